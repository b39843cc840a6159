"""Language identification by a string kernel.

The kernel counts the distinct character n-grams of one to ``order`` characters (a blended spectrum) that two
texts share, divided by the root of the product of their own numbers. n-grams are hashed to 2**bits places,
so a text is a set of places. A bounded sample of labelled documents gives landmarks; the Nyström map of
the rest of the sample onto them feeds one ridge regression for each language against the others. As the
kernel is a product of presence vectors, a language's weights over landmarks fold into one weight for each
place, and texts are scored by products of presence matrices, in batches, with these weights.

Sample: ``per_lang`` documents of each language, fewer if there are more than ``sample`` // ``per_lang``
languages, but four at least, those of least hash; a quarter are landmarks. It is the only bound: every document
is read whole and every language is learned. Beyond sample // 4 languages the sample grows with their number,
by four rows of 2**bits 4-byte numbers each in the driver.

Defined cases: null texts and texts without a letter are "und" with score 0; without any learned language
all are; ties go to the language that sorts first; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm._grams import buckets, codes
from evidentia.llm._shared import settle, small_batches

_LETTER = re.compile(r"[^\W\d_]").search
_SLICE = 1 << 20


def presence(text: str, order: int, bits: int) -> np.ndarray:
    """Which places the n-grams of a text take."""
    mark = np.zeros(1 << bits, bool)
    points = codes(" ".join(text.lower().split()))
    for begin in range(0, max(len(points), 1), _SLICE):
        part = points[begin : begin + _SLICE + order - 1]
        for n in range(1, order + 1):
            mark[buckets(part, n, bits)] = True
    return mark


class Model:
    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, order: int, bits: int):
        self.langs, self.weights, self.bias, self.order, self.bits = langs, weights, bias, order, bits

    def predict(self, texts: list[str | None], rows: int = 64) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for begin in range(0, len(texts), rows):
            part = texts[begin : begin + rows]
            known = [t for t in part if t and _LETTER(t)] if self.langs else []
            if known:
                x = np.zeros((len(known), 1 << self.bits), np.float32)
                for i, t in enumerate(known):
                    x[i] = presence(t, self.order, self.bits)
                x /= np.sqrt(x.sum(axis=1, keepdims=True))
                f = x @ self.weights + self.bias
                best = iter(zip(f.argmax(axis=1).tolist(), np.clip((f.max(axis=1) + 1) / 2, 0, 1).tolist(), strict=True))
            for t in part:
                if self.langs and t and _LETTER(t):
                    at, score = next(best)
                    langs.append(self.langs[at])
                    scores.append(score)
                else:
                    langs.append("und")
                    scores.append(0.0)
        return langs, scores


def _sample(rows: DataFrame, per_lang: int, sample: int, order: int, bits: int) -> list:
    """Rows (lang, packed presence) of the training sample."""
    rows = rows.filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"[\p{L}\p{Nl}\p{No}]")
    ).withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)))
    counts = settle(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    found = counts.count()
    if not found:
        return []
    want = max(4, min(per_lang, sample // found))
    # A share of each language's hashes that holds the wanted number, with room for chance; the least of them are settled below.
    near = rows.join(counts, "lang").filter(F.col("h") < F.least(F.lit(1.0), (2 * want + 20) / F.col("n")) * float(1 << 40))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            bits_of = [np.packbits(presence(t, order, bits)).tobytes() if _LETTER(t) else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bits_of, pa.binary())], ["lang", "h", "marks"])

    packed = near.select("lang", "text", "h").mapInArrow(pack, "lang string, h long, marks binary").filter("marks is not null")
    least = packed.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h", "marks"))).filter(F.col("i") <= want)
    return [(r[0], bytes(r[2])) for r in sorted(least.select("lang", "h", "marks").collect(), key=lambda r: (r[1], r[0], r[2]))]


def learn(docs: DataFrame, train: Column, per_lang: int = 200, sample: int = 1600, order: int = 3, bits: int = 15, ridge: float = 0.01) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) where ``train`` holds."""
    rows = _sample(docs.filter(train).select("doc_id", "text", "lang"), per_lang, sample, order, bits)
    langs = sorted({lang for lang, _ in rows})
    if not langs:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0, np.float32), order, bits)
    x = np.unpackbits(np.frombuffer(b"".join(marks for _, marks in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
    x /= np.sqrt(x.sum(axis=1, keepdims=True))
    seen: dict[str, int] = {}
    landmark = []
    for i, (lang, _) in enumerate(rows):
        seen[lang] = seen.get(lang, -1) + 1
        if seen[lang] % 4 == 0:
            landmark.append(i)
    z = x[landmark]
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = (x @ z.T).astype(np.float64) @ root
    y = np.where(np.array([lang for lang, _ in rows])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    # Each language's rows weigh as much as the others' together.
    n = (y > 0).sum(axis=0)
    weights, bias = np.zeros((1 << bits, len(langs))), np.zeros(len(langs))
    for c in range(len(langs)):
        w = np.where(y[:, c] > 0, 0.5 / n[c], 0.5 / max(len(rows) - n[c], 1))
        mean, target = w @ phi / w.sum(), w @ y[:, c] / w.sum()
        centred = phi - mean
        beta = np.linalg.solve(
            centred.T @ (centred * w[:, None]) + ridge * np.eye(phi.shape[1]) * w.sum() / len(rows), centred.T @ (w * (y[:, c] - target))
        )
        weights[:, c] = z.T @ (root @ beta)
        bias[c] = target - mean @ beta
    return Model(langs, weights.astype(np.float32), bias.astype(np.float32), order, bits)


def identify(docs: DataFrame, held_out: Column, model: Model | None = None, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; the model is learned from the other rows unless given."""
    model = model or learn(docs, ~held_out, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            langs, scores = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"]
            )

    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), held_out.alias("held_out"), docs["text"]
    ).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
