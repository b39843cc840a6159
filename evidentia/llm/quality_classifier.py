"""Quality classifier with supervised subword embeddings.

Words, pairs of words in a row and character n-grams (3 to 5 characters of a word with its borders) are hashed
to 2**bits places, each with a learned vector; pairs of one word with itself share a place, so that repetition
is learned as such. A document is the mean of the vectors of all its features, and a softmax over
two classes stands on it; both are trained by stochastic gradient descent in numpy on a bounded sample of
``sample`` labelled documents, those of least hash. Since class scores are linear in the vectors, scoring
needs one number for each place, the difference of its two class scores, and reads every text whole.

Defined cases: null and empty texts have no features and get the softmax of the biases, close to the share of
label 1; labels other than 0 and 1, and null ids, teach nothing; of repeated labels of one id each counts; where ids of the
sample repeat among documents, twice ``sample`` rows are learned from at most, those of the least ids;
without labels all scores are 0.5; repeated documents are each scored; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm._grams import buckets, codes
from evidentia.llm._shared import filter_texts, small_batches, tidy

_SLICE = 1 << 20
_TWICE = 0x5BD1E995


def features(text: str | None, bits: int) -> Iterator[np.ndarray]:
    """The places of all features of a text, in parts."""
    words = (text or "").split()
    mask = (1 << bits) - 1
    for begin in range(0, len(words), 1 << 16):
        part = words[begin : begin + (1 << 16)]
        own = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in part], np.uint32)
        yield own & np.uint32(mask)
        pair = (own[:-1] * np.uint32(0x9E3779B1)) ^ (own[1:] * np.uint32(0x85EBCA6B))
        yield np.where(own[:-1] == own[1:], np.uint32(_TWICE & mask), (pair ^ (pair >> np.uint32(15))) & np.uint32(mask))
        points = codes(" " + " ".join(part) + " ")
        for at in range(0, len(points), _SLICE):
            piece = points[at : at + _SLICE + 4]
            gaps = np.concatenate([[0], np.cumsum(piece == 32)])
            for n in (3, 4, 5):
                if len(piece) < n or (at and len(piece) < 5):
                    continue
                # No border strictly inside: gaps are counted from the second to the last but one.
                count = len(piece) - n + 1
                inside = gaps[n - 1 : n - 1 + count] - gaps[1 : 1 + count]
                yield buckets(piece, n, bits)[inside == 0]


class Model:
    def __init__(self, place: np.ndarray, bias: float, bits: int):
        self.place, self.bias, self.bits = place, bias, bits

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            total, count = 0.0, 0
            for at in features(text, self.bits):
                total += float(self.place[at].sum(dtype=np.float64))
                count += len(at)
            if count:
                out[i] += total / count
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def _descend(rows: list[tuple[int, np.ndarray, np.ndarray]], dim: int, epochs: int, rate: float, bits: int) -> Model:
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    output, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, at, share = rows[i]
            own = vectors[at]
            mean = share @ own
            z = output @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            now = rate * (1 - step / steps)
            back = output.T @ p
            output -= now * np.outer(p, mean)
            bias -= 0.1 * now * p
            vectors[at] = own - now * share[:, None] * (back * len(at) ** 0.5)
            step += 1
    return Model((vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0]), bits)


def learn(
    docs: DataFrame, labels: DataFrame, train: Column, sample: int = 1500, dim: int = 8, epochs: int = 8, rate: float = 0.3, bits: int = 16
) -> Model:
    """Learn from documents where ``train`` holds and ``labels`` (doc_id, quality) has 0 or 1."""
    marks = labels.select(labels["doc_id"].alias("k"), labels["quality"].cast("int").alias("y")).filter("y in (0, 1) and k is not null")
    own = docs.filter(train).select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    # The sample is chosen among ids first, so that only its texts are moved.
    ids = own.select("doc_id").join(marks, own["doc_id"] == marks["k"]).withColumn("h", F.xxhash64("doc_id"))
    picked = ids.orderBy("h", "doc_id", "y").limit(sample).select("k", "y").collect()
    if not picked:
        return Model(np.zeros(1 << bits, np.float32), 0.0, bits)
    wanted = docs.sparkSession.createDataFrame([(int(r[0]), int(r[1])) for r in picked], "k long, y int")
    texts = own.join(F.broadcast(wanted), own["doc_id"] == wanted["k"]).select("k", "y", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            out = []
            for text in batch.column(2).to_pylist():
                n = np.zeros(1 << bits, np.int64)
                for at in features(text, bits):
                    n += np.bincount(at, minlength=1 << bits)
                at = np.flatnonzero(n)
                out.append((at.astype("<u4").tobytes(), (n[at] / max(n.sum(), 1)).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))], ["k", "y", "at", "share"]
            )

    rows = texts.mapInArrow(count, "k long, y int, at binary, share binary").orderBy("k", "y", "at").limit(2 * sample).toLocalIterator()
    seen = [(r[1], np.frombuffer(bytes(r[2]), "<u4"), np.frombuffer(bytes(r[3]), "<f4")) for r in rows]
    model = _descend([r for r in seen if len(r[1])], dim, epochs, rate, bits)
    del rows, seen
    tidy()
    return model


def score(docs: DataFrame, model: Model, held_out: Column, threshold: float = 0.3) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            scores = shared.value.scores(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"]
            )

    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), held_out.alias("held_out"), docs["text"]
    ).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_texts(docs, lambda texts: shared.value.scores(texts) >= threshold)
