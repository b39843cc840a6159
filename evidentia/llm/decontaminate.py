"""Benchmark decontamination by winnowing.

Words are hashed, every ``k`` words in a row get a fingerprint, and of each ``window - k + 1`` fingerprints
in a row the least is kept. A shared passage of ``window`` words or more has such a run on both sides, so
both sides keep the same fingerprint of it: none is missed. An item with fewer words is one window of its own length,
whose hash is its fingerprint. Fingerprints and windows of documents and of the benchmark meet in one join, and each hit
is extended to the words of its window.

Neither side is ever in one place: the benchmark's windows are a table, too. To move little of the documents, a bit map
of fixed size (``SLOTS`` bits) of the benchmark's fingerprints is broadcast, and documents only tell the windows whose
fingerprint it may hold. With a benchmark too large for it the map lets more pass, up to all, and the join stays right.

Defined cases: null texts have no words and are clean; items without words are skipped; a null item id is
named "null"; rows of the benchmark with one id count as one item; repeated documents are each returned; an
empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm._shared import Slots, numbered, settle, small_batches, without

#: Bytes that belong to words: digits, letters in lower case, and all beyond ASCII; others become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row."""
    count = max(len(hashes) - n + 1, 0)
    out = np.full(count, n, np.uint64)
    for i in range(n):
        out = out * _STEP + hashes[i : i + count]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def prints_of(hashes: np.ndarray, n: int, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each n words in a row, their fingerprint and their hash."""
    runs = _runs(hashes, n)
    if n < window:
        return runs, runs
    grams, least = _runs(hashes, k), None
    for i in range(n - k + 1):
        part = grams[i : i + len(runs)]
        least = part if least is None else np.minimum(least, part)
    return least, runs


class Hasher:
    """Hashes of words; the table of known ones starts anew when it is full."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)


def windows_of(benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """print, window, n, item: the windows of all items, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in small_batches(batches, "text", 1_000_000):
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                if words:
                    n = min(window, len(words))
                    prints, runs = prints_of(hasher(words), n, window, k)
                    size = len(runs)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(prints.view(np.int64)), pa.array(runs.view(np.int64)), pa.array(np.full(size, n, np.int32)),
                            pa.array([item] * size, pa.string())
                        ],
                        ["print", "window", "n", "item"]
                    )

    source = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("null")).alias("item"), benchmark["text"])
    return settle(source.mapInArrow(run, "print long, window long, n int, item string").distinct(), "windows")


def marks_of(source: DataFrame, sizes: list[int], slots: Slots, window: int, k: int) -> DataFrame:
    """mark, doc_id, n_words, hits (print, window, n, at) of each row of ``source`` (mark, doc_id, text), as a table: windows that the benchmark may hold."""
    shared, bits = slots.shared, slots.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in small_batches(batches, "text"):
            words, counts = [], []
            for text in batch.column(2).to_pylist():
                own = words_of(text)
                counts.append(len(own))
                words += own
            hashes, counts = hasher(words), np.array(counts, np.int64)
            begin = np.cumsum(counts) - counts
            doc = np.repeat(np.arange(len(counts)), counts)
            found: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, np.int64) for _ in range(5))]
            for n in sizes:
                prints, runs = prints_of(hashes, n, window, k)
                at = np.flatnonzero(Slots.test(shared.value, prints, bits))
                at = at[doc[at] == doc[at + n - 1]]
                found.append((doc[at], prints[at].view(np.int64), runs[at].view(np.int64), np.full(len(at), n), at - begin[doc[at]]))
            own, prints, runs, n, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(own, kind="stable")
            ends = np.searchsorted(own[order], np.arange(len(counts) + 1)).astype(np.int32)
            hit = pa.StructArray.from_arrays(
                [pa.array(prints[order]), pa.array(runs[order]), pa.array(n[order].astype(np.int32)), pa.array(at[order])],
                ["print", "window", "n", "at"]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), hit)],
                ["mark", "doc_id", "n_words", "hits"]
            )

    return settle(
        source.mapInArrow(run, "mark long, doc_id long, n_words long, hits array<struct<print:long, window:long, n:int, at:long>>"), "marks"
    )


def _hits(source: DataFrame, benchmark: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The marks of ``source``, the windows, and mark, window, n, at of each window of the benchmark in a document, as tables."""
    windows = windows_of(benchmark, window, k)
    sizes = sorted(r[0] for r in windows.select("n").distinct().collect())  # window lengths, at most ``window``
    slots = Slots(windows.select(F.col("print")), "print", hashed=True)
    marks = marks_of(source, sizes, slots, window, k)
    slots.shared.destroy()
    told = marks.filter(F.size("hits") > 0).select("mark", F.explode("hits").alias("h")).select("mark", "h.print", "h.window", "h.n", "h.at")
    # A table on each side, so that a passage that many documents share can be split.
    known = settle(windows.select("print", "window", "n").distinct(), "known")
    return marks, windows, settle(told.join(known, ["print", "window", "n"]).select("mark", "window", "n", "at"), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Per document: words, words hit, items found and a digest of their ids."""
    source = docs.select(F.monotonically_increasing_id().alias("mark"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    marks, windows, hits = _hits(source, benchmark, window, k)
    # Hit words: the union of the spans of one document, in order of their begin.
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach"))

    def add(acc, span):
        end = span["at"] + span["n"]
        return F.struct(
            (acc["total"] + F.greatest(end - F.greatest(span["at"], acc["reach"]), F.lit(0).cast("long"))).alias("total"),
            F.greatest(acc["reach"], end).alias("reach")
        )

    spans = hits.groupBy("mark").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans")).select(
        "mark", F.aggregate("spans", start, add, lambda acc: acc["total"]).alias("n_hit")
    )
    pairs = settle(hits.select("mark", "window", "n").distinct(), "pairs")
    items = pairs.join(
        windows.select("window", "n", "item").distinct(), ["window", "n"]
    ).groupBy("mark").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = items.select("mark", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    found = marks.select("mark", "doc_id", "n_words").join(spans, "mark", "left").join(items, "mark", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of the benchmark occurs. ``docs`` must be a table."""
    rows, number = numbered(docs)
    source = rows.select(F.col(number).alias("mark"), F.lit(None).cast("long").alias("doc_id"), docs["text"])
    _, _, hits = _hits(source, benchmark, window, k)
    return without(rows, number, settle(hits.select(F.col("mark").alias(number)).distinct(), "contaminated"))
