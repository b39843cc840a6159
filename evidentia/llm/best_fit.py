"""Best-fit decreasing packing.

Only documents of more than ``size`` tokens are cut, into pieces of ``size`` of which the first may be shorter. The pieces
are dealt in order of falling length, each to the open bin with the tightest room that holds it.

What that rule decides depends on lengths alone. So each task counts its pieces by length, and the bins are planned from
the counts of the whole corpus, ``size`` numbers whatever its size. Open bins stand in a segment tree over
remaining capacities, which tells the tightest in the logarithm of ``size``. Bins that have been filled alike are runs
of consecutive numbers and are filled together: pieces of one length go to all bins of the tightest capacity, as many to
each as it holds, before any other is touched, which is what dealing them one by one does. A length splits one run at most and opens
one, and a run at least halves its room whenever it is used, so the plan has some ten times as many rows as there are lengths,
and is broadcast. A piece's place follows from its rank among those of its length: its rank in its task, and the counts of the
tasks before, which join it by task and length. There is one packing of the whole corpus, and no bins are left half empty at the borders of tasks.

Tokens are those of the tokenizer file. They are made with the same vocabulary's rank file, which is much faster; special
tokens are split off before.

Defined cases: a null text is the empty text and gives one piece, the end token. Repeated rows are packed each for itself.
A null ``doc_id`` stays null. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm._shared import settle, small_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"
_SPECIAL = "<|endoftext|>"
#: A space after what is no white space: there the split pattern always begins anew.
_BREAK = re.compile(r"(?<=\S)(?= )")
_PART = 1 << 19


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids of texts as arrays of unsigned 32-bit numbers; long texts are read in parts."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.special = np.array([len(ranks)], np.uint32)
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _parts(self, text: str) -> Iterator[np.ndarray]:
        begin = 0
        while begin < len(text):
            m = _BREAK.search(text, begin + _PART)
            end = m.start() if m else len(text)
            yield self.encoding.encode_to_numpy(text[begin:end], disallowed_special=()).astype("<u4", copy=False)
            begin = end

    def __call__(self, text: str) -> np.ndarray:
        out: list[np.ndarray] = []
        for i, run in enumerate(text.split(_SPECIAL)):
            out += [self.special] * bool(i) + list(self._parts(run))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def cut(tokens: int, size: int) -> list[int]:
    """The lengths of a document's pieces."""
    return [tokens % size] * (tokens % size > 0) + [size] * (tokens // size)


class OpenBins:
    """Runs (first bin, number of bins) by remaining capacity, under a segment tree of their counts."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def _count(self, room: int, step: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += step
            i >>= 1

    def add(self, room: int, first: int, bins: int) -> None:
        self.runs[room].append((first, bins))
        self._count(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        self._count(room, -1)
        return self.runs[room].pop()

    def tightest(self, length: int) -> int | None:
        """The least capacity of ``length`` or more that an open bin has left."""
        i = length + self.leaves
        while not self.tree[i]:
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1  # the next subtree to the right
        while i < self.leaves:
            i = 2 * i + (not self.tree[2 * i])
        return i - self.leaves


def plan(counts: np.ndarray, size: int) -> np.ndarray:
    """Rows first, bin, each, used, of pieces numbered by falling length: from number ``first`` on, ``each`` of them go to one bin, from ``bin`` on, behind ``used`` tokens.

    counts: how many pieces there are of each length from 0 to ``size``.
    """
    bins, out, opened, number = OpenBins(size), [], 0, 0
    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            room = bins.tightest(length)
            if room is None:
                new = -(-left // (size // length))
                bins.add(size, opened, new)
                opened += new
                continue
            first, n = bins.take(room)
            each = room // length
            if full := min(n, left // each):
                out.append((number, first, each, size - room))
                bins.add(room - each * length, first, full)
                number, left, first, n = number + full * each, left - full * each, first + full, n - full
            if n and 0 < left < each:
                out.append((number, first, left, size - room))
                bins.add(room - left * length, first, 1)
                number, left, first, n = number + left, 0, first + 1, n - 1
            if n:
                bins.add(room, first, n)
    return np.array(out, np.int64).reshape(-1, 4)


def pieces_of(docs: DataFrame, size: int, end_id: int, ranks: str, with_ids: bool) -> DataFrame:
    """The pieces of all documents as a table; nth counts those of a length within its task."""
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task, seen = Encoder(ranks), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in small_batches(batches, "text"):
            out, kept = [[] for _ in range(6)], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, start = np.concatenate([encoder(text or ""), end]), 0
                for k, n in enumerate(cut(len(ids), size)):
                    piece = ids[start : start + n]
                    for col, value in zip(out, (doc_id, k, start, n, zlib.crc32(piece.tobytes()), seen[n]), strict=True):
                        col.append(value)
                    if with_ids:
                        kept.append(piece)
                    seen[n] += 1
                    start += n
            cols = [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(out)]
            cols.insert(5, pa.array(np.full(len(out[0]), task, np.int64)))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(out[3])]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "<u4"), *kept]).astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return settle(source.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else "")), "pieces")


def pack(docs: DataFrame, size: int = 2048, end_id: int = 0, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: its place in a sequence of at most ``size`` tokens; ``with_ids`` adds the ids themselves."""
    if size < 1:
        raise ValueError("size must be 1 at least")
    pieces = pieces_of(docs, size, end_id, ranks or default_ranks(), with_ids)
    counted = settle(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(size + 1, np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        counts[length] = n
    rows = plan(counts, size)
    longer = counts.sum() - np.cumsum(counts)  # pieces longer than each length
    shared = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(rows.T), longer))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    before = counted.select("task", "length", earlier.alias("before"))
    ranked = pieces.join(before.hint("merge"), ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before")).drop("task", "nth", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (first, bins, each, used), above = shared.value
        for batch in batches:
            length = batch.column(0).to_numpy()
            number = batch.column(batch.schema.get_field_index("rank")).to_numpy() + above[length]
            row = np.searchsorted(first, number, "right") - 1
            nth = number - first[row]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            cols += [pa.array(bins[row] + nth // each[row]), pa.array(used[row] + nth % each[row] * length)]
            yield pa.RecordBatch.from_arrays(cols, [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, ends of each sequence of ``pack(..., with_ids=True)``: its tokens, its documents, and where each ends in it."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))  # at most ``size`` tokens
    rows = packed.groupBy("sequence_id").agg(inside.alias("p"))
    ends = F.transform("p", lambda x: x["offset"] + x["length"])
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), ends.alias("ends"))
