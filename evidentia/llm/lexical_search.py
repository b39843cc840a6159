"""Ranked lexical search by inverted treaps.

Documents are indexed in blocks, one row each. A block holds, for each of its terms, a treap of the documents with the term:
a search tree by document whose nodes lie in a heap by impact, what the term's weight is multiplied by in the document's
score. The nodes of a treap are stored in order of documents, with their impacts and the distances to both children; the
first node of an interval of documents is the greatest impact in it.

A query walks the treaps of all its terms at once. It starts from the interval of all documents of a block and each
term's root. The sum of the weighted impacts of an interval's nodes bounds all scores in it; if that is below the k-th best score
so far, the interval and all subtrees in it are left. Else the document of the node with the greatest
weighted impact is scored and divides the interval, and each term's first node on either side is found by descent.
Intervals of one depth are handled together, in arrays, for many queries at once. A task carries its best scores from block to
block and returns k rows a query; these meet in two rounds of windows.

``build`` needs the corpus's number of documents and of terms for the impacts, so it first writes the blocks' plain lists and
their totals. Document frequencies are summed over the blocks for the terms of the queries only. Queries are taken in
groups of bounded size, each sent to all tasks, and each group's result is written before the next begins. No term, however frequent, is a
key of a shuffle: its list is spread over the blocks, and a block's work is bounded by its text.

Defined cases: null and empty texts have no terms, are in no list and don't count; nor do queries without terms have
results. Each row is a document, or a query, by itself, ids repeated or null. Equal scores are in order of ``doc_id``,
null first. A term that nearly all documents hold may weigh nothing. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm._shared import drop, settle, small_batches, tidy

#: Bytes of words, in lower case: digits, letters, and all beyond ASCII.
_TERMS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]").search
_PART = 1 << 20
BLOCK_BYTES, BLOCK_ROWS = 8_000_000, 4096
#: Nodes that the intervals of a walk hold together at most, if no query has more; bytes and rows of a group of queries.
WALK_NODES, GROUP_BYTES, GROUP_ROWS = 1_000_000, 4_000_000, 10_000


def terms_of(text: bytes | str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in order, in lists of about a million bytes."""
    data = (text.encode() if isinstance(text, str) else text or b"").lower()  # bytes know no letters but A to Z
    begin = 0
    while begin < len(data):
        m = _BETWEEN(data, begin + _PART)
        end = m.start() if m else len(data)
        yield _TERMS(data, begin, end)
        begin = end


def _put(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte of these, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _get(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


LISTS = "n_docs long, n_terms long, ids binary, sizes binary, terms binary, counts binary, docs binary, tf binary"
TREAPS = "ids binary, terms binary, counts binary, docs binary, impact binary, left binary, right binary"


def lists_of(docs: DataFrame) -> DataFrame:
    """Blocks of plain lists: documents with their sizes, terms with their numbers of documents, and these with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BLOCK_BYTES, BLOCK_ROWS):
            known: dict[bytes, int] = defaultdict()
            known.default_factory = known.__len__
            ids, sizes, found = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = [np.fromiter(map(known.__getitem__, part), np.int64, len(part)) for part in terms_of(text.as_py())]
                if size := sum(map(len, own)):
                    found += [part * BLOCK_ROWS + len(ids) for part in own]
                    ids.append(doc_id)
                    sizes.append(size)
            if not ids:
                continue
            keys, tf = np.unique(np.concatenate(found), return_counts=True)
            row = (
                len(ids), sum(sizes), pa.array(ids, pa.int64()), _put(np.array(sizes)), zstandard.compress(b" ".join(known), 1),
                _put(np.bincount(keys // BLOCK_ROWS, minlength=len(known))), _put(keys % BLOCK_ROWS), _put(tf)
            )
            yield _row(LISTS, row)
        tidy()

    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"))
    return settle(source.mapInArrow(run, LISTS), "lists")


def _row(schema: str, values: tuple) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    cols = [pa.array([_ids_out(v) if isinstance(v, pa.Array) else v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values]
    return pa.RecordBatch.from_arrays(cols, names)


def _ids_out(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.compress(sink.getvalue().to_pybytes(), 1)


def _ids_in(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_all().column(0).combine_chunks()


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term's weight is multiplied by in a document of ``size`` terms that holds it ``tf`` times."""
    length = 100 - 50 + 50 * size * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 20 * length)


def _nearest_greater(key: np.ndarray, bound: np.ndarray, step: int) -> np.ndarray:
    """For each place the nearest one in direction ``step`` with a greater key, ``bound`` (the place beyond its segment) if there is none."""
    at = np.arange(len(key)) + step
    live = np.flatnonzero(at != bound)
    while len(live):
        live = live[key[at[live]] < key[live]]
        at[live] = at[at[live]]  # all between a place and where it points is less
        live = live[at[live] != bound[live]]
    return at


def children(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots of the treaps of consecutive segments of ``counts`` nodes, and the distance of each node to its left and its right child, 0 for none.

    A node's parent is the lesser of the nearest greater ones on either side. No two keys of a segment are equal.
    """
    n, end = len(key), np.repeat(np.cumsum(counts), counts)
    begin = end - np.repeat(counts, counts)
    before, after = _nearest_greater(key, begin - 1, -1), _nearest_greater(key, end, 1)
    low = np.iinfo(np.int64).min
    over_before = np.where(before >= begin, key[np.maximum(before, 0)], low) if n else key
    over_after = np.where(after < end, key[np.minimum(after, n - 1)], low) if n else key
    lone = (over_before == low) & (over_after == low)
    to_before = (over_after == low) | ((over_before != low) & (over_before < over_after))
    left, right, at = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    under = ~lone & to_before
    right[before[under]] = at[under] - before[under]
    under = ~lone & ~to_before
    left[after[under]] = after[under] - at[under]
    return at[lone], left, right


def _keys(impact: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Heap keys: the impact, and among equal ones a scattered order of the documents, which keeps treaps low."""
    return impact << 32 | ((docs * 0x9E3779B1 & 0xFFFFFFFF) >> 20 << 12) | docs


class Index(NamedTuple):
    """An index: its blocks, and the corpus's number of documents with a term and of terms."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame) -> Index:
    """Index all rows of ``docs`` (doc_id, text)."""
    lists = lists_of(docs)
    n_docs, n_terms = (x or 0 for x in lists.agg(F.sum("n_docs"), F.sum("n_terms")).first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, terms, counts, docs_, tf = (batch.column(c)[i].as_py() for c in range(6))
                doc, own = _get(docs_), _get(counts)
                impact = impacts(_get(tf), _get(sizes)[doc], n_docs, n_terms)
                _, left, right = children(_keys(impact, doc), own)
                yield _row(TREAPS, (ids, terms, counts, docs_, _put(impact), _put(left), _put(right)))
        tidy()

    blocks = settle(lists.select("ids", "sizes", "terms", "counts", "docs", "tf").mapInArrow(run, TREAPS), "treaps")
    drop(lists)
    return Index(blocks, n_docs, n_terms)


def frequencies(blocks: DataFrame, terms: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each of these terms."""
    shared = blocks.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for own, counts in zip(batch.column(0), batch.column(1), strict=True):
                counts = _get(counts.as_py())
                for i, term in enumerate(zstandard.decompress(own.as_py()).split(b" ")):
                    if term in shared.value:
                        total[term] += int(counts[i])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    found = blocks.select("terms", "counts").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n")).collect()
    shared.destroy()
    return {bytes(term): n for term, n in found}


class Best:
    """The k best documents of each query of a walk so far, and the score that another must reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least
        self.query, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """doc: numbers in the order in which equal scores are ranked."""
        reach = score >= self.least[query]
        if not reach.any():
            return
        query, score, doc = (np.concatenate(x) for x in ((self.query, query[reach]), (self.score, score[reach]), (self.doc, doc[reach])))
        order = np.lexsort((doc, -score, query))
        query, score, doc = query[order], score[order], doc[order]
        begin = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(begin, np.diff(begin, append=len(query)))
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(score[last], 1)
        kept = rank < self.k
        self.query, self.score, self.doc = query[kept], score[kept], doc[kept]


class Walk(NamedTuple):
    """The treaps of a block: documents, impacts and children of their nodes, -1 for none."""

    doc: np.ndarray
    impact: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def first(self, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The greatest node of the interval from ``low`` to before ``high`` at or below each node, -1 if there is none."""
        node = node.copy()
        live = np.flatnonzero(node >= 0)
        while len(live):
            own = node[live]
            doc = self.doc[own]
            over, under = doc >= high[live], doc < low[live]
            off = over | under
            live, own, over = live[off], own[off], over[off]
            node[live] = step = np.where(over, self.left[own], self.right[own])
            live = live[step >= 0]
        return node

    def run(self, query: np.ndarray, node: np.ndarray, weight: np.ndarray, n_docs: int, best: Best, order: np.ndarray) -> None:
        """Walk from the roots ``node`` of the terms of queries, in order of ``query``; order: the rank of each document's id."""
        begin = np.flatnonzero(np.diff(query, prepend=-1))
        query, low, high = query[begin], np.zeros(len(begin), np.int64), np.full(len(begin), n_docs)
        while len(begin):
            size = np.diff(begin, append=len(node))
            value = weight * self.impact[node]
            bound = np.add.reduceat(value, begin)
            open_ = bound >= best.least[query]
            if not open_.any():
                return
            entry = np.repeat(open_, size)
            node, weight, value = node[entry], weight[entry], value[entry]
            query, low, high, size = query[open_], low[open_], high[open_], size[open_]
            begin = np.cumsum(size) - size
            own = np.repeat(np.arange(len(size)), size)  # the interval of each node
            top = np.flatnonzero(value == np.maximum.reduceat(value, begin)[own])
            cut = np.zeros(len(size), np.int64)
            cut[own[top]] = self.doc[node[top]]
            cuts = cut[own]
            at = self.first(node, cuts, cuts + 1)
            score = np.add.reduceat(np.where(at >= 0, weight * self.impact[at], 0), begin)
            best.add(query, score, order[cut])
            sides = [(self.first(node, low[own], cuts), low, cut), (self.first(node, cuts + 1, high[own]), cut + 1, high)]
            parts = []
            for found, lo, hi in sides:
                kept = found >= 0
                left = np.bincount(own[kept], minlength=len(size))
                some = left > 0
                parts.append((found[kept], weight[kept], left[some], query[some], lo[some], hi[some]))
            node, weight, size, query, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
            begin = np.cumsum(size) - size


class Group(NamedTuple):
    """Queries with their numbers, and for each term its queries, by place, and its weight."""

    numbers: np.ndarray
    terms: dict[bytes, tuple[np.ndarray, int]]


def weigh(index: Index, queries: list[tuple[int, str | None]]) -> Group:
    places: dict[bytes, list[int]] = defaultdict(list)
    for place, (_, text) in enumerate(queries):
        for term in {t for part in terms_of(text) for t in part}:
            places[term].append(place)
    df = frequencies(index.blocks, set(places))
    weights = {t: math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    return Group(np.array([n for n, _ in queries], np.int64), {t: (np.array(places[t]), w) for t, w in weights.items() if w > 0})


def _chunks(query: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of the sorted ``query`` whose sizes sum to ``WALK_NODES`` at most, or of one query."""
    edge = np.append(np.flatnonzero(np.diff(query, prepend=-1)), len(query))
    total, begin = np.append(0, np.cumsum(size)), 0
    for i in range(1, len(edge)):
        if i == len(edge) - 1 or total[edge[i + 1]] - total[edge[begin]] > WALK_NODES:
            yield edge[begin], edge[i]
            begin = i


def _search_group(index: Index, group: Group, k: int) -> DataFrame:
    """query, doc_id, score: the k best of each task."""
    shared = index.blocks.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, wanted = shared.value
        least, kept = np.ones(len(numbers), np.int64), None
        for batch in batches:
            for i in range(batch.num_rows):
                ids, terms, counts, *nodes = (batch.column(c)[i].as_py() for c in range(7))
                found = [(j, *wanted[t]) for j, t in enumerate(zstandard.decompress(terms).split(b" ")) if t in wanted]
                if not found:
                    continue
                counts, (doc, impact, left, right), ids = _get(counts), map(_get, nodes), _ids_in(ids)
                at = np.arange(len(doc))
                walk = Walk(doc, impact, np.where(left, at - left, -1), np.where(right, at + right, -1))
                begin = np.cumsum(counts) - counts
                child = np.zeros(len(doc), bool)
                child[walk.left[left > 0]] = child[walk.right[right > 0]] = True
                roots = np.flatnonzero(~child)  # one a term, in order
                term = np.repeat([j for j, _, _ in found], [len(q) for _, q, _ in found])
                query, weight = np.concatenate([q for _, q, _ in found]), np.repeat([w for *_, w in found], [len(q) for _, q, _ in found])
                order = np.argsort(query, kind="stable")
                term, query, weight = term[order], query[order], weight[order]
                # Numbers of the documents in order of their ids, null first.
                by_id = pa.compute.sort_indices(ids, null_placement="at_start").to_numpy()
                rank = np.empty(len(ids), np.int64)
                rank[by_id] = np.arange(len(ids))
                parts = []
                for a, b in _chunks(query, counts[term]):
                    best = Best(least, k)
                    walk.run(query[a:b], roots[term[a:b]], weight[a:b], len(ids), best, rank)
                    parts.append((best.query, best.score, by_id[best.doc]))
                query, score, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                now = pa.table({"query": query, "score": score, "doc_id": ids.take(pa.array(at))})
                kept = now if kept is None else pa.concat_tables([kept, now])
                kept = _top(kept, k)
                least = _least(kept, len(numbers), k)
        if kept is not None:
            kept = kept.set_column(0, "query", pa.array(numbers[kept.column("query").to_numpy()]))
            yield from kept.select(["query", "doc_id", "score"]).to_batches()
        tidy()

    return index.blocks.select(*[c.split()[0] for c in TREAPS.split(", ")]).mapInArrow(run, "query long, doc_id long, score long")


def _top(rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of each query, best first."""
    keys = [("query", "ascending"), ("score", "descending"), ("doc_id", "ascending")]
    rows = rows.take(pa.compute.sort_indices(rows, sort_keys=keys, null_placement="at_start")).combine_chunks()
    query = rows.column("query").to_numpy()
    begin = np.flatnonzero(np.diff(query, prepend=-1))
    rank = np.arange(len(query)) - np.repeat(begin, np.diff(begin, append=len(query)))
    return rows.filter(pa.array(rank < k))


def _least(rows: pa.Table, queries: int, k: int) -> np.ndarray:
    """The score that a further document of each query must reach, from its rows in order."""
    query, score, out = rows.column("query").to_numpy(), rows.column("score").to_numpy(), np.ones(queries, np.int64)
    full = np.bincount(query, minlength=queries) >= k
    last = np.flatnonzero(np.diff(query, append=-1))
    last = last[full[query[last]]]
    out[query[last]] = np.maximum(score[last], 1)
    return out


def _ranked(rows: DataFrame, k: int, *more: str) -> DataFrame:
    own = Window.partitionBy("query", *more).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 50) -> DataFrame:
    """query, rank, doc_id, score: the ``k`` best documents of each row of ``queries`` (query long, unique; text)."""
    spark, results = queries.sparkSession, []
    rows: list[tuple[int, str | None]] = []
    size = 0

    def answer() -> None:
        found = _search_group(index, weigh(index, rows), k).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))
        results.append(settle(_ranked(_ranked(found, k, "part").drop("rank"), k).select("query", "rank", "doc_id", "score"), "found"))

    for number, text in queries.select("query", "text").toLocalIterator():  # a partition at a time
        rows.append((number, text))
        size += len(text or "")
        if size >= GROUP_BYTES or len(rows) >= GROUP_ROWS:
            answer()
            rows, size = [], 0
    if rows:
        answer()
    if not results:
        return spark.createDataFrame([], "query long, rank int, doc_id long, score long")
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other)
    return out


def rank(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text)."""
    asked = settle(items.select(F.monotonically_increasing_id().alias("query"), items["item_id"].alias("item_id"), items["text"].cast("string").alias("text")), "asked")
    found = search(build(docs), asked, k)
    return found.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
