"""N-gram Jaccard join with prefix trees.

A document's set holds its distinct word shingles as 48-bit hashes; documents with one and the same set form
a class, known by a 64-bit hash of the set, and only classes are joined. Two sets that reach the threshold t share
a shingle among the first n - ceil(t n) + 1 of each under any one global order, and among fewer of the smaller.

The order is by exact document frequency, rare shingles first, and then by hash. Frequencies are counted in shards
of the hashes' range, to which blocks of sets deal their distinct shingles, as sorted differences, with the numbers of
their sets, so that one in all sets is one entry a block; a shard answers each block
with those of its shingles that stand in two sets or more. To move less, a fixed share of all shingles, by hash, goes
first in the order, and only these are counted; it is wide enough for the prefixes of sets of ``SMALL`` shingles and
more (the few for which it isn't go on in the order of hashes). Smaller sets have an order of their own over all their
shingles; sets near the limit stand in both. Shingles of one set alone can't be shared, so sets whose prefix holds
no others are done: no counting table of fixed size or broadcast has a part in this.

What is left meets in buckets of one shingle and one band of sizes; buckets with the same members count once.
Joining goes in two rounds. In the first, each bucket's hub (the member whose shingles are shared the most,
so alike buckets have the same hub) is joined with the others, which links most copies of a text in linear work. In the second, the other
members of buckets that are not connected yet are joined with each other, those of one hub together, without pairs
that are connected already, so no link between different components is lost. A join stores the sets of one side in a
prefix tree with one path for each common beginning; each set of the other side walks it, adds up the overlap along
shared paths, and leaves a subtree as soon as the overlap so far and what can remain of either side stay
below the threshold. Large groups are cut into pairs of chunks of bounded size; no group is held whole.
Components come from alternating star steps over the links, in tables.

Hot keys: buckets, hubs and classes are summed before they are shuffled, and each join by such a key has plain tables
on both sides and leads to another key, so that adaptive execution can split it.

Defined cases: null, empty and blank texts have no shingles and link with nothing; texts with fewer words than
a shingle have one, the whole sequence; repeated rows share a class; null ids never name a component unless all
its ids are null; an empty table gives no rows; other columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm._shared import Slots, drop, expand, numbered, settle, small_batches, squeeze, without

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BITS = 48
SMALL = 64
#: Shingles that a block and a shard hold, and sets and shingles of a chunk, at most (or one set).
BLOCK, SHARD, CHUNK, CHUNK_KEYS = 400_000, 1_000_000, 256, 500_000


# Sets


def _hashes(words: list[bytes], k: int, known: dict[bytes, int]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of k words, sorted."""
    own = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        own.append(h)
    own = np.array(own, np.uint64)
    width = min(k, len(own))
    count = len(own) - width + 1
    out = np.full(count, width, np.uint64)
    for i in range(width):
        out = (out ^ own[i : i + count]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _narrow(keys: np.ndarray) -> bytes:
    """Six bytes of each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _wide(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").reshape(-1)


def _counted(n: np.ndarray) -> bytes:
    """Numbers of sets; 2^32 - 1 stands for all greater ones too, which only order shingles."""
    return zstandard.compress(np.minimum(n, 0xFFFFFFFF).astype("<u4").tobytes(), 1)


def _counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<u4")


class Threshold:
    """Jaccard similarity of at least num / den, and what follows from it for a set of n shingles."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        #: Sets up to this size stand in the order of the small ones.
        self.cap = SMALL * den // num
        #: Of 2**16 values of a shingle's lowest bits, those that go first in the order of the large ones.
        self.first = min(1 << 16, math.ceil((1 << 16) * 2.5 * (den - num) / den) + 1)
        # A little wider than the threshold, so that near sizes are at most one band apart whatever the rounding.
        self.band = math.log(den / num) * (1 + 1e-9) if den > num else 1.0

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def early(self, n: int) -> int:
        """How much of the smaller set must hold the first common shingle."""
        return n - -(-2 * self.num * n // (self.num + self.den)) + 1

    def counted(self, keys: np.ndarray, n: int) -> np.ndarray:
        return keys if n <= self.cap else keys[(keys & np.uint64(0xFFFF)) < self.first]

    def worlds(self, counted: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """The counted shingles of a set in each order it stands in, marked with the order in the lowest bit."""
        if n <= self.cap:
            yield counted << np.uint64(1)
        if n >= SMALL:
            yield (counted[(counted & np.uint64(0xFFFF)) < self.first] << np.uint64(1)) | np.uint64(1)


def sets_of(source: DataFrame, k: int, limit: Threshold) -> DataFrame:
    """mark, id, n, cls, block, counted, rest, spill of every row of ``source`` (mark, id, text). A task gives the shingles of a class once.

    counted: shingles whose frequency is counted; rest: the others; spill: the first of these, where the counted
    ones are fewer than the prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: set[int] = set()
        known: dict[bytes, int] = {}
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in small_batches(batches, "text"):
            if len(known) > 200_000:
                known.clear()
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(2).to_pylist():
                words = (text or "").encode().lower().split()
                row: tuple = (0, None, None, None, None, None)
                if words:
                    found = _hashes(words, k, known)
                    cls = xxhash.xxh3_64_intdigest(found.tobytes())
                    cls -= (cls >> 63) << 64
                    n = len(found)
                    row = (n, cls, None, None, None, None)
                    if cls not in seen:
                        seen.add(cls)
                        keys = np.unique(found >> np.uint64(64 - _BITS))
                        counted = limit.counted(keys, n)
                        others = (keys & np.uint64(0xFFFF)) >= limit.first
                        rest = keys[others] if len(counted) < len(keys) else keys[:0]
                        short = limit.prefix(n) - (len(keys) - int(others.sum())) if n >= SMALL else 0
                        if held > BLOCK:
                            block, held = block + 1, 0
                        held += len(counted)
                        row = (n, cls, block, _narrow(counted), _narrow(rest), _narrow(keys[others][:short]) if short > 0 else None)
                for col, value in zip(out, row, strict=True):
                    col.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))],
                ["mark", "id", "n", "cls", "block", "counted", "rest", "spill"]
            )

    return source.mapInArrow(run, "mark long, id long, n long, cls long, block long, counted binary, rest binary, spill binary")


# Frequencies


def frequencies(sets: DataFrame, limit: Threshold) -> DataFrame:
    """block, keys, counts: for each block, parts of its counted shingles that stand in two sets or more."""
    expected = sets.agg(F.sum(F.octet_length("counted"))).first()[0] or 0
    shards = max(2 * sets.sparkSession.sparkContext.defaultParallelism, expected // 6 // SHARD + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(parts), return_counts=True)
            shard = ((keys >> np.uint64(_BITS + 1 - 32)) * np.uint64(shards)) >> np.uint64(32)
            own, at = np.unique(shard, return_index=True)
            rows, numbers = [squeeze(p) for p in np.split(keys, at[1:])], [_counted(n) for n in np.split(times, at[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(own.astype(np.int32)), pa.array([block] * len(rows), pa.int64()), pa.array(rows, pa.binary()), pa.array(numbers, pa.binary())],
                ["shard", "block", "data", "times"]
            )

        block, parts, size = None, [], 0
        for batch in small_batches(batches, "counted"):
            for b, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block or size > 2 * BLOCK:
                    if size:
                        yield done()
                    block, parts, size = b, [], 0
                parts += limit.worlds(_wide(data), n)
                size += len(data) // 6
        if size:
            yield done()

    def answer(group: pa.Table) -> pa.Table:
        keys = [expand(d) for d in group.column("data").to_pylist()]
        ends = np.cumsum([len(k) for k in keys])
        times = np.concatenate([_counts(d) for d in group.column("times").to_pylist()])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.bincount(at, times).astype(np.int64)  # exact below 2^53
        found, numbers = [], []
        for own, part in zip(keys, np.split(counts[at], ends[:-1]), strict=True):
            keep = part > 1
            found.append(squeeze(own[keep]))
            numbers.append(_counted(part[keep]))
        return pa.table({"block": group.column("block"), "keys": pa.array(found, pa.binary()), "counts": pa.array(numbers, pa.binary())})

    dealt = sets.select("block", "n", "counted").mapInArrow(deal, "shard int, block long, data binary, times binary")
    return dealt.groupBy("shard").applyInArrow(answer, "block long, keys binary, counts binary")


# Buckets


def _bucket(keys: np.ndarray, band: int) -> np.ndarray:
    out = (keys ^ (np.uint64(band + 1) << np.uint64(56))) * _MIX
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def postings(sets: DataFrame, answers: DataFrame, limit: Threshold) -> DataFrame:
    """bucket, cls, n, weight, early: where each class stands by the shared shingles of its prefix. weight: how much it shares in all."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = [expand(d) for d in right.column("keys").to_pylist()]
        counts = [_counts(d) for d in right.column("counts").to_pylist()]
        keys, counts = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (keys, counts))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.uint64)
        out: tuple[list, ...] = ([], [], [], [], [])
        for cls, n, data, spill in zip(*(left.column(c).to_pylist() for c in ("cls", "n", "counted", "spill")), strict=True):
            band, full, early = int(math.log(n) / limit.band), limit.prefix(n), limit.early(n)
            for own in limit.worlds(_wide(data), n):
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    often = np.where(keys[at] == own, counts[at], 1)
                else:
                    often = np.ones(len(own), np.uint64)
                weight = min(int(often.sum()) - len(own), (1 << 30) - 1)
                by = np.lexsort((own, often))[:full]
                own, shared = own[by], often[by] > 1
                if len(own) < full and spill:
                    more = (_wide(spill)[: full - len(own)] << np.uint64(1)) | np.uint64(1)
                    own, shared = np.concatenate([own, more]), np.concatenate([shared, np.ones(len(more), bool)])
                # As the larger or equal in its own band, as the smaller also in the next.
                soon = shared.copy()
                soon[early:] = False
                for b, pick in ((band, shared), (band + 1, soon)):
                    if pick.any():
                        out[0].append(_bucket(own[pick], b))
                        out[1].append(np.full(len(out[0][-1]), cls))
                        out[2].append(np.full(len(out[0][-1]), n))
                        out[3].append(np.full(len(out[0][-1]), weight))
                        out[4].append(soon[pick])
        kinds = (np.int64, np.int64, np.int64, np.int64, bool)
        return pa.table(
            {
                c: pa.array(np.concatenate(x) if x else np.zeros(0, t)) for c, x, t in zip(
                    ("bucket", "cls", "n", "weight", "early"), out, kinds, strict=True
                )
            }
        )

    own = sets.select("block", "cls", "n", "counted", "spill")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "bucket long, cls long, n long, weight long, early boolean")


def members_of(posts: DataFrame) -> DataFrame:
    """bucket, cls, n, size, hub, hub_n: the members of each bucket with two or more, once for each set of members."""
    once = settle(posts.groupBy("bucket", "cls", "n").agg(F.max("early").alias("early"), F.max("weight").alias("weight")), "posts")
    # The greatest weight, and of ties one by hash, which all buckets with these members choose alike.
    rank = F.shiftleft("weight", 32) + F.pmod(F.xxhash64("cls"), F.lit(1 << 32))
    mixed = F.xxhash64("cls")
    sums = once.groupBy("bucket").agg(
        F.bit_xor(mixed).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("size"),
        F.max("early").alias("early"), F.max_by("cls", rank).alias("hub"), F.max_by("n", rank).alias("hub_n")
    )
    kept = sums.filter("size > 1 and early").groupBy("x", "y", "size").agg(
        F.min("bucket").alias("bucket"), F.first("hub").alias("hub"), F.first("hub_n").alias("hub_n")
    )
    kept = settle(kept.select("bucket", "size", "hub", "hub_n"), "kept-buckets")
    out = settle(once.select("bucket", "cls", "n").join(kept, "bucket"), "members")
    drop(once, kept)
    return out


# The prefix tree


class PrefixTree:
    """Ordered sets with one path for each common beginning."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        rows = [sets[i] for i in self.order]
        self.rows, self.sizes = rows, np.array([len(r) for r in rows], np.int64)
        common = []
        for a, b in zip(rows, rows[1:], strict=False):
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            common.append(int(differ[0]) if len(differ) else m)
        self.common = np.array(common, np.int64)

    def matches(self, probe: np.ndarray, num: int, den: int, skip) -> Iterator[int]:
        """Numbers of the sets that reach the threshold with ``probe``; ``skip(i)`` tells which need no test."""
        if not self.rows:
            return
        n = len(probe)
        stack = [(0, len(self.rows), 0, 0)]
        while stack:
            lo, hi, depth, overlap = stack.pop()
            live = [i for i in range(lo, hi) if not skip(self.order[i])] if hi - lo <= 4 else range(lo, hi)
            if not live:
                continue
            if hi - lo == 1:
                end = len(self.rows[lo])
            else:
                end = int(self.common[lo : hi - 1].min())
            edge = self.rows[lo][depth:end]
            if len(edge):
                at = np.searchsorted(probe, edge)
                overlap += int((probe[np.minimum(at, n - 1)] == edge).sum())
                passed = int(np.searchsorted(probe, edge[-1], "right"))
            else:
                passed = n if not depth and not end else int(np.searchsorted(probe, self.rows[lo][depth - 1], "right")) if depth else 0
            if hi - lo == 1:
                if den * overlap >= num * (n + end - overlap) and not skip(self.order[lo]):
                    yield self.order[lo]
                continue
            sizes = self.sizes[lo:hi]
            left = n - passed if len(edge) or depth else n
            # The least size decides what is needed, the greatest what can remain.
            most = overlap + min(left, int(sizes.max()) - end)
            if (num + den) * most < num * (n + max(int(sizes.min()), end)):
                continue
            cuts = [lo, *(lo + 1 + np.flatnonzero(self.common[lo : hi - 1] == end)).tolist(), hi]
            for a, b in zip(cuts, cuts[1:], strict=False):
                stack.append((a, b, end, overlap))


def _links(num: int, den: int):
    def run(group: pa.Table) -> pa.Table:
        classes, comps, sides = (group.column(c).to_pylist() for c in ("cls", "comp", "side"))
        sets = [np.sort(_wide(a + b)) for a, b in zip(group.column("counted").to_pylist(), group.column("rest").to_pylist(), strict=True)]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root.setdefault(up, up)
                x = up
            return x

        # Side 0 walks the tree of side 1.
        stored = [i for i, s in enumerate(sides) if s]
        tree, out = PrefixTree([sets[i] for i in stored]), []
        for i, s in enumerate(sides):
            if s == 1:
                continue
            mine = comps[i]
            for j in tree.matches(sets[i], num, den, lambda j, mine=mine: find(comps[stored[j]]) == find(mine)):
                a, b = find(mine), find(comps[stored[j]])
                if a != b:
                    root[a] = b
                    out.append((classes[i], classes[stored[j]]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _needed(sets: DataFrame, members: DataFrame) -> DataFrame:
    """cls, counted, rest of the classes in ``members`` and a few more, once each, as a table. Nearly all others are left out where they are read."""
    slots = Slots(members, "cls")
    near = sets.select("cls", "counted", "rest").filter(slots.may_have("cls"))
    out = settle(near.groupBy("cls").agg(F.first(F.struct("counted", "rest")).alias("s")).select("cls", "s.counted", "s.rest"), "keys")
    slots.shared.destroy()
    return out


def _join(tasks: DataFrame, keys: DataFrame, num: int, den: int) -> DataFrame:
    """Links a, b found in ``tasks`` (task, cls, comp, side): each task is one bounded group."""
    return settle(tasks.join(keys.hint("merge"), "cls").groupBy("task").applyInArrow(_links(num, den), "a long, b long"), "links")


# Components


def components(links: DataFrame) -> DataFrame:
    """cls, root: the least class of each component, for all classes that have a link, as a table."""
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if before == now:
            out = settle(
                edges.select(F.col("u").alias("cls"), F.col("v").alias("root")).unionByName(
                    edges.select(F.col("v").alias("cls"), F.col("v").alias("root")).distinct()
                ),
                "labels"
            )
            drop(edges)
            return out
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The least neighbours are a table, so that a join by a hot class can be split.
        least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = settle(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges"
        )
        drop(edges, least)
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = settle(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        drop(large, least)


def _parts(count: Column, keys: Column, chunk: int) -> Column:
    """Into how many chunks so many sets of so many shingles are cut."""
    return F.greatest(F.ceil(count / chunk), F.ceil(keys / CHUNK_KEYS), F.lit(1)).cast("int")


def classes(source: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100), chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The rows (mark, id, n, cls) of ``source`` (mark, id, text), and the links' components (cls, root)."""
    num, den = threshold
    limit = Threshold(num, den)
    every = settle(sets_of(source, k, limit), "sets")
    sets = every.filter("counted is not null")
    answers = settle(frequencies(sets, limit), "frequencies")
    members = members_of(postings(sets, answers, limit))
    keys = _needed(sets, members)
    rows = settle(every.select("mark", "id", "n", "cls"), "rows")
    drop(every, answers)

    # First round: hubs.
    stars = members.filter(
        (F.col("cls") != F.col("hub")) & (F.least("n", "hub_n") * den >= F.greatest("n", "hub_n") * num)
    ).select("hub", "cls", "n").distinct()
    stars = settle(stars, "stars")
    counts = settle(stars.groupBy("hub").agg(_parts(F.count(F.lit(1)), F.sum("n"), chunk).alias("parts")), "counts")
    starred = stars.join(counts, "hub").select("hub", "cls", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("part"))
    spokes = starred.select(F.xxhash64("hub", "part").alias("task"), "cls", F.col("cls").alias("comp"), F.lit(1).alias("side"))
    centres = counts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(
        F.xxhash64("hub", "part").alias("task"), F.col("hub").alias("cls"), F.col("hub").alias("comp"), F.lit(0).alias("side")
    )
    links = _join(spokes.unionByName(centres), keys, num, den)
    labels = components(links)
    drop(stars, counts)

    # Second round: what the buckets of one hub hold besides it, where it is not connected yet.
    besides = members.filter("size > 2 and cls <> hub").join(labels, "cls", "left").select(
        "bucket", "hub", "cls", "n", F.coalesce("root", "cls").alias("comp")
    )
    besides = settle(besides, "besides")
    split = settle(
        besides.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("bucket"), "split"
    )
    work = settle(besides.join(split, "bucket", "left_semi").select("hub", "cls", "n", "comp").distinct(), "work")
    drop(members, besides, split)
    if not work.isEmpty():
        sums = work.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
        sums = sums.groupBy("hub").agg(F.max(F.struct("c", "comp", "s")).alias("most"), F.sum("c").alias("c"), F.sum("s").alias("s"))
        sized = settle(
            sums.select(
                "hub", F.col("most.comp").alias("main"), _parts(F.col("c"), F.col("s"), chunk).alias("parts"),
                _parts(F.col("c") - F.col("most.c"), F.col("s") - F.col("most.s"), chunk).alias("others")
            ),
            "sized"
        )
        cut = work.join(sized, "hub").withColumns(
            {"p": F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"), "q": F.pmod(F.xxhash64("cls", F.lit(1)), F.col("others")).cast("int")}
        )
        # Those outside the largest component walk trees of all members, chunk against chunk.
        stored = cut.select("hub", "cls", "comp", "p", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("q"), F.lit(1).alias("side"))
        walking = cut.filter(F.col("comp") != F.col("main")).select(
            "hub", "cls", "comp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "q", F.lit(0).alias("side")
        )
        tasks = stored.unionByName(walking).select(F.xxhash64("hub", "p", "q").alias("task"), "cls", "comp", "side")
        more = _join(tasks, keys, num, den)
        if not more.isEmpty():
            old, labels = labels, components(links.unionByName(more))
            drop(old)
        drop(more, sized)
    drop(links, work, keys)
    return rows, labels


def link(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id: the least id of those reachable by links, itself included."""
    ids = docs["doc_id"].cast("long")
    rows, labels = classes(docs.select(ids.alias("mark"), ids.alias("id"), docs["text"].alias("text")), k, threshold)
    filled = rows.filter("cls is not null")
    own = filled.groupBy("cls").agg(F.min("id").alias("least")).join(labels, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    own = settle(own.select("cls", "root", "least"), "classes")
    roots = settle(own.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = settle(own.join(roots, "root").select("cls", "component_id"), "named")
    found = filled.join(named, "cls").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(
        rows.filter("cls is null").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    )


def keep_one(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of ``docs`` without those linked with one of lesser ``doc_id``; of ties the first in the table stays.

    ``docs`` must be a table: its rows are numbered in reading order, twice.
    """
    own_rows, number = numbered(docs)
    rows, labels = classes(
        own_rows.select(F.col(number).alias("mark"), docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text")), k, threshold
    )
    # Copies of a text first, then the first rows of linked texts: only rows that have any company are moved on.
    rank = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("mark").alias("mark"))
    filled = rows.filter("cls is not null")
    own = settle(
        filled.groupBy("cls").agg(
            F.min(rank).alias("first"), F.count(F.lit(1)).alias("c")
        ).join(labels, "cls", "left").filter("c > 1 or root is not null").select("cls", F.coalesce("root", "cls").alias("root"), "first"),
        "classes"
    )
    roots = settle(own.groupBy("root").agg(F.min("first")["mark"].alias("first")), "roots")
    firsts = settle(own.select("cls", "root").join(roots, "root").select("cls", "first"), "firsts")
    gone = settle(filled.join(firsts, "cls").filter("mark <> first").select(F.col("mark").alias(number)), "copies")
    drop(own, roots, firsts, rows, labels)
    return without(own_rows, number, gone)
