"""Language-model scores from Elias-Fano n-gram tries.

The model is a trigram model with Dirichlet smoothing: p(w|h) = (c(hw) + m p(w|h')) / (c(h) + m), down to
the add-one unigram. It is learned from the rows that the caller marks, over all their whole texts, and is
as large as they make it; so it is never in one place. Documents are written once as blocks of bounded bytes, their
words as numbers. For every block the distinct n-grams, with their counts in the learning rows, are dealt to shards by
the hash of the context, the words before the last. Each shard adds up the counts, builds a trie, and looks up the
n-grams of all blocks in it, each distinct one once; the block then puts its answers together into document scores.

The trie lies in one mapping, which lives as long as its group of blocks is answered, and is only read there. Its levels are the words with their counts; the contexts, an
Elias-Fano sequence of their hashes, with quantised counts and Elias-Fano pointers to where each one's words begin;
and the words after contexts, made monotone by the context's rank in an Elias-Fano sequence, with the quantised
smoothed probability c(hw) / (c(h) + m) of each. A look-up finds the context, reads its two pointers, and between them
looks for the successor of the word: the bucket of its high bits by select, then its low bits.

Hot contexts: each block also tells which contexts it holds often, and a share of the others by hash, in proportion to their
occurrences, so that contexts spread thinly over many blocks are found, too. The words after contexts that the corpus holds
``HOT`` times or more (the ``HOT_LIST`` most frequent ones at most; any other has less than a 1/HOT_LIST share of
all tokens) are dealt by context and a range of the words' hashes. Such a part doesn't know c(h): it stores the
probability of the whole n-gram, and the block, which gets c(h) with the context, divides.

Words are known by 63-bit hashes, words after a context by 32 bits, and contexts by 20 bits more than it takes to number
all tokens (or ``context_bits``), so that at any size of corpus about one context in a million meets another's hash. Rows of
n-grams are never pruned, capped or sampled.

Defined cases: a null text is empty and has one token, its end; without learning rows all scores of a token
are log10(1) = 0; null ids fall in the fold of the empty text; repeated rows count and are scored each;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import mmap
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm._shared import expand, settle, small_batches, squeeze

_END, _BEGIN = b"\x00end", b"\x00begin"  # no word has these bytes in front and white space is not among words
_MIX = np.uint64(0x9E3779B97F4A7C15)
HOT, HOT_LIST, HOT_IN_BLOCK, HOT_PARTS, HOT_MARGIN = 200_000, 100_000, 256, 4096, 0.8
_JOINT = float(1 << 40)


# Elias-Fano sequences

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Place of the r-th one in a byte.
_PLACE = np.array([[([b for b in range(8) if i >> b & 1] + [0] * 8)[r] for r in range(8)] for i in range(256)], np.uint8)


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one number ``rank`` (from 0) in each 64-bit word."""
    parts = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(_POP[parts], axis=1, dtype=np.uint8)
    byte = (upto <= rank[:, None]).sum(axis=1)
    rows = np.arange(len(words))
    inside = rank - np.where(byte > 0, upto[rows, byte - 1], 0)
    return 8 * byte + _PLACE[parts[rows, byte], inside]


class EliasFano:
    """A sorted sequence, read in place from the bytes that ``encode`` makes: nothing is decoded beforehand."""

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> bytes:
        n = len(values)
        low = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        lows = np.zeros(n * low // 64 + 2, np.uint64)
        if n and low:
            bit = np.arange(n, dtype=np.uint64) * np.uint64(low)
            word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            v = values & np.uint64((1 << low) - 1)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            lows[word[first]] = np.bitwise_or.reduceat(v << off, first)
            over = off + np.uint64(low) > 64
            lows[word[over] + 1] |= v[over] >> (np.uint64(64) - off[over])
        high = (values >> np.uint64(low)).astype(np.int64)
        bits = np.zeros(64 * ((((max(universe, 1) - 1) >> low) + n + 1) // 64 + 1), np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.concatenate([[0], np.cumsum(64 - _POP[words.view(np.uint8)].reshape(-1, 8).sum(axis=1, dtype=np.int64))[:-1]])
        return np.array([n, low, len(lows), len(words)], "<i8").tobytes() + lows.tobytes() + words.tobytes() + zeros.astype("<u4").tobytes() + bytes(-len(words) % 2 * 4)

    def __init__(self, data: memoryview):
        self.n, self.low, lows, words = np.frombuffer(data, "<i8", 4).tolist()
        self.lows = np.frombuffer(data, np.uint64, lows, 32)
        self.words = np.frombuffer(data, np.uint64, words, 32 + 8 * lows)
        self.zeros = np.frombuffer(data, "<u4", words, 32 + 8 * (lows + words))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.uint64) * np.uint64(self.low)
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        return ((self.lows[word] >> off) | ((self.lows[word + 1] << (np.uint64(63) - off)) << np.uint64(1))) & np.uint64((1 << self.low) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        ones = 64 * np.arange(len(self.words)) - self.zeros
        word = np.searchsorted(ones, i, "right") - 1
        place = 64 * word + _select(self.words[word], i - ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.low)) | self._low(i)

    def _ends(self, high: np.ndarray) -> np.ndarray:
        """How many numbers have at most these high bits."""
        word = np.searchsorted(self.zeros, high, "right") - 1
        return 64 * word + _select(~self.words[word], high - self.zeros[word]) - high

    def successor(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where, between begin and end, the first number not under each value stands, and whether it is that value."""
        values = values.astype(np.uint64)
        high, low = (values >> np.uint64(self.low)).astype(np.int64), values & np.uint64((1 << self.low) - 1)
        if not len(values):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        hi = self._ends(high)
        lo = np.where(high > 0, self._ends(np.maximum(high - 1, 0)), 0)
        if begin is not None:
            lo, hi = np.clip(lo, begin, end), np.clip(hi, begin, end)
        stop = hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            middle = (lo[open_] + hi[open_]) >> 1
            under = self._low(middle) < low[open_]
            lo[open_[under]] = middle[under] + 1
            hi[open_[~under]] = middle[~under]
            open_ = open_[lo[open_] < hi[open_]]
        inside = lo < stop
        return lo, inside & (self._low(np.where(inside, lo, 0)) == low)


def pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.compress(np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts), 1)


def planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers byte by byte, all lowest ones first: the higher ones are nearly all zero and compress to nothing."""
    values = np.ascontiguousarray(values.astype(kind))
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(data: memoryview, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def unpack(data: bytes) -> list[memoryview]:
    data = memoryview(zstandard.decompress(data))
    count = int(np.frombuffer(data, "<i8", 1)[0])
    at, out = 8 * (count + 1), []
    for size in np.frombuffer(data, "<i8", count, 8).tolist():
        out.append(data[at : at + size])
        at += size
    return out


# Quantisation


def count_code(counts: np.ndarray) -> np.ndarray:
    """0 for no count, else a 16-bit code of the logarithm."""
    return np.where(counts > 0, 1 + np.rint(1024 * np.log2(np.maximum(counts, 1))), 0).astype("<u2")


def count_of(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, np.exp2((code.astype(np.float64) - 1) / 1024), 0.0)


def chance_code(p: np.ndarray) -> np.ndarray:
    return (1 + np.minimum(np.rint(-4096 * np.log10(p)), 65534)).astype("<u2")


def chance_of(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(code.astype(np.float64) - 1) / 4096), 0.0)


def _taken(values: np.ndarray, at: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Values at those places that are held, 0 for the others."""
    out = np.zeros(len(at), values.dtype)
    out[held] = values[at[held]]
    return out


class Trie:
    """Words, contexts and the words after them in one mapping, which ends with the object."""

    def __init__(
        self, words: np.ndarray, ones: np.ndarray, contexts: np.ndarray, twos: np.ndarray, entries: np.ndarray, chances: np.ndarray,
        span: tuple[int, int, int, int]
    ):
        """words and contexts: sorted hashes, in the ranges that ``span`` gives; entries: sorted, the rank of the context in the upper 32 bits."""
        begin = np.searchsorted(entries >> np.uint64(32), np.arange(len(contexts) + 1, dtype=np.uint64))
        levels = [
            EliasFano.encode((words - np.uint64(span[0])) >> np.uint64(1), (span[1] - span[0]) // 2 + 1), ones.astype("<i8").tobytes(),
            EliasFano.encode(contexts - np.uint64(span[2]), span[3] - span[2]), count_code(twos).tobytes(), EliasFano.encode(begin, len(entries) + 1),
            EliasFano.encode(entries, max(len(contexts), 1) << 32), chance_code(chances).tobytes(),
        ]
        levels = [x + bytes(-len(x) % 8) for x in levels]
        self.span, self.size = span, sum(map(len, levels))
        self.map = mmap.mmap(-1, max(self.size, 1))
        view, at, parts = memoryview(self.map), 0, []
        for x in levels:
            self.map.write(x)
            parts.append(view[at : at + len(x)])
            at += len(x)
        self.words, self.contexts, self.begin, self.entries = (EliasFano(parts[i]) for i in (0, 2, 4, 5))
        self.ones, self.twos, self.chances = np.frombuffer(parts[1], "<i8"), np.frombuffer(parts[3], "<u2"), np.frombuffer(parts[6], "<u2")

    def word_counts(self, words: np.ndarray) -> np.ndarray:
        at, held = self.words.successor((words - np.uint64(self.span[0])) >> np.uint64(1))
        return _taken(self.ones, at, held)

    def context_codes(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of contexts, -1 for those not held, and the codes of their counts."""
        at, held = self.contexts.successor(contexts - np.uint64(self.span[2]))
        return np.where(held, at, -1), _taken(self.twos, at, held)

    def chance_codes(self, rank: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Codes of the chance of each word after the context of this rank."""
        out, known = np.zeros(len(words), "<u2"), np.flatnonzero(rank >= 0)
        if len(known) and self.entries.n:
            # Pointers are read once a context: ranks come in groups.
            own, of = np.unique(rank[known], return_inverse=True)
            begin, end = self.begin.at(own)[of].astype(np.int64), self.begin.at(own + 1)[of].astype(np.int64)
            at, held = self.entries.successor((rank[known].astype(np.uint64) << np.uint64(32)) | words[known], begin, end)
            out[known[held]] = self.chances[at[held]]
        return out


# Blocks of documents


class Block:
    """Documents as numbers of words: ids, sizes and folds of documents, the words' hashes and each token's word."""

    @classmethod
    def of_texts(cls, docs: list, held: list, texts: list[str | None]) -> Block:
        seen: defaultdict[bytes, int] = defaultdict()
        seen.default_factory = seen.__len__
        begin, end = seen[_BEGIN], seen[_END]
        ids, sizes = [], []
        for text in texts:
            words = (text or "").encode().lower().split()
            ids += (begin, begin)
            ids += [seen[w] for w in words]
            ids.append(end)
            sizes.append(len(words) + 1)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in seen], np.uint64) & ~np.uint64(1)
        self = cls()
        self.words, place = np.unique(hashes, return_inverse=True)  # sorted, the marks of begin and end among them
        self.at1 = place[np.array(ids, np.int64)].astype(np.uint32)
        self.docs, self.held, self.sizes = docs, np.array(held, bool), np.array(sizes, np.int64)
        return self

    def store(self) -> bytes:
        none = np.array([d is None for d in self.docs], bool)
        # Frequent words have small numbers, so that the higher bytes are nearly all zero.
        order = np.argsort(-np.bincount(self.at1, minlength=len(self.words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        return pack(
            np.array([d or 0 for d in self.docs], "<i8"), none, self.held, self.sizes, self.words[order].astype("<u8"), planes(rank[self.at1], "<u4")
        )

    @classmethod
    def load(cls, data: bytes) -> Block:
        a = unpack(data)
        self = cls()
        self.docs = [None if n else d for d, n in zip(np.frombuffer(a[0], "<i8").tolist(), np.frombuffer(a[1], bool).tolist(), strict=True)]
        self.held, self.sizes, words = np.frombuffer(a[2], bool), np.frombuffer(a[3], "<i8"), np.frombuffer(a[4], "<u8")
        self.words, place = np.unique(words, return_inverse=True)
        self.at1 = place.astype(np.uint32)[unplanes(a[5], "<u4")]
        return self

    def pairs_of(self, context_bits: int) -> np.ndarray:
        """Hashes, even ones, of each two tokens in a row, in reading order."""
        self.begin, self.end = (int(np.searchsorted(self.words, np.uint64(xxhash.xxh3_64_intdigest(x) & ~1))) for x in (_BEGIN, _END))
        own = self.words[self.at1]
        pair = (own[:-1] * _MIX) ^ (own[1:] + (own[:-1] >> np.uint64(31)))
        pair ^= pair >> np.uint64(32)
        #: A pair for each place but where a document ends; the pair at place i is of the tokens i and i + 1.
        self.pair_here = self.at1[:-1] != self.end
        return ((pair * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - context_bits)) & ~np.uint64(1)

    def often(self, context_bits: int, least: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and how often they stand here; those that stand here less than ``least`` times are told as ``least`` with the fitting chance.

        Sums over blocks are right in the mean however thinly a context is spread. Chance is a hash of context and ``block``.
        """
        found, n = np.unique(self.pairs_of(context_bits)[self.pair_here], return_counts=True)
        draw = (found ^ (np.array([block], np.uint64) * _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
        draw = ((draw ^ (draw >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)
        told = draw * np.uint64(least) < (n.astype(np.uint64) << np.uint64(32))
        return found[told], np.maximum(n[told], least)

    def number(self, context_bits: int, hot: np.ndarray, parts: np.ndarray) -> None:
        """Find the distinct contexts and entries, and where each stands. hot: sorted contexts whose words are dealt in parts."""
        pair = self.pairs_of(context_bits)
        self.token = self.at1 != self.begin
        self.ends = np.flatnonzero(self.token)  # places of tokens, in order
        pairs, at2 = np.unique(pair[self.pair_here], return_inverse=True)
        self.at2 = np.full(len(pair), -1, np.int64)
        self.at2[self.pair_here] = at2
        own, word = self.at2[self.ends - 2], self.words[self.at1[self.ends]] >> np.uint64(32)
        self.home, self.contexts = own, pairs
        if len(hot) and len(pairs):
            which = np.minimum(np.searchsorted(hot, pairs), len(hot) - 1)
            split = np.where(hot[which] == pairs, parts[which], 0)[own]
            far = np.flatnonzero(split)
            part = pairs[own[far]] + ((word[far] * split[far].astype(np.uint64)) >> np.uint64(32)) * np.uint64(0x9E3779B97F4B)
            part = (((part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - context_bits)) | np.uint64(1)
            names, of = np.unique(part, return_inverse=True)
            there = np.arange(len(pairs)) + np.searchsorted(names, pairs)
            self.contexts = np.sort(np.concatenate([pairs, names]))
            self.at2[self.pair_here] = there[at2]
            self.home = there[own]
            own = self.home.copy()
            own[far] = (np.arange(len(names)) + np.searchsorted(pairs, names))[of]
        self.entries, self.at3 = np.unique((own.astype(np.uint64) << np.uint64(32)) | word, return_inverse=True)
        self.children = np.bincount((self.entries >> np.uint64(32)).astype(np.int64), minlength=len(self.contexts))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often each word, context and entry stands in the documents to learn from."""
        marks = np.repeat(~self.held, self.sizes + 2)
        one = np.bincount(self.at1[self.token & marks], minlength=len(self.words))
        two = np.bincount(self.at2[self.pair_here & marks[:-1]], minlength=len(self.contexts))
        three = np.bincount(self.at3[marks[self.ends]], minlength=len(self.entries))
        return one, two, three

    def cuts(self, shards: int, context_bits: int) -> Iterator[tuple[int, slice, slice]]:
        """The shards that have any of these words and contexts, and where theirs stand: shards are ranges of hashes."""
        upper = self.contexts >> np.uint64(context_bits - 32)
        word, pair = (x * np.uint64(shards) >> np.uint64(32) for x in (self.words >> np.uint64(32), upper))
        for s in np.union1d(word, pair):
            yield int(s), slice(*np.searchsorted(word, [s, s + 1])), slice(*np.searchsorted(pair, [s, s + 1]))


def shard_base(shard: int, shards: int, bits: int) -> int:
    """The least hash of so many bits in a shard."""
    return -(-(shard << 32) // shards) << (bits - 32)


def blocks_of(source: DataFrame, block_bytes: int, context_bits: int, hot: int = HOT) -> DataFrame:
    """block, data, often, times: documents (doc_id, text, held_out) in blocks of about so many bytes, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, texts, held, size = [], [], [], 0

        def done() -> pa.RecordBatch:
            block = Block.of_texts(ids, held, texts)
            often, times = block.often(context_bits, max(1, hot * HOT_IN_BLOCK // HOT), number)
            cols = [
                pa.array([number], pa.int64()), pa.array([block.store()], pa.binary()),
                *(pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in (often, times))
            ]
            return pa.RecordBatch.from_arrays(cols, ["block", "data", "often", "times"])

        for batch in small_batches(batches, "text", block_bytes // 4, 100_000):
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            held += batch.column(2).to_pylist()
            size += batch.column(1).nbytes
            if size >= block_bytes:
                yield done()
                number += 1
                ids, texts, held, size = [], [], [], 0
        if ids:
            yield done()

    return settle(source.mapInArrow(run, "block long, data binary, often array<long>, times array<long>"), "lm-blocks")


def hot_contexts(blocks: DataFrame, least: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted contexts that the corpus holds often, and in how many parts their words are dealt.

    Sums of what the blocks tell stray by some four hundredths where contexts are spread thinly, hence the margin.
    """
    sums = blocks.select(F.explode(F.arrays_zip("often", "times")).alias("x")).groupBy("x.often").agg(F.sum("x.times").alias("n"))
    rows = sums.filter(F.col("n") >= HOT_MARGIN * least).orderBy(F.desc("n"), "often").limit(HOT_LIST).collect()
    rows.sort()
    return np.array([r[0] for r in rows], np.int64).astype(np.uint64), np.array([min(HOT_PARTS, -(-r[1] // least)) + 1 for r in rows], np.int64)


def score(
    docs: DataFrame, held_out: Column, block_bytes: int = 5 << 20, shard_bytes: int = 6 << 20, context_bits: int | None = None, m2: float = 5000.0,
    m3: float = 10.0, hot: int = HOT
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_score of every document."""
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], held_out.alias("held_out"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sc = docs.sparkSession.sparkContext
    context_bits = context_bits or min(max(int(size // 6).bit_length() + 20, 40), 60)
    shards = max(2 * sc.defaultParallelism, math.ceil(size / shard_bytes))
    blocks = blocks_of(source, block_bytes, context_bits, hot)
    often = sc.broadcast(hot_contexts(blocks, hot))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "data"):
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = Block.load(data)
                block.number(context_bits, *often.value)
                one, two, three = block.counts()
                entry = np.concatenate([[0], np.cumsum(block.children)])
                after = (block.entries & np.uint64(0xFFFFFFFF)).astype("<u4")
                own, rows = [], []
                for s, w, p in block.cuts(shards, context_bits):
                    e = slice(entry[p.start], entry[p.stop])
                    own.append(s)
                    numbers = (planes(x, "<u4") for x in (two[p], block.children[p], after[e], three[e]))
                    rows.append(pack(squeeze(block.words[w]), planes(one[w], "<u4"), squeeze(block.contexts[p]), *numbers))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int32()), pa.array([name] * len(own), pa.int64()), pa.array(rows, pa.binary())], ["shard", "block", "data"]
                )

    def answer(group: pa.Table) -> pa.Table:
        asked = []
        shard = group.column("shard")[0].as_py()
        span = tuple(shard_base(shard + i, shards, bits) for bits in (64, context_bits) for i in (0, 1))
        for data in group.column("data").to_pylist():
            a = unpack(data)
            asked.append((expand(bytes(a[0])), unplanes(a[1], "<u4"), expand(bytes(a[2])), *(unplanes(a[i], "<u4") for i in (3, 4, 5, 6))))
        words, contexts, after = (np.concatenate([a[i] for a in asked]) for i in (0, 2, 5))
        ends1, ends2, ends3 = (np.cumsum([len(a[i]) for a in asked])[:-1] for i in (0, 2, 5))
        one, two, three = (np.concatenate([a[i] for a in asked]).astype(np.float64) for i in (1, 3, 6))
        children = np.concatenate([a[4] for a in asked])
        del asked
        # Each distinct word, context and entry once, with its sum.
        words, of1 = np.unique(words, return_inverse=True)
        one = np.bincount(of1, one, len(words))
        contexts, of2 = np.unique(contexts, return_inverse=True)
        two = np.bincount(of2, two, len(contexts))
        entries, of3 = np.unique((np.repeat(of2, children).astype(np.uint64) << np.uint64(32)) | after, return_inverse=True)
        three = np.bincount(of3, three, len(entries))
        own, after = (entries >> np.uint64(32)).astype(np.int64), entries & np.uint64(0xFFFFFFFF)
        del children, entries
        held = (two > 0) | (np.bincount(own, three, len(contexts)) > 0)
        rank = np.cumsum(held) - 1
        seen = three > 0
        at = own[seen]
        chance = three[seen] / np.where(contexts[at] & np.uint64(1), _JOINT, two[at] + m3)
        trie = Trie(
            words[one > 0], one[one > 0], contexts[held], two[held], (rank[at].astype(np.uint64) << np.uint64(32)) | after[seen], chance, span
        )
        total, kinds = int(one.sum()), int((one > 0).sum())
        del one, two, three, held, seen, chance, at
        ones = trie.word_counts(words)
        rank, twos = trie.context_codes(contexts)
        threes = trie.chance_codes(rank[own], after)
        del words, contexts, own, after, rank
        out = [
            pack(planes(a, "<i8"), planes(b, "<u2"), planes(c, "<u2")) for a, b, c in zip(
                np.split(ones[of1], ends1), np.split(twos[of2], ends2), np.split(threes[of3], ends3), strict=True
            )
        ]
        more = [0] * (len(out) - 1)
        return pa.table(
            {
                "block": group.column("block"), "shard": group.column("shard"), "data": pa.array(out, pa.binary()),
                "tokens": pa.array([total, *more], pa.int64()), "kinds": pa.array([kinds, *more], pa.int64())
            }
        )

    dealt = blocks.select("block", "data").mapInArrow(deal, "shard int, block long, data binary")
    answers = settle(dealt.groupBy("shard").applyInArrow(answer, "block long, shard int, data binary, tokens long, kinds long"), "lm-answers")
    train_tokens, kinds = (x or 0 for x in answers.agg(F.sum("tokens"), F.sum("kinds")).first())
    norm = float(train_tokens + kinds + 1)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block.load(left.column("data")[0].as_py())
        block.number(context_bits, *often.value)
        parts = dict(zip(right.column("shard").to_pylist(), right.column("data").to_pylist(), strict=True))
        found = [unpack(parts[s]) for s in sorted(parts)]
        one, two, three = (np.concatenate([unplanes(f[i], kind) for f in found]) for i, kind in enumerate(("<i8", "<u2", "<u2")))
        counts2, c = count_of(two), one.copy()
        c[block.begin] = one[block.end]  # documents begin as often as they end
        # A part of a hot context holds chances of whole n-grams.
        joint = (block.contexts[(block.entries >> np.uint64(32)).astype(np.int64)] & np.uint64(1)).astype(bool)
        chances = chance_of(three) * np.where(joint, _JOINT, 1.0)
        here = block.ends
        known = c[block.at1[here]]
        flat = np.log10((known + 1) / norm)
        p2 = (counts2[block.at2[here - 1]] + m2 * (known + 1) / norm) / (c[block.at1[here - 1]] + m2)
        own = counts2[block.home]
        p3 = chances[block.at3] / np.where(joint[block.at3], own + m3, 1.0) + m3 / (own + m3) * p2
        edge = np.concatenate([[0], np.cumsum(block.sizes)[:-1]])
        total = np.add.reduceat(np.minimum(np.log10(p3), 0.0), edge)
        return pa.table(
            {
                "doc_id": pa.array(block.docs, pa.int64()),
                "held_out": pa.array(block.held),
                "n_tokens": pa.array(block.sizes),
                "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64), edge)),
                "train_tokens": pa.array(np.full(len(edge), train_tokens, np.int64)),
                "base_score": pa.array(np.add.reduceat(flat, edge)),
                "score": pa.array(total),
                "mean_score": pa.array(total / block.sizes),
            }
        )

    whole = blocks.select("block", "data").groupBy("block").cogroup(answers.select("block", "shard", "data").groupBy("block"))
    return whole.applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, mean_score double"
    )
