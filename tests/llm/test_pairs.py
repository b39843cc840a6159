"""N-gram Jaccard join and benchmark decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from evidentia.llm import _shared, decontaminate, ngram_join
from tests.llm.helpers import DOCS, empty_docs, odd_docs, prose, words


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t, k), []).append(i)
    keys = [s for s in sets if s]
    root = {s: s for s in keys}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for a in range(len(keys)):
        for b in range(a):
            both = len(keys[a] & keys[b])
            if den * both >= num * (len(keys[a]) + len(keys[b]) - both):
                root[find(keys[a])] = find(keys[b])
    least = {}
    for s in keys:
        ids = [i for i in sets[s] if i is not None]
        if ids:
            least[find(s)] = min(least.get(find(s), 10**9), *ids)
    out = []
    for i, t in rows:
        s = shingles(t, k)
        out.append((i, len(s), least.get(find(s)) if s else i))
    return sorted(out, key=str)


def corpus(n_base=12, copies=25, seed=1):
    rng = random.Random(seed)
    rows, i = [], 0
    passage = words(rng, 60)
    for b in range(n_base):
        base = words(rng, rng.randrange(3, 120))
        if b % 3 == 0:
            base = base + passage
        for _ in range(rng.randrange(1, copies)):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "A b"), (i + 4, "a B"), (None, "a b")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "num", "chunk", "seed"), [(4, 85, 256, 1), (5, 80, 8, 2)])
def test_join_equals_brute_force(spark, k, num, chunk, seed):
    rows = corpus(seed=seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = ngram_join.classes
    try:
        ngram_join.classes = lambda d, k, t: whole(d, k, t, chunk=chunk)
        got = [tuple(r) for r in ngram_join.link(docs, k, (num, 100)).collect()]
    finally:
        ngram_join.classes = whole
    assert sorted(got, key=str) == brute(rows, k, num, 100)


def test_prefix_tree_equals_pairwise():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(60)]
    sets = base + [np.unique(np.append(b, rng.integers(0, 60, 2).astype(np.uint64))) for b in base]
    tree = ngram_join.PrefixTree(sets)
    for probe in sets:
        got = sorted(tree.matches(probe, 80, 100, lambda i: False))
        assert got == [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(probe, s)) >= 80 * len(np.union1d(probe, s))]


def test_a_shingle_of_all_sets_is_one_entry_a_block(spark):
    """What is dealt to the shards does not grow with the holders of a shingle, and its frequency is exact."""
    limit = ngram_join.Threshold(85, 100)
    docs = spark.createDataFrame([(i, i, "one two three four " + f"w{i} " * 5) for i in range(3000)], "mark long, id long, text string").coalesce(1)
    sets = ngram_join.sets_of(docs, 4, limit)
    answers = ngram_join.frequencies(sets, limit).collect()
    counts = [n for r in answers for n in ngram_join._counts(r["counts"]).tolist()]
    assert counts.count(3000) == 1 and len(counts) == len([k for r in answers for k in ngram_join.expand(r["keys"]).tolist()])
    assert sets.select("block").distinct().count() == 1


def test_join_of_odd_and_empty_tables(spark):
    got = ngram_join.link(odd_docs(spark)).collect()
    assert len(got) == 17
    assert {r.component_id for r in got if r.doc_id in (10, 11)} == {10}
    assert ngram_join.link(empty_docs(spark)).count() == 0


def test_keep_one(spark, tmp_path):
    docs = odd_docs(spark)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    kept = ngram_join.keep_one(spark.read.parquet(str(tmp_path / "d")))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(10) == 1 and 11 not in ids and ids.count(6) == 2 and ids.count(None) == 1 and {0, 1, 2} <= set(ids)
    assert ngram_join.keep_one(empty_docs(spark)).count() == 0


def fold(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(rows, items, n=10):
    grams = {}
    for item, text in items:
        w = fold(text)
        if w:
            m = min(n, len(w))
            for i in range(len(w) - m + 1):
                grams.setdefault(tuple(w[i : i + m]), set()).add("null" if item is None else str(item))
    out = []
    for d, text in rows:
        w, hit, found = fold(text), set(), set()
        for m in {len(g) for g in grams}:
            for i in range(len(w) - m + 1):
                g = tuple(w[i : i + m])
                if g in grams:
                    hit.update(range(i, i + m))
                    found |= grams[g]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def planted():
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.randrange(11, 40)))) for i in range(12)] + [
        (20, "Tiny Item-three words"), (21, "mono"), (22, None), (23, "..."), (None, "nameless item"), (3, " ".join(words(rng, 15)))
    ]
    rows = []
    for d in range(60):
        w = words(rng, rng.randrange(5, 80))
        if d % 3 == 0:
            source = items[rng.randrange(12)][1].split()
            a = rng.randrange(len(source) - 9)
            w[d % len(w) : d % len(w)] = source[a : a + rng.randrange(9, 12)]
        if d % 7 == 0:
            w += ["TINY", "item", "three", "Words", "mono"]
        rows.append((d, " ".join(w)))
    return rows + [(60, None), (61, ""), (5, "repeated nameless item"), (5, "repeated nameless item")], items


@pytest.mark.parametrize("slots", [1 << 25, 1 << 15])
def test_decontamination_equals_brute_force(spark, slots, monkeypatch):
    """Also with a bit map so small that it lets many windows pass that no item has."""
    monkeypatch.setattr(_shared, "SLOTS", slots)
    rows, items = planted()
    rng = random.Random(3)
    items += [(100 + i, " ".join(words(rng, 300, 100_000))) for i in range(40)] + [
        (200 + i, "a passage that many items of this one benchmark share word by word") for i in range(50)
    ]
    rows += [(100 + i, " ".join(words(rng, 30)) + " a passage that many items of this one benchmark share word") for i in range(20)]
    got = decontaminate.contamination(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    )
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_hits(rows, items)


def test_one_giant_item(spark):
    rng = random.Random(4)
    giant = words(rng, 200_000, 50_000)
    rows = [(1, " ".join(giant[70_000:70_010])), (2, " ".join(giant[70_000:70_009])), (3, " ".join(giant))]
    items = [(7, " ".join(giant))]
    got = decontaminate.contamination(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {r.doc_id: (r.n_hit, r.n_items) for r in got} == {1: (10, 1), 2: (0, 0), 3: (200_000, 1)}


def test_small_and_large_sets_equal_brute_force(spark):
    """Sets on both sides of the limit between the two orders, and large ones of which only a share is counted."""
    rng = random.Random(14)
    rows = []
    for size in (10, 40, 62, 66, 70, 76, 80, 90, 200, 500):
        base = words(rng, size, 10**6)
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(max(size // 25, 2))):
                w[rng.randrange(size)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w[: size - rng.randrange(size // 12 + 1)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in ngram_join.link(docs, 4, (85, 100)).collect()]
    want = brute(rows, 4, 85, 100)
    assert sorted(got, key=str) == want and len({c for _, _, c in want}) < len(rows) - 15


def test_clean_keeps_all_columns(spark):
    bench = spark.createDataFrame([(1, "same text here")], "item_id long, text string")
    docs = odd_docs(spark)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, none).count() == docs.count()
    assert decontaminate.contamination(docs, none).filter("contaminated").count() == 0
    assert decontaminate.contamination(empty_docs(spark), bench).count() == 0


def test_documents_schema(spark, sf):
    assert spark.read.parquet(f"{sf}/documents.parquet").columns == [c.split()[0] for c in DOCS.split(", ")]
