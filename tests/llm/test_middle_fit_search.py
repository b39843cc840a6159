"""Fill-in-middle, best-fit packing and ranked search against brute force, and their odd cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import best_fit, fill_in_middle, lexical_search
from tests.llm.helpers import empty_docs, odd_docs, prose, words


def rows(df):
    return [r.asDict() for r in df.collect()]


def middle(text, doc_id):
    """n, form, prefix, middle and output by the rule."""
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_against_brute_force(spark):
    rng = random.Random(5)
    alphabet = ["a", " ", "\n", "\t", "é", "\U0001f600", "<", "P>", "<P", "S>", "  ", "\x0b", " ", "\\E", "$1"]
    made = [(i, "".join(rng.choices(alphabet, k=rng.randrange(0, 30)))) for i in range(600)]
    made += [(1000 + i, prose(rng)) for i in range(60)] + [(2000, "<P>"), (2001, "x<M>"), (None, "no id"), (None, None), (3, "same"), (3, "same")]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    found = fill_in_middle.transform(docs)
    found = found.withColumn("restored", fill_in_middle.restored(F.col("output"), F.col("form")))
    want = Counter((i, t, *middle(t, i), t or "") for i, t in made)
    assert Counter(found.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored").rdd.map(tuple).collect()) == want
    assert {r["form"] for r in found.collect()} == {"plain", "psm", "spm"}


def test_fill_in_middle_odd_tables_and_sentinels(spark):
    for docs in (odd_docs(spark), empty_docs(spark)):
        found = fill_in_middle.transform(docs, rate=100)
        assert found.columns == [*docs.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
        assert found.count() == docs.count()
        again = found.withColumn("r", fill_in_middle.restored(F.col("output"), F.col("form")))
        assert again.filter(F.col("r") != F.coalesce("text", F.lit(""))).count() == 0
    clash = spark.createDataFrame([(1, "a b c", "old", 7)], "doc_id long, text string, output string, h1 int")
    row = fill_in_middle.transform(clash, rate=100, spm_rate=0, sentinels=("[[p", "[[s", "[[m")).first()
    assert row["output"].startswith("[[p") and row["h1"] == 7 and row["form"] == "psm"
    for bad in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "x"), ("", "b", "c"), ("abc", "b", "x")):
        with pytest.raises(ValueError):
            fill_in_middle.transform(clash, sentinels=bad)


def test_fill_in_middle_runs_in_the_jvm_without_shuffle(spark):
    plan = fill_in_middle.transform(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow", plan)


def best_fit_decreasing(lengths, size):
    """The rooms left by the rule, one piece at a time."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - length)
        else:
            rooms.append(size - length)
    return sorted(rooms)


@pytest.mark.parametrize("size, n, seed", [(16, 300, 1), (64, 500, 2), (64, 40, 3), (100, 700, 4), (7, 50, 5), (1, 9, 6)])
def test_plan_is_best_fit_decreasing(size, n, seed):
    rng = random.Random(seed)
    lengths = [min(size, max(1, int(rng.choice([rng.uniform(1, size), rng.gauss(size / 3, size / 20)])))) for _ in range(n)]
    counts = np.bincount(lengths, minlength=size + 1)
    filled, number, plan = Counter(), 0, best_fit.plan(counts, size)
    ends = [*plan[1:, 0].tolist(), n]
    longest_first = sorted(lengths, reverse=True)
    for (first, bin_, each, used), end in zip(plan.tolist(), ends, strict=True):
        assert first == number
        for nth in range(end - first):
            at = bin_ + nth // each
            assert filled[at] == used + nth % each * longest_first[first]
            filled[at] += longest_first[first]
        number = end
    assert sorted(size - f for f in filled.values()) == best_fit_decreasing(lengths, size)
    assert set(filled) == set(range(len(filled)))


def test_plan_stays_small_at_any_scale():
    rng = np.random.default_rng(3)
    for scale in (10, 10**4, 10**12):
        counts = (rng.pareto(0.5, 2049) * scale).astype(np.int64) + 1
        counts[0] = 0
        plan = best_fit.plan(counts, 2048)
        assert len(plan) <= 11 * 4 * 2048


def pieces(packed):
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append(r)
    return by


@pytest.mark.parametrize("size", [32, 2048])
def test_packed_documents_come_back_whole(spark, size):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = odd_docs(spark).repartition(3)
    packed = best_fit.pack(docs, size=size, with_ids=True)
    found = rows(packed)
    for own in pieces(found).values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0] + [r["length"] for r in own])[:-1].tolist()
        assert sum(r["length"] for r in own) <= size
    want = Counter((r["doc_id"], *tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0) for r in docs.collect())
    lengths, back = [], {}
    for r in sorted(found, key=lambda r: r["piece"]):
        lengths.append(r["length"])
        if r["doc_id"] not in (None, 6):  # ids of one row each
            back[r["doc_id"]] = back.get(r["doc_id"], ()) + tuple(r["ids"])
            assert len(back[r["doc_id"]]) == r["start"] + r["length"] and (r["piece"] == 0 or r["length"] == size)
    assert all(want[(doc_id, *ids)] == 1 for doc_id, ids in back.items()) and sum(lengths) == sum((len(k) - 1) * n for k, n in want.items())
    assert len(pieces(found)) == len(best_fit_decreasing(lengths, size))
    whole = rows(best_fit.sequences(packed))
    assert {r["sequence_id"]: len(r["ids"]) for r in whole} == {k: sum(p["length"] for p in v) for k, v in pieces(found).items()}
    assert all(r["ends"][-1] == len(r["ids"]) for r in whole)


def test_best_fit_of_nothing(spark):
    assert best_fit.pack(empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        best_fit.pack(empty_docs(spark), size=0)


def test_encoder_gives_the_tokenizers_ids(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, rng = best_fit.Encoder(best_fit.default_ranks()), random.Random(8)
    alphabet = ["a", "B", "é", "é", "字", "\U0001f600", " ", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", " ", " ", "　", "'s", "'LL", "1", "²", "٣", "_",
                "<|endoftext|>", "<|", "|>", "!", "\x00", "the", " and", "ſ", "İ", "​", "﻿"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(0, 40))) for _ in range(3000)] + ["x" * 50_000, " " * 50_000, "ab " * 30_000, ""]
    for part in (1 << 19, 5):
        monkeypatch.setattr(best_fit, "_PART", part)
        for text in texts:
            assert encoder(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def brute_search(docs, items, k):
    """Every item against every document by the rule."""
    terms = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    held = [(i, Counter(terms(fold(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc_id, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(fold(text))) if c[t]
            )
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:k])]
    return Counter(out)


def searched(spark, docs, items, k):
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    return Counter(tuple(r) for r in lexical_search.rank(d.repartition(3), q, k).collect())


@pytest.mark.parametrize("seed, vocabulary, k, rows_a_block, nodes", [(1, 30, 5, 4096, 10**6), (2, 400, 50, 17, 10), (3, 8, 3, 40, 500), (4, 2000, 1, 7, 100)])
def test_search_against_brute_force(spark, monkeypatch, seed, vocabulary, k, rows_a_block, nodes):
    rng = random.Random(seed)
    monkeypatch.setattr(lexical_search, "WALK_NODES", nodes)
    make = lambda n: " ".join(words(rng, n, vocabulary)).replace("w1", "W1É.")
    docs = [(i * 7 % 301, make(rng.choice([1, 5, 30, 80]))) for i in range(220)]
    docs += [docs[3]] * 9 + [(None, docs[3][1]), (None, make(9)), (900, ""), (901, None), (902, "... !"), (903, make(3000)), (904, "\U0001f600 w5")]
    items = [(f"i{i}", make(rng.choice([1, 4, 40]))) for i in range(25)] + [("i0", make(3)), (None, make(3)), ("e", ""), ("n", None), ("x", "unknownterm")]
    assert searched(spark, docs, items, k) == brute_search(docs, items, k)


def test_search_of_ordered_documents_and_blocks(spark, monkeypatch):
    """Documents that grow with their ids make treaps that are paths; small blocks carry scores from one to the next."""
    docs = [(i, "w1 " * (i + 1) + f"w{i % 5 + 2}") for i in range(150)]
    items = [("a", "w1 w2"), ("b", "w3 w4 w1")]
    want = brute_search(docs, items, 10)
    assert searched(spark, docs, items, 10) == want
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = lexical_search.build(frame)
    asked = spark.createDataFrame([(0, "w1 w2"), (1, "w3 w4 w1")], "query long, text string")
    monkeypatch.setattr(lexical_search, "GROUP_ROWS", 1)
    found = Counter(("ab"[r["query"]], r["rank"], r["doc_id"], r["score"]) for r in lexical_search.search(index, asked, 10).collect())
    assert found == want


def test_search_of_odd_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "one w3 W7"), (None, None)], "item_id long, text string")
    assert lexical_search.rank(empty_docs(spark), items).count() == 0
    assert lexical_search.rank(odd_docs(spark), items.limit(0)).count() == 0
    odd = [(r["doc_id"], r["text"]) for r in odd_docs(spark).collect()]
    found = Counter(tuple(r) for r in lexical_search.rank(odd_docs(spark), items).collect())
    assert found == brute_search(odd, [(1, "one w3 W7"), (None, None)], 50)


def test_treaps_are_heaps_by_impact_and_ordered_by_document():
    rng = np.random.default_rng(2)
    counts = np.array([1, 0, 7, 300, 2, 0, 50])
    docs = np.concatenate([np.sort(rng.choice(4096, c, replace=False)) for c in counts])
    key = lexical_search._keys(rng.integers(0, 5, counts.sum()), docs)
    roots, left, right = lexical_search.children(key, counts)
    begin = np.cumsum(counts) - counts
    assert len(roots) == (counts > 0).sum()

    def walk(node, low, high):
        """All places of a segment, in order; children are less."""
        if low == high:
            assert node is None
            return []
        assert low <= node < high and key[node] == key[low:high].max()
        a = walk(node - left[node] if left[node] else None, low, node)
        return [*a, node, *walk(node + right[node] if right[node] else None, node + 1, high)]

    for root, b, c in zip(roots, begin[counts > 0], counts[counts > 0], strict=True):
        assert walk(int(root), int(b), int(b + c)) == list(range(b, b + c))
