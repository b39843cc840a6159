"""Models that are trained here: language, quality, n-grams. Held-out accuracy and brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from evidentia.llm import language_id, lm_score, quality_classifier
from evidentia.llm._shared import fold
from tests.llm.helpers import empty_docs, odd_docs, prose, words


def test_language(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, fold("doc_id", 5) == 0).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_every_language_has_its_share_of_the_sample(spark):
    rng = random.Random(5)
    langs = [f"l{k:03}" for k in range(120)]
    sizes = [40 if k < 100 else 14 for k in range(120)]
    rows = [(1000 * k + i, " ".join(words(rng, 5)), langs[k]) for k in range(120) for i in range(sizes[k])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = Counter(lang for lang, _ in language_id._sample(docs, 200, 1200, 3, 10))
    assert taken == {lang: 10 for lang in langs}
    many = spark.createDataFrame([(i, f"word{i}", f"l{i % 500}") for i in range(2000)], "doc_id long, text string, lang string")
    assert Counter(Counter(lang for lang, _ in language_id._sample(many, 200, 1600, 3, 10)).values()) == {4: 500}


def test_folded_weights_are_the_kernel():
    rng = random.Random(1)
    a, b = (language_id.presence(prose(rng), 3, 12).astype(float) for _ in range(2))
    shared = np.logical_and(a, b).sum() / math.sqrt(a.sum() * b.sum())
    assert abs(a @ (b / math.sqrt(b.sum())) / math.sqrt(a.sum()) - shared) < 1e-12


def test_language_equals_kernel_ridge(spark):
    """Scores are those of the kernel expansion over landmarks, and these solve the weighted ridge problem; equal scores go to the first language."""
    rng = random.Random(7)
    rows = [(i, " ".join(f"{'xyz'[i % 3]}{w}" for w in words(rng, 12, 60)), "abc"[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs, language_id.F.lit(True), order=3, bits=11, ridge=0.05)
    sample = language_id._sample(docs, 200, 1600, 3, 11)
    sets = [set(np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8))).tolist()) for _, m in sample]
    seen, land = Counter(), []
    for i, (lang, _) in enumerate(sample):
        if seen[lang] % 4 == 0:
            land.append(i)
        seen[lang] += 1
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    kzz, kxz = (np.array([[kernel(a, sets[j]) for j in land] for a in some]) for some in ([sets[i] for i in land], sets))
    values, vectors = np.linalg.eigh(kzz)
    root = vectors[:, values > 1e-6 * values[-1]] / np.sqrt(values[values > 1e-6 * values[-1]])
    phi = kxz @ root
    asked = [" ".join(f"{rng.choice('xyz')}{w}" for w in words(rng, 20, 60)) for _ in range(25)]
    got = model.predict(asked)
    want = np.zeros((len(asked), 3))
    for c, lang in enumerate("abc"):
        y = np.array([1.0 if x == lang else -1.0 for x, _ in sample])
        w = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        # The stationary point of sum w (y - phi b - a)^2 + ridge * mean(w) |b|^2, solved with the intercept as a column.
        full = np.column_stack([phi, np.ones(len(y))])
        penalty = 0.05 * w.sum() / len(y) * np.diag([1.0] * phi.shape[1] + [0.0])
        beta = np.linalg.solve(full.T @ (full * w[:, None]) + penalty, full.T @ (w * y))
        for i, text in enumerate(asked):
            own = set(np.flatnonzero(language_id.presence(text, 3, 11)).tolist())
            want[i, c] = np.array([kernel(own, sets[j]) for j in land]) @ root @ beta[:-1] + beta[-1]
    assert got[0] == ["abc"[i] for i in want.argmax(axis=1)]
    assert np.allclose(got[1], np.clip((want.max(axis=1) + 1) / 2, 0, 1), atol=1e-4)
    tied = language_id.Model(["a", "b"], np.zeros((1 << 11, 2), np.float32), np.zeros(2, np.float32), 3, 11)
    assert tied.predict(["text"]) == (["a"], [0.5])


def test_language_on_odd_and_empty_tables(spark):
    got = {(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(odd_docs(spark), fold("doc_id", 5) == 0).collect()}
    assert {(0, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0)} <= got
    assert language_id.identify(empty_docs(spark), fold("doc_id", 5) == 0).count() == 0
    none = odd_docs(spark).withColumn("lang", language_id.F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(none, fold("doc_id", 5) == 0).collect()} == {"und"}


def test_quality(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    held = fold("doc_id", 5) == 0
    model = quality_classifier.learn(docs, labels, ~held)
    got = quality_classifier.score(docs.filter(held), model, held).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_descent_equals_plain_loops():
    """Embeddings, softmax and their updates against the same steps number by number."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(12):
        at = np.unique(rng.integers(0, 32, rng.integers(1, 9))).astype("<u4")
        share = rng.random(len(at)).astype("<f4")
        rows.append((int(rng.integers(0, 2)), at, share / share.sum()))
    dim, epochs, rate, bits = 3, 4, 0.3, 5
    model = quality_classifier._descend(rows, dim, epochs, rate, bits)
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32).astype(float).tolist()
    out, bias, step = [[0.0] * dim, [0.0] * dim], [0.0, 0.0], 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, at, share = rows[i]
            mean = [sum(float(s) * vectors[a][d] for a, s in zip(at, share, strict=True)) for d in range(dim)]
            z = [sum(out[c][d] * mean[d] for d in range(dim)) + bias[c] for c in range(2)]
            p = [math.exp(x) / sum(map(math.exp, z)) for x in z]
            grad = [p[c] - (c == label) for c in range(2)]  # of the loss -log p[label] by z
            now = rate * (1 - step / (epochs * len(rows)))
            back = [sum(grad[c] * out[c][d] for c in range(2)) for d in range(dim)]
            for c in range(2):
                bias[c] -= 0.1 * now * grad[c]
                for d in range(dim):
                    out[c][d] -= now * grad[c] * mean[d]
            for a, s in zip(at, share, strict=True):
                for d in range(dim):
                    vectors[a][d] -= now * math.sqrt(len(at)) * float(s) * back[d]
            step += 1
    want = [sum(v[d] * (out[1][d] - out[0][d]) for d in range(dim)) for v in vectors]
    assert np.allclose(model.place, want, atol=1e-4) and abs(model.bias - (bias[1] - bias[0])) < 1e-4
    p = model.scores(["some words"])
    places = np.concatenate([*quality_classifier.features("some words", bits)])
    assert abs(p[0] - 1 / (1 + math.exp(-model.bias - np.mean([model.place[a] for a in places])))) < 1e-6


def test_quality_on_odd_and_empty_tables(spark):
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 0), (7, 0, 0), (None, 1, 0), (8, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    held, docs = fold("doc_id", 5) == 0, odd_docs(spark)
    model = quality_classifier.learn(docs, labels, ~held)
    assert quality_classifier.score(docs, model, held).count() == 17
    assert quality_classifier.keep_good(docs, model).columns == docs.columns
    none = quality_classifier.learn(docs, labels.limit(0), ~held)
    assert {r.score for r in quality_classifier.score(docs, none, held).collect()} == {0.5}
    assert quality_classifier.score(empty_docs(spark), model, held).count() == 0


def test_elias_fano():
    """Numbers and successors read in place, without and within bounds."""
    rng = np.random.default_rng(2)
    for n, universe in ((0, 10), (1, 1), (5, 2**52), (1000, 1000), (3000, 2**60), (100, 300), (5000, 2**33), (2000, 40)):
        v = np.sort(rng.integers(0, universe, n).astype(np.uint64))
        data = lm_score.EliasFano.encode(v, universe)
        held = lm_score.EliasFano(memoryview(data))
        assert np.array_equal(held.at(np.arange(n)), v)
        asked = np.concatenate([v[:50], rng.integers(0, universe, 200).astype(np.uint64)])
        at, found = held.successor(asked)
        assert np.array_equal(at, np.searchsorted(v, asked)) and np.array_equal(found, np.isin(asked, v))
        begin, end = np.full(len(asked), n // 4), np.full(len(asked), n // 2)
        at, found = held.successor(asked, begin, end)
        assert np.array_equal(at, n // 4 + np.searchsorted(v[n // 4 : n // 2], asked)) and np.array_equal(found, np.isin(asked, v[n // 4 : n // 2]))
        assert np.array_equal(lm_score.expand(lm_score.squeeze(v)), v)


def test_trie_stays_compact():
    """A built trie holds no array beside its mapping, and the mapping is much smaller than plain arrays."""
    rng = np.random.default_rng(3)
    words, contexts = (np.unique(rng.integers(0, 2**n, size, dtype=np.uint64) & ~np.uint64(1)) for n, size in ((63, 5_000), (52, 20_000)))
    rank = np.sort(rng.integers(0, len(contexts), 100_000)).astype(np.uint64)
    entries = np.unique((rank << np.uint64(32)) | rng.integers(0, 2**32, len(rank), dtype=np.uint64))
    trie = lm_score.Trie(
        words, np.arange(1, len(words) + 1), contexts, np.full(len(contexts), 7), entries, np.full(len(entries), 0.25), (0, 2**63, 0, 2**52)
    )
    for part in (trie.words, trie.contexts, trie.begin, trie.entries):
        assert all(x.base is not None and not x.flags.owndata for x in (part.lows, part.words, part.zeros))
    assert not any(x.flags.owndata for x in (trie.ones, trie.twos, trie.chances))
    assert trie.size < 0.65 * (16 * len(words) + 10 * len(contexts) + 8 * len(contexts) + 10 * len(entries))
    assert np.array_equal(trie.word_counts(words), np.arange(1, len(words) + 1)) and trie.word_counts(words[:9] + np.uint64(2)).sum() == 0
    at, codes = trie.context_codes(contexts)
    assert np.array_equal(at, np.arange(len(contexts))) and len(set(codes.tolist())) == 1
    got = trie.chance_codes((entries >> np.uint64(32)).astype(np.int64), entries & np.uint64(0xFFFFFFFF))
    assert np.allclose(lm_score.chance_of(got), 0.25, rtol=1e-3)
    other = (np.array([0, 1, -1]), np.array([5, 6, 7], np.uint64))
    assert trie.chance_codes(*other).sum() == 0


def brute(rows, m2, m3):
    tokens = [(i, (t or "").encode().lower().split() + [0]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    one, two, three = Counter(), Counter(), Counter()
    for i, t in tokens:
        if not held(i):
            s = [1, 1, *t]
            one.update(t)
            two.update(zip(s, s[1:], strict=False))
            three.update(zip(s, s[1:], s[2:], strict=False))
    n, v = sum(one.values()), len(one)
    out = []
    for i, t in tokens:
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        s, score = [1, 1, *t], 0.0
        for a, b, w in zip(s, s[1:], s[2:], strict=False):
            p2 = (two[b, w] + m2 * (one[w] + 1) / (n + v + 1)) / ((one[0] if b == 1 else one[b]) + m2)
            score += math.log10((three[a, b, w] + m3 * p2) / (two[a, b] + m3))
        out.append((i, held(i), len(t), sum(one[w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("hot", [10**9, 30])
def test_scores_equal_brute_force(spark, hot):
    """Also where the words after frequent contexts are dealt in parts."""
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, rng.randrange(60), 30))) for i in range(60)] + [
        (60, None), (61, ""), (None, "w1 W2 w3"), (5, "w1 w2"), (5, "w1 w2")
    ]
    rows += [(100 + i, "w1 w2 " * 9) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocks = lm_score.blocks_of(docs.withColumn("held_out", lm_score.F.lit(False)), 1000, 52, hot)
    assert len(lm_score.hot_contexts(blocks, hot)[0]) > 1 or hot > 100
    got = sorted(
        (tuple(r) for r in lm_score.score(docs, fold("doc_id", 7) == 2, block_bytes=1000, shard_bytes=500, m2=20.0, m3=3.0, hot=hot).collect()),
        key=lambda r: (str(r[0]), r[2], r[5])
    )
    want = sorted(brute(rows, 20.0, 3.0), key=lambda r: (str(r[0]), r[2], r[5]))
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-9 and abs(a[6] - b[6]) <= 2e-3 * max(1, abs(b[6])) and abs(a[7] * a[2] - a[6]) < 1e-9 * max(1, -a[6])


def test_contexts_spread_thinly_over_many_blocks_are_hot(spark):
    """Contexts that stand in no block as often as it tells surely are found all the same, and others are not; few are told."""
    rng, least, told, size = random.Random(4), 24_000, [], 0
    sure = least * lm_score.HOT_IN_BLOCK // lm_score.HOT
    thin = [f"w{i}" for i in range(4)]
    for number in range(1200):
        text = " ".join(f"{a} x y{rng.randrange(9)} {rng.randrange(10**9)}" for a in thin for _ in range(20)) + " w1 z" * 5
        block = lm_score.Block.of_texts([number], [False], [text])
        often, times = block.often(52, sure, number)
        told += zip(often.astype("int64").tolist(), times.tolist(), strict=True)
        size += len(text.split())
    assert sure > 20 and len(told) < size / sure * 2
    rows = [([c], [n]) for c, n in told]
    blocks = spark.createDataFrame(rows, "often array<long>, times array<long>")
    found, parts = lm_score.hot_contexts(blocks, least)
    block = lm_score.Block.of_texts([0], [False], [" ".join(f"{a} x" for a in thin)])
    want = set(block.pairs_of(52)[[2, 4, 6, 8]].tolist())  # w0 x and so on, behind the two marks of the begin
    assert want <= set(found.tolist()) and len(found) <= len(want) and (parts > 1).all()


def test_scores_of_odd_empty_and_unlearned_tables(spark):
    assert lm_score.score(odd_docs(spark), fold("doc_id", 7) == 2).count() == 17
    assert lm_score.score(empty_docs(spark), fold("doc_id", 7) == 2).count() == 0
    got = lm_score.score(odd_docs(spark), lm_score.F.lit(True)).collect()
    assert {r.train_tokens for r in got} == {0} and {r.base_score for r in got} == {0.0} and {r.n_known for r in got} == {0}
