"""Steps that work on what is asked for, once: the same results as the plain way, and bounds of what is grouped or met."""

import random

from pyspark.sql import functions as F

from evidentia.operators import infill, matching, novelty, records


def _texts(spark, n, seed):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.choices("abcdefgh", k=rng.choice([0, 1, 2, 9, 20]))) for i in range(n)], "k long, w array<string>")


def test_surprise_counts_only_pairs_that_are_asked_for(spark, monkeypatch):
    model, texts = _texts(spark, 60, 1), spark.createDataFrame([(1, ["a", "b", "zebra", "a"]), (2, []), (3, ["h"]), (4, ["c", "a"])], "k long, w array<string>")
    rows, plain = {}, infill.written

    def noted(df, tag):
        rows[tag] = plain(df, tag)
        return rows[tag]

    whole = infill.surprise(texts, "k", "w", infill.pair_counts(model, "w"))
    monkeypatch.setattr(infill, "written", noted)
    found = infill.surprise_in(texts, "k", "w", model, "w")
    by = lambda df: {(r["k"], r["at"], r["word"]): round(r["surprise"], 9) for r in df.collect()}
    assert by(found) == by(whole) and len(by(found)) == 7
    assert {(r["a"], r["b"]) for r in rows["pairs"].collect()} == {("a", "b"), ("c", "a")}


def test_a_word_beside_masks_is_looked_up_once(spark, monkeypatch):
    model = _texts(spark, 60, 2)
    rng, plain, asked = random.Random(3), infill._likely, []
    canvas = spark.createDataFrame([(k, i, None if rng.random() < 0.6 else rng.choice("abcdefghz")) for k in range(12) for i in range(8)], "k long, at int, word string")

    def likely(pairs, given, word, most):
        asked.extend((given, r[0]) for r in pairs.select(given).distinct().collect())
        return plain(pairs, given, word, most)

    monkeypatch.setattr(infill, "_likely", likely)
    found = infill.fill(canvas, "k", infill.pair_counts(model, "w"), 4)
    assert found.filter("word IS NULL").count() == 0 and found.agg(F.max("round")).first()[0] == 4
    assert len(asked) == len(set(asked)) > 8


def test_boxes_of_one_shape_are_met_once(spark, monkeypatch):
    """The best partner of each box by a plain search: copies, boxes of both sides, without area, across cells, negative, null."""
    rng, shapes, plain = random.Random(4), [], matching.written
    box = lambda: ((t := rng.choice([-3.0, 0.0, 1.5, 6.0, 13.0])), t + rng.choice([0, 1, 2, 20]), (f := rng.choice([0.0, 1.0])), f + rng.choice([0, 1, 2]))
    a, b = ([(i, rng.choice("xy"), *box()) for i in range(s, 600, 2)] for s in (0, 1))
    kind = "id long, grp string, t0 double, t1 double, f0 double, f1 double"
    left, right = spark.createDataFrame(a + [(900, "x", None, 1.0, 0.0, 1.0)], kind), spark.createDataFrame(b + [(901, None, 0.0, 1.0, 0.0, 1.0)], kind)
    monkeypatch.setattr(matching, "written", lambda df, tag: shapes.append(plain(df, tag)) or shapes[-1])
    got = {r["id"]: (r["id_b"], r["iou"]) for r in matching.best_overlaps(left, right, 7.0, ["grp"], 0.2).collect()}
    want = {}
    for i, g, t0, t1, f0, f1 in a:
        for j, h, u0, u1, e0, e1 in b:
            if g == h and t0 < u1 and u0 < t1:
                both = max(min(t1, u1) - max(t0, u0), 0) * max(min(f1, e1) - max(f0, e0), 0)
                joint = (t1 - t0) * (f1 - f0) + (u1 - u0) * (e1 - e0) - both
                if joint and round(both / joint, 9) >= 0.2:
                    want[i] = max(want.get(i, (0, 0)), (round(both / joint, 9), -j))
    assert got == {i: (-j, iou) for i, (iou, j) in want.items()} and len(got) > 100
    assert shapes[0].count() == len({x[1:] for x in a}) + 1 < 200


def test_grams_of_a_document_stay_in_its_task(spark, monkeypatch, capsys):
    """Fresh grams by a plain search, in small portions; no shuffle has a row for each gram."""
    monkeypatch.setattr(novelty, "AT_ONCE", 7)
    rng = random.Random(5)
    lines = [[rng.choices("abcd", k=rng.choice([1, 2, 3, 5, 9])) for _ in range(rng.choice([1, 3, 6]))] for _ in range(40)]
    texts = [None, "", " .. \n!", *["\n".join("-- !" if len(s) == 1 and i % 3 else " ".join(s) for s in d) for i, d in enumerate(lines)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    corpus = spark.createDataFrame([("a b c d a",), ("b",), (None,)], "text string")
    found = novelty.new_sentences(docs, "k", "text", corpus, "text")
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()
    known, want = grams("abcda") | grams("b"), {}
    for k, x in enumerate(texts):
        seen = set(known)
        for i, s in enumerate([s for s in (x or "").split("\n") if s.strip()]):
            g = grams([w for w in s.split() if w.isalpha()])
            if g:
                want[k, i] = (len(g), len(g - seen))
            seen |= g
    assert {(r["id"], r["idx"]): (r["grams"], r["fresh"]) for r in found.collect()} == want and len(want) > 50
    found.explain()
    assert "hashpartitioning(id" in (plan := capsys.readouterr().out)
    assert all("gram#" not in x.split(")")[0] for x in plan.split("hashpartitioning(id")[1:])


def test_the_words_of_a_text_are_found_once_for_all_fields(spark, capsys):
    docs = spark.createDataFrame([(1, "one Two. three"), (2, None), (3, "..."), (4, "x n/a")], "k long, text string")
    found = records.canvas(docs, "k", "text", {"first": r"^(\S+ \S+)", "last": r"(\S+)$"})
    assert {(r["id"], r["field"], r["value"], r["why"]) for r in found.collect()} == {
        (1, "first", "one Two.", None), (1, "last", "three", None), (2, "first", None, "empty"), (2, "last", None, "empty"),
        (3, "first", None, "empty"), (3, "last", None, "null wording"), (4, "first", "x n/a", None), (4, "last", None, "null wording")
    }
    found.explain()
    (judging,) = [x for x in capsys.readouterr().out.split("\n") if "Generate" in x]
    assert "_spaced#" in judging and "_text#" not in judging


def test_terms_are_dealt_by_document(spark, capsys):
    docs = spark.createDataFrame([(1, "cat the cat dog"), (2, None), (3, "the"), (4, "dog")], "k long, text string")
    found = novelty.terms(docs, "k", "text")
    found.explain()
    assert (plan := capsys.readouterr().out).count("Exchange") == 1 and "term#" not in plan.split("hashpartitioning(")[1].split(")")[0]
    assert {tuple(r) for r in found.collect()} == {(1, "cat", 2), (1, "dog", 1), (4, "dog", 1)}
