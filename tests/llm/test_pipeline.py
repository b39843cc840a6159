"""The whole pipeline against plain Python over the smallest table."""

import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from evidentia.llm import packing, quality_classifier
from evidentia.llm._shared import fold, table
from tests.llm.helpers import empty_docs, odd_docs
from tests.llm.test_pairs import brute, brute_hits


def without_boilerplate(docs):
    distinct = {(s or "", t) for _, t, s in docs}
    pages, seen = Counter(s for s, _ in distinct), defaultdict(Counter)
    for source, text in distinct:
        seen[source or ""].update({x.strip(" \t\r") for x in (text or "").split("\n")} - {""})
    bad = {s: {x for x, n in c.items() if n >= 3 and 10 * n > pages[s]} for s, c in seen.items()}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" \t\r") not in bad[s or ""]), s) for i, t, s in docs]


def test_run_equals_plain_python(spark, sf):
    from tokenizers import Tokenizer

    source = table(spark, sf, "documents")
    docs = [(r.doc_id, r.text, r.source) for r in source.collect()]
    model = quality_classifier.learn(source, table(spark, sf, "labels"), fold("doc_id", 5) != 0)
    docs = [d for d, s in zip(docs, model.scores([t for _, t, _ in docs]), strict=True) if s >= 0.3]
    docs = without_boilerplate(docs)
    first = {i: c for i, _, c in brute([(i, t) for i, t, _ in docs], 5, 80, 100)}
    docs = [d for d in docs if first[d[0]] == d[0]]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    clean = {r[0] for r in brute_hits([(i, t) for i, t, _ in docs], items) if not r[5]}
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, t, _ in docs:
        if i in clean:
            ids, start = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], 0
            for n in packing.lengths(len(ids)):
                want.append((i, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()), len(ids)))
                start += n
    got = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, sf).collect()]
    assert len(clean) > 100 and sorted(got) == sorted(want)


def test_run_on_odd_repeated_and_empty_tables(spark, tmp_path):
    """Nulls, repeated rows, a long text and columns with clashing names go through all stages; empty tables give no rows."""
    docs = odd_docs(spark)
    labels = "doc_id long, quality int, toxic int"
    tables = {
        "odd": (docs, [(6, 1, 0), (7, 0, 0), (None, 1, 0), (9, None, None)], [(1, "same text here"), (None, None)]),
        "empty": (empty_docs(spark), [], [])
    }
    for name, (own, marks, items) in tables.items():
        own.coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(marks, labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = {r.doc_id for r in rows}
    assert {0, 1, 2, 9} <= ids and not ids & {10, 11} and all(sum(r.ids[-1:]) == 2 for r in rows if r.start + r.length == r.doc_tokens)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
