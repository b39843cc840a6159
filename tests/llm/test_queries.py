"""The registered queries, and the pipeline, over the smallest tables."""

import __spark_entry__
import corpus_pipeline
from evidentia.llm import queries
from evidentia.llm._shared import table

SCHEMAS = {
    "op1_ngram_jaccard_join": "doc_id:bigint n_shingles:bigint component_id:bigint", "op2_html_extraction": "page_id:bigint url:string text:string n_chars:bigint",
    "op3_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op4_quality_rules": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op5_lm_scoring": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op6_sharding": "doc_id:bigint", "op7_line_dedup": "doc_id:bigint text:string", "op8_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op9_quality_classifier": "doc_id:bigint held_out:boolean score:double predicted:int", "op10_decontamination": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op11_fill_in_middle": "doc_id:bigint n:bigint form:string prefix_chars:bigint middle_chars:bigint output_sha256:string restored_sha256:string",
    "op12_best_fit_packing": "doc_id:bigint piece:int start:bigint length:bigint ids_crc32:bigint sequence_id:bigint offset:bigint",
    "op13_ranked_lexical_search": "item_id:bigint rank:int doc_id:bigint score:bigint",
}


def test_schemas_and_registration(spark, sf):
    assert set(SCHEMAS) == set(queries.QUERIES) and {*SCHEMAS, "pipeline"} <= set(__spark_entry__.queries())
    for name, want in SCHEMAS.items():
        got = [":".join(x) for x in queries.QUERIES[name](spark, sf).dtypes]
        assert got[: len(want.split())] == want.split(), name


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.settle(stage(spark, docs, sf), "test")
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() >= before / 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
