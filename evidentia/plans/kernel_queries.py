"""Queries that run kernels or fits: no SQL says the same; tests hold them against planted truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import arrays, spatial
from evidentia.plans.table_queries import _places


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def conversation_word_errors(spark, sf):
    c = _t(spark, sf, "conversations")
    a, b = c.select("conv_id", "turn", F.col("text").alias("said")), c.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("heard")
    )
    return arrays.word_errors(a.join(b, ["conv_id", "turn"]), "said", "heard", ["conv_id", "turn"])


def corpus_word_error_rate(spark, sf):
    return arrays.corpus_errors(conversation_word_errors(spark, sf)).select("subs", "dels", "ins", "hits", "words", F.round("wer", 6).alias("wer"))


def unusual_lines(spark, sf):
    li = _t(spark, sf, "lineitem").withColumns(
        {"id": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "log_price": F.log1p("l_extendedprice"), "log_quantity": F.log1p("l_quantity")}
    )
    features = ["log_price", "log_quantity", "l_discount", "l_tax"]
    return arrays.reconstruction_errors(
        li, "id", features, *arrays.fit_components(li, features, 0.7)
    ).select("id", F.round("error", 5).alias("error"))


def kriged_balances(spark, sf):
    p = _places(spark, sf)
    samples = p.filter("id % 3 <> 0").select(F.col("id").alias("sid"), F.col("lat").alias("slat"), F.col("lon").alias("slon"), "value")
    near = spatial.neighbours(p.filter("id % 3 = 0").select("id", "lat", "lon"), samples, 15_000, 0.25, 12)
    return arrays.kriged(near, 1e5, 1e6, 10_000).select("id", F.round("estimate", 3).alias("estimate"), F.round("sigma", 3).alias("sigma"))


def event_pulse_trains(spark, sf):
    e = _t(spark, sf, "events").select(
        F.col("user_id").alias("scene"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1e6").alias("toa_s")
    )
    return arrays.pulse_trains(e)


QUERIES = {f.__name__: f for f in (conversation_word_errors, corpus_word_error_rate, unusual_lines, kriged_balances, event_pulse_trains)}
ORACLE_SQL: dict[str, str] = {}
