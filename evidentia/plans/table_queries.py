"""Queries of matching, metrics, novelty, style, places and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import geo, stats, text, tiers
from evidentia.operators import matching, metrics, novelty, records, spatial, style


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Matching


def prototype_classes(spark, sf):
    v = _t(spark, sf, "embeddings")
    return matching.classify(v, "vec_id", "embedding", matching.prototypes(v, "embedding", "label"), 0.8).select(
        "id", "nearest", F.round("distance", 5).alias("distance"), F.round("second", 5).alias("second"), "answer"
    )


def prototype_thresholds(spark, sf):
    return matching.class_thresholds(_t(spark, sf, "embeddings"), "embedding", "label").select(
        "label", "n", F.round("threshold", 5).alias("threshold")
    )


def _features(spark, sf):
    li = _t(spark, sf, "lineitem")
    cols = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return li.select(
        F.col("l_suppkey").alias("emitter"), F.col("l_orderkey"), F.col("l_linenumber"), F.explode(cols).alias("x")
    ).select("emitter", "l_orderkey", "l_linenumber", "x.feature", "x.value")


def emitter_library(spark, sf):
    return matching.library(_features(spark, sf)).select("emitter", "feature", "n", F.round("mean", 4).alias("mean"), F.round("var", 3).alias("var"))


def pooled_variance(spark, sf):
    return matching.pooled_variance(matching.library(_features(spark, sf))).select("feature", F.round("pooled", 3).alias("pooled"))


def emitter_match(spark, sf):
    f = _features(spark, sf)
    probes = f.filter("l_orderkey % 100 = 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "feature", "value")
    limits = {k: (stats.chi2_quantile(0.5, k) / k) ** 0.5 for k in range(1, 5)}
    return matching.library_match(probes, matching.library(f), limits).select(
        "id", "nearest", F.round("distance", 5).alias("distance"), "used", "answer"
    )


def ledger_labels(spark, sf):
    p = _t(spark, sf, "part")
    features = p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("value"))
    low, high = features.filter("id % 7 = 0").select("value"), features.filter("id % 5 = 0").select("value")
    return matching.ledger_labels(features, [("receiver", low, 0.05), ("background", high, 0.2)])


def order_overlaps(spark, sf):
    b = _boxes(spark, sf)
    pairs = matching.overlaps(b, b, "t0", "t1", 7.0, ["grp"]).filter("id < id_b")
    return matching.box_iou(pairs).filter("iou > 0.2").select("id", "id_b", F.round("iou", 6).alias("iou"))


def _boxes(spark, sf):
    o = _t(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    return o.select(
        F.col("o_orderkey").alias("id"), F.pmod("o_custkey", F.lit(50)).alias("grp"), day.alias("t0"),
        (day + 1 + F.pmod("o_orderkey", F.lit(9))).alias("t1"), F.pmod("o_custkey", F.lit(13)).cast("double").alias("f0"),
        (F.pmod("o_custkey", F.lit(13)) + 4).cast("double").alias("f1")
    )


def claimed_boxes(spark, sf):
    b = _boxes(spark, sf)
    left, right = b.filter("id % 2 = 0"), b.filter("id % 2 = 1")
    return matching.first_claim(matching.best_overlaps(left, right, 28.0, ["grp"], 0.2), "id", "id_b", "iou", "t0", 0.2).select("id", "id_b", F.round("iou", 6).alias("iou"), "matched")


def owned_boxes(spark, sf):
    b = _boxes(spark, sf).withColumns({"own0": F.floor(F.col("t0") / 10) * 10.0, "own1": F.floor(F.col("t0") / 10) * 10.0 + 10.0})
    return matching.owned(b, ("t0", "t1"), ("own0", "own1")).select("id", "t0", "t1")


def confirmed_labels(spark, sf):
    o, li = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    boxes = o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", matching.UNKNOWN).otherwise(F.col("o_orderstatus")).alias("cls")
    )
    results = li.select(
        F.col("l_orderkey").alias("id"), F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("decoder"),
        F.col("l_linenumber").alias("rank"), (F.col("l_discount") > 0.05).alias("ok"), F.col("l_linestatus").alias("label")
    )
    return matching.confirmed(boxes, results).select("id", "decoder", "label", "disagrees")


# Metrics: document labels against simple guesses


def _scored(spark, sf):
    d, lab = _t(spark, sf, "documents"), _t(spark, sf, "labels")
    junk = F.regexp_count("text", F.lit(r"[*$#%&!|]")) / F.greatest(F.length("text"), F.lit(1))
    return d.join(lab, "doc_id").select("doc_id", "quality", "toxic", "n_chars", F.round(1 - F.least(5 * junk, F.lit(1.0)), 6).alias("score"))


def label_confusion(spark, sf):
    return metrics.confusion(_scored(spark, sf).withColumn("guess", (F.col("score") > 0.9).cast("int")), "quality", "guess")


def label_scores(spark, sf):
    return metrics.class_scores(
        _scored(spark, sf).withColumn("guess", (F.col("score") > 0.9).cast("int")), "quality", "guess"
    ).select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def label_summary(spark, sf):
    return metrics.summary_scores(
        _scored(spark, sf).withColumn("guess", (F.col("score") > 0.9).cast("int")), "quality", "guess"
    ).select("n", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def label_reliability(spark, sf):
    s = _scored(spark, sf)
    return metrics.reliability(s, "score", F.col("quality") == 1).select(
        "bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy")
    )


def label_calibration(spark, sf):
    return metrics.calibration_error(_scored(spark, sf), "score", F.col("quality") == 1).select("n", F.round("ece", 6).alias("ece"))


def label_average_precision(spark, sf):
    return metrics.average_precision(_scored(spark, sf), "score", "quality").select("positives", F.round("ap", 6).alias("ap"))


def label_best_threshold(spark, sf):
    return metrics.best_threshold(_scored(spark, sf), "score", "quality").select(
        "threshold", *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall")]
    )


def label_operating_point(spark, sf):
    return metrics.operating_point(_scored(spark, sf), "score", "quality", 0.1).select(
        "threshold", F.round("detected", 6).alias("detected"), F.round("false_rate", 6).alias("false_rate")
    )


def label_auc(spark, sf):
    return metrics.auc(_scored(spark, sf), "score", "quality").select("positives", "negatives", F.round("auc", 6).alias("auc"))


def price_spearman(spark, sf):
    return metrics.spearman(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select("n", F.round("spearman", 6).alias("spearman"))


def price_kendall(spark, sf):
    li = _t(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("a"), F.floor(F.col("l_extendedprice") / 10000).alias("b"))
    return metrics.kendall_tau_b(li, "a", "b").select("n", F.round("tau_b", 6).alias("tau_b"))


def price_quantile(spark, sf):
    return metrics.disc_quantile(_t(spark, sf, "orders"), "o_totalprice", 0.95)


# Novelty and style


def tfidf_nearest(spark, sf):
    d, b = _t(spark, sf, "documents"), _t(spark, sf, "benchmark")
    corpus = novelty.terms(b, "item_id", "text")
    return novelty.similar(
        novelty.weights(novelty.terms(d, "doc_id", "text"), corpus), novelty.weights(corpus, corpus), 1
    ).select("id", F.round("cosine", 6).alias("cosine"))


def gram_containment(spark, sf):
    return novelty.containment(
        _t(spark, sf, "documents"), "doc_id", "text", _t(spark, sf, "benchmark"), "text"
    ).select("id", "grams", "seen", F.round("contained", 6).alias("contained"))


def novelty_rank(spark, sf):
    return novelty.rank(
        novelty.new_sentences(_t(spark, sf, "documents"), "doc_id", "text", _t(spark, sf, "benchmark"), "text")
    ).select("id", F.round("added", 4).alias("added"), "novel_sentences")


def document_style(spark, sf):
    return style.measures(_t(spark, sf, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn")), "key", "text").select(
        "id", "n_words", "sentences", *[F.round(c, 5).alias(c) for c in ("stop_rate", "sentence_words", "sentence_commas", "richness")]
    )


def style_delta(spark, sf):
    d = _t(spark, sf, "documents")
    return style.delta(
        style.function_rates(d, "doc_id", "text"), d.select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"))
    ).select("group_a", "group_b", F.round("delta", 5).alias("delta"))


def style_divergence(spark, sf):
    d = _t(spark, sf, "documents").withColumn("n", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    return style.divergence_bits(
        style.length_histogram(d, "lang", "n", (50, 100, 200, 400, 800))
    ).select("group_a", "group_b", F.round("bits", 6).alias("bits"))


def suspect_text(spark, sf):
    c = _t(spark, sf, "documents")
    return c.select(
        "doc_id", F.size(text.suspect_lines(F.col("text"))).alias("suspect"), text.suspect_count(F.col("text")).alias("suspect_all"), F.size(text.redaction_marks(F.col("text"))).alias("redacted"),
        text.fence_id(F.col("text")).alias("fence")
    )


def extracted_licence(spark, sf):
    d = _t(spark, sf, "documents").withColumn("got", F.regexp_extract("text", r"(?m)^(?:Licensed|Released) under (?:the )?([^\n.]+)", 1))
    return d.select(
        "doc_id", records.judged(F.when(F.col("got") != "", F.col("got")), F.col("text")).alias("j")
    ).select("doc_id", "j.value", "j.ok", "j.why")


# Places: customers stand on a grid made from their keys


def _places(spark, sf, name="customer", key="c_custkey", value="c_acctbal"):
    k = F.col(key)
    return _t(spark, sf, name).select(
        k.alias("id"), (50 + F.pmod(k * 37, F.lit(211)) / 100).alias("lat"), (5 + F.pmod(k * 91, F.lit(307)) / 100).alias("lon"),
        F.col(value).cast("double").alias("value")
    )


def idw_estimates(spark, sf):
    p = _places(spark, sf)
    samples = p.filter("id % 3 <> 0").select(F.col("id").alias("sid"), F.col("lat").alias("slat"), F.col("lon").alias("slon"), "value")
    return spatial.idw(
        p.filter("id % 3 = 0").select("id", "lat", "lon"), samples, 15_000, 0.25, 8
    ).select("id", "used", F.round("estimate", 3).alias("estimate"))


def value_variogram(spark, sf):
    return spatial.variogram(_places(spark, sf), [0, 2_000, 5_000, 10_000], 0.2).select(
        "lag", "pairs", F.round("metres", 2).alias("metres"), F.round("semivariance", 1).alias("semivariance")
    )


def merged_samples(spark, sf):
    return spatial.merged(_places(spark, sf), 0.25).select(
        "row", "col", "n", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("value", 4).alias("value")
    )


def fold_errors(spark, sf):
    li = _t(spark, sf, "lineitem")
    return spatial.fold_errors(
        li.withColumn("guess", F.col("l_quantity") * 1400), "l_extendedprice", "guess", F.pmod("l_orderkey", F.lit(5))
    ).select("fold", "n", *[F.round(c, 2).alias(c) for c in ("rmse", "mae", "bias")])


def geodesy(spark, sf):
    p = _places(spark, sf)
    return p.select(
        "id", F.round(geo.haversine_m(F.col("lat"), F.col("lon"), 52.0, 6.0), 2).alias("metres"),
        F.round(geo.bearing_deg(F.col("lat"), F.col("lon"), 52.0, 6.0), 5).alias("bearing"),
        F.round(geo.fspl_db(geo.haversine_m(F.col("lat"), F.col("lon"), 52.0, 6.0), 446e6), 5).alias("loss_db")
    )


def locators(spark, sf):
    return _places(spark, sf).select("id", geo.locator(F.col("lat"), F.col("lon")).alias("grid"))


def band_counts(spark, sf):
    return _t(spark, sf, "events").groupBy(geo.band_of(F.col("value")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def bearing_cells(spark, sf):
    grid = spark.range(400).select(
        F.col("id").alias("cell"), (50 + F.floor(F.col("id") / 20) * 0.1).alias("lat"), (5 + F.pmod("id", F.lit(20)) * 0.15).alias("lon")
    )
    b = _places(spark, sf, "supplier", "s_suppkey", "s_acctbal").select(
        F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), geo.bearing_deg(F.col("lat"), F.col("lon"), 51.03, 6.02).alias("deg"),
        F.lit(5.0).alias("sigma"), (F.pmod("id", F.lit(3)) == 2).alias("ambiguous")
    )
    mass = spatial.bearing_posterior(grid, b).withColumn("mass", F.round("mass", 9))
    return spatial.densest(mass, "mass", 0.9).select("cell", F.round("mass", 6).alias("mass"), F.round("credible", 5).alias("credible"))


def fingerprint_places(spark, sf):
    li = _t(spark, sf, "lineitem")
    long = li.groupBy(F.col("l_suppkey").alias("place"), F.col("l_linenumber").alias("key")).agg(F.avg(-F.col("l_quantity") - 50).alias("level"))
    heard = li.filter("l_orderkey % 100 = 0").select(
        F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("key"), (-F.col("l_quantity") - 50).cast("double").alias("level")
    )
    return spatial.fingerprint_loglik(heard, spatial.signal_matrix(long)).select(
        "qid", "place", "shared", (F.round("loglik", 5) + 0.0).alias("loglik")
    )


# Records


def rolled_counts(spark, sf):
    return records.rolled_counts(_t(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


def dataset_plan(spark, sf):
    o = _t(spark, sf, "orders")
    originals = o.filter("o_orderkey % 2 = 1").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), F.col("o_custkey").alias("grp"),
        records.role(F.col("o_custkey")).alias("role")
    )
    copies = o.filter("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"), (F.col("o_orderkey") - 1).alias("parent"),
        F.pmod("o_custkey", F.lit(7)).alias("generator"), (F.pmod("o_custkey", F.lit(11)) == 0).alias("fresh")
    )
    return records.dataset_plan(originals, copies, spark.createDataFrame([(3,), (5,)], "generator long"))


def weak_tests(spark, sf):
    o = _t(spark, sf, "orders")
    return records.weak_tests(
        o.select(F.col("o_orderpriority").alias("type"), F.col("o_custkey").alias("grp"), records.role(F.col("o_orderkey")).alias("role"))
    )


def row_problems(spark, sf):
    li = _t(spark, sf, "lineitem")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    return records.problems(
        li.withColumn("id", key), "id",
        {"quantity must be under 49": F.col("l_quantity") < 49, "discount must not exceed tax by 0.09": F.col("l_discount") - F.col("l_tax") < 0.09}
    )


def role_coverage(spark, sf):
    return records.coverage(
        _t(spark, sf, "lineitem"), F.col("l_discount") > 0.05, "l_returnflag"
    ).select("l_returnflag", "trials", "hits", F.round("share", 6).alias("share"))


def unusual_orders(spark, sf):
    o = _t(spark, sf, "orders")
    return records.unusual(
        o.select("o_orderkey", "o_totalprice"), "o_totalprice", o.filter("o_orderstatus = 'F'"), "o_totalprice"
    ).select("o_orderkey", F.round("percentile", 5).alias("percentile"))


def tiers_of_priorities(spark, sf):
    o = _t(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "measurement").when(F.col("o_orderstatus") == "O", "interpolate").otherwise("operator").alias("method")
    )
    return tiers.check_tier(o.withColumn("tier", tiers.tier_for(F.col("method")))).groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), F.first(tiers.is_record(F.col("tier"))).alias("record")
    )


_NAMES = """prototype_classes prototype_thresholds emitter_library pooled_variance emitter_match ledger_labels order_overlaps claimed_boxes owned_boxes confirmed_labels label_confusion label_scores label_summary
label_reliability label_calibration label_average_precision label_best_threshold label_operating_point label_auc price_spearman price_kendall price_quantile tfidf_nearest gram_containment novelty_rank document_style
style_delta style_divergence suspect_text extracted_licence idw_estimates value_variogram merged_samples fold_errors geodesy locators band_counts bearing_cells fingerprint_places rolled_counts dataset_plan weak_tests
row_problems role_coverage unusual_orders tiers_of_priorities""".split()
QUERIES = {name: globals()[name] for name in _NAMES}

_STOP = ", ".join(f"'{w}'" for w in text.STOP)
_WORDS = "regexp_extract_all(lower(coalesce({t}, '')), '[\\p{{L}}\\p{{N}}_]+(?:[:.''’\\-/][\\p{{L}}\\p{{N}}_]+)*')"
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_FEAT = "f AS (SELECT l_suppkey AS emitter, l_orderkey, l_linenumber, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax])::DOUBLE AS value FROM lineitem)"
_LIB = "lib AS (SELECT emitter, feature, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM f GROUP BY ALL), pv AS (SELECT feature, sum((n - 1) * var) / sum(n - 1) AS pooled FROM lib WHERE n > 1 GROUP BY 1)"
_SCORED = "s AS (SELECT doc_id, quality, toxic, n_chars, round(1 - least(5 * (length(text) - length(regexp_replace(text, '[*$#%&!|]', '', 'g'))) / greatest(length(text), 1), 1.0), 6) AS score FROM documents JOIN labels USING (doc_id))"
_CUM = "g AS (SELECT score, sum((quality = 1)::INT) AS pos, sum((quality <> 1)::INT) AS neg FROM s GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM g)"
_BOX = "b AS (SELECT o_orderkey AS id, o_custkey % 50 AS grp, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS t0, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE + 1 + o_orderkey % 9 AS t1, (o_custkey % 13)::DOUBLE AS f0, (o_custkey % 13 + 4)::DOUBLE AS f1 FROM orders)"
_IOU = "(greatest(least(x.t1, y.t1) - greatest(x.t0, y.t0), 0) * greatest(least(x.f1, y.f1) - greatest(x.f0, y.f0), 0))"
_IOU = f"({_IOU} / ((x.t1 - x.t0) * (x.f1 - x.f0) + (y.t1 - y.t0) * (y.f1 - y.f0) - {_IOU}))"
_PLACE = "p AS (SELECT {k} AS id, 50 + ({k} * 37 % 211) / 100 AS lat, 5 + ({k} * 91 % 307) / 100 AS lon, {v}::DOUBLE AS value FROM {t})"
_P = _PLACE.format(k="c_custkey", v="c_acctbal", t="customer")
_HAV = "(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))))"
_BEAR = "degrees(atan2(sin(radians({d}) - radians({b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b}))))"
_BEAR = f"(CASE WHEN {_BEAR} < 0 THEN {_BEAR} + 360 ELSE {_BEAR} END)"
_GRAMS = "list_distinct(list_transform(range(1, greatest(len({w}) - 2, 1) + 1), lambda i: array_to_string({w}[i:i+2], ' ')))"
_TIER = "CASE o_orderstatus WHEN 'F' THEN 'measured' WHEN 'O' THEN 'inferred' ELSE 'confirmed' END"


def _grams_of(source: str, key: str) -> str:
    return f"SELECT {key} AS id, unnest({_GRAMS.format(w='w')}) AS gram FROM (SELECT {key}, {_WORDS.format(t='text')} AS w FROM {source}) WHERE len(w) > 0"


_LIMIT = (stats.chi2_quantile(0.5, 4) / 4) ** 0.5
_BANDS = " ".join(f"WHEN value BETWEEN {lo} AND {hi} THEN '{name}'" for name, lo, hi in geo.BANDS)

ORACLE_SQL = {
    "prototype_classes": f"""
        WITH m AS (SELECT label, d, avg(embedding[d]::DOUBLE) AS m FROM embeddings, range(1, 65) AS r(d) GROUP BY ALL), u AS (SELECT label, list(m
            ORDER BY d) AS v FROM m GROUP BY 1), c AS (SELECT label, v, sqrt({_DOT.format(a='v', b='v')}) AS n FROM u),
        x AS (SELECT vec_id AS id, label, 1 - list_sum(list_transform(range(1, 65),
            lambda i: e.embedding[i]::DOUBLE * c.v[i])) / n / sqrt(list_sum(list_transform(range(1, 65),
            lambda i: e.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE))) AS distance FROM (SELECT vec_id, embedding FROM embeddings) AS e, c),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, label) AS r, lead(distance) OVER (PARTITION BY id ORDER BY distance,
            label) AS second FROM x)
        SELECT id, label AS nearest, round(distance, 5) AS distance, round(second, 5) AS second, CASE WHEN distance <= 0.8 THEN label::VARCHAR
            ELSE 'UNKNOWN' END AS answer FROM r WHERE r = 1""",
    "prototype_thresholds": """
        WITH e AS (SELECT vec_id, label, d, embedding[d]::DOUBLE AS x FROM embeddings, range(1, 65) AS r(d)), t AS (SELECT *,
            sum(x) OVER (PARTITION BY label, d) - x AS o FROM e), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
        d AS (SELECT vec_id, label, 1 - sum(x * o) / sqrt(sum(x * x)) / sqrt(sum(o * o)) AS q FROM t GROUP BY ALL)
        SELECT label, any_value(n) AS n, round(least(greatest(CASE WHEN any_value(n) < 10 THEN quantile_cont(q, 0.95) * 1.25 ELSE quantile_cont(q,
            0.95) END, 0.0001), 2.0), 5) AS threshold FROM d JOIN n USING (label) WHERE n > 1 GROUP BY label""",
    "emitter_library": f"WITH {_FEAT}, {_LIB} SELECT emitter, feature, n, round(mean, 4) AS mean, round(var, 3) AS var FROM lib",
    "pooled_variance": f"WITH {_FEAT}, {_LIB} SELECT feature, round(pooled, 3) AS pooled FROM pv",
    "emitter_match": f"""
        WITH {_FEAT}, {_LIB}, q AS (SELECT l_orderkey * 10 + l_linenumber AS id, feature, value FROM f WHERE l_orderkey % 100 = 0),
        d AS (SELECT id, emitter, count(*) AS used, sqrt(avg(pow(value - mean, 2) / pooled)) AS distance FROM q JOIN lib USING (feature)
            JOIN pv USING (feature) WHERE pooled > 0 GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, emitter) AS r FROM d)
        SELECT id, emitter AS nearest, round(distance, 5) AS distance, used, CASE WHEN used = 4 AND distance <= {_LIMIT!r} THEN emitter::VARCHAR
            ELSE 'UNKNOWN' END AS answer FROM r WHERE r = 1""",
    "ledger_labels": """
        WITH f AS (SELECT p_partkey AS id, p_retailprice::DOUBLE AS value FROM part)
        SELECT id, value, CASE WHEN EXISTS (SELECT 1 FROM f AS k WHERE k.id % 7 = 0 AND abs(k.value - f.value) <= 0.05) THEN 'receiver'
            WHEN EXISTS (SELECT 1 FROM f AS k WHERE k.id % 5 = 0 AND abs(k.value - f.value) <= 0.2) THEN 'background' ELSE 'new' END AS label
            FROM f""",
    "order_overlaps": f"WITH {_BOX} SELECT x.id, y.id AS id_b, round({_IOU}, 6) AS iou FROM b AS x JOIN b AS y ON x.grp = y.grp AND x.id < y.id AND x.t0 < y.t1 AND y.t0 < x.t1 WHERE {_IOU} > 0.2",
    "claimed_boxes": f"""
        WITH {_BOX}, p AS (SELECT x.id, y.id AS id_b, x.t0, round({_IOU}, 9) AS iou FROM b AS x JOIN b AS y ON x.grp = y.grp AND x.id % 2 = 0
            AND y.id % 2 = 1 AND x.t0 < y.t1 AND y.t0 < x.t1),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY iou DESC, id_b) AS r FROM p WHERE iou >= 0.2)
        SELECT id, id_b, round(iou, 6) AS iou, row_number() OVER (PARTITION BY id_b ORDER BY t0 DESC, id) = 1 AS matched FROM r WHERE r = 1""",
    "owned_boxes": f"WITH {_BOX}, o AS (SELECT *, floor(t0 / 10) * 10 AS a FROM b) SELECT id, greatest(t0, a) AS t0, least(t1, a + 10) AS t1 FROM o WHERE (t0 + t1) / 2 >= a AND (t0 + t1) / 2 < a + 10",
    "confirmed_labels": """
        WITH b AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'UNKNOWN' ELSE o_orderstatus END AS cls FROM orders),
        r AS (SELECT l_orderkey AS id, l_linenumber, l_linestatus AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
            l_linestatus) AS r FROM lineitem WHERE l_discount > 0.05)
        SELECT b.id, 'd' || l_linenumber AS decoder, coalesce(label, cls) AS label, label <> cls AS disagrees FROM b LEFT JOIN (SELECT * FROM r
            WHERE r = 1) AS r ON r.id = b.id AND cls <> 'UNKNOWN'""",
    "label_confusion": f"WITH {_SCORED} SELECT quality AS truth, (score > 0.9)::INT AS guess, count(*) AS n FROM s GROUP BY ALL",
    "label_scores": f"""
        WITH {_SCORED}, q AS (SELECT quality AS t, (score > 0.9)::INT AS g FROM s), c AS (SELECT DISTINCT t AS class FROM q), x AS (SELECT class,
            (SELECT count(*) FROM q WHERE t = class) AS support, (SELECT count(*) FROM q WHERE g = class) AS said, (SELECT count(*) FROM q
            WHERE t = class AND g = class) AS hits FROM c)
        SELECT class, support, round(CASE WHEN said > 0 THEN hits / said ELSE 0 END, 6) AS precision, round(hits / support, 6) AS recall,
            round(2 * hits / (support + said), 6) AS f1 FROM x""",
    "label_summary": f"""
        WITH {_SCORED}, q AS (SELECT quality AS t, (score > 0.9)::INT AS g FROM s), c AS (SELECT DISTINCT t AS class FROM q), x AS (SELECT class,
            (SELECT count(*) FROM q WHERE t = class) AS support, (SELECT count(*) FROM q WHERE g = class) AS said, (SELECT count(*) FROM q
            WHERE t = class AND g = class) AS hits FROM c)
        SELECT count(*) AS n, round(avg((t = g)::INT), 6) AS accuracy, round((SELECT avg(2 * hits / (support + said)) FROM x), 6) AS macro_f1
            FROM q""",
    "label_reliability": f"WITH {_SCORED} SELECT least(greatest(ceil(score * 15), 1), 15)::INT AS bin, count(*) AS n, round(avg(score), 6) AS confidence, round(avg((quality = 1)::INT), 6) AS accuracy FROM s GROUP BY 1",
    "label_calibration": f"WITH {_SCORED}, r AS (SELECT least(greatest(ceil(score * 15), 1), 15)::INT AS bin, count(*) AS n, avg(score) AS c, avg((quality = 1)::INT) AS a FROM s GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM r",
    "label_average_precision": f"WITH {_SCORED}, {_CUM}, b AS (SELECT *, max(tp / (tp + fp)) OVER (ORDER BY score) AS best FROM c) SELECT sum(pos)::BIGINT AS positives, round(sum(pos * best) / sum(pos), 6) AS ap FROM b",
    "label_best_threshold": f"WITH {_SCORED}, {_CUM}, f AS (SELECT *, 2 * tp / (tp + fp + (SELECT sum(pos) FROM g)) AS f1, (SELECT sum(pos) FROM g) AS p FROM c) SELECT score AS threshold, round(f1, 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM f ORDER BY f1 DESC, score DESC LIMIT 1",
    "label_operating_point": f"WITH {_SCORED}, {_CUM}, t AS (SELECT sum(pos) AS p, sum(neg) AS n FROM g) SELECT min(score) AS threshold, round(min_by(tp / p, score), 6) AS detected, round(min_by(fp / n, score), 6) AS false_rate FROM c, t WHERE fp <= 0.1 * n",
    "label_auc": f"WITH {_SCORED}, {_CUM} SELECT sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives, round(sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM c",
    "price_spearman": """
        WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a,
            rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS b FROM lineitem)
        SELECT count(*) AS n, round(corr(a, b), 6) AS spearman FROM r""",
    "price_kendall": """
        WITH c AS (SELECT trunc(l_quantity)::INT AS a, floor(l_extendedprice / 10000) AS b, count(*) AS n FROM lineitem GROUP BY ALL),
            t AS (SELECT sum(n) AS n FROM c),
        s AS (SELECT sum(sign(x.a - y.a) * sign(x.b - y.b) * x.n * y.n) / 2 AS s FROM c AS x, c AS y), ta AS (SELECT sum(n * (n - 1) / 2) AS v
            FROM (SELECT sum(n) AS n FROM c GROUP BY a)), tb AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY b))
        SELECT t.n::BIGINT AS n, round(s / sqrt((t.n * (t.n - 1) / 2 - ta.v) * (t.n * (t.n - 1) / 2 - tb.v)), 6) AS tau_b FROM t, s, ta, tb""",
    "price_quantile": "SELECT min(o_totalprice) AS threshold, any_value(n) AS n FROM (SELECT o_totalprice, count(*) OVER (ORDER BY o_totalprice) AS upto, count(*) OVER () AS n FROM orders) WHERE upto >= 0.95 * n",
    "tfidf_nearest": f"""
        WITH dt AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_WORDS.format(t='text')}) AS term FROM documents)
            WHERE term NOT IN ({_STOP}) GROUP BY ALL), bt AS (SELECT id, term, count(*) AS tf FROM (SELECT item_id AS id,
            unnest({_WORDS.format(t='text')}) AS term FROM benchmark) WHERE term NOT IN ({_STOP}) GROUP BY ALL),
        n AS (SELECT count(DISTINCT id) AS n FROM bt), df AS (SELECT term, count(*) AS df FROM bt GROUP BY 1),
        dw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS w FROM dt LEFT JOIN df USING (term), n), bw AS (SELECT id,
            term, (1 + ln(tf)) * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS w FROM bt LEFT JOIN df USING (term), n),
        dn AS (SELECT id, sqrt(sum(w * w)) AS l FROM dw GROUP BY 1), bn AS (SELECT id, sqrt(sum(w * w)) AS l FROM bw GROUP BY 1), c AS (SELECT dw.id,
            bw.id AS o, sum(dw.w * bw.w) AS s FROM dw JOIN bw USING (term) GROUP BY ALL)
        SELECT c.id, round(max(s / dn.l / bn.l), 6) AS cosine FROM c JOIN dn ON dn.id = c.id JOIN bn ON bn.id = c.o GROUP BY c.id""",
    "gram_containment": f"""
        WITH d AS ({_grams_of('documents', 'doc_id')}), b AS (SELECT DISTINCT gram FROM ({_grams_of('benchmark', 'item_id')}))
        SELECT id, count(*) AS grams, count(b.gram) AS seen, round(count(b.gram) / count(*), 6) AS contained FROM d LEFT JOIN b ON d.gram = b.gram
            GROUP BY id""",
    "novelty_rank": f"""
        WITH s AS (SELECT doc_id AS id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(10),
            'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
        p AS (SELECT id, i, {_WORDS.format(t='l[i]')} AS w FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM s)),
        g AS (SELECT id, i, unnest({_GRAMS.format(w='w')}) AS gram FROM p WHERE len(w) > 0), b AS (SELECT DISTINCT gram
            FROM ({_grams_of('benchmark', 'item_id')})),
        f AS (SELECT id, i, count(*) AS fresh FROM (SELECT id, gram, min(i) AS i FROM g GROUP BY ALL) WHERE gram NOT IN (SELECT gram FROM b)
            GROUP BY ALL),
        t AS (SELECT id, i, count(*) AS grams FROM g GROUP BY ALL), r AS (SELECT t.id, grams, coalesce(fresh, 0) / grams AS score FROM t LEFT
            JOIN f ON f.id = t.id AND f.i = t.i)
        SELECT id, round(sum(grams * greatest(score - 0.5, 0)), 4) AS added, sum((score > 0.5)::INT)::BIGINT AS novel_sentences FROM r GROUP BY 1""",
    "suspect_text": r"""
        SELECT doc_id, least(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x,
            '(?i)\b(ignore|disregard|forget)\b.{0,40}\b(instruction|instructions|above|previous|prompt)\b|\byou are now\b|\bsystem prompt\b'))),
            5)::INT AS suspect, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x,
            '(?i)\b(ignore|disregard|forget)\b.{0,40}\b(instruction|instructions|above|previous|prompt)\b|\byou are now\b|\bsystem prompt\b')))::INT AS suspect_all,
            len(regexp_extract_all(coalesce(text, ''), '(?i)\[(?:redacted|removed|withheld)\]|█{2,}|\bX{4,}\b'))::INT AS redacted,
                substr(sha256(coalesce(text, '')), 1, 8) AS fence FROM documents""",
    "idw_estimates": f"""
        WITH {_P}, n AS (SELECT x.id, y.id AS sid, y.value, {_HAV.format(a='x.lat', b='x.lon', c='y.lat', d='y.lon')} AS m FROM p AS x
            JOIN p AS y ON x.id % 3 = 0 AND y.id % 3 <> 0 AND abs(x.lat - y.lat) < 0.3),
        k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, sid) AS r FROM n WHERE m <= 15000) WHERE r <= 8),
        e AS (SELECT id, count(*) AS used, coalesce(min_by(value, sid) FILTER (m < 1e-6),
            sum(value / m / m) FILTER (m >= 1e-6) / sum(1 / m / m) FILTER (m >= 1e-6)) AS estimate FROM k GROUP BY 1)
        SELECT p.id, used, round(estimate, 3) AS estimate FROM p LEFT JOIN e USING (id) WHERE p.id % 3 = 0""",
    "value_variogram": f"""
        WITH {_P}, d AS (SELECT {_HAV.format(a='x.lat', b='x.lon', c='y.lat', d='y.lon')} AS m, x.value - y.value AS v FROM p AS x
            JOIN p AS y ON x.id < y.id AND abs(x.lat - y.lat) < 0.2), l AS (SELECT *, CASE WHEN m < 2000 THEN 0 WHEN m < 5000 THEN 1
            WHEN m < 10000 THEN 2 END AS lag FROM d)
        SELECT lag, count(*) AS pairs, round(avg(m), 2) AS metres, round(avg(v * v) / 2, 1) AS semivariance FROM l WHERE lag IS NOT NULL GROUP BY 1
            HAVING count(*) >= 3""",
    "merged_samples": f"WITH {_P} SELECT floor(lat / 0.25)::BIGINT AS row, floor(lon / 0.25)::BIGINT AS col, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(avg(value), 4) AS value FROM p GROUP BY 1, 2",
    "fold_errors": "WITH e AS (SELECT l_orderkey % 5 AS fold, l_quantity * 1400 - l_extendedprice AS e FROM lineitem) SELECT fold, count(*) AS n, round(sqrt(avg(e * e)), 2) AS rmse, round(avg(abs(e)), 2) AS mae, round(avg(e), 2) AS bias FROM e GROUP BY 1",
    "geodesy": f"""
        WITH {_P}, m AS (SELECT *, {_HAV.format(a='lat', b='lon', c='52.0', d='6.0')} AS m FROM p)
        SELECT id, round(m, 2) AS metres, round({_BEAR.format(a='lat', b='lon', c='52.0', d='6.0')}, 5) AS bearing,
            round(20 * log10(4 * pi() * greatest(m, 1) / (299792458.0 / 446e6)), 5) AS loss_db FROM m""",
    "locators": f"""
        WITH {_P}, a AS (SELECT id, lon + 180 AS x, lat + 90 AS y FROM p), b AS (SELECT *, floor(x / 20)::INT AS a1, floor(y / 10)::INT AS b1 FROM a),
            c AS (SELECT *, x - a1 * 20.0 AS x2, y - b1 * 10.0 AS y2 FROM b),
        d AS (SELECT *, floor(x2 / 2)::INT AS a2, floor(y2 / 1)::INT AS b2 FROM c), e AS (SELECT *, x2 - a2 * 2.0 AS x3, y2 - b2 * 1.0 AS y3 FROM d)
        SELECT id, chr(65 + a1) || chr(65 + b1) || a2 || b2 || chr(97 + floor(x3 / (2.0 / 24))::INT) || chr(97 + floor(y3 / (1.0 / 24))::INT) AS grid
            FROM e""",
    "band_counts": f"SELECT CASE {_BANDS} ELSE '' END AS band, count(*) AS n FROM events GROUP BY 1",
    "rolled_counts": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "dataset_plan": """
        WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS type, CASE o_custkey % 5 WHEN 2 THEN 'test' WHEN 4 THEN 'val' ELSE 'train' END AS role
            FROM orders WHERE o_orderkey % 2 = 1)
        SELECT id, type, role, 'original' AS kind FROM o UNION ALL
        SELECT o_orderkey, o_orderpriority, 'train', 'copy' FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 7 NOT IN (3, 5)
            AND (o_custkey % 11 = 0 OR o_orderkey - 1 IN (SELECT id FROM o WHERE role = 'train'))""",
    "weak_tests": """
        WITH o AS (SELECT o_orderpriority AS type, o_custkey AS grp, CASE o_orderkey % 5 WHEN 2 THEN 'test' WHEN 4 THEN 'val' ELSE 'train' END AS role
            FROM orders)
        SELECT type, count(DISTINCT grp) AS tests, count(DISTINCT CASE WHEN grp NOT IN (SELECT grp FROM o
            WHERE role = 'train') THEN grp END) AS apart, count(DISTINCT CASE WHEN grp NOT IN (SELECT grp FROM o
            WHERE role = 'train') THEN grp END) = 0 AS weak FROM o WHERE role = 'test' GROUP BY 1""",
    "row_problems": """
        SELECT l_orderkey * 10 + l_linenumber AS id, 'quantity must be under 49' AS problem FROM lineitem WHERE NOT l_quantity < 49 UNION ALL
        SELECT l_orderkey * 10 + l_linenumber, 'discount must not exceed tax by 0.09' FROM lineitem WHERE NOT l_discount - l_tax < 0.09""",
    "role_coverage": "SELECT l_returnflag, count(*) AS trials, sum((l_discount > 0.05)::INT)::BIGINT AS hits, round(avg((l_discount > 0.05)::INT), 6) AS share FROM lineitem GROUP BY 1",
    "unusual_orders": "WITH f AS (SELECT o_totalprice AS v FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT v, count(*) OVER (ORDER BY v) AS upto FROM f) SELECT o_orderkey, round(100 * coalesce((SELECT max(upto) FROM r WHERE v <= o_totalprice), 0) / (SELECT count(*) FROM f), 5) AS percentile FROM orders",
    "tiers_of_priorities": f"SELECT {_TIER} AS tier, count(*) AS n, {_TIER} = 'measured' AS record FROM orders GROUP BY ALL",
    "style_divergence": """
        WITH l AS (SELECT lang, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents), c AS (SELECT lang AS g,
            CASE WHEN n <= 50 THEN 0 WHEN n <= 100 THEN 1 WHEN n <= 200 THEN 2 WHEN n <= 400 THEN 3 WHEN n <= 800 THEN 4 ELSE 5 END AS cell,
            count(*) AS n FROM l GROUP BY ALL),
        s AS (SELECT g, cell, n / sum(n) OVER (PARTITION BY g) AS p FROM c), k AS (SELECT a.g AS a, b.g AS b, cell FROM (SELECT DISTINCT g
            FROM s) AS a JOIN (SELECT DISTINCT g FROM s) AS b ON a.g < b.g, (SELECT DISTINCT cell FROM s)),
        j AS (SELECT k.a, k.b, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q FROM k LEFT JOIN s AS x ON x.g = a AND x.cell = k.cell LEFT
            JOIN s AS y ON y.g = b AND y.cell = k.cell)
        SELECT a AS group_a, b AS group_b, round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE
            WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS bits FROM j GROUP BY ALL""",
    "style_delta": f"""
        WITH w AS (SELECT doc_id AS id, lang, unnest({_WORDS.format(t='text')}) AS word FROM documents), n AS (SELECT id, lang, count(*) AS n FROM w
            GROUP BY ALL), c AS (SELECT id, word, count(*) AS c FROM w WHERE word IN ({_STOP}) GROUP BY ALL),
        top AS (SELECT word FROM c GROUP BY 1 ORDER BY sum(c) DESC, word LIMIT 30), r AS (SELECT n.id, lang, top.word, 1000 * coalesce(c,
            0) / n AS rate FROM n CROSS JOIN top LEFT JOIN c ON c.id = n.id AND c.word = top.word),
        z AS (SELECT word, stddev_samp(rate) AS sd FROM r GROUP BY 1), m AS (SELECT lang, word, avg(rate) AS rate FROM r GROUP BY ALL)
        SELECT a.lang AS group_a, b.lang AS group_b, round(avg(abs(a.rate - b.rate) / sd), 5) AS delta FROM m AS a JOIN m AS b ON a.word = b.word
            AND a.lang < b.lang JOIN z ON z.word = a.word WHERE sd > 0 GROUP BY ALL""",
    "document_style": f"""
        WITH b AS (SELECT conv_id * 1000 + turn AS id, coalesce(text, '') AS t, {_WORDS.format(t='text')} AS w FROM conversations), c AS (SELECT *,
            len(w) AS n, greatest(len(regexp_extract_all(t, '[.!?](\\s|$)')), 1) AS s FROM b)
        SELECT id, n::BIGINT AS n_words, s::BIGINT AS sentences, round(CASE WHEN n > 0 THEN 1000 * len(list_filter(w,
            lambda x: list_contains([{_STOP}], x))) / n ELSE 0 END, 5) AS stop_rate, round(n / s, 5) AS sentence_words,
            round((length(t) - length(replace(t, ',', ''))) / s, 5) AS sentence_commas,
            round(CASE WHEN n > 0 THEN list_avg(list_transform(range(1, greatest(n - 49, 1) + 1), lambda i: len(list_distinct(w[i:i+49])) / least(n,
                50))) END, 5) AS richness FROM c""",
    "fingerprint_places": """
        WITH li AS (SELECT * FROM lineitem), k0 AS (SELECT l_suppkey AS place, l_linenumber AS key, avg(-l_quantity - 50) AS level FROM li
            GROUP BY ALL), k AS (SELECT * FROM k0 WHERE key IN (SELECT key FROM k0 GROUP BY 1 HAVING count(*) >= 3)),
        h AS (SELECT l_orderkey AS qid, l_linenumber AS key, (-l_quantity - 50)::DOUBLE AS level FROM li WHERE l_orderkey % 100 = 0),
            m AS (SELECT qid, sum(-2.5 * ln(1 + pow((level + 110) / 6, 2) / 4)) AS missed FROM h GROUP BY 1),
        p AS (SELECT qid, place, count(*) AS shared, sum(-2.5 * ln(1 + pow((h.level - k.level) / 6, 2) / 4)) AS hit,
            sum(-2.5 * ln(1 + pow((h.level + 110) / 6, 2) / 4)) AS ins FROM h JOIN k USING (key) GROUP BY ALL)
        SELECT qid, place, shared, round(missed - ins + hit, 5) + 0.0 AS loglik FROM p JOIN m USING (qid)""",
    "extracted_licence": rf"""
        WITH g AS (SELECT doc_id, text, nullif(regexp_extract(text, '(?m)^(?:Licensed|Released) under (?:the )?([^\n.]+)', 1), '') AS got
            FROM documents),
        w AS (SELECT *, CASE WHEN got IS NULL OR trim(got) = '' THEN 'empty' WHEN lower(trim(got, ' .' || chr(9))) IN ('-', 'n/a', 'na', 'nil',
            'none', 'null', 'unknown') THEN 'null wording'
            WHEN NOT contains(' ' || array_to_string({_WORDS.format(t='text')}, ' ') || ' ', ' ' || array_to_string({_WORDS.format(t='got')},
                ' ') || ' ') THEN 'no support' END AS why FROM g)
        SELECT doc_id, CASE WHEN why IS NULL THEN got END AS value, why IS NULL AS ok, why FROM w""",
    "bearing_cells": f"""
        WITH grid AS (SELECT i AS cell, 50 + (i // 20) * 0.1 AS lat, 5 + (i % 20) * 0.15 AS lon FROM range(400) AS r(i)),
            {_PLACE.format(k="s_suppkey", v="s_acctbal", t="supplier")},
        b AS (SELECT id, lat AS la, lon AS lo, {_BEAR.format(a="lat", b="lon", c="51.03", d="6.02")} AS deg, id % 3 = 2 AS amb FROM p),
        o AS (SELECT cell, amb, {_BEAR.format(a="la", b="lo", c="lat", d="lon")} - deg + 180 AS x FROM grid, b), q AS (SELECT cell, amb,
            abs(x - 360 * floor(x / 360) - 180) AS off FROM o),
        n AS (SELECT cell, CASE WHEN amb THEN (exp(-0.5 * pow(off / 5, 2)) + exp(-0.5 * pow((180 - off) / 5, 2))) / 2 ELSE exp(-0.5 * pow(off / 5,
            2)) END / (5 * 2.5066282746310002) AS one FROM q),
        l AS (SELECT cell, sum(ln(0.95 * one + 0.05 / 360)) AS s FROM n GROUP BY 1), e AS (SELECT cell, exp(s - max(s) OVER ()) AS v FROM l),
            m AS (SELECT cell, round(v / sum(v) OVER (), 9) AS mass FROM e),
        d AS (SELECT mass, sum(mass) AS own FROM m GROUP BY 1), c AS (SELECT mass, own, sum(own) OVER (ORDER BY mass DESC) - own / 2 AS credible
            FROM d)
        SELECT cell, round(m.mass, 6) AS mass, round(credible, 5) AS credible FROM m JOIN c ON c.mass = m.mass""",
}
