"""Record keeping: newest entries, differences of tables, plans of training sets, labels, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.running import running


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; one pass of partial maxima, no sort of a key's rows."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in rest]).select(*rows.columns)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table and not of the other, copies counted, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def replace_source(labels: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """Labels without those of one source, and the new ones."""
    return labels.filter(~F.col("source").eqNullSafe(F.lit(source))).unionByName(new)


def rolled_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts by all keys, by fewer from the left, and over all."""
    return rows.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def role(index: Column) -> Column:
    """A fixed share by index: of five, one tests, one validates."""
    left = F.pmod(index, F.lit(5))
    return F.when(left == 2, "test").when(left == 4, "val").otherwise("train")


def dataset_plan(originals: DataFrame, copies: DataFrame, stale: DataFrame) -> DataFrame:
    """Which examples train, validate and test.

    originals: id, type, grp, role. copies: id, type, parent, generator, fresh. Copies only train, if
    their parent trains or they are fresh, and their generator is not stale (stale: generator).
    """
    parents = originals.filter("role = 'train'").select(F.col("id").alias("parent"))
    live = copies.join(stale, "generator", "left_anti")
    joined = live.filter("not fresh").join(parents, "parent", "left_semi").unionByName(live.filter("fresh"))
    return originals.select("id", "type", "role", F.lit("original").alias("kind")).unionByName(
        joined.select("id", "type", F.lit("train").alias("role"), F.lit("copy").alias("kind"))
    )


def weak_tests(originals: DataFrame) -> DataFrame:
    """Per type: test recordings, and those whose group feeds no training example; none of these is a weak test."""
    train = originals.filter("role = 'train'").select("grp").distinct()
    test = originals.filter("role = 'test'")
    apart = test.join(train, "grp", "left_anti").groupBy("type").agg(F.countDistinct("grp").alias("apart"))
    every = test.groupBy("type").agg(F.countDistinct("grp").alias("tests"))
    return every.join(apart, "type", "left").select(
        "type", "tests", F.coalesce("apart", F.lit(0)).alias("apart"), (F.coalesce("apart", F.lit(0)) == 0).alias("weak")
    )


def problems(rows: DataFrame, id_: str, rules: dict[str, Column]) -> DataFrame:
    """id, problem: a row for each rule that a row breaks; null counts as broken."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in rules.items()]))
    return rows.select(F.col(id_).alias("id"), F.explode(found).alias("problem"))


def judged(
    value: Column, source: Column, choices: list[str] | None = None, confidence: Column | None = None, least: float = 0.5, source_spaced: Column | None = None
) -> Column:
    """{value, ok, why} of an extracted value: it is kept only if it says something the source supports (``source_spaced``: see ``text.found_in``)."""
    from evidentia.functions.text import REDACTED, found_in, is_null_wording

    why = F.when(value.rlike("(?i)" + REDACTED), "redacted").when(
        value.isNull() | (F.btrim(value) == ""), "empty"
    ).when(is_null_wording(value), "null wording")
    if confidence is not None:
        why = why.when(confidence < least, "low confidence")
    if choices:
        why = why.when(~F.lower(value).isin(*[c.lower() for c in choices]), "not a choice")
    why = why.when(~found_in(value, source, source_spaced), "no support")
    return F.struct(F.when(why.isNull(), value).alias("value"), why.isNull().alias("ok"), why.alias("why"))


def coverage(rows: DataFrame, hit: Column, *keys: str) -> DataFrame:
    """Trials, hits and their share."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("trials"), F.sum(hit.cast("long")).alias("hits"), F.avg(hit.cast("double")).alias("share"))


def unusual(rows: DataFrame, value: str, baseline: DataFrame, baseline_value: str) -> DataFrame:
    """Adds the share of the baseline at or under each value; no row is dropped."""
    at = baseline.groupBy(F.col(baseline_value).alias("v")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        rows.select(F.col(value).alias("v"), F.lit(0).cast("long").alias("n")).distinct()
    )
    run = running(at.groupBy("v").agg(F.sum("n").alias("n")), "v", {"upto": ("sum", "n")})
    total = baseline.agg(F.count(F.lit(1)).alias("_all"))
    return rows.join(
        run.select("v", "upto"), rows[value] == run["v"], "left"
    ).join(F.broadcast(total)).withColumn("percentile", 100 * F.col("upto") / F.col("_all")).drop("v", "upto", "_all")


def annotations(captures: DataFrame, id_: str, labels: str) -> DataFrame:
    """One row a label of an array column of structs, with its place in the array."""
    return captures.select(F.col(id_).alias("id"), F.posexplode(labels).alias("place", "_x")).select("id", "place", "_x.*")


def stale_originals(trained: DataFrame, originals: DataFrame) -> DataFrame:
    """Ids a model was trained on (id) that train no more (originals: id, role)."""
    return trained.join(originals.filter("role = 'train'").select("id"), "id", "left_anti")


def agreement(confirmed: DataFrame, *keys: str) -> DataFrame:
    """Boxes, those that a decoder confirmed, those it called otherwise, and the share that agrees (from ``matching.confirmed``)."""
    known, off = F.col("decoder").isNotNull(), F.coalesce(F.col("disagrees"), F.lit(False))
    sums = confirmed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("boxes"), F.sum(known.cast("long")).alias("confirmed"), F.sum((known & off).cast("long")).alias("disagreements")
    )
    return sums.withColumn("agreement", F.when(F.col("confirmed") > 0, 1 - F.col("disagreements") / F.col("confirmed")))


def canvas(docs: DataFrame, id_: str, text: str, fields: dict[str, str]) -> DataFrame:
    """id, field, value, ok, why: each field by the first group of its pattern, judged against the text it comes from."""
    from evidentia.functions.text import spaced

    # Words and values are columns of their own, so that a text is read once for each, not once for each place that names them.
    source = docs.select(F.col(id_).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = source.select("*", spaced(F.col("_text")).alias("_spaced"), *[F.regexp_extract("_text", p, 1).alias(f"_f{i}") for i, p in enumerate(fields.values())])
    parts = []
    for i, name in enumerate(fields):
        got = F.col(f"_f{i}")
        parts.append(F.struct(F.lit(name).alias("field"), judged(F.when(got != "", got), F.col("_text"), source_spaced=F.col("_spaced")).alias("j")))
    return found.select("id", F.explode(F.array(*parts)).alias("x")).select("id", "x.field", "x.j.value", "x.j.ok", "x.j.why")


def complete(fields: DataFrame) -> DataFrame:
    """id, found, missing: how many fields of a canvas hold, and the names of the others."""
    lost = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("field")))), ",")
    return fields.groupBy("id").agg(F.sum(F.col("ok").cast("long")).alias("found"), lost.alias("missing"))
