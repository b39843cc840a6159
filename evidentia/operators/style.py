"""Style of writing: rates, lengths, richness, and distances between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import STOP, words


def richness(tokens: Column, width: int = 50) -> Column:
    """Mean share of distinct words in windows of so many; of a shorter text, in the whole."""
    n = F.size(tokens)
    starts = F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))
    shares = F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(tokens, i, width))) / F.least(n, F.lit(width)))
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda s, x: s + x) / F.size(starts))


def measures(docs: DataFrame, id_: str, text: str, width: int = 50) -> DataFrame:
    """id, n_words, stop_rate per 1000, sentences, words a sentence, commas a sentence, richness."""
    base = docs.select(F.col(id_).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("w", words(F.col("t")))
    n, s = F.size("w"), F.greatest(F.regexp_count("t", F.lit(r"[.!?](?=\s|$)")), F.lit(1))
    rate = F.when(n > 0, 1000 * F.size(F.filter("w", lambda x: x.isin(*STOP))) / n).otherwise(0.0)
    return base.select(
        "id", n.cast("long").alias("n_words"), rate.alias("stop_rate"), s.cast("long").alias("sentences"), (n / s).alias("sentence_words"),
        (F.regexp_count("t", F.lit(",")) / s).alias("sentence_commas"), richness(F.col("w"), width).alias("richness")
    )


def function_rates(docs: DataFrame, id_: str, text: str, most: int = 30) -> DataFrame:
    """id, word, rate per 1000 of the commonest function words of all texts; absent ones have rate 0."""
    own = docs.select(F.col(id_).alias("id"), F.explode(words(F.col(text))).alias("word"))
    total = own.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    counts = own.filter(F.col("word").isin(*STOP)).groupBy("id", "word").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy("word").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "word").limit(most).select("word")
    cells = total.join(F.broadcast(top))
    return cells.join(counts, ["id", "word"], "left").select("id", "word", (1000 * F.coalesce("c", F.lit(0)) / F.col("n")).alias("rate"))


def delta(rates: DataFrame, groups: DataFrame) -> DataFrame:
    """group_a, group_b, delta: mean difference of z-scored mean rates. groups: id, grp."""
    z = rates.groupBy("word").agg(F.stddev_samp("rate").alias("sd")).filter("sd > 0")
    means = rates.join(groups, "id").groupBy("grp", "word").agg(F.avg("rate").alias("rate")).join(z, "word")
    pair = means.alias("a").join(means.alias("b"), (F.col("a.word") == F.col("b.word")) & (F.col("a.grp") < F.col("b.grp")))
    return pair.groupBy(F.col("a.grp").alias("group_a"), F.col("b.grp").alias("group_b")).agg(
        F.avg(F.abs(F.col("a.rate") - F.col("b.rate")) / F.col("a.sd")).alias("delta")
    )


def length_histogram(lengths: DataFrame, group: str, value: str, edges: tuple[int, ...] = (5, 10, 15, 20, 30, 40)) -> DataFrame:
    """grp, cell, share: lengths in cells up to each edge and beyond the last."""
    cell = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        cell = F.when(F.col(value) <= edges[i], i).otherwise(cell)
    counts = lengths.groupBy(F.col(group).alias("grp"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grp"))).drop("n")


def divergence_bits(shares: DataFrame) -> DataFrame:
    """group_a, group_b, bits: Jensen-Shannon divergence of histograms (grp, cell, share)."""
    names = shares.select("grp").distinct()
    pairs = names.alias("x").join(names.alias("y"), F.col("x.grp") < F.col("y.grp")).select(F.col("x.grp").alias("a"), F.col("y.grp").alias("b"))
    cells = pairs.join(shares.select("cell").distinct())
    left, right = shares.select(
        F.col("grp").alias("a"), "cell", F.col("share").alias("p")
    ), shares.select(F.col("grp").alias("b"), "cell", F.col("share").alias("q"))
    both = cells.join(left, ["a", "cell"], "left").join(right, ["b", "cell"], "left").na.fill(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return both.groupBy(F.col("a").alias("group_a"), F.col("b").alias("group_b")).agg((F.sum(part("p") + part("q")) / 2).alias("bits"))
