"""Scores of predictions: counts, ranks, calibration, curves. All are sums or windows over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.running import running

#: Keys of rank correlation below so many bits are plain numbers.
LONG_BITS = 62


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Per class that occurs in the truth: precision, recall, F1."""
    m = confusion(rows, truth, guess)
    hit = F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0))
    real = m.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), hit.alias("hits"))
    said = m.groupBy(F.col("guess").alias("class")).agg(F.sum("n").alias("said"))
    both = real.join(said, "class", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    return both.select(
        "class", "support", F.when(F.col("said") > 0, F.col("hits") / F.col("said")).otherwise(0.0).alias("precision"),
        (F.col("hits") / F.col("support")).alias("recall"), (2 * F.col("hits") / (F.col("support") + F.col("said"))).alias("f1")
    )


def summary_scores(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: rows, accuracy, macro F1 over the classes of the truth."""
    right = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))
    return right.join(F.broadcast(class_scores(rows, truth, guess).agg(F.avg("f1").alias("macro_f1"))))


def score_by_bin(rows: DataFrame, right: Column, by: str, width: float) -> DataFrame:
    """Mean correctness per bin of another value; null has a bin of its own."""
    return rows.groupBy((F.floor(F.col(by) / width) * width).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(right.cast("double")).alias("score")
    )


def reliability(rows: DataFrame, confidence: str, right: Column, bins: int = 15) -> DataFrame:
    """Equal bins of confidence, the first closed at 0, others open below."""
    cell = F.least(F.greatest(F.ceil(F.col(confidence) * bins), F.lit(1)), F.lit(bins)).cast("int")
    return rows.groupBy(cell.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(right.cast("double")).alias("accuracy")
    )


def calibration_error(rows: DataFrame, confidence: str, right: Column, bins: int = 15) -> DataFrame:
    r = reliability(rows, confidence, right, bins)
    return r.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def _cumulative(rows: DataFrame, score: str, label: str) -> DataFrame:
    """By distinct score: labels 1 and 0 at it, and at or above it."""
    at = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) != 1).cast("long")).alias("neg")
    )
    return running(at, "score", {"tp": ("sum", "pos"), "fp": ("sum", "neg")}, desc=True)


def average_precision(rows: DataFrame, score: str, label: str) -> DataFrame:
    """All-point interpolated average precision: the greatest precision at any lower score, weighted by recall gained."""
    c = _cumulative(rows, score, label).withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
    best = running(c, "score", {"best": ("max", "precision")})
    return best.agg(F.sum("pos").alias("positives"), F.coalesce(F.sum(F.col("pos") * F.col("best")) / F.sum("pos"), F.lit(0.0)).alias("ap"))


def best_threshold(rows: DataFrame, score: str, label: str) -> DataFrame:
    """The score with the best F1 when all at or above it are said to be 1; ties go to the higher."""
    c = _cumulative(rows, score, label)
    total = c.agg(F.sum("pos").alias("all"))
    f1 = 2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("all"))
    scored = c.join(F.broadcast(total)).withColumn("f1", f1)
    return scored.agg(F.max(F.struct("f1", "score", "tp", "fp", "all")).alias("b")).select(
        F.col("b.score").alias("threshold"), F.col("b.f1").alias("f1"), (F.col("b.tp") / (F.col("b.tp") + F.col("b.fp"))).alias("precision"),
        (F.col("b.tp") / F.col("b.all")).alias("recall")
    )


def operating_point(rows: DataFrame, score: str, label: str, false_rate: float) -> DataFrame:
    """The lowest score whose share of false alarms stays within the rate, and what it detects."""
    c = _cumulative(rows, score, label)
    total = c.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    inside = c.join(F.broadcast(total)).filter(F.col("fp") <= false_rate * F.col("n"))
    return inside.agg(F.min(F.struct("score", "tp", "fp", "p", "n")).alias("b")).select(
        F.col("b.score").alias("threshold"), (F.col("b.tp") / F.col("b.p")).alias("detected"), (F.col("b.fp") / F.col("b.n")).alias("false_rate")
    )


def average_rank(rows: DataFrame, value: str, name: str, tiebreak: str | None = None) -> DataFrame:
    """Adds the rank of a value, ties sharing their mean rank. Ranks come from counts of distinct values."""
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, "_v", {"_upto": ("sum", "_n")}).withColumn("_r", F.col("_upto") - (F.col("_n") - 1) / 2)
    return rows.join(ranked.select("_v", F.col("_r").alias(name)), rows[value] == ranked["_v"]).drop("_v")


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    clean = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    ranked = average_rank(average_rank(clean, "a", "ra"), "b", "rb")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("spearman"))


def kendall_tau_b(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Tie-corrected tau. Pairs of rows are never formed: they are counted by running totals, one bit of b's rank at a time.

    Two different ranks of b part at one bit. Among rows whose ranks agree in all higher bits, those with the bit
    meet those without it, and a running total over a tells how many of these stand lower or higher there.
    """
    cells = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
        F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")
    ).agg(F.count(F.lit(1)).alias("n"))
    ranks = {}
    for name in ("a", "b"):
        at = cells.groupBy(name).agg(F.sum("n").alias("n"))
        ranks[name] = running(at.withColumn("one", F.lit(1)), name, {"rank": ("sum", "one")}).select(name, (F.col("rank") - 1).alias(f"r{name}"))
    sizes = ranks["a"].agg(F.max("ra")).first()[0], ranks["b"].agg(F.max("rb")).first()[0]
    width = (sizes[0] or 0) + 1
    ranked = cells.join(ranks["a"], "a").join(ranks["b"], "b")
    bits = max((sizes[1] or 0).bit_length(), 1)
    level = ranked.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    # One number for bit, higher bits and rank of a: groups stand one after the other.
    group = F.col("bit").cast("long") * (1 << bits) + F.expr("shiftright(rb, cast(bit + 1 as int))")
    if bits * width << bits >= 1 << LONG_BITS:
        group, width = group.cast("decimal(19,0)"), F.lit(width).cast("decimal(18,0)")
    one = F.expr("shiftright(rb, cast(bit as int)) & 1")
    parted = level.select(
        (group * width + F.col("ra")).alias("at"), group.cast("long").alias("grp"), F.when(one == 1, F.col("n")).otherwise(0).alias("with"),
        F.when(one == 0, F.col("n")).otherwise(0).alias("without")
    )
    summed = parted.groupBy("at", "grp").agg(F.sum("with").alias("with"), F.sum("without").alias("without"))
    run = running(summed, "at", {"w": ("sum", "with"), "o": ("sum", "without")})
    # Rows without the bit and of lower a agree in order with one that has it; rows with the bit and of lower a disagree with one without.
    wide = "decimal(38,0)"
    terms = run.select("grp", *[F.col(c).cast(wide).alias(c) for c in ("with", "without", "w", "o")])
    per = terms.groupBy("grp").agg(
        F.sum(F.col("with") * (F.col("o") - F.col("without"))).alias("agree"), F.sum(F.col("without") * (F.col("w") - F.col("with"))).alias("differ"),
        F.sum("with").alias("with"), F.sum("without").alias("without"), F.min(F.col("o") - F.col("without")).alias("o"), F.min(F.col("w") - F.col("with")).alias("w"),
    )
    s = per.agg(
        F.coalesce(
            F.sum(F.col("agree") - F.col("with") * F.col("o") - F.col("differ") + F.col("without") * F.col("w")), F.lit(0)
        ).cast("double").alias("s")
    )
    pairs = lambda d: F.sum(d * (d - 1) / 2)
    total = cells.agg(F.sum("n").alias("n"))
    ta = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("ta"))
    tb = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("tb"))
    every = F.col("n") * (F.col("n") - 1) / 2
    return s.join(F.broadcast(total)).join(F.broadcast(ta)).join(F.broadcast(tb)).select(
        "n", (F.col("s") / F.sqrt((every - F.col("ta")) * (every - F.col("tb")))).alias("tau_b")
    )


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve, ties counting half, from rank sums of distinct scores."""
    c = _cumulative(rows, score, label)
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return c.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), (wins / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def disc_quantile(rows: DataFrame, value: str, q: float) -> DataFrame:
    """The least value with at least the share q at or below it: no interpolation."""
    at = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    up = running(at, "v", {"upto": ("sum", "n")})
    total = at.agg(F.sum("n").alias("all"))
    return up.join(F.broadcast(total)).filter(F.col("upto") >= q * F.col("all")).agg(F.min("v").alias("threshold"), F.max("all").alias("n"))


def latency(rows: DataFrame, ms: str, *keys: str) -> DataFrame:
    """Samples, mean, median, 95th percentile and greatest of a latency."""
    return rows.groupBy(*keys).agg(
        F.count(ms).alias("n"), F.avg(ms).alias("mean"), F.percentile(ms, 0.5).alias("p50"), F.percentile(ms, 0.95).alias("p95"),
        F.max(ms).alias("most")
    )


def domain_gap(rows: DataFrame, domain: str, a: str, b: str, truth: str, guess: str) -> DataFrame:
    """One row: rows and accuracy in two domains, and how much the second loses."""
    right = (F.col(truth) == F.col(guess)).cast("double")
    of = lambda d: F.avg(F.when(F.col(domain) == d, right))
    n = lambda d: F.sum((F.col(domain) == d).cast("long"))
    return rows.agg(n(a).alias("n_a"), n(b).alias("n_b"), of(a).alias("accuracy_a"), of(b).alias("accuracy_b"), (of(a) - of(b)).alias("gap"))


def detection_ap(claims: DataFrame, truths: DataFrame) -> DataFrame:
    """cls, truths, ap: all-point interpolated average precision of each class of ``truths`` (id, cls).

    claims: predictions (id, cls, score, matched), as ``matching.first_claim`` decides which of them have a truth.
    """
    at = claims.groupBy("cls", "score").agg(F.sum(F.col("matched").cast("long")).alias("hit"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("cls").orderBy(F.desc("score"))
    upto = at.withColumns({"tp": F.sum("hit").over(down), "all": F.sum("n").over(down)}).withColumn("precision", F.col("tp") / F.col("all"))
    best = upto.withColumn("best", F.max("precision").over(Window.partitionBy("cls").orderBy("score")))
    gained = best.groupBy("cls").agg(F.sum(F.col("hit") * F.col("best")).alias("area"))
    total = truths.groupBy("cls").agg(F.count(F.lit(1)).alias("truths"))
    return total.join(gained, "cls", "left").select("cls", "truths", (F.coalesce("area", F.lit(0.0)) / F.col("truths")).alias("ap"))


def detection_map(aps: DataFrame) -> DataFrame:
    """One row: classes and the mean of their average precision, over all rows (class by overlap threshold)."""
    return aps.agg(F.countDistinct("cls").alias("classes"), F.avg("ap").alias("map"))


def linear_fit(rows: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Slope, intercept and error of a least-squares line, the error in dB of the power of ``y``."""
    own = rows.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x is not null and _y is not null")
    fit = own.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_syy("_y", "_x").alias("_syy"), F.regr_sxy("_y", "_x").alias("_sxy"), F.sum(F.col("_y") ** 2).alias("_p")
    )
    error = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    return fit.select(
        *keys, "n", "slope", "intercept", F.when(F.col("_p") > 0, 10 * F.log10(F.greatest(error / F.col("_p"), F.lit(1e-20)))).alias("nmse_db")
    )


def detection_by_level(truths: DataFrame, level: str, found: Column, width: float) -> DataFrame:
    """bin, n, detected: the share found in bins of a level such as the signal-to-noise ratio."""
    return truths.groupBy((F.floor(F.col(level) / width) * width).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(found.cast("double")).alias("detected")
    )


def level_at(curve: DataFrame, wanted: float) -> DataFrame:
    """One row: the level at which a curve (bin, detected) first reaches the wanted share, between bins; null if it never does."""
    w = Window.orderBy("bin")  # a curve has one row a bin
    steps = curve.withColumns({"_b": F.lag("bin").over(w), "_d": F.lag("detected").over(w)}).filter(F.col("detected") >= wanted)
    between = F.when(
        F.col("_d") < wanted, F.col("_b") + (F.col("bin") - F.col("_b")) * (wanted - F.col("_d")) / (F.col("detected") - F.col("_d"))
    ).otherwise(F.col("bin"))
    return steps.agg(F.min_by(between, F.col("bin")).alias("level"))


def false_alarm_rate(rows: DataFrame, false: Column, seconds: float, *keys: str) -> DataFrame:
    """False detections, and how many an hour over the time covered."""
    return rows.groupBy(*keys).agg(F.sum(false.cast("long")).alias("false_marks"), (F.sum(false.cast("long")) * 3600 / seconds).alias("an_hour"))
