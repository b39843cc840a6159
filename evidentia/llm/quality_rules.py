"""Quality rules by robust multivariate outliers, in DataFrame operations only.

Counts are taken inside each row: words, their code points, symbols, repeated lines and the words covered by
repeated windows. Base rules reject a document with few words or much repetition. The others are judged in
groups of one language and source: their transformed counts form a vector, a minimum-covariance-determinant
estimate gives the group's centre and scatter, and a document whose Mahalanobis distance exceeds the chi-squared
quantile is rejected.

The estimate has several starts: the coordinates' medians and median deviations, the mean and covariance of all
rows, and those of three parts of an eighth of the rows, by hash. From each, concentration steps keep the ``share`` of
rows that lie nearest and estimate anew; the start whose covariance has the least determinant wins. ``_FLOOR`` is added
to the variances, as in the regularised form of the estimate.

The same is done for each language and for all rows. A group's estimate is then mixed with its language's, as if
``weight`` rows of that were added, the language's with that of all rows, and that with ``weight`` rows of the wide
scatter ``_WIDE``: a group of one row is judged nearly as its language, one of thousands by itself, and nothing
changes at any number of rows.

Only the counts, a few numbers a row, are written and read again for the steps. Groups are summed before
every shuffle, so a source with a third of all rows costs no more than others; estimates join back by broadcast while
they are measured to be small, and else by salted keys.

Defined cases: a null text has no words and fails the base rules; null languages and sources are groups of
their own; repeated rows are each counted and judged; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.stats import gamma_p
from evidentia.llm._shared import join_small, settle

_SPACE = r"[\x20\x09-\x0D]+"
_FILLED = r"[^\x20\x09-\x0D]"
WINDOW = 8
_DIM = 5
#: Added to each coordinate's variance, so that a coordinate that hardly varies rejects nothing by itself.
#: In a group without any, at the default level, symbols alone reject from a tenth of the characters on, repeated words
#: alone from 0.29 of the words, repeated lines alone from 0.24 of the lines and ``_LINES`` more; together from less.
_FLOOR = (0.04, 0.004, 0.004, 0.0125, 0.01)
#: Lines added to a document's own, so that one repeated line of a short document is no great share.
_LINES = 10
#: Variances of the scatter that stands in for rows that are not there.
_WIDE = (1.0, 0.1, 0.05, 0.05, 0.05)
_PAIRS = [(i, j) for i in range(_DIM) for j in range(i + 1)]
_PARTS = 8


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row."""
    base = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"),
        F.coalesce(docs["text"], F.lit("")).alias("text")
    )
    rows = base.withColumns(
        {"words": F.array_remove(F.split("text", _SPACE), ""), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(_FILLED))}
    )
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    # Hashes of 1, 2, 4 and 8 words in a row: each step joins two neighbouring runs.
    for width in (1, 2, 4):
        rows = rows.withColumn("h", F.zip_with("h", F.slice("h", width + 1, F.greatest(F.size("h"), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    rows = rows.withColumn("h", F.slice("h", 1, F.greatest(F.size("h") - (WINDOW - 1), F.lit(0))))
    rows = rows.withColumn(
        "s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    )
    # In hash order, a window that equals a neighbour occurs twice or more.
    rows = rows.withColumn(
        "at",
        F.array_sort(
            F.transform(F.filter("s", lambda e, i: (e["x"] == F.get("s", i - 1)["x"]) | (e["x"] == F.get("s", i + 1)["x"])), lambda e: e["i"])
        )
    )
    step = F.zip_with(
        "at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))
    )
    covered = F.when(F.col("at").isNull(), F.lit(0)).otherwise(F.aggregate(step, F.lit(0), lambda t, x: t + x))
    return rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", covered.cast("long").alias("n_repeat_words")
    )


def _chi2_cdf(x: float, dim: int) -> float:
    return gamma_p(dim / 2, x / 2)


def chi2_quantile(p: float, dim: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_cdf(middle, dim) < p else (low, middle)
    return high


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(F.col("n_words")), F.log1p(F.col("word_chars") / n), F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + _LINES))
    ]


def _factor(cov: dict[tuple[int, int], Column]) -> dict[str, Column]:
    """The Cholesky factor of a covariance, as columns l00, l10, l11, ... each made of those before it."""
    out: dict[str, Column] = {}
    for i in range(_DIM):
        for j in range(i + 1):
            rest = cov[i, j] - reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
            out[f"l{i}{j}"] = F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}")
    return out


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. under the factor l00.., by forward substitution."""
    solved: list[Column] = []
    for i in range(_DIM):
        left = F.col(f"x{i}") - F.col(f"m{i}") - reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * solved[k] for k in range(i)], F.lit(0.0))
        solved.append(left / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, [s * s for s in solved])


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(_DIM)], *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i, j in _PAIRS]
    )


def _with_factor(sums: DataFrame, scale: float, floor: tuple[float, ...] = _FLOOR) -> DataFrame:
    """Covariances c00.. times ``scale`` and with the floor, and their Cholesky factor l00.., added."""
    cov = {(i, j): F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0)) * scale + (F.lit(floor[i]) if i == j else F.lit(0.0)) for i, j in _PAIRS}
    sums = sums.withColumns({f"c{i}{j}": c for (i, j), c in cov.items()})
    for name, col in _factor({p: F.col("c%d%d" % p) for p in _PAIRS}).items():
        sums = sums.withColumn(name, col)
    return sums


def _starts(rows: DataFrame, size: int) -> DataFrame:
    """g, s, m0.., l00..: first centres and factors of each group."""
    centre = settle(rows.groupBy("g").agg(*[F.percentile_approx(f"x{i}", 0.5, 10_000).alias(f"m{i}") for i in range(_DIM)]), "centre")
    near = _joined(rows, centre, size).groupBy("g").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(_DIM)],
        *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 10_000).alias(f"d{i}") for i in range(_DIM)]
    )
    columns = ["g", "s", *[f"m{i}" for i in range(_DIM)], *[f"l{i}{j}" for i, j in _PAIRS]]
    median = near.select(
        "g", F.lit(0).alias("s"), *[f"m{i}" for i in range(_DIM)],
        *[(F.sqrt((F.col(f"d{i}") * 1.4826) ** 2 + _FLOOR[i]) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _PAIRS]
    )
    part = F.pmod("h", F.lit(_PARTS)).cast("int") + 2
    parted = rows.withColumn("s", F.explode(F.when(part < 5, F.array(F.lit(1), part)).otherwise(F.array(F.lit(1)))))
    return settle(median.select(columns).unionByName(_with_factor(_sums(parted, "g", "s"), 1.0).select(columns)), "starts")


def _joined(rows: DataFrame, table: DataFrame, size: int, key: str = "g", how: str = "inner") -> DataFrame:
    """Rows with the ``table`` of their group, which has so many bytes at most."""
    return join_small(rows, table, key, F.col("h"), size, how)


def estimates(rows: DataFrame, share: float, steps: int) -> DataFrame:
    """g, n, s, m0.., c00..: the minimum-covariance-determinant estimate of each group of ``rows`` (g, h, x0..), as a table."""
    scale = share / _chi2_cdf(chi2_quantile(share, _DIM), _DIM + 2)
    # Five starts a group, each with a name and some 25 numbers.
    size = 5 * 300 * rows.select("g").distinct().count()
    params = _starts(rows, size)
    vectors, numbers = [f"x{i}" for i in range(_DIM)], [*[f"m{i}" for i in range(_DIM)], *[f"l{i}{j}" for i, j in _PAIRS]]
    for _ in range(max(steps, 1)):
        measured = _joined(rows, params.select("g", "s", *numbers), size).withColumn("d", _distance())
        cut = settle(
            measured.groupBy("g", "s").agg(
                F.percentile_approx("d", share, 10_000).alias("cut"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in numbers]
            ),
            "cut"
        )
        held = _joined(rows, cut, size).filter(_distance() <= F.col("cut")).select("g", "s", "n", *vectors)
        params = settle(_with_factor(_sums(held, "g", "s", "n"), scale), "scatter")
    volume = reduce(lambda a, b: a + b, [F.log(f"l{i}{i}") for i in range(_DIM)])
    kept = ["n", "s", *[f"m{i}" for i in range(_DIM)], *[f"c{i}{j}" for i, j in _PAIRS]]
    best = params.groupBy("g").agg(F.min(F.struct(volume.alias("v"), *kept)).alias("b"))
    return settle(best.select("g", *[F.col(f"b.{c}").alias(c) for c in kept]), "estimates")


def _mixed(own: str, more: str, weight: float) -> dict[str, Column]:
    """Centre and covariance of n rows with those of ``own`` and ``weight`` rows with those of ``more``; names begin so."""
    n = F.col(f"{own}n")
    a, b = n / (n + weight), F.lit(weight) / (n + weight)
    gap = [F.col(f"{own}m{i}") - F.col(f"{more}m{i}") for i in range(_DIM)]
    out = {f"{own}m{i}": a * F.col(f"{own}m{i}") + b * F.col(f"{more}m{i}") for i in range(_DIM)}
    return out | {f"{own}c{i}{j}": a * F.col(f"{own}c{i}{j}") + b * F.col(f"{more}c{i}{j}") + a * b * gap[i] * gap[j] for i, j in _PAIRS}


def models(rows: DataFrame, groups: DataFrame, share: float, steps: int, weight: float) -> DataFrame:
    """own, m0.., l00.. of each group (own, wide): its estimate, mixed with its language's and that of all rows."""
    found = estimates(rows, share, steps)
    named = lambda p: found.select(*[F.col(c).alias(p + c) for c in found.columns])
    wide = F.broadcast(named("a_").filter("a_g = 'all'"))
    prior = {f"p_m{i}": F.col(f"a_m{i}") for i in range(_DIM)} | {f"p_c{i}{j}": F.lit(_WIDE[i] if i == j else 0.0) for i, j in _PAIRS}
    joined = groups.join(named("o_"), F.col("own") == F.col("o_g")).join(named("w_"), F.col("wide") == F.col("w_g"))
    joined = joined.withColumn("all", F.lit("all")).join(wide, F.col("all") == F.col("a_g")).withColumns(prior)
    for own, more in (("a_", "p_"), ("w_", "a_"), ("o_", "w_")):
        joined = joined.withColumns(_mixed(own, more, weight))
    out = joined.select("own", *[F.col(f"o_m{i}").alias(f"m{i}") for i in range(_DIM)], *[F.col(f"o_c{i}{j}").alias(f"c{i}{j}") for i, j in _PAIRS])
    return settle(_with_factor(out, 1.0, (0.0,) * _DIM), "models")


def judge(
    docs: DataFrame, share: float = 0.75, level: float = 0.9999, steps: int = 3, weight: float = 30.0, min_words: int = 20,
    max_repeat: tuple[int, int] = (30, 100)
) -> DataFrame:
    """The counts of every document, base_failed and kept."""
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * max_repeat[1] > F.col("n_words") * max_repeat[0])
    every = settle(counts(docs).withColumn("base_failed", failed), "counts")
    # Groups by language and source, by language, and all; null stays apart from any name.
    mark = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c)))
    vectors = {f"x{i}": x for i, x in enumerate(_vector())}
    keyed = every.withColumns(
        {
            "own": F.to_json(F.array(mark("lang"), mark("source"))), "wide": F.to_json(F.array(mark("lang"))),
            "h": F.xxhash64("doc_id", "n_words", "word_chars"), **vectors
        }
    )
    fine = keyed.filter(~F.col("base_failed"))
    rows = settle(fine.select(F.explode(F.array("own", "wide", F.lit("all"))).alias("g"), "h", *vectors), "vectors")
    found = models(rows, fine.select("own", "wide").distinct(), share, steps, weight)
    far = _distance() > chi2_quantile(level, _DIM)
    out = _joined(keyed, found, 300 * found.count(), "own", "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept")
    )
