"""Operators over time-stamped events: dense matrices, interval joins, gaps, islands, rhythms.

Joins in time never compare all pairs: times are cut into buckets as wide as the join reaches, and a bucket
meets itself and its neighbours by an equality join, which Spark shuffles, splits when skewed, or broadcasts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.stats import poisson_tail
from evidentia.functions.times import micros
from evidentia.operators import pairs

#: How many reaches of an answer are one span of time.
SPANS = 16


def activity_matrix(events: DataFrame, rows: str, hour: Column, who: str, value: str, reach: str, open_at: int = 1) -> DataFrame:
    """Every row value by every hour of the day: count, distinct, median, greatest, open or not; none is left out."""
    counted = events.groupBy(F.col(rows).alias("row"), hour.cast("int").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(who).alias("n_who"), F.median(value).alias("median_value"), F.max(reach).alias("max_reach")
    )
    cells = events.select(F.col(rows).alias("row")).distinct().select("row", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    full = cells.join(counted, ["row", "hour"], "left")
    n = F.coalesce("n", F.lit(0))
    return full.select(
        "row", "hour", n.alias("n"), F.coalesce("n_who", F.lit(0)).alias("n_who"), "median_value", "max_reach", (n >= open_at).alias("open")
    )


def _first_answers(calls: DataFrame, hits: DataFrame, parts: list[str], low_us: int, high_us: int) -> DataFrame:
    """Adds ``hit`` (us, id, key) to each call (id, key, us): the first of the hits between low and high later, with another key, or null.

    Both are cut by ``parts``, columns of both, and by time into spans of several reaches; hits in the first reach of a span belong to the
    span before too. A span is walked backwards in time once: each hit knows the next one of another key, so that a call needs no more
    than the hit next to it, and no call meets all hits in its reach.
    """
    reach = max(high_us - low_us, 1)
    span = lambda us: F.floor(us / (SPANS * reach))
    own = F.struct("us", "id", "key")
    a = calls.select("id", "key", "us", *parts, (F.col("us") + low_us).alias("_at"), F.lit(None).cast(hits.select(own.alias("h")).schema["h"].dataType).alias("_hit"))
    b = hits.filter("us IS NOT NULL AND key IS NOT NULL").select(
        F.lit(None).cast(calls.schema["id"].dataType).alias("id"), "key", F.lit(None).cast("long").alias("us"), *parts, F.col("us").alias("_at"), own.alias("_hit")
    )
    a = a.withColumn("_span", span(F.col("_at")))
    b = b.withColumn("_span", F.explode(F.array_distinct(F.array(span(F.col("_at") - reach), span(F.col("_at"))))))
    back = Window.partitionBy(*parts, "_span").orderBy(F.desc("_at"), F.desc(F.col("_hit").isNotNull()), F.desc("_hit.id"))
    rows = a.unionByName(b).withColumn("_next", F.last("_hit", True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    # Where the key changes, the next hit is the first of another key for all hits before it with the same key.
    rows = rows.withColumn("_turn", F.when(F.col("_hit").isNotNull() & (F.col("_next.key") != F.col("key")), F.col("_next")))
    rows = rows.withColumn("_other", F.last("_turn", True).over(back.rowsBetween(Window.unboundedPreceding, 0))).filter("_hit IS NULL")
    found = F.when(F.col("_next.key") != F.col("key"), F.col("_next")).when(F.col("_next.key") == F.col("key"), F.col("_other"))
    rows = rows.withColumn("hit", found)
    return rows.select("id", "key", "us", *parts, F.when(F.col("hit.us") <= F.col("us") + high_us, F.col("hit")).alias("hit"))


def first_within(left: DataFrame, right: DataFrame, key: str, low_us: int, high_us: int, same: bool = False) -> DataFrame:
    """For each row of ``left`` (id, key, us) the first of ``right`` between low and high later, with another key.

    Ids are distinct. Returns id, key, us, hit_id, hit_key, delay_us; rows without a hit have nulls. Ties go to the lesser id.
    """
    a, b = (df.select("id", F.col(key).alias("key"), "us") for df in (left, right.filter(F.col(key).isNotNull())))
    if same:  # cut by the key, where all hits count as of another
        a, b = (df.select("id", F.lit(n).alias("key"), "us", F.col("key").alias("_part")) for n, df in enumerate((a, b)))
    met = _first_answers(a, b, ["_part"] if same else [], low_us, high_us)
    own, other = ("_part", F.when(F.col("hit").isNotNull(), F.col("_part"))) if same else ("key", F.col("hit.key"))
    return met.select(
        "id", F.col(own).alias(key), "us", F.col("hit.id").alias("hit_id"), other.alias("hit_key"), (F.col("hit.us") - F.col("us")).alias("delay_us")
    )


def nearest(left: DataFrame, right: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """For each row of ``left`` (id, keys, us) the row of ``right`` nearest in time within the gap; ties go to the earlier, then the lesser id."""
    a = left.select("id", *keys, "us", F.explode(F.array(*[F.floor(F.col("us") / gap_us) + i for i in (-1, 0, 1)])).alias("bucket"))
    b = right.select(*keys, F.col("id").alias("near_id"), F.col("us").alias("near_us"), F.floor(F.col("us") / gap_us).alias("bucket"))
    found = a.join(b, [*keys, "bucket"]).withColumn("off", F.abs(F.col("near_us") - F.col("us"))).filter(F.col("off") <= gap_us)
    best = found.groupBy("id").agg(F.min(F.struct("off", "near_us", "near_id")).alias("h"))
    return left.join(best, "id", "left").select("id", *keys, "us", F.col("h.near_id").alias("near_id"), F.col("h.off").alias("off_us"))


def call_response(events: DataFrame, kind: str, low_us: int, high_us: int) -> DataFrame:
    """For each ordered pair of kinds: calls, answered calls, those that chance would answer, and its tail.

    events: id (distinct), who, kind, us. An answer is the first event of the other kind by anybody else in time.
    """
    k = F.col(kind)
    span = events.agg((F.max("us") - F.min("us")).alias("span"))
    totals = events.groupBy(k.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    # Each call looks for an answer of every other kind.
    kinds = events.agg(F.collect_set(k).alias("_kinds"))
    calls = events.join(F.broadcast(kinds)).select(
        F.struct("id", k.alias("kind")).alias("id"), F.col("who").alias("key"), "us", F.explode(F.filter("_kinds", lambda x: x != k)).alias("b_kind")
    )
    hits = events.filter(k.isNotNull()).select("id", F.col("who").alias("key"), "us", k.alias("b_kind"))
    met = _first_answers(calls, hits, ["b_kind"], low_us, high_us).filter("hit IS NOT NULL")
    answered = met.groupBy(F.col("id.kind").alias("a_kind"), "b_kind").agg(
        F.count(F.lit(1)).alias("answered"), F.avg(F.col("hit.us") - F.col("us")).alias("delay_us")
    )
    both = answered.join(totals.select(F.col("kind").alias("a_kind"), F.col("n").alias("calls")), "a_kind").join(
        totals.select(F.col("kind").alias("b_kind"), F.col("n").alias("others")), "b_kind"
    ).join(F.broadcast(span))
    chance = F.col("calls") * (1 - F.exp(-F.col("others") * (high_us - low_us) / F.col("span")))
    return both.select(
        "a_kind", "b_kind", "calls", "answered", chance.alias("expected"), poisson_tail(F.col("answered"), chance).alias("p_value"), "delay_us"
    )


def co_occurrence(events: DataFrame, bin_us: int, least: int = 2, alpha: float = math.inf) -> DataFrame:
    """Pairs of ``who`` active in the same time bins: bins together, lift over chance and its Poisson tail, those with one below alpha."""
    return pairs.together(events.select("who", F.floor(F.col("us") / bin_us).alias("bin")).distinct(), least, alpha)


def week_counts(events: DataFrame) -> DataFrame:
    """who, slot (hour of the week, Monday 0), n."""
    slot = F.pmod(F.floor(F.col("us") / 3_600_000_000) + 72, F.lit(168))  # 1970 began on a Thursday
    return events.groupBy("who", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def week_profiles(events: DataFrame) -> DataFrame:
    """who, slot, n of ``week_counts``, share of the unit-length profile."""
    counts = week_counts(events)
    length = counts.groupBy("who").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return counts.join(length, "who").select("who", "slot", "n", (F.col("n") / F.col("length")).alias("share"))


def alike_schedules(events: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs whose week profiles have at least this cosine.

    The product of two profiles is summed in whole numbers, and divided once: no order of sums decides who reaches ``least``.
    """
    return pairs.alike(week_counts(events), least)


def user_graph(events: DataFrame, bin_us: int, together: int, cosine: float) -> DataFrame:
    """``social_graph`` of ``co_occurrence`` by lift and ``alike_schedules`` by cosine, found where two users meet: no edge is written to be joined with another."""
    active = events.select("who", F.floor(F.col("us") / bin_us).alias("bin")).distinct()
    return pairs.together_or_alike(active, week_counts(events), together, cosine, ("together", "schedule"))


def co_movement(fixes: DataFrame, gap_us: int, near_m: float, speed: float, share: float) -> DataFrame:
    """Pairs of ``who`` whose fixes (who, us, lat, lon) stay close: nearest in time within the gap, near enough for the time apart."""
    met = pairs.close_meetings(fixes, gap_us, near_m, speed, 0, share)
    return met.filter("known > 0").select("who_a", "who_b", "met", (F.col("close") / F.col("known")).alias("close_share")).filter(F.col("close_share") >= share)


def co_movement_tested(
    fixes: DataFrame, gap_us: int, near_m: float, speed: float, least: int = 3, share: float = 0.8, alpha: float = 0.001, shifts: int = 8
) -> DataFrame:
    """Pairs of ``who`` that stay close more often than their tracks do by chance: met, close, expected, lift, p_value.

    Chance is what the same tracks give when one of them is turned in time: its fixes move by ``shifts`` equal parts of the span,
    round the end, of pairs that stay close. p_value: the Poisson tail of as many close meetings.
    """
    met = pairs.close_meetings(fixes, gap_us, near_m, speed, least, 0.0, share, shifts)
    kept = met.filter((F.col("close") >= least) & (F.col("close") >= share * F.col("met")))
    rate = (F.col("close_by_chance") + 0.5) / (F.col("met_by_chance") + 1)  # never zero
    tested = kept.withColumn("expected", F.col("met") * rate).withColumn("p_value", poisson_tail(F.col("close"), F.col("expected")))
    return tested.filter(F.col("p_value") < alpha).select("who_a", "who_b", "met", "close", "expected", (F.col("close") / F.col("expected")).alias("lift"), "p_value")


def answered_pairs(events: DataFrame, low_us: int, high_us: int, least: int = 3, alpha: float = 0.001) -> DataFrame:
    """Directed edges who_a, who_b: calls of the one that the other answers in time more often than its rate gives, with expected, lift and p_value.

    events: who, us. A pair's calls count once each.
    """
    return pairs.answers(events, low_us, high_us, least, alpha)


def social_links(**kinds: tuple[DataFrame, bool, str]) -> DataFrame:
    """who_a, who_b, kind, directed, count, lift, p_value, weight of edges by kind, each kept apart with its own chance.

    kinds: name to edges (who_a, who_b, lift, p_value and a count of the given name) and whether they are directed; of undirected ones the
    lesser end is first. weight: log1p(count) times the lift, 50 at most.
    """
    rows = None
    for kind, (edges, directed, count) in kinds.items():
        ends = ("who_a", "who_b") if directed else (F.least("who_a", "who_b"), F.greatest("who_a", "who_b"))
        a, b = (F.col(e) if isinstance(e, str) else e for e in ends)
        own = edges.select(
            a.alias("who_a"), b.alias("who_b"), F.lit(kind).alias("kind"), F.lit(directed).alias("directed"), F.col(count).cast("long").alias("count"),
            F.col("lift").cast("double").alias("lift"), F.col("p_value").cast("double").alias("p_value")
        )
        rows = own if rows is None else rows.unionByName(own)
    return rows.filter("who_a <> who_b").withColumn("weight", F.log1p("count") * F.least("lift", F.lit(50.0)))


def rhythm(events: DataFrame, period_us: int) -> DataFrame:
    """Per ``who``: how many, the circular resultant at a period, and the chance of one as long."""
    angle = 2 * math.pi * F.pmod(F.col("us"), F.lit(period_us)) / period_us
    r = F.sqrt(F.avg(F.cos(angle)) ** 2 + F.avg(F.sin(angle)) ** 2)
    base = events.groupBy("who").agg(F.count(F.lit(1)).alias("n"), r.alias("resultant"))
    z, n = F.col("n") * F.col("resultant") ** 2, F.col("n")
    p = F.exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z**2 + 76 * z**3 - 9 * z**4) / (288 * n * n))
    return base.select("who", "n", "resultant", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias("p_value"))


def intervals(events: DataFrame) -> DataFrame:
    """id, who, us and the microseconds to the next event of the same ``who``."""
    w = Window.partitionBy("who").orderBy("us", "id")
    return events.withColumn("wait_us", F.lead("us").over(w) - F.col("us"))


def gaps(events: DataFrame, factor: float = 3.0) -> DataFrame:
    """Waits longer than ``factor`` times the median wait of their ``who``."""
    waits = intervals(events).filter("wait_us is not null")
    middle = waits.groupBy("who").agg(F.median("wait_us").alias("median_us"))
    return waits.join(middle, "who").filter(F.col("wait_us") > factor * F.col("median_us")).select("id", "who", "us", "wait_us", "median_us")


def pace(events: DataFrame) -> DataFrame:
    """Per ``who``: median wait, scaled median deviation, and the kind of rhythm."""
    waits = intervals(events).filter("wait_us > 0")
    middle = waits.groupBy("who").agg(F.median("wait_us").alias("median_us"), F.count(F.lit(1)).alias("n"))
    spread = waits.join(middle, "who").groupBy("who").agg(
        F.first("median_us").alias("median_us"), F.first("n").alias("n"),
        (1.4826 * F.median(F.abs(F.col("wait_us") - F.col("median_us")))).alias("mad_us")
    )
    ratio = F.col("mad_us") / F.col("median_us")
    return spread.select(
        "who", "n", "median_us", "mad_us",
        F.when(F.col("n") < 3, "few").when(ratio < 0.02, "constant").when(ratio < 0.2, "jittered").otherwise("irregular").alias("kind")
    )


def islands(rows: DataFrame, keys: list[str], order: list[str], flag: Column) -> DataFrame:
    """Runs of rows with the flag: first and last of the order's first column, and how many."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_on", F.coalesce(flag, F.lit(False)).cast("int"))
    marked = marked.withColumn("_new", F.when((F.col("_on") == 1) & (F.coalesce(F.lag("_on").over(w), F.lit(0)) == 0), 1).otherwise(0))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_on = 1")
    return marked.groupBy(*keys, "run").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n"))


def unchanged_runs(rows: DataFrame, keys: list[str], order: list[str], value: str, least: int) -> DataFrame:
    """Runs of at least so many equal values in a row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = rows.withColumn("_new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run").agg(
        F.first(value).alias("value"), F.min(order[0]).alias("first"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") >= least).drop("run")


def stuck_threshold(repeat_share: float, n: int, alpha: float = 0.01) -> int:
    """The run of equal samples that chance makes with probability alpha in n samples."""
    if repeat_share <= 0:
        return 2
    return max(2, math.ceil(1 + math.log(alpha / max(n, 1)) / math.log(min(repeat_share, 1 - 1e-12))))


def busy_spans(events: DataFrame, length: Column) -> DataFrame:
    """Union of the intervals [us, us + length) of each ``who``: bursts, time on the air, share of it, period."""
    w = Window.partitionBy("who").orderBy("us", "id")
    spans = events.withColumn("end", F.col("us") + length)
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.when(reach.isNull() | (F.col("us") > reach), 1).otherwise(0))
    spans = spans.withColumn("burst", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bursts = spans.groupBy("who", "burst").agg(F.min("us").alias("us"), F.max("end").alias("end"))
    bursts = bursts.withColumn("wait", F.lead("us").over(Window.partitionBy("who").orderBy("us")) - F.col("us"))
    return bursts.groupBy("who").agg(
        F.count(F.lit(1)).alias("bursts"), F.sum(F.col("end") - F.col("us")).alias("busy_us"),
        (F.sum(F.col("end") - F.col("us")) / (F.max("end") - F.min("us"))).alias("duty"), F.median("wait").alias("period_us")
    )


def drift(events: DataFrame, value: str) -> DataFrame:
    """Per ``who``: least-squares slope of a value over hours."""
    hours = F.col("us") / 3.6e9
    return events.groupBy("who").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.col(value), hours).alias("slope"))


def sessions(events: DataFrame, gap_us: int) -> DataFrame:
    """Sessions of each ``who``: a wait of at least the gap begins a new one."""
    w = Window.partitionBy("who").orderBy("us", "id")
    new = F.coalesce((F.col("us") - F.lag("us").over(w) >= gap_us).cast("int"), F.lit(1))
    numbered = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("who", "session").agg(F.min("us").alias("begin_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"))


def lag_histogram(events: DataFrame, key: str, lags: int, per_decade: int = 10) -> DataFrame:
    """Differences to the next 1 to ``lags`` events of the key, counted on a geometric grid of seconds."""
    w = Window.partitionBy(key).orderBy("us", "id")
    lagged = events.select(key, *[(F.lead("us", c).over(w) - F.col("us")).alias(f"d{c}") for c in range(1, lags + 1)])
    long = lagged.select(
        key, F.explode(F.array(*[F.struct(F.lit(c).alias("lag"), F.col(f"d{c}").alias("us")) for c in range(1, lags + 1)])).alias("x")
    ).filter("x.us > 0")
    return long.groupBy(
        key, F.col("x.lag").alias("lag"), F.floor(per_decade * F.log10(F.col("x.us") / 1e6)).cast("int").alias("cell")
    ).agg(F.count(F.lit(1)).alias("n"))


def pri_spectrum(events: DataFrame, key: str, lags: int, periods_us: list[int]) -> DataFrame:
    """For each trial period, the length of the sum of phases of differences near it: true periods stand out, multiples don't."""
    w = Window.partitionBy(key).orderBy("us", "id")
    lagged = events.select(key, "us", *[(F.lead("us", c).over(w) - F.col("us")).alias(f"d{c}") for c in range(1, lags + 1)])
    long = lagged.select(key, "us", F.explode(F.array(*[F.col(f"d{c}") for c in range(1, lags + 1)])).alias("d")).filter("d > 0")
    trial = long.withColumn(
        "period_us", F.explode(F.array(*[F.lit(p).cast("long") for p in periods_us]))
    ).filter(F.abs(F.col("d") - F.col("period_us")) <= 0.2 * F.col("period_us"))
    angle = 2 * math.pi * F.col("us") / F.col("d")
    return trial.groupBy(key, "period_us").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(F.cos(angle)) ** 2 + F.sum(F.sin(angle)) ** 2).alias("strength")
    )


def decayed(events: DataFrame, now_us: int, half_life_us: int) -> DataFrame:
    """Per ``who``: events, each halved in weight for every half-life since."""
    return events.groupBy("who").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.pow(F.lit(0.5), (F.lit(now_us) - F.col("us")) / half_life_us)).alias("weight")
    )


def unwrap_clock(rows: DataFrame, keys: list[str], order: str, clock: str, bits: int = 32) -> DataFrame:
    """Adds ``unwrapped``: a counter of so many bits made to run on where it starts over."""
    w = Window.partitionBy(*keys).orderBy(order)
    wrapped = F.when(F.col(clock) < F.lag(clock).over(w) - 2 ** (bits - 1), 1).otherwise(0)
    marked = rows.withColumn("_wrap", wrapped)
    return marked.withColumn("unwrapped", F.col(clock) + F.sum("_wrap").over(w.rowsBetween(Window.unboundedPreceding, 0)) * 2**bits).drop("_wrap")


def resample(rows: DataFrame, key: str, value: str, step_us: int, max_gap_us: int) -> DataFrame:
    """Linear interpolation of (key, us, value) on a grid; grid points inside longer gaps are null."""
    w = Window.partitionBy(key).orderBy("us")
    steps = rows.groupBy(key, "us").agg(F.avg(value).alias(value)).withColumns({"to_us": F.lead("us").over(w), "to": F.lead(value).over(w)})
    first = F.ceil(F.col("us") / step_us)
    last = F.when(F.col("to_us").isNull(), F.floor(F.col("us") / step_us)).otherwise(F.ceil(F.col("to_us") / step_us) - 1)
    grid = steps.filter(last >= first).withColumn("at", F.explode(F.sequence(first, last)))
    at = F.col("at") * step_us
    inside = F.when(F.col("to_us").isNull() | (at == F.col("us")), F.col(value)).when(
        F.col("to_us") - F.col("us") <= max_gap_us, F.col(value) + (F.col("to") - F.col(value)) * (at - F.col("us")) / (F.col("to_us") - F.col("us"))
    )
    return grid.select(key, at.alias("us"), inside.alias(value))


def presence(rows: DataFrame, value: str, window: str, slide: str, quantile: float = 0.9, factor: float = 1.5) -> DataFrame:
    """Half-overlapping windows of a signal (ts, value): spread, and whether it exceeds a multiple of its quantile."""
    moved = rows.groupBy(F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(value).alias("motion"))
    cut = moved.agg((factor * F.expr(f"percentile(motion, {quantile})")).alias("cut"))
    return moved.join(F.broadcast(cut)).select(F.col("window.start").alias("begin"), "n", "motion", (F.col("motion") > F.col("cut")).alias("present"))


def as_sightings(events: DataFrame, id_: str, who: str, ts: str, *more: str) -> DataFrame:
    """The columns by which these operators know events: id, who, us."""
    return events.select(F.col(id_).alias("id"), F.col(who).alias("who"), micros(ts).alias("us"), *more)


def difference_peaks(histogram: DataFrame, events: DataFrame, key: str, share: float = 0.5, decay: float = 0.5) -> DataFrame:
    """Cells of a lag histogram that exceed what chance gives: ``share`` of the key's events less the lag, falling with the cell.

    histogram: key, lag, cell, n, as ``lag_histogram`` has it; cells of a key count from its first.
    """
    total = events.groupBy(key).agg(F.count(F.lit(1)).alias("events"))
    span = histogram.groupBy(key).agg(F.min("cell").alias("first"), (F.max("cell") - F.min("cell") + 1).alias("cells"))
    limit = share * (F.col("events") - F.col("lag")) * F.exp(-(F.col("cell") - F.col("first")) / (decay * F.col("cells")))
    return histogram.join(total, key).join(span, key).withColumn("bound", limit).filter(F.col("n") > F.col("bound")).select(key, "lag", "cell", "n", "bound")


def social_graph(*edges: tuple[str, DataFrame, str]) -> DataFrame:
    """who_a, who_b, kinds, weight: all edges (kind, pairs, weight column) of two, the lesser first, with their kinds and summed weights."""
    rows = None
    for kind, pairs, weight in edges:
        own = pairs.select(
            F.least("who_a", "who_b").alias("who_a"), F.greatest("who_a", "who_b").alias("who_b"), F.lit(kind).alias("kind"),
            F.col(weight).cast("double").alias("weight")
        )
        rows = own if rows is None else rows.unionByName(own)
    found = rows.filter("who_a <> who_b").groupBy("who_a", "who_b").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kinds"), F.sum("weight").alias("weight")
    )
    return found
