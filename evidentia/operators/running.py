"""Running totals over a whole table without one task that sorts it all.

The order's values are cut at approximate quantiles into buckets of about ``ROWS`` rows, ``PARTS`` at least and ``MOST`` at most.
Totals of the buckets, that many rows, give each bucket what stands before it; inside a bucket a window does the rest. The cuts are
numbers fixed when the operator is made, so all parts of the plan agree on them; the rows are written once, for they are read by the
count, the cuts, the totals and the windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.tables import written

PARTS, MOST, ROWS = 64, 4096, 1_000_000


def _bucket(df: DataFrame, order: str) -> Column:
    """How many cuts lie below a row's value: looked for in groups of ``PARTS`` cuts, then within one."""
    value = F.col(order).cast("double")
    parts = min(MOST, max(PARTS, -(-df.count() // ROWS)))
    cuts = sorted(set(df.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], max(1000, 16 * parts))).first()[0] or []))
    if not cuts:
        return F.lit(0)
    groups = [cuts[i : i + PARTS] for i in range(0, len(cuts), PARTS)]
    below = lambda numbers: F.size(F.filter(numbers, lambda c: c < value))
    literal = lambda numbers: F.array(*[F.lit(float(c)) for c in numbers])
    if len(groups) == 1:
        return below(literal(cuts))
    whole = below(literal([g[-1] for g in groups]))
    inside = F.coalesce(F.get(F.array(*map(literal, groups)), whole), F.array().cast("array<double>"))
    return F.least(whole * PARTS, F.lit(len(cuts))) + below(inside)


def running(df: DataFrame, order: str, columns: dict[str, tuple[str, str]], desc: bool = False) -> DataFrame:
    """Adds columns: name to (``sum`` or ``max``, source), over all rows up to each by ``order``, which must be numeric and distinct."""
    df = written(df, "running")
    parted = df.withColumn("_part", _bucket(df, order))
    direction = F.desc if desc else F.asc
    totals = parted.groupBy("_part").agg(*[(F.sum if kind == "sum" else F.max)(source).alias(f"_{name}") for name, (kind, source) in columns.items()])
    before = Window.orderBy(direction("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "_part", *[(F.sum if kind == "sum" else F.max)(f"_{name}").over(before).alias(f"_{name}") for name, (kind, _) in columns.items()]
    )
    inside = Window.partitionBy("_part").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = parted.join(F.broadcast(totals), "_part")
    for name, (kind, source) in columns.items():
        own = (F.sum if kind == "sum" else F.max)(source).over(inside)
        out = out.withColumn(name, own + F.coalesce(f"_{name}", F.lit(0)) if kind == "sum" else F.greatest(own, F.col(f"_{name}")))
    return out.drop("_part", *[f"_{name}" for name in columns])


def previous(df: DataFrame, order: str, name: str = "previous") -> DataFrame:
    """Adds the value of ``order`` (numeric and distinct) in the row before, null for the first."""
    df = written(df, "running")
    parted = df.withColumn("_part", _bucket(df, order))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    edges = parted.groupBy("_part").agg(F.max(order).alias("_top")).select("_part", F.max("_top").over(before).alias("_edge"))
    out = parted.join(F.broadcast(edges), "_part")
    return out.withColumn(name, F.coalesce(F.lag(order).over(Window.partitionBy("_part").orderBy(order)), "_edge")).drop("_part", "_edge")
