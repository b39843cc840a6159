"""Networks of edges: what can be reached within a distance, by which way, and which stretches of edges lie how far away.

Shortest distances spread from all sources at once, in rounds: the nodes that came nearer in the last round hand their distance on over
their edges, the least for each (source, node) is kept if it is within the budget and nearer than before, and those go on. Rounds end
when nothing comes nearer; each writes only what changed, and the tables of rounds that are no longer read are
deleted. Work follows the nodes within the budget, not the network.

Defined cases: edges lead both ways; of several between two nodes the shortest counts; lengths of nulls or below zero are no edges; a source that
no edge touches reaches itself; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.tables import forget, tasks, written

#: Rows of a task that groups edges; points of a cell that one group takes; distances at once.
ROWS, CROWD, AT_ONCE = 250_000, 100_000, 200_000


def _dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` rows dealt by keys before they are grouped, to more tasks the more they are: groups are nearly as many, so each task holds its rows."""
    return rows.repartition(max(tasks(rows), -(-n // ROWS)), *keys)


def both_ways(edges: DataFrame) -> DataFrame:
    """a, b, length of edges (a, b, length) in both directions, the shortest of each."""
    plain = edges.filter("length >= 0 AND a IS NOT NULL AND b IS NOT NULL").select("a", "b", F.col("length").cast("double").alias("length"))
    turned = plain.select(F.col("b").alias("a"), F.col("a").alias("b"), "length")
    return _dealt(plain.unionByName(turned), 2 * edges.count(), "a", "b").groupBy("a", "b").agg(F.min("length").alias("length"))


def reach(edges: DataFrame, seeds: DataFrame, budget: float, paths: bool = False) -> DataFrame:
    """source, node, cost (and path) of all nodes within ``budget`` of the seeds (source, node, cost). Of equal ways the first by path counts.

    paths: the nodes on the way, as text, which only short ways should carry.
    """
    more = ["path"] if paths else []
    ways = written(both_ways(edges), "edges")
    first = seeds.filter(F.col("cost") <= budget).select("source", "node", F.col("cost").cast("double").alias("cost"))
    if paths:
        first = first.withColumn("path", F.array(F.col("node").cast("string")))
    best = F.min(F.struct("cost", *more)).alias("s")
    known = written(first.groupBy("source", "node").agg(best).select("source", "node", "s.*"), "reach")
    near = known
    while True:
        on = near.join(ways, near["node"] == ways["a"]).select(
            "source", F.col("b").alias("node"), (F.col("cost") + F.col("length")).alias("cost"),
            *([F.concat("path", F.array(F.col("b").cast("string"))).alias("path")] if paths else [])
        ).filter(F.col("cost") <= budget)
        least = on.groupBy("source", "node").agg(best).select("source", "node", "s.*")
        before = known.select("source", "node", *[F.col(c).alias(f"_{c}") for c in ("cost", *more)])
        nearer = F.struct("cost", *more) < F.struct(*[F.col(f"_{c}") for c in ("cost", *more)])
        step = least.join(before, ["source", "node"], "left").filter(F.col("_cost").isNull() | nearer).select("source", "node", "cost", *more)
        step = written(step, "nearer")
        if step.isEmpty():
            forget(step, ways)
            return known
        rest = known.join(step.select("source", "node"), ["source", "node"], "left_anti")
        new = written(rest.unionByName(step), "reach")
        forget(*{id(t): t for t in (known, near)}.values())
        known, near = new, step


def routes(edges: DataFrame, pairs: DataFrame, budget: float) -> DataFrame:
    """source, target, cost and path of the shortest way of each pair; pairs farther apart have nulls."""
    found = reach(edges, pairs.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost")).distinct(), budget, True)
    return pairs.join(found.withColumnRenamed("node", "target"), ["source", "target"], "left").select("source", "target", "cost", "path")


def stretches(edges: DataFrame, reached: DataFrame, low: float, high: float) -> DataFrame:
    """source, a, b, from_m, to_m: the parts of the edges (a < b) between two distances from each source, measured from ``a``.

    Along an edge the distance rises from ``a`` and falls towards ``b``; each slope has one part at most.
    """
    ways = both_ways(edges).filter("a < b")
    at_a = reached.select("source", F.col("node").alias("a"), F.col("cost").alias("da"))
    at_b = reached.select("source", F.col("node").alias("b"), F.col("cost").alias("db"))
    from_a = ways.join(at_a, "a").select("source", "a", "b", "length", "da", F.lit(None).cast("double").alias("db"))
    from_b = ways.join(at_b, "b").select("source", "a", "b", "length", F.lit(None).cast("double").alias("da"), "db")
    met = written(from_a.unionByName(from_b), "stretches")
    both = _dealt(met, met.count(), "source", "a", "b").groupBy("source", "a", "b").agg(F.max("length").alias("length"), F.min("da").alias("da"), F.min("db").alias("db"))
    far = F.lit(float("inf"))
    da, db = F.coalesce("da", far), F.coalesce("db", far)
    top = F.when(F.col("db").isNull(), F.col("length")).when(F.col("da").isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.col("length"), (db + F.col("length") - da) / 2))
    )
    rise = F.struct(F.greatest(F.lit(0.0), low - da).alias("from_m"), F.least(top, high - da).alias("to_m"))
    fall = F.struct(F.greatest(top, db + F.col("length") - high).alias("from_m"), F.least(F.col("length"), db + F.col("length") - low).alias("to_m"))
    parts = both.select("source", "a", "b", F.explode(F.array(rise, fall)).alias("p")).select("source", "a", "b", "p.*")
    return parts.filter(F.col("to_m") > F.col("from_m"))


def _cells(low_x: Column, high_x: Column, low_y: Column, high_y: Column, width: float) -> Column:
    xs = F.sequence(F.floor(low_x / width), F.floor(high_x / width))
    ys = F.sequence(F.floor(low_y / width), F.floor(high_y / width))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def snap(points: DataFrame, segments: DataFrame, most: float, digits: int = 9) -> DataFrame:
    """id, edge, share, metres: the nearest segment of each point within ``most``, and how far along it lies; of equal ones the lesser edge.

    points: id, x, y; segments: edge, ax, ay, bx, by; all in one plane. They meet in cells ``most`` wide that a segment's surroundings touch, once for
    all points of one place, as matrices; the points of a crowded cell are dealt in parts. Distances are compared, with each other and with
    ``most``, to ``digits`` decimal places, so that rounding decides no tie.
    """
    wide = most + 10.0**-digits
    plain = lambda df, *names: df.filter(" AND ".join(f"{n} IS NOT NULL AND NOT isnan({n})" for n in names))
    double = lambda *names: [F.col(n).cast("double").alias(n) for n in names]
    at = plain(points.select("id", *double("x", "y")), "x", "y").withColumns({"cx": F.floor(F.col("x") / most), "cy": F.floor(F.col("y") / most)})
    parts = at.groupBy("cx", "cy").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("_parts"))
    near = plain(segments.select("edge", *double("ax", "ay", "bx", "by")), "ax", "ay", "bx", "by").withColumn(
        "c", F.explode(
            _cells(
                F.least("ax", "bx") - wide, F.greatest("ax", "bx") + wide, F.least("ay", "by") - wide, F.greatest("ay", "by") + wide, most
            )
        )
    ).select("edge", "ax", "ay", "bx", "by", F.col("c.cx").alias("r_cx"), F.col("c.cy").alias("r_cy"))
    near = near.join(parts.toDF("r_cx", "r_cy", "r_parts"), ["r_cx", "r_cy"]).withColumn("r_p", F.explode(F.sequence(F.lit(0), F.col("r_parts") - 1)))
    own = at.join(parts, ["cx", "cy"]).withColumn("_p", F.pmod(F.xxhash64("x", "y"), F.col("_parts")).cast("int"))
    kinds = points.schema["id"].dataType.simpleString(), segments.schema["edge"].dataType.simpleString()

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by([("edge", "ascending")]) if b["edge"].null_count == 0 else b.take(pc.sort_indices(b["edge"], null_placement="at_start"))
        ax, ay, bx, by = (b[c].to_numpy() for c in ("ax", "ay", "bx", "by"))
        x, y = a["x"].to_numpy(), a["y"].to_numpy()
        order = np.lexsort((y, x))
        heads = np.r_[True, (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])][: len(order)]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(heads) - 1
        x, y = x[order[heads]], y[order[heads]]
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        per = np.where(size > 0, size, 1.0)
        dx_, dy_ = np.where(size > 0, dx, 0.0), np.where(size > 0, dy, 0.0)
        found = np.full(len(x), -1, np.int64), np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
        step = max(1, AT_ONCE // max(1, len(ax)))
        for i in range(0, len(x) if len(ax) else 0, step):
            px, py = x[i : i + step, None], y[i : i + step, None]
            ox, oy = px - ax, py - ay
            share = np.minimum(1.0, np.maximum(0.0, (ox * dx_ + oy * dy_) / per))
            square = (ox - share * dx) ** 2 + (oy - share * dy) ** 2
            # Only those that rounding could make the nearest are compared as distances.
            least = (np.sqrt(square.min(axis=1)) + 2 * 10.0**-digits) ** 2 * (1 + 1e-12)
            p, q = np.nonzero(square <= np.minimum(least, (most + 2 * 10.0**-digits) ** 2 * (1 + 1e-12))[:, None])
            metres = np.hypot(ox[p, q] - share[p, q] * dx[q], oy[p, q] - share[p, q] * dy[q])
            far = np.floor(metres * 10.0**digits + 0.5)
            kept = np.flatnonzero(far <= np.floor(most * 10.0**digits + 0.5))
            p, q, metres, far = p[kept], q[kept], metres[kept], far[kept]
            best = np.lexsort((q, far, p))
            best = best[np.r_[True, p[best][1:] != p[best][:-1]][: len(best)]]
            for out, v in zip(found, (q[best], share[p[best], q[best]], metres[best], far[best]), strict=True):
                out[i + p[best]] = v
        rows = np.flatnonzero(found[0][place] >= 0)
        edge, share, metres, far = (v[place[rows]] for v in found)
        return pa.table({"id": a["id"].take(pa.array(rows)), "edge": b["edge"].take(pa.array(edge)), "share": share, "metres": metres, "_far": far})

    # Cells are few and their work is not: they keep the tasks they are dealt to.
    left, right = (df.repartition(tasks(points), *by).groupBy(*by) for df, by in ((own, ["cx", "cy", "_p"]), (near, ["r_cx", "r_cy", "r_p"])))
    far = left.cogroup(right).applyInArrow(met, f"id {kinds[0]}, edge {kinds[1]}, share double, metres double, _far double")
    best = far.groupBy("id").agg(F.min(F.struct("_far", "edge", "share", "metres")).alias("s"))
    return best.select("id", "s.edge", "s.share", "s.metres")
