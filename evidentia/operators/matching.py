"""Open-set matching: prototypes of classes, emitter libraries, ledgers, boxes. Unknown is an answer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.tables import forget, tasks, written

UNKNOWN = "UNKNOWN"


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v) -> Column:
    """The vector at unit length; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x.cast("double") / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def softmax(v) -> Column:
    top = F.array_max(v)
    powers = F.transform(v, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


BLOCK, FEW, SPREAD = 1024, 16, 64
#: Rows of probes that meet a part of a library, emitters of a part, pairs at once, emitters of a leaf of its trees, and most trees' meetings.
PROBES, EMITTERS, PAIRS, LEAF, MEETINGS = 50_000, 200_000, 500_000, 32, 1000


def with_blocks(rows: DataFrame, bank: DataFrame, size: int = BLOCK) -> DataFrame:
    """``rows`` with ``_block``, an array of the bank's rows, once for each block of the bank: an equality join on the block's number.

    A bank counted to be of at most ``FEW`` blocks is broadcast. A greater one is joined by block and one of ``SPREAD`` numbers,
    so that a block, which all rows meet, is no single task.
    """
    blocks = max(1, -(-bank.count() // size))
    number = F.pmod(F.xxhash64(*bank.columns), F.lit(blocks)).cast("int")
    packed = bank.groupBy(number.alias("_b")).agg(F.collect_list(F.struct(*bank.columns)).alias("_block"))
    dealt = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if blocks <= FEW:
        return dealt.join(F.broadcast(packed), "_b").drop("_b")
    many = packed.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    # The number of tasks is named, for work is by rows times blocks, and by the few bytes that come in they would be made one.
    spread = dealt.withColumn("_s", F.pmod(F.xxhash64(rows.columns[0]), F.lit(SPREAD)).cast("int")).repartition(tasks(rows), "_b", "_s")
    return spread.join(many, ["_b", "_s"]).drop("_b", "_s")


def prototypes(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """label, n, centre: the unit-length mean of each class. Dimensions are averaged apart, so no class is collected."""
    parts = vectors.select(F.col(label).alias("label"), F.posexplode(vector).alias("d", "x")).groupBy("label", "d").agg(
        F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    means = parts.groupBy("label").agg(
        F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean")
    )
    return means.select("label", "n", unit("mean").alias("centre"))


def vector_sums(vectors: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """keys, n, total: sums of vectors by key, each dimension apart, so that no group is collected; sums of sums are sums."""
    parts = vectors.select(*keys, F.posexplode(vector).alias("d", "x")).groupBy(*keys, "d").agg(
        F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    return parts.groupBy(*keys).agg(
        F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda s: s["s"]).alias("total")
    )


def taught(sums: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """``vector_sums`` of what both hold: a bank learns from new examples without the old ones."""
    both = sums.select(*keys, "n", "total").unionByName(more.select(*keys, "n", "total"))
    counts = both.groupBy(*keys).agg(F.sum("n").alias("n"))
    parts = both.select(*keys, F.posexplode("total").alias("d", "x")).groupBy(*keys, "d").agg(F.sum("x").alias("s"))
    totals = parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda s: s["s"]).alias("total"))
    return counts.join(totals, keys)


def _nearest_part(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """rows (label, id, v) with part, distance: the nearest centre of its class; of equal ones the lesser part."""
    packed = centres.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("part", "centre"))).alias("_c"))
    packed = F.broadcast(packed) if packed.count() <= BLOCK else packed
    far = F.transform("_c", lambda c: F.struct((1 - dot("v", c["centre"])).alias("distance"), c["part"].alias("part")))
    return rows.join(packed, "label").withColumn("_m", F.array_min(far)).select(
        *rows.columns, F.col("_m.part").alias("part"), F.col("_m.distance").alias("distance")
    )


def sub_prototypes(vectors: DataFrame, id_: str, vector: str, label: str, parts: int, rounds: int = 10) -> DataFrame:
    """label, part, n, centre: every class in at most ``parts`` parts by spherical k-means.

    The first centre of a class is its vector of least id, each further one the vector farthest from those before, of equal ones the least
    id; so seeds are fixed. A round gives each vector to the nearest centre of its class and sums the vectors of a part by
    dimension; only centres are written between rounds. Rounds end early when no centre moves. Zero vectors and null labels are left out;
    a class of fewer different vectors has fewer parts.
    """
    rows = vectors.select(F.col(label).alias("label"), F.col(id_).alias("id"), unit(vector).alias("v")).filter(
        F.col("label").isNotNull() & F.exists("v", lambda x: x != 0)
    )
    centres = written(rows.groupBy("label").agg(F.min_by("v", "id").alias("centre")).select("label", F.lit(0).alias("part"), "centre"), "centres")
    for part in range(1, parts):
        far = _nearest_part(rows, centres).groupBy("label").agg(F.max_by("v", F.struct(F.round("distance", 12), -F.col("id"))).alias("centre"), F.max("distance").alias("most"))
        new = far.filter("most > 1e-9").select("label", F.lit(part).alias("part"), "centre")
        old, centres = centres, written(centres.unionByName(new), "centres")
        forget(old)
    for _ in range(rounds):
        sums = vector_sums(_nearest_part(rows, centres), ["label", "part"])
        moved = sums.select("label", "part", "n", unit("total").alias("centre"))
        new = written(centres.select("label", "part", F.col("centre").alias("_old")).join(moved, ["label", "part"], "left").select(
            "label", "part", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("centre", "_old").alias("centre"), "_old"
        ), "centres")
        still = new.filter(1 - dot("centre", "_old") > 1e-12).isEmpty()
        forget(centres)
        centres = new.select("label", "part", "n", "centre")
        if still:
            break
    return centres


def classify(vectors: DataFrame, id_: str, vector: str, bank: DataFrame, threshold: float | None = None) -> DataFrame:
    """Nearest and second class by 1 - cosine; UNKNOWN beyond the class's threshold (column or number).

    The bank holds one row a class or part of one. It is cut into blocks of at most ``BLOCK`` rows, and a row meets each
    block by number and keeps the classes' least distances of it, so what is moved a row grows with blocks, not with the bank.
    """
    limit = F.lit(threshold) if threshold is not None else F.col("threshold")
    rows = vectors.select(F.col(id_).alias("id"), unit(vector).alias("_v"))
    met = with_blocks(rows, bank.select("label", "centre", limit.alias("limit")))
    near = F.transform(
        "_block", lambda x: F.struct(x["label"].alias("label"), (1 - dot("_v", x["centre"])).alias("distance"), x["limit"].alias("limit"))
    )
    per_class = met.select("id", F.explode(near).alias("x")).groupBy("id", F.col("x.label").alias("label")).agg(
        F.min(F.struct("x.distance", F.col("x.limit").alias("_limit"))).alias("m")
    )
    best = per_class.groupBy("id").agg(
        F.min(F.struct(F.col("m.distance").alias("distance"), "label", F.col("m._limit").alias("limit"))).alias("first"),
        F.sort_array(F.collect_list("m.distance")).alias("all")
    )
    return best.select(
        "id", F.col("first.label").alias("nearest"), F.col("first.distance").alias("distance"), F.get("all", F.lit(1)).alias("second"),
        F.when(F.col("first.distance") <= F.col("first.limit"), F.col("first.label").cast("string")).otherwise(UNKNOWN).alias("answer")
    )


def class_thresholds(vectors: DataFrame, vector: str, label: str, quantile: float = 0.95, least: int = 10, widen: float = 1.25) -> DataFrame:
    """Per class the quantile of leave-one-out distances, wider for small classes, between 1e-4 and 2."""
    parts = vectors.select(F.col(label).alias("label"), F.posexplode(vector).alias("d", "x")).groupBy("label", "d").agg(
        F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n")
    )
    sums = parts.groupBy("label").agg(
        F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("d", "s"))), lambda s: s["s"]).alias("total")
    )
    rows = vectors.select(F.col(label).alias("label"), F.col(vector).alias("v")).join(sums, "label").filter("n > 1")
    rest = unit(F.zip_with("total", "v", lambda t, x: t - x.cast("double")))
    own = rows.select("label", "n", (1 - dot(rest, unit("v"))).alias("distance"))
    cut = own.groupBy("label").agg(F.max("n").alias("n"), F.expr(f"percentile(distance, {quantile})").alias("q"))
    return cut.select(
        "label", "n",
        F.least(F.greatest(F.when(F.col("n") < least, F.col("q") * widen).otherwise(F.col("q")), F.lit(1e-4)), F.lit(2.0)).alias("threshold")
    )


# Emitter libraries: named features, compared in units of their scatter


def library(long: DataFrame) -> DataFrame:
    """emitter, feature, n, mean, var of long rows (emitter, feature, value); nulls and NaN are no observations."""
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("emitter", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var")
    )


def pooled_variance(lib: DataFrame) -> DataFrame:
    """Per feature, the variance within emitters."""
    return lib.filter("n > 1").groupBy("feature").agg((F.sum((F.col("n") - 1) * F.col("var")) / F.sum(F.col("n") - 1)).alias("pooled"))


def library_distances(probes: DataFrame, lib: DataFrame) -> DataFrame:
    """id, emitter, used, distance: root mean square over the features that both sides have, in pooled deviations.

    probes: long rows (id, feature, value). The join is on the feature.
    """
    scaled = lib.join(pooled_variance(lib), "feature").filter("pooled > 0").select("emitter", "feature", "mean", "pooled")
    met = probes.filter(F.col("value").isNotNull()).join(scaled, "feature")
    return met.groupBy("id", "emitter").agg(
        F.count(F.lit(1)).alias("used"), F.sqrt(F.avg((F.col("value") - F.col("mean")) ** 2 / F.col("pooled"))).alias("distance")
    )


def _tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Rows of ``points`` in leaves of at most ``LEAF`` (-1 where none is), and lows and highs of the nodes of each level, root first.

    A level halves every node by the middle of its widest dimension; children of node i are 2 i and 2 i + 1.
    """
    nodes = np.arange(len(points))[None, :]
    boxes = []
    while True:
        none = nodes < 0
        at = points[nodes]
        low, high = np.where(none[:, :, None], np.inf, at).min(axis=1), np.where(none[:, :, None], -np.inf, at).max(axis=1)
        boxes.append((low, high))
        if nodes.shape[1] <= LEAF:
            return nodes, nodes >= 0, boxes
        wide = np.argmax(np.where(low <= high, high - low, 0.0), axis=1)
        by = np.where(none, np.inf, np.take_along_axis(at, wide[:, None, None], axis=2)[:, :, 0])
        nodes = np.take_along_axis(nodes, np.argsort(by, axis=1, kind="stable"), axis=1)
        if nodes.shape[1] % 2:
            nodes = np.pad(nodes, ((0, 0), (0, 1)), constant_values=-1)
        nodes = nodes.reshape(2 * len(nodes), -1)


def _cost(number: np.ndarray, middle: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (number * (middle - place) ** 2).sum(axis=-1)


def _nearest_points(number: np.ndarray, middle: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the least sum of number * (middle - point)**2 over ``points``, and the least index that has it.

    Every row first goes down the tree to a near leaf, whose least cost bounds the second walk: that follows only nodes whose box may hold as little.
    """
    leaves, there, boxes = _tree(points)
    off = lambda level, rows, nodes: _cost(number[rows], middle[rows], np.clip(middle[rows], boxes[level][0][nodes], boxes[level][1][nodes]))
    best, which = np.full(len(middle), np.inf), np.full(len(middle), len(points))

    def meet(rows: np.ndarray, nodes: np.ndarray) -> None:
        """``rows``, in order, meet the points of leaves."""
        for i in range(0, len(rows), max(1, PAIRS // LEAF)):
            r, n = (x[i : i + max(1, PAIRS // LEAF)] for x in (rows, nodes))
            cost = np.where(there[n], _cost(number[r][:, None, :], middle[r][:, None, :], points[leaves[n]]), np.inf)
            least = cost.min(axis=1)
            first = np.where(cost == least[:, None], leaves[n], len(points)).min(axis=1)
            order = np.lexsort((first, least, r))
            head = order[np.flatnonzero(np.diff(r[order], prepend=-1))]
            own = r[head]
            nearer = (least[head] < best[own]) | ((least[head] == best[own]) & (first[head] < which[own]))
            best[own[nearer]], which[own[nearer]] = least[head][nearer], first[head][nearer]

    every, at = np.arange(len(middle)), np.zeros(len(middle), int)
    for level in range(1, len(boxes)):
        at = 2 * at + (off(level, every, 2 * at + 1) < off(level, every, 2 * at))
    meet(every, at)
    waiting = [(0, every, np.zeros(len(middle), int))]
    while waiting:
        level, rows, nodes = waiting.pop()
        near = off(level, rows, nodes) <= best[rows] * (1 + 1e-9) + 1e-300
        rows, nodes = rows[near], nodes[near]
        if level + 1 == len(boxes):
            meet(rows, nodes)
            continue
        for i in range(0, len(rows), PAIRS):
            r, n = rows[i : i + PAIRS], nodes[i : i + PAIRS]
            waiting.append((level + 1, np.concatenate([r, r]), np.concatenate([2 * n, 2 * n + 1])))
    return best, which


def _nearest_emitters(left: pa.Table, right: pa.Table) -> pa.Table:
    """id, distance, emitter, used: the nearest emitter of ``right`` for each probe of ``left`` that shares a feature with any.

    Every row of a probe counts, also several of one feature. Probes of the same features meet emitters of the same features in one tree, in
    units of pooled deviations; a sum over a feature's rows is their number times the square from their middle, and what is the same for all.
    Where there are more than ``MEETINGS`` of such kinds, all meet as matrices.
    """
    right = right.rename_columns([c[1:] for c in right.column_names]).combine_chunks()
    left = left.combine_chunks()
    emitters, names, own = (t.column(c).combine_chunks().unique() for t, c in ((right, "emitter"), (right, "feature"), (left, "id")))
    emitters = emitters.take(pc.sort_indices(emitters))
    at, of = (pc.index_in(right.column(c).combine_chunks(), v).to_numpy(zero_copy_only=False) for c, v in (("emitter", emitters), ("feature", names)))
    places, scale = np.full((len(emitters), len(names)), np.nan), np.ones(len(names))
    scale[of] = np.sqrt(right.column("pooled").to_numpy())
    places[at, of] = right.column("mean").to_numpy() / scale[of]
    places[~np.isfinite(places)] = np.nan
    known = pc.index_in(left.column("feature").combine_chunks(), names)
    left, feature = left.filter(known.is_valid()).combine_chunks(), known.drop_null().to_numpy(zero_copy_only=False).astype(int)
    probe, value = pc.index_in(left.column("id").combine_chunks(), own).to_numpy(zero_copy_only=False).astype(int), left.column("value").to_numpy() / scale[feature]
    # A value that is no number counts for nothing, as without it.
    probe, feature, value = (x[np.isfinite(value)] for x in (probe, feature, value))
    shape = (len(own), len(names))
    cell = probe * len(names) + feature
    summed = lambda x: np.bincount(cell, x, shape[0] * shape[1]).reshape(shape)
    number = summed(np.ones(len(cell)))
    middle = summed(value) / np.maximum(number, 1)
    around = summed((value - middle[probe, feature]) ** 2)
    best, which, used = np.full(len(own), np.inf), np.full(len(own), len(emitters)), np.zeros(len(own), np.int64)
    kinds = [np.unique(x, axis=0) for x in (number > 0, ~np.isnan(places))]
    if len(kinds[0]) * len(kinds[1]) > MEETINGS:
        there, step = ~np.isnan(places), max(1, PAIRS // max(1, len(emitters)))
        for i in range(0, len(own), step):
            n, m, a = (x[i : i + step] for x in (number, middle, around))
            cost = sum((there[:, f] * (n[:, f, None] * (m[:, f, None] - np.nan_to_num(places[:, f])) ** 2 + a[:, f, None]) for f in range(len(names))), np.zeros((len(n), len(emitters))))
            count = n @ there.T
            far = np.where(count > 0, np.sqrt(cost / np.maximum(count, 1)), np.inf)
            which[i : i + step] = near = far.argmin(axis=1)
            best[i : i + step], used[i : i + step] = far[np.arange(len(n)), near], count[np.arange(len(n)), near]
        kinds = [[], []]
    for has in kinds[1]:
        rows = np.flatnonzero((~np.isnan(places) == has).all(axis=1))
        for asks in kinds[0]:
            both, mine = has & asks, np.flatnonzero(((number > 0) == asks).all(axis=1))
            if not both.any() or not len(mine):
                continue
            points, place = np.unique(places[np.ix_(rows, both)], axis=0, return_index=True)
            order = np.argsort(place)
            n, m = number[np.ix_(mine, both)], middle[np.ix_(mine, both)]
            cost, near = _nearest_points(n, m, points[order])
            count = n.sum(axis=1)
            far, found = np.sqrt((cost + around[np.ix_(mine, both)].sum(axis=1)) / count), rows[place[order][near]]
            nearer = (far < best[mine]) | ((far == best[mine]) & (found < which[mine]))
            best[mine[nearer]], which[mine[nearer]], used[mine[nearer]] = far[nearer], found[nearer], count[nearer]
    met = np.flatnonzero(used > 0)
    return pa.table({"id": own.take(pa.array(met)), "distance": pa.array(best[met]), "emitter": emitters.take(pa.array(which[met])), "used": pa.array(used[met])})


def library_match(probes: DataFrame, lib: DataFrame, limits: dict[int, float]) -> DataFrame:
    """The nearest emitter, or UNKNOWN beyond the limit for the number of features used.

    Emitters are dealt in parts of about ``EMITTERS`` and probes in parts of about ``PROBES`` rows; each two parts meet once, through trees
    over the emitters, and give every probe's nearest of the part. No pair of probe and emitter is a row. The library is written once.
    """
    lib = written(lib, "library")
    scaled = lib.join(F.broadcast(pooled_variance(lib)), "feature").filter("pooled > 0").select("emitter", "feature", "mean", "pooled")
    asked = probes.filter(F.col("value").isNotNull()).select("id", "feature", F.col("value").cast("double").alias("value"))
    banks = max(1, -(-scaled.select("emitter").distinct().count() // EMITTERS))
    parts = max(1, -(-asked.count() // PROBES))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_p", number("id", parts)).withColumn("_b", every(banks)).repartition(tasks(probes), "_p", "_b")
    right = scaled.withColumn("_b", number("emitter", banks)).withColumn("_p", every(parts))
    kinds = probes.schema["id"].dataType.simpleString(), lib.schema["emitter"].dataType.simpleString()
    right = right.select(*[F.col(c).alias(f"r{c}") for c in right.columns]).repartition(tasks(probes), "r_p", "r_b")
    near = left.groupBy("_p", "_b").cogroup(right.groupBy("r_p", "r_b")).applyInArrow(_nearest_emitters, f"id {kinds[0]}, distance double, emitter {kinds[1]}, used long")
    best = near.groupBy("id").agg(F.min(F.struct("distance", "emitter", "used")).alias("b")).select(
        "id", F.col("b.emitter").alias("nearest"), F.col("b.distance").alias("distance"), F.col("b.used").alias("used")
    )
    limit = F.lit(None).cast("double")
    for k, v in limits.items():
        limit = F.when(F.col("used") == k, F.lit(v)).otherwise(limit)
    return best.withColumn("answer", F.when(F.col("distance") <= limit, F.col("nearest").cast("string")).otherwise(UNKNOWN))


# Tolerance joins


def within(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tolerance: float, keys: list[str] = ()) -> DataFrame:
    """Rows of both sides whose values differ by at most the tolerance, through buckets of its width."""
    a = left.withColumn("_cell", F.explode(F.array(*[F.floor(F.col(left_value) / tolerance) + i for i in (-1, 0, 1)])))
    b = right.withColumn("_cell", F.floor(F.col(right_value) / tolerance))
    return a.join(b, [*keys, "_cell"]).filter(F.abs(F.col(left_value) - F.col(right_value)) <= tolerance).drop("_cell")


def _near_cells(rows: DataFrame, tolerance: float) -> DataFrame:
    """_cell, _low, _high, _below, _above: of the values in a bucket of the tolerance's width the least and greatest, and those next to it.

    Of any values in a bucket and its neighbours that lie within the tolerance of one in it, one is among these four.
    """
    cells = rows.filter("value IS NOT NULL").groupBy(F.floor(F.col("value") / tolerance).alias("_cell")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    none = F.lit(None).cast("double")
    near = lambda move, low, high, below, above: F.struct(
        (F.col("_cell") + move).alias("c"), low.alias("low"), high.alias("high"), below.alias("below"), above.alias("above")
    )
    low, high = F.col("low").cast("double"), F.col("high").cast("double")
    dealt = cells.select(F.explode(F.array(near(0, low, high, none, none), near(1, none, none, high, none), near(-1, none, none, none, low))).alias("n"))
    return dealt.groupBy(F.col("n.c").alias("_cell")).agg(*[F.max(f"n.{c}").alias(f"_{c}") for c in ("low", "high", "below", "above")])


def ledger_labels(features: DataFrame, ledgers: list[tuple[str, DataFrame, float]]) -> DataFrame:
    """id, value, label: the first ledger, in the given order, that has a value within its tolerance, else new.

    A feature meets one row of each ledger, whatever many values that has in its reach.
    """
    out, names = features, []
    for name, rows, tolerance in ledgers:
        met = out.withColumn("_cell", F.floor(F.col("value") / tolerance)).join(_near_cells(rows, tolerance), "_cell", "left")
        off = F.least(*[F.abs(F.col("value") - F.col(c)) for c in ("_low", "_high", "_below", "_above")])
        out = met.withColumn(f"_in_{name}", F.when(off <= tolerance, name)).drop("_cell", "_low", "_high", "_below", "_above")
        names.append(f"_in_{name}")
    return out.select("id", "value", F.coalesce(*names, F.lit("new")).alias("label"))


def overlaps(a: DataFrame, b: DataFrame, low: str, high: str, width: float, keys: list[str] = ()) -> DataFrame:
    """Pairs of intervals [low, high) that overlap, once each: columns of b get the suffix _b.

    An interval stands in every bucket it touches; a pair is kept in the bucket where the later one begins. The number of tasks is named,
    for a few bytes of intervals, which would be made one task, may overlap very much.
    """
    cells = lambda d: d.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    right = cells(b)
    right = right.select(*[F.col(c).alias(c if c in keys or c == "_cell" else f"{c}_b") for c in right.columns])
    met = cells(a).repartition(tasks(a), *keys, "_cell").join(right, [*keys, "_cell"])
    return met.filter(
        (F.col(low) < F.col(f"{high}_b")) & (F.col(f"{low}_b") < F.col(high)) & (F.col("_cell") == F.floor(F.greatest(low, f"{low}_b") / width))
    ).drop("_cell")


def box_iou(pairs: DataFrame, t: tuple[str, str] = ("t0", "t1"), f: tuple[str, str] = ("f0", "f1")) -> DataFrame:
    """Adds the time by frequency overlap of pairs from ``overlaps``: shared area over joint area."""
    share = lambda lo, hi: F.greatest(F.least(hi, f"{hi}_b") - F.greatest(lo, f"{lo}_b"), F.lit(0.0))
    area = lambda s: (F.col(t[1] + s) - F.col(t[0] + s)) * (F.col(f[1] + s) - F.col(f[0] + s))
    both = share(*t) * share(*f)
    return pairs.withColumn("iou", both / (area("") + area("_b") - both))


def _best_boxes(left: pa.Table, right: pa.Table, least: float) -> pa.Table:
    """_l, _r, iou: of each left box of a cell the right one that shares most with it, of equals to nine digits the one with the least id."""
    right = right.take(pc.sort_indices(right["_r"]))
    (a0, a1, af0, af1), (b0, b1, bf0, bf1) = ([s[c].to_numpy().astype(float) for c in ("_t0", "_t1", "_f0", "_f1")] for s in (left, right))
    order, best, which = np.argsort(a0), np.full(len(a0), -1.0), np.zeros(len(a0), int)
    for i in range(0, len(order), 128):
        p = order[i : i + 128]
        near = np.flatnonzero((b1 > a0[p].min()) & (b0 < a1[p].max()))
        if not near.size:
            continue
        x = [c[p][:, None] for c in (a0, a1, af0, af1)]
        y = [c[near] for c in (b0, b1, bf0, bf1)]
        both = np.maximum(np.minimum(x[1], y[1]) - np.maximum(x[0], y[0]), 0) * np.maximum(np.minimum(x[3], y[3]) - np.maximum(x[2], y[2]), 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            iou = both / ((x[1] - x[0]) * (x[3] - x[2]) + (y[1] - y[0]) * (y[3] - y[2]) - both)
        iou = np.where((x[0] < y[1]) & (y[0] < x[1]) & np.isfinite(iou), iou, -1.0)
        most = np.rint(iou * 1e9).argmax(axis=1)
        best[p], which[p] = iou[np.arange(len(p)), most], near[most]
    kept = np.flatnonzero(np.rint(best * 1e9) / 1e9 >= least)
    return pa.table({"_l": left["_l"].take(pa.array(kept)), "_r": right["_r"].take(pa.array(which[kept])), "iou": pa.array(best[kept])})


def best_overlaps(
    a: DataFrame, b: DataFrame, width: float, keys: list[str] = (), least: float = 0.0, id_: str = "id", t: tuple[str, str] = ("t0", "t1"), f: tuple[str, str] = ("f0", "f1")
) -> DataFrame:
    """Rows of a with the row of b that shares most with each, if any shares ``least``: adds id_b and iou, to nine digits; of equals the least id.

    Boxes alike in keys and edges are one: they are told apart again when their best is known, so that what is met grows with the shapes there are, not with
    boxes squared. A shape that both sides have is its own best and meets no other. The others meet in cells of ``width`` that they touch, as matrices; a
    cell of one key is in one task. Rows without an edge have no best.
    """
    shape, kind = [*keys, *t, *f], dict(a.dtypes)[id_]
    held = b.groupBy(*shape).agg(F.min(id_).alias("_r"))
    own = a.groupBy(*shape).agg(F.min(id_).alias("_l")).join(held, shape, "left")
    twin = F.col("_r").isNotNull() & (F.col(t[0]) < F.col(t[1])) & (F.col(f[0]) < F.col(f[1])) & F.lit(least <= 1)
    own = written(own.withColumn("_twin", F.coalesce(twin, F.lit(False))), "shapes")

    def cells(rows: DataFrame, name: str) -> DataFrame:
        edges = [F.col(c).cast("double").alias(n) for c, n in zip((*t, *f), ("_t0", "_t1", "_f0", "_f1"), strict=True)]
        cell = F.explode(F.sequence(F.floor(F.col("_t0") / width), F.floor(F.col("_t1") / width))).alias("_cell")
        return rows.select(*keys, name, *edges).dropna(subset=["_t0", "_t1", "_f0", "_f1"]).select("*", cell).repartition(tasks(a), *keys, "_cell")

    sides = [cells(rows, name).groupBy(*keys, "_cell") for rows, name in ((own.filter("NOT _twin").drop("_r"), "_l"), (held, "_r"))]
    met = sides[0].cogroup(sides[1]).applyInArrow(lambda left, right: _best_boxes(left, right, least), f"_l {kind}, _r {kind}, iou double")
    found = met.withColumn("iou", F.round("iou", 9)).groupBy("_l").agg(F.max(F.struct("iou", -F.col("_r"), F.col("_r").alias("r"))).alias("b"))
    twins = own.filter("_twin").select(*shape, F.col("_r").alias(f"{id_}_b"), F.lit(1.0).alias("iou"))
    best = twins.unionByName(own.join(found, "_l").select(*shape, F.col("b.r").alias(f"{id_}_b"), F.col("b.iou").alias("iou")))
    return a.join(best, shape).select(*a.columns, f"{id_}_b", "iou")


def first_claim(pairs: DataFrame, left: str, right: str, score: str, order: str, least: float) -> DataFrame:
    """Each left row tries only its best right row; of those that try one, the first in order has it, others have none."""
    best = pairs.filter(F.col(score) >= least).groupBy(left).agg(
        F.max(F.struct(F.col(score), -F.col(right), F.col(right).alias("r"), F.col(order).alias("o"))).alias("b")
    )
    tries = best.select(left, F.col("b.r").alias(right), F.col(f"b.{score}").alias(score), F.col("b.o").alias(order))
    rank = F.row_number().over(Window.partitionBy(right).orderBy(F.desc(order), left))
    return tries.withColumn("matched", rank == 1)


def owned(boxes: DataFrame, t: tuple[str, str], own: tuple[str, str]) -> DataFrame:
    """Boxes seen in overlapping tiles, once: the tile that owns the middle keeps the box, clipped to what it owns."""
    middle = (F.col(t[0]) + F.col(t[1])) / 2
    kept = boxes.filter((middle >= F.col(own[0])) & (middle < F.col(own[1])))
    return kept.withColumns({t[0]: F.greatest(t[0], own[0]), t[1]: F.least(t[1], own[1])})


def confirmed(boxes: DataFrame, results: DataFrame, id_: str = "id") -> DataFrame:
    """boxes (id, cls) with the first decoder in rank order that succeeded (results: id, decoder, rank, ok, label).

    A box without a class, or UNKNOWN, is never tried; a label that differs is kept as a disagreement.
    """
    tried = boxes.filter(F.coalesce(F.col("cls"), F.lit(UNKNOWN)) != UNKNOWN).select(id_)
    best = results.filter("ok").join(tried, id_, "left_semi").groupBy(id_).agg(F.min(F.struct("rank", "decoder", "label")).alias("b"))
    return boxes.join(best, id_, "left").select(
        *boxes.columns, F.col("b.decoder").alias("decoder"), F.coalesce("b.label", "cls").alias("label"),
        (F.col("b.label") != F.col("cls")).alias("disagrees")
    )


def box_json(boxes: DataFrame, id_: str, columns: list[str]) -> DataFrame:
    """id, json: boxes as JSON text."""
    return boxes.select(F.col(id_).alias("id"), F.to_json(F.struct(*columns)).alias("json"))


def boxes_of(rows: DataFrame, schema: str) -> DataFrame:
    """id and the columns of JSON texts made by ``box_json``; a text that is none gives nulls."""
    return rows.select("id", F.from_json("json", schema).alias("_b")).select("id", "_b.*")
