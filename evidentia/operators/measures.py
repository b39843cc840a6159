"""Measures of sampled series, filters over them, and measures of pictures, networks of points and scores, as aggregates.

Series are samples (key, at, re, im), or blocks of them where a spectrum or a filter needs neighbours (see ``series``). Moments are
sums by key; spectra are summed by task before they meet by (key, bin).

Defined cases: null samples count as none in moments; a constant or empty series has null shape measures; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.cyclic import window_of
from evidentia.operators.series import _arrays, with_halo
from evidentia.operators.tables import tasks, written


def centred(samples: DataFrame, key: str) -> DataFrame:
    """samples with their key's mean taken away, and that mean."""
    means = samples.groupBy(key).agg(F.avg("re").alias("dc_re"), F.avg("im").alias("dc_im"))
    return samples.join(means, key).withColumns({"re": F.col("re") - F.col("dc_re"), "im": F.col("im") - F.col("dc_im")})


def impairments(samples: DataFrame, key: str) -> DataFrame:
    """key, n, dc_re, dc_im, power, gain, phase, circularity: offset, imbalance of the two arms (ratio, radians), and |E x^2| / E |x|^2."""
    i, q = F.col("re"), F.col("im")
    m = centred(samples, key).groupBy(key).agg(
        F.count("re").alias("n"), F.first("dc_re").alias("dc_re"), F.first("dc_im").alias("dc_im"), F.avg(i * i).alias("ii"), F.avg(q * q).alias("qq"), F.avg(i * q).alias("iq")
    )
    both = F.when((F.col("ii") > 0) & (F.col("qq") > 0), F.col("iq") / F.sqrt(F.col("ii") * F.col("qq")))
    power = F.col("ii") + F.col("qq")
    return m.select(
        key, "n", "dc_re", "dc_im", power.alias("power"), F.when(F.col("ii") > 0, F.sqrt(F.col("qq") / F.col("ii"))).alias("gain"),
        F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), both))).alias("phase"),
        F.when(power > 0, F.sqrt((F.col("ii") - F.col("qq")) ** 2 + 4 * F.col("iq") ** 2) / power).alias("circularity")
    )


def corrected(samples: DataFrame, key: str, measured: DataFrame) -> DataFrame:
    """samples without the offset and imbalance of their key; those of a series without shape stay."""
    m = measured.filter("gain > 0 AND abs(phase) < 1.5").select(key, "dc_re", "dc_im", "gain", "phase")
    i = F.col("re") - F.col("dc_re")
    q = ((F.col("im") - F.col("dc_im")) / F.col("gain") - i * F.sin("phase")) / F.cos("phase")
    return samples.join(m, key, "left").withColumns({"re": F.coalesce(i, "re"), "im": F.coalesce(q, "im")}).drop("dc_re", "dc_im", "gain", "phase")


def cumulants(samples: DataFrame, key: str) -> DataFrame:
    """key, c20, c40, c41, c42: magnitudes (c42 signed) of the cumulants of the centred series over powers of its power."""
    i, q = F.col("re"), F.col("im")
    sr, si, p = i * i - q * q, 2 * i * q, i * i + q * q  # x^2 and |x|^2
    m = centred(samples, key).groupBy(key).agg(
        F.avg(sr).alias("a"), F.avg(si).alias("b"), F.avg(p).alias("p"), F.avg(sr * sr - si * si).alias("fr"), F.avg(2 * sr * si).alias("fi"),
        F.avg(sr * p).alias("tr"), F.avg(si * p).alias("ti"), F.avg(p * p).alias("pp")
    ).filter("p > 0")
    a, b, p = F.col("a"), F.col("b"), F.col("p")
    square = p * p
    return m.select(
        key, (F.hypot(a, b) / p).alias("c20"), (F.hypot(F.col("fr") - 3 * (a * a - b * b), F.col("fi") - 6 * a * b) / square).alias("c40"),
        (F.hypot(F.col("tr") - 3 * a * p, F.col("ti") - 3 * b * p) / square).alias("c41"), ((F.col("pp") - a * a - b * b - 2 * square) / square).alias("c42")
    )


def autocorrelation(samples: DataFrame, key: str, lags: list[int]) -> DataFrame:
    """key, lag, re, im: the centred series with itself some samples later, over its power. Samples meet by number."""
    x = centred(samples, key)
    power = x.groupBy(key).agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("_p"))
    late = x.select(key, F.col("at").alias("_at"), F.col("re").alias("_r"), F.col("im").alias("_i"))
    early = x.select(key, "at", "re", "im", F.explode(F.array(*map(F.lit, lags))).alias("lag")).withColumn("_at", F.col("at") + F.col("lag"))
    met = early.join(late, [key, "_at"]).groupBy(key, "lag").agg(
        F.sum(F.col("_r") * F.col("re") + F.col("_i") * F.col("im")).alias("r"), F.sum(F.col("_i") * F.col("re") - F.col("_r") * F.col("im")).alias("i")
    )
    return met.join(power.filter("_p > 0"), key).select(key, "lag", (F.col("r") / F.col("_p")).alias("re"), (F.col("i") / F.col("_p")).alias("im"))


def correlation_length(correlations: DataFrame, key: str, level: float = math.exp(-1)) -> DataFrame:
    """key, length: the first lag whose correlation is below the level; null if none is."""
    low = F.when(F.hypot("re", "im") < level, F.col("lag"))
    return correlations.groupBy(key).agg(F.min(low).alias("length"))


# Spectra


def spectra(blocks: DataFrame, key: str, size: int, kind: str = "x") -> DataFrame:
    """key, bin, power, segments: mean power spectrum of the whole segments of a series, or of what takes its modulation away.

    kind: x, the series; power, its squared magnitude, whose lines are symbol rates; square or fourth, its powers, whose lines are
    two or four times the carrier's offset. A task adds up its segments of a key before they meet.
    """
    taken = {"x": lambda x: x, "power": lambda x: (np.abs(x) ** 2).astype(complex), "square": lambda x: x**2, "fourth": lambda x: x**4}[kind]
    w = window_of(size)
    kind_ = blocks.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        arrow = pa.int64()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), arrow), pa.array([s.tolist() for s, _ in sums.values()], pa.list_(pa.float64())), pa.array([n for _, n in sums.values()], pa.int64())],
                [key, "powers", "segments"]
            )

        for batch in batches:
            arrow = batch.column(0).type
            for name, re, im in zip(batch.column(0).to_pylist(), _arrays(batch, "re"), _arrays(batch, "im"), strict=True):
                y = taken(re + 1j * im)
                y = y - y.mean() if kind == "power" else y
                own = sums.setdefault(name, [0.0, 0])
                own[0] = own[0] + np.abs(np.fft.fft(y * w)) ** 2 / (w**2).sum()
                own[1] += 1
            if len(sums) * size > 4_000_000:
                yield told()
                sums.clear()
        yield told()

    whole = blocks.filter(F.size("re") == size).select(key, "re", "im")
    rows = whole.mapInArrow(run, f"{key} {kind_}, powers array<double>, segments long").select(key, "segments", F.posexplode("powers").alias("bin", "power"))
    summed = rows.groupBy(key, "bin").agg(F.sum("power").alias("power"), F.sum("segments").alias("segments"))
    return summed.select(key, "bin", (F.col("power") / F.col("segments")).alias("power"), "segments")


def strongest_line(spectrum: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """key, bin, ratio: the greatest bin of a span, the first of equal ones, and how far it stands over the span's mean."""
    span = spectrum.filter(F.col("bin").between(low, high))
    best = F.max(F.struct(F.round("power", 9).alias("p"), (-F.col("bin")).alias("b")))
    return span.groupBy(key).agg(best.alias("m"), F.avg("power").alias("mean")).filter("mean > 0").select(key, (-F.col("m.b")).alias("bin"), (F.col("m.p") / F.col("mean")).alias("ratio"))


def occupied_band(spectrum: DataFrame, key: str, size: int, share: float = 0.99) -> DataFrame:
    """key, floor, low, high: the median of the bins, and the bins (signed) between which the share of the power above it stands. Groups are ``size`` bins."""
    at = F.when(2 * F.col("bin") >= size, F.col("bin") - size).otherwise(F.col("bin"))
    floor = spectrum.groupBy(key).agg(F.median("power").alias("floor"))
    over = spectrum.join(floor, key).select(key, at.alias("at"), "floor", F.greatest(F.col("power") - F.col("floor"), F.lit(0.0)).alias("over"))
    run = over.withColumns({"upto": F.sum("over").over(Window.partitionBy(key).orderBy("at")), "all": F.sum("over").over(Window.partitionBy(key))}).filter("all > 0")
    edge = lambda s: F.min(F.when(F.col("upto") >= s * F.col("all") * (1 - 1e-12), F.col("at")))
    return run.groupBy(key).agg(F.first("floor").alias("floor"), edge((1 - share) / 2).alias("low"), edge((1 + share) / 2).alias("high"))


# Filters over blocks


def median_filtered(blocks: DataFrame, key: str, reach: int, name: str = "re") -> DataFrame:
    """key, at, value: the median of each sample and up to ``reach`` on either side; at the ends of fewer."""
    x = F.concat(f"before_{name}", name, f"after_{name}")
    first = F.size(f"before_{name}")
    index = F.sequence(F.lit(0), F.size(name) - 1)

    def middle(i: Column) -> Column:
        begin = F.greatest(first + i - reach, F.lit(0))
        own = F.array_sort(F.slice("_x", begin + 1, F.least(first + i + reach, F.size("_x") - 1) - begin + 1))
        return (F.get(own, F.floor((F.size(own) - 1) / 2).cast("int")) + F.get(own, F.floor(F.size(own) / 2).cast("int"))) / 2

    rows = with_halo(blocks, key, reach, (name,)).withColumn("_x", x)
    return rows.select(key, "start", F.posexplode(F.transform(index, middle)).alias("_i", "value")).select(key, (F.col("start") + F.col("_i")).alias("at"), "value")


def smoothing_taps(reach: int) -> list[float]:
    """Weights of the least-squares parabola through the samples around one."""
    n = np.arange(-reach, reach + 1)
    design = np.stack([np.ones(len(n)), n, n**2], axis=1)
    return np.linalg.pinv(design)[0].tolist()


def weighted(blocks: DataFrame, key: str, taps: list[float], name: str = "re") -> DataFrame:
    """key, at, value: each sample and those around it, weighted; beyond the ends they are zeros. An odd number of taps, the middle one for the sample itself."""
    reach = len(taps) // 2
    zeros = lambda side: F.array_repeat(F.lit(0.0), reach - F.size(f"{side}_{name}"))
    x = F.concat(zeros("before"), f"before_{name}", name, f"after_{name}", zeros("after"))
    weights = F.array(*[F.lit(float(t)) for t in taps])
    index = F.sequence(F.lit(1), F.size(name))
    total = lambda i: F.aggregate(F.zip_with(F.slice("_x", i, len(taps)), weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = with_halo(blocks, key, reach, (name,)).withColumn("_x", x)
    return rows.select(key, "start", F.posexplode(F.transform(index, total)).alias("_i", "value")).select(key, (F.col("start") + F.col("_i")).alias("at"), "value")


def likeliest_words(samples: DataFrame, key: str, codebook: DataFrame, length: int) -> DataFrame:
    """key, symbol, word, share: for every ``length`` samples the code word (word, place, re, im) that fits best whatever the phase.

    share: of the symbol's power that the word explains. Samples meet the book by place; of equal words the lesser counts.
    """
    energy = codebook.groupBy("word").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("_e")).filter("_e > 0")
    book = codebook.join(energy, "word").select("word", "_e", F.col("place").alias("_p"), F.col("re").alias("_r"), F.col("im").alias("_i"))
    x = samples.select(key, F.floor(F.col("at") / length).alias("symbol"), F.pmod("at", F.lit(length)).alias("_p"), "re", "im")
    power = x.groupBy(key, "symbol").agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2).alias("_w"))
    met = x.join(F.broadcast(book) if book.count() <= 10_000 else book, "_p").groupBy(key, "symbol", "word").agg(
        F.sum(F.col("re") * F.col("_r") + F.col("im") * F.col("_i")).alias("a"), F.sum(F.col("im") * F.col("_r") - F.col("re") * F.col("_i")).alias("b"), F.first("_e").alias("_e")
    )
    fit = met.withColumn("f", F.round((F.col("a") ** 2 + F.col("b") ** 2) / F.col("_e"), 9))
    best = fit.groupBy(key, "symbol").agg(F.min(F.struct((-F.col("f")).alias("f"), "word")).alias("s")).join(power.filter("_w > 0"), [key, "symbol"])
    return best.select(key, "symbol", "s.word", (-F.col("s.f") / F.col("_w")).alias("share"))


# Pictures and points


def two_class_threshold(values: DataFrame, key: str, value: str, cells: int = 64) -> DataFrame:
    """key, threshold, between: the value that parts a histogram of each key, from its least to its greatest value, into the two most different classes.

    Histograms are counts by (key, cell); the windows are over ``cells`` rows. Of equal cuts the first counts; a constant key has none.
    """
    own = values.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"))
    span = own.groupBy(key).agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("high > low")
    cell = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * cells), F.lit(cells - 1))
    counts = own.join(span, key).groupBy(key, "low", "high", cell.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("c")
    every = Window.partitionBy(key)
    run = counts.withColumns(
        {"w0": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col("c")).over(w), "n": F.sum("n").over(every), "s": F.sum(F.col("n") * F.col("c")).over(every)}
    )
    w1 = F.col("n") - F.col("w0")
    apart = F.when(w1 > 0, F.col("w0") * w1 * (F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1) ** 2 / F.col("n") ** 2)
    best = run.withColumn("b", F.round(apart, 9)).filter("b IS NOT NULL").groupBy(key).agg(F.min(F.struct((-F.col("b")).alias("b"), "c", "low", "high")).alias("m"))
    return best.select(key, (F.col("m.low") + (F.col("m.c") + 1) * (F.col("m.high") - F.col("m.low")) / cells).alias("threshold"), (-F.col("m.b")).alias("between"))


def in_rings(points: DataFrame, corners: DataFrame, cell: float) -> DataFrame:
    """id, ring of points (id, x, y) inside rings (ring, nth, x, y; closed by themselves): an edge crosses to the right of a point an odd number of times.

    Edges are dealt to the cells, ``cell`` wide and high, of the rows that they touch, from the ring's left end to their own right one; a place
    meets the edges of its cell, once for all its points.
    """
    w = Window.partitionBy("ring").orderBy("nth")
    all_ = Window.partitionBy("ring")
    first = Window.partitionBy("ring").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = corners.select(
        "ring", F.col("x").alias("ax"), F.col("y").alias("ay"), F.coalesce(F.lead("x").over(w), F.first("x").over(first)).alias("bx"),
        F.coalesce(F.lead("y").over(w), F.first("y").over(first)).alias("by"), F.min("x").over(all_).alias("left")
    ).filter("ay <> by")
    rows = edges.withColumn("_r", F.explode(F.sequence(F.floor(F.least("ay", "by") / cell), F.floor(F.greatest("ay", "by") / cell))))
    # One cell more on either side: the crossing is computed, and may be a last bit beyond the corners.
    dealt = rows.withColumn("_c", F.explode(F.sequence(F.floor(F.col("left") / cell) - 1, F.floor(F.greatest("ax", "bx") / cell) + 1))).drop("left")
    # Few places meet many edges: by their size alone Spark would join them in one task. They are dealt before they are made distinct, since Spark
    # leaves out a repartition by what they are grouped by already.
    places = points.select("x", "y").repartition(tasks(points), "x", "y").distinct()
    met = places.withColumns({"_r": F.floor(F.col("y") / cell), "_c": F.floor(F.col("x") / cell)}).join(dealt, ["_r", "_c"])
    spans = (F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))
    right = F.col("x") < F.col("ax") + (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    inside = met.filter(spans & right).groupBy("x", "y", "ring").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    return points.select("id", "x", "y").join(inside, ["x", "y"]).select("id", "ring")


def ring_areas(corners: DataFrame) -> DataFrame:
    """ring, m2: the area of rings (ring, nth, lat, lon) on the plane that touches the earth in their middle."""
    earth = 6_371_000.0
    mid = corners.groupBy("ring").agg(F.avg("lat").alias("_a"), F.avg("lon").alias("_o"))
    flat = corners.join(mid, "ring").select(
        "ring", "nth", (F.radians(F.col("lon") - F.col("_o")) * earth * F.cos(F.radians("_a"))).alias("x"), (F.radians(F.col("lat") - F.col("_a")) * earth).alias("y")
    )
    w = Window.partitionBy("ring").orderBy("nth")
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(first)), F.coalesce(F.lead("y").over(w), F.first("y").over(first))
    turned = flat.withColumn("t", F.col("x") * ny - nx * F.col("y"))
    return turned.groupBy("ring").agg((F.abs(F.sum("t")) / 2).alias("m2"))


def knife_edge_db(v: Column) -> Column:
    """Loss over one edge by its parameter."""
    return F.when(v > -0.78, 6.9 + 20 * F.log10(F.sqrt((v - 0.1) ** 2 + 1) + v - 0.1)).otherwise(0.0)


def bullington_losses(profile: DataFrame, link: str, hz: float, bulge: float = 4 / 3) -> DataFrame:
    """link, loss_db: diffraction over a terrain profile (link, d, h, span, tx, rx) by the one edge that stands for it.

    d: metres from the sender, 0 < d < span; h: ground; tx, rx: heights of the antennas over the same level. The edge is where the steepest
    lines from both ends meet, or, if they see each other, the point that rises most into the zone between them. One aggregate a link.
    """
    length = 299_792_458.0 / hz
    d, span, h = F.col("d"), F.col("span"), F.col("h") + F.col("d") * (F.col("span") - F.col("d")) / (2 * bulge * 6_371_000.0)
    line = F.col("tx") + (F.col("rx") - F.col("tx")) * d / span
    zone = (h - line) * F.sqrt(2 * span / (length * d * (span - d)))
    m = profile.filter((d > 0) & (d < span)).groupBy(link).agg(
        F.max((h - F.col("tx")) / d).alias("up"), F.max((h - F.col("rx")) / (span - d)).alias("down"), F.max(zone).alias("near"),
        F.first("span").alias("span"), F.first("tx").alias("tx"), F.first("rx").alias("rx")
    )
    at = (F.col("rx") + F.col("down") * F.col("span") - F.col("tx")) / (F.col("up") + F.col("down"))
    top = F.col("tx") + F.col("up") * at - (F.col("tx") + (F.col("rx") - F.col("tx")) * at / F.col("span"))
    seen = F.col("up") < (F.col("rx") - F.col("tx")) / F.col("span")
    v = F.when(seen, F.col("near")).otherwise(top * F.sqrt(2 * F.col("span") / (length * at * (F.col("span") - at))))
    edge = knife_edge_db(v)
    return m.select(link, (edge + (1 - F.exp(-edge / 6)) * (10 + 0.02 * F.col("span") / 1000)).alias("loss_db"))


# Scores


def platt(rows: DataFrame, score: str, label: str, rounds: int = 6) -> tuple[float, float]:
    """a, b of the chance 1 / (1 + exp(-(a s + b))) that a score's label is 1: Newton steps, each one sum over all rows."""
    clean = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y")).agg(
        F.count(F.lit(1)).alias("n")
    )
    clean = written(clean, "scores")  # distinct scores, read in every round
    a = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-(a * F.col("s") + b)))
        g, h, n = p - F.col("y"), p * (1 - p), F.col("n")
        r = clean.agg(
            F.sum(n * g * F.col("s")).alias("ga"), F.sum(n * g).alias("gb"), F.sum(n * h * F.col("s") ** 2).alias("aa"), F.sum(n * h * F.col("s")).alias("ab"), F.sum(n * h).alias("bb")
        ).first()
        if r["bb"] is None:
            break
        aa, bb = r["aa"] + 1e-9, r["bb"] + 1e-9
        whole = aa * bb - r["ab"] ** 2
        if whole <= 0:
            break
        a, b = a - (bb * r["ga"] - r["ab"] * r["gb"]) / whole, b - (aa * r["gb"] - r["ab"] * r["ga"]) / whole
    return a, b


def with_chance(rows: DataFrame, score: str, a: float, b: float) -> DataFrame:
    """rows with the chance that the score's label is 1."""
    return rows.withColumn("chance", 1 / (1 + F.exp(-(F.lit(a) * F.col(score) + F.lit(b)))))
