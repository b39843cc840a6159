"""Queries of measures of series, filters, pictures, points, scores and wording."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.operators import measures, series, spatial, wording
from evidentia.plans import series_queries as sq
from evidentia.plans import table_queries as tq

S = sq.SEGMENT
BOOK = [("a", [1, 1, -1, 1]), ("b", [1, -1, 1, 1]), ("c", [1, 1, 1, -1])]


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _series(spark, sf):
    return sq._samples(spark, sf).select("capture", "at", F.col("x").alias("re"), F.col("y").alias("im"))


def series_impairments(spark, sf):
    return _rounded(measures.impairments(_series(spark, sf), "capture"), 5, "dc_re", "dc_im", "power", "gain", "phase", "circularity")


def series_corrected(spark, sf):
    """Each capture after its offset and imbalance are taken away: sums of its samples' squares and products."""
    x = _series(spark, sf)
    y = measures.corrected(x, "capture", measures.impairments(x, "capture"))
    found = y.groupBy("capture").agg(F.avg(F.col("re") ** 2).alias("ii"), F.avg(F.col("im") ** 2).alias("qq"), F.avg(F.col("re") * F.col("im")).alias("iq"))
    return found.select("capture", F.round("ii", 4).alias("ii"), F.round("qq", 4).alias("qq"), (F.round("iq", 4) + 0.0).alias("iq"))


def series_cumulants(spark, sf):
    return _rounded(measures.cumulants(_series(spark, sf), "capture"), 5, "c20", "c40", "c41", "c42")


def series_correlations(spark, sf):
    return _rounded(measures.autocorrelation(_series(spark, sf), "capture", [1, 2, 5]), 6, "re", "im")


def correlation_lengths(spark, sf):
    return measures.correlation_length(measures.autocorrelation(_series(spark, sf), "capture", list(range(0, 4))), "capture", 0.05)


def power_spectra(spark, sf):
    return _rounded(measures.spectra(sq._blocks(spark, sf), "capture", S, "power"), 3, "power").select("capture", "bin", "power", "segments")


def symbol_lines(spark, sf):
    return _rounded(measures.strongest_line(measures.spectra(sq._blocks(spark, sf), "capture", S, "power"), "capture", 2, S // 2), 4, "ratio")


def occupied_bands(spark, sf):
    return _rounded(measures.occupied_band(measures.spectra(sq._blocks(spark, sf), "capture", S), "capture", S, 0.8), 3, "floor")


def median_lines(spark, sf):
    return _rounded(measures.median_filtered(sq._blocks(spark, sf), "capture", 2), 5, "value").withColumnRenamed("at", "pos")


def smoothed_lines(spark, sf):
    return _rounded(measures.weighted(sq._blocks(spark, sf), "capture", measures.smoothing_taps(2)), 7, "value").withColumnRenamed("at", "pos")


def code_words(spark, sf):
    book = spark.createDataFrame([(w, i, float(v), 0.0) for w, vs in BOOK for i, v in enumerate(vs)], "word string, place int, re double, im double")
    return _rounded(measures.likeliest_words(_series(spark, sf), "capture", book, 4), 5, "share")


def price_thresholds(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return _rounded(measures.two_class_threshold(li, "l_returnflag", "l_extendedprice", 32), 3, "threshold", "between")


def _rings(spark, sf):
    """A triangle north-east of each supplier."""
    p = tq._places(spark, sf, "supplier", "s_suppkey", "s_acctbal")
    corners = F.array(*[F.struct(F.lit(i).alias("nth"), (F.col("lat") + a).alias("lat"), (F.col("lon") + o).alias("lon")) for i, (a, o) in enumerate(((0.0, 0.0), (0.3, 0.1), (0.1, 0.4)))])
    return p.select(F.col("id").alias("ring"), F.explode(corners).alias("c")).select("ring", "c.*")


def customers_in_rings(spark, sf):
    points = tq._places(spark, sf).select("id", (F.col("lon") + 0.0013).alias("x"), (F.col("lat") + 0.0017).alias("y"))
    corners = _rings(spark, sf).select("ring", "nth", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return measures.in_rings(points, corners, 0.1)


def ring_areas(spark, sf):
    """Areas of the rings whose number divides by three."""
    return _rounded(measures.ring_areas(_rings(spark, sf).filter("ring % 3 = 0")), 0, "m2")


def terrain_losses(spark, sf):
    """The lines of an order as ground between two masts 40 kilometres apart."""
    li = _t(spark, sf, "lineitem")
    profile = li.select(
        "l_orderkey", (F.col("l_linenumber") * 5000 + F.col("l_partkey") % 1000).cast("double").alias("d"), (F.col("l_quantity") * 4).cast("double").alias("h"),
        F.lit(40_000.0).alias("span"), F.lit(90.0).alias("tx"), F.lit(60.0).alias("rx")
    )
    return _rounded(measures.bullington_losses(profile, "l_orderkey", 446e6), 4, "loss_db")


def calibrated_prices(spark, sf):
    """The chance that a line is returned by its discount: the fitted curve at each discount."""
    li = _t(spark, sf, "lineitem").select(F.col("l_discount").cast("double").alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    a, b = measures.platt(li, "s", "y", 3)
    return _rounded(measures.with_chance(li.select("s").distinct(), "s", a, b), 6, "chance")


def sentence_figures(spark, sf):
    return wording.sentence_figures(_t(spark, sf, "documents"), "doc_id", "text")


def cased_items(spark, sf):
    """Benchmark items, lower-cased, in the documents' usual casing."""
    found = wording.cased(_t(spark, sf, "benchmark"), "item_id", "text", wording.casing(_t(spark, sf, "documents"), "text"))
    return found.select(F.col("id").alias("item_id"), F.md5("text").alias("text_md5"))


def closed_up_turns(spark, sf):
    c = _t(spark, sf, "conversations")
    spread = F.regexp_replace(F.coalesce("text", F.lit("")), r"([.,!?;:()])", " $1 ")
    return c.select("conv_id", "turn", F.md5(wording.closed_up(spread)).alias("text_md5"))


def missing_terms(spark, sf):
    """The commonest long words of the benchmark as terms that the next turn of a conversation must repeat."""
    c = _t(spark, sf, "conversations")
    pairs = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "text").join(
        c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")), ["conv_id", "turn"]
    )
    words = _t(spark, sf, "benchmark").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0))).alias("term"))
    terms = words.filter(F.length("term") > 4).groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("term", F.col("term").alias("wanted"))
    return wording.missing_terms(pairs, "id", "text", "answer", terms)


def last_objects(spark, sf):
    e = _t(spark, sf, "events")
    said = F.concat(F.lit("first {\"k\": -1} then "), F.col("props"), F.lit(" and { no end"))
    return e.select("event_id", F.get_json_object(wording.last_object(said), "$.k").alias("k"))


def near_hosts(spark, sf):
    """Hosts of pages one edit from another host."""
    host = F.regexp_extract("url", r"://([^/]+)", 1)
    p = _t(spark, sf, "pages").select(host.alias("host")).filter("host <> ''").distinct()
    found = wording.near_names(p.select(F.col("host").alias("id"), F.col("host").alias("name")), p.select(F.col("host").alias("known")), 1)
    return found.filter("name <> known").select("name", "known", "edits")


def filled_lines(spark, sf):
    """Prices of each capture without those of line 7, which are predicted from the others around."""
    x = sq._samples(spark, sf, "l_linenumber").select("capture", "at", F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("x")).alias("x"))
    found = series.filled(series.blocks_of(x, "capture", "at", S, F.col("x")), "capture", S, 4, 8, 40)
    return found.filter("inferred").select("capture", F.col("at").alias("pos"), "value")


def balance_variograms(spark, sf):
    """The curve through the variogram of the customers' balances."""
    return spatial.fitted_variogram(spatial.variogram(tq._places(spark, sf), [0, 2_000, 5_000, 10_000, 15_000], 0.25))


QUERIES = {
    f.__name__: f for f in (
        series_impairments, series_corrected, series_cumulants, series_correlations, correlation_lengths, power_spectra, symbol_lines, occupied_bands, median_lines,
        smoothed_lines, code_words, price_thresholds, customers_in_rings, ring_areas, terrain_losses, calibrated_prices, sentence_figures, cased_items,
        closed_up_turns, missing_terms, last_objects, near_hosts, filled_lines, balance_variograms
    )
}

_Z = f"{sq._S}, m AS (SELECT capture, avg(x) AS mx, avg(y) AS my FROM s GROUP BY capture), z AS (SELECT s.capture, pos, x - mx AS i, y - my AS q, mx, my FROM s JOIN m ON m.capture = s.capture)"
_IMP = f"""{_Z}, a AS (SELECT capture, count(*) AS n, any_value(mx) AS dc_re, any_value(my) AS dc_im, avg(i * i) AS ii, avg(q * q) AS qq, avg(i * q) AS iq FROM z GROUP BY capture),
    imp AS (SELECT *, sqrt(qq / ii) AS gain, asin(greatest(-1, least(1, iq / sqrt(ii * qq)))) AS phase FROM a)"""
_CORR = f"""{_Z}, p AS (SELECT capture, sum(i * i + q * q) AS p FROM z GROUP BY capture),
    c AS (SELECT a.capture, lag, sum(b.i * a.i + b.q * a.q) AS r, sum(b.q * a.i - b.i * a.q) AS s FROM z AS a JOIN (SELECT unnest([{{lags}}]) AS lag) AS l ON true
        JOIN z AS b ON b.capture = a.capture AND b.pos = a.pos + lag GROUP BY ALL),
    r AS (SELECT c.capture, lag, r / p AS re, s / p AS im FROM c JOIN p ON p.capture = c.capture)"""


def _spectrum(re: str, im: str, mean: bool) -> str:
    """Spectrum of an expression of x and y over the whole segments, as ``f``: capture, bin, power, segments."""
    take = "- avg({v}) OVER (PARTITION BY capture, seg)" if mean else ""
    return f"""{sq._SEGMENTS}, v AS (SELECT capture, seg, pos % {S} AS i, {re} {take.format(v=re)} AS cr, {im} AS ci, {sq._WINDOW.format(n=S - 1)} AS h
        FROM (SELECT *, pos % {S} AS i FROM w)),
    d AS (SELECT capture, seg, k AS bin, sum(h * (cr * cos(2 * pi() * k * i / {S}) + ci * sin(2 * pi() * k * i / {S}))) AS re,
        sum(h * (ci * cos(2 * pi() * k * i / {S}) - cr * sin(2 * pi() * k * i / {S}))) AS im, sum(h * h) AS scale FROM v JOIN range(0, {S}) AS r(k) ON true GROUP BY ALL),
    f AS (SELECT capture, bin::INTEGER AS bin, avg((re * re + im * im) / scale) AS power, count(*) AS segments FROM d GROUP BY capture, bin)"""


_POWER = _spectrum("(x * x + y * y)", "0", True)
_PLAIN = _spectrum("x", "y", False)
_BOOK = ", ".join(f"('{w}', {i}, {v})" for w, vs in BOOK for i, v in enumerate(vs))
_TAPS = " + ".join(f"({t!r}) * coalesce(lag(x, {-k}) OVER o, 0)" if k < 0 else f"({t!r}) * coalesce(lead(x, {k}) OVER o, 0)" for k, t in zip(range(-2, 3), measures.smoothing_taps(2), strict=True))
_TRI = "t AS (SELECT id AS ring, unnest([0, 1, 2]) AS nth, lat + unnest([0.0, 0.3, 0.1]) AS lat, lon + unnest([0.0, 0.1, 0.4]) AS lon FROM (SELECT s_suppkey AS id, 50 + (s_suppkey * 37 % 211) / 100 AS lat, 5 + (s_suppkey * 91 % 307) / 100 AS lon FROM supplier{where}))"
_EDGES = "e AS (SELECT a.ring, a.{x} AS ax, a.{y} AS ay, b.{x} AS cx, b.{y} AS cy FROM {t} AS a JOIN {t} AS b ON b.ring = a.ring AND b.nth = (a.nth + 1) % 3)"


def _newton(k: int) -> str:
    """One Newton step from the table n{k-1} (a, b) to n{k}."""
    return f"""q{k} AS (SELECT s, y, n, 1 / (1 + exp(-(a * s + b))) AS p FROM g, n{k - 1}),
        h{k} AS (SELECT sum(n * (p - y) * s) AS ga, sum(n * (p - y)) AS gb, sum(n * p * (1 - p) * s * s) + 1e-9 AS aa, sum(n * p * (1 - p) * s) AS ab, sum(n * p * (1 - p)) + 1e-9 AS bb FROM q{k}),
        n{k} AS (SELECT a - (bb * ga - ab * gb) / (aa * bb - ab * ab) AS a, b - (aa * gb - ab * ga) / (aa * bb - ab * ab) AS b FROM n{k - 1}, h{k})"""


_SPLIT = "list_filter(regexp_split_to_array(coalesce({t}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_TAIL = "[.,!?;:]+$"

ORACLE_SQL = {
    "series_impairments": f"""
        WITH {_IMP} SELECT capture, n, round(dc_re, 5) AS dc_re, round(dc_im, 5) AS dc_im, round(ii + qq, 5) AS power, round(gain, 5) AS gain, round(phase, 5) AS phase,
            round(sqrt(pow(ii - qq, 2) + 4 * iq * iq) / (ii + qq), 5) AS circularity FROM imp""",
    "series_corrected": f"""
        WITH {_IMP}, y AS (SELECT z.capture, i, (q / gain - i * sin(phase)) / cos(phase) AS r FROM z JOIN imp ON imp.capture = z.capture)
        SELECT capture, round(avg(i * i), 4) AS ii, round(avg(r * r), 4) AS qq, round(avg(i * r), 4) + 0.0 AS iq FROM y GROUP BY capture""",
    "series_cumulants": f"""
        WITH {_Z}, v AS (SELECT capture, i * i - q * q AS sr, 2 * i * q AS si, i * i + q * q AS p FROM z),
        g AS (SELECT capture, avg(sr) AS a, avg(si) AS b, avg(p) AS p, avg(sr * sr - si * si) AS fr, avg(2 * sr * si) AS fi, avg(sr * p) AS tr, avg(si * p) AS ti, avg(p * p) AS pp
            FROM v GROUP BY capture)
        SELECT capture, round(sqrt(a * a + b * b) / p, 5) AS c20, round(sqrt(pow(fr - 3 * (a * a - b * b), 2) + pow(fi - 6 * a * b, 2)) / (p * p), 5) AS c40,
            round(sqrt(pow(tr - 3 * a * p, 2) + pow(ti - 3 * b * p, 2)) / (p * p), 5) AS c41, round((pp - a * a - b * b - 2 * p * p) / (p * p), 5) AS c42 FROM g""",
    "series_correlations": f"WITH {_CORR.format(lags='1, 2, 5')} SELECT capture, lag, round(re, 6) AS re, round(im, 6) AS im FROM r",
    "correlation_lengths": f"WITH {_CORR.format(lags='0, 1, 2, 3')} SELECT capture, min(CASE WHEN sqrt(re * re + im * im) < 0.05 THEN lag END) AS length FROM r GROUP BY capture",
    "power_spectra": f"WITH {_POWER} SELECT capture, bin, round(power, 3) AS power, segments FROM f",
    "symbol_lines": f"""
        WITH {_POWER}, b AS (SELECT * FROM f WHERE bin BETWEEN 2 AND {S // 2})
        SELECT capture, arg_min(bin, (-round(power, 9), bin)) AS bin, round(max(round(power, 9)) / avg(power), 4) AS ratio FROM b GROUP BY capture""",
    "occupied_bands": f"""
        WITH {_PLAIN}, m AS (SELECT *, median(power) OVER (PARTITION BY capture) AS floor, CASE WHEN 2 * bin >= {S} THEN bin - {S} ELSE bin END AS pos FROM f),
        u AS (SELECT *, sum(greatest(power - floor, 0)) OVER (PARTITION BY capture ORDER BY pos) AS upto, sum(greatest(power - floor, 0)) OVER (PARTITION BY capture) AS total FROM m)
        SELECT capture, round(any_value(floor), 3) AS floor, min(CASE WHEN upto >= 0.1 * total * (1 - 1e-12) THEN pos END)::INTEGER AS low,
            min(CASE WHEN upto >= 0.9 * total * (1 - 1e-12) THEN pos END)::INTEGER AS high FROM u WHERE total > 0 GROUP BY capture""",
    "median_lines": f"WITH {sq._S} SELECT capture, pos, round(median(x) OVER (PARTITION BY capture ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) AS value FROM s",
    "smoothed_lines": f"WITH {sq._S} SELECT capture, pos, round({_TAPS}, 7) AS value FROM s WINDOW o AS (PARTITION BY capture ORDER BY pos)",
    "code_words": f"""
        WITH {sq._S}, k AS (SELECT * FROM (VALUES {_BOOK}) AS k(word, place, v)),
        f AS (SELECT capture, pos // 4 AS symbol, word, round((pow(sum(x * k.v), 2) + pow(sum(y * k.v), 2)) / 4, 9) AS f FROM s JOIN k ON pos % 4 = place GROUP BY ALL),
        p AS (SELECT capture, pos // 4 AS symbol, sum(x * x + y * y) AS p FROM s GROUP BY ALL)
        SELECT f.capture, f.symbol, arg_min(word, (-f, word)) AS word, round(max(f) / any_value(p), 5) AS share FROM f JOIN p ON p.capture = f.capture AND p.symbol = f.symbol
        GROUP BY f.capture, f.symbol""",
    "price_thresholds": """
        WITH v AS (SELECT l_returnflag, l_extendedprice AS v, min(l_extendedprice) OVER w AS lo, max(l_extendedprice) OVER w AS hi FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)),
        c AS (SELECT l_returnflag, lo, hi, least(floor((v - lo) / (hi - lo) * 32), 31) AS c, count(*) AS n FROM v GROUP BY ALL),
        r AS (SELECT *, sum(n) OVER o AS w0, sum(n * c) OVER o AS s0, sum(n) OVER e AS t, sum(n * c) OVER e AS s FROM c
            WINDOW o AS (PARTITION BY l_returnflag ORDER BY c), e AS (PARTITION BY l_returnflag)),
        b AS (SELECT *, round(w0 * (t - w0) * pow(s0 / w0 - (s - s0) / (t - w0), 2) / pow(t, 2), 9) AS b FROM r WHERE t > w0)
        SELECT l_returnflag, round(arg_min(lo + (c + 1) * (hi - lo) / 32, (-b, c)), 3) AS threshold, round(max(b), 3) AS between FROM b GROUP BY l_returnflag""",
    "customers_in_rings": f"""
        WITH {_TRI.format(where='')}, {_EDGES.format(x='lon', y='lat', t='t')},
        p AS (SELECT c_custkey AS id, 5 + (c_custkey * 91 % 307) / 100 + 0.0013 AS x, 50 + (c_custkey * 37 % 211) / 100 + 0.0017 AS y FROM customer)
        SELECT id, ring FROM p JOIN e ON (ay > y) <> (cy > y) AND x < ax + (y - ay) / (cy - ay) * (cx - ax) GROUP BY id, ring HAVING count(*) % 2 = 1""",
    "ring_areas": f"""
        WITH {_TRI.format(where=' WHERE s_suppkey % 3 = 0')}, c AS (SELECT *, avg(lat) OVER (PARTITION BY ring) AS a, avg(lon) OVER (PARTITION BY ring) AS o FROM t),
        f AS (SELECT ring, nth, radians(lon - o) * 6371000.0 * cos(radians(a)) AS x, radians(lat - a) * 6371000.0 AS y FROM c), {_EDGES.format(x='x', y='y', t='f')}
        SELECT ring, round(abs(sum(ax * cy - cx * ay)) / 2, 0) AS m2 FROM e GROUP BY ring""",
    "terrain_losses": f"""
        WITH p AS (SELECT l_orderkey, (l_linenumber * 5000 + l_partkey % 1000)::DOUBLE AS d, l_quantity * 4 AS g FROM lineitem),
        h AS (SELECT *, g + d * (40000.0 - d) / (2 * 4.0 / 3 * 6371000.0) AS h FROM p WHERE d > 0 AND d < 40000),
        m AS (SELECT l_orderkey, max((h - 90) / d) AS up, max((h - 60) / (40000 - d)) AS down,
            max((h - (90 - 30 * d / 40000)) * sqrt(80000 / ({299_792_458.0 / 446e6!r} * d * (40000 - d)))) AS near FROM h GROUP BY l_orderkey),
        v AS (SELECT *, (60 + down * 40000 - 90) / (up + down) AS x FROM m),
        w AS (SELECT l_orderkey, CASE WHEN up < -30.0 / 40000 THEN near ELSE (90 + up * x - (90 - 30 * x / 40000)) * sqrt(80000 / ({299_792_458.0 / 446e6!r} * x * (40000 - x))) END AS v FROM v),
        k AS (SELECT l_orderkey, CASE WHEN v > -0.78 THEN 6.9 + 20 * log10(sqrt(pow(v - 0.1, 2) + 1) + v - 0.1) ELSE 0 END AS e FROM w)
        SELECT l_orderkey, round(e + (1 - exp(-e / 6)) * 10.8, 4) AS loss_db FROM k""",
    "calibrated_prices": f"""
        WITH g AS (SELECT l_discount::DOUBLE AS s, (l_returnflag = 'R')::INT AS y, count(*) AS n FROM lineitem GROUP BY ALL), n0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b),
        {_newton(1)}, {_newton(2)}, {_newton(3)}
        SELECT DISTINCT s, round(1 / (1 + exp(-(a * s + b))), 6) AS chance FROM g, n3""",
    "sentence_figures": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents),
        s AS (SELECT doc_id, unnest(string_split(regexp_replace(l, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM l),
        t AS (SELECT doc_id AS id, trim(s, ' ') AS s FROM s)
        SELECT id, count(*) AS sentences, max(length(s))::INTEGER AS longest, sum((s[-1:] = '?')::INT)::BIGINT AS questions FROM t WHERE s <> '' GROUP BY id""",
    "cased_items": f"""
        WITH d AS (SELECT {_SPLIT.format(t='text')} AS w FROM documents),
        i AS (SELECT regexp_replace(w[k], '{_TAIL}', '') AS form FROM (SELECT w, unnest(range(2, len(w) + 1)) AS k FROM d) WHERE NOT regexp_matches(w[k - 1], '[.!?]$')),
        c AS (SELECT form, count(*) AS n FROM i WHERE form <> '' GROUP BY form), model AS (SELECT lower(form) AS lo, arg_min(form, (-n, form)) AS form FROM c GROUP BY 1),
        b AS (SELECT item_id, k, lower(w[k]) AS x, k = 1 OR regexp_matches(w[greatest(k - 1, 1)], '[.!?]$') AS first FROM (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS k
            FROM (SELECT item_id, {_SPLIT.format(t='text')} AS w FROM benchmark))),
        p AS (SELECT item_id, k, first, regexp_replace(x, '{_TAIL}', '') AS lo, regexp_extract(x, '{_TAIL}', 0) AS tail FROM b),
        f AS (SELECT item_id, k, first, coalesce(form, p.lo) AS form, tail FROM p LEFT JOIN model ON model.lo = p.lo)
        SELECT item_id, md5(string_agg(CASE WHEN first THEN upper(form[1:1]) || form[2:] ELSE form END || tail, ' ' ORDER BY k)) AS text_md5 FROM f GROUP BY item_id""",
    "closed_up_turns": r"""
        WITH s AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '([.,!?;:()])', ' \1 ', 'g') AS t FROM conversations),
        o AS (SELECT conv_id, turn, regexp_replace(trim(t, ' '), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM s)
        SELECT conv_id, turn, md5(regexp_replace(regexp_replace(t, ' ([.,!?;:%)\]}])', '\1', 'g'), '([(\[{]) ', '\1', 'g')) AS text_md5 FROM o""",
    "missing_terms": r"""
        WITH b AS (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+'))) AS term FROM benchmark),
        g AS (SELECT term FROM b WHERE length(term) > 4 GROUP BY term HAVING count(*) > 1),
        p AS (SELECT a.conv_id * 1000 + a.turn AS id, regexp_extract_all(lower(coalesce(a.text, '')), '[\p{L}\p{N}]+') AS x, regexp_extract_all(lower(coalesce(b.text, '')), '[\p{L}\p{N}]+') AS y
            FROM conversations AS a JOIN conversations AS b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
        q AS (SELECT id, y, unnest(list_distinct(x)) AS term FROM p)
        SELECT id, q.term, q.term AS wanted FROM q JOIN g ON g.term = q.term WHERE NOT list_contains(y, q.term)""",
    "last_objects": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "near_hosts": r"""
        WITH h AS (SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS h FROM pages)
        SELECT a.h AS name, b.h AS known, levenshtein(a.h, b.h)::INTEGER AS edits FROM h AS a JOIN h AS b ON a.h <> b.h AND a.h <> '' AND b.h <> '' AND levenshtein(a.h, b.h) <= 1""",
}
