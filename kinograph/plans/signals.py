"""Queries of the signal family: windows, spectra, correlation, resampling, curves, exact arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.functions import curves as K
from kinograph.operators import signal
from kinograph.operators.joins import asof
from kinograph.plans.registry import query
from kinograph.sources.tables import PACKETS, PIXELS, SAMPLES, packets, pcm, pixels, table


@query(
    "window_functions",
    """WITH i AS (SELECT range AS i, 2 * pi() * range / 63.0::DOUBLE AS t FROM range(0, 64)) SELECT i, round(0.5::DOUBLE * (1 - cos(t)), 6) AS hann, round(0.54::DOUBLE - 0.46::DOUBLE * cos(t), 6) AS hamming,
round(0.35875::DOUBLE - 0.48829::DOUBLE * cos(t) + 0.14128::DOUBLE * cos(2 * t) - 0.01168::DOUBLE * cos(3 * t), 6) AS blackman_harris FROM i""",
)
def window_functions(spark, d):
    i = F.col("id")
    return spark.range(64).select(i.alias("i"), *[F.round(f(i, 64), 6).alias(f.__name__) for f in (K.hann, K.hamming, K.blackman_harris)])


@query(
    "kaiser_window",
    """WITH i AS (SELECT range AS i, 6 * sqrt(greatest(0, 1 - power(2 * range / 32.0::DOUBLE - 1, 2))) AS z FROM range(0, 33)), t AS (SELECT i, z, k.range AS k, list_product([z / 2 / j for j in range(1, k.range + 1)]) AS p, list_product([3.0::DOUBLE / j for j in range(1, k.range + 1)]) AS q FROM i, range(0, 20) k)
SELECT i, round(sum(CASE WHEN k = 0 THEN 1 ELSE p * p END) / sum(CASE WHEN k = 0 THEN 1 ELSE q * q END), 6) AS w FROM t GROUP BY i""",
)
def kaiser_window(spark, d):
    return spark.range(33).select(F.col("id").alias("i"), F.round(K.kaiser(F.col("id"), 33), 6).alias("w"))


@query("dft_magnitude", f"WITH {SAMPLES} SELECT s.source_id, k.range AS k, round(sqrt(power(sum(s.x * cos(2 * pi() * k.range * s.i / 64.0::DOUBLE)), 2) + power(sum(s.x * sin(2 * pi() * k.range * s.i / 64.0::DOUBLE)), 2)), 5) AS magnitude FROM samples s, range(0, 33) k GROUP BY 1, 2")
def dft_magnitude(spark, d):
    out = pcm(spark, d).select("source_id", F.posexplode(signal.dft_magnitude(F.col("x"), 64)).alias("k", "m"))
    return out.select("source_id", F.col("k").cast("long").alias("k"), F.round("m", 5).alias("magnitude"))


@query(
    "spectral_flux",
    f"""WITH {SAMPLES}, f AS (SELECT s.source_id, fr.range AS fr, k.range AS k, sqrt(power(sum(s.x * cos(2 * pi() * k.range * (s.i - fr.range * 8) / 16.0::DOUBLE)), 2) + power(sum(s.x * sin(2 * pi() * k.range * (s.i - fr.range * 8) / 16.0::DOUBLE)), 2)) AS m
FROM samples s, range(0, 7) fr, range(0, 9) k WHERE s.i >= fr.range * 8 AND s.i < fr.range * 8 + 16 GROUP BY 1, 2, 3)
SELECT b.source_id, b.fr AS frame, round(sum(greatest(0, b.m - a.m)), 5) AS flux FROM f b JOIN f a ON a.source_id = b.source_id AND a.k = b.k AND a.fr = b.fr - 1 GROUP BY 1, 2""",
)
def spectral_flux(spark, d):
    from kinograph.operators.sequences import hops

    frames = F.transform(hops(F.col("x"), 16, 8), lambda f: signal.dft_magnitude(f["samples"], 16))
    rows = pcm(spark, d).select("source_id", F.posexplode(frames).alias("frame", "m"))
    was = F.lag("m").over(Window.partitionBy("source_id").orderBy("frame"))
    return rows.withColumn("was", was).where("was is not null").select("source_id", F.col("frame").cast("long").alias("frame"), F.round(signal.spectral_flux(F.col("m"), F.col("was")), 5).alias("flux"))


@query(
    "xcorr_lag",
    f"""WITH {SAMPLES}, c AS (SELECT a.source_id, k.range - 16 AS k, CAST(floor(sum(a.x * b.x) * 1000000 + 0.5::DOUBLE) AS BIGINT) AS c FROM samples a, range(0, 33) k, samples b WHERE b.source_id = a.source_id + 1 AND b.i = a.i + k.range - 16 GROUP BY 1, 2)
SELECT source_id, k AS lag, c FROM c QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY c DESC, k) = 1""",
)
def xcorr_lag(spark, d):
    follow = pcm(spark, d).select((F.col("source_id") - 1).alias("source_id"), F.col("x").alias("y"))
    scored = F.transform(signal.correlation(F.col("x"), F.col("y"), 16), lambda s: F.struct(F.floor(s["c"] * 1_000_000 + 0.5).alias("c"), (-s["k"]).alias("k")))
    best = pcm(spark, d).join(follow, "source_id").select("source_id", F.array_max(scored).alias("b"))
    return best.select("source_id", (-F.col("b.k")).cast("long").alias("lag"), "b.c")


@query("linear_resample", f"WITH {SAMPLES}, k AS (SELECT range AS k, range * 64 / 48.0::DOUBLE AS pos, CAST(floor(range * 64 / 48.0::DOUBLE) AS BIGINT) AS i FROM range(0, 48)) SELECT source_id, k, round(a[i + 1] + (a[least(i + 1, 63) + 1] - a[i + 1]) * (pos - i), 6) AS x FROM pcm, k")
def linear_resample(spark, d):
    out = pcm(spark, d).select("source_id", F.posexplode(signal.linear_resample(F.col("x"), 48)).alias("k", "x"))
    return out.select("source_id", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"))


@query("sinc_resample")
def sinc_resample(spark, d):
    out = pcm(spark, d).select("source_id", F.posexplode(signal.sinc_resample(F.col("x"), 0.75)).alias("k", "x"))
    return out.select("source_id", F.col("k").cast("long").alias("k"), F.round("x", 6).alias("x"))


@query("frame_pts_rational", f"WITH {PACKETS} SELECT event_id, event_id * 1001000000 // 30000 AS ntsc, event_id * 1000000 // 25 AS pal FROM packets")
def frame_pts_rational(spark, d):
    return packets(spark, d).select("event_id", K.frame_micros(F.col("event_id"), 29.97).alias("ntsc"), K.frame_micros(F.col("event_id"), 25).alias("pal"))


@query("sign_extend_cts", f"WITH {PIXELS}, c AS (SELECT p, r * 65536 + g * 256 + b AS c FROM pixels) SELECT p, CASE WHEN c >= 8388608 THEN c - 16777216 ELSE c END AS cts FROM c")
def sign_extend_cts(spark, d):
    return pixels(spark, d).select("p", K.sign_extend(F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("cts"))


@query("pcm_quantize_i16", f"WITH {SAMPLES}, c AS (SELECT source_id, i, greatest(-1, least(1, x * 3)) AS c FROM samples) SELECT source_id, i, CAST(trunc(CASE WHEN c < 0 THEN c * 32768 ELSE c * 32767 END) AS INT) AS v FROM c")
def pcm_quantize_i16(spark, d):
    out = F.transform("x", lambda v: K.pcm_int16(v * 3))
    return pcm(spark, d).select("source_id", F.posexplode(out).alias("i", "v"))


@query("gcd_rates", f"WITH {PIXELS} SELECT p, gcd(r * 100 + 1, g * 10 + 4) AS g FROM pixels")
def gcd_rates(spark, d):
    return pixels(spark, d).select("p", K.gcd(F.col("r") * 100 + 1, F.col("g") * 10 + 4).alias("g"))


POINTS = [(0.0, 0.0), (100.0, 50.0), (200.0, -30.0), (320.0, 80.0), (400.0, 0.0)]


def spline_sql(axis: int) -> str:
    v = "[" + ", ".join(f"{p[axis]}::DOUBLE" for p in POINTS) + "]"
    p = lambda k: f"{v}[least(5, greatest(1, seg + {k}))]"
    return f"0.5::DOUBLE * (2 * {p(1)} + ({p(2)} - {p(0)}) * u + (2 * {p(0)} - 5 * {p(1)} + 4 * {p(2)} - {p(3)}) * u * u + (3 * {p(1)} - {p(0)} - 3 * {p(2)} + {p(3)}) * u * u * u)"


@query(
    "catmull_rom_point",
    f"""WITH s AS (SELECT range AS k, least(3, range * 4 // 200) AS seg, range * 4 / 200.0::DOUBLE - least(3, range * 4 // 200) AS u FROM range(0, 201)), c AS (SELECT k, {spline_sql(0)} AS x, {spline_sql(1)} AS y FROM s),
l AS (SELECT k, x, y, coalesce(sum(d) OVER (ORDER BY k), 0) AS len FROM (SELECT *, sqrt(power(x - lag(x) OVER (ORDER BY k), 2) + power(y - lag(y) OVER (ORDER BY k), 2)) AS d FROM c)),
q AS (SELECT range AS q, range / 20.0::DOUBLE * (SELECT max(len) FROM l) AS want FROM range(0, 20)), n AS (SELECT *, lead(x) OVER (ORDER BY k) AS x2, lead(y) OVER (ORDER BY k) AS y2, lead(len) OVER (ORDER BY k) AS len2 FROM l)
SELECT q.q, round(n.x + (n.x2 - n.x) * (want - len) / (len2 - len), 4) AS x, round(n.y + (n.y2 - n.y) * (want - len) / (len2 - len), 4) AS y FROM q ASOF JOIN n ON q.want >= n.len""",
)
def catmull_rom_point(spark, d):
    """Twenty points at even arc lengths of a spline: a table of 201 arc lengths, as-of joined and interpolated."""
    seg = F.least(F.lit(3), F.expr("id * 4 div 200")).cast("int")
    u = F.col("id") * 4 / 200.0 - seg

    def axis(a: int):
        values = F.array(*[F.lit(p[a]) for p in POINTS])
        p = [F.get(values, F.least(F.lit(4), F.greatest(F.lit(0), seg + k - 1))) for k in range(4)]
        return F.lit(0.5) * (p[1] * 2 + (p[2] - p[0]) * u + (p[0] * 2 - p[1] * 5 + p[2] * 4 - p[3]) * u * u + (p[1] * 3 - p[0] - p[2] * 3 + p[3]) * u * u * u)

    one = Window.partitionBy("path").orderBy("k")
    curve = spark.range(201).select(F.lit(0).alias("path"), F.col("id").alias("k"), axis(0).alias("x"), axis(1).alias("y"))
    step = F.hypot(F.col("x") - F.lag("x").over(one), F.col("y") - F.lag("y").over(one))
    arc = curve.withColumn("d", F.coalesce(step, F.lit(0.0))).withColumn("len", F.sum("d").over(one))
    arc = arc.withColumns({"x2": F.lead("x").over(one), "y2": F.lead("y").over(one), "len2": F.lead("len").over(one)})
    total = arc.agg(F.max("len").alias("total"))
    asked = spark.range(20).join(F.broadcast(total)).select(F.lit(0).alias("path"), F.col("id").alias("q"), (F.col("id") / 20.0 * F.col("total")).alias("want"))
    found = asof(asked, arc, ["path"], "want", "len", ["len", "x", "y", "x2", "y2", "len2"])
    share = (F.col("want") - F.col("len")) / (F.col("len2") - F.col("len"))
    return found.select("q", F.round(F.col("x") + (F.col("x2") - F.col("x")) * share, 4).alias("x"), F.round(F.col("y") + (F.col("y2") - F.col("y")) * share, 4).alias("y"))


@query("fnv1a", "SELECT p_partkey AS p, list_reduce(list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM part")
def fnv1a(spark, d):
    from kinograph.functions.text import fnv1a as hashed

    return table(spark, d, "part").select(F.col("p_partkey").alias("p"), hashed(F.col("p_name")).alias("h"))


#: A track's values, and the same some places later, three quarters in one place and a quarter in the next.
LATER = f"""{PACKETS}, r AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY pts, event_id) - 1 AS i, value - 250 AS x FROM packets),
t AS (SELECT track, i, sum(x) AS x FROM (SELECT track, i + 1 + track % 5 AS i, x * 0.75::DOUBLE AS x FROM r UNION ALL SELECT track, i + 2 + track % 5, x * 0.25::DOUBLE FROM r) GROUP BY ALL)"""


@query(
    "xcorr_peak",
    f"""WITH {LATER}, c AS (SELECT r.track, t.i - r.i AS lag, sum(r.x * t.x) AS c FROM r JOIN t ON r.track = t.track AND abs(t.i - r.i) <= 16 GROUP BY ALL),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY track ORDER BY c DESC, lag < 0, lag) = 1),
n AS (SELECT b.*, p.c AS before, q.c AS after FROM b LEFT JOIN c p ON p.track = b.track AND p.lag = b.lag - 1 LEFT JOIN c q ON q.track = b.track AND q.lag = b.lag + 1),
s AS (SELECT *, lag + CASE WHEN lag NOT IN (0, -1) AND abs(before - 2 * c + after) > 1e-12 THEN (before - after) / (2 * (before - 2 * c + after)) ELSE 0 END AS sub FROM n)
SELECT s.track, lag, round(sub, 4) AS sub_lag, CAST(floor(sub + 0.5::DOUBLE) AS BIGINT) AS "offset", round(greatest(0, least(1, c / sqrt((SELECT sum(x * x) FROM r WHERE r.track = s.track) * (SELECT sum(x * x) FROM t WHERE t.track = s.track)))), 6) AS confidence FROM s""",
)
def xcorr_peak(spark, d):
    """Where each track and its delayed copy fit best, by overlapping blocks of 16 samples."""
    from kinograph.operators import carry, correlate

    p = packets(spark, d).select("track", "pts", "event_id", (F.col("value") - 250).alias("x"))
    r = carry.running_sum(p, ["track"], "pts", ["event_id"], {"n": F.lit(1)}).select("track", (F.col("n") - 1).alias("i"), "x")
    copies = F.explode(F.array(*[F.struct((F.col("i") + k + F.col("track") % 5).alias("i"), (F.col("x") * w).alias("x")) for k, w in ((1, 0.75), (2, 0.25))]))
    t = r.select("track", copies.alias("s")).groupBy("track", "s.i").agg(F.sum("s.x").alias("x"))
    found = correlate.peaks(r, t, ["track"], 16, size=16)
    return found.select("track", "lag", F.round("sub_lag", 4).alias("sub_lag"), "offset", F.round("confidence", 6).alias("confidence"))


@query(
    "fft_low_pass",
    f"""WITH {SAMPLES}, n AS (SELECT source_id, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS n FROM samples GROUP BY 1),
f AS (SELECT s.source_id, k.range AS k, n.n, sum(s.x * cos(2 * pi() * k.range * s.i / n.n)) AS re, -sum(s.x * sin(2 * pi() * k.range * s.i / n.n)) AS im FROM samples s JOIN n USING (source_id), range(0, 9) k GROUP BY ALL)
SELECT s.source_id, s.i, round(sum(CASE WHEN k = 0 THEN re ELSE 2 * (re * cos(2 * pi() * k * s.i / f.n) - im * sin(2 * pi() * k * s.i / f.n)) END) / any_value(f.n), 6) AS x FROM samples s JOIN f USING (source_id) GROUP BY ALL""",
)
def fft_low_pass(spark, d):
    """Forward, the nine lowest frequencies kept on both sides, and back: blocks of any length."""
    from kinograph.operators import correlate

    spectra = pcm(spark, d).where(F.size("x") > 0).select("source_id", F.size("x").alias("n"), correlate.fft(F.col("x")).alias("f"))
    low = lambda part: F.transform(part, lambda v, k: F.when((k <= 8) | (k >= F.size("f.re") - 8), v).otherwise(0.0))
    back = spectra.select("source_id", "n", correlate.inverse_fft(low(F.col("f.re")), low(F.col("f.im"))).alias("y"))
    return back.select("source_id", F.posexplode(F.slice("y", F.lit(1), F.col("n"))).alias("i", "x")).select("source_id", "i", F.round("x", 6).alias("x"))


@query(
    "imdct_overlap_add",
    f"""WITH {SAMPLES}, c AS (SELECT source_id, i // 16 AS b, i % 16 AS k, x FROM samples),
y AS (SELECT c.source_id, c.b, t.range AS t, sum(c.x * cos(pi() / 16 * (t.range + 0.5::DOUBLE + 8) * (c.k + 0.5::DOUBLE))) * sin(pi() / 32 * (t.range + 0.5::DOUBLE)) * 2 / 16 AS y FROM c, range(0, 32) t GROUP BY c.source_id, c.b, t.range)
SELECT a.source_id, CAST(a.b AS BIGINT) AS block, CAST(a.t AS BIGINT) AS i, round(a.y + p.y, 6) AS x FROM y a JOIN y p ON p.source_id = a.source_id AND p.b = a.b - 1 AND p.t = a.t + 16 WHERE a.t < 16""",
)
def imdct_overlap_add(spark, d):
    """Blocks of 16 samples taken for coefficients, brought back to 32 windowed samples each, neighbours' halves added."""
    from kinograph.operators import correlate
    from kinograph.operators.sequences import hops

    parts = pcm(spark, d).select("source_id", F.posexplode(hops(F.col("x"), 16, 16)).alias("block", "h"))
    back = parts.select("source_id", F.col("block").cast("long").alias("block"), correlate.imdct_blocks(F.col("h.samples")).alias("y"))
    out = signal.overlap_add(back, ["source_id"], "block", "y")
    return out.select("source_id", "block", F.posexplode("y").alias("i", "x")).select("source_id", "block", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))
