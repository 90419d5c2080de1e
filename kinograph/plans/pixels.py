"""Queries of the pixel family: blending, keying, colour spaces, grading, geometry, bits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.functions import colour as C
from kinograph.plans.registry import query
from kinograph.sources.tables import CLIPS, PIXELS, SAMPLES, clips, pcm, pixels, table

UNIT = f"""{PIXELS}, px AS (SELECT p, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM pixels)"""


def unit(spark, d):
    return pixels(spark, d).select("p", *[(F.col(c) / 255.0).alias(c) for c in "rgb"])


BLEND_SQL = {
    "multiply": "a * b",
    "screen": "1 - (1 - a) * (1 - b)",
    "overlay": "CASE WHEN a < 0.5::DOUBLE THEN a * b * 2 ELSE 1 - (1 - a) * (1 - b) * 2 END",
    "darken": "least(a, b)",
    "lighten": "greatest(a, b)",
    "color-dodge": "CASE WHEN b >= 1 THEN 1 ELSE least(1, a / greatest(1e-9::DOUBLE, 1 - b)) END",
    "color-burn": "CASE WHEN b <= 0 THEN 0 ELSE 1 - least(1, (1 - a) / greatest(1e-9::DOUBLE, b)) END",
    "hard-light": "CASE WHEN b < 0.5::DOUBLE THEN a * b * 2 ELSE 1 - (1 - a) * (1 - b) * 2 END",
    "soft-light": "CASE WHEN b < 0.5::DOUBLE THEN a * b * 2 + a * a * (1 - b * 2) ELSE sqrt(a) * (b * 2 - 1) + a * 2 * (1 - b) END",
    "difference": "abs(a - b)",
    "exclusion": "a + b - a * b * 2",
    "add": "least(1, a + b)",
}


@query(
    "blend_modes",
    f"WITH {UNIT}, ab AS (SELECT p, r AS a, g AS b FROM px) " + " UNION ALL ".join(f"SELECT p, '{m}' AS mode, round(a + (({e}) - a) * 0.75::DOUBLE, 6) AS v FROM ab" for m, e in BLEND_SQL.items()),
)
def blend_modes(spark, d):
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.round(C.blend(m, F.col("r"), F.col("g"), 0.75), 6).alias("v")) for m in C.BLENDS])
    return unit(spark, d).select("p", F.explode(modes).alias("x")).select("p", "x.*")


@query(
    "composite_layers",
    f"""WITH RECURSIVE {CLIPS}, l AS (SELECT d.day, (c.clip_id * 37 % 256) / 255.0::DOUBLE AS v, 0.25::DOUBLE + c.clip_id % 3 * 0.25::DOUBLE AS alpha, row_number() OVER (PARTITION BY d.day ORDER BY c.layer, c.clip_id) AS n FROM (SELECT unnest(range(min(lo), max(hi))) AS day FROM clips) d JOIN clips c ON d.day >= c.lo AND d.day < c.hi),
f AS (SELECT DISTINCT day, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS v FROM l UNION ALL SELECT f.day, f.n + 1, f.v * (1 - l.alpha) + l.v * l.alpha FROM f JOIN l ON l.day = f.day AND l.n = f.n + 1 AND l.n <= 8)
SELECT day, max(n) AS layers, round(arg_max(v, n), 6) AS v FROM f GROUP BY day""",
)
def composite_layers(spark, d):
    """Every frame's first eight layers, laid over each other in order; no array holds more than eight."""
    from kinograph.operators.joins import grid_of

    rank = F.row_number().over(Window.partitionBy("day").orderBy("layer", "clip_id"))
    rows = grid_of(clips(spark, d).select("clip_id", "lo", "hi", "layer"), "lo", "hi", 1, "day").withColumn("n", rank).where("n <= 8")
    look = F.struct("n", ((F.col("clip_id") * 37 % 256) / 255.0).alias("v"), (F.lit(0.25) + F.col("clip_id") % 3 * 0.25).alias("alpha"))
    frames = rows.groupBy("day").agg(F.array_sort(F.collect_list(look)).alias("layers"))
    mixed = F.aggregate("layers", F.lit(0.0), lambda v, x: C.over(v, x["v"], x["alpha"]))
    return frames.select("day", F.size("layers").cast("long").alias("layers"), F.round(mixed, 6).alias("v"))


@query("chroma_key", f"WITH {PIXELS} SELECT p, CASE WHEN sqrt(0.0::DOUBLE + r * r + (g - 255) * (g - 255) + b * b) < 120 THEN 0 ELSE 255 END AS alpha FROM pixels")
def chroma_key(spark, d):
    away = C.chroma_distance(F.col("r"), F.col("g"), F.col("b"), (0, 255, 0))
    return pixels(spark, d).select("p", F.when(away < 120, 0).otherwise(255).alias("alpha"))


@query("luma_key", f"WITH {UNIT}, t AS (SELECT p, greatest(0::DOUBLE, least(1::DOUBLE, (r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE - 0.4::DOUBLE) / 0.2::DOUBLE)) AS t FROM px) SELECT p, round(t * t * (3 - 2 * t), 6) AS alpha FROM t")
def luma_key(spark, d):
    return unit(spark, d).select("p", F.round(C.luma_key(F.col("r"), F.col("g"), F.col("b"), 0.5, 0.1), 6).alias("alpha"))


@query(
    "yuv_to_rgb",
    f"""WITH {PIXELS}, c AS (SELECT p, (r - 16) / 219.0::DOUBLE AS y, (g - 128) / 224.0::DOUBLE AS u, (b - 128) / 224.0::DOUBLE AS v FROM pixels)
SELECT p, greatest(0, least(255, round_even((y + v * 1.5748::DOUBLE) * 255, 0))) AS red, greatest(0, least(255, round_even((y - u * (1.8556::DOUBLE * 0.0722::DOUBLE / 0.7152::DOUBLE) - v * (1.5748::DOUBLE * 0.2126::DOUBLE / 0.7152::DOUBLE)) * 255, 0))) AS green, greatest(0, least(255, round_even((y + u * 1.8556::DOUBLE) * 255, 0))) AS blue FROM c""",
)
def yuv_to_rgb(spark, d):
    red, green, blue = C.yuv_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return pixels(spark, d).select("p", red.alias("red"), green.alias("green"), blue.alias("blue"))


def graded(x):
    return f"power(greatest(0::DOUBLE, {x} * 1.1::DOUBLE + 0.05::DOUBLE * (1 - {x})), 1 / 1.2::DOUBLE)"


@query(
    "color_grade",
    f"WITH {UNIT}, l AS (SELECT *, r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE AS y FROM px) SELECT p, " + ", ".join(f"round(greatest(0, least(1, {graded('y')} + ({graded(c)} - {graded('y')}) * 1.3::DOUBLE)), 5) AS {c}" for c in "rgb") + " FROM l",
)
def color_grade(spark, d):
    grey = C.luma(F.col("r"), F.col("g"), F.col("b"))
    return unit(spark, d).select("p", *[F.round(C.grade(F.col(c), grey, 0.05, 1.2, 1.1, 1.3), 5).alias(c) for c in "rgb"])


@query("aces_tonemap", f"WITH {UNIT} SELECT p, " + ", ".join(f"round(greatest(0, least(1, ({c} * 1.5::DOUBLE * ({c} * 1.5::DOUBLE * 2.51::DOUBLE + 0.03::DOUBLE)) / ({c} * 1.5::DOUBLE * ({c} * 1.5::DOUBLE * 2.43::DOUBLE + 0.59::DOUBLE) + 0.14::DOUBLE))), 6) AS {c}" for c in "rgb") + " FROM px")
def aces_tonemap(spark, d):
    return unit(spark, d).select("p", *[F.round(C.aces(F.col(c), 1.5), 6).alias(c) for c in "rgb"])


@query("grayscale_brightness", f"WITH {PIXELS} SELECT p, least(255, round_even((r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) * 1.2::DOUBLE, 0)) AS v FROM pixels")
def grayscale_brightness(spark, d):
    return pixels(spark, d).select("p", F.least(F.lit(255.0), F.rint(C.luma(F.col("r"), F.col("g"), F.col("b")) * 1.2)).alias("v"))


@query("glitch_active", f"WITH {CLIPS} SELECT clip_id, floor(lo * 1000 / 700.0::DOUBLE) % 2 = 0 AS active FROM clips")
def glitch_active(spark, d):
    return clips(spark, d).select("clip_id", (F.floor(F.col("lo") * 1000 / 700.0) % 2 == 0).alias("active"))


@query(
    "fit_rect",
    f"""WITH {PIXELS}, s AS (SELECT p, r + 1.0::DOUBLE AS w, g + 1.0::DOUBLE AS h FROM pixels), k AS (SELECT p, w, h, 'contain' AS mode, least(320 / w, 180 / h) AS z FROM s UNION ALL SELECT p, w, h, 'cover', greatest(320 / w, 180 / h) FROM s)
SELECT p, mode, round((320 - w * z) / 2, 4) AS x, round((180 - h * z) / 2, 4) AS y, round(w * z, 4) AS w, round(h * z, 4) AS h FROM k UNION ALL SELECT p, 'stretch', 0, 0, 320, 180 FROM s""",
)
def fit_rect(spark, d):
    sw, sh = F.col("r") + 1.0, F.col("g") + 1.0
    rect = lambda m: F.struct(F.lit(m).alias("mode"), *[F.round(v, 4).alias(n) for n, v in zip("xywh", C.fit_rect(sw, sh, 320, 180, m))])
    return pixels(spark, d).select("p", F.explode(F.array(*[rect(m) for m in ("contain", "cover", "stretch")])).alias("q")).select("p", "q.*")


@query("ascii_ramp", f"WITH {UNIT} SELECT p, substr(' .:-=+*#%@', CAST(least(floor((r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) * 10), 9) AS INT) + 1, 1) AS ch FROM px")
def ascii_ramp(spark, d):
    at = F.least(F.floor(C.luma(F.col("r"), F.col("g"), F.col("b")) * 10), F.lit(9)).cast("int") + 1
    return unit(spark, d).select("p", F.substr(F.lit(" .:-=+*#%@"), at, F.lit(1)).alias("ch"))


@query("lsb_embed", f"WITH {PIXELS} SELECT p, r - r % 2 + (CAST(floor(ascii('K') / power(2, 7 - p % 8)) AS BIGINT)) % 2 AS r FROM pixels")
def lsb_embed(spark, d):
    """The bits of the letter K, written to the lowest bits of successive pixels."""
    bits = F.lpad(F.bin(F.ascii(F.lit("K"))), 8, "0")
    bit = F.substr(bits, (F.col("p") % 8 + 1).cast("int"), F.lit(1)).cast("long")
    return pixels(spark, d).select("p", (F.col("r").bitwiseAND(F.lit(-2)) + bit).alias("r"))


@query(
    "box_blur_1d",
    f"""WITH {SAMPLES}, o AS (SELECT k.range - 2 AS k FROM range(0, 5) k) SELECT s.source_id, s.i, round(avg(p.a[greatest(0, least(63, s.i + o.k)) + 1]), 6) AS x FROM samples s JOIN pcm p USING (source_id), o GROUP BY s.source_id, s.i""",
)
def box_blur_1d(spark, d):
    """Mean of five neighbours; beyond the ends the edge value counts again."""
    at = lambda i, k: F.get("x", F.greatest(F.lit(0), F.least(F.size("x") - 1, i + k)))
    out = F.transform("x", lambda _, i: sum((at(i, k) for k in range(-2, 3)), F.lit(0.0)) / 5)
    return pcm(spark, d).select("source_id", F.posexplode(out).alias("i", "x")).select("source_id", "i", F.round("x", 6).alias("x"))


IMAGE = f"{SAMPLES}, im AS (SELECT source_id, i % 8 AS x, i // 8 AS y, CAST(floor(x * 1000000) AS BIGINT) AS v FROM samples)"


@query(
    "frame_diff",
    f"WITH {IMAGE}, df AS (SELECT source_id, x, y, abs(v - lag(v) OVER (PARTITION BY x, y ORDER BY source_id)) AS m FROM im) SELECT source_id, CAST(sum(m) AS BIGINT) AS motion, max(m) AS peak FROM df WHERE m IS NOT NULL GROUP BY source_id",
)
def frame_diff(spark, d):
    """Motion between successive 8 x 8 frames: each frame meets its predecessor once, as whole arrays."""
    frames = pcm(spark, d).select("source_id", F.transform("x", lambda v: F.floor(v * 1_000_000)).alias("now"))
    numbered = frames.join(frames.select((F.col("source_id") + 1).alias("source_id"), F.col("now").alias("was")), "source_id")
    away = F.zip_with("now", "was", lambda a, b: F.abs(a - b))
    return numbered.select("source_id", F.aggregate(away, F.lit(0).cast("long"), lambda a, v: a + v).alias("motion"), F.array_max(away).alias("peak"))


@query(
    "lucas_kanade_1patch",
    f"""WITH {SAMPLES}, k AS (SELECT (range // 6 + 1) * 8 + range % 6 + 2 AS j FROM range(0, 36)),
g AS (SELECT c.source_id AS s, (c.a[j + 1] - c.a[j - 1]) / 2 AS gx, (c.a[j + 8] - c.a[j - 8]) / 2 AS gy, n.a[j] - c.a[j] AS gt FROM pcm c JOIN pcm n ON n.source_id = c.source_id + 1, k),
t AS (SELECT s, sum(gx * gx) AS a, sum(gx * gy) AS b, sum(gy * gy) AS c, sum(gx * gt) AS e, sum(gy * gt) AS f FROM g GROUP BY s)
SELECT s AS source_id, round((b * f - c * e) / (a * c - b * b), 4) AS u, round((b * e - a * f) / (a * c - b * b), 4) AS v FROM t WHERE abs(a * c - b * b) > 1e-9::DOUBLE""",
)
def lucas_kanade_1patch(spark, d):
    """Optical flow of one patch (the inside of an 8 x 8 frame) to the next frame: sums of gradient products, solved."""
    from kinograph.operators.signal import patch_flow

    frames = pcm(spark, d)
    pairs = frames.join(frames.select((F.col("source_id") - 1).alias("source_id"), F.col("x").alias("next")), "source_id")
    return pairs.select("source_id", patch_flow("x", "next", 8).alias("f")).where("f is not null").select("source_id", F.round("f.u", 4).alias("u"), F.round("f.v", 4).alias("v"))


@query(
    "fractal_escape",
    f"""WITH RECURSIVE {PIXELS}, z AS (SELECT p, 0 AS n, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, r / 255.0::DOUBLE * 3 - 2.2::DOUBLE AS ca, g / 255.0::DOUBLE * 2.4::DOUBLE - 1.2::DOUBLE AS cb FROM pixels UNION ALL
SELECT p, n + 1, a * a - b * b + ca, 2 * a * b + cb, ca, cb FROM z WHERE n < 40 AND a * a + b * b <= 4) SELECT p, max(n) AS n FROM z GROUP BY p""",
)
def fractal_escape(spark, d):
    """Steps that z -> z^2 + c stays within radius two, forty at most."""
    q = pixels(spark, d).select("p", (F.col("r") / 255.0 * 3 - 2.2).alias("ca"), (F.col("g") / 255.0 * 2.4 - 1.2).alias("cb"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))

    def step(z, _):
        move = F.struct((z["n"] + 1).alias("n"), (z["a"] * z["a"] - z["b"] * z["b"] + F.col("ca")).alias("a"), (z["a"] * 2 * z["b"] + F.col("cb")).alias("b"))
        return F.when(z["a"] * z["a"] + z["b"] * z["b"] <= 4, move).otherwise(z)

    return q.select("p", F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, step, lambda z: z["n"]).alias("n"))


@query("crc32_png")
def crc32_png(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("p"), F.crc32(F.encode("p_name", "UTF-8")).alias("crc"))


