"""Queries of filters over whole frames: parts as the pixels of pictures 50 wide and up to 80 high, larger than a tile."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinograph.operators import tiles
from kinograph.plans.registry import query
from kinograph.sources.tables import PIXELS, pixels

WIDE, HIGH, TILE = 50, 80, 16
#: Each pixel with its neighbours; beyond the border the border's pixel counts.
NEAR = f"""WITH {PIXELS}, f AS (SELECT p // {WIDE * HIGH} AS frame, p % {WIDE} AS x, (p // {WIDE}) % {HIGH} AS y, r / 255 AS v, g / 255 AS m FROM pixels),
s AS (SELECT frame, max(x) AS mx, max(y) AS my FROM f GROUP BY frame),
o AS (SELECT a.range AS dx, b.range AS dy FROM range(-2, 3) a, range(-2, 3) b),
n AS (SELECT f.frame, f.x, f.y, f.v AS own, o.dx, o.dy, q.v, q.m FROM f JOIN s USING (frame) CROSS JOIN o
  JOIN f q ON q.frame = f.frame AND q.x = greatest(0, least(s.mx, f.x + o.dx)) AND q.y = greatest(0, least(s.my, f.y + o.dy)))"""


def frames(spark, d):
    p = F.col("p")
    row = F.call_function("div", p, F.lit(WIDE)) % HIGH
    return pixels(spark, d).select(F.call_function("div", p, F.lit(WIDE * HIGH)).alias("frame"), (p % WIDE).alias("x"), row.alias("y"), (F.col("r") / 255).alias("v"), (F.col("g") / 255).alias("m"))


def filtered(spark, d, planes, reach, of):
    out = tiles.filter_frames(frames(spark, d), planes, reach, of, "value", tile=TILE)
    return out.select("frame", "x", "y", F.round("value", 6).alias("value"))


@query("box_blur_2d", f"{NEAR} SELECT frame, x, y, round(avg(v), 6) AS value FROM n GROUP BY ALL")
def box_blur_2d(spark, d):
    return filtered(spark, d, ["v"], 2, tiles.box(2))


def gaussian_sql() -> str:
    weights = " ".join(f"WHEN {i} THEN {w!r}::DOUBLE" for i, w in zip(range(-2, 3), tiles.gaussian_weights(2, 1.2)))
    return f"{NEAR} SELECT frame, x, y, round(sum(v * CASE dx {weights} END * CASE dy {weights} END), 6) AS value FROM n GROUP BY ALL"


@query("gaussian_blur_2d", gaussian_sql())
def gaussian_blur_2d(spark, d):
    return filtered(spark, d, ["v"], 2, tiles.gaussian(2, 1.2))


@query(
    "sobel_edges",
    f"""{NEAR}, k AS (SELECT frame, x, y, sum(v * dx * (2 - abs(dy))) AS gx, sum(v * dy * (2 - abs(dx))) AS gy FROM n WHERE abs(dx) < 2 AND abs(dy) < 2 GROUP BY ALL)
SELECT frame, x, y, round(sqrt(gx * gx + gy * gy), 6) AS value FROM k""",
)
def sobel_edges(spark, d):
    return filtered(spark, d, ["v"], 1, tiles.sobel())


@query("sharpen_2d", f"{NEAR} SELECT frame, x, y, round(5 * any_value(own) - sum(v), 6) AS value FROM n WHERE abs(dx) + abs(dy) = 1 GROUP BY frame, x, y")
def sharpen_2d(spark, d):
    return filtered(spark, d, ["v"], 1, tiles.sharpen())


@query(
    "bilateral_2d",
    f"""{NEAR}, k AS (SELECT *, exp(-(dx * dx + dy * dy) / (2 * 1.5::DOUBLE * 1.5::DOUBLE)) * exp(-(v - own) * (v - own) / (2 * 0.2::DOUBLE * 0.2::DOUBLE)) AS w FROM n)
SELECT frame, x, y, round(sum(v * w) / sum(w), 6) AS value FROM k GROUP BY frame, x, y""",
)
def bilateral_2d(spark, d):
    return filtered(spark, d, ["v"], 2, tiles.bilateral(2, 1.5, 0.2))


@query(
    "guided_filter",
    f"""{NEAR}, k AS (SELECT frame, x, y, own, avg(v) AS i, avg(m) AS p, avg(v * m) AS ip, avg(v * v) AS ii FROM n GROUP BY ALL),
a AS (SELECT *, (ip - i * p) / (ii - i * i + 0.01::DOUBLE) AS a FROM k) SELECT frame, x, y, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, a * own + p - a * i)), 6) AS value FROM a""",
)
def guided_filter(spark, d):
    """The mask plane redrawn along the picture's edges."""
    return filtered(spark, d, ["v", "m"], 2, tiles.guided(2, 0.01))
