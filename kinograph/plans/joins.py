"""Queries of the join family: stabbing, overlap, as-of, nearest, key frames, cuts, hit tests."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.window import Window

from kinograph.functions.curves import bezier
from kinograph.operators import carry, joins
from kinograph.plans.registry import query
from kinograph.sources.tables import CLIPS, PACKETS, PIXELS, clips, packets, pixels, table

HOUR, DAY = 3_600_000_000, 86_400_000_000


@query(
    "timeline_render_plan",
    f"""WITH {CLIPS}, s AS (SELECT d.day, c.clip_id, c.layer, row_number() OVER (PARTITION BY d.day ORDER BY c.layer, c.clip_id) AS rn
  FROM (SELECT unnest(range(min(lo), max(hi))) AS day FROM clips) d JOIN clips c ON d.day >= c.lo AND d.day < c.hi)
SELECT day, count(*) AS n_layers, min(layer) AS min_layer, max(layer) AS max_layer, CAST(sum(clip_id) AS BIGINT) AS sum_clip FROM s WHERE rn <= 8 GROUP BY day""",
)
def timeline_render_plan(spark, d):
    """The frames' layer lists: every clip yields its frames, each frame keeps its first eight layers."""
    rows = joins.grid_of(clips(spark, d).select("clip_id", "layer", "lo", "hi"), "lo", "hi", 1, "day")
    rank = F.row_number().over(Window.partitionBy("day").orderBy("layer", "clip_id"))
    top = rows.withColumn("rn", rank).where("rn <= 8")
    return top.groupBy("day").agg(F.count("*").alias("n_layers"), F.min("layer").alias("min_layer"), F.max("layer").alias("max_layer"), F.sum("clip_id").alias("sum_clip"))


STAB = f"""WITH {CLIPS} SELECT p.day, count(*) AS n, CAST(sum(c.clip_id) AS BIGINT) AS sum_clip
FROM (SELECT unnest(range(CAST(floor(min(lo) / 7) AS BIGINT), CAST(floor(max(hi) / 7) AS BIGINT) + 1)) * 7 AS day FROM clips) p JOIN clips c ON p.day >= c.lo AND p.day < c.hi GROUP BY p.day"""


def counted(rows):
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.sum("clip_id").alias("sum_clip"))


def week_grid(spark, d):
    """The first days of all weeks that clips reach."""
    first, last = clips(spark, d).agg(F.floor(F.min("lo") / 7), F.floor(F.max("hi") / 7)).first()
    return spark.range(first or 0, (last or 0) + 1).select((F.col("id") * 7).alias("day"))


@query("stab_join", STAB)
def stab_join(spark, d):
    return counted(joins.stab(F.broadcast(week_grid(spark, d)), clips(spark, d), "day", "lo", "hi"))


@query("stab_join_bucketed", STAB)
def stab_join_bucketed(spark, d):
    return counted(joins.stab_bucketed(week_grid(spark, d), clips(spark, d), "day", "lo", "hi", width=4, levels=5))


@query(
    "overlap_join",
    f"WITH {CLIPS} SELECT a.track, count(*) AS n_pairs, CAST(sum(b.clip_id - a.clip_id) AS BIGINT) AS gap FROM clips a JOIN clips b ON a.track = b.track AND a.clip_id < b.clip_id AND a.lo < b.hi AND a.hi > b.lo GROUP BY a.track",
)
def overlap_join(spark, d):
    """How many pairs of clips overlap, and how far apart their numbers are, from running counts: no pair is made."""
    met = joins.overlap_counts(clips(spark, d), "lo", "hi", "clip_id", ["track"])
    gap = F.sum((F.col("sign") * F.col("clip_id") * F.col("partners")).cast("decimal(38, 0)")).cast("long")
    pairs = met.groupBy("track").agg(F.sum(F.when(F.col("sign") == 1, F.col("partners"))).alias("n_pairs"), gap.alias("gap"))
    return pairs.where("n_pairs > 0")


def tracks(spark):
    return spark.range(16).select(F.col("id").alias("track"), (F.col("id") % 5 == 0).alias("muted"))


@query("clip_track_join", f"WITH {CLIPS} SELECT c.clip_id, c.track, t.muted, c.hi - c.lo AS span FROM clips c JOIN (SELECT range AS track, range % 5 = 0 AS muted FROM range(0, 16)) t ON c.track = t.track WHERE NOT c.disabled")
def clip_track_join(spark, d):
    rows = clips(spark, d).where(~F.col("disabled")).join(F.broadcast(tracks(spark)), "track")
    return rows.select("clip_id", "track", "muted", (F.col("hi") - F.col("lo")).alias("span"))


@query(
    "clips_at_time",
    f"""WITH {CLIPS} SELECT p.t, c.clip_id, c.track FROM (SELECT unnest(range(60 * CAST(floor(min(lo) / 60) AS BIGINT), max(hi), 60)) AS t FROM clips) p JOIN clips c ON p.t >= c.lo AND p.t < c.hi
WHERE NOT c.disabled AND c.track % 5 <> 0""",
)
def clips_at_time(spark, d):
    heard = clips(spark, d).where(~F.col("disabled")).join(F.broadcast(tracks(spark).where(~F.col("muted"))), "track")
    return joins.grid_of(heard.select("clip_id", "track", "lo", "hi"), "lo", "hi", 60, "t").select("t", "clip_id", "track")


@query(
    "asof_keyframe",
    f"""WITH {PACKETS}, k AS (SELECT track, pts, event_id AS key_id FROM packets WHERE is_key), f AS (SELECT track, arg_min(key_id, pts) AS first_key FROM k GROUP BY track)
SELECT p.event_id, p.track, coalesce(k.key_id, f.first_key) AS key_id FROM packets p ASOF LEFT JOIN k ON p.track = k.track AND p.pts >= k.pts LEFT JOIN f ON f.track = p.track WHERE NOT p.is_key""",
)
def asof_keyframe(spark, d):
    p = packets(spark, d)
    keys = p.where("is_key").select("track", F.col("pts").alias("key_pts"), F.col("event_id").alias("key_id"))
    return joins.asof(p.where("not is_key").select("track", "pts", "event_id"), keys, ["track"], "pts", "key_pts", ["key_pts", "key_id"], clamp_first=True).select("event_id", "track", "key_id")


@query(
    "nearest_within_tolerance",
    f"""WITH {PACKETS}, n AS (SELECT v.event_id, c.event_id AS click_id, abs(v.pts - c.pts) AS gap, row_number() OVER (PARTITION BY v.event_id ORDER BY abs(v.pts - c.pts), c.event_id) AS rn
FROM packets v JOIN packets c ON v.track = c.track AND abs(v.pts - c.pts) <= {6 * HOUR} WHERE v.event_type = 'view' AND c.event_type = 'click')
SELECT event_id, click_id, gap FROM n WHERE rn = 1""",
)
def nearest_within_tolerance(spark, d):
    p = packets(spark, d)
    views = p.where("event_type = 'view'").select("track", "pts", "event_id")
    clicks = p.where("event_type = 'click'").select("track", F.col("pts").alias("click_pts"), F.col("event_id").alias("click_id"))
    found = joins.nearest(views, clicks, ["track"], "pts", "click_pts", 6 * HOUR, "event_id", ["click_id"])
    return found.select("event_id", "click_id", F.abs(F.col("pts") - F.col("click_pts")).alias("gap"))


def tenth_hour() -> Column:
    return F.floor(F.col("pts") / HOUR * 10 + 0.5).cast("long")


@query(
    "quantized_equi_join",
    f"""WITH {PACKETS}, q AS (SELECT *, CAST(floor(pts / {HOUR} * 10 + 0.5::DOUBLE) AS BIGINT) AS slot FROM packets)
SELECT a.event_id, b.event_id AS click_id, a.slot FROM q a JOIN q b ON a.track = b.track AND a.slot = b.slot WHERE a.event_type = 'purchase' AND b.event_type = 'click'""",
)
def quantized_equi_join(spark, d):
    p = packets(spark, d).withColumn("slot", tenth_hour())
    clicks = p.where("event_type = 'click'").select("track", "slot", F.col("event_id").alias("click_id"))
    return p.where("event_type = 'purchase'").join(clicks, ["track", "slot"]).select("event_id", "click_id", "slot")


START = 1_704_067_200_000_000


@query("frames_between", f"WITH {PACKETS} SELECT track, event_id, pts, row_number() OVER (PARTITION BY track ORDER BY pts) AS n FROM packets WHERE pts >= {START + 5 * DAY} AND pts < {START + 9 * DAY}")
def frames_between(spark, d):
    rows = packets(spark, d).where(F.col("pts").between(START + 5 * DAY, START + 9 * DAY - 1))
    return rows.select("track", "event_id", "pts", F.row_number().over(Window.partitionBy("track").orderBy("pts")).alias("n"))


def hours_of(spark, d):
    """The first and last hour, from START, that packets reach."""
    return packets(spark, d).agg(*[F.floor((f("pts") - START) / HOUR).cast("int") for f in (F.min, F.max)]).first()


def hourly(spark, d):
    """A probe every seven hours per track, from before the first packet of all to after the last."""
    first, last = hours_of(spark, d)
    users = packets(spark, d).select("track").distinct()
    return users.withColumn("hour", F.explode(F.sequence(F.lit(first - 7), F.lit(last + 7), F.lit(7)))).withColumn("t", F.lit(START) + F.col("hour").cast("long") * HOUR)


KEYED = f"""WITH {PACKETS}, seg AS (SELECT track, pts, value, lead(pts) OVER w AS t2, lead(value) OVER w AS v2 FROM packets WINDOW w AS (PARTITION BY track ORDER BY pts)),
f AS (SELECT track, arg_min(value, pts) AS v0 FROM packets GROUP BY track),
h AS (SELECT CAST(floor((min(pts) - {START}) / {HOUR}) AS BIGINT) AS a, CAST(floor((max(pts) - {START}) / {HOUR}) AS BIGINT) AS b FROM packets),
g AS (SELECT unnest(range(a - 7, b + 8, 7)) AS hour FROM h),
q AS (SELECT f.track, f.v0, CAST(g.hour AS INT) AS hour, {START} + g.hour * {HOUR} AS t FROM f, g),
j AS (SELECT q.track, q.hour, q.t, q.v0, s.pts, s.value, s.t2, s.v2, CAST(q.t - s.pts AS DOUBLE) / CAST(s.t2 - s.pts AS DOUBLE) AS u FROM q ASOF LEFT JOIN seg s ON q.track = s.track AND q.t >= s.pts)"""


@query("keyframe_lerp", KEYED + " SELECT track, hour, round(coalesce(CASE WHEN t2 IS NULL THEN value ELSE value + (v2 - value) * u END, v0), 4) AS value FROM j")
def keyframe_lerp(spark, d):
    keys = packets(spark, d).select("track", "pts", F.col("value").alias("v"))
    out = joins.key_values(hourly(spark, d), keys, ["track"], "t", "pts", "v")
    return out.select("track", "hour", F.round("value", 4).alias("value"))


def newton(x: str, steps: int = 8) -> str:
    """SQL of the Newton steps for the easing curve (.25, .1, .25, 1), nested as subqueries."""
    sql = f"SELECT *, {x} AS s0 FROM j"
    for i in range(steps):
        s = f"s{i}"
        at = f"(3 * (1 - {s}) * (1 - {s}) * {s} * 0.25::DOUBLE + 3 * (1 - {s}) * {s} * {s} * 0.25::DOUBLE + {s} * {s} * {s})"
        slope = f"(3 * (1 - {s}) * (1 - {s}) * 0.25::DOUBLE + 6 * (1 - {s}) * {s} * (0.25::DOUBLE - 0.25::DOUBLE) + 3 * {s} * {s} * (1 - 0.25::DOUBLE))"
        sql = f"SELECT *, CASE WHEN abs({slope}) < 1e-6::DOUBLE THEN {s} ELSE greatest(0::DOUBLE, least(1::DOUBLE, {s} - ({at} - {x}) / {slope})) END AS s{i + 1} FROM ({sql})"
    return sql


@query(
    "keyframe_bezier",
    KEYED + f", n AS ({newton('u')}) SELECT track, hour, round(coalesce(CASE WHEN t2 IS NULL THEN value ELSE value + (v2 - value) * (3 * (1 - s8) * (1 - s8) * s8 * 0.1::DOUBLE + 3 * (1 - s8) * s8 * s8 + s8 * s8 * s8) END, v0), 4) AS value FROM n",
)
def keyframe_bezier(spark, d):
    keys = packets(spark, d).select("track", "pts", F.col("value").alias("v"))
    out = joins.key_values(hourly(spark, d), keys, ["track"], "t", "pts", "v", ease=lambda u: bezier(u, 0.25, 0.1, 0.25, 1.0))
    return out.select("track", "hour", F.round("value", 4).alias("value"))


@query("time_remap", f"WITH {CLIPS} SELECT clip_id, 1000 + clip_id % 7 AS t, CAST(1000 + clip_id % 7 - lo AS DOUBLE) AS plain, round(power((1000 + clip_id % 7 - lo) / CAST(greatest(1, hi - lo) AS DOUBLE), 2) * (hi - lo), 4) AS eased FROM clips WHERE 1000 + clip_id % 7 >= lo AND 1000 + clip_id % 7 < hi")
def time_remap(spark, d):
    c = clips(spark, d).withColumn("t", F.lit(1000) + F.col("clip_id") % 7).where("t >= lo and t < hi")
    passed = (F.col("t") - F.col("lo")) / F.greatest(F.lit(1), F.col("hi") - F.col("lo"))
    return c.select("clip_id", "t", (F.col("t") - F.col("lo")).cast("double").alias("plain"), F.round(F.pow(passed, 2) * (F.col("hi") - F.col("lo")), 4).alias("eased"))


@query("trim_filter", f"WITH {PACKETS} SELECT event_id, pts - {START + 3 * DAY} AS pts FROM packets WHERE pts BETWEEN {START + 3 * DAY} AND {START + 4 * DAY}")
def trim_filter(spark, d):
    return packets(spark, d).where(F.col("pts").between(START + 3 * DAY, START + 4 * DAY)).select("event_id", (F.col("pts") - (START + 3 * DAY)).alias("pts"))


@query("prefetch_window", f"WITH {CLIPS} SELECT clip_id, round(lo * 1000 - 3 * 1000 / 30.0::DOUBLE, 4) AS first_ms, round(lo * 1000 + 10 * 1000 / 30.0::DOUBLE, 4) AS last_ms FROM clips")
def prefetch_window(spark, d):
    at, frame = F.col("lo") * 1000, F.lit(1000 / 30.0)
    return clips(spark, d).select("clip_id", F.round(at - frame * 3, 4).alias("first_ms"), F.round(at + frame * 10, 4).alias("last_ms"))


@query("triangle_wave", f"WITH {CLIPS} SELECT clip_id, CASE WHEN (1300 - lo) % (2 * (hi - lo)) < hi - lo THEN (1300 - lo) % (2 * (hi - lo)) ELSE 2 * (hi - lo) - (1300 - lo) % (2 * (hi - lo)) END AS at FROM clips WHERE lo <= 1300")
def triangle_wave(spark, d):
    c = clips(spark, d).where("lo <= 1300").withColumn("span", F.col("hi") - F.col("lo"))
    phase = (F.lit(1300) - F.col("lo")) % (2 * F.col("span"))
    return c.select("clip_id", F.when(phase < F.col("span"), phase).otherwise(2 * F.col("span") - phase).alias("at"))


def switches(spark, d):
    return packets(spark, d).where("event_type = 'error'").select("pts", "event_id", (F.col("track") % 4).alias("angle"))


CUTS = f"""{PACKETS}, sw AS (SELECT pts, event_id, track % 4 AS angle FROM packets WHERE event_type = 'error'),
ch AS (SELECT * FROM (SELECT *, lag(angle) OVER (ORDER BY pts) AS was FROM sw) WHERE was IS NULL OR was <> angle),
cuts AS (SELECT row_number() OVER (ORDER BY pts) AS seq, angle, pts AS in_pt, lead(pts) OVER (ORDER BY pts) AS out_pt FROM ch)"""


def cut_list(spark, d):
    """The switches of one programme, each after the last one before it: a switch to the live angle is none. One key, many tasks."""
    own = switches(spark, d).select(F.lit(0).alias("show"), "pts", "angle")
    facts = own.select("show", F.col("pts").alias("at"), F.col("angle").alias("was"))
    before = carry.asof(own.withColumn("probe", F.col("pts") - 1), facts, ["show"], "probe", "at", ["at", "was"])
    changed = before.where("was is null or was <> angle").select("show", "pts", "angle")
    after = changed.select("show", (-F.col("pts")).alias("at"), F.col("pts").alias("out_pt"))
    cuts = carry.asof(changed.withColumn("probe", -F.col("pts") - 1), after, ["show"], "probe", "at", ["at", "out_pt"])
    return carry.running_sum(cuts, ["show"], "pts", [], {"seq": F.lit(1)}).select(F.col("seq").cast("long").alias("seq"), "angle", F.col("pts").alias("in_pt"), "out_pt")


@query("cutlist_from_switches", f"WITH {CUTS} SELECT * FROM cuts")
def cutlist_from_switches(spark, d):
    return cut_list(spark, d)


@query(
    "multicam_angle_at",
    f"""WITH {CUTS}, p AS (SELECT hour, {START} + hour * {HOUR} AS t FROM (SELECT unnest(range(CAST(floor((min(pts) - {START}) / {HOUR}) AS BIGINT), CAST(floor((max(pts) - {START}) / {HOUR}) AS BIGINT) + 2)) AS hour FROM packets))
SELECT p.hour, coalesce(c.angle, 0) AS angle FROM p ASOF LEFT JOIN cuts c ON p.t >= c.in_pt""",
)
def multicam_angle_at(spark, d):
    """The live angle at every full hour that packets reach."""
    first, last = hours_of(spark, d)
    probes = spark.range(first, last + 2).select(F.lit(0).alias("show"), F.col("id").alias("hour"), (F.lit(START) + F.col("id") * HOUR).alias("t"))
    cuts = cut_list(spark, d).withColumn("show", F.lit(0))
    return joins.asof(probes, cuts, ["show"], "t", "in_pt", ["in_pt", "angle"]).select("hour", F.coalesce("angle", F.lit(0)).alias("angle"))


@query("multicam_source_time", f"WITH {CUTS} SELECT seq, angle, in_pt - coalesce(CASE WHEN angle < 3 THEN angle * 1500000 END, 0) AS source_t FROM cuts")
def multicam_source_time(spark, d):
    offsets = spark.range(3).select(F.col("id").alias("angle"), (F.col("id") * 1_500_000).alias("offset"))
    found = cut_list(spark, d).join(F.broadcast(offsets), "angle", "left")
    return found.select("seq", "angle", (F.col("in_pt") - F.coalesce("offset", F.lit(0))).alias("source_t"))


@query("semi_join_targets", f"WITH {CLIPS} SELECT clip_id, lo, hi FROM clips WHERE source_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_targets(spark, d):
    targets = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("source_id"))
    return clips(spark, d).join(targets, "source_id", "left_semi").select("clip_id", "lo", "hi")


@query("anti_join_assets", "SELECT c_custkey AS asset_id, c_name AS name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def anti_join_assets(spark, d):
    used = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(used, "c_custkey", "left_anti").select(F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("name"))


@query("move_connected", f"WITH {CLIPS} SELECT c.clip_id, c.lo + CASE WHEN p.clip_id IS NOT NULL THEN 5 ELSE 0 END AS lo, c.hi + CASE WHEN p.clip_id IS NOT NULL THEN 5 ELSE 0 END AS hi FROM clips c LEFT JOIN (SELECT clip_id FROM clips WHERE track = 3) p ON p.clip_id = c.clip_id // 2")
def move_connected(spark, d):
    """Clips connected to (id div 2) one that moves follow by its shift, one level deep."""
    c = clips(spark, d)
    moved = c.where("track = 3").select(F.col("clip_id").alias("parent"), F.lit(5).alias("shift"))
    out = c.withColumn("parent", F.expr("clip_id div 2")).join(moved, "parent", "left")
    return out.select("clip_id", *[(F.col(x) + F.coalesce("shift", F.lit(0))).alias(x) for x in ("lo", "hi")])


@query(
    "zip_assign_beats",
    f"""WITH {CLIPS}, {PACKETS}, b AS (SELECT track % 16 AS track, pts, coalesce(lead(pts) OVER (PARTITION BY track % 16 ORDER BY pts), pts + 2000000) AS next_pts, row_number() OVER (PARTITION BY track % 16 ORDER BY pts) AS n FROM packets WHERE is_key),
c AS (SELECT track, clip_id, row_number() OVER (PARTITION BY track ORDER BY lo, clip_id) AS n FROM clips) SELECT c.track, c.clip_id, n, pts AS start_us, next_pts AS end_us FROM c JOIN b USING (track, n)""",
)
def zip_assign_beats(spark, d):
    beats = packets(spark, d).where("is_key").select((F.col("track") % 16).alias("track"), "pts")
    follow = F.coalesce(F.lead("pts").over(Window.partitionBy("track").orderBy("pts")), F.col("pts") + 2_000_000)
    out = joins.zip_join(clips(spark, d), beats.withColumn("next_pts", follow), ["track"], [F.col("lo"), F.col("clip_id")], [F.col("pts")])
    return out.select("track", "clip_id", "n", F.col("pts").alias("start_us"), F.col("next_pts").alias("end_us"))


@query(
    "on_beat_frames",
    f"""WITH {PACKETS}, g AS (SELECT frame, {START} + frame * 600000000 AS t FROM (SELECT unnest(range(CAST(floor((min(pts) - {START}) / 6e8) AS BIGINT), CAST(floor((max(pts) - {START}) / 6e8) AS BIGINT) + 2)) AS frame FROM packets))
SELECT g.frame, min(p.pts) AS beat FROM g JOIN packets p ON p.is_key AND abs(p.pts - g.t) < 300000000 GROUP BY g.frame""",
)
def on_beat_frames(spark, d):
    """Ten-minute frames that a beat falls within half a frame of; each beat names its frame by arithmetic."""
    beats = packets(spark, d).where("is_key").withColumn("frame", F.floor((F.col("pts") - START) / 600_000_000 + 0.5).cast("long"))
    near = beats.where(F.abs(F.col("pts") - (F.lit(START) + F.col("frame") * 600_000_000)) < 300_000_000)
    return near.groupBy("frame").agg(F.min("pts").alias("beat"))


@query(
    "comp_flatten",
    """WITH RECURSIVE n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey > 0 THEN o_orderkey // 2 END AS parent, o_custkey % 100 AS off FROM orders),
t AS (SELECT id, off AS start, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, t.start + n.off, t.depth + 1 FROM n JOIN t ON n.parent = t.id) SELECT id, start, depth FROM t""",
)
def comp_flatten(spark, d):
    return flattened(table(spark, d, "orders"))


def flattened(orders):
    parent = F.when(F.col("o_orderkey") > 0, F.expr("o_orderkey div 2"))
    nodes = orders.select("o_orderkey", parent.alias("parent"), (F.col("o_custkey") % 100).alias("off"))
    return joins.flatten_tree(nodes, "o_orderkey", "parent", "off")


@query(
    "layer_matrices",
    """WITH RECURSIVE n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey > 0 THEN o_orderkey // 2 END AS parent, 0.01::DOUBLE + (o_custkey % 37) * 0.17::DOUBLE AS r, 0.9::DOUBLE + (o_custkey % 3) / 10 AS s, CAST(o_orderkey % 7 AS DOUBLE) AS x, CAST(o_custkey % 11 AS DOUBLE) AS y FROM orders),
m AS (SELECT id, parent, cos(r) * s AS a, sin(r) * s AS b, -sin(r) * s AS c, cos(r) * s AS d, x AS e, y AS f FROM n),
t AS (SELECT id, 0 AS depth, a, b, c, d, e, f FROM m WHERE parent IS NULL UNION ALL SELECT m.id, t.depth + 1, t.a * m.a + t.c * m.b, t.b * m.a + t.d * m.b, t.a * m.c + t.c * m.d, t.b * m.c + t.d * m.d, t.a * m.e + t.c * m.f + t.e, t.b * m.e + t.d * m.f + t.f FROM m JOIN t ON m.parent = t.id)
SELECT id, depth, round(a, 6) AS a, round(b, 6) AS b, round(e, 5) AS e, round(f, 5) AS f FROM t""",
)
def layer_matrices(spark, d):
    """Layers in layers, each turned, scaled and moved inside its parent: what each does to a point of its own, in the root's plane."""
    o = table(spark, d, "orders")
    nodes = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") > 0, F.call_function("div", F.col("o_orderkey"), F.lit(2).cast("long"))).alias("parent"), "o_custkey", "o_orderkey")
    own = joins.affine(F.lit(0.01) + (F.col("o_custkey") % 37) * 0.17, F.lit(0.9) + (F.col("o_custkey") % 3) / 10, F.col("o_orderkey") % 7, F.col("o_custkey") % 11)
    found = joins.to_root(nodes, "id", "parent", own, joins.after)
    return found.select("id", "depth", *[F.round(F.get("value", F.lit(n)), digits).alias(c) for n, c, digits in ((0, "a", 6), (1, "b", 6), (4, "e", 5), (5, "f", 5))])


@query(
    "point_in_rotated_rect",
    """WITH s AS (SELECT p_partkey AS z, CAST(p_partkey * 37 % 400 AS DOUBLE) AS cx, CAST(p_partkey * 53 % 300 AS DOUBLE) AS cy, 10.0::DOUBLE + p_size AS w, 8.0::DOUBLE + p_size / 2.0::DOUBLE AS h, radians(p_partkey % 90) AS a FROM part),
g AS (SELECT x.range * 20 AS x, y.range * 20 AS y FROM range(0, 20) x, range(0, 15) y),
l AS (SELECT g.x, g.y, s.z, s.w, s.h, (g.x - cx) * cos(-a) - (g.y - cy) * sin(-a) AS u, (g.x - cx) * sin(-a) + (g.y - cy) * cos(-a) AS v FROM g, s)
SELECT x, y, max(z) AS top FROM l WHERE abs(u) <= w / 2 AND abs(v) <= h / 2 GROUP BY x, y""",
)
def point_in_rotated_rect(spark, d):
    return top_sprites(spark, table(spark, d, "part"))


def top_sprites(spark, part):
    """The top-most sprite under each point of a fixed grid; the grid (300 points) is broadcast."""
    p = F.col("p_partkey")
    sprites = part.select(
        p.alias("z"), (p * 37 % 400).cast("double").alias("cx"), (p * 53 % 300).cast("double").alias("cy"), (F.lit(10.0) + F.col("p_size")).alias("w"), (F.lit(8.0) + F.col("p_size") / 2).alias("h"), F.radians((p % 90).cast("double")).alias("a")
    )
    grid = spark.range(300).select((F.col("id") % 20 * 20).alias("x"), (F.expr("id div 20") * 20).alias("y"))
    dx, dy, a = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), -F.col("a")
    u, v = dx * F.cos(a) - dy * F.sin(a), dx * F.sin(a) + dy * F.cos(a)
    hit = sprites.join(F.broadcast(grid), (F.abs(u) <= F.col("w") / 2) & (F.abs(v) <= F.col("h") / 2))
    return hit.groupBy("x", "y").agg(F.max("z").alias("top"))


@query(
    "lut_lookup",
    f"""WITH {PIXELS}, q AS (SELECT p, r * 7 // 255 AS ri, g * 7 // 255 AS gi, b * 7 / 255.0::DOUBLE AS bf FROM pixels),
l AS (SELECT i.range % 8 AS ri, i.range // 8 % 8 AS gi, i.range // 64 AS bi, (i.range * 31 % 97) / 97.0::DOUBLE AS v FROM range(0, 512) i)
SELECT p, round(lo.v + (hi.v - lo.v) * (bf - floor(bf)), 6) AS v FROM q JOIN l lo ON lo.ri = q.ri AND lo.gi = q.gi AND lo.bi = floor(bf) JOIN l hi ON hi.ri = q.ri AND hi.gi = q.gi AND hi.bi = least(7, floor(bf) + 1)""",
)
def lut_lookup(spark, d):
    i = F.col("id")
    lut = spark.range(512).select((i % 8).alias("ri"), (F.expr("id div 8") % 8).alias("gi"), F.expr("id div 64").alias("bi"), ((i * 31 % 97) / 97.0).alias("v"))
    q = pixels(spark, d).select("p", F.expr("r * 7 div 255").alias("ri"), F.expr("g * 7 div 255").alias("gi"), (F.col("b") * 7 / 255.0).alias("bf"))
    q = q.withColumns({"b0": F.floor("bf"), "b1": F.least(F.lit(7).cast("long"), F.floor("bf") + 1)})
    low, high = (lut.select("ri", "gi", F.col("bi").alias(b), F.col("v").alias(v)) for b, v in (("b0", "v0"), ("b1", "v1")))
    found = q.join(F.broadcast(low), ["ri", "gi", "b0"]).join(F.broadcast(high), ["ri", "gi", "b1"])
    return found.select("p", F.round(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("bf") - F.floor("bf")), 6).alias("v"))


@query(
    "nearest_palette",
    f"""WITH {PIXELS}, pal AS (SELECT CAST(n_nationkey AS BIGINT) AS idx, n_nationkey * 67 % 256 AS pr, n_nationkey * 101 % 256 AS pg, n_nationkey * 29 % 256 AS pb FROM nation),
m AS (SELECT p, idx, abs(r - pr) + abs(g - pg) + abs(b - pb) AS dist, row_number() OVER (PARTITION BY p ORDER BY abs(r - pr) + abs(g - pg) + abs(b - pb), idx) AS rn FROM pixels, pal) SELECT p, idx, dist FROM m WHERE rn = 1""",
)
def nearest_palette(spark, d):
    """Each pixel's nearest of 25 palette colours: the palette is one array, compared without a join or shuffle."""
    key = F.col("n_nationkey").cast("long")
    colour = F.struct(key.alias("idx"), (key * 67 % 256).alias("r"), (key * 101 % 256).alias("g"), (key * 29 % 256).alias("b"))
    palette = table(spark, d, "nation").agg(F.collect_list(colour).alias("palette"))
    distance = lambda c: F.abs(F.col("r") - c["r"]) + F.abs(F.col("g") - c["g"]) + F.abs(F.col("b") - c["b"])
    best = F.array_min(F.transform("palette", lambda c: F.struct(distance(c).alias("dist"), c["idx"].alias("idx"))))
    return pixels(spark, d).join(F.broadcast(palette)).withColumn("best", best).select("p", "best.idx", "best.dist")


@query("clip_defaults", "SELECT o_orderkey AS clip_id, coalesce(nullif(CASE WHEN o_custkey % 3 = 0 THEN 0 WHEN o_custkey % 3 = 1 THEN o_custkey * 10 END, 0), o_orderkey + coalesce(nullif(o_orderkey % 5 * 100, 0), 1000)) AS end_ms, CASE WHEN o_orderstatus = 'F' THEN 'audio' WHEN o_orderstatus = 'O' THEN 'image' ELSE 'video' END AS kind FROM orders")
def clip_defaults(spark, d):
    given = F.when(F.col("o_custkey") % 3 == 0, F.lit(0)).when(F.col("o_custkey") % 3 == 1, F.col("o_custkey") * 10)
    duration = F.coalesce(F.nullif(F.col("o_orderkey") % 5 * 100, F.lit(0)), F.lit(1000))
    kind = F.when(F.col("o_orderstatus") == "F", "audio").when(F.col("o_orderstatus") == "O", "image").otherwise("video")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("clip_id"), F.coalesce(F.nullif(given, F.lit(0)), F.col("o_orderkey") + duration).alias("end_ms"), kind.alias("kind"))


@query("sequential_layout", "SELECT o_custkey AS source_id, o_orderkey AS clip_id, CAST(coalesce(sum(coalesce(nullif(o_orderkey % 5 * 100, 0), 1000)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM orders")
def sequential_layout(spark, d):
    duration = F.coalesce(F.nullif(F.col("o_orderkey") % 5 * 100, F.lit(0)), F.lit(1000))
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("clip_id"), F.coalesce(F.sum(duration).over(before), F.lit(0)).alias("start_ms"))


@query("layer_order", f"WITH {CLIPS} SELECT track, clip_id, row_number() OVER (PARTITION BY track ORDER BY layer, clip_id) AS z FROM clips")
def layer_order(spark, d):
    return clips(spark, d).select("track", "clip_id", F.row_number().over(Window.partitionBy("track").orderBy("layer", "clip_id")).alias("z"))


@query("top8_layers", f"WITH {CLIPS} SELECT lo, clip_id, layer FROM clips QUALIFY row_number() OVER (PARTITION BY lo ORDER BY layer, clip_id) <= 8")
def top8_layers(spark, d):
    rank = F.row_number().over(Window.partitionBy("lo").orderBy("layer", "clip_id"))
    return clips(spark, d).withColumn("rn", rank).where("rn <= 8").select("lo", "clip_id", "layer")
