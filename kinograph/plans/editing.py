"""Queries of timeline editing: ripple, overlap, split, snap, cache survivors, history, diffs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.operators import sequences as S
from kinograph.operators import timeline as T
from kinograph.functions.curves import snap
from kinograph.plans.registry import query
from kinograph.sources.tables import CLIPS, CUES, PACKETS, clips, cues, packets, table


@query("ripple_insert", f"WITH {CLIPS} SELECT clip_id, track, lo + CASE WHEN track = 2 AND lo >= 700 THEN 30 ELSE 0 END AS lo, hi + CASE WHEN track = 2 AND lo >= 700 THEN 30 ELSE 0 END AS hi FROM clips UNION ALL SELECT -1, 2, 700, 730")
def ripple_insert(spark, d):
    c = clips(spark, d).select("clip_id", "track", "lo", "hi")
    fresh = spark.range(1).select(F.lit(-1).cast("long").alias("clip_id"), F.lit(2).cast("long").alias("track"), F.lit(700).cast("long").alias("lo"), F.lit(730).cast("long").alias("hi"))
    return T.ripple(c, (F.col("track") == 2) & (F.col("lo") >= 700), 30).unionByName(fresh)


@query("ripple_remove", f"WITH {CLIPS}, g AS (SELECT clip_id, track, lo, hi FROM clips WHERE clip_id % 16 = 5) SELECT c.clip_id, c.lo - coalesce((SELECT CAST(sum(g.hi - g.lo) AS BIGINT) FROM g WHERE g.track = c.track AND g.hi <= c.lo), 0) AS lo, c.hi - coalesce((SELECT CAST(sum(g.hi - g.lo) AS BIGINT) FROM g WHERE g.track = c.track AND g.hi <= c.lo), 0) AS hi FROM clips c WHERE c.clip_id % 16 <> 5")
def ripple_remove(spark, d):
    c = clips(spark, d).select("clip_id", "track", "lo", "hi")
    return T.ripple_remove(c, F.col("clip_id") % 16 == 5).select("clip_id", "lo", "hi")


@query(
    "resolve_overlaps",
    f"""WITH RECURSIVE {CLIPS}, o AS (SELECT track, clip_id, lo, hi, row_number() OVER (PARTITION BY track ORDER BY lo, clip_id) AS n FROM clips),
r AS (SELECT track, n, clip_id, lo AS new_lo, hi AS new_hi, 0::BIGINT AS shift FROM o WHERE n = 1 UNION ALL
SELECT o.track, o.n, o.clip_id, o.lo + r.shift + greatest(0, r.new_hi - (o.lo + r.shift)), o.hi + r.shift + greatest(0, r.new_hi - (o.lo + r.shift)), r.shift + greatest(0, r.new_hi - (o.lo + r.shift)) FROM r JOIN o ON o.track = r.track AND o.n = r.n + 1)
SELECT track, clip_id, new_lo, new_hi FROM r""",
)
def resolve_overlaps(spark, d):
    return T.resolve_overlaps(clips(spark, d), ["track"], "clip_id").select("track", "clip_id", "new_lo", "new_hi")


@query("split_clip", f"WITH {CLIPS} SELECT clip_id, 0 AS part, lo, CASE WHEN 1200 > lo AND 1200 < hi THEN 1200 ELSE hi END AS hi FROM clips UNION ALL SELECT clip_id, 1, 1200, hi FROM clips WHERE 1200 > lo AND 1200 < hi")
def split_clip(spark, d):
    return T.split(clips(spark, d).select("clip_id", "lo", "hi"), "lo", "hi", 1200)


@query("snap_to_grid", f"WITH {CLIPS} SELECT clip_id, round(floor((lo / 7.0::DOUBLE) / 0.5::DOUBLE + 0.5::DOUBLE) * 0.5::DOUBLE, 4) AS snapped FROM clips")
def snap_to_grid(spark, d):
    return clips(spark, d).select("clip_id", F.round(snap(F.col("lo") / 7.0, 0.5), 4).alias("snapped"))


@query(
    "lru_survivors",
    f"WITH {PACKETS}, r AS (SELECT track, event_id, CAST(sum(size) OVER w AS BIGINT) AS held, row_number() OVER w AS n FROM packets WINDOW w AS (PARTITION BY track ORDER BY pts DESC, event_id DESC ROWS UNBOUNDED PRECEDING)) SELECT track, event_id, held FROM r WHERE held <= 500000 AND n <= 30",
)
def lru_survivors(spark, d):
    return T.survivors(packets(spark, d), ["track"], [F.desc("pts"), F.desc("event_id")], "size", 500_000, 30).select("track", "event_id", "held")


@query("upsert_latest", f"WITH {PACKETS} SELECT track, event_type, arg_max(event_id, pts) AS event_id, arg_max(value, pts) AS value FROM packets GROUP BY track, event_type")
def upsert_latest(spark, d):
    return T.latest(packets(spark, d), ["track", "event_type"], ["pts"]).select("track", "event_type", "event_id", "value")


@query(
    "history_replay_prefix",
    f"""WITH {PACKETS}, e AS (SELECT track, event_id, event_type, value, row_number() OVER (PARTITION BY track ORDER BY pts, event_id) AS n, count(*) OVER (PARTITION BY track) AS total FROM packets),
a AS (SELECT * FROM e WHERE n <= total - 3 AND n > total - 200) SELECT track, event_type AS path, arg_max(value, n) AS value FROM a GROUP BY track, event_type""",
)
def history_replay_prefix(spark, d):
    """The last write per path among the entries still applied: three undone, two hundred kept."""
    return T.replay(packets(spark, d), ["track"], ["pts", "event_id"], "event_type", "value", undone=3, depth=200).withColumnRenamed("event_type", "path")


@query("cues_as_clips", f"WITH {CUES}, {CLIPS} SELECT 'cue' AS kind, conv_id AS id, start_ms AS lo, end_ms AS hi FROM cues UNION ALL SELECT 'clip', clip_id, lo * 86400000, hi * 86400000 FROM clips")
def cues_as_clips(spark, d):
    text = cues(spark, d).select(F.lit("cue").alias("kind"), F.col("conv_id").alias("id"), F.col("start_ms").alias("lo"), F.col("end_ms").alias("hi"))
    rest = clips(spark, d).select(F.lit("clip").alias("kind"), F.col("clip_id").alias("id"), (F.col("lo") * 86_400_000).alias("lo"), (F.col("hi") * 86_400_000).alias("hi"))
    return text.unionByName(rest)


@query(
    "struct_diff",
    """WITH o AS (SELECT event_id, user_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
l AS (SELECT *, lag(event_id) OVER w AS was, lag(event_type) OVER w AS t0, lag(value) OVER w AS v0, lag(k) OVER w AS k0 FROM o WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
m AS (SELECT event_id, unnest([{'path': 'event_type', 'old': t0, 'new': event_type}, {'path': 'k', 'old': CAST(k0 AS VARCHAR), 'new': CAST(k AS VARCHAR)}, {'path': 'extra', 'old': CASE WHEN k0 % 2 = 0 THEN 'yes' END, 'new': CASE WHEN k % 2 = 0 THEN 'yes' END}]) AS x FROM l WHERE was IS NOT NULL)
SELECT event_id, x.path AS path, CASE WHEN x.old IS NULL THEN 'add' WHEN x.new IS NULL THEN 'remove' ELSE 'replace' END AS op, x.old AS old_value, x.new AS value FROM m WHERE x.old IS DISTINCT FROM x.new""",
)
def struct_diff(spark, d):
    """Patches from each packet's properties to those of the one before it on its track."""
    k = F.get_json_object("props", "$.k")
    extra = F.when(k.cast("long") % 2 == 0, "yes")
    now = F.map_filter(F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("k"), k, F.lit("extra"), extra), lambda _, v: v.isNotNull())
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").withColumn("now", now).withColumn("was", F.lag("now").over(w)).where("was is not null")
    return rows.select("event_id", F.explode(T.map_diff(F.col("was"), F.col("now"))).alias("x")).select("event_id", "x.*")


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"type\":\"' || event_type || '\"}' AS doc FROM events")
def json_props(spark, d):
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("doc"))
