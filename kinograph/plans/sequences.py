"""Queries over ordered packets: runs, offsets, gaps, aggregates, windows of time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.operators import sequences as S
from kinograph.plans.registry import query
from kinograph.sources.tables import CLIPS, PACKETS, SAMPLES, clips, packets, pcm, samples, table


def by_track():
    return Window.partitionBy("track").orderBy("pts", "event_id")


@query("timeline_duration", f"WITH {CLIPS} SELECT track, coalesce(max(hi), 0) AS duration FROM clips GROUP BY track")
def timeline_duration(spark, d):
    return clips(spark, d).groupBy("track").agg(F.coalesce(F.max("hi"), F.lit(0)).alias("duration"))


@query(
    "gop_table",
    f"""WITH {PACKETS}, n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY pts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY track) AS total FROM packets)
SELECT track, event_id, pts AS start_pts, coalesce(lead(pts) OVER w, pts + (total - idx) * 33333) AS end_pts, coalesce(lead(idx) OVER w, total) - idx AS frames FROM n WHERE is_key WINDOW w AS (PARTITION BY track ORDER BY idx)""",
)
def gop_table(spark, d):
    n = packets(spark, d).withColumns({"idx": F.row_number().over(by_track()).cast("long") - 1, "total": F.count("*").over(Window.partitionBy("track"))}).where("is_key")
    w = Window.partitionBy("track").orderBy("idx")
    end = F.coalesce(F.lead("pts").over(w), F.col("pts") + (F.col("total") - F.col("idx")) * 33_333)
    frames = F.coalesce(F.lead("idx").over(w), F.col("total")) - F.col("idx")
    return n.select("track", "event_id", F.col("pts").alias("start_pts"), end.alias("end_pts"), frames.alias("frames"))


@query(
    "pipeline_stats",
    f"""WITH {PACKETS} SELECT count(*) AS total, count(*) FILTER (event_type = 'view') AS rendered, count(*) FILTER (event_type = 'error') AS skipped, count(*) FILTER (event_type = 'click') AS cached,
round(avg(value) FILTER (event_type = 'view'), 4) AS avg_ms, round(1000 / avg(value) FILTER (event_type = 'view'), 4) AS fps, round(count(*) FILTER (event_type = 'click') / CAST(nullif(count(*), 0) AS DOUBLE), 6) AS hit_rate FROM packets""",
)
def pipeline_stats(spark, d):
    kind = lambda k: F.count_if(F.col("event_type") == k)
    ms = F.avg(F.when(F.col("event_type") == "view", F.col("value")))
    return packets(spark, d).agg(
        F.count("*").alias("total"), kind("view").alias("rendered"), kind("error").alias("skipped"), kind("click").alias("cached"),
        F.round(ms, 4).alias("avg_ms"), F.round(F.try_divide(F.lit(1000.0), ms), 4).alias("fps"), F.round(F.try_divide(kind("click"), F.count("*")), 6).alias("hit_rate"),
    )


@query("invalidate_bytes", f"WITH {PACKETS} SELECT track, CAST(sum(size) AS BIGINT) AS freed, count(*) AS frames FROM packets WHERE track % 3 = 0 AND pts >= 1704499200000000 AND pts < 1705104000000000 GROUP BY track")
def invalidate_bytes(spark, d):
    gone = packets(spark, d).where("track % 3 = 0 and pts >= 1704499200000000 and pts < 1705104000000000")
    return gone.groupBy("track").agg(F.sum("size").alias("freed"), F.count("*").alias("frames"))


RLE = f"""WITH {PACKETS}, r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY pts, event_id) - row_number() OVER (PARTITION BY track, event_type ORDER BY pts, event_id) AS g FROM packets),
e AS (SELECT track, event_type, min(pts) AS first_pts, count(*) AS n FROM r GROUP BY track, event_type, g)"""


def coded(spark, d):
    rows = S.runs(packets(spark, d), ["track"], ["pts", "event_id"], F.col("event_type"))
    return rows.groupBy("track", "run").agg(F.first("event_type").alias("event_type"), F.min("pts").alias("first_pts"), F.count("*").alias("n"))


@query("rle_encode", RLE + " SELECT track, event_type, first_pts, n FROM e")
def rle_encode(spark, d):
    return coded(spark, d).select("track", "event_type", "first_pts", "n")


@query("rle_expand", RLE + ", x AS (SELECT track, event_type, first_pts, unnest(range(0, n)) AS k FROM e) SELECT track, event_type, first_pts, k FROM x")
def rle_expand(spark, d):
    return S.rle_expand(coded(spark, d), "n").select("track", "event_type", "first_pts", "k")


@query("keyframe_index", f"WITH {PACKETS}, n AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY pts, event_id) AS sample FROM packets) SELECT track, sample FROM n WHERE is_key")
def keyframe_index(spark, d):
    return packets(spark, d).withColumn("sample", F.row_number().over(by_track())).where("is_key").select("track", "sample")


@query("prefix_sum_offsets", f"WITH {PACKETS} SELECT track, event_id, CAST(coalesce(sum(size + 8) OVER (PARTITION BY track ORDER BY pts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM packets")
def prefix_sum_offsets(spark, d):
    return S.offsets(packets(spark, d), ["track"], ["pts", "event_id"], F.col("size") + 8).select("track", "event_id", "offset")


@query("per_stream_pts", f"WITH {PACKETS} SELECT track, event_id, (row_number() OVER (PARTITION BY track ORDER BY pts, event_id) - 1) * 1001 * 1000000 // 30000 AS pts_us FROM packets")
def per_stream_pts(spark, d):
    n = F.row_number().over(by_track()).cast("long") - 1
    return packets(spark, d).withColumn("n", n).select("track", "event_id", F.expr("n * 1001 * 1000000 div 30000").alias("pts_us"))


@query("rebase_pts", f"WITH {PACKETS} SELECT track, event_id, pts - min(pts) OVER (PARTITION BY track) AS pts FROM packets")
def rebase_pts(spark, d):
    return packets(spark, d).select("track", "event_id", (F.col("pts") - F.min("pts").over(Window.partitionBy("track"))).alias("pts"))


@query("chunk_pts_drift", f"WITH {PACKETS} SELECT track, event_id, CAST(coalesce(sum(size * 1000000 // 44100) OVER (PARTITION BY track ORDER BY pts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pts_us FROM packets")
def chunk_pts_drift(spark, d):
    return S.offsets(packets(spark, d), ["track"], ["pts", "event_id"], F.expr("size * 1000000 div 44100"), "pts_us").select("track", "event_id", "pts_us")


@query(
    "packet_reassembly",
    f"""WITH {PACKETS}, s AS (SELECT track, event_id, pts, CAST(floor(value) AS BIGINT) AS seg FROM packets),
p AS (SELECT *, coalesce(sum(CASE WHEN seg < 255 THEN 1 ELSE 0 END) OVER (PARTITION BY track ORDER BY pts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS packet FROM s)
SELECT track, CAST(packet AS BIGINT) AS packet, count(*) AS segments, CAST(sum(seg) AS BIGINT) AS bytes, min(seg) < 255 AS complete FROM p GROUP BY track, packet""",
)
def packet_reassembly(spark, d):
    seg = F.floor("value").cast("long")
    rows = packets(spark, d).withColumn("seg", seg)
    rows = S.offsets(rows, ["track"], ["pts", "event_id"], F.when(F.col("seg") < 255, 1).otherwise(0), "packet")
    return rows.groupBy("track", "packet").agg(F.count("*").alias("segments"), F.sum("seg").alias("bytes"), (F.min("seg") < 255).alias("complete"))


QUIET = f"""WITH {SAMPLES}, q AS (SELECT source_id, i, abs(x) < 0.03::DOUBLE AS quiet FROM samples),
g AS (SELECT *, i - row_number() OVER (PARTITION BY source_id ORDER BY i) AS grp FROM q WHERE quiet),
r AS (SELECT source_id, min(i) AS first_i, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY source_id, grp HAVING count(*) >= 3)"""


def islands(spark, d):
    """Runs of at least three quiet samples: each source's array is cut where the quiet indices jump."""
    quiet = samples(spark, d).where(F.abs("x") < 0.03)
    group = F.col("i") - F.row_number().over(Window.partitionBy("source_id").orderBy("i"))
    found = quiet.withColumn("g", group).groupBy("source_id", "g").agg(F.min("i").alias("first_i"), F.count("*").alias("n"))
    return found.where("n >= 3").select("source_id", "first_i", "n")


@query("silence_islands", QUIET + " SELECT * FROM r")
def silence_islands(spark, d):
    return islands(spark, d)


@query("silence_removed", QUIET + " SELECT s.source_id, row_number() OVER (PARTITION BY s.source_id ORDER BY s.i) - 1 AS i, s.x FROM samples s LEFT JOIN r ON r.source_id = s.source_id AND s.i >= r.first_i AND s.i < r.first_i + r.n WHERE r.source_id IS NULL")
def silence_removed(spark, d):
    gone = islands(spark, d).withColumn("i", F.explode(F.sequence(F.col("first_i").cast("long"), F.col("first_i") + F.col("n") - 1))).select("source_id", F.col("i").cast("int").alias("i"))
    kept = samples(spark, d).join(gone, ["source_id", "i"], "left_anti")
    return kept.select("source_id", (F.row_number().over(Window.partitionBy("source_id").orderBy("i")).cast("long") - 1).alias("i"), "x")


@query("lag_intervals", f"WITH {PACKETS} SELECT track, event_id, pts - lag(pts) OVER (PARTITION BY track ORDER BY pts, event_id) AS gap FROM packets")
def lag_intervals(spark, d):
    return packets(spark, d).select("track", "event_id", (F.col("pts") - F.lag("pts").over(by_track())).alias("gap"))


@query(
    "bpm_histogram",
    f"""WITH {PACKETS}, g AS (SELECT track, pts, (pts - lag(pts) OVER (PARTITION BY track ORDER BY pts, event_id)) // 3600000000 AS iv FROM packets),
b AS (SELECT track, CAST(floor(iv / 10.0::DOUBLE + 0.5::DOUBLE) * 10 AS BIGINT) AS bucket, pts FROM g WHERE iv BETWEEN 1 AND 40),
h AS (SELECT track, bucket, count(*) AS n, min(pts) AS first_seen FROM b GROUP BY track, bucket)
SELECT track, bucket, n FROM h QUALIFY row_number() OVER (PARTITION BY track ORDER BY n DESC, first_seen) = 1""",
)
def bpm_histogram(spark, d):
    gap = F.call_function("div", F.col("pts") - F.lag("pts").over(by_track()), F.lit(3_600_000_000))
    rows = packets(spark, d).select("track", "pts", gap.alias("iv")).where("iv between 1 and 40")
    bucket = (F.floor(F.col("iv") / 10.0 + 0.5) * 10).cast("long")
    bins = rows.groupBy("track", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("pts").alias("first_seen"))
    best = F.max_by(F.struct("bucket", "n"), F.struct(F.col("n"), -F.col("first_seen")))
    return bins.groupBy("track").agg(best.alias("b")).select("track", "b.bucket", "b.n")


@query("upper_median", f"WITH {PACKETS} SELECT track, list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM packets GROUP BY track")
def upper_median(spark, d):
    return S.upper_median(packets(spark, d), ["track"], "value")


@query(
    "rolling_median_peaks",
    """WITH h AS (SELECT 0 AS k, epoch_us(ts) // 3600000000 AS hour, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS x FROM events GROUP BY 2),
w AS (SELECT hour, x, lag(x) OVER (ORDER BY hour) AS p, lead(x) OVER (ORDER BY hour) AS f, list(x) OVER (ORDER BY hour ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING) AS a FROM h)
SELECT hour, x FROM w WHERE len(a) = 33 AND x > 1.4::DOUBLE * list_sort(a)[17] + 0.01::DOUBLE AND x >= p AND x >= f""",
)
def rolling_median_peaks(spark, d):
    """Peaks of the hourly totals: one series, aggregated to one row an hour before it is ordered."""
    hour = F.call_function("div", F.col("pts"), F.lit(3_600_000_000))
    h = packets(spark, d).groupBy(hour.alias("hour")).agg(F.sum("size").alias("x")).withColumn("k", F.lit(0))
    w = Window.partitionBy("k").orderBy("hour")
    h = h.withColumns({"m": S.rolling_median("x", ["k"], ["hour"], 16), "p": F.lag("x").over(w), "f": F.lead("x").over(w)})
    return h.where("m is not null and x > 1.4D * m + 0.01D and x >= p and x >= f").select("hour", "x")


@query(
    "greedy_min_gap",
    f"""WITH RECURSIVE {PACKETS}, t AS (SELECT track, pts // 1000000 AS t FROM packets), g AS (SELECT track, min(t) AS t FROM t GROUP BY track
UNION ALL SELECT g.track, (SELECT min(t.t) FROM t WHERE t.track = g.track AND t.t - g.t > 20000) FROM g WHERE g.t IS NOT NULL) SELECT track, t FROM g WHERE t IS NOT NULL""",
)
def greedy_min_gap(spark, d):
    rows = packets(spark, d).select("track", F.expr("pts div 1000000").alias("t"), "event_id").withColumn("at", F.col("t"))

    def make():
        step = S.greedy_gap_steps(20_000)
        return lambda t, event_id, at: [step(at)]

    return S.grouped_fold(rows, "track", ["t", "event_id"], "at", make, "track long, t long, event_id long, taken boolean").where("taken").select("track", "t")


@query(
    "changed_frames",
    f"""WITH {CLIPS}, e AS (SELECT track, clip_id, unnest(range(lo, hi)) AS day FROM clips), f AS (SELECT track, day, list_sort(list(clip_id)) AS ids FROM e GROUP BY track, day),
l AS (SELECT track, day, ids, lag(ids) OVER (PARTITION BY track ORDER BY day) AS was FROM f) SELECT track, day, len(ids) AS n FROM l WHERE was IS NULL OR was <> ids""",
)
def changed_frames(spark, d):
    """Frames of every track whose set of clips differs from the frame before.

    Clips last a day at least, so that a set changes exactly where a clip starts or ends; a running sum of both counts its clips.
    """
    c = clips(spark, d)
    starts, ends = c.select("track", F.col("lo").alias("day"), F.lit(1).alias("step")), c.select("track", F.col("hi").alias("day"), F.lit(-1).alias("step"))
    steps = starts.unionByName(ends).groupBy("track", "day").agg(F.sum("step").alias("step"))
    held = F.sum("step").over(Window.partitionBy("track").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("n", held).where("n > 0").select("track", "day", "n")


@query("waveform_bins", f"WITH {SAMPLES} SELECT source_id, i // 8 AS bin, round(avg(abs(x)), 6) AS level FROM samples GROUP BY 1, 2")
def waveform_bins(spark, d):
    bins = F.transform(S.numbers(F.ceil(F.size("x") / 8)), lambda b: S.mean(F.transform(F.slice("x", b * 8 + 1, 8), F.abs)))
    return pcm(spark, d).select("source_id", F.posexplode(bins).alias("bin", "level")).select("source_id", "bin", F.round("level", 6).alias("level"))


@query("downmix_mono", f"WITH {SAMPLES} SELECT source_id, i // 2 AS frame, round(avg(x), 6) AS x FROM samples GROUP BY 1, 2")
def downmix_mono(spark, d):
    mono = F.transform(S.numbers(F.ceil(F.size("x") / 2)), lambda k: S.mean(F.slice("x", k * 2 + 1, 2)))
    return pcm(spark, d).select("source_id", F.posexplode(mono).alias("frame", "x")).select("source_id", "frame", F.round("x", 6).alias("x"))


@query("block_rms", f"WITH {SAMPLES} SELECT source_id, i // 16 AS block, round(sqrt(avg(x * x)), 6) AS rms FROM samples GROUP BY 1, 2")
def block_rms(spark, d):
    blocks = F.transform(S.numbers(F.ceil(F.size("x") / 16)), lambda b: F.sqrt(S.mean(F.transform(F.slice("x", b * 16 + 1, 16), lambda v: v * v))))
    return pcm(spark, d).select("source_id", F.posexplode(blocks).alias("block", "rms")).select("source_id", "block", F.round("rms", 6).alias("rms"))


@query(
    "mix_sum",
    f"""WITH {SAMPLES}, a AS (SELECT source_id // 2 AS mix, i + CASE WHEN source_id % 2 = 1 THEN 8 ELSE 0 END AS i, CAST(floor(x * CASE WHEN source_id % 2 = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * 1000000) AS BIGINT) AS v FROM samples)
SELECT mix, i, CAST(sum(v) AS BIGINT) AS v FROM a GROUP BY mix, i""",
)
def mix_sum(spark, d):
    """Neighbouring sources mixed: the second starts eight samples later at half gain."""
    odd = F.col("source_id") % 2 == 1
    gain = F.when(odd, 0.5).otherwise(1.0)
    rows = samples(spark, d).select(F.expr("source_id div 2").alias("mix"), (F.col("i") + F.when(odd, 8).otherwise(0)).alias("i"), F.floor(F.col("x") * gain * 1_000_000).cast("long").alias("v"))
    return rows.groupBy("mix", "i").agg(F.sum("v").alias("v"))


@query("deinterleave", f"WITH {SAMPLES} SELECT source_id, i % 2 AS ch, i // 2 AS frame, x FROM samples")
def deinterleave(spark, d):
    return samples(spark, d).select("source_id", (F.col("i") % 2).alias("ch"), F.expr("i div 2").cast("int").alias("frame"), "x")


@query("chunk_array", f"WITH {SAMPLES} SELECT source_id, c.range AS chunk, list_sum(a[c.range * 24 + 1 : c.range * 24 + 24]) AS total, len(a[c.range * 24 + 1 : c.range * 24 + 24]) AS n FROM pcm, LATERAL (SELECT unnest(range(0, CAST(ceil(len(a) / 24) AS BIGINT))) AS range) c".replace("list_sum(a[c.range * 24 + 1 : c.range * 24 + 24])", "round(list_sum(a[c.range * 24 + 1 : c.range * 24 + 24]), 6)"))
def chunk_array(spark, d):
    chunks = F.transform(S.numbers(F.ceil(F.size("x") / 24)), lambda c: F.slice("x", c * 24 + 1, 24))
    rows = pcm(spark, d).select("source_id", F.posexplode(chunks).alias("chunk", "a"))
    return rows.select("source_id", F.col("chunk").cast("long").alias("chunk"), F.round(F.aggregate("a", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.size("a").cast("long").alias("n"))


@query("array_lerp", f"WITH {SAMPLES} SELECT p.source_id, s.range AS i, round(p.a[s.range + 1] + (q.a[s.range + 1] - p.a[s.range + 1]) * 0.25::DOUBLE, 6) AS x FROM pcm p JOIN pcm q ON q.source_id = p.source_id + 1, range(0, 64) s")
def array_lerp(spark, d):
    follow = pcm(spark, d).select((F.col("source_id") - 1).alias("source_id"), F.col("x").alias("y"))
    mixed = F.zip_with("x", "y", lambda a, b: a + (b - a) * F.lit(0.25))
    return pcm(spark, d).join(follow, "source_id").select("source_id", F.posexplode(mixed).alias("i", "x")).select("source_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("decimate", f"WITH {SAMPLES} SELECT source_id, i // 4 AS i, x FROM samples WHERE i % 4 = 0")
def decimate(spark, d):
    return samples(spark, d).where("i % 4 = 0").select("source_id", F.expr("i div 4").cast("int").alias("i"), "x")


@query("karaoke_lr", f"WITH {SAMPLES} SELECT source_id, k.range AS frame, round((a[2 * k.range + 1] - a[2 * k.range + 2]) / 2, 6) AS x FROM pcm, LATERAL (SELECT unnest(range(0, len(a) // 2)) AS range) k")
def karaoke_lr(spark, d):
    sides = F.transform(S.numbers(F.floor(F.size("x") / 2)), lambda k: (F.get("x", k * 2) - F.get("x", k * 2 + 1)) / 2)
    return pcm(spark, d).select("source_id", F.posexplode(sides).alias("frame", "x")).select("source_id", F.col("frame").cast("long").alias("frame"), F.round("x", 6).alias("x"))


@query("bleep_gate", f"WITH {SAMPLES} SELECT source_id, i, round(CASE WHEN i >= 20 AND i < 40 THEN sin(2 * pi() * 1000 * i / 8000.0::DOUBLE) * 0.5::DOUBLE ELSE x END, 6) AS x FROM samples")
def bleep_gate(spark, d):
    tone = F.sin(F.lit(2.0) * F.pi() * 1000 * F.col("i") / 8000.0) * 0.5
    return samples(spark, d).select("source_id", "i", F.round(F.when(F.col("i").between(20, 39), tone).otherwise(F.col("x")), 6).alias("x"))


@query(
    "echo_taps",
    f"""WITH {SAMPLES} SELECT source_id, s.range AS i, round(a[s.range + 1] + 0.5::DOUBLE * (CASE WHEN s.range >= 10 THEN a[s.range - 9] ELSE 0 END + 0.5::DOUBLE * CASE WHEN s.range >= 20 THEN a[s.range - 19] ELSE 0 END + 0.25::DOUBLE * CASE WHEN s.range >= 30 THEN a[s.range - 29] ELSE 0 END), 6) AS x FROM pcm, range(0, 64) s""",
)
def echo_taps(spark, d):
    """Three taps ten samples apart, feedback one half, wet share one half."""
    tap = lambda i, k: F.coalesce(F.when(i >= 10 * k, F.get("x", i - 10 * k)), F.lit(0.0)) * F.lit(0.5 ** (k - 1))
    out = F.transform("x", lambda v, i: v + F.lit(0.5) * (tap(i, 1) + tap(i, 2) + tap(i, 3)))
    return pcm(spark, d).select("source_id", F.posexplode(out).alias("i", "x")).select("source_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("hop_frames", f"WITH {SAMPLES} SELECT source_id, k.range * 8 AS start, round(list_sum(a[k.range * 8 + 1 : k.range * 8 + 16]), 6) AS total FROM pcm, range(0, 7) k")
def hop_frames(spark, d):
    frames = pcm(spark, d).select("source_id", F.explode(S.hops(F.col("x"), 16, 8)).alias("f"))
    return frames.select("source_id", "f.start", F.round(F.aggregate("f.samples", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("tumbling_chunks", "SELECT user_id AS track, epoch_us(ts) // 3600000000 AS hour, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS size FROM events GROUP BY 1, 2")
def tumbling_chunks(spark, d):
    rows = table(spark, d, "events").withColumn("size", F.floor(F.col("value") * 100).cast("long"))
    grouped = rows.groupBy(F.col("user_id").alias("track"), F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    return grouped.select("track", F.expr("unix_micros(w.start) div 3600000000").alias("hour"), "n", "size")


@query("hopping_windows", "SELECT e.h - k.range AS hour, count(*) AS n FROM (SELECT epoch_us(ts) // 3600000000 AS h FROM events) e, range(0, 2) k GROUP BY 1")
def hopping_windows(spark, d):
    w = F.window(F.col("ts").cast("timestamp"), "2 hours", "1 hour")
    return table(spark, d, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.expr("unix_micros(w.start) div 3600000000").alias("hour"), "n")


@query(
    "session_windows",
    f"""WITH {PACKETS}, g AS (SELECT *, CASE WHEN pts - lag(pts) OVER w > 1800000000 OR lag(pts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM packets WINDOW w AS (PARTITION BY track ORDER BY pts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY track ORDER BY pts, event_id) AS session FROM g) SELECT track, min(pts) AS start_pts, max(pts) AS last_pts, count(*) AS n FROM s GROUP BY track, session""",
)
def session_windows(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("track"), F.col("ts").cast("timestamp").alias("ts"))
    grouped = rows.groupBy("track", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return grouped.select("track", F.unix_micros("a").alias("start_pts"), F.unix_micros("b").alias("last_pts"), "n")


@query("cumulative_motion", f"WITH {PACKETS} SELECT track, event_id, CAST(sum(size - 25000) OVER (PARTITION BY track ORDER BY pts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS path FROM packets")
def cumulative_motion(spark, d):
    return packets(spark, d).select("track", "event_id", F.sum(F.col("size") - 25_000).over(by_track().rowsBetween(Window.unboundedPreceding, 0)).alias("path"))


NUMBERED = f"{PACKETS}, v AS (SELECT track, row_number() OVER (PARTITION BY track ORDER BY pts, event_id) AS n, value / 100 AS z FROM packets)"


def measured(spark, d):
    return packets(spark, d).select("track", "pts", "event_id", (F.col("value") / 100).alias("z"))


@query(
    "kalman_smooth",
    f"""WITH RECURSIVE {NUMBERED}, k AS (SELECT DISTINCT track, CAST(0 AS BIGINT) AS n, 1.0::DOUBLE AS p, 0.0::DOUBLE AS x FROM v
UNION ALL SELECT k.track, k.n + 1, (1 - (k.p + 0.00001::DOUBLE) / (k.p + 0.00001::DOUBLE + 0.01::DOUBLE)) * (k.p + 0.00001::DOUBLE), k.x + (k.p + 0.00001::DOUBLE) / (k.p + 0.00001::DOUBLE + 0.01::DOUBLE) * (v.z - k.x) FROM k JOIN v ON v.track = k.track AND v.n = k.n + 1)
SELECT track, n, round(x, 4) AS x FROM k WHERE n > 0""",
)
def kalman_smooth(spark, d):
    """A track of any length: the recurrence is scanned per stretch of time."""
    return S.kalman(measured(spark, d), ["track"], "pts", ["event_id"], "z").select("track", "n", F.round("x", 4).alias("x"))


@query(
    "ducking_gain",
    f"""WITH RECURSIVE {NUMBERED}, k AS (SELECT DISTINCT track, CAST(0 AS BIGINT) AS n, 1.0::DOUBLE AS g FROM v
UNION ALL SELECT k.track, k.n + 1, k.g * c + goal * (1 - c) FROM (SELECT k.*, v.z, CASE WHEN v.z > 2.5::DOUBLE THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS goal, CASE WHEN CASE WHEN v.z > 2.5::DOUBLE THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END < k.g THEN 0.3::DOUBLE ELSE 0.9::DOUBLE END AS c FROM k JOIN v ON v.track = k.track AND v.n = k.n + 1) k)
SELECT track, n, round(g, 5) AS gain FROM k WHERE n > 0""",
)
def ducking_gain(spark, d):
    return S.ducking(measured(spark, d), ["track"], "pts", ["event_id"], "z", 2.5, 4.0, 0.3, 0.9).select("track", "n", F.round("gain", 5).alias("gain"))


def coloured_sql() -> str:
    """The filters' definition, one sample after the other."""
    poles = [f"b{i}" for i in range(len(S.PINK))]
    steps = ", ".join(f"({a}::DOUBLE * k.{p} + v.w * {b}::DOUBLE) AS {p}" for p, (a, b) in zip(poles, S.PINK))
    zeros = ", ".join(f"0.0::DOUBLE AS {p}" for p in poles)
    return f"""WITH RECURSIVE {NUMBERED.replace("value / 100 AS z", "value / 250 - 1 AS w")}, k AS (SELECT DISTINCT track, CAST(0 AS BIGINT) AS n, {zeros}, 0.0::DOUBLE AS before, 0.0::DOUBLE AS w, 0.0::DOUBLE AS brown FROM v
UNION ALL SELECT k.track, k.n + 1, {steps}, k.w, v.w, (k.brown + {S.BROWN_IN}::DOUBLE * v.w) / {S.BROWN_LEAK}::DOUBLE FROM k JOIN v ON v.track = k.track AND v.n = k.n + 1)
SELECT track, n, round(({" + ".join(poles)} + before * {S.PINK_LATER}::DOUBLE + w * {S.PINK_NOW}::DOUBLE) * {S.PINK_WHOLE}::DOUBLE, 6) AS pink, round(brown * {S.BROWN_GAIN}::DOUBLE, 6) AS brown FROM k WHERE n > 0"""


@query("coloured_noise", coloured_sql())
def coloured_noise(spark, d):
    """Each track's values as white noise, made pink and brown."""
    white = packets(spark, d).select("track", "pts", "event_id", (F.col("value") / 250 - 1).alias("w"))
    out = S.coloured_noise(white, ["track"], "pts", ["event_id"], "w")
    return out.select("track", "n", F.round("pink", 6).alias("pink"), F.round("brown", 6).alias("brown"))


@query("last_value_per_key", "SELECT user_id AS track, event_type AS name, arg_max(value, ts) AS value FROM events GROUP BY 1, 2")
def last_value_per_key(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("track"), F.col("event_type").alias("name")).agg(F.max_by("value", "ts").alias("value"))
