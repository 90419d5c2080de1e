"""Queries over container files: each track's packets written as a file, and read back by the parser."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.operators.joins import kept
from kinograph.plans.registry import query
from kinograph.sources import containers as C
from kinograph.sources import matroska as M
from kinograph.sources import ranges, sink
from kinograph.sources import writers as W
from kinograph.sources.scratch import fresh
from kinograph.sources.tables import PACKETS, packets

#: Packets as they are written: hundreds of milliseconds from the track's start in place of hours, so that clusters and fragments are many.
WRITTEN = f"""{PACKETS}, w AS (SELECT track, event_id, is_key, row_number() OVER (PARTITION BY track ORDER BY pts, event_id) - 1 AS n, (pts - min(pts) OVER (PARTITION BY track)) // 36000000 AS raw, 8 + event_id % 40 AS size FROM packets),
f AS (SELECT *, max(raw - n) OVER (PARTITION BY track ORDER BY n) + n AS ms FROM w)"""


def written(spark, d, size=None):
    """(track, event_id, n, ms, is_key, data): times never fall, a packet's data starts with its number."""
    w = Window.partitionBy("track").orderBy("pts", "event_id")
    p = packets(spark, d).withColumn("n", F.row_number().over(w).cast("long") - 1)
    p = p.withColumn("raw", F.call_function("div", F.col("pts") - F.min("pts").over(Window.partitionBy("track")), F.lit(36_000_000)))
    p = p.withColumn("ms", F.max(F.col("raw") - F.col("n")).over(Window.partitionBy("track").orderBy("n")) + F.col("n"))
    length = (F.lit(8) + F.col("event_id") % 40).cast("int") if size is None else F.lit(size)
    return p.select("track", "event_id", "n", "ms", "is_key", F.encode(F.rpad(F.concat(F.col("event_id").cast("string"), F.lit("|")), length, "x"), "UTF-8").alias("data"))


def track(rows):
    return rows.withColumn("track", F.col("path").cast("long"))


def numbered(rows, order):
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy(*order)).cast("long") - 1)


@query("mkv_packets", f"WITH {WRITTEN} SELECT track, n, ms * 1000 AS pts_us, size, is_key FROM f")
def mkv_packets(spark, d):
    """Clusters at key frames, one packet a block."""
    rows = M.mkv_packets(kept(M.mkv_rows(W.files(written(spark, d), "track", "n", W.mkv))))
    return track(numbered(rows, ["seq", "lace"]).drop("track")).select("track", "n", "pts_us", "size", "is_key")


def laced(spark, d, lacing, size=None):
    layout = lambda p: W.mkv(p, lacing=lacing, per_block=3, cluster_ms=1 << 40)
    rows = M.mkv_packets(M.mkv_rows(W.files(written(spark, d, size), "track", "n", layout)))
    return track(numbered(rows, ["seq", "lace"]).drop("track")).select("track", "n", "size", (F.col("lace") > 0).alias("laced"))


@query("mkv_xiph_lacing", f"WITH {WRITTEN} SELECT track, n, size FROM f")
def mkv_xiph_lacing(spark, d):
    return laced(spark, d, 1).drop("laced")


@query("mkv_fixed_lacing", f"WITH {WRITTEN} SELECT track, n, CAST(16 AS BIGINT) AS size FROM f")
def mkv_fixed_lacing(spark, d):
    return laced(spark, d, 2, 16).select("track", "n", "size")


@query("mkv_ebml_lacing", f"WITH {WRITTEN} SELECT track, n, size FROM f")
def mkv_ebml_lacing(spark, d):
    return laced(spark, d, 3).select("track", "n", "size")


#: Pictures are as wide as the file has packets, so that no two headers need be alike.
WIDE = f"WITH {WRITTEN}, h AS (SELECT track, CAST(16 + count(*) AS BIGINT) AS width, CAST(9 + count(*) FILTER (is_key) AS BIGINT) AS height FROM f GROUP BY track)"


def sized(packets):
    return {"width": 16 + len(packets), "height": 9 + sum(p[1] for p in packets)}


@query("mkv_tracks", f"{WIDE} SELECT track, 'video' AS type, 'V_MPEG4/ISO/AVC' AS codec, width, height FROM h")
def mkv_tracks(spark, d):
    rows = M.mkv_tracks(M.mkv_rows(W.files(written(spark, d), "track", "n", lambda p: W.mkv(p, **sized(p)))))
    return track(rows.drop("track")).select("track", "type", "codec", "width", "height")


@query(
    "mp4_samples",
    f"WITH {WRITTEN} SELECT track, n, (ms - first_value(ms) OVER (PARTITION BY track ORDER BY n)) * 1000 AS dts_us, size, is_key OR NOT bool_or(is_key) OVER (PARTITION BY track) AS is_key, CAST(32 + coalesce(sum(size) OVER (PARTITION BY track ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM f",
)
def mp4_samples(spark, d):
    """Sample tables written and expanded again: times by runs, offsets by chunks. Without any key listed, every sample is one."""
    rows = C.mp4_samples(kept(C.mp4_rows(W.files(written(spark, d), "track", "n", W.mp4))))  # the tables are joined many times over, the files written once
    return track(rows.drop("track")).select("track", (F.col("sample") - 1).alias("n"), "dts_us", "size", "is_key", "offset")


@query("mp4_track_headers", f"{WIDE} SELECT track, 'vide' AS type, width, height, 1000 AS timescale, printf('avc1.%02x00%02x', width % 256, height % 256) AS codec FROM h")
def mp4_track_headers(spark, d):
    layout = lambda p: W.mp4(p, **(s := sized(p)), config=bytes([1, s["width"] % 256, 0, s["height"] % 256]))
    rows = C.mp4_tracks(W.files(written(spark, d), "track", "n", layout))
    return track(rows.drop("track")).select("track", "type", "width", "height", "timescale", "codec")


@query("avi_chunks", f"WITH {WRITTEN} SELECT track, n, n * 1000000 // 25 AS pts_us, size, is_key FROM f")
def avi_chunks(spark, d):
    """Chunks at a constant rate, key flags by the index."""
    return track(C.avi_packets(W.files(written(spark, d), "track", "n", W.avi))).select("track", "n", "pts_us", "size", "is_key")


@query(
    "fragment_cuts",
    f"""WITH RECURSIVE {WRITTEN}, c AS (SELECT track, ms AS start, 1 AS fragment FROM f WHERE n = 0
UNION ALL SELECT c.track, (SELECT min(f.ms) FROM f WHERE f.track = c.track AND f.is_key AND f.ms >= c.start + 2000), c.fragment + 1 FROM c WHERE c.start IS NOT NULL),
s AS (SELECT track, fragment, start, lead(start) OVER (PARTITION BY track ORDER BY fragment) AS til FROM c WHERE start IS NOT NULL)
SELECT s.track, CAST(s.fragment AS BIGINT) AS fragment, s.start AS first_dts, count(*) AS samples, CAST(sum(f.size) AS BIGINT) AS bytes FROM s JOIN f ON f.track = s.track AND f.ms >= s.start AND (s.til IS NULL OR f.ms < s.til) GROUP BY ALL""",
)
def fragment_cuts(spark, d):
    """Fragments start at the first key frame two seconds after the last start; written as movie fragments and read back."""
    rows = track(C.mp4_fragments(W.files(written(spark, d), "track", "n", W.fragmented_mp4)))
    return rows.groupBy("track", "fragment").agg(F.min("dts").alias("first_dts"), F.count("*").alias("samples"), F.sum("size").alias("bytes"))


@query(
    "bmp_images",
    """WITH p AS (SELECT vec_id AS source_id, unnest(range(0, len(embedding))) AS p, unnest(embedding) AS v, len(embedding) AS n FROM embeddings)
SELECT source_id, p, CAST(54 + (n + 7) // 8 * 24 AS BIGINT) AS bytes, CAST(greatest(0, least(255, floor(CAST(v AS DOUBLE) * 128 + 128))) AS BIGINT) AS grey FROM p""",
)
def bmp_images(spark, d):
    """Every source's samples as a picture eight wide; every pixel is read from the file again, by its place from the bottom row up."""
    from kinograph.sources.tables import pcm

    grey = F.transform("x", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v * 128 + 128))).cast("int"))
    images = pcm(spark, d).select("source_id", F.size("x").alias("n"), W.bmp(F.transform(grey, lambda g: g * 65793), 8).alias("image"))
    start = F.conv(F.hex(F.reverse(F.substring("image", 11, 4))), 16, 10).cast("int")
    rows = images.withColumns({"start": start, "p": F.explode(F.expr("sequence(0L, n - 1L)"))}).withColumn("row", F.expr("(n + 7) div 8 - 1 - p div 8"))
    at = F.expr("start + row * 24 + p % 8 * 3 + 1").cast("int")
    return rows.select("source_id", "p", F.length("image").cast("long").alias("bytes"), F.conv(F.hex(F.substring("image", at, F.lit(1))), 16, 10).cast("long").alias("grey"))


def streams(spark, d):
    """Packets with odd numbers as the second stream of their file."""
    return written(spark, d).select(F.col("track").cast("string").alias("key"), (F.col("event_id") % 2).cast("int").alias("stream"), "ms", "is_key", "data", "event_id")


#: Within a stream times never fall; a file's samples lie by time, then stream.
STREAMS = f"""{WRITTEN}, s AS (SELECT track, event_id, event_id % 2 AS stream, ms, is_key, size, row_number() OVER (PARTITION BY track, event_id % 2 ORDER BY ms, event_id) - 1 AS i FROM f),
t AS (SELECT *, max(ms - i) OVER (PARTITION BY track, stream ORDER BY i) + i AS steady FROM s),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY track ORDER BY ms, stream, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)"""


@query(
    "mp4_two_streams",
    f"""WITH {STREAMS} SELECT track, stream, i AS n, (steady - first_value(steady) OVER (PARTITION BY track, stream ORDER BY i)) * 1000 AS dts_us, size, CAST(40 + before AS BIGINT) AS "offset",
CASE stream WHEN 1 THEN true ELSE is_key OR NOT bool_or(is_key) OVER (PARTITION BY track, stream) END AS is_key, event_id FROM o""",
)
def mp4_two_streams(spark, d):
    """Two interleaved streams written as files, listed by ranges, and every sample's bytes fetched again."""
    folder = fresh(spark, "mp4")
    sink.write_containers(streams(spark, d), folder, "mp4", order=["event_id"])
    rows = kept(ranges.read(spark, folder, "mp4"))  # the tables are joined many times over, the files listed once
    kinds = rows.where("what in ('vide', 'soun')").select("path", "track", F.when(F.col("what") == "vide", 0).otherwise(1).cast("long").alias("stream"))
    samples = ranges.payloads(C.mp4_samples(rows)).join(kinds, ["path", "track"])
    return samples.select(file_number("mp4"), "stream", (F.col("sample") - 1).alias("n"), "dts_us", "size", "offset", "is_key", packet_number())


@query("mkv_cluster_ranges", f"WITH {STREAMS} SELECT track, stream, i AS n, steady * 1000 AS pts_us, size, is_key, event_id FROM o")
def mkv_cluster_ranges(spark, d):
    """The same packets in Matroska files, read in many ranges of clusters."""
    folder = fresh(spark, "mkv")
    sink.write_containers(streams(spark, d), folder, "matroska", order=["event_id"])
    frames = ranges.payloads(M.mkv_packets(kept(ranges.read(spark, folder, "matroska", splitBytes=4096))))
    n = F.row_number().over(Window.partitionBy("path", "stream").orderBy("seq")).cast("long") - 1
    out = frames.withColumn("stream", F.col("track") - 1)
    return out.select(file_number("mkv"), "stream", n.alias("n"), "pts_us", "size", "is_key", packet_number())


@query("ogg_pages", f"WITH {STREAMS} SELECT track, stream, i AS n, size, event_id FROM o")
def ogg_pages(spark, d):
    """The same packets in Ogg pages, two logical streams a file; the two header packets of each are left out here."""
    folder = fresh(spark, "ogg")
    sink.write_containers(streams(spark, d), folder, "ogg", order=["event_id"])
    packets = ranges.payloads(C.ogg_joined(ranges.read(spark, folder, "ogg")).where("packet >= 2 and complete"))
    return packets.select(file_number("ogg"), (F.col("serial") - 1).alias("stream"), (F.col("packet") - 2).alias("n"), "size", packet_number())


def file_number(suffix):
    return F.regexp_extract("path", rf"([0-9]+)\.{suffix}$", 1).cast("long").alias("track")


def packet_number():
    """A packet's data starts with its number."""
    return F.split_part(F.decode("data", "UTF-8"), F.lit("|"), F.lit(1)).cast("long").alias("event_id")
