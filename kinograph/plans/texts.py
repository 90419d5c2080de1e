"""Queries of the text family: subtitles, markup, names, note sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinograph.functions import text as T
from kinograph.plans.registry import query
from kinograph.sources.tables import CUES, cues, table

STAMP = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query("srt_parse", f"WITH {CUES} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY cue_no) AS cue_no, start_ms, end_ms, text FROM (SELECT conv_id, cue_no, start_ms, end_ms, trim(regexp_replace(text, '\\n[ \\t]*\\n+', chr(10), 'g'), ' ' || chr(10) || chr(9)) AS text FROM cues)")
def srt_parse(spark, d):
    """Each conversation written as one SRT document and read again."""
    body = F.trim(F.regexp_replace("text", r"\n[ \t]*\n+", "\n"), F.lit(" \n\t"))
    head = F.concat((F.col("cue_no") + 1).cast("string"), F.lit("\r\n"), T.format_stamp(F.col("start_ms")), F.lit(" --> "), T.format_stamp(F.col("end_ms")))
    block = F.struct("cue_no", F.concat(head, F.lit("\r\n<i>"), body, F.lit("</i>\r\n\r\n")).alias("block"))
    docs = cues(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("b"))
    text = F.concat(F.lit("﻿"), F.array_join(F.transform("b", lambda x: x["block"]), ""))
    return docs.select("conv_id", F.posexplode(T.srt_cues(text)).alias("n", "c")).select("conv_id", (F.col("n") + 1).cast("long").alias("cue_no"), "c.*")


@query("vtt_settings", f"WITH {CUES} SELECT conv_id, cue_no, start_ms, end_ms, CAST(cue_no % 5 * 20 AS DOUBLE) AS position, CASE WHEN cue_no % 2 = 0 THEN 'left' ELSE 'center' END AS align FROM cues")
def vtt_settings(spark, d):
    side = F.when(F.col("cue_no") % 2 == 0, " align:left").otherwise(" align:start")
    line = F.concat(T.format_stamp(F.col("start_ms"), "."), F.lit(" --> "), T.format_stamp(F.col("end_ms"), "."), F.lit(" position:"), (F.col("cue_no") % 5 * 20).cast("string"), F.lit("%"), side)
    text = F.concat(F.lit("WEBVTT\n\nNOTE none\n\n"), line, F.lit("\nwords"))
    rows = cues(spark, d).select("conv_id", "cue_no", F.explode(T.vtt_cues(text)).alias("c"))
    return rows.select("conv_id", "cue_no", "c.start_ms", "c.end_ms", "c.position", "c.align")


@query("srt_format", f"WITH {CUES} SELECT conv_id, cue_no, {STAMP.format('(start_ms + conv_id * 61001)')} AS stamp FROM cues")
def srt_format(spark, d):
    return cues(spark, d).select("conv_id", "cue_no", T.format_stamp(F.col("start_ms") + F.col("conv_id") * 61_001).alias("stamp"))


@query("strip_tags", "SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages")
def strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("digest"))


@query(
    "html_sanitize",
    r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace('<p onclick="x()">' || html || '</foreignObject>', '<script\b.*?</script\s*>', '', 'gis'), '</?style\b[^>]*>', '', 'gis'), '</foreignObject\s*>', '', 'gis'),
'\son\w+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', '', 'gis')) AS digest FROM pages""",
)
def html_sanitize(spark, d):
    html = F.concat(F.lit('<p onclick="x()">'), F.col("html"), F.lit("</foreignObject>"))
    return table(spark, d, "pages").select("page_id", F.md5(T.sanitize_html(html)).alias("digest"))


@query("slug_ext", "SELECT p_partkey AS p, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS slug, CASE WHEN p_partkey % 3 = 0 THEN 'mp4' WHEN p_partkey % 3 = 1 THEN 'webm' END AS ext FROM part")
def slug_ext(spark, d):
    end = F.when(F.col("p_partkey") % 3 == 0, ".MP4").when(F.col("p_partkey") % 3 == 1, ".webm").otherwise("")
    return table(spark, d, "part").select(F.col("p_partkey").alias("p"), T.slug(F.col("p_name")).alias("slug"), T.extension(F.concat("p_name", end)).alias("ext"))


@query(
    "chiptune_schedule",
    """WITH n AS (SELECT range AS i, (['C4', 'E4', 'G4', 'REST', 'A4', 'C5'])[range % 6 + 1] AS note FROM range(0, 24)), m AS (SELECT * FROM (VALUES ('C4', 60), ('E4', 64), ('G4', 67), ('A4', 69), ('C5', 72)) v(note, midi))
SELECT i, n.note, i * 250 AS start_ms, round(coalesce(440 * power(2, (midi - 69) / 12.0::DOUBLE), 0), 4) AS hertz FROM n LEFT JOIN m ON m.note = n.note""",
)
def chiptune_schedule(spark, d):
    song = spark.range(1).select(F.repeat(F.lit("c4 e4  g4 rest a4 c5 "), 4).alias("s"))
    notes = song.select(F.posexplode(F.split(F.trim(F.upper("s")), r"\s+")).alias("i", "note"))
    return notes.select(F.col("i").cast("long").alias("i"), "note", (F.col("i") * 250).cast("long").alias("start_ms"), F.round(T.note_hertz(F.col("note")), 4).alias("hertz"))
