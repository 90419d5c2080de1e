"""Logical inputs of the timeline engine, derived from the stored tables; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as clips: half-open day intervals on 16 tracks and 8 layers."""
    lo = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("clip_id"),
        (F.col("o_custkey") % 16).alias("track"),
        lo.alias("lo"),
        (lo + 1 + F.col("o_orderkey") % 50).alias("hi"),
        (F.col("o_custkey") % 8).alias("layer"),
        F.col("o_custkey").alias("source_id"),
        (F.col("o_orderstatus") == "P").alias("disabled"),
    )


CLIPS = """clips AS (SELECT *, lo + 1 + clip_id % 50 AS hi FROM (SELECT o_orderkey AS clip_id, o_custkey % 16 AS track,
  date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS lo, o_custkey % 8 AS layer, o_custkey AS source_id, o_orderstatus = 'P' AS disabled FROM orders))"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as encoded packets: one track per user, sign-ups as key frames."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("track"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("pts"),
        F.floor(F.col("value") * 100).cast("long").alias("size"),
        (F.col("event_type") == "signup").alias("is_key"),
        "event_type",
        "value",
    )


PACKETS = """packets AS (SELECT user_id AS track, event_id, epoch_us(ts) AS pts, CAST(floor(value * 100) AS BIGINT) AS size,
  event_type = 'signup' AS is_key, event_type, value FROM events)"""


def pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as sample arrays, one row per source; :func:`samples` is the long form."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), F.col("embedding").cast("array<double>").alias("x"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pcm(spark, sf_dir).select("source_id", F.posexplode("x").alias("i", "x"))


SAMPLES = """pcm AS (SELECT vec_id AS source_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings),
samples AS (SELECT source_id, CAST(unnest(range(0, len(a))) AS INT) AS i, unnest(a) AS x FROM pcm)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pixels with integer channels."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(p.alias("p"), (p * 37 % 256).alias("r"), (F.col("p_size") * 5 % 256).cast("long").alias("g"), (p * 11 % 256).alias("b"))


PIXELS = "pixels AS (SELECT p_partkey AS p, p_partkey * 37 % 256 AS r, CAST(p_size * 5 % 256 AS BIGINT) AS g, p_partkey * 11 % 256 AS b FROM part)"


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as subtitle cues of two seconds with half a second between them."""
    start = F.col("turn") * 2500
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("cue_no"), start.alias("start_ms"), (start + 2000).alias("end_ms"), "text")


CUES = "cues AS (SELECT conv_id, turn AS cue_no, turn * 2500 AS start_ms, turn * 2500 + 2000 AS end_ms, text FROM conversations)"
