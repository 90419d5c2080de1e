"""Proportional stratified interleaving: every shard holds the corpus's mixture of sources.

Rows are shuffled within their source by a seeded digest, ranked, and given the fractional rank
(rank + 1/2) / size of the source. Sorted by fractional rank, any stretch of rows holds every
source in proportion, so cutting the sorted sequence into equal stretches gives shards that
match the mixture; counts differ by one at most (law ``rows``).

No source is ranked in one task: ranks come from digest buckets whose starts are running sums
over a table of counts (:func:`kinograph.llm.common.group_rank`); the global order uses
buckets of the fractional rank, which are even by construction. DataFrame expressions only.

Cases: a null source is a source of its own; a null text has size 16 and the CRC of no bytes;
rows that repeat id and text are interchangeable and each get a slot; with fewer rows than
shards, some shards stay empty; an empty table gives an empty result. Input columns of the same
name as an output column are replaced, the others are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import buckets_for, cut, group_rank, with_columns

#: Bytes that a row costs beside its text.
ROW_BYTES = 16
#: Hex digits of the digest that make a shuffle bucket.
DIGITS = 7


def interleave(df: DataFrame, n_shards: int, seed: int, id_col: str = "doc_id", source_col: str = "source", n_rows: int | None = None) -> DataFrame:
    """Add shard (0 to n_shards - 1) and slot (gapless from 0 within the shard).

    ``df`` should be narrow: carry ids, not texts, and join the texts by shard afterwards.
    """
    n = df.count() if n_rows is None else n_rows
    b = buckets_for(n)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    df = with_columns(df, {"__digest": digest, "__src": F.concat_ws("", F.lit("s"), F.col(source_col).cast("string"), F.when(F.col(source_col).isNull(), "-null"))})
    df = df.withColumn("__bucket", F.floor(F.conv(F.substring("__digest", 1, DIGITS), 16, 10).cast("long") * b / 16**DIGITS).cast("int"))
    df = group_rank(df, ["__src"], "__bucket", [F.col("__digest"), F.col(id_col)], "__rank", total="__size")
    # exact comparison of fractions (2r + 1) / 2n: the integer part of frac * b picks the bucket
    df = df.withColumn("__frac", (F.col("__rank") + F.lit(0.5)) / F.col("__size")).withColumn("__slice", F.floor(F.col("__frac") * b).cast("int"))
    df = group_rank(df.drop("__bucket"), [], "__slice", [F.col("__frac"), F.col("__src"), F.col("__digest")], "__pos")
    df = df.withColumn("__shard", F.expr(f"__pos * {n_shards} div {max(n, 1)}"))
    first = F.expr(f"(__shard * {n} + {n_shards - 1}) div {n_shards}")
    out = with_columns(df, {"shard": F.col("__shard").cast("int"), "slot": (F.col("__pos") - first).cast("long")})
    return out.drop("__digest", "__src", "__rank", "__size", "__frac", "__slice", "__pos", "__shard")


def shard_rows(docs: DataFrame, n_shards: int = 40, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Sizes and checksums of the rows, their shard and slot; texts are read once and left behind."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    narrow = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (F.length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    return interleave(narrow, n_shards, seed, "doc_id", "source")
