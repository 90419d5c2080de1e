"""Helpers shared by the corpus operators: reading tables, cutting lineage, ranking without a hot task."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one sort group of :func:`group_rank` holds on average at most.
RANK_GROUP_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only a local session without one gets a folder of its own; a cluster without the setting is an
    error, since executors could not read each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a small table in one partition.
PARTITION_ROWS = 500_000


def cut_small(df: DataFrame, most_rows: int) -> DataFrame:
    """:func:`cut` of a table with at most so many rows, into as many partitions as it needs."""
    return cut(df.coalesce(1 + most_rows // PARTITION_ROWS))


#: Rows of a few numbers or digests that may be broadcast: some 60 MB at most.
BROADCAST_ROWS = 1_000_000


def narrow_side(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow, materialised side of a join: broadcast if it is counted small, else the build side of a shuffled hash join."""
    return F.broadcast(df) if df.count() <= most_rows else df.hint("shuffle_hash")


def cut_in_place(df: DataFrame) -> DataFrame:
    """:func:`cut` that keeps what is known of the rows' partitioning and order.

    A checkpoint carries both on, but only from a plan that is fixed before it runs; so adaptive
    execution rests meanwhile. Joins and groupings of such tables on the key they are dealt by need no
    exchange, and where they are sorted by it no sort.
    """
    conf = df.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    """A column's name as an expression that means just that column."""
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, rest): all other columns in one struct, so that no operator can meet their names."""
    rest = [F.col(quoted(c)).alias(c) for c in docs.columns if c not in (id_col, text_col)]
    return docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"), (F.struct(*rest) if rest else F.lit(None)).alias("rest"))


def unpacked(df: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The given columns, in order, of a table made by :func:`packed`."""
    own = {id_col: F.col("doc_id"), text_col: F.col("text")}
    return df.select(*[own.get(c, F.col(f"rest.{quoted(c)}")).alias(c) for c in columns])


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` in which the given columns replace those of the same name, whatever their case."""
    taken = {c.lower() for c in columns}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def parts(batch, rows: int = 256) -> Iterator:
    """A batch or array in slices of at most ``rows`` rows, so that few texts at a time become Python objects."""
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def parts_of_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose values of a string column have at most so many bytes together, or one row each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Return the free memory of a Python worker to the system; workers outlive their tasks and those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class Memo(dict):
    """What a task remembers per text key, bounded by an estimate of its bytes: when full it starts afresh."""

    def __init__(self, most_bytes: int, entry_bytes: int):
        super().__init__()
        self.most, self.entry, self.bytes = most_bytes, entry_bytes, 0

    def room(self, keys) -> bool:
        """Count ``keys`` as about to be added; false if everything remembered had to go for them."""
        size = sum(map(len, keys)) + self.entry * len(keys)
        self.bytes += size
        if self.bytes <= self.most or not self:
            return True
        self.clear()
        self.bytes = size
        return False


def buckets_for(n_rows: int, least: int = 256) -> int:
    """Power of two, so that a bucket holds about RANK_GROUP_ROWS rows whatever the input's size."""
    n = least
    while n * RANK_GROUP_ROWS < n_rows:
        n *= 2
    return n


def group_rank(df: DataFrame, group: list[str], bucket: str, order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """Add ``name``: the gapless rank from 0 of a row in its group, ordered by (bucket, *order).

    ``bucket`` is an integer column that follows the wanted order. A group of any size is ranked
    in parallel: rows are numbered within (group, bucket), and the buckets' starts come from a
    running sum over the much smaller table of counts. ``total`` adds the group's size.
    """
    keys = [*group, bucket]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if total:
        counts = counts.withColumn(total, F.sum("__n").over(whole))
    counts = counts.drop("__n").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__before", *([total] if total else []))
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    joined = ranked.join(counts, on, "inner")
    return joined.withColumn(name, F.col("__before") + F.col("__rn") - 1).drop("__before", "__rn", *[f"__k{i}" for i in range(len(keys))])
