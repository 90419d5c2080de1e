"""The corpus pipeline: stages over ``documents``, each read from its predecessor's Parquet.

Cases: further columns of documents are passed on as they are, whatever their names; a null text is
an empty one; repeated rows and ids, ties and very long texts are as the operators state; an empty
table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm import langid, line_dedup, packing, quality, simhash
from kinograph.llm.common import packed, quoted, shared_folder, table, unpacked
from kinograph.llm.queries import vocabulary


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter (null and empty texts, too), or without a language that stands out, go."""
    model = langid.fit(docs.where(~langid.held_out("doc_id")))
    found = packed(docs).withColumn("found", langid.predictor(model, spark)(F.col("text")))
    return unpacked(found.where((F.col("found.lang") != langid.UNKNOWN) & (F.col("found.score") >= 0.5)), docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality: documents that importance resampling does not draw go; without labels of both kinds all stay."""
    return unpacked(quality.resample(packed(docs), table(spark, sf_dir, "labels")), docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: frequent lines stay in their last document only; ``n_chars`` follows the text."""
    out = unpacked(line_dedup.drop_frequent_lines(packed(docs)).withColumn("text", F.col("kept_text")), docs.columns)
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays; texts that share four fifths of their five-word shingles are a group."""
    return simhash.keep_first(docs, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: where each piece of each document goes."""
    return packing.pack(docs.select("doc_id", "text"), vocabulary("byte_bpe_50k.json").decode(), capacity=1024, end_id=0)


STAGES = [
    ("language ID", keep_known_languages),
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("packing", pack),
]

#: Language models and packing are not expressible in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            remove(spark, f"{folder}/{i - 1}")
    return docs
