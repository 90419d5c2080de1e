"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

The raw model counts the hashed n-grams (words and marks, and pairs of neighbours) of every
document; the target model those of labelled good documents, a bounded sample of about
``sample_docs``. Both are bags of n-grams with add-one-half smoothing, so a document's log
importance weight is the **sum** of the log ratios of target to raw over its n-grams. Documents are
drawn without replacement in proportion to their weights: Gumbel noise seeded by the id is added to
the log weights, and the k largest keys are taken.

k is a stated share of the documents: ``keep_share``, or, where it is None, the share of good ones
among the labelled documents that are there, plus ``margin``. The k-th largest key comes from
repeated histograms, so no task sorts the corpus.

Texts are read twice: to count, and to weigh. What was weighed is written to the shared folder and
filtered from there.

Cases: null and empty texts, and those without any mark, have log weight 0; with a null
``keep_share`` and without both good and bad labels nothing is rejected; null labels are ignored; an
id with several labels is good only if all are; repeated rows share id, weight and noise and stay or
go together (keys equal to the k-th all stay); an empty table gives an empty result.
Input columns are passed on, those named like an output are replaced.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import Memo, cut, give_back, parts, shared_folder, with_columns

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 14
#: Bytes of the token hashes that a task remembers, and of an entry beside its text.
MEMO_BYTES, ENTRY_BYTES = 32_000_000, 160
#: Bins of one histogram in the search for the k-th key, and rounds of it: 2048^5 covers a double's digits.
BINS, ROUNDS = 2048, 5


class Features:
    """Buckets of a text's n-grams; remembers token hashes."""

    def __init__(self):
        self.memo = Memo(MEMO_BYTES, ENTRY_BYTES)

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall((text or "").lower())
        memo = self.memo
        try:
            ids = np.array([memo[t] for t in tokens], dtype=np.int64)
        except KeyError:
            every = set(tokens)
            new = [t for t in every if t not in memo]
            memo.update((t, zlib.crc32(t.encode("utf-8", "replace"))) for t in (new if memo.room(new) else every))
            ids = np.array([memo[t] for t in tokens], dtype=np.int64)
        pairs = (ids[:-1] * 1_000_003 + ids[1:] * 7) % BUCKETS
        return np.concatenate([ids % BUCKETS, pairs])


@dataclass
class Model:
    """Log ratios of target to raw per bucket, the share to draw (1: everything), and the noise's seed."""

    log_ratio: np.ndarray
    share: float
    seed: int


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, sample_docs: int) -> DataFrame:
    """About ``sample_docs`` rows (id, good), chosen by a digest of the id; small enough to broadcast."""
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).alias("good"))
    share = min(1.0, sample_docs / max(1, rows.count()))
    chance = F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    return cut(rows.where(chance < share).groupBy("id").agg(F.min("good").alias("good")))


def count_features(rows: DataFrame) -> DataFrame:
    """rows (text, good) to (bucket, raw, target): counts over all rows and over good ones.

    Bucket -1 holds the rows with a bad label (raw) and with a good one (target).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, raw, target, labelled = Features(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), [0, 0]
        for part in (p for b in batches for p in parts(b)):
            for text, good in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                n = np.bincount(features(text), minlength=BUCKETS)
                raw += n
                if good is not None:
                    labelled[good] += 1
                if good:
                    target += n
        del features
        at = np.flatnonzero(raw)
        columns = [np.r_[at, -1].astype(np.int32), np.r_[raw[at], labelled[0]], np.r_[target[at], labelled[1]]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "raw", "target"])
        give_back()

    per_task = rows.mapInArrow(count, "bucket int, raw long, target long")
    return per_task.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_weight(model: Model, spark) -> callable:
    """Column function: text to the sum of its log ratios."""
    shared = spark.sparkContext.broadcast(model.log_ratio)

    @F.arrow_udf("double")
    def weigh_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features, ratio = Features(), shared.value
        for texts in batches:
            yield pa.array([float(ratio[features(t)].sum()) for part in parts(texts) for t in part.to_pylist()], pa.float64())
        del features
        give_back()

    return weigh_texts


def gumbel(seed: int, id_col: str) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11).cast("double") + 0.5) / 2.0**53
    return -F.log(-F.log(u))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample_docs: int = 20_000, keep_share: float | None = None, margin: float = 0.01, seed: int = 3,
) -> Model:
    """Count both models over all documents; what comes to the driver is a row per bucket."""
    sample = labelled_sample(labels, id_col, label_col, sample_docs)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = count_features(named.join(F.broadcast(sample), "id", "left").select("text", "good")).collect()
    raw, target, bad, good = np.full(BUCKETS, 0.5), np.full(BUCKETS, 0.5), 0, 0
    for bucket, r, t in counts:
        if bucket < 0:
            bad, good = r, t
        else:
            raw[bucket] += r
            target[bucket] += t
    if keep_share is None:
        keep_share = min(1.0, good / (good + bad) + margin) if good and bad else 1.0
    return Model(np.log(target / target.sum()) - np.log(raw / raw.sum()), keep_share, seed)


def weigh(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add log_weight and key (log_weight with Gumbel noise)."""
    out = with_columns(docs, {"log_weight": log_weight(model, docs.sparkSession)(F.col(text_col))})
    return with_columns(out, {"key": F.col("log_weight") + gumbel(model.seed, id_col)})


def kth_key(keys: DataFrame, k: int) -> float:
    """The k-th largest value of column ``key``, by histograms that close in on it."""
    if k <= 0:
        return float("inf")
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    for _ in range(ROUNDS):
        width = (hi - lo) / BINS
        if lo + width == lo or hi - width == hi:
            break
        at = F.least(F.floor((F.col("key") - lo) / width), F.lit(BINS - 1)).cast("int")
        bins = keys.where(F.col("key").between(lo, hi)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if above + row["n"] >= k:
                lo, hi = row["lo"], row["hi"]
                break
            above += row["n"]
        if lo == hi:
            break
    return lo


def draw(weighed: DataFrame, share: float) -> DataFrame:
    """The rows with the ``share`` largest keys, rounded up. ``weighed`` is read several times, so it should be materialised."""
    if share >= 1:
        return weighed
    return weighed.where(F.col("key") >= kth_key(weighed, math.ceil(share * weighed.count())))


def materialise(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, of which later readers take the columns they need."""
    path = f"{shared_folder(df.sparkSession)}/weighed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, **options) -> DataFrame:
    """The documents drawn, with log_weight and key, and the columns ``carry`` of ``docs`` (all, where it is None)."""
    model = fit(docs, labels, id_col, text_col, **options)
    weighed = weigh(docs, model, id_col, text_col)
    kept = [F.col(f"`{c}`") for c in docs.columns if (carry is None or c in carry) and c.lower() not in ("log_weight", "key")]
    return draw(materialise(weighed.select(*kept, "log_weight", "key")), model.share)
