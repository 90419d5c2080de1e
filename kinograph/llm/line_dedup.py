"""Line dedup over levelled sorted runs of line hashes.

The index is a small log-structured store. Every batch of documents is reduced to one *run*: a
table of (line hash, number of documents, keeper), dealt and sorted by hash. Before a batch's
run is added, it is merge-anti-joined with the runs already there: only lines new to the index
bring a keeper, lines seen before just add to the count. Runs live in levels; once a level holds
``fanout`` runs they are compacted, by a merge that sums the counts, into one run of the next level.
All runs are dealt alike and stay sorted, so anti-joins and compactions exchange and sort
nothing. Only line hashes ever reach the index; texts stay where they are.

Two policies use the runs:

* :meth:`LineRuns.ingest` - first come, first kept: a batch loses the lines that earlier batches
  hold (incremental crawls).
* :func:`drop_frequent_lines` - whole corpus: lines in at least ``min_docs`` documents stay only
  in the document with the largest id. Documents enter in batches of falling ids, so the first run
  to hold a line knows its keeper. Ids are integers of any size.

Everything is DataFrame expressions; no Python runs on the executors. Occurrences are aggregated
before they are dealt by hash, and meet the frequent lines in a join that adaptive execution can
split, so a line that every document holds makes no hot task.

Cases: a null or empty text is one empty line, whose key is shorter than ``min_chars``, so it is
kept. Rows count as documents: repeated rows with one id each count, and all rows that carry the
keeper's id keep the line. A null id is smaller than every other id; rows with it are the keeper only
if no other id holds the line. Columns beside id and text are passed on; output names replace
columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import cut, cut_in_place, narrow_side, with_columns

#: Upper case ASCII and the white space of a key, as fixed by the key's definition.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
#: The 128-bit hash of a key, as two columns.
HASH = ["ha", "hb"]


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def text_hash(text: Column) -> Column:
    """Tells apart different texts of one id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(batch: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row (id, t, ha, hb, pos, fresh) per line whose key has ``min_chars`` code points; ``fresh`` for the first of a key in its document."""
    keys = F.transform(lines(F.col(text_col)), line_key)
    found = F.filter(F.transform(keys, lambda k, i: F.struct(F.when(F.char_length(k) >= min_chars, F.xxhash64(k)).alias("ha"), k.alias("k"), i.alias("pos"))), lambda x: x["ha"].isNotNull())
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["ha"], F.xxhash64(F.lit("second"), x["k"]).alias("hb"), x["pos"])))
    rows = batch.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("t"), ordered.alias("o"))
    before = lambda i: F.get("o", i - 1)
    marked = F.transform("o", lambda x, i: F.struct(x["ha"], x["hb"], x["pos"], F.when((i > 0) & (before(i)["ha"] == x["ha"]) & (before(i)["hb"] == x["hb"]), 0).otherwise(1).alias("fresh")))
    return rows.select("id", "t", F.explode(marked).alias("m")).select("id", "t", "m.*")


def summarise(found: DataFrame) -> DataFrame:
    """Occurrences to (ha, hb, n_docs, keeper)."""
    return found.groupBy(*HASH).agg(F.sum("fresh").alias("n_docs"), F.max("id").alias("keeper"))


def merge(runs: list[DataFrame]) -> DataFrame:
    """Compaction: several runs become one. At most one of them, the first to hold a line, has its keeper."""
    return reduce(DataFrame.unionByName, runs).groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.any_value("keeper", True).alias("keeper"))


class LineRuns:
    """Levelled runs. ``levels[k]`` lists the runs of level k, each cut from its lineage."""

    def __init__(self, fanout: int = 3, min_chars: int = 20):
        self.fanout, self.min_chars, self.levels = fanout, min_chars, [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, summary: DataFrame) -> None:
        """Merge-anti-join a batch's summary with the runs, add it as a run, compact full levels.

        The summary's own aggregation deals it by hash, the only exchange here.
        """
        run = summary.sortWithinPartitions(*HASH)
        if self.runs():
            known = reduce(DataFrame.unionByName, [run.join(r.select(*HASH), HASH, "left_semi") for r in self.runs()]).select(*HASH, "n_docs").distinct()
            known = known.withColumn("keeper", F.lit(None).cast(run.schema["keeper"].dataType))
            run = self.unseen(run).unionByName(known).sortWithinPartitions(*HASH)
        run = cut_in_place(run)
        self.levels[0].append(run)
        k = 0
        while len(self.levels[k]) >= self.fanout:
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(cut_in_place(merge(self.levels[k]).sortWithinPartitions(*HASH)))
            self.levels[k] = []
            k += 1

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """The rows whose hash no run holds."""
        return reduce(lambda left, run: left.join(run.select(*HASH), HASH, "left_anti"), self.runs(), hashes)

    def ingest(self, batch: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Drop from ``batch`` every line that an earlier batch holds, then add the batch's run.

        Lines repeated within the batch stay. Returns the batch with its text replaced.
        """
        found = cut(occurrences(batch, id_col, text_col, self.min_chars))
        seen = found.limit(0)
        if self.runs():
            seen = found.join(reduce(DataFrame.unionByName, [r.select(*HASH) for r in self.runs()]).distinct(), HASH, "left_semi")
        out = cut(strip_lines(batch, seen, id_col, text_col))
        self.add(summarise(found))
        return with_columns(out, {text_col: F.col("kept_text")}).drop("kept_text", "n_lines", "n_dropped").select(*batch.columns)

    def compacted(self) -> DataFrame:
        """All runs as one."""
        runs = self.runs()
        return runs[0] if len(runs) == 1 else merge(runs)


def strip_lines(docs: DataFrame, drop: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Remove from each document the lines whose places ``drop`` (id, t, pos) names.

    Adds n_lines, n_dropped and kept_text. Per document the places become a mask with a byte for each
    line up to the last of them, so that every line is looked up at once. The masks are narrow and
    become the build side of a shuffled hash join: texts are shuffled once and never sorted.
    """
    per_doc = drop.groupBy("id", "t").agg(F.array_sort(F.collect_set("pos")).alias("__gone"))
    gap = lambda p, i: p - F.coalesce(F.when(i > 0, F.get("__gone", i - 1)), F.lit(-1)) - 1
    mask = F.array_join(F.transform("__gone", lambda p, i: F.concat(F.repeat(F.lit("0"), gap(p, i).cast("int")), F.lit("1"))), "").cast("binary")
    masks = per_doc.select(F.col("id").alias("__id"), F.col("t").alias("__t"), mask.alias("__mask"))
    joined = docs.join(masks.hint("shuffle_hash"), docs[id_col].eqNullSafe(F.col("__id")) & (text_hash(docs[text_col]) == F.col("__t")), "left").drop("__id", "__t")
    parts = lines(F.col(text_col))
    kept = F.filter(parts, lambda x, i: F.substring(F.col("__mask"), i + 1, F.lit(1)) != F.lit(b"1"))
    text = F.when(F.col("__mask").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    dropped = F.when(F.col("__mask").isNull(), F.lit(0)).otherwise(F.length(F.regexp_replace(F.col("__mask").cast("string"), "0", "")))
    return with_columns(joined, {"n_lines": F.size(parts).cast("long"), "n_dropped": dropped.cast("long"), "kept_text": text}).drop("__mask")


def falling_ranges(ids: DataFrame, n: int) -> list[Column]:
    """Conditions on ``id`` that part the rows into about ``n`` ranges of like numbers of rows, largest ids first."""
    shares = [i / n for i in range(n - 1, 0, -1)]
    cuts = ids.agg(F.percentile_approx("id", shares, 10_000).alias("c")).first()["c"] if shares else None
    cuts = list(dict.fromkeys(cuts or []))
    above = [F.col("id") > c for c in cuts] + [F.lit(True)]
    return [here if i == 0 else here & ~F.coalesce(above[i - 1], F.lit(False)) for i, here in enumerate(above)]


def drop_frequent_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3, min_chars: int = 20, n_batches: int = 4, fanout: int = 3
) -> DataFrame:
    """Drop the lines found in at least ``min_docs`` documents, except in the largest id.

    The corpus is hashed once and enters the runs in ``n_batches`` batches of falling ids. Frequent
    hashes are then joined with the occurrences to name what each document loses.
    """
    found = cut(occurrences(docs, id_col, text_col, min_chars))
    index = LineRuns(fanout, min_chars)
    for of_batch in falling_ranges(found, n_batches):
        index.add(summarise(found.where(of_batch)))
    frequent = cut(index.compacted().where(F.col("n_docs") >= min_docs).select(*HASH, "keeper"))
    drop = found.join(narrow_side(frequent), HASH).where(~F.col("id").eqNullSafe(F.col("keeper"))).select("id", "t", "pos")
    return strip_lines(docs, drop, id_col, text_col)
