"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every table hashes a vector with ``width`` Gaussian projections, each cut into windows of equal
length after a random shift. Rows go to their own bucket of every table. A query visits perturbed
buckets too: a neighbour at distance d has projections that scatter around the query's, drawn
towards the mean by the correlation 1 - d^2 / 2V, so the probability of each bucket follows from the
normal distribution; buckets are visited in the order of that estimate until their sum reaches
``success``. The distances and spreads come from a bounded sample of the rows; every row is indexed.
The width is the largest, up to one that follows from the number of rows, at which MOST_PROBES buckets
reach ``success``; queries that fall short of it all the same visit no bucket and are searched exactly.

Queries and rows meet by bucket in tasks that stream the rows past the bucket's queries and pass
on the nearest few of each, by exact distance in double precision; merging the tables gives the result.
Crowded buckets are dealt to several tasks by salting both sides; the table of crowded buckets
is bounded by the share of all rows that makes a bucket crowded. Queries for which the visited
buckets hold too few rows are searched exactly, in blocks against all rows.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
rows without an id, nor vectors whose length is not the table's most frequent; a repeated id counts
once, with its nearest vector; ties go to the smaller id; a table with one vector, or none, gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.llm.common import cut

#: Elements of one block of differences; bounds a task's memory.
BLOCK_ELEMENTS = 2_000_000
#: Buckets that a query visits in one table at most; one that needs more is searched exactly.
MOST_PROBES = 2048
#: Length of a window, in spreads of its projection.
WINDOW = 1.6
#: Share of a sample's visits that must reach their target at the width taken, and queries in the sample.
REACHED, REACH_SAMPLE = 0.98, 50
#: Queries of one exact pass over all rows.
EXACT_BLOCK = 2000
#: A bucket is crowded above this share of all rows (of all queries), or above the least number.
ROW_SHARE, LEAST_ROWS, QUERY_SHARE, LEAST_QUERIES = 500, 500, 100, 2000
ROW_SCHEMA = "cell long, kind int, id long, vec array<double>"


@dataclass
class Hashing:
    """Projections (dim, tables * width), shifts, window length, and the model of a neighbour's scatter."""

    directions: np.ndarray
    shifts: np.ndarray
    window: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    correlation: float
    tables: int
    width: int
    success: float

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers (n, tables, width) and the projections behind them."""
        along = vectors @ self.directions
        shape = (len(vectors), self.tables, self.width)
        return np.floor((along + self.shifts) / self.window).astype(np.int64).reshape(shape), along.reshape(shape)

    def cells(self, codes: np.ndarray, table: np.ndarray | int) -> np.ndarray:
        """One 64-bit number for the window numbers (n, width) of a table."""
        h = np.full(len(codes), 0x9E3779B97F4A7C15, np.uint64) * (np.asarray(table, np.uint64) + np.uint64(1))
        for i in range(codes.shape[1]):
            h = (h ^ codes[:, i].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        return h.view(np.int64)

    def ranked(self, along: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Chances and window numbers of the MOST_PROBES most promising cells for a query with projections ``along`` (width)."""
        at = slice(table * self.width, (table + 1) * self.width)
        centre = self.mean[at] + self.correlation * (along - self.mean[at])
        scatter = self.spread[at] * math.sqrt(max(1e-9, 1 - self.correlation**2))
        chance, codes = np.ones(1), np.zeros((1, 0), np.int64)
        for j in range(self.width):
            shift, window = self.shifts[at][j], self.window[at][j]
            own = math.floor((along[j] + shift) / window)
            lo, hi = (math.floor((centre[j] + s * 3 * scatter[j] + shift) / window) for s in (-1, 1))
            number = np.arange(min(lo, own), max(hi, own) + 1)
            edges = (np.append(number, number[-1] + 1) * window - shift - centre[j]) / scatter[j]
            part = np.diff([0.5 * math.erfc(-e / math.sqrt(2)) for e in edges])
            both = (chance[:, None] * part[None, :]).ravel()
            best = np.argsort(-both, kind="stable")[:MOST_PROBES]
            codes = np.column_stack([codes[best // len(number)], number[best % len(number)]])
            chance = both[best]
        return chance, codes

    def probes(self, along: np.ndarray) -> list[np.ndarray]:
        """The cells that a query with projections ``along`` (tables, width) visits in each table; none if they miss ``success`` in any."""
        cells = []
        for table in range(self.tables):
            chance, codes = self.ranked(along[table], table)
            n = int(np.searchsorted(np.cumsum(chance), self.success)) + 1
            if n > len(chance):
                return [np.empty(0, np.int64)]
            cells.append(self.cells(codes[:n], table))
        return cells

    def reached(self, sample: np.ndarray) -> float:
        """Share of the sample's rows that would, as queries, reach ``success`` in every table."""
        _, along = self.codes(sample)
        return float(np.mean([len(self.probes(a)[0]) > 0 for a in along]))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def vectors(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """The rows that take part, as (id, vec), and their dimension (0 if there are none)."""
    vec = F.col(vec_col).cast("array<double>")
    found = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(usable(F.col("vec")))
    top = found.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = top[0]["dim"] if top else 0
    return found.where(F.size("vec") == dim), dim


def fit(vecs: DataFrame, dim: int, n_rows: int, tables: int = 2, success: float = 0.72, k: int = 10, sample_rows: int = 4096, seed: int = 4) -> Hashing:
    """Draw the projections and measure, on about ``sample_rows`` rows, spreads and the distance of the k-th neighbour.

    In a sample, that is the neighbour whose rank is as much smaller as the sample is. Where MOST_PROBES buckets miss ``success``, fewer projections make larger buckets, until they reach it.
    """
    share = int(min(1.0, sample_rows / max(1, n_rows)) * 2**30)
    sample = np.array([r[0] for r in vecs.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2**30)) < share).select("vec").collect()]).reshape(-1, dim)
    width = max(2, round(math.log2(max(2, n_rows)) / 2))
    correlation = 0.9
    if len(sample) > 2:
        some = sample[:: max(1, len(sample) // 200)][:200]
        squares = np.stack([((sample - q) ** 2).sum(axis=1) for q in some])
        squares[squares == 0] = np.inf
        rank = min(len(sample) - 2, max(0, round(k * len(sample) / max(1, n_rows)) - 1))
        nearest = np.partition(squares, rank, axis=1)[:, rank]
        total = ((sample - sample.mean(axis=0)) ** 2).sum(axis=1).mean()
        if np.isfinite(nearest).any() and total > 0:
            correlation = float(np.clip(1 - np.median(nearest[np.isfinite(nearest)]) / (2 * total), 0.1, 0.95))
    while True:
        rng = np.random.default_rng(seed)
        directions = rng.standard_normal((dim, tables * width))
        along = sample @ directions if len(sample) else np.zeros((1, tables * width))
        spread = np.maximum(along.std(axis=0), 1e-9)
        window = np.full(tables * width, WINDOW) * spread
        hashing = Hashing(directions, rng.uniform(0, 1, tables * width) * window, window, along.mean(axis=0), spread, correlation, tables, width, success)
        asked = sample[:: max(1, len(sample) // REACH_SAMPLE)][:REACH_SAMPLE]
        if width == 1 or not len(asked) or hashing.reached(asked) >= REACHED:
            return hashing
        width -= 1


def bucket_rows(vecs: DataFrame, hashing: Hashing, dim: int, as_queries: bool) -> DataFrame:
    """A row per vector and bucket: its own bucket of each table (kind 1), or those it visits (kind 0)."""
    shared = vecs.sparkSession.sparkContext.broadcast(hashing)

    def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                codes, along = h.codes(matrix(part.column("vec"), dim))
                if as_queries:
                    visits = [np.concatenate(h.probes(a)) for a in along]
                    where = np.repeat(np.arange(len(visits)), [len(v) for v in visits])
                    cells = np.concatenate(visits)
                else:
                    where = np.tile(np.arange(part.num_rows), h.tables)
                    cells = np.concatenate([h.cells(codes[:, t], t) for t in range(h.tables)])
                take = part.take(pa.array(where))
                kind = pa.array(np.full(len(where), 0 if as_queries else 1, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(cells), kind, take.column("id"), take.column("vec")], ["cell", "kind", "id", "vec"])

    return vecs.select("id", "vec").mapInArrow(hash_batches, ROW_SCHEMA)


class Nearest:
    """The k nearest rows seen so far of a few queries."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int):
        self.ids, self.vecs, self.k = ids, vecs, k
        self.squares = (vecs**2).sum(axis=1)
        self.distances = np.full((len(ids), k), np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        step = max(1, BLOCK_ELEMENTS // max(1, min(4096, len(self.ids)), vecs.shape[1]))
        for at in range(0, len(ids), step):
            some, their = ids[at : at + step], vecs[at : at + step]
            squares = (their**2).sum(axis=1)
            for q in range(0, len(self.ids), 4096):
                self._merge(q, some, their, squares)

    def _merge(self, q: int, ids: np.ndarray, vecs: np.ndarray, squares: np.ndarray) -> None:
        """A matrix product tells, within its rounding error, which rows can be among the nearest; those are measured exactly."""
        mine, own = self.vecs[q : q + 4096], self.squares[q : q + 4096]
        rough = own[:, None] + squares[None, :] - 2 * (mine @ vecs.T)
        slack = 1e-12 * vecs.shape[1] * (own.max(initial=0) + squares.max(initial=0))
        rough[self.ids[q : q + 4096, None] == ids[None, :]] = np.inf
        bound = self.distances[q : q + len(mine), -1] ** 2 + slack
        for i in np.flatnonzero((rough <= bound[:, None]).any(axis=1)):
            close = np.flatnonzero((rough[i] <= bound[i]) & np.isfinite(rough[i]))
            if len(close) > 4 * self.k:
                limit = np.partition(rough[i][close], self.k)[self.k] + 2 * slack
                close = close[rough[i][close] <= limit]
            exact = np.sqrt(((vecs[close] - mine[i]) ** 2).sum(axis=1))
            d = np.r_[self.distances[q + i], exact]
            found = np.r_[self.found[q + i], ids[close]]
            order = np.lexsort((found, d))
            _, first = np.unique(found[order], return_index=True)
            best = order[np.sort(first)][: self.k]
            self.distances[q + i, : len(best)], self.found[q + i, : len(best)] = d[best], found[best]
            self.distances[q + i, len(best) :], self.found[q + i, len(best) :] = np.inf, np.iinfo(np.int64).max

    def rows(self) -> pa.RecordBatch:
        there = np.isfinite(self.distances)
        query = np.repeat(self.ids, there.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(self.found[there]), pa.array(self.distances[there])], ["query_id", "vec_id", "score"])


FOUND_SCHEMA = "query_id long, vec_id long, score double"
#: Rows that a task gathers before it keeps only the nearest of each query.
GATHERED = 200_000


def nearest_rows(found: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """The k nearest rows of each query, each row once."""
    query, vec, score = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in found]) for i in range(3))
    order = np.lexsort((score, vec, query))
    query, vec, score = query[order], vec[order], score[order]
    fresh = np.r_[True, (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])][: len(query)]
    query, vec, score = query[fresh], vec[fresh], score[fresh]
    order = np.lexsort((vec, score, query))
    query, vec, score = query[order], vec[order], score[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]][: len(query)])
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    near = place < k
    return pa.RecordBatch.from_arrays([pa.array(query[near]), pa.array(vec[near]), pa.array(score[near])], ["query_id", "vec_id", "score"])


def search_buckets(rows: DataFrame, dim: int, k: int) -> DataFrame:
    """rows (cell, part, kind, id, vec): the k nearest of each query, over the buckets of a task.

    A task merges its buckets before it passes rows on; when it has met so many queries that merging
    no longer makes them few, it passes on what it has.
    """

    def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, query_ids, query_vecs, state = None, [], [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "part", "kind")])
            ids, vecs = batch.column("id").to_numpy(zero_copy_only=False), matrix(batch.column("vec"), dim)
            edges = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]) if len(ids) else []
            for lo, hi in zip(edges, [*edges[1:], len(ids)]):
                here, kind = tuple(key[:2, lo]), key[2, lo]
                if here != now:
                    if state is not None:
                        yield state.rows()
                    now, query_ids, query_vecs, state = here, [], [], None
                if kind == 0:
                    query_ids.append(ids[lo:hi])
                    query_vecs.append(vecs[lo:hi])
                elif query_ids:
                    if state is None:
                        state = Nearest(np.concatenate(query_ids), np.concatenate(query_vecs), k)
                    state.see(ids[lo:hi], vecs[lo:hi])
        if state is not None:
            yield state.rows()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for found in by_bucket(batches):
            held.append(found)
            size += found.num_rows
            if size >= GATHERED:
                held = [nearest_rows(held, k)]
                size = held[0].num_rows
                if size >= GATHERED // 2:
                    yield held[0]
                    held, size = [], 0
        if held:
            yield nearest_rows(held, k)

    spread = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    return spread.select("cell", "part", "kind", "id", "vec").mapInArrow(search, FOUND_SCHEMA)


def deal(index: DataFrame, asks: DataFrame, n_rows: int, n_queries: int) -> DataFrame:
    """Index rows and query visits in one table, with ``part``: crowded buckets are split on both sides."""
    most_rows, most_queries = max(LEAST_ROWS, n_rows // ROW_SHARE), max(LEAST_QUERIES, n_queries // QUERY_SHARE)
    both = index.select("cell", "kind").unionByName(asks.select("cell", "kind"))
    sizes = both.groupBy("cell").agg(F.sum("kind").alias("rows"), F.sum(1 - F.col("kind")).alias("asks"))
    crowded = sizes.where((F.col("rows") > most_rows) | (F.col("asks") > most_queries))
    by_row, by_ask = (F.ceil(F.col(c) / m).cast("int") for c, m in (("rows", most_rows), ("asks", most_queries)))
    crowded = F.broadcast(crowded.select("cell", F.greatest(by_row, F.lit(1)).alias("by_row"), F.greatest(by_ask, F.lit(1)).alias("by_ask")))

    def parts(rows: DataFrame, own: str, other: str, stride_own: bool) -> DataFrame:
        rows = rows.join(crowded, "cell", "left")
        mine = F.pmod(F.xxhash64("id"), F.coalesce(own, F.lit(1))).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        rows = rows.withColumn("mine", mine).withColumn("theirs", theirs)
        row_part, ask_part = ("mine", "theirs") if stride_own else ("theirs", "mine")
        return rows.withColumn("part", F.col(row_part) * F.coalesce("by_ask", F.lit(1)) + F.col(ask_part)).select("cell", "part", "kind", "id", "vec")

    return parts(index, "by_row", "by_ask", True).unionByName(parts(asks, "by_ask", "by_row", False))


def exact(queries: DataFrame, vecs: DataFrame, dim: int, k: int) -> DataFrame:
    """The k nearest of each query in each task's share of all rows; ``queries`` are at most a block."""
    rows = queries.select("id", "vec").collect()
    shared = vecs.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(-1, dim)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Nearest(*shared.value, k)
        for batch in batches:
            state.see(batch.column("id").to_numpy(zero_copy_only=False), matrix(batch.column("vec"), dim))
        yield state.rows()

    return vecs.select("id", "vec").mapInArrow(search, FOUND_SCHEMA)


def nearest_of(found: DataFrame, k: int) -> DataFrame:
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 2, success: float = 0.72) -> DataFrame:
    """(query_id, rank, vec_id, score) for the k nearest rows found of each query, by Euclidean distance.

    ``is_query`` is a condition on the column ``id``.
    """
    vecs, dim = vectors(rows, id_col, vec_col)
    if not dim:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_rows, n_queries = vecs.agg(F.count_distinct("id"), F.count(F.when(is_query, 1))).first()
    hashing = fit(vecs, dim, n_rows, tables, success, k)
    asked = vecs.where(is_query)
    dealt = deal(bucket_rows(vecs, hashing, dim, False), bucket_rows(asked, hashing, dim, True), n_rows, n_queries)
    best = cut(nearest_of(search_buckets(dealt, dim, k), k))
    filled = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k, n_rows - 1))
    short = cut(asked.join(filled, F.col("id") == F.col("query_id"), "left_anti"))
    n_blocks = math.ceil(short.count() / EXACT_BLOCK)
    for b in range(n_blocks):  # none as a rule
        block = short.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b)
        best = cut(nearest_of(best.drop("rank").unionByName(exact(block, vecs, dim, k)), k))
    return best
