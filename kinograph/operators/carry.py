"""Ordered work over keys of any length: time is cut into buckets, and what a bucket hands on is carried to the next.

A window by key alone puts a key in one task. Here a window, or a scan in Arrow batches, runs per (key, bucket);
what has gone before enters each bucket as one more row in front of its own: the last fact, a
running sum, or the state of a recurrence. What is carried is one row per key and bucket, scanned per
key in its own small table. Buckets are equal stretches of the order's range, as many as the rows ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window

#: Rows of a bucket on average.
BUCKET_ROWS = 100_000


def bucket_of(df: DataFrame, t: str, rows: int = BUCKET_ROWS) -> tuple[Column, int]:
    """A column that numbers stretches of ``t`` (a number), in order, and how many there are; rows without a ``t`` are in the first."""
    lo, hi, n = df.agg(F.min(t).cast("double"), F.max(t).cast("double"), F.count(F.lit(1))).first()
    many = -(-n // rows)
    if many <= 1 or lo is None or not hi > lo:
        return F.lit(0), 1
    share = (F.col(t).cast("double") - F.lit(lo)) / F.lit(hi - lo)
    return F.coalesce(F.least(F.lit(many - 1), F.floor(share * many).cast("int")), F.lit(0)), many


def entering(rows: DataFrame, on: list[str], value: Column, name: str, carried) -> DataFrame:
    """(*on, __bucket, name): what each bucket of ``rows`` gets from those before it; ``carried(name, window)`` says how."""
    per_bucket = rows.groupBy(*on, "__bucket").agg(value.alias("__own"))
    before = Window.partitionBy(*on).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select(*on, "__bucket", carried("__own", before).alias(name))


def running_sum(df: DataFrame, on: list[str], t: str, ties: list[str], values: dict[str, Column], rows: int = BUCKET_ROWS) -> DataFrame:
    """Add the running sum of each of ``values`` per key, in order of ``t`` and ``ties``, its own row included."""
    bucket, _ = bucket_of(df, t, rows)
    own = {f"__v{i}": v for i, v in enumerate(values.values())}
    filed = df.withColumns({**own, "__bucket": bucket})
    order = Window.partitionBy(*on, "__bucket").orderBy(t, *ties).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*on).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = filed.groupBy(*on, "__bucket").agg(*[F.sum(v).alias(v) for v in own])
    enter = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(on)], F.col("__bucket").alias("__b"), *[F.sum(v).over(before).alias(f"{v}b") for v in own])
    at = F.col("__bucket") == F.col("__b")
    for i, k in enumerate(on):
        at &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    out = filed.withColumns({f"{v}r": F.sum(v).over(order) for v in own}).join(enter, at)
    return out.select(*df.columns, *[(F.col(f"__v{i}r") + F.coalesce(f"__v{i}b", F.lit(0))).alias(name) for i, name in enumerate(values)])


def asof(probes: DataFrame, facts: DataFrame, on: list[str], t: str, fact_t: str, take: list[str], clamp_first: bool = False, rows: int = BUCKET_ROWS) -> DataFrame:
    """Add the columns ``take`` of the latest fact at or before each probe, per key; ``t`` and ``fact_t`` are numbers.

    Probes and facts are shuffled together by key and stretch of time; the last fact of the stretches before
    enters each one as a row of its own. Facts of the same time count in the order of ``take``. With
    ``clamp_first``, probes before the first fact get that one.
    """
    carried = F.struct(*[F.col(c) for c in take])
    probe = F.struct(*[F.col(c) for c in probes.columns])
    no_fact, no_probe = F.lit(None).cast(facts.select(carried).schema[0].dataType), F.lit(None).cast(probes.select(probe).schema[0].dataType)
    p = probes.select(*on, F.col(t).alias("__t"), F.lit(2).alias("__kind"), probe.alias("__probe"), no_fact.alias("__fact"))
    f = facts.select(*on, F.col(fact_t).alias("__t"), F.lit(1).alias("__kind"), no_probe.alias("__probe"), carried.alias("__fact"))
    both = f.unionByName(p)
    bucket, many = bucket_of(both, "__t", rows)
    both = both.withColumn("__bucket", bucket)
    fact = F.when(F.col("__kind") == 1, F.struct("__t", "__fact"))
    if many > 1:
        enter = entering(both, on, F.max(fact), "__in", lambda c, w: F.max(c).over(w))
        if clamp_first:
            first = both.groupBy(*on).agg(F.min(fact).alias("__first"))
            same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in on]
            enter = enter.alias("l").join(first.alias("r"), same).select(*[f"l.{k}" for k in on], "__bucket", F.coalesce("__in", "__first").alias("__in"))
        lead = enter.where("__in is not null").select(*on, F.lit(None).cast(both.schema["__t"].dataType).alias("__t"), F.lit(0).alias("__kind"), no_probe.alias("__probe"), F.col("__in.__fact").alias("__fact"), "__bucket")
        both = both.unionByName(lead)
    by = Window.partitionBy(*on, "__bucket")
    found = F.last("__fact", ignorenulls=True).over(by.orderBy(F.col("__kind") > 0, "__t", "__kind", "__fact").rowsBetween(Window.unboundedPreceding, 0))
    if clamp_first and many == 1:
        found = F.coalesce(found, F.min(fact).over(by)["__fact"])
    out = both.withColumn("__found", found).where("__kind = 2")
    return out.select("__probe.*", *[F.col(f"__found.{c}").alias(c) for c in take])


def scan(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x_i = a_i x_(i-1) + b_i from a state ``x`` on, by doubling: steps of 1, 2, 4, ... are composed, log2 n passes in all."""
    a, b = a.copy(), b.copy()
    b[0] += a[0] * x
    step = 1
    while step < len(a):
        b[step:] += a[step:] * b[:-step]
        a[step:] *= a[:-step]
        step *= 2
    return b


def steps(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """As :func:`scan`, one step after the other: the same bits as a plain loop over the rows gives."""
    out = np.empty_like(b)
    for j, state in enumerate(x.tolist()):
        states = []
        for p, q in zip(a[:, j].tolist(), b[:, j].tolist()):
            state = p * state + q
            states.append(state)
        out[:, j] = states
    return out


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)


def affine_scan(df: DataFrame, on: list[str], t: str, ties: list[str], a: Column, b: Column, start: list[float], name: str = "state", rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``name``: the state x after each row of the recurrence x = a x + b per key, entry by entry, from ``start`` on.

    ``a`` and ``b`` are arrays of as many numbers as ``start``, without nulls and with absolute values of ``a`` up to 1.
    The steps of a bucket compose to one step; those of a key's buckets are scanned, and the state that
    enters a bucket becomes its first row, a step with a = 0 that forgets what was before. So a task scans
    its sorted rows without looking at keys.
    """
    dims = len(start)
    bucket, many = bucket_of(df, t, rows)
    arrays = lambda values: F.array(*[F.lit(float(v)) for v in values])
    row = df.select(*on, bucket.alias("__bucket"), F.lit(1).alias("__own"), F.col(t).alias("__t"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(ties)], a.cast("array<double>").alias("__a"), b.cast("array<double>").alias("__b"), F.struct(*df.columns).alias("__row"))
    ordered = ["__bucket", "__own", "__t", *[f"__o{i}" for i in range(len(ties))]]
    no_row = {c: F.lit(None).cast(row.schema[c].dataType) for c in row.columns}
    groups = row.select(*on, "__bucket").distinct()
    as_first = lambda held, state: held.select(*[{**no_row, **{k: F.col(k) for k in on}, "__bucket": F.col("__bucket"), "__own": F.lit(0), "__a": arrays([0.0] * dims), "__b": state}[c].alias(c) for c in row.columns])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The last row of each group, with what the group's steps compose to."""
        x, held = np.zeros(2 * dims), None
        for batch in batches:
            ra, rb, own = matrix(batch.column("__a"), dims), matrix(batch.column("__b"), dims), batch.column("__own").to_numpy() == 1
            wide = scan(np.hstack([ra, ra]), np.hstack([np.where(own[:, None], rb, 0), np.where(own[:, None], 0.0, 1.0) * np.ones(dims)]), x)
            x = wide[-1]
            out = batch.select([*on, "__bucket"])
            new = np.flatnonzero(~own)
            if held is not None and len(new) and new[0] == 0:
                yield held
            ends = new[new > 0] - 1
            whole = pa.RecordBatch.from_arrays([*out.columns, *[pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), dims).cast(pa.list_(pa.float64())) for w in (wide[:, dims:], wide[:, :dims])]], [*on, "__bucket", "__a", "__b"])
            yield whole.take(pa.array(ends))
            held = whole.slice(len(own) - 1, 1)
        if held is not None:
            yield held

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(dims)
        for batch in batches:
            found = steps(matrix(batch.column("__a"), dims), matrix(batch.column("__b"), dims), x)
            x = found[-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), dims).cast(pa.list_(pa.float64()))], [*kept, name])

    filled = lambda rows, enter, by: rows.unionByName(enter).repartition(*by).sortWithinPartitions(*by, *ordered)
    first = groups.groupBy(*on).agg(F.min("__bucket").alias("__bucket"))
    if many == 1:
        enter = as_first(first, arrays(start))
    else:
        kept = [*on, "__bucket", "__own"]
        own = row.schema
        composed = filled(row.drop("__row"), as_first(groups, arrays([0.0] * dims)).drop("__row"), [*on, "__bucket"]).mapInArrow(totals, ", ".join([*[f"`{k}` {own[k].dataType.simpleString()}" for k in on], "__bucket int", "__a array<double>", "__b array<double>"]))
        composed = composed.select(*[(F.col(c) if c in (*on, "__bucket", "__a", "__b") else F.lit(1) if c == "__own" else no_row[c]).alias(c) for c in row.columns if c != "__row"])
        begin = as_first(first.withColumn("__bucket", F.lit(-1)), arrays(start)).drop("__row")
        schema = ", ".join([*[f"`{k}` {own[k].dataType.simpleString()}" for k in on], "__bucket int", "__own int", f"{name} array<double>"])
        after = filled(composed, begin, on).mapInArrow(states, schema)
        before = F.lag(name).over(Window.partitionBy(*on).orderBy("__bucket"))
        enter = as_first(after.withColumn("__s", before).where("__bucket >= 0"), F.col("__s"))
    kept = ["__own", "__row"]
    out = filled(row, enter, [*on, "__bucket"])
    schema = out.select("__own", "__row").schema.add(name, ArrayType(DoubleType()))
    return out.mapInArrow(states, schema).where("__own = 1").select("__row.*", name)
