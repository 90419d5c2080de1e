"""Ordered sequences: runs, running offsets, greedy gaps, recursive filters, framing, rolling medians.

Windows are partitioned by key and bounded; folds run over one key's ordered array inside a row
expression. Keys with more rows than an array should hold go through :func:`grouped_fold`,
which streams a key's sorted rows in Arrow batches with constant state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.operators import carry


def runs(df: DataFrame, on: list[str], order: list[str], value: Column, name: str = "run") -> DataFrame:
    """Number the runs of equal neighbouring values of each key, from 0."""
    w = Window.partitionBy(*on).orderBy(*order)
    df = df.withColumn("__v", value)
    start = F.when(F.col("__v").eqNullSafe(F.lag("__v").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__start", start).withColumn(name, F.sum("__start").over(w) - 1).drop("__v", "__start")


def rle_encode(df: DataFrame, on: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, run, value, n): run-length coding."""
    return runs(df, on, order, F.col(value)).groupBy(*on, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def rle_expand(coded: DataFrame, n: str, name: str = "k") -> DataFrame:
    """Each run's row, repeated n times with its number from 0."""
    return coded.where(F.col(n) > 0).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))


def offsets(df: DataFrame, on: list[str], order: list[str], size: Column, name: str = "offset") -> DataFrame:
    """Sum of the sizes before each row."""
    before = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)))


def ordered_array(df: DataFrame, on: list[str], order: list[str], values: list[str], name: str = "rows") -> DataFrame:
    """One row per key with its rows as an array in order."""
    return df.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(*order, *[v for v in values if v not in order]))).alias(name))


def kalman_steps(q: float = 1e-5, r: float = 1e-2) -> Callable[[float], float]:
    """One-dimensional Kalman filter, starting at 0 with variance 1; one value at a time, for :func:`grouped_fold`."""
    p, x = 1.0, 0.0

    def step(z: float) -> float:
        nonlocal p, x
        p += q
        k = p / (p + r)
        x += k * (z - x)
        p *= 1.0 - k
        return x

    return step


def ducking_steps(threshold: float, ratio: float, attack: float, release: float) -> Callable[[float], float]:
    """Gain per block: above the threshold it falls to ``1 / ratio`` at the attack rate, else it rises at the release rate."""
    g = 1.0

    def step(level: float) -> float:
        nonlocal g
        goal = 1.0 / ratio if level > threshold else 1.0
        keep = attack if goal < g else release
        g = g * keep + goal * (1.0 - keep)
        return g

    return step


def kalman_gains(q: float = 1e-5, r: float = 1e-2, most: int = 100_000) -> list[float]:
    """The filter's gains in order, up to the one that all later ones equal to double precision: they don't depend on what is measured."""
    p, gains = 1.0, []
    while len(gains) < most:
        p += q
        k = p / (p + r)
        p *= 1.0 - k
        if len(gains) > 1 and abs(k - gains[-1]) <= 1e-16 * k:
            break
        gains.append(k)
    return gains


def kalman(df: DataFrame, on: list[str], t: str, ties: list[str], z: str, name: str = "x", q: float = 1e-5, r: float = 1e-2, rows: int = carry.BUCKET_ROWS) -> DataFrame:
    """Add n (from 1) and the filter's state after each row of a key, from 0 and variance 1 on: x = (1 - k) x + k z, a recurrence scanned in parallel."""
    gains = kalman_gains(q, r)
    numbered = carry.running_sum(df, on, t, ties, {"n": F.lit(1)}, rows)
    k = F.get(F.array(*map(F.lit, gains)), F.least(F.col("n"), F.lit(len(gains))).cast("int") - 1)
    out = carry.affine_scan(numbered, on, t, ties, F.array(1 - k), F.array(k * F.col(z)), [0.0], name, rows)
    return out.withColumn(name, F.get(name, F.lit(0)))


def ducking(df: DataFrame, on: list[str], t: str, ties: list[str], level: str, threshold: float, ratio: float, attack: float, release: float, name: str = "gain", rows: int = carry.BUCKET_ROWS) -> DataFrame:
    """Add n and the gain after each row: the goal alone says whether it falls, at the attack rate, or rises, as the gain lies between both goals."""
    low = F.col(level) > threshold
    goal, keep = F.when(low, 1.0 / ratio).otherwise(1.0), F.when(low, attack).otherwise(release)
    numbered = carry.running_sum(df, on, t, ties, {"n": F.lit(1)}, rows)
    out = carry.affine_scan(numbered, on, t, ties, F.array(keep), F.array(goal * (1 - keep)), [1.0], name, rows)
    return out.withColumn(name, F.get(name, F.lit(0)))


#: Decay and input weight of the six poles of the pink filter, weights of the input itself now and one sample later, and the whole's.
PINK = ((0.99886, 0.0555179), (0.99332, 0.0750759), (0.96900, 0.1538520), (0.86650, 0.3104856), (0.55000, 0.5329522), (-0.7616, -0.0168980))
PINK_NOW, PINK_LATER, PINK_WHOLE = 0.5362, 0.115926, 0.11
#: The brown filter's input weight, leak and gain.
BROWN_IN, BROWN_LEAK, BROWN_GAIN = 0.02, 1.02, 3.5


def coloured_noise(df: DataFrame, on: list[str], t: str, ties: list[str], white: str, rows: int = carry.BUCKET_ROWS) -> DataFrame:
    """Add n, pink and brown: the columns of white noise through both recursive filters, seven recurrences scanned at once."""
    numbered = carry.running_sum(df, on, t, ties, {"n": F.lit(1)}, rows)
    decay = F.array(*[F.lit(a) for a, _ in PINK], F.lit(1 / BROWN_LEAK))
    enter = F.array(*[F.col(white) * b for _, b in PINK], F.col(white) * (BROWN_IN / BROWN_LEAK))
    out = carry.affine_scan(numbered, on, t, ties, decay, enter, [0.0] * 7, "__state", rows)
    later = numbered.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], (F.col("n") + 1).alias("__n"), F.col(white).alias("__before"))
    same = F.col("n") == F.col("__n")
    for i, c in enumerate(on):
        same &= F.col(c).eqNullSafe(F.col(f"__k{i}"))
    poles = F.aggregate(F.slice("__state", 1, len(PINK)), F.lit(0.0), lambda a, x: a + x)
    pink = (poles + F.coalesce("__before", F.lit(0.0)) * PINK_LATER + F.col(white) * PINK_NOW) * PINK_WHOLE
    return out.join(later, same, "left").select(*df.columns, "n", pink.alias("pink"), (F.get("__state", F.lit(6)) * BROWN_GAIN).alias("brown"))


def greedy_gap_steps(gap: int) -> Callable[[int], bool]:
    """Whether a value of an ascending sequence is more than ``gap`` after the last one taken, for :func:`grouped_fold`."""
    last = None

    def step(t: int) -> bool:
        nonlocal last
        taken = last is None or t - last > gap
        last = t if taken else last
        return taken

    return step


def rolling_median(x: str, on: list[str], order: list[str], reach: int) -> Column:
    """Upper median of the rows within ``reach``; null where the frame is cut off."""
    around = F.collect_list(x).over(Window.partitionBy(*on).orderBy(*order).rowsBetween(-reach, reach))
    return F.when(F.size(around) == 2 * reach + 1, F.element_at(F.array_sort(around), reach + 1))


def upper_median(df: DataFrame, on: list[str], value: str, name: str = "median") -> DataFrame:
    """The value in the place floor(n / 2), from 0, of each key's sorted values: by a running count over distinct values, so no array holds a key."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*on, value).agg(F.count("*").alias("__n"))
    up_to = F.sum("__n").over(Window.partitionBy(*on).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__n").over(Window.partitionBy(*on))
    return counts.withColumns({"__up": up_to, "__all": total}).where("__up > __all div 2").groupBy(*on).agg(F.min(value).alias(name))


def numbers(n: Column) -> Column:
    """0 to n - 1; none for n of 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("int"), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def hops(x: Column, size: int, hop: int) -> Column:
    """Array of frames (start, samples) of an array; the rest that fills no frame is left out."""
    last = F.floor((F.size(x) - size) / hop)
    starts = F.when(F.size(x) >= size, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda k: F.struct((k * hop).alias("start"), F.slice(x, (k * hop + 1).cast("int"), size).alias("samples")))


def grouped_fold(df: DataFrame, on: str, order: list[str], value: str, make: Callable, schema: str) -> DataFrame:
    """Run a Python fold over each key's rows in order, whatever their number.

    ``make()`` gives a function from (order values..., value) to a list of output values. Rows are shuffled by key
    and sorted; a task holds one batch and the state of one key. ``schema`` names key, order and outputs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = object(), None
        for batch in batches:
            out = []
            for key, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if key != now:
                    now, fold = key, make()
                out.append((key, *row[:-1], *fold(*row)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in out], schema=arrow)

    names = [c.split()[0] for c in schema.split(", ")]
    arrow = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in schema.split(", ")])
    return df.select(on, *order, value).repartition(on).sortWithinPartitions(on, *order).mapInArrow(run, schema)
