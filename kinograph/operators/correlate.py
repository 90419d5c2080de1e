"""Correlation of signals of any length by overlap-save: blocks of samples, their halos exchanged by key, one FFT a block.

Samples are rows (key, i, x). A reference block needs the target's samples up to the largest lag on either side; what wraps around in the circular
product falls outside the lags that are kept. A task adds up its blocks of a key before it sends on 2 lag + 1
sums, so a long signal is many tasks and the shuffle does not grow with it. Missing samples count as zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 4096


def power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def blocks(samples: DataFrame, on: list[str], i: str, x: str, size: int) -> DataFrame:
    """(*on, block, part: array<struct<i, x>>): samples gathered by stretches of ``size``."""
    return samples.groupBy(*on, F.floor(F.col(i) / size).alias("block")).agg(F.collect_list(F.struct(F.col(i).cast("long").alias("i"), F.col(x).cast("double").alias("x"))).alias("part"))


def correlate(reference: DataFrame, target: DataFrame, on: list[str], max_lag: int, i: str = "i", x: str = "x", size: int = SIZE) -> DataFrame:
    """(*on, lag, c): the sum of reference[t] * target[t + lag] for lags up to ``max_lag`` either way, for the keys of both."""
    ref = blocks(reference, on, i, x, size).withColumns({"at": F.col("block"), "kind": F.lit(0)})
    reach = F.sequence(F.floor((F.col("block") * size - max_lag) / size), F.floor(((F.col("block") + 1) * size - 1 + max_lag) / size))
    tgt = blocks(target, on, i, x, size).withColumns({"at": F.explode(reach), "kind": F.lit(1)})
    both = ref.unionByName(tgt).repartition(*on, "at").sortWithinPartitions(*on, "at", "kind")
    kinds = [(k, both.schema[k].dataType.simpleString()) for k in on]
    n, wide = power_of_two(size + 2 * max_lag), size + 2 * max_lag

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        held: pa.RecordBatch | None = None
        now, spectrum, near = None, None, None

        def close() -> None:
            """Add the block's correlation to its key's."""
            nonlocal total
            if spectrum is not None and near is not None:
                total = (np.zeros(2 * max_lag + 1) if total is None else total) + np.fft.irfft(np.fft.rfft(near, n) * np.conj(spectrum), n)[: 2 * max_lag + 1]

        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[held.column(c) for c in on], pa.array([total.tolist()], pa.list_(pa.float64()))], [*on, "sums"])

        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in on])) if on else [()] * batch.num_rows
            parts, kind_at = batch.column("part"), zip(batch.column("at").to_pylist(), batch.column("kind").to_pylist())
            for row, (key, (at, kind)) in enumerate(zip(keys, kind_at)):
                if (key, at) != now:
                    close()
                    if now is not None and key != now[0]:
                        if total is not None:
                            yield sums()
                        total = None
                    now, spectrum, near = (key, at), None, None
                    held = batch.slice(row, 1)
                part = parts[row].values
                place, value = part.field("i").to_numpy() - at * size, part.field("x").to_numpy(zero_copy_only=False)
                if kind == 0:
                    own = np.zeros(size)
                    np.add.at(own, place, value)
                    spectrum = np.fft.rfft(own, n)
                elif spectrum is not None:
                    near = np.zeros(wide) if near is None else near
                    inside = (place + max_lag >= 0) & (place + max_lag < wide)
                    np.add.at(near, place[inside] + max_lag, value[inside])
        close()
        if total is not None:
            yield sums()

    found = both.select(*on, "at", "kind", "part").mapInArrow(run, ", ".join([*[f"`{k}` {t}" for k, t in kinds], "sums array<double>"]))
    each = found.select(*on, F.posexplode("sums").alias("lag", "c"))
    return each.groupBy(*on, (F.col("lag") - max_lag).cast("long").alias("lag")).agg(F.sum("c").alias("c"))


def energy(samples: DataFrame, on: list[str], x: str = "x") -> DataFrame:
    return samples.groupBy(*on).agg(F.sum(F.col(x) * F.col(x)).alias("energy"))


def peaks(reference: DataFrame, target: DataFrame, on: list[str], max_lag: int, i: str = "i", x: str = "x", size: int = SIZE) -> DataFrame:
    """(*on, lag, sub_lag, offset, confidence): where two signals fit best.

    Of equal peaks the first counts, in the order 0, 1, ..., then the negative lags upwards. ``sub_lag`` is the top of the
    parabola through the peak and its neighbours (the peak itself at lags 0 and -1, the ends of a circular
    correlation, and at the largest lag), ``offset`` that rounded, ``confidence`` the peak over the root of both energies, from 0 to 1.
    """
    c = correlate(reference, target, on, max_lag, i, x, size)
    best = c.groupBy(*on).agg(F.max(F.struct("c", (F.col("lag") >= 0).alias("ahead"), (-F.col("lag")).alias("back"))).alias("b")).select(*on, (-F.col("b.back")).alias("lag"), F.col("b.c").alias("peak"))
    beside = lambda step, name: c.select(*on, (F.col("lag") - step).alias("lag"), F.col("c").alias(name))
    out = best.join(beside(-1, "before"), [*on, "lag"], "left").join(beside(1, "after"), [*on, "lag"], "left")
    bend = F.col("before") - 2 * F.col("peak") + F.col("after")
    inner = ~F.col("lag").isin(0, -1) & (F.abs(bend) > 1e-12)
    out = out.withColumn("sub_lag", F.col("lag") + F.when(inner, (F.col("before") - F.col("after")) / (2 * bend)).otherwise(0.0))
    out = out.join(energy(reference, on, x).withColumnRenamed("energy", "__r"), on).join(energy(target, on, x).withColumnRenamed("energy", "__t"), on)
    norm = F.sqrt(F.col("__r") * F.col("__t"))
    confidence = F.when(norm > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("peak") / norm))).otherwise(0.0)
    return out.select(*on, "lag", "sub_lag", F.floor(F.col("sub_lag") + 0.5).alias("offset"), confidence.alias("confidence"))


SPECTRUM = "struct<re: array<double>, im: array<double>>"


def fft(x: Column) -> Column:
    """Spectrum of a block of any length, filled up with zeros to a power of two."""

    @F.arrow_udf(SPECTRUM)
    def forward(blocks: pa.Array) -> pa.Array:
        found = [np.fft.fft(v, power_of_two(len(v))) if len(v) else np.empty(0) for v in (np.asarray(b.as_py() or [], float) for b in blocks)]
        kind = pa.list_(pa.float64())
        return pa.StructArray.from_arrays([pa.array([f.real.tolist() for f in found], kind), pa.array([f.imag.tolist() for f in found], kind)], ["re", "im"])

    return forward(x)


def inverse_fft(re: Column, im: Column) -> Column:
    """The real samples of a spectrum of two arrays."""

    @F.arrow_udf("array<double>")
    def back(res: pa.Array, ims: pa.Array) -> pa.Array:
        found = (np.asarray(r.as_py() or [], float) + 1j * np.asarray(i.as_py() or [], float) for r, i in zip(res, ims))
        return pa.array([np.fft.ifft(f).real.tolist() if len(f) else [] for f in found], pa.list_(pa.float64()))

    return back(re, im)


def imdct_blocks(coefficients: Column) -> Column:
    """Each block of n coefficients as 2 n windowed samples."""
    from kinograph.operators.signal import imdct

    @F.arrow_udf("array<double>")
    def back(blocks: pa.Array) -> pa.Array:
        return pa.array([imdct(np.asarray(b.as_py(), float)).tolist() for b in blocks], pa.list_(pa.float64()))

    return back(coefficients)
