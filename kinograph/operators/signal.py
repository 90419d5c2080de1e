"""Signal operators over sample arrays: one row holds a block, so nothing is shuffled per sample."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def dft_magnitude(x: Column, n: int) -> Column:
    """Magnitudes of the first n / 2 + 1 frequencies by the definition; for short blocks."""

    def part(k: Column, wave) -> Column:
        terms = F.transform(x, lambda v, i: v * wave(F.lit(2 * math.pi) * k * i / F.lit(float(n))))
        return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)

    return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), lambda k: F.sqrt(F.pow(part(k, F.cos), 2) + F.pow(part(k, F.sin), 2)))


def stft(blocks: DataFrame, id_col: str, x_col: str, size: int = 1024, hop: int = 512) -> DataFrame:
    """(id, frame, magnitude array) of Hann-windowed frames by FFT, in Arrow batches."""
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / (size - 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, x in zip(batch.column(0), batch.column(1)):
                x = np.asarray(x.as_py() or [], float)
                n = max(0, (len(x) - size) // hop + 1)
                frames = np.stack([x[k * hop : k * hop + size] for k in range(n)]) if n else np.empty((0, size))
                spectrum = np.abs(np.fft.rfft(frames * window, axis=1))
                keys = pa.array([key.as_py()] * n, batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([keys, pa.array(range(n), pa.int32()), pa.array(list(spectrum), pa.list_(pa.float64()))], ["id", "frame", "magnitude"])

    kind = blocks.schema[id_col].dataType.simpleString()
    return blocks.select(id_col, F.col(x_col).cast("array<double>")).mapInArrow(run, f"id {kind}, frame int, magnitude array<double>")


def spectral_flux(now: Column, was: Column) -> Column:
    return F.aggregate(F.zip_with(now, was, lambda a, b: F.greatest(F.lit(0.0), a - b)), F.lit(0.0), lambda a, v: a + v)


def correlation(reference: Column, target: Column, lag: int) -> Column:
    """Array of (k, c): sum of reference[t] * target[t + k] for lags up to ``lag`` either way."""

    def at(k: Column) -> Column:
        terms = F.transform(reference, lambda v, t: F.when((t + k >= 0) & (t + k < F.size(target)), v * F.get(target, t + k)).otherwise(0.0))
        return F.struct(k.alias("k"), F.aggregate(terms, F.lit(0.0), lambda a, v: a + v).alias("c"))

    return F.transform(F.sequence(F.lit(-lag), F.lit(lag)), at)


def linear_resample(x: Column, n_out: int) -> Column:
    """A block stretched to n_out samples, interpolated linearly; the last sample is held."""

    def at(k: Column) -> Column:
        pos = k * F.size(x) / F.lit(float(n_out))
        i = F.floor(pos).cast("int")
        a, b = F.get(x, i), F.get(x, F.least(i + 1, F.size(x) - 1))
        return a + (b - a) * (pos - i)

    return F.transform(F.sequence(F.lit(0), F.lit(n_out - 1)), at)


def sinc_kernel(ratio: float, taps: int = 33, phases: int = 512, beta: float = 6.0) -> np.ndarray:
    """Normalised Kaiser-windowed sinc, one row per phase; low-pass at min(1, ratio)."""
    cutoff, half = min(1.0, ratio), taps // 2
    at = np.arange(taps)[None, :] - half - np.arange(phases)[:, None] / phases
    window = np.i0(beta * np.sqrt(np.maximum(0, 1 - (at / (half + 1)) ** 2))) / np.i0(beta)
    kernel = cutoff * np.sinc(cutoff * at) * window
    return kernel / kernel.sum(axis=1, keepdims=True)


def sinc_resample(x: Column, ratio: float) -> Column:
    """Blocks at ``ratio`` times their rate by a polyphase kernel, vectorised over Arrow batches."""
    kernel = sinc_kernel(ratio)
    phases, taps = kernel.shape

    @F.arrow_udf("array<double>")
    def resample(blocks: pa.Array) -> pa.Array:
        out = []
        for b in blocks:
            v = np.asarray(b.as_py() or [], float)
            pos = np.arange(int(len(v) * ratio)) / ratio
            i = pos.astype(int)
            phase = ((pos - i) * phases).astype(int)
            padded = np.pad(v, taps // 2)
            out.append((np.lib.stride_tricks.sliding_window_view(padded, taps)[i] * kernel[phase]).sum(axis=1) if len(pos) else np.empty(0))
        return pa.array([o.tolist() for o in out], pa.list_(pa.float64()))

    return resample(x)


def patch_flow(now: str, following: str, side: int) -> Column:
    """(u, v): least-squares motion of the inside of a side x side image between two frames; null where it is not determined."""
    inside = [y * side + x for y in range(1, side - 1) for x in range(1, side - 1)]
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "abcef"])

    def add(s: Column, i: Column) -> Column:
        gx = (F.get(now, i + 1) - F.get(now, i - 1)) / 2
        gy = (F.get(now, i + side) - F.get(now, i - side)) / 2
        gt = F.get(following, i) - F.get(now, i)
        terms = {"a": gx * gx, "b": gx * gy, "c": gy * gy, "e": gx * gt, "f": gy * gt}
        return F.struct(*[(s[k] + t).alias(k) for k, t in terms.items()])

    def solve(s: Column) -> Column:
        det = s["a"] * s["c"] - s["b"] * s["b"]
        flow = F.struct(((s["b"] * s["f"] - s["c"] * s["e"]) / det).alias("u"), ((s["b"] * s["e"] - s["a"] * s["f"]) / det).alias("v"))
        return F.when(F.abs(det) > 1e-9, flow)

    return F.aggregate(F.array(*[F.lit(i) for i in inside]), zero, add, solve)


def imdct(spectrum: np.ndarray) -> np.ndarray:
    """Inverse MDCT of n coefficients to 2n samples, sine-windowed."""
    n = len(spectrum)
    t, k = np.arange(2 * n)[:, None], np.arange(n)[None, :]
    out = (np.cos(np.pi / n * (t + 0.5 + n / 2) * (k + 0.5)) * spectrum[None, :]).sum(axis=1)
    return out * np.sin(np.pi / (2 * n) * (np.arange(2 * n) + 0.5)) * 2 / n


def overlap_add(blocks: DataFrame, on: list[str], number: str, x: str) -> DataFrame:
    """Second half of each block plus first half of the next: a join of neighbours, one row per seam."""
    half = F.expr(f"size({x}) div 2")
    left = blocks.select(*on, (F.col(number) + 1).alias(number), F.slice(x, half + 1, half).alias("__tail"))
    return left.join(blocks.select(*on, number, F.slice(x, F.lit(1), half).alias("__head")), [*on, number]).select(*on, number, F.zip_with("__tail", "__head", lambda a, b: a + b).alias(x))


