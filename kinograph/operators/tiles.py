"""Filters over frames of any size: pixels are dealt to square tiles, each with a halo of its neighbours' pixels.

A pixel goes to its own tile and to those whose halo it lies in, by key, in one shuffle; a tile is dense
arrays in a task, and gives back its own pixels. Beyond a frame's border the border's pixel counts (edge
clamp). Results don't depend on the tile's size. Box sums come from summed-area tables, so their cost does
not grow with the radius.

Cases: frames may differ in size and begin anywhere; pixels that are missing inside a frame make what they reach null; of
repeated pixels one counts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256


def box_mean(values: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2 r + 1, from a summed-area table of the values less their mean; the result is smaller by r on each side."""
    middle = np.nanmean(values) if np.isfinite(values).any() else 0.0
    table = np.zeros((values.shape[0] + 1, values.shape[1] + 1))
    known = np.isfinite(values)
    table[1:, 1:] = np.where(known, values - middle, 0).cumsum(axis=0).cumsum(axis=1)
    n = 2 * r + 1
    square = lambda t: t[n:, n:] - t[:-n, n:] - t[n:, :-n] + t[:-n, :-n]
    out = square(table) / n**2 + middle
    if not known.all():
        table[1:, 1:] = (~known).cumsum(axis=0).cumsum(axis=1)
        out[square(table) > 0] = np.nan
    return out


def box(r: int) -> Callable[[list[np.ndarray]], np.ndarray]:
    return lambda planes: box_mean(planes[0], r)


def weighted(values: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """The sums of neighbours along an axis, times weights."""
    n = values.shape[axis] - len(weights) + 1
    return sum(w * np.take(values, range(i, i + n), axis) for i, w in enumerate(weights))


def gaussian_weights(r: int, sigma: float) -> list[float]:
    """Weights of -r to r that add up to one."""
    raw = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [w / sum(raw) for w in raw]


def gaussian(r: int, sigma: float) -> Callable[[list[np.ndarray]], np.ndarray]:
    weights = np.array(gaussian_weights(r, sigma))
    return lambda planes: weighted(weighted(planes[0], weights, 0), weights, 1)


def sobel() -> Callable[[list[np.ndarray]], np.ndarray]:
    """Length of the gradient by the 3 x 3 operator."""
    smooth, slope = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    return lambda planes: np.hypot(weighted(weighted(planes[0], smooth, 0), slope, 1), weighted(weighted(planes[0], slope, 0), smooth, 1))


def sharpen(amount: float = 1.0) -> Callable[[list[np.ndarray]], np.ndarray]:
    """The pixel and ``amount`` of its difference to each of its four neighbours."""

    def of(planes: list[np.ndarray]) -> np.ndarray:
        v = planes[0]
        around = v[:-2, 1:-1] + v[2:, 1:-1] + v[1:-1, :-2] + v[1:-1, 2:]
        return v[1:-1, 1:-1] * (1 + 4 * amount) - around * amount

    return of


def bilateral(r: int, sigma: float, tone: float) -> Callable[[list[np.ndarray]], np.ndarray]:
    """Neighbours weighed by distance and by likeness of value."""

    def of(planes: list[np.ndarray]) -> np.ndarray:
        v = planes[0]
        h, w = v.shape[0] - 2 * r, v.shape[1] - 2 * r
        middle, total, norm = v[r : r + h, r : r + w], np.zeros((h, w)), np.zeros((h, w))
        for dy in range(2 * r + 1):
            for dx in range(2 * r + 1):
                near = v[dy : dy + h, dx : dx + w]
                weight = math.exp(-((dx - r) ** 2 + (dy - r) ** 2) / (2 * sigma**2)) * np.exp(-((near - middle) ** 2) / (2 * tone**2))
                total, norm = total + near * weight, norm + weight
        return total / norm

    return of


def guided(r: int, eps: float) -> Callable[[list[np.ndarray]], np.ndarray]:
    """The second plane, redrawn along the edges of the first: a line fitted to both in each square, taken at its middle and clamped to 0 to 1."""

    def of(planes: list[np.ndarray]) -> np.ndarray:
        guide, mask = planes
        mean_i, mean_p = box_mean(guide, r), box_mean(mask, r)
        slope = (box_mean(guide * mask, r) - mean_i * mean_p) / (box_mean(guide * guide, r) - mean_i**2 + eps)
        own = guide[r : guide.shape[0] - r, r : guide.shape[1] - r]
        return np.clip(slope * (own - mean_i) + mean_p, 0.0, 1.0)

    return of


def filter_frames(pixels: DataFrame, planes: list[str], reach: int, of: Callable[[list[np.ndarray]], np.ndarray], out: str, frame: str = "frame", x: str = "x", y: str = "y", tile: int = TILE) -> DataFrame:
    """(frame, x, y, out): ``of`` the planes around each pixel. It gets arrays wider by ``reach`` on each side and gives back the middle."""
    if not 0 <= reach <= tile:
        raise ValueError("a filter reaches over one tile at most")
    kind = pixels.schema[frame].dataType.simpleString()
    rows = pixels.select(F.col(frame).alias("frame"), F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), *[F.col(p).cast("double").alias(f"v{i}") for i, p in enumerate(planes)])
    sides = rows.groupBy("frame").agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("least", F.min), ("most", F.max))])
    around = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile), F.floor((F.col(c) + reach) / tile))
    dealt = rows.withColumn("ty", F.explode(around("y"))).withColumn("tx", F.explode(around("x")))
    # halos beyond the frame have no tile; the frame's extent goes along with each tile's rows
    dealt = dealt.join(sides.withColumnRenamed("frame", "__frame"), F.col("frame").eqNullSafe(F.col("__frame"))).drop("__frame")
    dealt = dealt.where(F.col("ty").between(F.floor(F.col("least_y") / tile), F.floor(F.col("most_y") / tile)) & F.col("tx").between(F.floor(F.col("least_x") / tile), F.floor(F.col("most_x") / tile)))
    columns = ["x", "y", "ty", "tx", "least_x", "most_x", "least_y", "most_y"]

    def tile_of(frame_value: pa.Scalar, at: dict[str, np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        ty, tx, x0, x1, y0, y1 = (int(at[c][0]) for c in ("ty", "tx", "least_x", "most_x", "least_y", "most_y"))
        left, top = max(x0, tx * tile), max(y0, ty * tile)
        right, bottom = min(x1, tx * tile + tile - 1), min(y1, ty * tile + tile - 1)
        low_x, low_y = max(x0, left - reach), max(y0, top - reach)
        wide, tall = min(x1, right + reach) - low_x + 1, min(y1, bottom + reach) - low_y + 1
        clamp_x = np.clip(np.arange(left - reach, right + reach + 1), x0, x1) - low_x
        clamp_y = np.clip(np.arange(top - reach, bottom + reach + 1), y0, y1) - low_y
        padded, inside = [], (at["x"] - low_x < wide) & (at["x"] >= low_x) & (at["y"] - low_y < tall) & (at["y"] >= low_y)
        for v in values:
            plane = np.full((tall, wide), np.nan)
            plane[(at["y"] - low_y)[inside], (at["x"] - low_x)[inside]] = v[inside]
            padded.append(plane[np.ix_(clamp_y, clamp_x)])
        found = of(padded)
        held = (at["x"] >= left) & (at["x"] <= right) & (at["y"] >= top) & (at["y"] <= bottom)
        place = np.unique(np.column_stack([at["y"][held], at["x"][held]]), axis=0)
        result = found[place[:, 0] - top, place[:, 1] - left]
        return pa.RecordBatch.from_arrays([pa.repeat(frame_value, len(place)), pa.array(place[:, 1]), pa.array(place[:, 0]), pa.array(result, mask=~np.isfinite(result))], [frame, x, y, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def close() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            at = {c: whole.column(c).to_numpy() for c in columns}
            return tile_of(held[0].column("frame")[0], at, [whole.column(f"v{i}").to_numpy().astype(np.float64) for i in range(len(planes))])

        for batch in batches:
            keys = list(zip(batch.column("frame").to_pylist(), batch.column("ty").to_pylist(), batch.column("tx").to_pylist()))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(keys)]):
                if held and keys[a] != now:
                    yield close()
                    held = []
                now = keys[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield close()

    whole = dealt.repartition("frame", "ty", "tx").sortWithinPartitions("frame", "ty", "tx")
    return whole.mapInArrow(run, f"`{frame}` {kind}, `{x}` long, `{y}` long, `{out}` double")
