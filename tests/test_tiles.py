"""Filters over tiles: the same for any tile, equal to plain loops, frames of any place and size."""

from __future__ import annotations

import numpy as np
import pytest

from kinograph.operators import tiles

RNG = np.random.default_rng(6)
FRAMES = {7: (RNG.random((23, 41)), (-5, 3)), 8: (RNG.random((1, 1)), (0, 0)), 9: (RNG.random((40, 2)), (100, -30))}


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [(f, x0 + j, y0 + i, float(v), float(v * v % 0.7)) for f, (p, (x0, y0)) in FRAMES.items() for i, r in enumerate(p) for j, v in enumerate(r)]
    return spark.createDataFrame(rows, "frame int, x long, y long, v double, m double").repartition(7).cache()


def padded(plane, r):
    return np.pad(plane, r, mode="edge")


CASES = {"box": (3, tiles.box(3)), "wide box": (9, tiles.box(9)), "gauss": (4, tiles.gaussian(4, 2.0)), "sobel": (1, tiles.sobel()), "sharpen": (1, tiles.sharpen(0.5)), "bilateral": (2, tiles.bilateral(2, 1.0, 0.3))}


@pytest.mark.parametrize("name", CASES)
def test_any_tile_gives_the_whole_frames_result(pixels, name):
    reach, of = CASES[name]
    want = {f: of([padded(p, reach)]) for f, (p, _) in FRAMES.items()}
    for tile in (9, 16, 256):
        got = tiles.filter_frames(pixels, ["v"], reach, of, "out", tile=tile).collect()
        assert len(got) == sum(p.size for p, _ in FRAMES.values())
        for r in got:
            x0, y0 = FRAMES[r["frame"]][1]
            assert r["out"] == pytest.approx(want[r["frame"]][r["y"] - y0, r["x"] - x0], abs=1e-12)


def test_filters_by_plain_loops():
    p = RNG.random((9, 8))
    big = padded(p, 2)
    windows = np.array([[big[i : i + 5, j : j + 5] for j in range(8)] for i in range(9)])
    assert np.allclose(tiles.box(2)([big]), windows.mean(axis=(2, 3)))
    w = np.exp(-(np.arange(-2, 3) ** 2) / (2 * 1.3**2))
    assert np.allclose(tiles.gaussian(2, 1.3)([big]), (windows * np.outer(w, w) / w.sum() ** 2).sum(axis=(2, 3)))
    k = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    inner = windows[:, :, 1:4, 1:4]
    assert np.allclose(tiles.sobel()([padded(p, 1)]), np.hypot((inner * k).sum(axis=(2, 3)), (inner * k.T).sum(axis=(2, 3))))
    mask = RNG.random((9, 8))
    more = np.array([[padded(mask, 2)[i : i + 5, j : j + 5] for j in range(8)] for i in range(9)])
    i, q = windows.mean(axis=(2, 3)), more.mean(axis=(2, 3))
    a = ((windows * more).mean(axis=(2, 3)) - i * q) / ((windows**2).mean(axis=(2, 3)) - i * i + 0.1)
    assert np.allclose(tiles.guided(2, 0.1)([big, padded(mask, 2)]), np.clip(a * p + q - a * i, 0, 1))


def test_missing_and_repeated_pixels(spark, pixels):
    holed = pixels.where("not (frame = 7 and x = 10 and y = 10)").unionByName(pixels.where("frame = 9"))
    got = {(r["frame"], r["x"], r["y"]): r["out"] for r in tiles.filter_frames(holed, ["v"], 1, tiles.box(1), "out", tile=8).collect()}
    assert len(got) == sum(p.size for p, _ in FRAMES.values()) - 1
    assert {k for k, v in got.items() if v is None} == {(7, 10 + i, 10 + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)}
    assert tiles.filter_frames(pixels.where("false"), ["v"], 1, tiles.box(1), "out").collect() == []
    with pytest.raises(ValueError):
        tiles.filter_frames(pixels, ["v"], 9, tiles.box(9), "out", tile=8)


def test_a_box_keeps_small_values_beside_large_ones():
    """The summed-area table is of differences to the mean: a bright frame costs no digits."""
    p = 1e9 + RNG.random((300, 300))
    got = tiles.box_mean(padded(p, 1), 1)
    assert np.allclose(got - 1e9, np.mean([padded(p - 1e9, 1)[i : i + 300, j : j + 300] for i in range(3) for j in range(3)], axis=0), atol=1e-6)
