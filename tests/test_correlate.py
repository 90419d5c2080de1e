"""Correlation by blocks equals the definition; a lag in a long signal is found; spectra go there and back; resampling by a plain loop."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinograph.operators import correlate, signal

RNG = np.random.default_rng(9)


def samples(spark, signals):
    return spark.createDataFrame([(k, i + at, float(v)) for k, (at, x) in signals.items() for i, v in enumerate(x)], "k string, i long, x double").repartition(5)


@pytest.mark.parametrize("size", [4, 16, 4096])
def test_correlation_equals_its_definition(spark, size):
    refs = {"a": (0, RNG.normal(size=70)), "b": (-13, RNG.normal(size=33)), "c": (5, RNG.normal(size=3)), "only": (0, RNG.normal(size=4))}
    tgts = {"a": (3, RNG.normal(size=50)), "b": (40, RNG.normal(size=20)), "c": (0, RNG.normal(size=40))}
    got = {(r["k"], r["lag"]): r["c"] for r in correlate.correlate(samples(spark, refs), samples(spark, tgts), ["k"], 9, size=size).collect()}
    for k in tgts:
        r, t = ({at + i: v for i, v in enumerate(x)} for at, x in (refs[k], tgts[k]))
        for lag in range(-9, 10):
            want = sum(v * t.get(i + lag, 0.0) for i, v in r.items())
            assert got.get((k, lag), 0.0) == pytest.approx(want, abs=1e-9)
    assert not any(k == "only" for k, _ in got)


def test_a_lag_in_a_long_signal(spark):
    """300,000 samples in 74 blocks of one key, more than one task; the lag is longer than a block."""
    n, lag = 300_000, 9_137
    x = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(2001)) / 1000 - 1).alias("x"))
    later = x.select("k", (F.col("i") + lag).alias("i"), (F.col("x") * 2).alias("x"))
    row = correlate.peaks(x, later, ["k"], 10_000).first()
    assert (row["lag"], row["offset"]) == (lag, lag) and abs(row["sub_lag"] - lag) < 0.1 and row["confidence"] == pytest.approx(1, abs=1e-9)


def test_peaks_between_samples(spark):
    """A smooth bump moved by 2.3 samples: the parabola comes within a twentieth; silence has no confidence."""
    bump = lambda at: [math.exp(-((i - at) ** 2) / 50) for i in range(100)]
    out = correlate.peaks(samples(spark, {"a": (0, bump(40)), "z": (0, [0.0] * 9)}), samples(spark, {"a": (0, bump(42.3)), "z": (0, [0.0] * 9)}), ["k"], 20, size=32)
    rows = {r["k"]: r for r in out.collect()}
    assert abs(rows["a"]["sub_lag"] - 2.3) < 0.05 and rows["a"]["offset"] == 2 and rows["a"]["confidence"] > 0.99
    assert (rows["z"]["lag"], rows["z"]["confidence"]) == (0, 0.0)


def test_spectra_there_and_back(spark):
    held = [RNG.normal(size=n).tolist() for n in (1, 2, 3, 64, 100)] + [[]]
    rows = spark.createDataFrame(list(enumerate(held)), "k long, x array<double>").select("k", "x", correlate.fft(F.col("x")).alias("f"))
    for r in rows.withColumn("y", correlate.inverse_fft(F.col("f.re"), F.col("f.im"))).collect():
        n = correlate.power_of_two(len(r["x"])) if r["x"] else 0
        assert len(r["f"]["re"]) == n
        for k in range(n):
            want = sum(v * complex(math.cos(2 * math.pi * k * i / n), -math.sin(2 * math.pi * k * i / n)) for i, v in enumerate(r["x"]))
            assert r["f"]["re"][k] == pytest.approx(want.real, abs=1e-9) and r["f"]["im"][k] == pytest.approx(want.imag, abs=1e-9)
        assert r["y"] == pytest.approx([*r["x"], *[0.0] * (n - len(r["x"]))], abs=1e-12)


def bessel(x):
    return sum((x / 2) ** (2 * k) / math.factorial(k) ** 2 for k in range(40))


@pytest.mark.parametrize("ratio", [0.75, 1.0, 2.0])
def test_sinc_resampling_by_a_plain_loop(spark, ratio):
    x = RNG.normal(size=50).tolist()
    got = spark.createDataFrame([(x,), ([],)], "x array<double>").select(signal.sinc_resample(F.col("x"), ratio)).collect()
    taps, phases, beta, cut = 33, 512, 6.0, min(1.0, ratio)
    want = []
    for n in range(int(len(x) * ratio)):
        at = n / ratio
        i, phase = int(at), int((at - int(at)) * phases)
        kernel = []
        for j in range(taps):
            t = j - 16 - phase / phases
            window = bessel(beta * math.sqrt(max(0.0, 1 - (t / 17) ** 2))) / bessel(beta)
            kernel.append(cut * (1.0 if t == 0 else math.sin(math.pi * cut * t) / (math.pi * cut * t)) * window)
        want.append(sum(w * (x[i + j - 16] if 0 <= i + j - 16 < len(x) else 0.0) for j, w in enumerate(kernel)) / sum(kernel))
    assert got[0][0] == pytest.approx(want, abs=1e-9) and got[1][0] == []
