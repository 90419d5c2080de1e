"""Ordered work over long keys: the carried results equal the plain fold, however small the buckets, and one key is many tasks."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinograph.operators import carry, joins, sequences

ROWS = [(int(k), int(t), i, float(z)) for i, (k, t, z) in enumerate(zip(*(np.random.default_rng(1).integers(0, n, 2000) for n in (4, 300)), np.random.default_rng(2).normal(size=2000)))]
BY_KEY = {k: list(g) for k, g in itertools.groupby(sorted(ROWS, key=lambda r: r[:3]), lambda r: r[0])}
SIZES = [10**6, 150, 23]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k long, t long, i long, z double").repartition(5).cache()


@pytest.mark.parametrize("size", SIZES)
def test_running_sum(rows, size):
    out = carry.running_sum(rows, ["k"], "t", ["i"], {"n": F.lit(1), "s": F.col("i")}, rows=size)
    assert out.columns == [*rows.columns, "n", "s"]
    got = {r["i"]: (r["n"], r["s"]) for r in out.collect()}
    for held in BY_KEY.values():
        for n, (r, s) in enumerate(zip(held, itertools.accumulate(r[2] for r in held)), 1):
            assert got[r[2]] == (n, s)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("clamp", [False, True])
def test_asof(rows, size, clamp):
    facts = rows.where("i % 9 = 0").select("k", F.col("t").alias("at"), F.col("i").alias("v"))
    out = carry.asof(rows.where("i % 9 > 0"), facts, ["k"], "t", "at", ["at", "v"], clamp, rows=size).collect()
    assert len(out) == sum(r[2] % 9 > 0 for r in ROWS)
    for r in out:
        known = [f for f in BY_KEY[r["k"]] if f[2] % 9 == 0]
        before = [f for f in known if f[1] <= r["t"]]
        want = max(before, key=lambda f: f[1:3])[1:3] if before else min(known, key=lambda f: f[1:3])[1:3] if clamp else (None, None)
        assert (r["at"], r["v"]) == want


def test_asof_without_facts_or_probes(rows):
    none = rows.where("false").select("k", F.col("t").alias("at"), F.col("i").alias("v"))
    for clamp in (False, True):
        assert carry.asof(rows, none, ["k"], "t", "at", ["v"], clamp, rows=50).where("v is null").count() == len(ROWS)
        assert carry.asof(rows.where("false"), none, ["k"], "t", "at", ["v"], clamp).count() == 0


@pytest.mark.parametrize("size", SIZES)
def test_affine_scan(rows, size):
    a, b = F.array(F.lit(0.9), F.when(F.col("z") > 0, 0.5).otherwise(-1.0), F.lit(1.0)), F.array(F.col("z"), F.lit(1.0), F.lit(0.25))
    got = {r["i"]: r["x"] for r in carry.affine_scan(rows, ["k"], "t", ["i"], a, b, [1.0, 2.0, 0.0], "x", rows=size).collect()}
    assert len(got) == len(ROWS)
    for held in BY_KEY.values():
        x = [1.0, 2.0, 0.0]
        for _, _, i, z in held:
            x = [0.9 * x[0] + z, (0.5 if z > 0 else -1.0) * x[1] + 1, x[2] + 0.25]
            assert got[i] == pytest.approx(x, abs=1e-9)
    assert carry.affine_scan(rows.where("false"), ["k"], "t", ["i"], a, b, [1.0, 2.0, 0.0]).count() == 0


def test_scan_in_blocks():
    rng = np.random.default_rng(3)
    a, b = rng.uniform(-1, 1, (1000, 3)), rng.normal(size=(1000, 3))
    a[[0, 400]] = 0
    x, want = np.array([5.0, 6.0, 7.0]), []
    for i in range(1000):
        x = a[i] * x + b[i]
        want.append(x)
    assert np.allclose(carry.scan(a, b, np.array([5.0, 6.0, 7.0])), want, atol=1e-12)
    assert (carry.steps(a, b, np.array([5.0, 6.0, 7.0])) == want).all()


@pytest.mark.parametrize("size", [10**6, 100])
def test_filters_equal_their_folds(rows, size):
    kalman = {r["i"]: (r["n"], r["x"]) for r in sequences.kalman(rows, ["k"], "t", ["i"], "z", rows=size).collect()}
    gain = {r["i"]: r["gain"] for r in sequences.ducking(rows, ["k"], "t", ["i"], "z", 0.5, 4.0, 0.3, 0.9, rows=size).collect()}
    noise = {r["i"]: (r["pink"], r["brown"]) for r in sequences.coloured_noise(rows, ["k"], "t", ["i"], "z", rows=size).collect()}
    for held in BY_KEY.values():
        step, duck = sequences.kalman_steps(), sequences.ducking_steps(0.5, 4.0, 0.3, 0.9)
        b, later, brown = [0.0] * 6, 0.0, 0.0
        for n, (_, _, i, z) in enumerate(held, 1):
            assert kalman[i] == (n, pytest.approx(step(z), abs=1e-9)) and gain[i] == pytest.approx(duck(z), abs=1e-9)
            b = [0.99886 * b[0] + z * 0.0555179, 0.99332 * b[1] + z * 0.0750759, 0.969 * b[2] + z * 0.153852, 0.8665 * b[3] + z * 0.3104856, 0.55 * b[4] + z * 0.5329522, -0.7616 * b[5] - z * 0.016898]
            brown = (brown + 0.02 * z) / 1.02
            assert noise[i] == pytest.approx(((sum(b) + later + z * 0.5362) * 0.11, brown * 3.5), abs=1e-9)
            later = z * 0.115926


def test_one_key_of_a_million_rows_is_many_tasks(spark):
    """Buckets of one key are dealt out: no task of the scan or the as-of sees more than a fraction of it."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.col("id") % 10).cast("double").alias("z"))
    out = sequences.kalman(df, ["k"], "t", [], "z").withColumn("task", F.spark_partition_id())
    per_task = [r["count"] for r in out.groupBy("task").count().collect()]
    assert sum(per_task) == n and len(per_task) >= 3 and max(per_task) <= n / 2
    facts = spark.range(0, n, 1000).select(F.lit(1).alias("k"), F.col("id").alias("at"), F.col("id").alias("v"))
    met = carry.asof(df, facts, ["k"], "t", "at", ["at", "v"]).withColumn("task", F.spark_partition_id())
    assert met.where("v <> t - t % 1000").count() == 0
    per_task = [r["count"] for r in met.groupBy("task").count().collect()]
    assert sum(per_task) == n and len(per_task) >= 3 and max(per_task) <= n / 2


def test_overlap_counts(spark):
    rng = np.random.default_rng(5)
    held = [(int(rng.integers(3)), i * 7 % 401, int(lo), int(lo + rng.integers(0, 30))) for i, lo in enumerate(rng.integers(0, 200, 300))]
    df = spark.createDataFrame(held, "track long, id long, lo long, hi long")
    met = joins.overlap_counts(df, "lo", "hi", "id", ["track"]).groupBy("track", "id", "sign").agg(F.sum("partners").alias("n")).collect()
    got = {(r["track"], r["id"], r["sign"]): r["n"] for r in met if r["n"]}
    want = {}
    for a in held:
        for b in held:
            if a[0] == b[0] and a[1] != b[1] and a[2] < b[3] and a[3] > b[2] and a[2] < a[3] and b[2] < b[3]:
                key = (a[0], a[1], 1 if b[1] < a[1] else -1)
                want[key] = want.get(key, 0) + 1
    assert got == want


@pytest.mark.parametrize("rows", [16, 100_000])
def test_overlap_counts_over_blocks_of_ids(spark, rows):
    """Ids far apart and below zero, in many blocks and in one; what is shuffled doesn't grow with the bits of an id."""
    rng = np.random.default_rng(9)
    held = [(int(rng.integers(3)), (i * 7 % 401) ** 4 * (-1) ** i, int(lo), int(lo + rng.integers(0, 30))) for i, lo in enumerate(rng.integers(0, 60, 300))]
    df = spark.createDataFrame(held, "track long, id long, lo long, hi long")
    found = joins.overlap_counts(df, "lo", "hi", "id", ["track"], rows=rows)
    got = {(r["track"], r["id"], r["sign"]): r["partners"] for r in found.collect() if r["partners"]}
    want = {}
    for a in held:
        for b in held:
            if a[0] == b[0] and a[1] != b[1] and a[2] < b[3] and a[3] > b[2] and a[2] < a[3] and b[2] < b[3]:
                key = (a[0], a[1], 1 if b[1] < a[1] else -1)
                want[key] = want.get(key, 0) + 1
    assert got == want
    assert found.count() <= 2 * len(held)


def test_to_root(spark):
    """A path of 100 nodes, a bush, an orphan and a cycle with a tail; the cycle and the orphan have no root."""
    parents = {0: None, **{i: i - 1 for i in range(1, 100)}, **{200 + i: i % 7 for i in range(50)}, 300: 999, 301: 300, 400: 401, 401: 402, 402: 400, 403: 400, 500: None}
    df = spark.createDataFrame([(i, p, float(i % 5)) for i, p in parents.items()], "id long, parent long, angle double")
    value = joins.affine(F.col("angle"), F.lit(0.9), F.col("id") % 3, F.lit(1))
    got = {r["id"]: (r["depth"], r["value"]) for r in joins.to_root(df, "id", "parent", value, joins.after).collect()}
    assert set(got) == set(parents) - {300, 301, 400, 401, 402, 403}
    for i in got:
        depth, m, at = -1, np.eye(3), i
        while at is not None:
            c, s = 0.9 * np.cos(at % 5), 0.9 * np.sin(at % 5)
            m = np.array([[c, -s, at % 3], [s, c, 1], [0, 0, 1]]) @ m
            depth, at = depth + 1, parents[at]
        assert got[i][0] == depth and got[i][1] == pytest.approx([m[0, 0], m[1, 0], m[0, 1], m[1, 1], m[0, 2], m[1, 2]], abs=1e-9)
    assert joins.to_root(df.where("false"), "id", "parent", value, joins.after).collect() == []
    with pytest.raises(ValueError, match="deeper"):
        joins.flatten_tree(df, "id", "parent", "angle")
