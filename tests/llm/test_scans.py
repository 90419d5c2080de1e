"""License scans, periodic runs and whitening against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus import SF, awkward, documents, texts  # noqa: F401

pytest.importorskip("kinograph.llm")
from kinograph.llm import licenses, periodic, queries, whitening  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# licenses


def brute_base(text):
    words = WORD.findall(lower(text or ""))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [p[0] for p in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({p[1] for p in places}))


def licensed_rows(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def license_rows(df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op11_licenses(df.sparkSession, str(tmp_path))


CASES = [
    "MIT License",
    "mit. license mit/license\nmit\tlicense",
    "the mitlicense and mit licenses and smit license",
    "apache apache license license",
    "General Public License general public license",
    "mit license " * 3000,
    "é mit éx license mit license中文 mit license",
    "K mit license",  # the Kelvin sign stays as it is
    "License MIT",
]


def test_licenses_base_against_brute_force(spark, awkward, tmp_path):  # noqa: F811
    rows = [(100 + i, t) for i, t in enumerate(CASES)] * 2
    df = licensed_rows(spark, rows).unionByName(awkward, allowMissingColumns=True)
    out = license_rows(df, tmp_path).collect()
    found = sorted((str(r["doc_id"]), r["n_words"], r["n_base"], str(r["first_word"]), str(r["last_word"]), r["base_labels"]) for r in out)
    wanted = sorted((str(i), n, b, str(lo), str(hi), labels) for i, t in texts(df) for n, b, lo, hi, labels in [brute_base(t)])
    assert found == wanted
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in out)


def test_licenses_of_documents(spark, documents, tmp_path):  # noqa: F811
    out = queries.op11_licenses(spark, SF).collect()
    wanted = {i: brute_base(t) for i, t in texts(documents)}
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in out} == wanted
    assert any(r["n_base"] for r in out)


def test_licenses_find_changed_copies_and_leave_others(spark):
    rng = random.Random(5)
    text = licenses.TEXTS["mit-text"]
    words = list(licenses.template_words(text))
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "free", "of", "charge", "software"]) for _ in range(n))
    rows = []
    for i in range(30):
        copy = words[:]
        for _ in range(i % 12):  # up to 11 of 71 words changed, left out or put in
            at = rng.randrange(len(copy))
            how = rng.choice("cdi")
            copy[at : at + (how != "i")] = [] if how == "d" else ["other"]
        rows.append((i, f"{filler(rng.randrange(300))} {' '.join(copy)} {filler(50)}"))
    shuffled = words[:]
    rng.shuffle(shuffled)
    rows += [(90, " ".join(shuffled)), (91, " ".join(words[:40])), (92, filler(5000))]
    found = {r["doc_id"]: r["spans"] for r in licenses.scan(licensed_rows(spark, rows)).collect()}
    for i in range(30):
        (span,) = [s for s in found[i] if s["label"] == "mit-text"]
        assert span["similarity"] >= 0.8 and not span["phrase"]
        start = len(WORD.findall(rows[i][1].split(" permission")[0])) if i % 12 == 0 else None
        assert start is None or (span["start"], span["end"], span["similarity"]) == (start, start + len(words), 1.0)
    assert not any("mit-text" in [s["label"] for s in found[i]] for i in (90, 91, 92))


def test_licenses_spans_at_exactly_the_share(spark):
    """Every fifth word changed leaves one whole gram in five words: the fewest votes that a copy can have."""
    words = [f"w{i}" for i in range(50)]
    changed = [w if i % 5 != 4 else "x" for i, w in enumerate(words)]
    less = ["x" if i == 0 else w for i, w in enumerate(changed)]
    held = licenses.templates({}, {"own": " ".join(words)})
    out = licenses.scan(licensed_rows(spark, [(1, " ".join(changed)), (2, " ".join(less))]), held).collect()
    assert {r["doc_id"]: [(s["label"], s["start"], s["similarity"]) for s in r["spans"]] for r in out} == {1: [("own", 0, 0.8)], 2: []}


def test_licenses_without_templates_or_rows(spark):
    df = licensed_rows(spark, [(1, "mit license")])
    assert [tuple(r) for r in licenses.scan(df, []).collect()] == [(1, 2, [])]
    assert licenses.scan(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        licenses.templates({"mit": "m"}, {})
    clash = df.withColumn("digest", F.lit(1)).withColumn("words", F.lit("x")).withColumn("a.b", F.lit(2))
    assert [s["label"] for r in licenses.scan(clash).collect() for s in r["spans"]] == ["mit"]


def test_licenses_sql_on_changed_copies(spark, tmp_path):
    import duckdb

    text = licenses.TEXTS["bsd-text"] + " " + licenses.TEXTS["gpl-notice"]
    words = text.split()
    rows = [(i, " ".join(w for j, w in enumerate(words) if j % (i + 7) != 3)) for i in range(12)] + [(50, text + "\n" + text)]
    df = licensed_rows(spark, rows)
    out = license_rows(df, tmp_path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = db.execute(queries.ORACLES["op11_licenses"])
    columns = [c[0] for c in found.description]
    assert sorted(tuple(r[c] for c in columns) for r in out.collect()) == sorted(found.fetchall())


# periodic runs


def brute_runs(words):
    n, out, seen = len(words), [], set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q) and (i, j - i + q) not in seen:
                seen.add((i, j - i + q))
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_periodic(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    milli = 1000 * top[1] // top[2] if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


ROW = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_documents(spark, documents):  # noqa: F811
    out = sorted(tuple(r[c] for c in ROW) for r in queries.op12_periodic(spark, SF).collect())
    rows = [(i, t) for i, t in texts(documents) if len(t.split()) < 4000]
    wanted = {i: brute_periodic(i, t) for i, t in rows}
    assert len(out) == documents.count() and len(rows) > 150
    assert [r for r in out if r[0] in wanted] == sorted(wanted.values())
    assert sum(r[1] > 0 for r in out) > 10


def test_periodic_awkward(spark, awkward, tmp_path):  # noqa: F811
    more = [(i, t) for i, t in enumerate(["a " * 23, "a " * 24, "a\x0bb\x0cc " * 9, "a\xa0b " * 30, "x y " * 12 + "z " + "x y " * 12, "ab " * 300 + "q " + "ab c " * 200], 100)]
    planted = [(i, "one two three four five six seven eight nine ten " * (i % 7)) for i in range(1000, 1080)]
    df = awkward.select("doc_id", "text", F.lit(1).alias("runs"), F.lit(2).alias("a.b")).unionByName(spark.createDataFrame(more + planted, "doc_id long, text string"), allowMissingColumns=True)
    df = df.where("coalesce(doc_id, 0) <> 5")  # the long text is left to the test of long texts
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = [tuple(r[c] for c in ROW) for r in queries.op12_periodic(spark, str(tmp_path)).collect()]
    wanted = [brute_periodic(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(out, key=str) == sorted(wanted, key=str)
    assert queries.op12_periodic(spark, SF).where("false").collect() == []


def test_periodic_random_sequences():
    rng = random.Random(7)
    for _ in range(400):
        n, v = rng.randrange(600), rng.choice([1, 2, 3, 5, 50])
        words = [rng.randrange(v) for _ in range(n)]
        for _ in range(rng.randrange(5) if n > 30 else 0):
            a, p = rng.randrange(n), rng.randint(1, n // 4)
            for i in range(a, min(n, a + rng.randint(24, n))):
                words[i] = words[a + (i - a) % p]
        assert periodic.runs_of(*periodic.numbered([b"%d" % w for w in words])) == brute_runs(words)


@pytest.mark.parametrize("kind", ["same", "blocks", "text", "nested"])
def test_periodic_long_texts(kind):
    """200,000 words in a few seconds, whatever they are; runs known by construction."""
    rng, n = np.random.default_rng(3), 200_000
    ids = rng.integers(0, 5000, n)
    wanted = []
    if kind == "same":
        ids[:] = 0
        wanted = [(0, n, 1)]
    elif kind == "blocks":
        ids = np.arange(n) + 1
        for at in range(0, n - 50, 50):
            ids[at : at + 40] = 0
            wanted.append((at, 40, 1))
    elif kind == "nested":
        part = np.concatenate([np.resize(np.arange(7), 70), np.arange(10, 40)])
        ids = np.concatenate([np.arange(100_000) + 50, np.resize(part, 1000), np.arange(1000) + 900_000])
        wanted = [(100_000 + 100 * i, 70, 7) for i in range(10)] + [(100_000, 1000, 100)]
    dense = np.unique(ids, return_inverse=True)[1]
    assert periodic.runs_of(dense, int(dense.max()) + 1) == sorted(wanted, key=lambda r: (r[0], r[2]))


# whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute_whitening(rows, scale=64, shift=1_000_000):
    """Exact covariance in fractions, numpy's eigenvectors of it."""
    x = [[int(np.floor(scale * float(c))) + shift for c in v] for _, v in rows]
    n, dims = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(dims)]
    d = [[n * r[j] - sums[j] for j in range(dims)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in d), n**3)) for j in range(dims)] for i in range(dims)])
    return d, cov


@pytest.mark.parametrize("table", ["embeddings", "repeated"])
def test_whitening_against_fractions(spark, table):
    df = spark.read.parquet(f"{SF}/embeddings.parquet") if table == "embeddings" else vectors(spark, [(i // 2, [float((i * k) % 97) / 3 for k in range(1, 6)]) for i in range(300)])
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    out = whitening.whiten(df).collect()
    d, cov = brute_whitening(rows)
    values, found = np.linalg.eigh(cov)
    values, found = values[::-1][:32], found[:, ::-1][:, :32].T
    k = len(values)
    assert len(out) == len(rows) * k and {r["n"] for r in out} == {len(rows)}
    assert all(r["identity_error"] < 1e-12 for r in out)
    assert np.allclose(sorted({(r["component"], r["explained"]) for r in out}), [(i + 1, values[i] / np.trace(cov)) for i in range(k)], rtol=1e-13)
    wanted = np.array(d, float) @ found.T / len(rows) / np.sqrt(values)
    by_id = {}
    for r in out:
        by_id.setdefault((r["vec_id"], r["component"]), []).append((r["deviation"], r["whitened"]))
    sign = np.ones(k)
    for c in range(k):
        i = int(np.abs(wanted[:, c]).argmax())
        sign[c] = np.sign(wanted[i, c] * min(by_id[rows[i][0], c + 1], key=lambda v: abs(abs(v[1]) - abs(wanted[i, c])))[1])
    expected = {}
    for i, (key, _) in enumerate(rows):
        for c in range(k):
            expected.setdefault((key, c + 1), []).append((sum(v * v for v in d[i]), wanted[i, c] * sign[c]))
    for key, pairs in expected.items():
        for a, b in zip(sorted(pairs), sorted(by_id[key])):
            assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-10


def test_whitening_keeps_small_variances_beside_a_large_shift(spark):
    """Uncentred moments of a shift of 2^40 leave nothing of variances around 1; nor does n matter that doesn't divide the sums."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(a) / 64, float(b) / 64]) for i, (a, b) in enumerate(rng.integers(-3, 4, (701, 2)))]
    out = whitening.whiten(vectors(spark, rows), shift=2**40).collect()
    plain = whitening.whiten(vectors(spark, rows), shift=0).collect()
    key = lambda r: (r["vec_id"], r["component"])
    for a, b in zip(sorted(out, key=key), sorted(plain, key=key)):
        assert a["deviation"] == b["deviation"] and a["whitened"] == pytest.approx(b["whitened"], abs=1e-12)


def test_whitening_awkward(spark):
    good = [(i, [float(i % 3), float(i % 5), 7.0]) for i in range(15)]
    bad = [(20, None), (21, [1.0, None, 2.0]), (22, [float("nan"), 1.0, 1.0]), (23, [float("inf"), 1.0, 1.0]), (24, [1.0, 2.0]), (25, []), (26, [1e38, 0.0, 0.0]), (None, [1.0, 1.0, 7.0])]
    df = vectors(spark, good + bad).withColumn("n", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("vector", F.lit(2))
    out = whitening.whiten(df).collect()
    assert {r["component"] for r in out} == {1, 2} and {r["n"] for r in out} == {16}  # the constant dimension has no component
    assert {r["vec_id"] for r in out} == {*range(15), None}
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0]), (2, [2.0])]):
        empty = whitening.whiten(vectors(spark, rows))
        assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_of_long_sums_is_null(spark):
    out = whitening.whiten(vectors(spark, [(i, [float(2**38 * (i % 2)), float(i)]) for i in range(10)])).collect()
    assert all(r["deviation"] is None and np.isfinite(r["whitened"]) for r in out)


def test_slices_add_up_without_error():
    rng = np.random.default_rng(1)
    high, low = rng.normal(0, 20, 5000), rng.normal(0, 1e-16, 5000)
    a, b, c = whitening.slices(high, low, 7)
    assert all(Fraction(x) + Fraction(y) + Fraction(h) - Fraction(x) - Fraction(y) == Fraction(h) for x, y, h in zip(a, b, high))
    assert all(Fraction(float(x)) + Fraction(float(y)) + Fraction(float(z)) - Fraction(float(h)) - Fraction(float(e)) < Fraction(1, 2**80) for x, y, z, h, e in zip(a, b, c, high, low))
    total = (np.zeros((1, 1)), np.zeros((1, 1)))
    total = whitening.outer_sum(total, high[:2000, None], low[:2000, None], 7)
    exact = sum((Fraction(float(h)) + Fraction(float(e))) ** 2 for h, e in zip(high[:2000], low[:2000]))
    assert abs(Fraction(float(total[0][0, 0])) + Fraction(float(total[1][0, 0])) - exact) / exact < Fraction(1, 2**75)

