"""The corpus operators against brute force, on whole small tables and on awkward ones."""

from __future__ import annotations

import base64
import hashlib
import importlib
import itertools
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA, assert_same

P = pytest.importorskip("public_tokenizers")
pytest.importorskip("kinograph.llm")
from kinograph.llm import ann, bpe, langid, line_dedup, media, packing, quality, queries, sharding, simhash, url_filter  # noqa: E402

SF = str(DATA)
LONG = "lang und breit " * 20_000
AWKWARD = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (3, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (4, "the quick brown fox jumps over the lazy dog", None, "a"),
    (5, LONG, "de", "b"),
    (6, " \t\n  \r\n ", "", "b"),
    (7, "12 34 !! ²", "de", "b"),
    (8, "a line that is long enough to count\nshort\nA LINE that is long enough to count  ", "en", "a"),
    (9, "a line that is long enough to count", "en", "a"),
    (10, "\ta line that is long enough to count\x0b\n\n", "en", "a"),
    (None, "no number, äöü 中文 \U0001f600  two  spaces <|endoftext|>", "de", "b"),
    (12, " nicht ge trennt", "de", "b"),
    (13, "nul\x00", "de", "b"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(*r, "x", "y") for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string, Fp string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_oracles(spark):
    for name, sql in queries.ORACLES.items():
        assert_same(queries.QUERIES[name](spark, SF), sql)


def test_language_held_out_accuracy(spark):
    found = queries.op1_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(held) >= 20
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_language_awkward(spark, awkward):
    model = langid.fit(awkward)
    rows = langid.predict(awkward, model).collect()
    assert len(rows) == len(AWKWARD)
    found = {r["doc_id"]: r for r in rows}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1, 2, 6, 7))
    assert found[5]["lang_pred"] == "de" and 0 < found[5]["score"] <= 1
    assert all(r["lang_pred"] in ("en", "de", "und") for r in rows)
    assert langid.predict(awkward, langid.fit(awkward.limit(0))).where("lang_pred <> 'und'").isEmpty()
    strange = spark.createDataFrame([(1, "中文")], "doc_id long, text string")
    assert langid.predict(strange, model).first()["lang_pred"] in ("de", "en")


def brute_language(rows, least=4, languages=None):
    """rows (id, text, label or None) to a function from text to (language, score), counted in plain Python."""
    import math
    import unicodedata

    letters = lambda t: ["".join(g) for k, g in itertools.groupby(t.lower(), lambda c: unicodedata.category(c)[0] == "L") if k]
    words, grams = defaultdict(Counter), [defaultdict(Counter) for _ in range(5)]
    for _, text, label in rows:
        if label is not None and text is not None:
            words[label].update(letters(text))
    for label, counts in words.items():
        for word, n in counts.items():
            for k in range(1, 5):
                for i in range(len(word) + 3 - k):
                    grams[k][label][f"_{word}_"[i : i + k]] += n

    def logs(counts):
        kept = {l: {x: n for x, n in c.items() if n >= enough[l]} for l, c in counts.items() if l in enough}
        keys = set().union(*kept.values()) if kept else set()
        totals = {l: sum(kept.get(l, {}).values()) + len(keys) / 2 for l in names}
        return {x: [math.log((kept.get(l, {}).get(x, 0) + 0.5) / totals[l]) for l in names] for x in keys}

    names = sorted(l for l in words if words[l])
    enough = {l: least if max(n for k in range(1, 5) for x, n in grams[k][l].items() if x != "_") >= least else 1 for l in names}
    of_word, of_gram = logs(words), [logs(g) for g in grams]

    def of(word):
        if word in of_word:
            return of_word[word]
        for k in range(4, 0, -1):
            parts = list(word) if k == 1 else [f"_{word}_"[i : i + k] for i in range(len(word) + 3 - k)]
            if hits := [of_gram[k][x] for x in parts if x in of_gram[k]]:
                return [sum(c) / len(hits) for c in zip(*hits)]
        return [0.0] * len(names)

    def predict(text):
        found = [of(w) for w in letters(text or "")]
        if not found:
            return "und", 0.0
        sums = [sum(c) for c in zip(*found)]
        return names[sums.index(max(sums))], 1 / sum(math.exp(max(x - max(sums), -700)) for x in sums)

    return predict


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_language_against_brute_force(request, which):
    docs = request.getfixturevalue(which)
    train = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect() if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5]
    predict = brute_language(train)
    for r in langid.predict(docs.drop("score"), langid.fit(docs.where(~langid.held_out("doc_id")))).collect():
        lang, score = predict(r["text"])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-6)


def test_language_with_few_rows_is_learned(spark):
    """Nothing of a short sample is met four times: it counts from once on then."""
    rows = [(i, "the quick brown fox and the lazy dog by the old mill", "en") for i in range(20)] + [(90, "zwölf kühe", "de"), (91, "123", "xx")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    assert [langid.Scorer(model)(t)[0] for t in ("zwölf kühe", "the fox", "kühen")] == ["de", "en", "de"]


def test_language_model_of_many_languages_is_sparse(spark):
    """Entries are (key, language) pairs that met, not keys times languages; a model too large says so before it is brought."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 200).alias("lang"), F.expr("array_join(transform(sequence(1, 60), i -> translate(concat('w', id % 200, 'x', i), '0123456789', 'abcdefghij')), ' ')").alias("text"))
    model = langid.fit(docs, least=4)
    assert len(model.languages) == 200 and len(model.words.keys) == 200 * 60 and model.words.floor.shape == (200,)
    assert model.bytes() < 40 * (len(model.words.logs) + sum(len(g.logs) for g in model.grams))
    assert sum(r["lang"] == r["lang_pred"] for r in langid.predict(docs, model).collect()) == 2000
    with pytest.raises(ValueError, match="most_bytes"):
        langid.fit(docs, most_bytes=100_000)


def test_language_never_reads_labels(spark, documents):
    model = langid.fit(documents.where(~langid.held_out("doc_id")))
    other = documents.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.lit(0))
    same = Counter((r["text"], r["lang_pred"]) for r in langid.predict(documents, model).collect())
    assert same == Counter((r["text"], r["lang_pred"]) for r in langid.predict(other, model).collect())


def ids_of(text: str) -> list[int]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return [*t.encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("which", ["documents", "awkward", "empty"])
def test_packing(request, which):
    docs = request.getfixturevalue("documents") if which == "documents" else request.getfixturevalue("awkward").limit(0 if which == "empty" else 99)
    pieces = packing.pack(docs, queries.vocabulary("byte_bpe_50k.json").decode()).collect()
    want = defaultdict(list)
    for i, text in texts(docs):
        want[i].append(ids_of(text))
    have = defaultdict(lambda: defaultdict(int))
    for p in pieces:
        assert 1 <= p["length"] <= 1024
        ids = want[p["doc_id"]][0][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) and p["doc_tokens"] == len(want[p["doc_id"]][0])
        have[p["doc_id"]][p["start"]] += 1
    assert all(sum(p["length"] for p in pieces if p["doc_id"] == i) == sum(map(len, w)) for i, w in want.items())
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    if which == "documents":
        total = sum(p["length"] for p in pieces)
        assert len(by_sequence) <= -(-total // 1024) * 1.02 + 1


def test_special_strings_are_what_the_tokenizer_makes_of_them(spark):
    """Without special tokens being added, a special token's own string in a text still is that token."""
    from kinograph.llm.tokens import Encoder

    encoder = Encoder(queries.vocabulary("byte_bpe_50k.json").decode())
    assert encoder.special
    held = [f"{a}{s}{b}" for s in encoder.special for a in ("", "one two ", "x") for b in ("", " three", "y  z")]
    held += [s[:-1] for s in encoder.special] + [" ".join(s) for s in encoder.special]
    assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in encoder.encode(held)] == [ids_of(t)[:-1] for t in held]
    assert any(encoder.tokenizer.token_to_id(s) in ids_of(f"one {s}") for s in encoder.special)


@pytest.mark.parametrize("seed", range(6))
def test_pieces_are_cut_where_the_tokenizer_cuts(seed):
    """Texts of all kinds of neighbours, at either end and side by side, give the ids of the tokenizer by itself."""
    from kinograph.llm.tokens import Encoder
    from tokenizers import Tokenizer

    alone = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encoder = Encoder(queries.vocabulary("byte_bpe_50k.json").decode())
    rng = random.Random(seed)
    signs = list("abZ019.,;-'$%  \n\n\t\r") + ["'s", "'ll", " the", "\x00", "\x0b", "\x1c", "\x85", "\xa0", "\xb5", "\xd7", "\xf7", "\xdf", "\xe9", "\u0130", "\u01c0", "\u0301", "\u0416", "\u0482", "\u0660", "\u2003", "\u2026", "\u3000", "\u4e2d", "\U0001f600", "<|endoftext|>", "<|endof", "text|>"]
    some = ["".join(rng.choices(signs, k=rng.randrange(0, 14))) for _ in range(3000)] + [None, "", "\u00e9", " ", "  ", "x"]
    rng.shuffle(some)
    for at in (0, 1500):  # the second half meets what the first left in the memo
        ids, upto = encoder.encode_array(pa.array(["cut off", *some], pa.string())[1 + at :])
        assert [ids[a:b].tolist() for a, b in zip(upto, upto[1:])] == [alone.encode(t or "", add_special_tokens=False).ids for t in some[at:]]


def test_a_word_is_learned_once_whatever_stands_behind_it():
    from kinograph.llm.tokens import Encoder

    encoder = Encoder(queries.vocabulary("byte_bpe_50k.json").decode())
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}{mark}" for i in range(200) for mark in ("", ",", ".", "!?", ".\nNext", "***", ":1")]
    assert encoder.encode([" ".join(words)]) == [struct.pack(f"<{len(x)}I", *x) for x in [ids_of(" ".join(words))[:-1]]]
    assert len(encoder.memo) < 250  # 200 words and some signs, not 1,400 pairs


def test_packed_sequences_hold_the_ids(spark, documents):
    some = documents.where("doc_id < 40")
    rows = packing.sequences(some, queries.vocabulary("byte_bpe_50k.json").decode()).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in rows)
    want = Counter(x for _, t in texts(some) for x in ids_of(t))
    assert Counter(x for r in rows for x in struct.unpack(f"<{r['n_tokens']}I", r["ids"])) == want


def test_fullest_window_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = Counter(rng.integers(1, 30, 8).tolist())
        taken = packing.fullest_window(lengths, 40)
        assert all(n <= lengths[k] for k, n in taken.items()) and taken[max(lengths)] >= 1
        rest = list((lengths - Counter([max(lengths)])).elements())
        best = max(s for n in range(len(rest) + 1) for c in itertools.combinations(rest, n) if (s := sum(c) + max(lengths)) <= 40)
        assert sum(k * n for k, n in taken.items()) == best


def test_quality_keeps_good(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in queries.op3_quality(spark, SF).collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert len(kept & good) >= 0.97 * len(good)
    assert len(kept & bad) <= 0.6 * len(bad)


def brute_quality(rows, labels, margin=0.01):
    """Log weight of every row's text, and the number of rows to draw."""
    import re

    kind = {}
    for i, q in labels:
        if q is not None and i is not None:
            kind[i] = min(kind.get(i, True), q > 0)
    raw, target, grams = Counter(), Counter(), []
    for i, text in rows:
        ids = [zlib.crc32(t.encode()) for t in re.findall(r"\w+|[^\w\s]+", text.lower())]
        grams.append([t % 16384 for t in ids] + [(a * 1_000_003 + b * 7) % 16384 for a, b in zip(ids, ids[1:])])
        raw.update(grams[-1])
        if kind.get(i):
            target.update(grams[-1])
    n_raw, n_target = raw.total() + 8192, target.total() + 8192
    ratio = [np.log((target[b] + 0.5) / n_target) - np.log((raw[b] + 0.5) / n_raw) for b in range(16384)]
    good, bad = (sum(kind.get(i) is k for i, _ in rows) for k in (True, False))
    share = min(1, good / (good + bad) + margin) if good and bad else 1
    return [sum(ratio[g] for g in gs) for gs in grams], int(np.ceil(share * len(rows)))


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_quality_against_brute_force(spark, request, which):
    docs = request.getfixturevalue(which)
    labels = spark.read.parquet(f"{SF}/labels.parquet") if which == "documents" else spark.createDataFrame([(3, 1), (5, 0), (None, 1), (9, None), (8, 1), (8, 0)], "doc_id long, quality int")
    weights, k = brute_quality(texts(docs), [(r["doc_id"], r["quality"]) for r in labels.collect()])
    noise = dict(docs.select("doc_id", quality.gumbel(3, "doc_id").alias("g")).collect())
    keys = sorted(((w + noise[i], str(i), w) for w, (i, _) in zip(weights, texts(docs))), reverse=True)
    want = [x for x in keys if x[0] >= keys[k - 1][0] - 1e-9]
    have = sorted(((r["key"], str(r["doc_id"]), r["log_weight"]) for r in quality.resample(docs, labels).collect()), reverse=True)
    assert [x[1] for x in have] == [x[1] for x in want] and np.allclose([x[::2] for x in have], [x[::2] for x in want])
    spread = np.random.default_rng(1).permutation([float(x) for x in noise.values()])
    assert which == "awkward" or (abs(spread.mean() - 0.577) < 0.3 and abs(spread.std() - 1.283) < 0.3)


def test_quality_awkward(spark, awkward):
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (9, None)], "doc_id long, quality int")
    out = quality.resample(awkward, labels)
    assert {"log_weight", "key", "text"} <= set(out.columns)
    assert quality.resample(awkward, labels.limit(0)).count() == len(AWKWARD)
    assert quality.resample(awkward.limit(0), labels).isEmpty()
    assert quality.resample(awkward.limit(0), labels.limit(0), keep_share=0.5).isEmpty()
    half = quality.resample(awkward.withColumn("KEY", F.lit("x")), labels, keep_share=0.5)
    assert 7 <= half.count() <= 8 and dict(half.dtypes)["key"] == "double"  # one more where a repeated row ties with the last


def brute_nearest(rows: list[tuple[int, list]], k: int = 10) -> dict[int, list[int]]:
    ids, vecs = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((vecs - vecs[q]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        out[int(ids[q])] = [(int(ids[i]), d[i]) for i in order if ids[i] != ids[q]][:k]
    return out


def test_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    vecs = rng.standard_normal((6000, 64))
    vecs[3000:3600] = vecs[3000]  # a vector that a tenth of the rows share
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(vecs.astype(np.float32))]
    want = brute_nearest(rows)
    found = defaultdict(list)
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 100 == 0).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert found.keys() == want.keys() and all(sorted(x[0] for x in v) == list(range(1, 11)) for v in found.values())
    exact = {q: dict(v) for q, v in want.items()}
    hits = sum(v in exact[q] for q, f in found.items() for _, v, _ in f)
    assert hits >= 0.9 * 10 * len(want)
    assert [v for _, v, _ in sorted(found[3000])] == [v for v, _ in want[3000]]
    assert all(abs(s - exact[q][v]) < 1e-12 for q, f in found.items() for _, v, s in f if v in exact[q])


def test_neighbours_visit_enough_buckets_of_large_tables(spark):
    """At the width of a large table, the most promising buckets still hold a neighbour with the wanted probability."""
    rng = np.random.default_rng(11)
    vecs = rng.standard_normal((500, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs / np.linalg.norm(vecs, axis=1, keepdims=True))], "id long, vec array<double>")
    n = 1 << 31
    hashing = ann.fit(df, 64, n, sample_rows=n)
    _, along = hashing.codes(np.array([r["vec"] for r in df.orderBy("id").limit(60).collect()]))
    mass = np.array([[hashing.ranked(a[t], t)[0].sum() for t in range(hashing.tables)] for a in along])
    assert (mass >= hashing.success).all(axis=1).mean() > 0.9
    for a, m in zip(along, mass):
        assert (sum(map(len, hashing.probes(a))) > 0) == bool((m >= hashing.success).all())


def test_neighbours_are_searched_exactly_where_buckets_fall_short(spark):
    rng = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3000, 32)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in ann.search(df, F.col("id") % 100 == 0, success=0.99999).orderBy("rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    assert found == {q: [v for v, _ in near] for q, near in brute_nearest(rows).items()}


def test_neighbours_awkward(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (100, [3.0, 4.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(df, F.col("id") % 100 == 0).collect()}
    assert found[(0, 1)] == (1, 0.0) and found[(0, 2)][0] == 2 and found[(0, 3)][0] == 100
    assert [found[(100, i)][0] for i in (1, 2, 3)] == [2, 0, 1] and len(found) == 6
    assert ann.search(df.limit(0), F.col("id") % 100 == 0).isEmpty()


def test_lines_awkward(spark, awkward):
    found = {r["doc_id"]: r for r in line_dedup.drop_frequent_lines(awkward).collect()}
    assert [found[i]["n_dropped"] for i in (8, 9, 10)] == [2, 1, 0] and found[8]["kept_text"] == "short"
    assert found[1]["kept_text"] == "" and found[1]["n_lines"] == 1 and found[6]["n_lines"] == 3
    assert found[10]["kept_text"] == AWKWARD[10][1]
    assert line_dedup.drop_frequent_lines(awkward.limit(0)).isEmpty()


def brute_lines(rows):
    """(id, text) rows to (id, kept text), dropping as the contract says."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: (i is not None, i)
    holders = defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            holders[k].append(i)
    keeper = {k: max(v, key=order) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    return [(i, "\n".join(x for x in t.split("\n") if key(x) not in keeper or keeper[key(x)] == i)) for i, t in rows]


@pytest.mark.parametrize("n_batches", [1, 2, 6])
def test_lines_against_brute_force(spark, n_batches):
    """Ids from end to end of their type, repeated and null ids, lines that repeat within a document."""
    rng = np.random.default_rng(1)
    ids = [0, 1, 2, 2, 3, None, None, -5, 2**62 - 1, 2**63 - 1, -(2**63), *rng.integers(-(2**63), 2**63 - 1, 30).tolist()]
    rows = [(i, "\n".join(["Some line that is long enough %d" % x if x < 8 else "short" if x == 8 else "" for x in rng.integers(0, 10, n)])) for n, i in enumerate(ids)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ha string")
    have = [(r["doc_id"], r["kept_text"]) for r in line_dedup.drop_frequent_lines(docs, n_batches=n_batches).collect()]
    assert sorted(have, key=repr) == sorted(brute_lines(rows), key=repr)
    assert sum(a != b for a, b in zip(sorted(have, key=repr), sorted(rows, key=repr))) > 5
    wide = spark.createDataFrame([(i, "one line that three documents share") for i in (0, 1, 2**62 - 1)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_frequent_lines(wide).collect()} == {0: 1, 1: 1, 2**62 - 1: 0}


def test_line_runs_stay_dealt_and_sorted(spark):
    """Anti-joins and compactions of runs exchange and sort nothing."""
    docs = spark.createDataFrame([(i, f"line number {i % 7} is long enough") for i in range(50)], "id long, text string")
    index = line_dedup.LineRuns(fanout=5)
    for part in range(2):
        index.add(line_dedup.summarise(line_dedup.occurrences(docs.where(f"id % 2 = {part}"), "id", "text", 20)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(line_dedup.merge(index.runs())) and not {"Exchange", "Sort ["} & {x for x in ("Exchange", "Sort [") if x in plan(index.unseen(index.runs()[0]))}
    assert {r["n_docs"] for r in index.compacted().collect()} == {7, 8}


def test_line_runs_awkward(spark, awkward):
    index = line_dedup.LineRuns(fanout=2)
    first = index.ingest(awkward.select("doc_id", "text"), "doc_id", "text").collect()
    assert Counter(map(tuple, first)) == Counter((i, t or "") for i, t, *_ in AWKWARD)  # lines repeated within a batch stay
    again = index.ingest(awkward.select("doc_id", "text"), "doc_id", "text")
    assert again.where("length(text) > 60").count() == 0 and again.count() == len(AWKWARD)
    assert index.ingest(awkward.select("doc_id", "text").limit(0), "doc_id", "text").isEmpty()


def test_line_runs_first_come_first_kept(spark):
    line = "a line that is long enough {}".format
    index = line_dedup.LineRuns(fanout=2)
    kept = []
    for b in range(5):
        batch = spark.createDataFrame([(b, "\n".join([line(b), line(b - 1), "x"]))], "id long, text string")
        kept += [r["text"] for r in index.ingest(batch, "id", "text").collect()]
    assert kept == ["\n".join([line(0), line(-1), "x"]), *["\n".join([line(b), "x"]) for b in range(1, 5)]]
    assert index.compacted().count() == 6 and len(index.runs()) <= 3


def test_urls(spark):
    entries = spark.createDataFrame([("spam", "Bad.com", "add", 10), ("spam", "bad.com", "remove", 20), ("spam", "bad.com", "add", 30), ("adult", "x.bad.com", "add", 0), ("adult", "x.bad.com", "add", 0), (None, "y.com", "add", 0)], "list string, host string, action string, at int")
    rows = [(1, "http://bad.com/a", 9), (2, "http://u@BAD.com.:80/a", 10), (3, "https://a.bad.com", 19), (4, "http://bad.com", 20), (5, "http://x.bad.com", 31), (6, None, 5), (7, "nonsense", 5), (8, "http://notbad.com", 15), (9, "http://bad.com", None)]
    captures = spark.createDataFrame([(*r, "old") for r in rows], "id long, url string, day int, lists string")
    found = {r["id"]: r for r in url_filter.judge(captures, entries, "id", "url", "day").collect()}
    assert {i for i, r in found.items() if r["blocked"]} == {2, 3, 5} and len(found) == 9
    assert found[5]["lists"] == "adult,spam" and found[5]["matched"] == "x.bad.com" and found[4]["lists"] == ""
    assert url_filter.judge(captures.limit(0), entries, "id", "url", "day").isEmpty()
    assert url_filter.judge(captures, entries.limit(0), "id", "url", "day").where("blocked").isEmpty()


@pytest.mark.parametrize("which", ["documents", "awkward", "empty"])
def test_bpe(request, which):
    import tiktoken

    docs = request.getfixturevalue("documents") if which == "documents" else request.getfixturevalue("awkward").limit(0 if which == "empty" else 99)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(i), coder.encode_ordinary(t), t.encode()) for i, t in texts(docs))
    rows = bpe.encode_decode(docs, queries.vocabulary("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert sorted((str(r["doc_id"]), list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"])), bytes(r["decoded"])) for r in rows) == want


def brute_simhash(rows):
    import xxhash

    prints = []
    for i, text in rows:
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate(dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if w]
        shingles = [" ".join(words[j : j + 3]) for j in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0))
    group = list(range(len(prints)))
    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 2 and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    smallest = defaultdict(lambda: None)
    for (i, _), g in zip(prints, group):
        smallest[g] = i if smallest[g] is None else min(smallest[g], i if i is not None else smallest[g])
    return sorted((str(i), f"{fp:016x}", smallest[g]) for (i, fp), g in zip(prints, group))


def test_simhash_brute_force(spark, documents, awkward):
    for docs in (documents, awkward):
        small = docs
        rows = simhash.group(small).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fp"), "component_id").collect()
        assert sorted((str(r["doc_id"]), r["fp"], r["component_id"]) for r in rows) == brute_simhash(texts(small))
    assert simhash.group(awkward.limit(0)).isEmpty()


def test_simhash_chains_of_fingerprints(spark):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 60, dtype=np.int64).tolist()
    for start in fps[:6]:
        for step in range(12):  # chains: two bits a step
            start ^= 3 << 2 * step
            fps.append(start)
    fps = list(dict.fromkeys(fps))
    links = simhash.compare(simhash.replicate(spark.createDataFrame([(x,) for x in fps], "fp long"), 2), 2)
    label = {r["node"]: r["label"] for r in simhash.components(links).collect()}
    group = {x: {x} for x in fps}
    for a, b in itertools.combinations(fps, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    assert all(label.get(x, x) == min(group[x]) for x in fps)


def test_simhash_keeps_one_of_each_group(spark, awkward):
    kept = simhash.keep_first(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({str(r["component_id"]) for r in simhash.group(awkward).collect()})


@pytest.mark.parametrize("which", ["documents", "awkward", "empty"])
def test_sharding(request, which):
    docs = request.getfixturevalue("documents") if which == "documents" else request.getfixturevalue("awkward").limit(0 if which == "empty" else 99)
    rows = sharding.shard_rows(docs, 40, 20).collect()
    want = sorted((str(i), len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts(docs))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values())
    sizes = [len(shards[i]) for i in range(40)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    if which == "documents":
        share = Counter(r["source"] for r in rows)
        for s in shards.values():
            assert all(abs(n - len(s) * share[k] / len(rows)) < 2 for k, n in Counter(r["source"] for r in s).items())


def grey_samples(png: bytes) -> bytes:
    """The samples of an 8-bit grey PNG, read by the format's rules alone: chunks, checksums, row filters 0 to 4."""
    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, width, height = 8, b"", 0, 0
    while at < len(png):
        size = int.from_bytes(png[at : at + 4], "big")
        name, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        assert zlib.crc32(name + body) == int.from_bytes(png[at + 8 + size : at + 12 + size], "big")
        if name == b"IHDR":
            width, height, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            assert (depth, colour, rest) == (8, 0, [0, 0, 0])
        data += body if name == b"IDAT" else b""
        at += 12 + size
    raw, rows, before = zlib.decompress(data), [], bytes(width)
    assert len(raw) == height * (width + 1)
    for y in range(height):
        kind, line, row = raw[y * (width + 1)], raw[y * (width + 1) + 1 : (y + 1) * (width + 1)], bytearray()
        for x, v in enumerate(line):
            left, up, corner = (row[x - 1] if x else 0), before[x], (before[x - 1] if x else 0)
            near = min((left, up, corner), key=lambda c: abs(left + up - corner - c))
            row.append((v + (0, left, up, (left + up) // 2, near)[kind]) % 256)
        rows.append(bytes(row))
        before = rows[-1]
    return b"".join(rows)


def plain_features(data: bytes) -> str:
    counts = Counter(data)
    mode = min(counts, key=lambda v: (-counts[v], v))
    return f"64x{len(data) // 64} min={min(data)} max={max(data)} mean_milli={sum(data) * 1000 // len(data)} levels={len(counts)} mode={mode}"


def place_in_page(text: str) -> tuple:
    """The figure's position and caption: a paragraph a line, blank ones none, the figure after half of them."""
    lines = text.split("\n")
    before = lines[: len(lines) // 2]
    caption = " ".join(before[-1].split()) if before else ""
    return sum(bool(x.split()) for x in before), caption or None


@pytest.mark.parametrize("which", ["documents", "awkward", "empty", "markup"])
def test_media_round_trip(spark, request, which):
    if which == "markup":
        names = ['<img src="x">', "a&amp;b", "</figure>", "sha256:00", None, ""]
        docs = spark.createDataFrame([(n, t) for n in names for t in ("<p>one</p>\n<img src='y'> & &lt;\n<script>x\nz", "]]> <!-- \n -->", "a\n\n \nb\nc\nd")], "doc_id string, text string")
    else:
        docs = request.getfixturevalue("documents") if which == "documents" else request.getfixturevalue("awkward").limit(0 if which == "empty" else 99)
    want = []
    for i, t in texts(docs):
        raw = t.encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.store(padded)
        assert media.restore(stored) == padded
        if len(padded) < 20_000:
            assert grey_samples(stored) == padded
        want.append((str(i), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), plain_features(padded), *place_in_page(t)))
    rows = media.media_features(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption").collect()
    assert sorted(((str(r[0]), *r[1:]) for r in rows), key=str) == sorted(want, key=str)


def test_media_damage_is_noticed():
    stored = bytearray(media.store(bytes(64)))
    stored[45] ^= 1
    with pytest.raises(Exception):
        media.restore(bytes(stored))


def test_media_sequences(spark):
    html = '<p>One <b>two</b> &amp; three</p><script>no</script><figure><img src="sha256:AB" alt="x"><figcaption>The <i>cap</i></figcaption></figure>tail<img src="http://e/f.png" alt="alt"><video src=sha256:cd></video><figure><img src="sha256:ee"><figcaption>open'
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (1, html)], "id long, html string")
    store = spark.createDataFrame([("ab", 7)], "digest string, size int")
    items = [tuple(x)[:5] for x in pages.select(media.sequences(F.col("html"))).first()[0]]
    assert items == [
        (0, "text", "One two & three", None, None),
        (1, "media", None, "ab", "The cap"),
        (2, "text", "tail", None, None),
        (3, "media", None, None, "alt"),
        (4, "media", None, "cd", None),
        (5, "media", None, "ee", "open"),
    ]
    rows = media.resolve(pages, store, "id", "html").collect()
    assert Counter(r["size"] for r in rows) == {7: 2, None: 10}
    whole = media.interleave(pages, store, "id", "html").collect()
    assert [r["id"] for r in whole] == [1, 1]  # repeated pages each keep their sequence
    assert all([(x["position"], x["size"]) for x in r["items"]] == [(0, None), (1, 7), (2, None), (3, None), (4, None), (5, None)] for r in whole)


def test_media_pages_against_an_independent_parser(spark):
    """Texts and references of every page, in order, by regular expressions over its markup."""
    import html
    import re

    have = defaultdict(list)
    for r in queries.media_pages(spark, SF).orderBy("page_id", "position").collect():
        have[r["page_id"]].append(r)
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.sub(r"(?is)<(script|style|template|noscript)\b.*?</\1\s*>", "", re.sub(r"(?s)<!--.*?-->|<!doctype[^>]*>", "", r["html"], flags=re.I))
        words = " ".join(html.unescape(re.sub(r"(?is)</?(?:a|abbr|b|code|em|i|mark|s|small|span|strong|sub|sup|u)\b[^>]*>", "", body).replace("\x00", "")).split())
        text = " ".join(" ".join(re.sub(r"(?s)<[^>]*>", " ", words).split()).split())
        items = have.pop(r["page_id"], [])
        assert " ".join(" ".join(x["text"] or x["caption"] or "" for x in items if x["kind"] == "text").split()) == text
        assert [x["src"] for x in items if x["kind"] == "media"] == [html.unescape(m) for m in re.findall(r"""(?is)<(?:img|video|audio|source|embed)\b[^>]*?\ssrc=["']?([^"'\s>]+)""", body)]
        assert [x["position"] for x in items] == list(range(len(items)))
        for x in (x for x in items if x["kind"] == "media"):
            raw = x["src"].encode()
            assert x["payload_sha256"] == hashlib.sha256(raw + bytes(-len(raw) % 64)).hexdigest()
    assert not have


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 1500, "abracadabra" * 300, "".join("etaoinshr"[i * i % 9] for i in range(3000)), "x" + "é" * 700 + "中文" * 300])
def test_bpe_of_long_pre_tokens(text):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    (ids, decoded), short = bpe.TextCoder(ranks, P.PATTERN).encode([text, "short"])
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == coder.encode_ordinary(text) and decoded == text.encode() and short[1] == b"short"


def test_bpe_of_many_long_words():
    """Random words over small alphabets, where neighbouring merges compete."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list(letters), rng.integers(64, 200))) for letters in ("ab", "aab", "etaoin", "abcdefghijklmnopqrstuvwxyz") for _ in range(40)]
    for word, (ids, _) in zip(words, bpe.WordCoder(ranks).encode([w.encode() for w in words])):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == coder.encode_ordinary(word)


@pytest.mark.parametrize("seed", range(4))
def test_bpe_of_all_kinds_of_neighbours(seed):
    """Texts side by side, cut as arrays, give the ids of tiktoken, also where the memo has to start afresh."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(seed)
    signs = list("abZ019.,;-'$%  \n\n\t\r") + ["'s", "'ll", " the", " Thand", "\x00", "\x0b", "\x85", "\xa0", "\xb5", "\xd7", "\xf7", "\xdf", "\xe9", "\u0130", "\u01c0", "\u0301", "\u0416", "\u0482", "\u0660", "\u2003", "\u2026", "\u3000", "\u4e2d", "\U0001f600", "x" * 70]
    some = ["".join(rng.choices(signs, k=rng.randrange(0, 14))) for _ in range(1000)] + [None, "", "\u00e9", " ", "  ", "x"]
    rng.shuffle(some)
    coder = bpe.TextCoder(ranks, P.PATTERN)
    for most in (None, 1000):  # the second time the memo starts afresh
        coder.memo.most = most or coder.memo.most
        for at in (0, 500):
            ids, decoded = coder.encode_array(pa.array(["cut off", *some], pa.string())[1 + at :])
            assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in ids.to_pylist()] == [own.encode_ordinary(t or "") for t in some[at:]]
            assert decoded.to_pylist() == [(t or "").encode() for t in some[at:]]
    for none in ([], [None], ["", None]):
        assert [x.to_pylist() for x in coder.encode_array(pa.array(none, pa.string()))] == [[b""] * len(none)] * 2
    assert bpe.TextCoder(ranks, r"\S+").encode(["one  two", "one"])[0][1] == b"onetwo"  # another pattern: what it leaves out has no ids


def test_bpe_looks_at_a_piece_once():
    """Only what differs goes through the pattern, and many texts' words through one recursive query."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    coder = bpe.TextCoder(ranks, P.PATTERN)
    split, contract, seen, calls = coder.split, coder.words._contract, [], []
    coder.split = lambda text: seen.append(len(text)) or split(text)
    coder.words._contract = lambda *a: calls.append(a) or contract(*a)
    some = [f"Words w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} and others, again and again.\n" for i in range(2000)]
    assert [x[1] for x in coder.encode(some)] == [t.encode() for t in some]
    assert sum(seen) < 100 and len(calls) == 1


@pytest.mark.parametrize("which", ["documents", "awkward"])
def test_sharding_order_against_brute_force(request, which):
    """The law's order itself: seeded digests within a source, then fractional ranks."""
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["source"]) for r in docs.collect()]
    digest = lambda i: hashlib.md5(f"20:{'null' if i is None else i}".encode()).hexdigest()
    by_source = defaultdict(list)
    for i, source in rows:
        by_source["s-null" if source is None else f"s{source}"].append(i)
    places = []
    for name, ids in by_source.items():
        ids.sort(key=lambda i: (digest(i), i is not None, i))
        places += [((k + 0.5) / len(ids), name, digest(i), i) for k, i in enumerate(ids)]
    places.sort(key=lambda p: p[:3])
    want = []
    for at, (_, _, _, i) in enumerate(places):
        shard = at * 40 // len(places)
        want.append((str(i), shard, at - -(-shard * len(places) // 40)))
    have = [(str(r["doc_id"]), r["shard"], r["slot"]) for r in sharding.shard_rows(docs, 40, 20).collect()]
    assert sorted(have) == sorted(want)


def shingles_of(text, words=5):
    w = text.encode().lower().split()
    return {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()


def brute_similar(rows, similarity=0.8):
    sets = {i: shingles_of(t) for i, t in rows if i is not None}
    text = dict(rows)
    first = {}
    for i in sorted(sets):
        first.setdefault(text[i], i)
    pairs = ((a, b) for a, b in itertools.combinations(sorted(first.values()), 2) if sets[a] and sets[b])
    return {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def brute_groups(rows):
    """Smallest id of the group of each id, by fingerprints and similar texts."""
    top = {int(i): c for i, _, c in brute_simhash(rows)}
    for a, b in brute_similar(rows):
        lo, hi = sorted((top[a], top[b]))
        top = {i: lo if c == hi else c for i, c in top.items()}
    return top


def edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(out)


def test_similar_texts_against_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = []
    for family in range(30):
        words = [f"w{x}" for x in rng.integers(0, 400, 150 + 20 * family)]
        rows += [(len(rows) + j, edited(rng, words, n)) for j, n in enumerate((0, 0, 1, 2, 3, 12, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, have = brute_similar(rows), {(r["a"], r["b"]) for r in simhash.similar(docs).collect()}
    assert have <= want
    top = brute_groups(rows)
    kept = {r["doc_id"] for r in simhash.keep_first(docs, similarity=0.8).collect()}
    assert kept == set(top.values())
    assert len(kept) < len({c for _, _, c in brute_simhash(rows)})


def test_similar_texts_of_a_large_family(spark):
    """More texts at an anchor than are compared pair by pair: its forest still joins them."""
    rng = np.random.default_rng(7)
    words = [f"w{x}" for x in rng.integers(0, 400, 600)]
    rows = [(i, edited(rng, words, 2)) for i in range(300)] + [(1000, " ".join(f"v{x}" for x in rng.integers(0, 400, 600)))]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.8)
    assert {r["doc_id"] for r in kept.collect()} == {0, 1000}


def test_similar_texts_whose_forest_is_rejected(spark):
    """At a crowded anchor the closest signatures can have too little in common, and further ones enough: every close pair decides."""
    rng = np.random.default_rng(8)
    rows = []
    for family in range(4):
        words = [f"w{x}" for x in rng.integers(0, 400, 120)]
        rows += [(len(rows) + j, edited(rng, words, 1 + j % 4)) for j in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, have = brute_similar(rows), {(r["a"], r["b"]) for r in simhash.similar(docs).collect()}
    assert have <= want
    top = lambda links: {frozenset(g) for g in groups_of(links)}
    assert top(have) == top(want)


def groups_of(links):
    of = {i: {i} for pair in links for i in pair}
    for a, b in links:
        if of[a] is not of[b]:
            of[a] |= of[b]
            for i in of[b]:
                of[i] = of[a]
    return of.values()


@pytest.mark.parametrize("n", [17, 60])
def test_an_anchor_meets_every_close_pair(n):
    rng = np.random.default_rng(n)
    sig = rng.integers(0, 1 << 63, 1).astype(np.uint64) ^ np.array([1 << rng.integers(63) | 1 << rng.integers(63) for _ in range(n)], np.uint64)
    pairs, more = simhash.nearest_pairs(np.arange(n), sig)
    d = np.bitwise_count(sig[:, None] ^ sig[None, :]) + 99 * np.eye(n, dtype=int)
    assert more and set(pairs.ravel().tolist()) == set(range(n)) and len(pairs) < n
    assert all(d[i, j] == d[i].min() or d[i, j] == d[j].min() for i, j in pairs)
    some = np.sort(rng.permutation(n)[: n - 1])  # without one row, the others keep their nearest
    fewer, _ = simhash.nearest_pairs(some, sig[some])
    edges = lambda pairs, ids: {tuple(sorted((int(ids[a]), int(ids[b])))) for a, b in pairs}
    gone = set(range(n)) - set(some.tolist())
    assert {e for e in edges(pairs, np.arange(n)) if not gone & set(e)} <= edges(fewer, some)
    all_of = lambda label, sketches: sorted(map(tuple, simhash.pairs_between(sig, label, sketches).tolist()))
    none = [b""] * n
    assert all_of(np.arange(n), none) == list(itertools.combinations(range(n), 2))
    assert all_of(np.arange(n) % 2, none) == [(i, j) for i, j in itertools.combinations(range(n), 2) if (j - i) % 2]
    assert not all_of(np.zeros(n, int), none)
    far = [bytes([255 * (i < 3)] * 512) for i in range(n)]
    assert all_of(np.arange(n), far) == [(i, j) for i, j in itertools.combinations(range(n), 2) if (i < 3) == (j < 3)]


def test_sketches_rule_out_no_similar_pair(spark):
    """Small sets are judged exactly, sizes bound the rest, sketches stay within their margin; pairs of both kinds pass on."""
    rng = np.random.default_rng(8)
    sets = []
    for size in (1, 5, 30, 62, 63, 64, 66, 75, 200, 800):
        base = rng.choice(2**32, size * 2, replace=False)
        for keep in (size, size - size // 10, size - size // 9, size - size // 5, size // 2):
            sets.append(np.sort(np.concatenate([base[:keep], base[size : 2 * size - keep]])).astype("<u4"))
            sets.append(np.sort(base[:keep]).astype("<u4"))
    sets = [x for x in sets if len(x)]  # a text with words has a shingle
    rows = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "i long, x binary").select("i", simhash.sketch(F.col("x")).alias("s"))
    held = simhash.Sketches([bytes(r["s"]) for r in sorted(rows.collect(), key=lambda r: r["i"])])
    a, b = np.array(list(itertools.combinations(range(len(sets)), 2))).T
    near = held.near(a, b, 0.8)
    for i, j, kept in zip(a, b, near):
        both = len(np.intersect1d(sets[i], sets[j]))
        similar = both / (len(sets[i]) + len(sets[j]) - both) >= 0.8
        assert kept or not similar
        if len(sets[i]) < 64 and len(sets[j]) < 64:
            assert kept == similar
        if len(sets[i]) >= 64 and len(sets[j]) >= 64 and both < 0.5 * min(len(sets[i]), len(sets[j])):
            assert not kept


def test_crowded_anchors_are_dealt_to_many_tasks(spark):
    """Rows beyond ``most`` come back, and blocks of them meet pair by pair: no pair is lost."""
    rng = np.random.default_rng(3)
    rows = [(cell, 100 * cell + i, int(1 << rng.integers(60))) for cell in range(3) for i in range((5, 40, 90)[cell])]
    replicas = spark.createDataFrame(rows, "cell long, id long, s long")
    found = simhash.candidates(replicas, most=30).collect()
    crowd = [(r["cell"], r["a"], r["s"]) for r in found if r["left"] == simhash.CROWD]
    assert sorted(crowd) == sorted(r for r in rows if r[0])
    dealt = simhash.split_crowds(spark.createDataFrame(crowd, "cell long, id long, s long"), block=7)
    met = {tuple(sorted(p)) for c, g in itertools.groupby(sorted(map(tuple, dealt.select("cell", "id").collect())), lambda r: r[0]) for p in itertools.combinations([i for _, i in g], 2)}
    assert met == {p for cell in (1, 2) for p in itertools.combinations([i for c, i, _ in rows if c == cell], 2)}
    known = dealt.select("id", F.col("id").alias("label"), F.lit(b"").alias("sketch")).distinct()
    assert {(r["a"], r["b"]) for r in simhash.candidates_between(dealt, known).collect()} == met


def test_similar_texts_with_a_replaced_passage(spark):
    """Recall for pairs that just reach 0.8: the hardest ones for a signature."""
    rng = np.random.default_rng(4)
    rows = []
    for family in range(120):
        words = [f"w{x}" for x in rng.integers(0, 4000, 400)]
        rows += [(2 * family, " ".join(words)), (2 * family + 1, " ".join([*words[:200], *(f"v{x}" for x in rng.integers(0, 4000, 38)), *words[238:]]))]
    want = {(2 * i, 2 * i + 1) for i in range(120)}
    assert want <= brute_similar(rows) and len(shingles_of(rows[0][1]) & shingles_of(rows[1][1])) < 0.82 * len(shingles_of(rows[0][1]) | shingles_of(rows[1][1]))
    have = {(r["a"], r["b"]) for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert have <= want and len(have) >= 0.9 * len(want)


def test_different_texts_under_one_id(spark):
    rows = [(1, "one two three four five six"), (1, "seven eight nine ten eleven"), (1, "seven eight nine ten eleven"), (2, "seven eight nine ten eleven"), (3, "one two three four five six"), (None, "alone it stands"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for similarity in (None, 0.8):
        kept = simhash.keep_first(docs, similarity=similarity).collect()
        assert sorted((str(r["doc_id"]), r["text"]) for r in kept if r["text"]) == [("1", rows[0][1]), ("1", rows[1][1]), ("None", rows[5][1])]
        assert sum(r["text"] is None for r in kept) == 1


def test_similar_texts_that_repeat_a_passage(spark):
    """How often a refrain or a row is repeated changes no shingle set, and so no signature by much."""
    rng = np.random.default_rng(9)
    rows = []
    for family in range(20):
        words = [f"w{x}" for x in rng.integers(0, 4000, 210)]
        rows += [(2 * family + j, " ".join(words[:200] + words[200:] * n)) for j, n in enumerate((1, 10 + family))]
    assert {(2 * i, 2 * i + 1) for i in range(20)} <= brute_similar(rows)
    bits = [[np.array(simhash.signature_text(t), np.int64).view(np.uint64) for _, t in rows[i : i + 2]] for i in range(0, 40, 2)]
    assert max(int(np.bitwise_count(a ^ b)[0]) for a, b in bits) <= simhash.CLOSE // 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["a"], r["b"]) for r in simhash.similar(docs).collect()} == brute_similar(rows)
    long = " ".join(f"w{x}" for x in rng.integers(0, 4000, simhash.CHUNK))  # repeats over the bounds of chunks count once, too
    assert simhash.signature_text(f"{long} {long} {long}") == simhash.signature_text(f"{long} {long}")


def test_similar_texts_awkward(spark, awkward):
    assert simhash.similar(awkward.limit(0)).isEmpty()
    assert {(r["a"], r["b"]) for r in simhash.similar(awkward).collect()} == brute_similar(texts(awkward))
    kept = simhash.keep_first(awkward, similarity=0.8)
    assert kept.columns == awkward.columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"]} >= {1, 3, 5, 7, 12}


def test_pipeline_against_brute_force(spark, documents, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    model = langid.fit(documents.where(~langid.held_out("doc_id")))
    score = langid.Scorer(model)
    rows = {i: t for i, t in rows.items() if (s := score(t))[0] != "und" and s[1] >= 0.5}
    left = documents.where(F.col("doc_id").isin(list(rows)))
    drawn = {r["doc_id"] for r in quality.resample(left, labels).collect()}
    rows = {i: t for i, t in rows.items() if i in drawn}
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows.items():
        for line in t.split("\n"):
            holders[key(line)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    rows = {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in rows.items()}
    keep = set(brute_groups(list(rows.items())).values())
    want = {i: ids_of(t) for i, t in rows.items() if i in keep}
    have = defaultdict(int)
    for p in pipeline.run(spark, SF).collect():
        ids = want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        have[p["doc_id"]] += p["length"]
    assert have == {i: len(w) for i, w in want.items()}


def test_pipeline_stages_awkward(spark, awkward):
    """Every stage on nulls, repeats, long texts, columns named like outputs, and an empty table."""
    pipeline = pytest.importorskip("corpus_pipeline")
    extra = {c: F.lit("own") for c in ("lang_pred", "key", "log_weight", "n_lines", "kept_text", "label", "digest", "h", "found", "rest", "a.b", "x`y", "__id", "__digest", "__found", "__row", "__own", "__text")}
    docs = awkward.withColumns({**extra, "n_chars": F.lit(1).cast("long")})
    kept = {}
    for name, stage in pipeline.STAGES:
        out, empty = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert empty.isEmpty()
        rows = out.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == {r[0] for r in AWKWARD}
            continue
        assert out.columns == docs.columns
        assert all(r[c] == "own" for r in rows for c in extra) and {r["score"] for r in rows} <= {"x"}
        kept[name] = Counter(r["doc_id"] for r in rows)
    assert not {1, 2, 6, 7} & set(kept["language ID"]) and kept["language ID"][3] == 2
    assert kept["line dedup"] == Counter(r[0] for r in AWKWARD)
    assert kept["SimHash near-dedup"][3] == 1 and 4 not in kept["SimHash near-dedup"]


def test_entry_registers_everything():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
