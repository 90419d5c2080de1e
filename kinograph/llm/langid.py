"""Language identification by words first, backing off to character n-grams for unseen words.

Training counts, per language, the words of labelled rows and the n-grams of those words, in Spark.
The labelled rows are a bounded sample: per language about ``sample_docs`` documents, chosen by a
digest of the id, each read whole. Every label that is not null is learned; a word or n-gram
enters the model for a language if it was met ``least`` times in that language's sample (once, where the sample
holds no n-gram that often). The model is sparse: hashes of the keys, sorted, with an entry per (key, language)
that was met, and one floor per language for all other keys; its bytes are counted before it comes to the driver.
Prediction reads whole texts: a known word scores by its log frequency in every language; an
unseen word by the mean log frequency of its longest n-grams that are known, falling back from four
characters to one. The posterior under equal priors is the score.

Cases: null texts and texts without a letter are ``und`` with score 0; words outside every model
table count equally for all languages, so a text with only such words has an even score; ties go to
the alphabetically first language; null labels do not train, an empty label is a label like any
other; a language whose sample has no letter is not learned; a model over ``most_bytes`` is an error that says so; without any training row everything is ``und``. Repeated rows count as often as they occur. ``predict`` passes all input
columns on and replaces those named like its outputs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import cut, give_back, parts, unused, with_columns

UNKNOWN = "und"
WORD = regex.compile(r"\p{L}+")
LONGEST_GRAM = 4
#: Bytes of the words that a task remembers, and of an entry beside its text and its numbers.
MEMO_BYTES, ENTRY_BYTES = 32_000_000, 200
#: Bytes of an entry of a table: a hash, a language, a log frequency.
TABLE_ENTRY_BYTES = 24
SEED = 42


def hashes_of(keys: list[str]) -> np.ndarray:
    """What Spark's xxhash64 gives for each key."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(k.encode(), SEED) for k in keys), np.uint64, len(keys))


@dataclass
class Table:
    """Log frequencies per key and language: entries where they met, sorted by the key's hash, and a floor per language elsewhere."""

    keys: np.ndarray
    starts: np.ndarray
    languages: np.ndarray
    logs: np.ndarray
    floor: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, languages: np.ndarray, counts: np.ndarray, n_languages: int) -> Table:
        """Add-one-half smoothed log frequencies of counts."""
        order = np.argsort(keys, kind="stable")
        keys, languages, counts = keys[order], languages[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        totals = np.bincount(languages, counts, n_languages) + len(first) / 2
        if len(first) == 0:
            totals = np.ones(n_languages)
        return cls(keys[first], np.r_[first, len(keys)], languages.astype(np.uint16 if n_languages < 2**16 else np.uint32), np.log((counts + 0.5) / totals[languages]), np.log(0.5 / totals))

    def rows(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and their log frequencies in every language."""
        at = np.minimum(np.searchsorted(self.keys, hashes), max(0, len(self.keys) - 1))
        known = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        at = at[known]
        sizes = self.starts[at + 1] - self.starts[at]
        entry = np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out = np.tile(self.floor, (len(at), 1))
        out[np.repeat(np.arange(len(at)), sizes), self.languages[entry]] = self.logs[entry]
        return known, out


@dataclass
class Model:
    """``grams`` has the table of k-grams at k - 1."""

    languages: list[str]
    words: Table | None
    grams: list[Table]

    def bytes(self) -> int:
        return sum(x.nbytes for t in [self.words, *self.grams] if t for x in (t.keys, t.starts, t.languages, t.logs, t.floor))


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_docs: int = 1500, least: int = 4, most_bytes: int = 1_000_000_000) -> Model:
    """Count words and n-grams of about ``sample_docs`` labelled rows per language; hashes and counts of those met ``least`` times come to the driver."""
    rows = rows.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    sizes = rows.groupBy("label").count().collect()  # a row for each language
    if not sizes:
        return Model([], None, [])
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["label"], min(1.0, sample_docs / r["count"]))])
    chance = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    sample = rows.where(chance < F.element_at(share, F.col("label")))
    found = F.array_remove(F.split(F.lower("text"), r"\P{L}+"), "")
    words = cut(sample.select("label", F.explode(found).alias("key")).groupBy("label", "key").agg(F.count(F.lit(1)).alias("n")))
    padded = F.concat(F.lit("_"), F.col("key"), F.lit("_"))
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(LONGEST_GRAM)),
            lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - k + 1, F.lit(1))), lambda i: F.substr(padded, i, k)),
        )
    )
    counted = cut(words.select("label", "n", F.explode(grams).alias("key")).groupBy("label", "key").agg(F.sum("n").alias("n")))
    most = {r["label"]: r["n"] for r in counted.where("key <> '_'").groupBy("label").agg(F.max("n").alias("n")).collect()}
    languages = sorted(most)
    if not languages:
        return Model([], None, [])
    enough = F.create_map(*[F.lit(x) for name in languages for x in (name, least if most[name] >= least else 1)])
    number = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
    often = lambda counts: counts.where(F.col("n") >= F.element_at(enough, F.col("label"))).select(F.xxhash64("key").alias("h"), F.element_at(number, F.col("label")).alias("language"), "n", F.length("key").alias("k"))
    tables = [often(words), *[often(counted).where(F.col("k") == k) for k in range(1, LONGEST_GRAM + 1)]]
    if (size := TABLE_ENTRY_BYTES * sum(t.count() for t in tables)) > most_bytes:
        raise ValueError(f"the model would take {size:,} bytes, over most_bytes = {most_bytes:,}: sample fewer documents or raise least")

    def brought(counts: DataFrame) -> Table:
        got = counts.select("h", "language", "n").toArrow()
        column = lambda name, kind: got.column(name).to_numpy().astype(kind, copy=False)
        return Table.of(column("h", np.int64).view(np.uint64), column("language", np.int32), column("n", np.int64), len(languages))

    words_table, *gram_tables = map(brought, tables)
    return Model(languages, words_table, gram_tables)


class Scorer:
    """Scores texts, a batch at a time; remembers the log frequencies of words within bounded memory."""

    def __init__(self, model: Model):
        self.model, self.n = model, len(model.languages)
        self.room = max(1, MEMO_BYTES // (ENTRY_BYTES + 8 * self.n))
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.logs = np.zeros((0, self.n))

    def backoff(self, words: list[str]) -> np.ndarray:
        """Mean log frequencies of each word's longest known n-grams; zeros if not even a letter is known."""
        out, left = np.zeros((len(words), self.n)), np.arange(len(words))
        for k in range(LONGEST_GRAM, 0, -1):
            # the boundary alone says nothing
            cut_up = [list(words[i]) if k == 1 else [p[j : j + k] for p in (f"_{words[i]}_",) for j in range(len(p) - k + 1)] for i in left.tolist()]
            owner = np.repeat(left, [len(g) for g in cut_up])
            known, rows = self.model.grams[k - 1].rows(hashes_of([g for c in cut_up for g in c]))
            np.add.at(out, owner[known], rows)
            hits = np.bincount(owner[known], minlength=len(words))
            done = hits > 0
            out[done] /= hits[done, None]
            left = left[~done[left]]
        return out

    def learn(self, words: list[str]) -> None:
        known, rows = self.model.words.rows(hashes_of(words))
        logs = np.empty((len(words), self.n))
        logs[known] = rows
        for at in range(0, len(unseen := np.flatnonzero(~known)), 2000):
            part = unseen[at : at + 2000]
            logs[part] = self.backoff([words[i] for i in part])
        self.memo.update(zip(words, range(len(self.logs), len(self.logs) + len(words))))
        self.logs = np.concatenate([self.logs, logs])

    def batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.n:
            return [(UNKNOWN, 0.0)] * len(texts)
        counts = [Counter(WORD.findall(t.lower())) if t else {} for t in texts]
        every = set().union(*counts)
        new = [w for w in every if w not in self.memo]
        if len(self.memo) + len(new) > self.room and self.memo:
            self.forget()
            new = list(every)
        self.learn(sorted(new))
        out = []
        for words in counts:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            rows = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
            sums = np.fromiter(words.values(), np.float64, len(words)) @ self.logs[rows]
            best = int(sums.argmax())
            out.append((self.model.languages[best], 1.0 / float(np.exp(np.maximum(sums - sums[best], -700.0)).sum())))
        return out

    def __call__(self, text: str | None) -> tuple[str, float]:
        return self.batch([text])[0]


def predictor(model: Model, spark) -> callable:
    """Column function: text to struct<lang, score>."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = Scorer(shared.value)
        for texts in batches:
            found = [x for part in parts(texts) for x in score.batch(part.to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"])
        del score
        give_back()

    return predict_texts


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add lang_pred and score."""
    name = unused(docs, "found")
    found = docs.withColumn(name, predictor(model, docs.sparkSession)(F.col(text_col)))
    return with_columns(found, {"lang_pred": F.col(f"{name}.lang"), "score": F.col(f"{name}.score")}).drop(name)


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; such rows never train."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
