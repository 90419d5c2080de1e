"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per Spark task.

Spark deals the texts; a task cuts them into pre-tokens by the public pattern, and encodes each
distinct pre-token once. A megabyte of texts at a time is first cut as arrays where that pattern must
cut (:func:`kinograph.llm.tokens.cut_texts`); only what is more than a space and letters then goes through the
pattern, each distinct piece once. New pre-tokens become token-position rows of an in-memory table. A
recursive query joins neighbouring positions with the merge table, contracts each word's
leftmost pair of minimum rank, and goes on until no word has a pair left. Its rows in order are
the ids, and, joined with the vocabulary, the decoded bytes. A query covers DEPTH steps; words with
more go through further queries, so that what the recursion collects stays bounded for very long
pre-tokens too.

Of a long pre-token, a step contracts from the left every pair of the minimum rank that does not
overlap the one before, up to and including the first after which a neighbouring pair has a lower
rank: those are the merges that one pair at a time would make next. So the steps are about as many
as the ranks met, not as the merges.

Cases: null and empty texts have no ids; lone surrogates cannot occur in Spark strings; texts and
pre-tokens of any length are encoded whole; equal texts give equal ids; repeated rows give
repeated results; an empty table gives an empty result. Columns beside id and text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import Memo, give_back, parts_of_bytes
from kinograph.llm.tokens import GPT2, cut_texts, distinct, laid_out

#: Steps that one recursive query makes for a word at most, and rows that it collects of long ones.
DEPTH, COLLECTED = 48, 2_000_000
#: Bytes from which on a pre-token is long.
LONG_WORD = 64
#: Bytes of pre-tokens that one query starts from, and of texts looked at together, or one text if it is longer.
ROUND_BYTES, BYTES_AT_ONCE = 200_000, 1 << 20
#: Bytes of the pre-tokens that a task remembers, and of an entry beside its text.
MEMO_BYTES, ENTRY_BYTES = 64_000_000, 150

ENCODE_SQL = f"""
WITH RECURSIVE step(w, pos, id, after, depth) AS (
  SELECT w, pos, id, coalesce(lead(id) OVER (PARTITION BY w ORDER BY pos), -1), 0 FROM state
  UNION ALL
  SELECT p.w, CASE WHEN pos > spot THEN pos - 1 ELSE pos END, CASE WHEN pos = spot + 1 THEN merged ELSE id END,
    CASE WHEN pos = spot - 1 THEN merged ELSE after END, p.depth + 1
  FROM step p JOIN (
    SELECT w, best >> 32 AS merged, best & 4294967295 AS spot
    FROM (SELECT q.w, min(m.merged::BIGINT << 32 | q.pos) AS best FROM step q JOIN merges m ON m.l = q.id AND m.r = q.after GROUP BY q.w)
  ) b ON b.w = p.w
  WHERE p.depth < {DEPTH} AND pos <> spot
)
SELECT s.w, s.pos, s.id, s.depth FROM step s JOIN (SELECT w, max(depth) AS depth FROM step GROUP BY w) d ON s.w = d.w AND s.depth = d.depth
"""
ENCODE_LONG_SQL = """
WITH RECURSIVE step(w, pos, id, depth) AS (
  SELECT w, pos::BIGINT, id, 0 FROM state
  UNION ALL
  (WITH t AS (
    SELECT w, pos, id, depth, lag(id) OVER line AS before, lead(id) OVER line AS after, lead(id, 2) OVER line AS beyond
    FROM step WHERE depth < {depth} WINDOW line AS (PARTITION BY w ORDER BY pos)
  ), lowest AS (
    SELECT t.w, t.pos, m.merged, t.before, t.beyond FROM t JOIN merges m ON m.l = t.id AND m.r = t.after
    QUALIFY m.merged = min(m.merged) OVER (PARTITION BY t.w)
  ), chains AS (
    SELECT *, pos - row_number() OVER (PARTITION BY w ORDER BY pos) AS chain FROM lowest
  ), apart AS (
    SELECT * FROM chains QUALIFY row_number() OVER (PARTITION BY w, chain ORDER BY pos) % 2 = 1
  ), beside AS (
    SELECT *, CASE WHEN lag(pos) OVER (PARTITION BY w ORDER BY pos) = pos - 2 THEN merged ELSE before END AS previous FROM apart
  ), judged AS (
    SELECT b.w, b.pos, b.merged, coalesce(x.merged < b.merged, false) OR coalesce(y.merged < b.merged, false) AS stop
    FROM beside b LEFT JOIN merges x ON x.l = b.previous AND x.r = b.merged LEFT JOIN merges y ON y.l = b.merged AND y.r = b.beyond
  ), now AS (
    SELECT w, pos, merged FROM judged
    QUALIFY NOT coalesce(bool_or(stop) OVER (PARTITION BY w ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
  )
  SELECT t.w, row_number() OVER (PARTITION BY t.w ORDER BY t.pos) - 1, coalesce(c.merged, t.id), t.depth + 1
  FROM t SEMI JOIN now ON now.w = t.w LEFT JOIN now c ON c.w = t.w AND c.pos = t.pos
  ANTI JOIN now d ON d.w = t.w AND d.pos + 1 = t.pos)
)
SELECT s.w, s.pos, s.id, s.depth FROM step s JOIN (SELECT w, max(depth) AS depth FROM step GROUP BY w) d ON s.w = d.w AND s.depth = d.depth
"""
COLLECT_SQL = "SELECT d.w, d.id, v.bytes FROM done d JOIN vocabulary v ON v.id = d.id ORDER BY d.w, d.pos"


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """A rank file's lines (base64 token, rank) to token ranks."""
    return {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines.splitlines() if x)}


def binary(data: bytes | np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Values that lie one behind the other."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


class WordCoder:
    """Encodes and decodes words by the recursive query; one instance for each task."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "350MB"})
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = zip(*pairs) if pairs else ((), (), ())
        merges = pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "merged": pa.array(merged, pa.int32())})
        vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())})
        self._load("merges", merges)
        self._load("vocabulary", vocabulary)
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def encode(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Each word's ids (little-endian unsigned 32-bit) and the bytes they decode to."""
        return list(zip(*[x.to_pylist() for x in self.encode_array(pa.array(words, pa.binary()))]))

    def encode_array(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The same of and as arrays."""
        long = pc.greater_equal(pc.binary_length(words), LONG_WORD)
        short = self._encode(words.filter(pc.invert(long)), False)
        if not pc.any(long).as_py():
            return short
        order = pa.array(np.argsort(np.argsort(long.to_numpy(zero_copy_only=False), kind="stable"), kind="stable"))
        ids, decoded = [pa.concat_arrays(x).take(order) for x in zip(short, self._encode(words.filter(long), True))]
        return ids, decoded

    def _encode(self, words: pa.Array, long: bool) -> tuple[pa.Array, pa.Array]:
        data, bounds = laid_out(words)
        sizes = np.diff(bounds)
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = np.arange(len(data), dtype=np.int32) - bounds[:-1][w]
        self._load("state", pa.table({"w": w, "pos": pos, "id": self.of_byte[np.frombuffer(data, np.uint8)]}))
        self._contract(len(data), long)
        found = self.db.sql(COLLECT_SQL).to_arrow_table()
        upto = np.searchsorted(found["w"].to_numpy(), np.arange(len(words) + 1, dtype=np.int32))
        decoded, ends = laid_out(pa.concat_arrays([pa.array([], pa.binary()), *found["bytes"].chunks]))
        return binary(found["id"].to_numpy().astype("<u4", copy=False), 4 * upto), binary(decoded, ends[upto])

    def _contract(self, n_rows: int, long: bool) -> None:
        """Table ``done`` with the tokens that ``state`` ends with."""
        self.db.execute("CREATE OR REPLACE TEMP TABLE done AS SELECT w, pos, id FROM state LIMIT 0")
        while n_rows:
            depth = max(1, min(DEPTH, COLLECTED // n_rows)) if long else DEPTH
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE reached AS {ENCODE_LONG_SQL.format(depth=depth) if long else ENCODE_SQL}")
            self.db.execute(f"INSERT INTO done SELECT w, pos, id FROM reached WHERE depth < {depth}")
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE state AS SELECT w, pos, id FROM reached WHERE depth = {depth}")
            n_rows = self.db.execute("SELECT count(*) FROM state").fetchall()[0][0]


class TextCoder:
    """Encodes texts through :class:`WordCoder`, remembering words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.words, self.split, self.cuts = WordCoder(ranks), regex.compile(pattern).findall, pattern == GPT2
        self.memo, self.known = Memo(MEMO_BYTES, ENTRY_BYTES), [pa.array([], pa.binary())] * 2  # words' rows, and ids and decoded bytes of the rows

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Each text's ids and the bytes they decode to."""
        return list(zip(*[x.to_pylist() for x in self.encode_array(pa.array(texts, pa.string()))]))

    def encode_array(self, texts: pa.Array) -> list[pa.Array]:
        """The same of and as arrays; null is an empty text."""
        data, bounds = laid_out(texts.cast(pa.string()))
        starts, words = cut_texts(data, bounds, self.cuts)
        every, which = distinct(data, starts)
        word = np.zeros(len(every), bool)
        word[which] = words
        others = [list(map(str.encode, self.split(p.decode()))) for p in compress(every, ~word)]
        counts = np.ones(len(every), np.int32)
        counts[~word] = [len(x) for x in others]
        rows = np.zeros(counts.sum(), np.int32)  # of the words of each piece in turn
        alone = np.repeat(word, counts)
        rows[alone], rows[~alone] = self._rows(list(compress(every, word)), list(chain.from_iterable(others)))
        each = counts[which]
        upto = np.append(np.int32(0), np.cumsum(each, dtype=np.int32))
        first = (np.cumsum(counts, dtype=np.int32) - counts)[which] - upto[:-1]
        rows = pa.array(rows[np.repeat(first, each) + np.arange(upto[-1], dtype=np.int32)])
        at, out = upto[np.searchsorted(starts, bounds)], []
        for known in self.known:
            held, ends = laid_out(known.take(rows))
            out.append(binary(held, ends[at]))
        return out

    def _rows(self, *lists: list[bytes]) -> list[np.ndarray]:
        """The words' rows, of words that are new after having learned them."""
        every = set().union(*lists)
        new = [w for w in every if w not in self.memo]
        if not self.memo.room(new):
            new, self.known = list(every), [x[:0] for x in self.known]
        new.sort(key=len)  # words of like length need like numbers of steps
        learned = [self.words.encode_array(x.column(0)) for x in parts_of_bytes(pa.record_batch([pa.array(new, pa.binary())], ["word"]), 0, ROUND_BYTES)]
        self.memo.update(zip(new, range(len(self.known[0]), len(self.known[0]) + len(new))))
        self.known = [pa.concat_arrays([x, *y]) for x, y in zip(self.known, zip(*learned))] if learned else self.known
        return [np.fromiter(map(self.memo.__getitem__, x), np.int32, len(x)) for x in lists]


def encode_decode(docs: DataFrame, rank_lines: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian unsigned 32-bit integers, and the bytes decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(rank_lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            for part in parts_of_bytes(batch, 1, BYTES_AT_ONCE):
                coder = coder or TextCoder(read_ranks(shared.value), pattern)
                yield pa.RecordBatch.from_arrays([part.column(0), *coder.encode_array(part.column(1))], ["doc_id", "ids", "decoded"])
        del coder
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")
