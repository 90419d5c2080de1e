"""Periodic runs of words, found by bit-parallel comparison of a text with itself at every lag.

The words of a text get dense ids; plane j is one big integer whose bit i is bit j of word i's id. At
lag q, plane XOR (plane >> q) has a one wherever word i and word i + q differ in that bit; the OR over
the planes is the map of mismatches. A run of period q and length m is a stretch of m - q zeros in that
map. Stretches of at least L zeros are isolated by shift-doubling: z & z >> 1 holds stretches of two,
that & itself >> 2 stretches of four, and so on up to L.

Three things keep this near linear, without losing a run:

* Planes are ORed one after the other and the search stops as soon as no stretch of L is left. Ordinary
  text is out after the first plane.
* A run of period q counts from length max(24, 3 q), so its stretch covers 64 multiples of any
  step s <= q / 32. Long lags are compared on every s-th word first, with planes of every phase
  at hand: the work for a lag falls with the lag, and all lags of a text of n words cost about n log n.
* Periods rise, so a run is met at its smallest period first. At later multiples of that period its
  stretch is exactly the same (Fine and Wilf: what has both periods over 3 q words has their
  greatest common divisor as a period), so it is masked and costs nothing but the mask.

A text is one row and one task's work; rows are independent, nothing is shuffled or collected, and a lost
task is simply run again.

Cases: a null or empty text has no words and no run, its kept text is empty; words are
``[^\\x20\\x09-\\x0D]+``, compared byte by byte; repeated rows and ids are rows like any other; an
empty table gives an empty result. :func:`find` is a column function, so names of other columns don't matter.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinograph.llm.common import give_back, parts

#: Runs count from this length, and from this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Samples that a run's stretch has on the coarse planes.
SAMPLES = 64
FOUND = "struct<n_words: bigint, runs: array<struct<start: bigint, length: bigint, period: bigint>>, kept: string>"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def to_int(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def ones(bits: int) -> np.ndarray:
    """Places of the ones of a non-negative integer, ascending."""
    data = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(data, bitorder="little"))


def stretches(z: int, least: int) -> int:
    """Ones where a stretch of at least ``least`` ones of ``z`` begins at that place or goes on for as many."""
    have = 1
    while have < least and z:
        step = min(have, least - have)
        z &= z >> step
        have += step
    return z


class Planes:
    """Bit planes of word ids, whole and thinned to every s-th word of each phase, made when asked for."""

    def __init__(self, ids: np.ndarray, n_ids: int):
        self.ids, self.n = ids, len(ids)
        self.depth = max(1, int(n_ids - 1).bit_length())
        self.made: dict[tuple[int, int], list[int]] = {}

    def of(self, plane: int, step: int) -> list[int]:
        """One integer per phase."""
        if (plane, step) not in self.made:
            bits = (self.ids >> plane & 1).astype(np.uint8)
            rows = -(-self.n // step)
            bits = np.pad(bits, (0, rows * step - self.n)).reshape(rows, step)
            packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
            self.made[plane, step] = [int.from_bytes(row.tobytes(), "little") for row in packed]
        return self.made[plane, step]

    def equal(self, lag: int, step: int, least: int, known: int) -> int:
        """Places i (of every step-th word) from which ``least`` neighbours all equal the word ``lag`` on; 0 as soon as there is none."""
        places = (self.n - lag + step - 1) // step  # i * step + lag < n
        mask = (1 << places) - 1
        differ, found = known, 0
        for plane in range(self.depth):
            phases = self.of(plane, step)
            differ |= phases[0] ^ (phases[lag % step] >> lag // step)
            found = stretches(~differ & mask, least)
            if not found:
                break
        return found


def known_at(live: list[tuple[int, int, int]], lag: int, step: int, n: int) -> int:
    """Ones at every step-th word inside the stretches that runs (length, start, period) have at this lag."""
    held = [(start, start + length - lag) for length, start, period in live if lag % period == 0]
    if not held:
        return 0
    edges = np.zeros(n // step + 2, np.int32)
    for first, end in held:
        edges[-(-first // step)] += 1
        edges[-(-end // step)] -= 1
    return to_int(np.cumsum(edges) > 0)


def runs_of(ids: np.ndarray, n_ids: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of ids below ``n_ids``, by start, then period."""
    n, planes = len(ids), Planes(ids, n_ids)
    runs: list[tuple[int, int, int]] = []
    live: list[tuple[int, int, int]] = []  # a heap of (length, start, period): runs long enough to show at later lags
    for lag in range(1, n // LEAST_PERIODS + 1 if n >= LEAST_WORDS else 1):
        enough = max(LEAST_WORDS, LEAST_PERIODS * lag)
        while live and live[0][0] < enough:
            heapq.heappop(live)
        step = 1 << max(1, 2 * lag // SAMPLES).bit_length() - 1
        if step > 1 and not planes.equal(lag, step, (enough - lag) // step, known_at(live, lag, step, n)):
            continue
        found = planes.equal(lag, 1, enough - lag, known_at(live, lag, 1, n))
        if found:
            for first, last in zip(ones(found & ~(found << 1)), ones(found & ~(found >> 1))):
                runs.append((int(first), int(last - first) + enough, lag))
                heapq.heappush(live, (runs[-1][1], runs[-1][0], lag))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """Words outside all runs, or in no run beyond its first period, joined by spaces."""
    edges = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]) if runs else b" ".join(words)


def numbered(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Dense ids by first place, and how many there are."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    return ids, len(known)


def _find(texts: pa.Array) -> pa.Array:
    counts, runs, kept = [], [], []
    for part in parts(texts):
        for text in part.cast(pa.binary()).to_pylist():
            words = (text or b"").split()  # parts at exactly the six ASCII blanks
            found = runs_of(*numbered(words))
            counts.append(len(words))
            runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
            kept.append(collapse(words, found))
    out = pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "runs", "kept"])
    del counts, runs, kept
    give_back()
    return out


def find(text: Column) -> Column:
    """struct<n_words, runs: array<struct<start, length, period>>, kept> of a text: its runs by start and period, and it without their repeats."""
    return F.arrow_udf(_find, FOUND)(text)


def strongest(runs: Column) -> Column:
    """The run with the most periods, exactly; ties go to the smallest start, then period. Null without runs."""

    def compare(a: Column, b: Column) -> Column:
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        by_place = F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"]))
        return F.when(left > right, -1).when(left < right, 1).otherwise(by_place).cast("int")

    return F.get(F.array_sort(runs, compare), F.lit(0))


def _plant(ids: pa.Array, texts: pa.Array) -> pa.Array:
    out = []
    for at in range(0, len(ids), 256):
        for key, text in zip(ids.slice(at, 256).to_pylist(), texts.slice(at, 256).to_pylist()):
            h = 1 if key is None else zlib.crc32(str(key).encode())
            if h % 10 == 0 and text and (words := text.encode().split()):
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words[a:] = [words[a + i % p] for i in range(n - a)]
                text = b" ".join(words).decode()
            out.append(text)
    return pa.array(out, pa.string())


def with_planted_runs(id_col: Column, text: Column) -> Column:
    """The text, but for about a tenth of the ids from some word on repeated with some period: cases for :func:`find`.

    With h the crc32 of the id in decimal, g = h // 10, and h % 10 = 0, word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8). A null id plants nothing.
    """
    return F.arrow_udf(_plant, "string")(id_col, text)

