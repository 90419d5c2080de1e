"""SimHash near-duplicates by anchor-point covering.

Anchors are a covering code of the 64-bit space: the perfect Hamming code of length 63 with the
64th bit free, so every fingerprint is within radius R = 1 of an anchor. Two fingerprints that
differ in at most t bits have a midpoint within ceil(t / 2) of both, and the anchor that covers
the midpoint is within R + ceil(t / 2) of both. So each fingerprint is replicated to every anchor
within that reach (covering radius plus its half of the threshold) and compared per anchor: no link
is missed. For t = 2 that is 33 anchors at most, and an anchor gathers at most 2081 distinct
fingerprints, however the corpus is skewed, because no more words lie within 2 bits of it.

The anchors of a word are found without search: flipping a set of bits leads to an anchor exactly if
the set has the word's syndrome, so the flip sets are tabled by syndrome.

Copies share a fingerprint and are one class before anything is replicated. Each anchor emits a
spanning forest of its links rather than all pairs; components then spread the smallest label
along the links, with pointer jumping, each round checkpointed.

Texts that share four fifths of their distinct shingles of five words differ in more bits than a
covering of 64 can bridge. :func:`similar_sets` therefore takes longer SimHash signatures, over distinct
pairs of words, and cuts them into PARTS short fingerprints, each covered by the Hamming code of its
length. What meets at an anchor in any of them and is close in a further signature word is a
candidate; the exact Jaccard similarity of the shingle sets decides. If a replaced passage brings a pair
down to 0.8, each bit differs with probability 0.15, so that it meets at an anchor of one part with
probability 0.2 and in any of twelve with 0.93; at 0.85 that is 0.98, at 0.9 0.999. Single words
replaced here and there touch fewer pairs of words: there it is over 0.999 at 0.8 too. Of more than two rows, an anchor first
emits each row's nearest only, with ties broken alike everywhere, so that anchors agree on them; when
those are decided, its rows meet again with the components they are in by then and a sketch of
4096 bits or, if small, their whole sets, and every pair between components that is close in signature and not ruled out by size, sketch or set is a candidate too. Anchors with more rows than one task should hold are dealt, block by block, to many.

Cases: null, empty and blank texts have fingerprint zero and are linked like any other; texts of
one or two words have one shingle; long texts are hashed in chunks; repeated rows are in one class;
null ids are never a component's id unless a component has no other; different texts under one id
are different documents; an empty table gives an empty result. Input columns are passed on, those
named like an output are replaced.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.llm.common import cut, cut_small, give_back, narrow_side, packed, parts, unpacked, with_columns

BITS, SEED = 64, 42
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
#: Checks of the Hamming code for a fingerprint, and for a part of a signature.
FULL, PART = 6, 5
#: A signature, over shingles of so many words: the parts (31 bits each) that are covered, two to a word of 64 bits, behind one word for the distance at an anchor.
SIGNATURE_SHINGLE, PART_BITS, PARTS = 2, 31, 12
SIGNATURE_WORDS = 1 + PARTS // 2
#: Bits of that word in which candidates differ at most. Texts with a Jaccard similarity of 0.8 differ
#: in 9.7 of them, with a deviation of 2.9.
CLOSE = 18
#: Words of a sketch over the shingles that decide, and its bits in which a pair of a crowded anchor differs
#: at most: at 0.8 it differs in 620, with a deviation of 23. Sets with fewer shingles are compared themselves.
SKETCH_WORDS, FAR, SKETCHED = 64, 696, 64
#: Bytes of sketches that a group of anchors brings to a task, and groups at least.
GROUP_BYTES, LEAST_GROUPS = 16_000_000, 16
#: Rows at an anchor up to which one task holds it.
MOST = 20_000
#: Distances between signatures that are held at a time.
BLOCK = 1 << 21


#: The bits of each byte, highest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII case and ASCII blanks only


def shingle_hashes(tokens: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles, repeats included, CHUNK at a time; none without words."""
    import xxhash

    shingles = max(1, len(tokens) - words + 1) if tokens else 0
    for at in range(0, shingles, CHUNK):
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), SEED) for i in range(at, min(at + CHUNK, shingles))], dtype=np.uint64)


def count_bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, highest bit first: a histogram of bytes per place, times their bits."""
    places = h.astype(">u8").view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    return (np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS).ravel()


def fingerprint_words(tokens: list[bytes], words: int) -> int:
    """The 64-bit SimHash of the word shingles, as a signed integer; zero without words."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for h in shingle_hashes(tokens, words):
        ones, n = ones + count_bits(h), n + len(h)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprint_text(text: str | None, words: int = 3) -> int:
    return fingerprint_words(words_of(text), words)


def fingerprint(text: Column, words: int = 3) -> Column:
    @F.arrow_udf("long")
    def of_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint_text(t, words) for part in parts(texts) for t in part.to_pylist()], pa.int64())
        give_back()

    return of_texts(text)


def syndrome(words: np.ndarray, checks: int = FULL) -> np.ndarray:
    """The parity checks of each word as one number: position p (from 1) is in check j if bit j of p is set."""
    masks = np.array([sum(1 << (p - 1) for p in range(1, 1 << checks) if p >> j & 1) for j in range(checks)], dtype=np.uint64)
    parity = np.bitwise_count(words[:, None] & masks[None, :]) & 1
    return (parity.astype(np.int64) << np.arange(checks)).sum(axis=1)


def flip_sets(reach: int, checks: int = FULL, bits: int = BITS) -> list[np.ndarray]:
    """For each syndrome, the masks of at most ``reach`` bits that have it."""
    masks = np.array([sum(1 << b for b in some) for n in range(reach + 1) for some in combinations(range(bits), n)], dtype=np.uint64)
    found = syndrome(masks, checks)
    return [masks[found == s] for s in range(1 << checks)]


def replicate(classes: DataFrame, distance: int) -> DataFrame:
    """(fp) to (anchor, fp): every anchor within the covering radius plus half the distance."""
    reach = 1 + (distance + 1) // 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = flip_sets(reach)
        sizes = np.array([len(m) for m in table])
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).view(np.uint64)
                s = syndrome(fps)
                words = np.repeat(fps, sizes[s])
                anchors = words ^ np.concatenate([table[i] for i in s]) if len(s) else words
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(words.view(np.int64))], ["anchor", "fp"])

    return classes.select("fp").mapInArrow(spread, "anchor long, fp long")


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among an anchor's fingerprints."""
    rest, links = list(range(1, len(fps))), []
    frontier = [0]
    while rest:
        if not frontier:
            frontier = [rest.pop(0)]
            continue
        i = frontier.pop()
        left = np.array(rest)
        near = np.bitwise_count(fps[left] ^ fps[i]) <= distance
        links += [(i, int(j)) for j in left[near]]
        frontier += left[near].tolist()
        rest = left[~near].tolist()
    return links


def compare(replicas: DataFrame, distance: int) -> DataFrame:
    """Links (a, b), a < b as signed numbers, between distinct fingerprints of an anchor."""

    def links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

        def link(anchors: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]]) if len(anchors) else np.empty(0, np.int64)
            sizes = np.diff(np.r_[starts, len(anchors)])
            two = starts[sizes == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
            left, right = [two], [two + 1]
            for start, n in zip(starts[sizes > 2], sizes[sizes > 2]):
                pairs = np.array(forest(fps[start : start + n], distance), dtype=np.int64).reshape(-1, 2) + start
                left.append(pairs[:, 0])
                right.append(pairs[:, 1])
            a, b = fps[np.concatenate(left)].view(np.int64), fps[np.concatenate(right)].view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            anchors = np.r_[anchors, batch.column(0).to_numpy(zero_copy_only=False)]
            fps = np.r_[fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            last = np.searchsorted(anchors, anchors[-1]) if len(anchors) else 0
            yield link(anchors[:last], fps[:last])
            anchors, fps = anchors[last:], fps[last:]  # the anchor that may go on in the next batch
        yield link(anchors, fps)

    return replicas.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(links_of, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links reach, for every node with a link. ``links`` should be materialised.

    A node has few links here (a fingerprint has at most 2080 neighbours), so joins on nodes stay even;
    the join on labels is skewed on one side only and both its sides are shuffles Spark can split.
    """
    n = 2 * links.count()
    both = cut_small(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst"))), n)
    labels = cut_small(both.groupBy(F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("label")), n)
    changed = n > 0
    while changed:
        told = both.join(labels, both["src"] == labels["node"]).groupBy("dst").agg(F.min("label").alias("told"))
        met = cut_small(labels.join(told, labels["node"] == told["dst"]).select("node", F.least("label", "told").alias("met"), F.col("label").alias("old")), n)
        up = met.select(F.col("node").alias("via"), F.col("met").alias("top"))
        jumped = cut_small(met.join(up, met["met"] == up["via"]).select("node", F.least("met", "top").alias("label"), "old"), n)
        changed = not jumped.where(F.col("label") != F.col("old")).isEmpty()
        labels = jumped.select("node", "label")
    return labels


def fingerprint_labels(fps: DataFrame, distance: int) -> DataFrame:
    """(fp, label) for distinct fingerprints: the smallest fingerprint that links reach."""
    fps = cut(fps)
    labels = components(cut(compare(replicate(fps, distance), distance)))
    return cut(fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("label")))


def group(docs: DataFrame, distance: int = 2, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row; texts are read once and left behind."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp")))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    named = cut(classes.join(fingerprint_labels(classes.select("fp"), distance), "fp"))
    smallest = cut(named.groupBy("label").agg(F.min("first").alias("component_id")))
    of_class = cut(named.join(smallest, "label").select("fp", "component_id"))
    return rows.join(of_class, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def remix(h: np.ndarray, k: int) -> np.ndarray:
    """A further 64-bit hash of each hash; k = 0 is the hash itself."""
    if k:
        h = h ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def distinct_hashes(tokens: list[bytes], words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    found = [np.unique(h) for h in shingle_hashes(tokens, words)]
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.empty(0, np.uint64)


def signature(distinct: np.ndarray) -> np.ndarray:
    """SIGNATURE_WORDS SimHash words over distinct shingle hashes, as signed integers.

    The similarity that decides is one of sets, so how often a passage is repeated must not count here either.
    """
    out = []
    for k in range(SIGNATURE_WORDS):
        ones = sum((count_bits(remix(distinct[at : at + CHUNK], k)) for at in range(0, len(distinct), CHUNK)), np.zeros(BITS, np.int64))
        out.append(np.packbits(ones * 2 > len(distinct)).view(">i8")[0])
    return np.array(out, dtype=np.int64)


def signature_text(text: str | None) -> list[int] | None:
    """The signature of a text; None for a text without words."""
    tokens = words_of(text)
    return signature(distinct_hashes(tokens, SIGNATURE_SHINGLE)).tolist() if tokens else None


PRINTS = "struct<fp: long, sig: array<long>, h: long>"


def prints(text: Column, words: int) -> Column:
    """The fingerprint of a text, its signature, and a hash of its words in order; the latter two null for texts without words."""

    @F.arrow_udf(PRINTS)
    def of_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        for texts in batches:
            fps, sigs, hs = [], [], []
            for part in parts(texts):
                for t in part.to_pylist():
                    tokens = words_of(t)
                    fps.append(fingerprint_words(tokens, words))
                    sigs.append(signature(distinct_hashes(tokens, SIGNATURE_SHINGLE)).tolist() if tokens else None)
                    hs.append(xxhash.xxh64_intdigest(b" ".join(tokens), SEED) - 2**63 if tokens else None)
            yield pa.StructArray.from_arrays([pa.array(fps, pa.int64()), pa.array(sigs, pa.list_(pa.int64())), pa.array(hs, pa.int64())], ["fp", "sig", "h"])
        give_back()

    return of_texts(text)


def shingle_set(text: Column, words: int) -> Column:
    """The distinct shingles of a text as sorted 32-bit hashes."""

    @F.arrow_udf("binary")
    def of_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets = (np.unique(distinct_hashes(words_of(t), words) >> np.uint64(32)) for part in parts(texts) for t in part.to_pylist())
            yield pa.array([s.astype("<u4").tobytes() for s in sets], pa.binary())
        give_back()

    return of_texts(text)


def sketch(shingles: Column) -> Column:
    """What :func:`pairs_between` judges a shingle set by: a set under SKETCHED itself, else SKETCH_WORDS SimHash words over it and its size."""

    @F.arrow_udf("binary")
    def of_sets(sets: pa.Array) -> pa.Array:
        out = []
        for x in sets:
            h = np.frombuffer(x.as_py(), "<u4")
            if len(h) < SKETCHED:
                out.append(h.tobytes())
                continue
            h = h.astype(np.uint64)
            words = [np.packbits(count_bits(remix(h, k)) * 2 > len(h)).tobytes() for k in range(1, SKETCH_WORDS + 1)]
            out.append(b"".join(words) + struct.pack("<I", len(h)))
        return pa.array(out, pa.binary())

    return of_sets(shingles)


class Sketches:
    """The sketches of an anchor's rows, and which pairs of rows they rule out; an empty sketch rules out none."""

    def __init__(self, sketches: list[bytes]):
        wide = 8 * SKETCH_WORDS
        self.large = np.array([len(x) >= wide for x in sketches], bool)
        self.small = np.array([0 < len(x) < wide for x in sketches], bool)
        self.size = np.array([len(x) // 4 if len(x) < wide else int.from_bytes(x[wide:], "little") for x in sketches], np.int64)
        self.bits = np.frombuffer(b"".join(x[:wide] if len(x) >= wide else bytes(wide) for x in sketches), np.uint64).reshape(-1, SKETCH_WORDS)
        # small sets in rows of SKETCHED, filled up with numbers that no set holds
        self.sets = np.arange(SKETCHED, dtype=np.uint64)[None, :] + np.uint64(1 << 32) + np.zeros((len(sketches), 1), np.uint64)
        for i in np.flatnonzero(self.small):
            self.sets[i, : self.size[i]] = np.frombuffer(sketches[i], "<u4")

    def near(self, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
        """Whether rows a[i] and b[i] may be similar: sizes alone bound a Jaccard similarity, small sets give it, long sketches an estimate."""
        sizes = np.minimum(self.size[a], self.size[b]) / np.maximum(1, np.maximum(self.size[a], self.size[b]))
        out = (sizes >= similarity - 1e-9) | (self.size[a] == 0) | (self.size[b] == 0)
        estimated = np.flatnonzero(out & self.large[a] & self.large[b])
        out[estimated] = np.bitwise_count(self.bits[a[estimated]] ^ self.bits[b[estimated]]).sum(axis=1) <= FAR
        exact = np.flatnonzero(out & self.small[a] & self.small[b])
        left, right = self.sets[a[exact]], self.sets[b[exact]]
        right = np.where(right >> np.uint64(32) > 0, right + np.uint64(1 << 32), right)
        merged = np.sort(np.concatenate([left, right], axis=1), axis=1)
        both = (merged[:, 1:] == merged[:, :-1]).sum(axis=1)
        out[exact] = both >= (similarity - 1e-9) * (self.size[a[exact]] + self.size[b[exact]] - both)
        return out


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two shingle sets; 0 if both are empty."""

    @F.arrow_udf("double")
    def of_sets(lefts: pa.Array, rights: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(lefts, rights):
            x, y = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        return pa.array(out, pa.float64())

    return of_sets(left, right)


def replicate_parts(sets: DataFrame) -> DataFrame:
    """(id, sig) to (cell, id, s): per part of the signature, every anchor within reach of two bits' difference."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = flip_sets(2, PART, PART_BITS)
        sizes = np.array([len(m) for m in table])
        for batch in batches:
            for rows in parts(batch, 1024):
                ids = rows.column("id").to_numpy(zero_copy_only=False)
                sig = rows.column("sig").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SIGNATURE_WORDS)
                for part in range(PARTS):
                    word = sig[:, 1 + part // 2] >> np.uint64(part % 2 * PART_BITS) & np.uint64((1 << PART_BITS) - 1)
                    s = syndrome(word, PART)
                    row = np.repeat(np.arange(len(word)), sizes[s])
                    cells = (word[row] ^ np.concatenate([table[i] for i in s])) | np.uint64(part << PART_BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(ids[row]), pa.array(sig[row, 0].view(np.int64))], ["cell", "id", "s"])
        give_back()

    return sets.select("id", "sig").mapInArrow(spread, "cell long, id long, s long")


def nearest_pairs(ids: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Index pairs (i, j), i < j, of an anchor's rows with their nearest close one, and the rows that have close ones besides. Ties go by a hash of the pair's ids."""
    n, close, found = len(sig), np.zeros(len(sig), np.int64), [np.empty((0, 2), np.int64)]
    mixed = remix(ids.view(np.uint64), 1)
    for at in range(0, n, max(1, BLOCK // n)):
        rows = np.arange(at, min(n, at + max(1, BLOCK // n)))
        d = np.bitwise_count(sig[rows, None] ^ sig[None, :])
        d[np.arange(len(rows)), rows] = BITS + 1
        close[rows] = (d <= CLOSE).sum(axis=1)
        least = d.min(axis=1)
        i, j = np.nonzero((d == least[:, None]) & (least <= CLOSE)[:, None])
        order = np.lexsort((remix(mixed[rows[i]] ^ mixed[j], 2), i))
        i, j = i[order], j[order]
        first = np.r_[True, i[1:] != i[:-1]][: len(i)]
        found.append(np.column_stack([np.minimum(rows[i], j), np.maximum(rows[i], j)])[first])
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs, np.flatnonzero(close > np.bincount(pairs.ravel(), minlength=n)).tolist()


def pairs_between(sig: np.ndarray, label: np.ndarray, sketches: list[bytes] | Sketches, similarity: float = 0.8) -> np.ndarray:
    """Index pairs (i, j), i < j, of rows with different labels that are close in signature and not ruled out by their sketches."""
    n, at, found = len(sig), 0, [np.empty((0, 2), np.int64)]
    held = sketches if isinstance(sketches, Sketches) else Sketches(sketches)
    while at < n - 1 and (label != label[0]).any():
        rows = np.arange(at, min(n - 1, at + max(1, BLOCK // (n - at))))
        behind = np.arange(at + 1, n)
        apart = (label[rows, None] != label[None, behind]) & (behind > rows[:, None])
        i, j = np.nonzero(apart & (np.bitwise_count(sig[rows, None] ^ sig[None, behind]) <= CLOSE))
        i, j = rows[i], behind[j]
        for k in range(0, len(i), BLOCK // SKETCH_WORDS):
            a, b = i[k : k + BLOCK // SKETCH_WORDS], j[k : k + BLOCK // SKETCH_WORDS]
            near = held.near(a, b, similarity)
            found.append(np.column_stack([a[near], b[near]]))
        at = int(rows[-1]) + 1
    return np.concatenate(found)


#: What :func:`candidates` returns: a pair (a, b), or a row (cell, a, s) of an anchor where ``left`` says what is to be done yet.
CANDIDATES = "a long, b long, cell long, s long, left int"
PAIR, REST, CROWD = 0, 1, 2


def anchors(cells: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of rows, sorted by cell, that share a cell."""
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.empty(0, np.int64)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(cells)]))


def ordered_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs of different ids, smaller id first."""
    met = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
    return met[met[:, 0] != met[:, 1]]


def candidates(replicas: DataFrame, most: int | None = MOST) -> DataFrame:
    """What meets at an anchor with close signatures: pairs (a, b), a < b (``left`` = PAIR).

    ``replicas`` (cell, id, s) give the close pair of two rows at an anchor; of more, those with each row's nearest,
    and again as REST the rows of which close pairs are left. Rows of anchors with over ``most`` rows come back as CROWD, one batch at a time.
    """

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_back(rows: np.ndarray, left: int) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), pa.nulls(n, pa.int64()), pa.array(rows[:, 0]), pa.array(rows[:, 2]), pa.array(np.full(n, left, np.int32))], names)

        def link(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            ids, sig, ranges = rows[:, 1], rows[:, 2].view(np.uint64), anchors(rows[:, 0])
            two = np.array([lo for lo, hi in ranges if hi - lo == 2], dtype=np.int64)
            two = two[np.bitwise_count(sig[two] ^ sig[two + 1]) <= CLOSE]
            found = [np.column_stack([two, two + 1])]
            for lo, hi in (r for r in ranges if r[1] - r[0] > 2):
                if most is not None and hi - lo > most:
                    yield rows_back(rows[lo:hi], CROWD)
                    continue
                pairs, more = nearest_pairs(ids[lo:hi], sig[lo:hi])
                found.append(pairs + lo)
                if more:
                    yield rows_back(rows[lo:hi][more], REST)
            at = np.concatenate(found)
            met, n = ordered_pairs(ids[at[:, 0]], ids[at[:, 1]]), pa.nulls
            yield pa.RecordBatch.from_arrays([pa.array(met[:, 0]), pa.array(met[:, 1]), n(len(met), pa.int64()), n(len(met), pa.int64()), pa.array(np.full(len(met), PAIR, np.int32))], names)

        held, crowded = np.empty((0, 3), np.int64), None
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if crowded is not None:  # the anchor of the batch before goes on
                own = int(np.searchsorted(rows[:, 0], crowded, side="right"))
                yield rows_back(rows[:own], CROWD)
                rows = rows[own:]
                crowded = crowded if not len(rows) else None
            held = np.r_[held, rows]
            last = int(np.searchsorted(held[:, 0], held[-1, 0])) if len(held) else 0
            yield from link(held[:last])
            held = held[last:]  # the anchor that may go on in the next batch
            if most is not None and len(held) > most:
                crowded = held[0, 0]
                yield rows_back(held, CROWD)
                held = held[:0]
        yield from link(held)
        give_back()

    names = [c.split()[0] for c in CANDIDATES.split(", ")]
    return replicas.repartition("cell").sortWithinPartitions("cell").mapInArrow(pairs_of, CANDIDATES)


def candidates_between(rows: DataFrame, known: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Pairs (a, b), a < b, with different labels that meet at an anchor, close in signature and not ruled out by their sketches.

    ``rows`` are (cell, id, s), ``known`` is (id, label, sketch). A text stands at some 200 anchors: anchors are dealt in groups, as
    many as keep a group's sketches within GROUP_BYTES, and a text's sketch goes to each group once.
    """

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def link(texts: list[dict]) -> pa.RecordBatch:
            ids, labels = (np.array([t[c] for t in texts], np.int64) for c in ("id", "label"))
            owner = np.repeat(np.arange(len(texts)), [len(t["anchors"]) for t in texts])
            cells, sig = (np.array([x[c] for t in texts for x in t["anchors"]], np.int64) for c in ("cell", "s"))
            order = np.argsort(cells, kind="stable")
            owner, cells, sig = owner[order], cells[order], sig[order].view(np.uint64)
            met = set()
            for lo, hi in anchors(cells):
                held = owner[lo:hi]
                if hi - lo > 1 and (labels[held] != labels[held[0]]).any():
                    at = pairs_between(sig[lo:hi], labels[held], Sketches([texts[i]["sketch"] for i in held]), similarity)
                    met.update(map(tuple, ordered_pairs(ids[held[at[:, 0]]], ids[held[at[:, 1]]]).tolist()))
            found = np.array(sorted(met), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        held: list[dict] = []
        for batch in batches:
            for text in batch.to_pylist():
                if held and text["group"] != held[0]["group"]:
                    yield link(held)
                    held = []
                held.append(text)
        if held:
            yield link(held)
        give_back()

    groups = max(LEAST_GROUPS, -(-rows.count() * (8 * SKETCH_WORDS + 64) // GROUP_BYTES))
    per_text = rows.withColumn("group", F.pmod(F.xxhash64("cell"), F.lit(groups))).groupBy("id", "group").agg(F.collect_list(F.struct("cell", "s")).alias("anchors"))
    per_text = per_text.groupBy("id").agg(F.collect_list(F.struct("group", "anchors")).alias("groups")).join(known, "id")
    dealt = per_text.select("id", "label", "sketch", F.explode("groups").alias("g")).select("g.group", "id", "label", "sketch", "g.anchors")
    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(pairs_of, "a long, b long").distinct()


def split_crowds(rows: DataFrame, block: int = MOST // 4) -> DataFrame:
    """Rows (cell, id, s) of crowded anchors, dealt so that any two rows of an anchor meet in some cell of about two blocks."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__m")).withColumnRenamed("cell", "__cell")
    rows = rows.join(sizes, F.col("cell") == F.col("__cell")).withColumn("__own", F.pmod(F.xxhash64("id"), F.col("__m")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.expr("sequence(0, __m - 1)")))
    return rows.select(F.xxhash64("cell", F.least("__own", "__other"), F.greatest("__own", "__other")).alias("cell"), "id", "s")


def similar_sets(rows: DataFrame, shingles_of: Callable[[DataFrame], DataFrame], similarity: float = 0.8) -> DataFrame:
    """Links (a, b), a < b, between values of h in rows (h, sig) whose shingle sets have the given Jaccard similarity.

    ``shingles_of`` gives (h, shingles) for a table of values of h, and is asked for those of candidates only.
    Links that would join nothing are left out at crowded anchors. ``rows`` should be materialised.
    """

    def linked(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
        left, right = (shingles.select(F.col("h").alias(f"{x}_id"), F.col("shingles").alias(f"{x}_shingles")) for x in "ab")
        both = pairs.join(left, F.col("a") == F.col("a_id")).join(right, F.col("b") == F.col("b_id"))
        return cut(both.where(jaccard(F.col("a_shingles"), F.col("b_shingles")) >= similarity).select("a", "b"))

    sets = rows.groupBy(F.col("h").alias("id")).agg(F.first("sig").alias("sig"))
    of = lambda found, kind: found.where(F.col("left") == kind)
    rows_of = lambda found, kind: of(found, kind).select("cell", F.col("a").alias("id"), "s")
    found = cut(candidates(replicate_parts(sets)))
    crowds = rows_of(found, CROWD)
    if not crowds.isEmpty():
        found = found.unionByName(cut(candidates(split_crowds(crowds), most=None)))
    pairs = cut(of(found, PAIR).select("a", "b").distinct())
    # a row with a close one at an anchor has a pair there, so what follows needs no further shingles
    asked = cut(pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct())
    shingles = cut(shingles_of(asked))
    links, rest = linked(pairs, shingles), rows_of(found, REST)
    if rest.isEmpty():
        return links
    again = cut(rest.select("id").distinct())
    known = shingles.join(narrow_side(again), F.col("h") == F.col("id"), "left_semi").select("h", sketch(F.col("shingles")).alias("sketch"))
    known = known.join(components(links), F.col("h") == F.col("node"), "left").select(F.col("h").alias("id"), F.coalesce("label", "h").alias("label"), "sketch")
    fresh = candidates_between(rest, cut(known), similarity)
    return links.unionByName(linked(fresh.join(pairs, ["a", "b"], "left_anti"), shingles))


def read_shingles(docs: DataFrame, rows: DataFrame, words: int, id_col: str, text_col: str) -> Callable[[DataFrame], DataFrame]:
    """For :func:`similar_sets`: read the texts of ``docs`` again that hold an asked h, one row of ``rows`` (doc_id, digest, h) for each."""

    def of(asked: DataFrame) -> DataFrame:
        first = rows.join(narrow_side(asked), "h", "left_semi").groupBy("h").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("k"))
        first = cut(first.select("h", F.col("k.doc_id").alias("__id"), F.col("k.digest").alias("__digest")))
        texts = docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("__text"))
        found = texts.join(narrow_side(first), F.col("__own").eqNullSafe(F.col("__id")) & (text_digest(F.col("__text")) == F.col("__digest")))
        return found.select("h", shingle_set(F.col("__text"), words).alias("shingles")).dropDuplicates(["h"])

    return of


def text_digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def printed(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, fp, sig, h) of every row, materialised."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_digest(F.col(text_col)).alias("digest"), prints(F.col(text_col), words).alias("p"))
    return cut(rows.select("doc_id", "digest", "p.*"))


def similar(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b), a < b, between ids of texts that are similar; texts with the same words are linked to the one with the smallest id."""
    rows = printed(docs.where(F.col(id_col).isNotNull()), 3, id_col, text_col).where("h is not null")
    links = similar_sets(rows.select("h", "sig"), read_shingles(docs, rows, words, id_col, text_col), similarity)
    first = rows.groupBy(F.col("h").alias("__h")).agg(F.min("doc_id").alias("first"))
    ends = links.join(first, F.col("a") == F.col("__h")).select(F.col("first").alias("x"), "b").join(first, F.col("b") == F.col("__h")).select("x", F.col("first").alias("y"))
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("h").alias("h"))
    same = texts.join(first, F.col("h") == F.col("__h")).where("id <> first").select(F.col("first").alias("x"), F.col("id").alias("y"))
    return ends.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def join_labels(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, h, label) rows and links between values of h to (label, top): what the links, and equal h, make of the labels."""
    of_h = cut(rows.where("h is not null").select("h", "label").distinct())
    firsts = cut(of_h.groupBy("h").agg(F.min("label").alias("top")))
    same = of_h.join(firsts, "h").select(F.col("label").alias("x"), F.col("top").alias("y"))
    ends = links.join(firsts, F.col("a") == F.col("h")).select(F.col("top").alias("x"), "b").join(firsts, F.col("b") == F.col("h")).select("x", F.col("top").alias("y"))
    between = same.unionByName(ends).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return components(cut(between))


def keep_first(docs: DataFrame, distance: int = 2, words: int = 3, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, shingle_words: int = 5) -> DataFrame:
    """One document of each component: the one with the smallest id (then the smallest digest), and a single row of it.

    With ``similarity``, texts that share so much of their shingles of ``shingle_words`` words are
    linked too. Texts are read once for all prints, once for the shingles of
    candidates, and once more to be kept.
    """
    columns, named_by = docs.columns, (id_col, text_col)
    docs, id_col, text_col = packed(docs, id_col, text_col), "doc_id", "text"
    digest = text_digest(docs[text_col])
    if similarity is None:
        rows = cut(docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest"), fingerprint(F.col(text_col), words).alias("fp"), F.lit(None).cast("long").alias("h")))
    else:
        rows = printed(docs, words, id_col, text_col)
    labels = fingerprint_labels(rows.select("fp").distinct(), distance)
    named = rows.join(labels, "fp").select("doc_id", "digest", "h", "label")
    if similarity is not None:
        named = cut(named)
        read = read_shingles(docs, rows.select("doc_id", "digest", "h"), shingle_words, id_col, text_col)
        tops = join_labels(named, similar_sets(rows.where("h is not null").select("h", "sig"), read, similarity))
        tops = tops.select("node", F.col("label").alias("top"))
        named = named.join(tops, F.col("label") == F.col("node"), "left").select("doc_id", "digest", F.coalesce("top", "label").alias("label"))
    keys = named.select("label", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest").alias("k"))
    first = cut(keys.groupBy("label").agg(F.min("k").alias("first")))
    gone = cut(keys.join(first, "label").groupBy("k").agg(F.max(F.col("k") == F.col("first")).alias("stays")).where("not stays").select(F.col("k.doc_id").alias("__id"), F.col("k.digest").alias("__digest")))
    kept = docs.join(narrow_side(gone), docs[id_col].eqNullSafe(F.col("__id")) & (digest == F.col("__digest")), "left_anti")
    repeated = not rows.groupBy("doc_id", "digest").count().where("count > 1").isEmpty()
    if repeated:  # sorting texts pays only then
        kept = kept.withColumn("__digest", digest).dropDuplicates([id_col, "__digest"]).drop("__digest")
    return unpacked(kept, columns, *named_by)
