"""Packing by minimum bin slack: token sequences of a fixed capacity with hardly any padding.

A document's tokens are cut into full windows and one shorter rest. What then needs packing is a
multiset of lengths below the capacity, and equal lengths are interchangeable, so the plan needs
only their histogram: at most ``capacity`` counters, whatever the corpus. For each window the
longest remaining length is set, a bitset subset-sum over the remaining multiset finds the sum
closest to what is left, and backtracking gives the counts taken. A pattern found is used as often
as the histogram allows, which uses up at least one of its lengths, so there are few patterns.

The pieces find their place by rank: within each length they are numbered in parallel
(:func:`kinograph.llm.common.group_rank`), and the pattern whose rank range covers the number says
sequence and offset. The plan is bounded by the capacity, never by the data, so it is broadcast.

Cases: a null or empty text is the end token alone; repeated rows are packed once each; ids may be
null; a text of any length is cut into as many windows as it fills; an empty table gives an empty
result. The piece table holds ids, never texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import buckets_for, cut, give_back, group_rank, parts_of_bytes
from kinograph.llm.tokens import Encoder

#: Bytes of texts that are encoded at a time, or one text if it is longer; a task holds some twenty times that beside them.
BYTES_AT_ONCE = 2 << 20
PLAN_SCHEMA = "p_length int, p_from long, p_to long, p_each int, p_sequence long, p_offset int"


def fullest_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, the longest one included, whose sum is closest to ``capacity``.

    Multiplicities are split into powers of two; ``reach[i]`` has bit s set if the first i parts can
    make the sum s. Backtracking walks the parts from the last to the first.
    """
    longest = max(counts)
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    parts: list[tuple[int, int]] = []
    reach = [1]
    full = 1 << room
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length] - (length == longest), room // length), 1
        while left > 0 and not reach[-1] & full:
            n = min(step, left)
            parts.append((length, n))
            reach.append((reach[-1] | reach[-1] << length * n) & mask)
            left, step = left - n, step * 2
    best = reach[-1].bit_length() - 1
    taken = {longest: 1}
    for (length, n), before in zip(reversed(parts), reversed(reach[:-1])):
        if not before >> best & 1:
            taken[length] = taken.get(length, 0) + n
            best -= length * n
    return taken


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from rank, to rank, per window, first window, offset) that place every rank of every length."""
    left = {k: v for k, v in histogram.items() if v > 0}
    used: dict[int, int] = dict.fromkeys(left, 0)
    rows, window = [], 0
    while left:
        taken = fullest_window(left, capacity)
        times = min(left[k] // n for k, n in taken.items())
        offset = 0
        for length in sorted(taken, reverse=True):
            n = taken[length]
            rows.append((length, used[length], used[length] + n * times, n, window, offset))
            offset += length * n
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        window += times
    return rows


def cut_pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Tokenise whole texts and cut them: (doc_id, start, length, ids_crc32, doc_tokens, ids) per piece.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers, null unless ``with_ids``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for part in parts_of_bytes(batch, 1, BYTES_AT_ONCE):
                rows = []
                found, upto = encoder.encode_array(part.column(1))
                data, at = found.tobytes(), upto.tolist()
                for i, (a, b) in enumerate(zip(at, at[1:])):
                    ids = data[a * 4 : b * 4] + end
                    for start in range(0, len(ids), capacity * 4):
                        piece = ids[start : start + capacity * 4]
                        rows.append((i, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece if with_ids else None))
                where, *columns = zip(*rows)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                arrays = [part.column(0).take(pa.array(where)), *[pa.array(c, t) for c, t in zip(columns, kinds)]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        del encoder
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length int, ids_crc32 long, doc_tokens long, ids binary"
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(cut_batches, schema)


def assign(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, start and length (1 to ``capacity``).

    ``pieces`` should be narrow and materialised: it is read once for the histogram, once to place.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    plan = plan_windows(histogram, capacity)
    n = buckets_for(sum(histogram.values()))
    placed = pieces.withColumn("__b", F.pmod(F.xxhash64("doc_id", "start"), F.lit(n)).cast("int"))
    placed = group_rank(placed, ["length"], "__b", [F.col("doc_id"), F.col("start")], "__r").drop("__b")
    slots = F.broadcast(spark.createDataFrame(plan, PLAN_SCHEMA))
    placed = placed.join(slots, (F.col("length") == F.col("p_length")) & (F.col("__r") >= F.col("p_from")) & (F.col("__r") < F.col("p_to")))
    place = {
        "sequence_id": F.expr("p_sequence + (__r - p_from) div p_each"),
        "offset": F.expr("p_offset + length * ((__r - p_from) % p_each)").cast("long"),
    }
    return placed.withColumns(place).drop("__r", *[c.split()[0] for c in PLAN_SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    narrow = cut(cut_pieces(docs, tokenizer_json, capacity, end_id, id_col, text_col, with_ids=False).drop("ids"))
    return assign(narrow, capacity).withColumn("length", F.col("length").cast("long"))


def sequences(docs: DataFrame, tokenizer_json: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, n_pieces and ids (bytes, unpadded).

    Ids are shuffled once, to their sequence; a sequence holds ``capacity`` ids at most.
    """
    pieces = cut_pieces(docs, tokenizer_json, capacity, end_id, id_col, text_col)
    packed = assign(cut(pieces), capacity)
    part = F.struct("offset", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    total = F.aggregate("parts", F.lit(0), lambda a, x: a + x["length"])
    return rows.select("sequence_id", total.alias("n_tokens"), F.size("parts").alias("n_pieces"), ids.alias("ids"))
