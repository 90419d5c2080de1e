"""Matroska and WebM as tables: elements are walked once per file, laces are parted by expressions.

The walker yields the track entries and the blocks with their times, flags and lace header; sizes
of laced frames and times of frames follow from it in Spark. Damaged files give the rows up to the damage and one row with ``error``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinograph.sources.containers import DEEPEST, unpack, walk

#: Ids of the elements that hold elements, and of those that are read.
PARENTS = {0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE0, 0xE1, 0x1F43B675, 0xA0}
#: Those that are entered on the way; those that no segment holds; those that a segment holds, which end a cluster of unknown size.
DESCENDED, TOP = {0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675}, {0x1A45DFA3, 0x18538067}
IN_SEGMENT = {0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x1941A469, 0x1043A770, 0x1254C367}
SEGMENT, INFO, CLUSTER, TRACK, GROUP = 0x18538067, 0x1549A966, 0x1F43B675, 0xAE, 0xA0
SCALE, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK, BLOCK_DURATION = 0x2AD7B1, 0xE7, 0xA3, 0xA1, 0x9B
TRACK_FIELDS = {0xD7: "number", 0x83: "type", 0x86: "codec", 0xB0: "width", 0xBA: "height", 0xB5: "rate", 0x9F: "channels", 0x23E383: "frame_ns", 0x22B59C: "language"}
TRACK_TYPES = {1: "video", 2: "audio", 17: "subtitle"}
SCHEMA = "what string, track long, type string, codec string, width long, height long, rate double, channels long, language string, frame_ns long, at_ns long, ticks long, scale_ns long, is_key boolean, discardable boolean, lacing int, sizes array<long>, offset long, size long"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """A variable-length number and the place behind it; None is the number of unknown size."""
    first = data[at]
    if not first:
        raise ValueError("number longer than eight bytes")
    length = 9 - first.bit_length()
    value = int.from_bytes(data[at : at + length], "big")
    if at + length > len(data):
        raise ValueError("cut off in a number")
    if keep_marker:
        return value, at + length
    value &= (1 << 7 * length) - 1
    return None if value == (1 << 7 * length) - 1 else value, at + length


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block's payload and where the first one starts. Lacing 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not lacing:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        sizes = [(end - at) // n] * (n - 1)
    for i in range(n - 1 if lacing != 2 else 0):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
        else:
            before = at
            value, at = vint(data, at)
            value = (1 << 7 * (at - before)) - 1 if value is None else value
            sizes.append(value if i == 0 else sizes[-1] + value - (1 << 7 * (at - before) - 1) + 1)
    rest = end - at - sum(sizes)
    if rest < 0 or any(s < 0 for s in sizes):
        raise ValueError("laces longer than their block")
    return [*sizes, rest], at


def element_at(data: bytes, at: int) -> tuple[int, int | None, int]:
    """Id, size (None: unknown) and the place of the contents of the element at a place."""
    name, at = vint(data, at, keep_marker=True)
    size, at = vint(data, at)
    return name, size, at


def elements(data: bytes, a: int, b: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements side by side between two places."""
    while a < b:
        name, size, a = element_at(data, a)
        end = b if size is None else a + size
        if end > b:
            raise ValueError(f"cut off in element {name:X}")
        yield name, a, end
        a = end


def mkv_walker(data: bytes, at: int = 0, until: int | None = None, scale: int = 1_000_000) -> Iterator[tuple]:
    """A row for each track entry and block, in file order; from ``at`` up to the cluster that starts at ``until`` or later.

    A cluster or segment of unknown size ends where an element of its own level or a higher one starts, so
    the clusters of a live recording lie side by side. ``data`` may be anything that can be sliced into bytes.
    """
    state = {"scale": scale, "cluster": 0}

    def row(**values) -> tuple:
        return tuple(values.get(n) for n in NAMES)

    def number(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def block(a: int, b: int, simple: bool, ticks: int = 0) -> tuple:
        track, at = vint(data, a)
        relative, flags = unpack(">hB", data, at)
        sizes, start = lace_sizes(data, at + 3, b, flags >> 1 & 3)
        ns = (state["cluster"] + relative) * state["scale"]
        return row(what="block", track=track, at_ns=ns, ticks=ticks, scale_ns=state["scale"], is_key=simple and bool(flags & 0x80), discardable=bool(flags & 1), lacing=flags >> 1 & 3, sizes=sizes, offset=start, size=b - start)

    def leaves(a: int, b: int, level: int = 0) -> Iterator[tuple[int, int, int]]:
        if level > DEEPEST:
            raise ValueError("elements nested too deeply")
        for name, start, end in elements(data, a, b):
            if name in PARENTS:
                yield from leaves(start, end, level + 1)
            else:
                yield name, start, end

    def entry(a: int, b: int) -> tuple:
        found: dict = {}
        for leaf, x, y in leaves(a, b):
            field = TRACK_FIELDS.get(leaf)
            if field in ("codec", "language"):
                found[field] = data[x:y].rstrip(b"\x00").decode("latin-1")
            elif field == "rate":
                found[field] = struct.unpack(">f" if y - x == 4 else ">d", data[x:y])[0]
            elif field:
                found[field] = number(x, y)
        return row(what="track", track=found.pop("number", 0), **found | {"type": TRACK_TYPES.get(found.get("type"), "other")})

    whole, short = len(data), []
    open_ends: list[tuple[int, int | None]] = []  # (id, end) of the elements that are open, None for an unknown size
    while at < whole:
        while open_ends and open_ends[-1][1] is not None and at >= open_ends[-1][1]:
            open_ends.pop()
        name, size, start = element_at(data, at)
        if name in TOP or name in IN_SEGMENT:
            while open_ends and open_ends[-1][1] is None and (name in TOP or open_ends[-1][0] != SEGMENT):
                open_ends.pop()
        if name == CLUSTER and until is not None and at >= until:
            return
        limit = next((end for _, end in reversed(open_ends) if end is not None), whole)
        end = limit if size is None else start + size
        if end > limit and name not in DESCENDED:
            raise ValueError(f"cut off in element {name:X}")
        if name in DESCENDED:
            if len(open_ends) > DEEPEST:
                raise ValueError("elements nested too deeply")
            open_ends.append((name, None if size is None else end if end <= limit else limit))
            if end > limit:
                short.append(name)
            if name == CLUSTER:
                state["cluster"] = 0
            at = start
            continue
        if name == TRACK:
            yield entry(start, end)
        elif name == GROUP:
            parts = {leaf: (x, y) for leaf, x, y in elements(data, start, end)}
            if BLOCK in parts:
                yield block(*parts[BLOCK], False, number(*parts[BLOCK_DURATION]) if BLOCK_DURATION in parts else 0)
        elif name == SCALE:
            state["scale"] = number(start, end)
        elif name == CLUSTER_TIME:
            state["cluster"] = number(start, end)
        elif name == SIMPLE_BLOCK:
            yield block(start, end, True)
        at = end
    if short:
        raise ValueError(f"cut off in element {short[-1]:X}")


def mkv_rows(found: DataFrame) -> DataFrame:
    """All rows of the walker, damage reports included."""
    return walk(found, mkv_walker, SCHEMA)


def mkv_tracks(rows: DataFrame) -> DataFrame:
    """(path, track, type, codec, width, height, rate, channels, language, frame_ns) of :func:`mkv_rows`."""
    return rows.where("what = 'track'").select("path", "track", "type", "codec", "width", "height", "rate", "channels", "language", "frame_ns")


def mkv_packets(rows: DataFrame) -> DataFrame:
    """A row per frame of :func:`mkv_rows`: the frames of a block share its duration, and the first keeps its key flag."""
    times = mkv_tracks(rows).groupBy("path", "track").agg(F.max("frame_ns").alias("__frame_ns"))
    blocks = rows.where("what = 'block'").join(times.hint("shuffle_hash"), ["path", "track"], "left")
    whole: Column = F.coalesce(F.nullif("__frame_ns", F.lit(0).cast("long")), F.nullif(F.col("ticks") * F.col("scale_ns"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    blocks = blocks.withColumn("dur_ns", F.call_function("div", whole, F.size("sizes").cast("long")))
    frames = blocks.select("path", "seq", "track", "at_ns", "dur_ns", "is_key", "discardable", "offset", "sizes", F.posexplode("sizes").alias("lace", "size"))
    before = F.aggregate(F.slice("sizes", 1, F.col("lace")), F.lit(0).cast("long"), lambda a, x: a + x)
    micros = lambda ns: F.call_function("div", ns, F.lit(1000).cast("long"))
    return frames.where("size > 0").select(
        "path", "seq", "lace", "track", micros(F.col("at_ns") + F.col("lace") * F.col("dur_ns")).alias("pts_us"), micros(F.col("dur_ns")).alias("dur_us"),
        (F.col("is_key") & (F.col("lace") == 0)).alias("is_key"), "discardable", (F.col("offset") + before).alias("offset"), "size",
    )


def mkv_clusters(packets: DataFrame) -> DataFrame:
    """Frames, bytes and first time per track and second of the file: what an iteration over clusters hands on."""
    return packets.groupBy("path", "track", F.call_function("div", F.col("pts_us"), F.lit(1_000_000).cast("long")).alias("second")).agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"), F.min("pts_us").alias("first_us"))
