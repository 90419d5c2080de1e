"""Media containers as tables: Spark reads and deals the files, a small walker lists their parts, Spark does the rest.

A walker yields what a file says, in file order; damaged or cut files give the rows up to the damage
and one row with ``error``, and never fail the job. Numbering, running offsets, time stamps
and reassembly are window functions and joins over those rows. All times are microseconds.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.functions.curves import sign_extend

#: Rows that are sent on together.
AT_ONCE = 10_000
ARROW = {"array<long>": pa.list_(pa.int64()), "double": pa.float64(), "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


#: What a walker raises for bytes that are no container, or a damaged one.
DAMAGE = (ValueError, IndexError, struct.error, OverflowError, RecursionError)
#: Levels of boxes or elements inside each other that are followed.
DEEPEST = 32


def unpack(form: str, data: bytes, at: int) -> tuple:
    """Numbers at a place; ``data`` may be anything that can be sliced into bytes."""
    return struct.unpack(form, data[at : at + struct.calcsize(form)])


def walk_fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in f"path string, seq long, {schema}, error string".split(", ")]


def fits(row: tuple) -> tuple:
    """The row, if all its numbers have 64 bits."""
    if any(type(v) is int and not -(2**63) <= v < 2**63 for v in row):
        raise OverflowError("a number over 64 bits")
    return row


def walked(found: Iterable[tuple[str, Iterator[tuple], int]], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of walkers, given as (path, rows, number of the first row), as batches of a ``walk`` table; damage ends a file's rows with one that says so."""
    rows, width = [], len(arrow) - 3
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)
    for path, entries, seq in found:
        more = True
        while more:
            try:
                rows.append((path, seq, *fits(next(entries)), None))
                seq += 1
            except StopIteration:
                more = False
            except DAMAGE as e:
                rows.append((path, seq, *[None] * width, str(e) or type(e).__name__))
                more = False
            if len(rows) == AT_ONCE:
                yield flush()
                rows = []
    if rows:
        yield flush()


def walk(found: DataFrame, walker: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """(path, seq, *schema, error): the rows of ``walker`` for each file, in order."""
    fields = walk_fields(schema)
    arrow = pa.schema([(n, ARROW[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = (f for batch in batches for f in zip(batch.column(0), batch.column(1)))
        yield from walked(((path.as_py(), walker(content.as_py() or b""), 0) for path, content in contents), arrow)

    return found.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in fields))


#: Enhanced codecs whose coded frames carry a composition offset.
FLV_WITH_OFFSETS = (b"avc1", b"hvc1")


def flv_walker(data: bytes) -> Iterator[tuple]:
    """(kind, dts_ms, cts, is_key, is_config, offset, size) per tag."""
    if data[:3] != b"FLV":
        raise ValueError("no FLV signature")
    at = struct.unpack_from(">I", data, 5)[0] + 4
    while at + 11 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        dts = int.from_bytes(data[at + 4 : at + 7], "big") | data[at + 7] << 24
        body = at + 11
        if body + size > len(data):
            raise ValueError("cut off in a tag")
        first = data[body] if size else 0
        cts, config = 0, False
        if kind == 9 and first & 0x80 and size >= 5:  # enhanced header: packet type, then the codec's four characters
            config = first & 15 == 0
            cts = int.from_bytes(data[body + 5 : body + 8], "big") if first & 15 == 1 and size >= 8 and data[body + 1 : body + 5] in FLV_WITH_OFFSETS else 0
        elif kind == 9 and first & 15 in (7, 12) and size >= 5:
            config = data[body + 1] == 0
            cts = int.from_bytes(data[body + 2 : body + 5], "big") if data[body + 1] == 1 else 0
        elif kind == 8 and size >= 2 and first >> 4 == 10:
            config = data[body + 1] == 0
        yield {8: "audio", 9: "video", 18: "script"}.get(kind, "other"), dts, cts, kind == 9 and first >> 4 & 7 == 1, config, body, size
        at = body + size + 4


def damage(found: DataFrame, walker: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """(path, seq, error) of the files that are not whole: after how many entries, and what is wrong."""
    return walk(found, walker, schema).where("error is not null").select("path", "seq", "error")


def flv_packets(found: DataFrame) -> DataFrame:
    tags = walk(found, flv_walker, "kind string, dts_ms long, cts long, is_key boolean, is_config boolean, offset long, size long")
    dts = F.col("dts_ms") * 1000
    return tags.select("path", "seq", "kind", dts.alias("dts_us"), (dts + sign_extend(F.col("cts")) * 1000).alias("pts_us"), "is_key", "is_config", "offset", "size", "error")


def find(data: bytes, what: bytes, at: int) -> int:
    """The first place of ``what`` from ``at`` on, -1 if there is none; ``data`` may be anything that can be sliced into bytes."""
    step = len(what)
    while at < len(data):
        found = data[at : at + step + len(what) - 1].find(what)
        if found >= 0:
            return at + found
        at, step = at + step, min(step * 2, 1 << 16)
    return -1


OGG_SCHEMA = "serial long, page long, granule long, offset long, size long"


def ogg_walker(data: bytes) -> Iterator[tuple]:
    """(serial, page, granule, segment sizes' offset and size) per segment; pages with a wrong checksum are skipped."""
    at = find(data, b"OggS", 0)
    while at >= 0 and at + 27 <= len(data):
        granule, serial, page, crc = unpack("<qIII", data, at + 6)
        n = data[at + 26]
        sizes = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(sizes)
        if end <= len(data) and ogg_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) == crc:
            body = at + 27 + n
            for size in sizes:
                yield serial, page, granule, body, size
                body += size
            at = find(data, b"OggS", end)
        else:
            at = find(data, b"OggS", at + 4)


#: Each byte with its bits in reverse.
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def ogg_crc(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, not reflected, start and end at zero: the reflected one of reversed bytes, reversed."""
    reflected = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{reflected:032b}"[::-1], 2)


def ogg_packets(found: DataFrame) -> DataFrame:
    """Packets of every stream of files (path, content)."""
    return ogg_joined(walk(found, ogg_walker, OGG_SCHEMA))


def ogg_joined(rows: DataFrame) -> DataFrame:
    """Packets per stream of the walker's rows: a packet ends with a segment under 255 bytes, whatever page it is on."""
    parts = rows.where("error is null")
    before = Window.partitionBy("path", "serial").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    numbered = parts.withColumn("packet", F.coalesce(F.sum(F.when(F.col("size") < 255, 1).otherwise(0)).over(before), F.lit(0)))
    return numbered.groupBy("path", "serial", "packet").agg(F.min("offset").alias("offset"), F.sum("size").alias("size"), F.max("page").alias("page"), F.max("granule").alias("granule"), (F.min("size") < 255).alias("complete"))


def avi_walker(data: bytes) -> Iterator[tuple]:
    """(stream, kind, rate, scale, offset, size): stream headers and places of long indexes first, then ``movi`` and its chunks, and the short index."""
    if data[:4] != b"RIFF":
        raise ValueError("no RIFF signature")
    at, streams = 12, 0
    while at + 8 <= len(data):
        tag, size = data[at : at + 4], unpack("<I", data, at + 4)[0]
        if tag in (b"LIST", b"RIFF"):  # long files go on in a further RIFF
            if data[at + 8 : at + 12] == b"movi":
                yield 0, "movi", None, None, at + 8, 0
            at += 12
            continue
        if at + 8 + size > len(data):
            raise ValueError("cut off in a chunk")
        if tag == b"strh":
            scale, rate = unpack("<II", data, at + 28)
            yield streams, data[at + 8 : at + 12].decode("latin-1"), rate, scale, at + 8, 0
            streams += 1
        elif tag == b"indx" and data[at + 11] == 0:  # an index of indexes
            yield from long_index(data, at + 8, size, max(0, streams - 1))
        elif tag[:2].isdigit() and tag[2:] in (b"dc", b"db", b"wb"):
            yield int(tag[:2]), "chunk", None, None, at + 8, size
        elif tag == b"idx1":  # flags take the place of the rate; the place is the chunk's, absolute or from "movi" on
            for i in range(at + 8, at + 8 + size - 15, 16):
                name, flags, place, length = unpack("<4sIII", data, i)
                if name[:2].isdigit():
                    yield int(name[:2]), "index", flags, None, place, length
        at += 8 + size + (size & 1)


def long_index(data: bytes, at: int, size: int, stream: int) -> Iterator[tuple]:
    """Rows (stream, "long index", flags, None, place of the data, size) of the indexes that an index of indexes points to."""
    longs, _, _, used = unpack("<HBBI", data, at)
    for i in range(min(used, (size - 24) // max(16, 4 * longs))):
        place, length, _ = unpack("<QII", data, at + 24 + i * max(16, 4 * longs))
        if not place or not length or place + 32 > len(data):
            continue
        place += 8 if data[place : place + 2] == b"ix" else 0
        entries, base = unpack("<I", data, place + 4)[0], unpack("<Q", data, place + 12)[0]
        for j in range(min(entries, (len(data) - place - 24) // 8)):
            offset, length = unpack("<II", data, place + 24 + 8 * j)
            yield stream, "long index", 0 if length >> 31 else 0x10, None, base + offset, length & 0x7FFFFFFF


def avi_packets(found: DataFrame) -> DataFrame:
    """Samples with their presentation time: the sample's number in its stream times scale / rate.

    Samples are those of the long index where a stream has one, else of the short index, else the chunks themselves; without
    an index every chunk may be decoded alone. Places of the short index are absolute if the first lies behind
    the start of ``movi``, else they count from there.
    """
    rows = walk(found, avi_walker, AVI_SCHEMA).where("error is null")
    held = ("chunk", "index", "long index")
    heads = rows.where(~F.col("kind").isin(*held, "movi")).select("path", "stream", F.col("kind").alias("type"), F.col("rate").alias("per"), F.col("scale").alias("of"))
    movi = rows.where("kind = 'movi'").groupBy("path").agg(F.min("offset").alias("movi"))
    first = rows.where("kind = 'index'").groupBy("path").agg(F.min_by("offset", "seq").alias("first"))
    rank = F.array_position(F.array(*map(F.lit, held)), F.col("kind"))
    known = rows.where(F.col("kind").isin(*held)).withColumn("best", F.max(rank).over(Window.partitionBy("path", "stream"))).where(F.col("best") == rank)
    known = known.join(movi, "path", "left").join(first, "path", "left")
    place = F.when(F.col("kind") != "index", F.col("offset")).when(F.col("first") >= F.col("movi"), F.col("offset") + 8).otherwise(F.coalesce("movi", F.lit(0)) + F.col("offset") + 8)
    is_key = (F.col("kind") == "chunk") | (F.col("rate").bitwiseAND(F.lit(0x10).cast("long")) != 0)
    n = F.row_number().over(Window.partitionBy("path", "stream").orderBy("seq")).cast("long") - 1
    out = known.select("path", "stream", n.alias("n"), place.alias("offset"), "size", F.coalesce(is_key, F.lit(True)).alias("is_key")).join(heads, ["path", "stream"])
    return out.select("path", "stream", "type", "n", F.expr("n * of * 1000000 div per").alias("pts_us"), "offset", "size", "is_key")


AVI_SCHEMA = "stream int, kind string, rate long, scale long, offset long, size long"


#: Boxes that hold boxes.
MP4_PARENTS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"moof", b"traf")
#: Boxes with a codec's configuration, and how far a sample entry's own fields reach by the kind of track.
MP4_CONFIGS, MP4_ENTRY = (b"avcC", b"hvcC", b"av1C", b"vpcC", b"esds", b"dOps"), {b"vide": 86, b"soun": 36}
MP4_SCHEMA = "track int, what string, a long, b long, c long, data binary"


def mp4_walker(data: bytes) -> Iterator[tuple]:
    """(track, what, a, b, c, data): entries of the sample tables, track headers (``tkhd``: id, width, height), time scales
    (``mdhd``), handlers, sample entries (``stsd:`` and the codec, with its configuration), and the runs of fragments."""
    track, kind_of_track = -1, b""

    def boxes(at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
        while at + 8 <= end:
            size, name = unpack(">I4s", data, at)
            head = 8
            if size == 1:
                size, head = unpack(">Q", data, at + 8)[0], 16
            size = size or end - at
            if size < head or at + size > end:
                raise ValueError(f"cut off in box {name.decode('latin-1')}")
            yield name, at + head, at + size
            at += size

    def inside(at: int, end: int, level: int = 0) -> Iterator[tuple]:
        nonlocal track, kind_of_track
        if level > DEEPEST:
            raise ValueError("boxes nested too deeply")
        for name, a, b in boxes(at, end):
            if name == b"trak":
                track += 1
            if name in MP4_PARENTS:
                yield from inside(a, b, level + 1)
            elif name == b"mdhd":
                yield track, "mdhd", unpack(">I", data, a + (20 if data[a] else 12))[0], 0, 0, None
            elif name == b"tkhd":
                wide = 12 if data[a] else 0
                yield track, "tkhd", unpack(">I", data, a + (20 if data[a] else 12))[0], *(x >> 16 for x in unpack(">II", data, a + 76 + wide)), None
            elif name == b"hdlr":
                kind_of_track = data[a + 8 : a + 12]
                yield track, kind_of_track.decode("latin-1"), 0, 0, 0, None
            elif name == b"stsd":
                for entry, x, y in boxes(a + 8, b):
                    reach = x - 8 + MP4_ENTRY.get(kind_of_track, y - x + 8)
                    config = next((data[p:q] for inner, p, q in boxes(reach, y) if inner in MP4_CONFIGS), None) if reach < y else None
                    yield track, "stsd:" + entry.decode("latin-1"), 0, 0, 0, config
            elif name == b"tfdt":
                yield 0, "tfdt", unpack(">Q" if data[a] else ">I", data, a + 4)[0], 0, 0, None
            elif name == b"trun":
                flags, count = unpack(">II", data, a)
                at_run = a + 8 + 4 * (flags & 1) + (flags & 4)
                fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
                step = 4 * len(fields)
                for entry in struct.iter_unpack(f">{len(fields)}I", data[at_run : at_run + step * min(count, (b - at_run) // step)]) if fields else ():
                    values = dict(zip(fields, entry))
                    yield 0, "trun", values.get(0x100, 0), values.get(0x200, 0), values.get(0x400, 0), None
            elif name in (b"stts", b"ctts", b"stsc", b"stco", b"co64", b"stss", b"stsz"):
                kind = name.decode()
                fields = {"stts": ">II", "ctts": ">Ii", "stsc": ">III", "co64": ">Q"}.get(kind, ">I")
                start = a + (8 if kind != "stsz" else 12)
                count = unpack(">I", data, start - 4)[0]
                same = unpack(">I", data, a + 4)[0] if kind == "stsz" else 0
                if same:
                    for _ in range(min(count, len(data) // same)):  # no file holds more samples than fit it
                        yield track, kind, same, 0, 0, None
                    continue
                step = struct.calcsize(fields)
                for values in struct.iter_unpack(fields, data[start : start + step * min(count, (b - start) // step)]):
                    yield track, "stco" if kind == "co64" else kind, *values, *[0] * (3 - len(values)), None

    yield from inside(0, len(data))


def mp4_rows(found: DataFrame) -> DataFrame:
    """All rows of the walker, damage reports included."""
    return walk(found, mp4_walker, MP4_SCHEMA)


def mp4_packets(found: DataFrame) -> DataFrame:
    """Samples of every track of files (path, content)."""
    return mp4_samples(mp4_rows(found))


def mp4_samples(rows: DataFrame) -> DataFrame:
    """Samples of every track, from the run-length tables of :func:`mp4_rows`: times, composition offsets, chunks, sizes, key flags."""
    rows = rows.where("error is null")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("path", "track", "what").orderBy("seq")).cast("long"))
    on, by_n = ["path", "track"], Window.partitionBy("path", "track").orderBy("n")
    of = lambda what: rows.where(F.col("what") == what)
    sample = Window.partitionBy(*on).orderBy("n", "k")

    def expanded(what: str) -> DataFrame:
        runs = of(what).where("a > 0").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("a"))))
        return runs.withColumn("sample", F.row_number().over(sample).cast("long"))

    timed = expanded("stts").withColumn("dts", F.coalesce(F.sum("b").over(sample.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(*on, "sample", "dts", F.col("b").alias("duration"))
    shift = expanded("ctts").select(*on, "sample", F.col("b").alias("cts"))
    sizes = of("stsz").select(*on, F.col("n").alias("sample"), F.col("a").alias("size"))
    chunks = of("stco").select(*on, F.col("n").alias("chunk"), F.col("a").alias("start"))
    spans = of("stsc").select(*on, F.col("a").alias("first"), F.col("b").alias("per"), (F.coalesce(F.lead("a").over(by_n), F.lit(2**62)) - 1).alias("last"))
    spans = spans.join(chunks.groupBy(*on).agg(F.max("chunk").alias("chunks")).hint("merge"), on).where("first <= least(last, chunks)")
    held = spans.select(*on, F.explode(F.expr("sequence(first, least(last, chunks))")).alias("chunk"), "per").where("per > 0").select(*on, "chunk", F.explode(F.expr("sequence(1L, per)")).alias("k"))
    held = held.withColumn("sample", F.row_number().over(Window.partitionBy(*on).orderBy("chunk", "k")).cast("long"))
    placed = held.join(sizes.hint("merge"), [*on, "sample"]).join(chunks.hint("merge"), [*on, "chunk"])  # no side is broadcast: each grows with the files
    within = Window.partitionBy(*on, "chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    keys = of("stss").select(*on, F.col("a").alias("sample"), F.lit(True).alias("listed"))
    has_keys = of("stss").groupBy(*on).agg(F.lit(True).alias("has_keys"))
    scale = of("mdhd").select(*on, F.col("a").alias("timescale"))
    kinds = rows.where("what in ('vide', 'soun', 'text', 'sbtl')").select(*on, F.col("what").alias("type"))
    out = placed.join(timed.hint("merge"), [*on, "sample"]).join(shift.hint("merge"), [*on, "sample"], "left").join(keys.hint("merge"), [*on, "sample"], "left")
    out = out.join(has_keys.hint("merge"), on, "left").join(scale.hint("merge"), on).join(kinds.hint("merge"), on, "left")
    micros = lambda c: F.call_function("div", c * 1_000_000, F.col("timescale"))
    is_key = F.when(F.col("has_keys"), F.coalesce("listed", F.lit(False))).otherwise(True)
    return out.select(*on, "type", "sample", micros(F.col("dts")).alias("dts_us"), micros(F.col("dts") + F.coalesce("cts", F.lit(0))).alias("pts_us"), micros(F.col("duration")).alias("dur_us"), is_key.alias("is_key"), "offset", "size")


def codec_string(entry: Column, config: Column) -> Column:
    """The codec of a sample entry with profile and level, as media players name it; its common default without a configuration.

    VP9 is read where its configuration box has profile, level and depth: behind version and flags.
    """
    byte = lambda i: F.conv(F.hex(F.substring(config, i, 1)), 16, 10).cast("int")
    hexed = lambda i: F.lower(F.hex(F.substring(config, i, 1)))
    bits = lambda i, shift, mask: F.shiftright(byte(i), shift).bitwiseAND(F.lit(mask))
    text = lambda c: c.cast("string")
    two = lambda c: F.lpad(text(c), 2, "0")
    given = lambda n: F.length(config) >= n
    space = F.get(F.array(*map(F.lit, ("", "A", "B", "C"))), bits(2, 6, 3))
    hevc = F.concat(entry, F.lit("."), space, text(bits(2, 0, 31)), F.lit("."), F.when(bits(2, 5, 1) == 1, "H").otherwise("L"), text(F.when(given(13), byte(13)).otherwise(93)))
    depth = F.when((bits(2, 5, 7) == 2) & (bits(3, 6, 1) == 1) & (bits(3, 5, 1) == 1), 12).when(bits(3, 6, 1) == 1, 10).otherwise(8)
    return (
        F.when((entry == "avc1") & given(4), F.concat(F.lit("avc1."), hexed(2), hexed(3), hexed(4)))
        .when(entry.isin("hev1", "hvc1") & given(4), hevc)
        .when((entry == "av01") & given(4), F.concat(F.lit("av01."), text(bits(2, 5, 7)), F.lit("."), two(bits(2, 0, 31)), F.lit("M."), two(depth)))
        .when((entry == "vp09") & given(7), F.concat(F.lit("vp09."), two(byte(5)), F.lit("."), two(byte(6)), F.lit("."), two(bits(7, 4, 15))))
        .when(entry == "avc1", "avc1.42E01E").when(entry.isin("hev1", "hvc1"), F.concat(entry, F.lit(".1.6.L93.B0"))).when(entry == "vp09", "vp09.00.10.08").when(entry == "av01", "av01.0.08M.08").when(entry == "mp4a", "mp4a.40.2")
        .otherwise(entry)
    )


def mp4_tracks(found: DataFrame) -> DataFrame:
    """(path, track, track_id, type, width, height, timescale, codec) per track of each file (path, content)."""
    return track_headers(mp4_rows(found))


def track_headers(rows: DataFrame) -> DataFrame:
    """(path, track, track_id, type, width, height, timescale, codec) per track of :func:`mp4_rows`."""
    rows = rows.where("error is null")
    of = lambda what, value: F.max(F.when(F.col("what") == what, F.col(value)))
    entry = F.max(F.when(F.startswith("what", F.lit("stsd:")), F.struct(F.substring("what", 6, 4).alias("name"), "data")))
    kind = F.max(F.when(F.col("what").isin("vide", "soun", "text", "sbtl"), F.col("what")))
    out = rows.where("track >= 0").groupBy("path", "track").agg(of("tkhd", "a").alias("track_id"), kind.alias("type"), of("tkhd", "b").alias("width"), of("tkhd", "c").alias("height"), of("mdhd", "a").alias("timescale"), entry.alias("e"))
    return out.where("timescale is not null").withColumn("codec", codec_string(F.col("e.name"), F.col("e.data"))).drop("e")


def mp4_fragments(found: DataFrame) -> DataFrame:
    """(path, fragment, n, dts, duration, size, is_key) of the samples in movie fragments; times in the track's own unit."""
    rows = walk(found, mp4_walker, MP4_SCHEMA).where("error is null and what in ('tfdt', 'trun')")
    file = Window.partitionBy("path").orderBy("seq")
    rows = rows.withColumns({"fragment": F.count(F.when(F.col("what") == "tfdt", 1)).over(file), "start": F.last(F.when(F.col("what") == "tfdt", F.col("a")), True).over(file)}).where("what = 'trun'")
    run = Window.partitionBy("path", "fragment").orderBy("seq")
    before = F.coalesce(F.sum("a").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    is_key = F.col("c").bitwiseAND(F.lit(0x10000).cast("long")) == 0
    return rows.select("path", "fragment", (F.row_number().over(run) - 1).alias("n"), (F.col("start") + before).alias("dts"), F.col("a").alias("duration"), F.col("b").alias("size"), is_key.alias("is_key"))


def wav_bytes(samples: DataFrame, id_col: str, x_col: str, rate: int = 44_100, channels: int = 1) -> DataFrame:
    """(id, wav): interleaved sample arrays as 16-bit WAV files. Quantised by expressions, packed in Arrow batches."""
    from kinograph.functions.curves import pcm_int16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                body = pa.array(x.as_py() or [], pa.int16()).to_numpy().astype("<i2").tobytes()
                head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(body))
                out.append(head + body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "wav"])

    kind = samples.schema[id_col].dataType.simpleString()
    return samples.select(id_col, F.transform(x_col, pcm_int16).alias("x")).mapInArrow(run, f"id {kind}, wav binary")
