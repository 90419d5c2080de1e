"""Container writers: the packets of a file, in order, become one binary value.

Spark gathers and sorts the packets of each file; a small helper lays out their bytes. A file's
packets fit one row, as the file itself does. Times are milliseconds from the file's start. The
parsers of :mod:`kinograph.sources` read all of it back.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest fragment or cluster in milliseconds; one ends before the first key frame after that.
FRAGMENT_MS = 2000
#: Bytes of files that a task sends on together.
SENT_BYTES = 1 << 20


def files(packets: DataFrame, key: str, order: str, layout: Callable[[list[tuple]], bytes], ms: str = "ms", is_key: str = "is_key", data: str = "data") -> DataFrame:
    """(path, content): the packets of each ``key`` in order, through ``layout`` (a list of (ms, is_key, bytes)).

    Packets are dealt by file and sorted; a task lays out one file after the other as their packets come, and sends files on together
    up to SENT_BYTES. So it holds one file's packets, however many files there are.
    """
    rows = packets.select(F.col(key).cast("string").alias("path"), F.col(order).alias("o"), F.col(ms).cast("long").alias("ms"), F.col(is_key).alias("k"), F.col(data).alias("d"))
    dealt = rows.repartition("path").sortWithinPartitions("path", "o", "ms", "k", "d").select("path", "ms", "k", "d")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (p for batch in batches for p in zip(*(c.to_pylist() for c in batch.columns)))
        made, weight = [], 0
        for path, some in groupby(every, lambda p: p[0]):
            made.append((path, layout([p[1:] for p in some])))
            weight += len(made[-1][1])
            if weight >= SENT_BYTES:
                yield sent(made)
                made, weight = [], 0
        if made:
            yield sent(made)

    return dealt.mapInArrow(write, "path string, content binary")


def sent(made: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in made], t) for i, t in enumerate((pa.string(), pa.binary()))], ["path", "content"])


def steady(times: list[int]) -> list[int]:
    """Times that never fall: a late one is put one after the last."""
    out: list[int] = []
    for t in times:
        out.append(max(t, out[-1] + 1) if out else max(t, 0))
    return out


def fragments(packets: list[tuple], longest: int = FRAGMENT_MS) -> list[list[tuple]]:
    """Packets cut before the first key frame that comes ``longest`` after the fragment's start."""
    out: list[list[tuple]] = []
    for p in packets:
        if not out or (p[1] and p[0] - out[-1][0][0] >= longest):
            out.append([])
        out[-1].append(p)
    return out


def box(name: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    return struct.pack(">I4s", len(data) + 8, name) + data


def full(name: bytes, flags: int, *body: bytes) -> bytes:
    return box(name, struct.pack(">I", flags), *body)


def table(name: bytes, rows: list[tuple], form: str) -> bytes:
    return full(name, 0, struct.pack(">I", len(rows)), *[struct.pack(form, *r) for r in rows])


def sample_table(packets: list[tuple], start: int, entry: bytes) -> bytes:
    """The sample tables of packets that lie one behind the other from ``start``, as one chunk."""
    times = steady([p[0] for p in packets])
    steps = [b - a for a, b in zip(times, times[1:])]
    steps.append(steps[-1] if steps else 40)
    runs = [(len(list(g)), k) for k, g in groupby(steps)]
    sizes = [(len(p[2]),) for p in packets]
    keys = [(i + 1,) for i, p in enumerate(packets) if p[1]]
    return box(
        b"stbl", full(b"stsd", 0, struct.pack(">I", 1), entry), table(b"stts", runs, ">II"), table(b"stss", keys, ">I"), table(b"stsc", [(1, len(packets), 1)] if packets else [], ">III"),
        full(b"stsz", 0, struct.pack(">II", 0, len(sizes)), *[struct.pack(">I", *s) for s in sizes]), table(b"stco", [(start,)] if packets else [], ">I"),
    )


def mp4(packets: list[tuple], width: int = 1280, height: int = 720, config: bytes = b"\x01\x42\xe0\x1e") -> bytes:
    """One AVC video track in milliseconds, samples first, tables behind them. Tables are empty for no packet."""
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomavc1")
    data = box(b"mdat", *[p[2] for p in packets])
    entry = box(b"avc1", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", width, height), bytes(50), box(b"avcC", config))
    times = steady([p[0] for p in packets])
    length = times[-1] - times[0] if times else 0
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    track = box(
        b"trak",
        full(b"tkhd", 7, struct.pack(">5I", 0, 0, 1, 0, length), bytes(16), matrix, struct.pack(">II", width << 16, height << 16)),
        box(
            b"mdia", full(b"mdhd", 0, struct.pack(">4IHH", 0, 0, 1000, length, 0x55C4, 0)), full(b"hdlr", 0, bytes(4), b"vide", bytes(13)),
            box(b"minf", full(b"vmhd", 1, bytes(8)), box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1))), sample_table(packets, len(head) + 8, entry)),
        ),
    )
    movie = full(b"mvhd", 0, struct.pack(">4I", 0, 0, 1000, length), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
    return head + data + box(b"moov", movie, track)


def fragmented_mp4(packets: list[tuple]) -> bytes:
    """Fragments of about FRAGMENT_MS, each a ``moof`` with its run of samples before its ``mdat``."""
    empty = mp4([])
    out = [box(b"ftyp", b"iso5", struct.pack(">I", 512), b"iso5"), empty[empty.index(b"moov") - 4 :]]
    for number, part in enumerate(fragments(packets), 1):
        times = steady([p[0] for p in part])
        steps = [b - a for a, b in zip(times, times[1:])] + [40]
        samples = b"".join(struct.pack(">III", step, len(p[2]), 0x02000000 if p[1] else 0x01010000) for step, p in zip(steps, part))
        run = lambda at: full(b"trun", 0x701, struct.pack(">Ii", len(part), at), samples)  # noqa: E731, B023
        moof = lambda at: box(b"moof", full(b"mfhd", 0, struct.pack(">I", number)), box(b"traf", full(b"tfhd", 0x20000, struct.pack(">I", 1)), full(b"tfdt", 0, struct.pack(">I", times[0])), run(at)))  # noqa: E731, B023
        out += [moof(len(moof(0)) + 8), box(b"mdat", *[p[2] for p in part])]
    return b"".join(out)


def chunk(name: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    return struct.pack("<4sI", name, len(data)) + data + b"\x00" * (len(data) & 1)


def avi(packets: list[tuple], rate: int = 25, scale: int = 1, width: int = 1280, height: int = 720) -> bytes:
    """One video stream of constant rate with an index that marks key frames."""
    main = struct.pack("<14I", 1_000_000 * scale // rate, 0, 0, 0x10, len(packets), 0, 1, 0, width, height, 0, 0, 0, 0)
    head = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, scale, rate, 0, len(packets), 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    frames, index, at = [], [], 4
    for _, is_key, data in packets:
        frames.append(chunk(b"00dc", data))
        index.append(struct.pack("<4sIII", b"00dc", 0x10 if is_key else 0, at, len(data)))
        at += len(frames[-1])
    header = chunk(b"LIST", b"hdrl", chunk(b"avih", main), chunk(b"LIST", b"strl", chunk(b"strh", head), chunk(b"strf", form)))
    return chunk(b"RIFF", b"AVI ", header, chunk(b"LIST", b"movi", *frames), chunk(b"idx1", *index))


def number(value: int) -> bytes:
    """A variable-length size."""
    length = next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def element(name: int, *body: bytes) -> bytes:
    data = b"".join(body)
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + number(len(data)) + data


def unsigned(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def xiph_lace(frames: list[bytes]) -> bytes:
    return bytes([len(frames) - 1]) + b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1]) + b"".join(frames)


def ebml_lace(frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames[:-1]]
    signed = lambda d: (d + (1 << 27) - 1 | 1 << 28).to_bytes(4, "big")
    return bytes([len(frames) - 1]) + (number(sizes[0]) if sizes else b"") + b"".join(signed(b - a) for a, b in zip(sizes, sizes[1:])) + b"".join(frames)


def fixed_lace(frames: list[bytes]) -> bytes:
    if len({len(f) for f in frames}) > 1:
        raise ValueError("fixed laces are of one size")
    return bytes([len(frames) - 1]) + b"".join(frames)


LACES = {1: xiph_lace, 2: fixed_lace, 3: ebml_lace}


def mkv(packets: list[tuple], lacing: int = 0, per_block: int = 1, frame_ms: int = 40, cluster_ms: int = FRAGMENT_MS, width: int = 1280, height: int = 720) -> bytes:
    """One video track in clusters that start at key frames; ``per_block`` packets share a block if ``lacing`` is set."""
    head = element(0x1A45DFA3, unsigned(0x4286, 1), element(0x4282, b"matroska"))
    info = element(0x1549A966, unsigned(0x2AD7B1, 1_000_000))
    track = element(0xAE, unsigned(0xD7, 1), unsigned(0x73C5, 1), unsigned(0x83, 1), element(0x86, b"V_MPEG4/ISO/AVC"), unsigned(0x23E383, frame_ms * 1_000_000 * per_block), element(0xE0, unsigned(0xB0, width), unsigned(0xBA, height)))
    clusters = []
    for part in fragments(packets, cluster_ms):
        for near in within_reach(part):
            start = max(0, near[0][0])
            blocks = []
            for i in range(0, len(near), per_block):
                some = near[i : i + per_block]
                laced = lacing if len(some) > 1 else 0
                body = LACES[laced]([p[2] for p in some]) if laced else some[0][2]
                blocks.append(element(0xA3, number(1), struct.pack(">hB", some[0][0] - start, (0x80 if some[0][1] else 0) | laced << 1), body))
            clusters.append(element(0x1F43B675, unsigned(0xE7, start), *blocks))
    return head + element(0x18538067, info, element(0x1654AE6B, track), *clusters)


def within_reach(packets: list[tuple]) -> list[list[tuple]]:
    """Packets cut where a block's 16-bit time would no longer reach the cluster's start."""
    out: list[list[tuple]] = []
    for p in packets:
        if not out or not -32768 <= p[0] - out[-1][0][0] <= 32767:
            out.append([])
        out[-1].append(p)
    return out


def bmp(pixels: Column, width: int, height: int | None = None) -> Column:
    """An array of packed 24-bit colours (r << 16 | g << 8 | b), row by row from the top, as a BMP file; as many rows as it takes, where ``height`` is not given."""

    @F.arrow_udf("binary")
    def write(images: pa.Array) -> pa.Array:
        out = []
        for image in images:
            values = image.as_py() or []
            tall = -(-len(values) // width) if height is None else height
            rows = [b"".join(v.to_bytes(3, "little") for v in values[y * width : (y + 1) * width]).ljust(width * 3, b"\0") for y in range(tall - 1, -1, -1)]
            body = b"".join(r + bytes(-len(r) % 4) for r in rows)
            out.append(struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, tall, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body)
        return pa.array(out, pa.binary())

    return write(pixels)
