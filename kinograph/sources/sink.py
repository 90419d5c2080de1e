"""Packets to container files, one file a key, written as the rows come: no file is ever held in a row or in memory.

:func:`write_containers` deals packets by file and sorts them by time, video before audio at the same
instant, so that streams lie interleaved. A task writes its files into a staging folder beside
the target; the driver's commit renames them, an abort or a later attempt removes what is left, and a
lost task is run again from its rows. Sizes that are known only at the end are patched in place.

* MP4: ``mdat`` with a 64-bit size, then ``moov`` with a table per stream; chunk offsets take 64 bits once
  a chunk starts beyond 4 GiB. A chunk is a stretch of one stream's samples.
* Matroska: clusters by span, whether or not they start with a key frame, and before a block's 16-bit time is exceeded.
* Ogg: one logical stream a stream number, pages with checksum and granule (48 kHz), the last one marked.

What grows with a file is its sample index, some 30 bytes a sample, in MP4 alone.

Times are milliseconds; within a stream they never fall: a late packet is put one after the last.
"""

from __future__ import annotations

import os
import struct
import urllib.parse
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from kinograph.sources.containers import ogg_crc
from kinograph.sources.ranges import Containers, file_system
from kinograph.sources.writers import box, element, full, number, unsigned

VIDEO, AUDIO = 0, 1
#: Span of a cluster in milliseconds and its most bytes; bytes of an Ogg page's contents from which it is closed.
CLUSTER_MS, CLUSTER_BYTES, PAGE_BYTES = 2000, 4 << 20, 4096
COLUMNS = {"key": "string", "stream": "int", "ms": "bigint", "is_key": "boolean", "data": "binary"}


class Output:
    """A new file that can be patched, on a file system with plain files."""

    def __init__(self, path: str):
        system, inner = file_system(path)
        if not isinstance(system, fs.LocalFileSystem):
            raise ValueError("sizes are patched in place: write to a mounted file system and copy from there")
        self.file, self.at = open(inner, "wb+"), 0

    def write(self, *parts: bytes) -> None:
        for data in parts:
            self.file.write(data)
            self.at += len(data)

    def skip(self, n: int) -> None:
        """Leave a hole; used to try large files."""
        self.at += n
        self.file.seek(self.at)

    def patch(self, at: int, data: bytes) -> None:
        self.file.seek(at)
        self.file.write(data)
        self.file.seek(self.at)

    def close(self) -> None:
        self.file.close()


@dataclass
class Stream:
    """The sample index of one stream of an MP4."""

    times: array = field(default_factory=lambda: array("q"))
    sizes: array = field(default_factory=lambda: array("Q"))
    keys: array = field(default_factory=lambda: array("Q"))
    chunks: array = field(default_factory=lambda: array("Q"))
    held: array = field(default_factory=lambda: array("Q"))


def runs(values: list[int]) -> list[tuple[int, int]]:
    """(count, value) of equal neighbours."""
    out: list[tuple[int, int]] = []
    for v in values:
        if out and out[-1][1] == v:
            out[-1] = (out[-1][0] + 1, v)
        else:
            out.append((1, v))
    return out


def numbers(form: str, values) -> bytes:
    """Count and values, big-endian."""
    values = array(form, values)
    count = struct.pack(">I", len(values))
    values.byteswap()  # a little-endian machine, as Arrow has it too
    return count + values.tobytes()


class Mp4:
    suffix = ".mp4"

    def __init__(self, out: Output, options: dict[str, str]):
        self.out, self.options, self.streams, self.last = out, options, {}, None
        out.write(box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomavc1"))
        self.start = out.at
        out.write(struct.pack(">I4sQ", 1, b"mdat", 0))

    def place(self, stream: int, ms: int, is_key: bool, size: int) -> None:
        """Enter the sample that comes next in the index."""
        s = self.streams.setdefault(stream, Stream())
        s.times.append(ms)
        s.sizes.append(size)
        if is_key:
            s.keys.append(len(s.sizes))
        if self.last != stream:
            s.chunks.append(self.out.at)
            s.held.append(0)
            self.last = stream
        s.held[-1] += 1

    def add(self, stream: int, ms: int, is_key: bool, data: bytes) -> None:
        self.place(stream, ms, is_key, len(data))
        self.out.write(data)

    def track(self, number: int, stream: int, s: Stream) -> bytes:
        video = stream == VIDEO
        width, height = (int(self.options.get(n, d)) for n, d in (("width", 1280), ("height", 720)))
        steps = [b - a for a, b in zip(s.times, s.times[1:])]
        steps.append(steps[-1] if steps else 40)
        per_chunk, first = [], 1
        for count, n in runs(list(s.held)):
            per_chunk.append((first, n, 1))
            first += count
        if video:
            entry = box(b"avc1", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", width, height), bytes(50), box(b"avcC", bytes.fromhex(self.options.get("avcc", "0142e01e"))))
        else:
            rate, channels = int(self.options.get("rate", 48_000)), int(self.options.get("channels", 2))
            head = struct.pack(">BBHIHB", 0, channels, 0, rate, 0, 0)
            entry = box(b"Opus", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", channels, 16, 0, 0, rate << 16), box(b"dOps", head))
        offsets = full(b"co64", 0, numbers("Q", s.chunks)) if max(s.chunks) >= 2**32 else full(b"stco", 0, numbers("I", s.chunks))
        table = lambda rows, form: struct.pack(">I", len(rows)) + b"".join(struct.pack(form, *r) for r in rows)
        stbl = box(
            b"stbl", full(b"stsd", 0, struct.pack(">I", 1), entry), full(b"stts", 0, table(runs(steps), ">II")), full(b"stss", 0, numbers("I", s.keys)) if video else b"",
            full(b"stsc", 0, table(per_chunk, ">III")), full(b"stsz", 0, struct.pack(">I", 0), numbers("I", s.sizes)), offsets,
        )
        length = min(2**32 - 1, s.times[-1] - s.times[0])
        matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
        head = full(b"vmhd", 1, bytes(8)) if video else full(b"smhd", 0, bytes(4))
        return box(
            b"trak", full(b"tkhd", 7, struct.pack(">5I", 0, 0, number, 0, length), bytes(16), matrix, struct.pack(">II", width << 16 if video else 0, height << 16 if video else 0)),
            box(b"mdia", full(b"mdhd", 0, struct.pack(">4IHH", 0, 0, 1000, length, 0x55C4, 0)), full(b"hdlr", 0, bytes(4), b"vide" if video else b"soun", bytes(13)),
                box(b"minf", head, box(b"dinf", full(b"dref", 0, struct.pack(">I", 1), full(b"url ", 1))), stbl)),
        )

    def close(self) -> None:
        self.out.patch(self.start + 8, struct.pack(">Q", self.out.at - self.start))
        length = min(2**32 - 1, max((s.times[-1] - s.times[0] for s in self.streams.values()), default=0))
        matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
        movie = full(b"mvhd", 0, struct.pack(">4I", 0, 0, 1000, length), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", len(self.streams) + 1))
        self.out.write(box(b"moov", movie, *[self.track(i, stream, s) for i, (stream, s) in enumerate(sorted(self.streams.items()), 1)]))


class Matroska:
    suffix = ".mkv"

    def __init__(self, out: Output, options: dict[str, str]):
        self.out, self.options, self.held, self.started, self.size = out, options, [], None, 0
        out.write(element(0x1A45DFA3, unsigned(0x4286, 1), element(0x4282, b"matroska")), b"\x18\x53\x80\x67")
        self.start = out.at
        out.write(b"\x01" + b"\xff" * 7)  # unknown, until the end
        video = element(0xAE, unsigned(0xD7, 1), unsigned(0x73C5, 1), unsigned(0x83, 1), element(0x86, b"V_MPEG4/ISO/AVC"), element(0xE0, unsigned(0xB0, int(options.get("width", 1280))), unsigned(0xBA, int(options.get("height", 720)))))
        audio = element(0xAE, unsigned(0xD7, 2), unsigned(0x73C5, 2), unsigned(0x83, 2), element(0x86, b"A_OPUS"), element(0xE1, element(0xB5, struct.pack(">d", float(options.get("rate", 48_000)))), unsigned(0x9F, int(options.get("channels", 2)))))
        out.write(element(0x1549A966, unsigned(0x2AD7B1, 1_000_000)), element(0x1654AE6B, video, audio))

    def add(self, stream: int, ms: int, is_key: bool, data: bytes) -> None:
        if self.held and (ms - self.started >= CLUSTER_MS or not -32768 <= ms - self.started <= 32767 or self.size + len(data) > CLUSTER_BYTES):
            self.flush()
        if not self.held:
            self.started = max(0, ms)
        self.held.append(element(0xA3, number(stream + 1), struct.pack(">hB", ms - self.started, 0x80 if is_key else 0), data))
        self.size += len(data)

    def flush(self) -> None:
        if self.held:
            self.out.write(element(0x1F43B675, unsigned(0xE7, self.started), *self.held))
        self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.out.patch(self.start, (self.out.at - self.start - 8 | 1 << 56).to_bytes(8, "big"))


class OggStream:
    """Pages of one logical stream; the one that is being filled waits until it is known not to be the last."""

    def __init__(self, out: Output, serial: int):
        self.out, self.serial, self.page, self.sizes, self.parts, self.granule, self.fresh = out, serial, 0, [], [], -1, True

    def add(self, data: bytes, granule: int) -> None:
        sizes = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        while sizes:
            if len(self.sizes) == 255 or sum(self.sizes) >= PAGE_BYTES:
                self.flush()
            take = min(len(sizes), 255 - len(self.sizes))
            self.sizes += sizes[:take]
            self.parts.append(data[at : at + sum(sizes[:take])])
            at += sum(sizes[:take])
            sizes = sizes[take:]
            if not sizes:
                self.granule = granule

    def flush(self, last: bool = False) -> None:
        kind = (0 if self.fresh else 1) | (2 if self.page == 0 else 0) | (4 if last else 0)
        head = struct.pack("<4sBBqIII", b"OggS", 0, kind, self.granule, self.serial, self.page, 0)
        body = bytes([len(self.sizes)]) + bytes(self.sizes) + b"".join(self.parts)
        self.out.write(head[:22], struct.pack("<I", ogg_crc(head + body)), body)
        self.fresh = not self.sizes or self.sizes[-1] < 255  # else the packet goes on
        self.page, self.sizes, self.parts, self.granule = self.page + 1, [], [], -1


class Ogg:
    suffix = ".ogg"

    def __init__(self, out: Output, options: dict[str, str]):
        self.out, self.options, self.streams = out, options, {}

    def add(self, stream: int, ms: int, is_key: bool, data: bytes) -> None:
        if stream not in self.streams:
            s = self.streams[stream] = OggStream(self.out, stream + 1)
            s.add(b"OpusHead" + struct.pack("<BBHIhB", 1, int(self.options.get("channels", 2)), 0, int(self.options.get("rate", 48_000)), 0, 0), 0)
            s.flush()
            s.add(b"OpusTags" + struct.pack("<I", 0) + struct.pack("<I", 0), 0)
            s.flush()
        self.streams[stream].add(data, ms * 48)

    def close(self) -> None:
        for s in self.streams.values():
            s.flush(last=True)


LAYOUTS = {"mp4": Mp4, "matroska": Matroska, "ogg": Ogg}


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ContainerWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("files are only added: write to a new folder, or append")
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if kinds != COLUMNS:
            raise ValueError(f"packets have the columns {COLUMNS}, not {kinds}")
        self.options, self.folder = options, options["path"].rstrip("/")
        self.layout = LAYOUTS[options.get("container", "mp4").lower()]
        self.staging = f"{self.folder}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """The files of a task's rows, sorted by key; a key that comes back is an error, not a second file."""
        system, inner = file_system(self.staging)
        system.create_dir(inner, recursive=True)
        files: dict[str, str] = {}
        key, out, layout, times = None, None, None, {}
        try:
            for batch in iterator:
                *columns, datas = (batch.column(batch.schema.get_field_index(c)) for c in COLUMNS)
                for name, stream, ms, is_key, data in zip(*(c.to_pylist() for c in columns), datas):
                    data = data.as_py()
                    if None in (name, stream, ms, data):
                        raise ValueError(f"a packet of {name!r} without stream, time or data")
                    if name != key:
                        if layout:
                            layout.close()
                            out.close()
                        if name in files:
                            raise ValueError(f"packets of {name!r} are not sorted together")
                        files[name] = f"{self.staging}/{uuid.uuid4().hex}"
                        out = Output(files[name])
                        key, layout, times = name, self.layout(out, self.options), {}
                    times[stream] = max(0, ms) if stream not in times else max(ms, times[stream] + 1)
                    layout.add(stream, times[stream], bool(is_key), data)
            if layout:
                layout.close()
        finally:
            if out:
                out.close()
        return Written([(path, f"{self.folder}/{urllib.parse.quote(name, safe='')}{self.layout.suffix}") for name, path in files.items()])

    def commit(self, messages: list[Written | None]) -> None:
        for staged, final in (f for m in messages if m for f in m.files):
            system, inner = file_system(staged)
            system.move(inner, file_system(final)[1])
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, inner = file_system(self.staging)
        if system.get_file_info(inner).type == fs.FileType.Directory:
            system.delete_dir(inner)


def write_containers(packets: DataFrame, folder: str, container: str = "mp4", key: str = "key", order: list[str] | None = None, **options) -> None:
    """Write ``packets`` (``key``, stream, ms, is_key, data) as a file per key; ``order`` settles packets of the same time and stream."""
    system, inner = file_system(folder)
    system.create_dir(inner, recursive=True)
    packets.sparkSession.dataSource.register(Containers)
    rows = packets.withColumnRenamed(key, "key") if key != "key" else packets
    dealt = rows.repartition("key").sortWithinPartitions("key", "ms", "stream", *(order or []))
    narrow = dealt.select(*[F.col(c).cast(t) for c, t in COLUMNS.items()])
    narrow.write.format("containers").mode("append").option("container", container).options(**options).save(folder)


def size_of(folder: str) -> int:
    """Bytes of a folder's files."""
    return sum(os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(file_system(folder)[1]) for n in names)
