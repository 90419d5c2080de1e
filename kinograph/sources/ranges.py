"""Media containers read by ranges: ``spark.read.format("containers")`` lists samples without reading their bytes.

``binaryFile`` holds a whole file in one row. This source plans over files of any size: an MP4 is read from
box to box, so that only headers and ``moov`` are fetched wherever it lies; a Matroska file over
``splitBytes`` is cut between clusters, found by hopping from one to the next. Ranges and small files share
partitions of about 64 MB, or a 256th of all bytes if that is less, but never under ``splitBytes``; only files that are
larger are hopped over on the driver, others by the task that reads them. An Ogg file is read page by page by one task. The rows are those of the walkers, in the order of
``seq``: (path, seq, *walker's columns, error); damage ends a file's rows with one that says so.

:func:`payloads` then fetches the bytes of samples: ranges are dealt by (file, stretch of the file),
so that one large file is many tasks', and neighbours are read together.

Options: ``path`` (a file or a folder, any file system Arrow knows), ``container`` (mp4, matroska or ogg), ``splitBytes``, ``readAhead``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition
from pyspark.sql.types import StructType

from kinograph.sources import matroska
from kinograph.sources.containers import ARROW, DAMAGE, MP4_SCHEMA, OGG_SCHEMA, mp4_walker, ogg_walker, walk_fields, walked

#: Bytes of a partition's range; what a range read fetches beyond what was asked, at first, least and at most.
SPLIT_BYTES, READ_AHEAD, LEAST_AHEAD, MOST_AHEAD = 64 << 20, 64 << 10, 256, 1 << 20
#: Samples up to so many bytes apart are fetched together, up to so many bytes at once; a stretch of a file that one task fetches.
GAP, MOST_AT_ONCE, STRETCH = 64 << 10, 16 << 20, 256 << 20
#: Rows of a split are numbered from its number times this.
SPLIT_ROWS = 1 << 40
#: Files planned together in one partition; partitions that ranges are spread over at least, before they reach SPLIT_BYTES, and the least bytes of small files in one.
FILES_AT_ONCE, SPREAD, LEAST_SHARE = 256, 256, 1 << 20
SCHEMAS = {"mp4": MP4_SCHEMA, "matroska": matroska.SCHEMA, "ogg": OGG_SCHEMA}
SUFFIXES = {"mp4": (".mp4", ".m4v", ".m4a", ".mov"), "matroska": (".mkv", ".webm", ".mka"), "ogg": (".ogg", ".oga", ".opus")}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there; Spark's ``file:/x`` is understood."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Ranged:
    """A file as something to slice: fetches what is asked and some bytes more, fewer the more of them go unused."""

    def __init__(self, path: str, read_ahead: int = READ_AHEAD):
        system, inner = file_system(path)
        self.file = system.open_input_file(inner)
        self.size, self.ahead = self.file.size(), read_ahead
        self.start, self.held, self.used, self.fetched = 0, b"", 0, 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        if isinstance(at, slice):
            a, b, _ = at.indices(self.size)
            return self.bytes(a, max(a, b))
        if not 0 <= at < self.size:
            raise IndexError("beyond the end of the file")
        return self.bytes(at, at + 1)[0]

    def bytes(self, a: int, b: int) -> bytes:
        if a < self.start or b > self.start + len(self.held):
            if self.held:  # jumps over most of what was fetched halve the surplus, reading on doubles it
                near = self.start <= a <= self.start + len(self.held)
                self.ahead = min(MOST_AHEAD, self.ahead * 2) if near and self.used * 2 >= len(self.held) else max(LEAST_AHEAD, self.ahead // 2)
            self.held = self.file.read_at(min(self.size - a, max(b - a, self.ahead)), a)
            self.start, self.used = a, 0
            self.fetched += len(self.held)
        self.used = max(self.used, b - self.start)
        return self.held[a - self.start : b - self.start]

    def close(self) -> None:
        self.file.close()


@dataclass
class Piece:
    """What a task reads of a file: from ``start`` up to the cluster at ``until``; one that is ``uncut`` is first cut into ranges by the task."""

    path: str
    split: int = 0
    start: int = 0
    until: int | None = None
    scale: int = 1_000_000
    uncut: bool = False


class Pieces(InputPartition):
    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


def cluster_pieces(path: str, data, split_bytes: int) -> list[Piece]:
    """A Matroska file cut between clusters about ``split_bytes`` apart; what can't be hopped over is the last piece's."""
    pieces, at, end, scale = [Piece(path)], 0, len(data), 1_000_000
    try:
        while at < end:
            name, size, start = matroska.element_at(data, at)
            if name == matroska.CLUSTER and at - pieces[-1].start >= split_bytes:
                pieces[-1].until = at
                pieces.append(Piece(path, len(pieces), at, None, scale))
            if name == matroska.SEGMENT:
                at = start
                continue
            if size is None:
                break
            if name == matroska.INFO:
                for leaf, a, b in matroska.elements(data, start, start + size):
                    scale = int.from_bytes(data[a:b], "big") if leaf == matroska.SCALE else scale
            at = start + size
    except DAMAGE:
        pass  # the walker meets it again and reports it
    return pieces


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.container = options["path"], options.get("container", "mp4").lower()
        self.split_bytes, self.read_ahead = int(options.get("splitbytes", SPLIT_BYTES)), int(options.get("readahead", READ_AHEAD))
        if self.container not in SCHEMAS:
            raise ValueError(f"container is one of {', '.join(SCHEMAS)}")

    def files(self) -> list[tuple[str, int]]:
        """(path, size) of the file, or of the folder's files with the container's suffix."""
        system, inner = file_system(self.path)
        found = system.get_file_info(inner)
        if found.type == fs.FileType.File:
            return [(self.path, found.size)]
        listed = system.get_file_info(fs.FileSelector(inner, recursive=True))
        base = self.path.rstrip("/")
        return sorted((base + f.path[len(inner.rstrip("/")) :], f.size) for f in listed if f.type == fs.FileType.File and f.path.lower().endswith(SUFFIXES[self.container]) and "/_staging-" not in f.path)

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of long Matroska files together up to a share of all bytes; the same for files, by what is likely to be read of them."""
        cost = lambda size: min(size, self.read_ahead) if self.container == "mp4" else size
        files = self.files()
        spread = min(SPLIT_BYTES, sum(cost(size) for _, size in files) // SPREAD)
        share, small = max(self.split_bytes, spread), max(min(self.split_bytes, LEAST_SHARE), spread)
        out: list[Pieces] = []

        def dealt(weighed: Iterable[tuple[Piece, int]], most: int) -> list[Piece]:
            """Puts full partitions out; the pieces left over."""
            together, weight = [], 0
            for piece, bytes_of in weighed:
                if together and (weight + bytes_of > most or len(together) == FILES_AT_ONCE):
                    out.append(Pieces(together))
                    together, weight = [], 0
                together.append(piece)
                weight += bytes_of
            return together

        def ranges() -> Iterator[tuple[Piece, int]]:
            for path, size in files:
                if self.container == "matroska" and size > share:
                    data = Ranged(path, LEAST_AHEAD)
                    yield from ((p, (p.until or size) - p.start) for p in cluster_pieces(path, data, self.split_bytes))
                    data.close()

        left = dealt(ranges(), share)
        out += [Pieces(left)] if left else []
        rest = [(Piece(path, uncut=self.container == "matroska" and size > self.split_bytes), cost(size)) for path, size in files if self.container != "matroska" or size <= share]
        left = dealt(rest, small)
        return [*out, Pieces(left)]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([(n, ARROW[t]) for n, t in walk_fields(SCHEMAS[self.container])])

        def entries() -> Iterator[tuple[str, Iterator[tuple], int]]:
            for piece in partition.pieces:
                data = Ranged(piece.path, self.read_ahead)
                for p in cluster_pieces(piece.path, data, self.split_bytes) if piece.uncut else [piece]:
                    walker = mp4_walker(data) if self.container == "mp4" else ogg_walker(data) if self.container == "ogg" else matroska.mkv_walker(data, p.start, p.until, p.scale)
                    yield p.path, walker, p.split * SPLIT_ROWS
                data.close()

        yield from walked(entries(), arrow)


class Containers(DataSource):
    """Rows of media containers in, files of packets out (see :mod:`kinograph.sources.sink`)."""

    @classmethod
    def name(cls) -> str:
        return "containers"

    def schema(self) -> str:
        return ", ".join(f"{n} {t}" for n, t in walk_fields(SCHEMAS[self.options.get("container", "mp4").lower()]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ContainerReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        from kinograph.sources.sink import ContainerWriter

        return ContainerWriter(dict(self.options), schema, overwrite)


def read(spark, path: str, container: str = "mp4", **options) -> DataFrame:
    """The walker's rows of a file or folder."""
    spark.dataSource.register(Containers)
    return spark.read.format("containers").option("container", container).options(**options).load(path)


def payloads(samples: DataFrame, path: str = "path", offset: str = "offset", size: str = "size", name: str = "data") -> DataFrame:
    """``samples`` with the bytes of each as ``name``; a sample that its file doesn't hold in full has null.

    Dealt by stretches of files, read in order, neighbours at once: what a task holds is bounded by MOST_AT_ONCE and its largest sample.
    """
    if name in samples.columns:
        raise ValueError(f"samples have a column {name} already")
    whole = samples.repartition(F.col(path), F.floor(F.col(offset) / STRETCH)).sortWithinPartitions(path, offset)
    schema = StructType([*whole.schema.fields]).add(name, "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, pa.NativeFile] | None = None
        for batch in batches:
            paths, starts, sizes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (path, offset, size))
            at, sent, found, fetched = 0, 0, [], 0
            while at < len(paths):
                last, end = at, None
                if None not in (paths[at], starts[at], sizes[at]):
                    end = starts[at] + sizes[at]
                    while last + 1 < len(paths) and paths[last + 1] == paths[at] and sizes[last + 1] is not None and starts[last + 1] <= end + GAP and max(end, starts[last + 1] + sizes[last + 1]) - starts[at] <= MOST_AT_ONCE:
                        last += 1
                        end = max(end, starts[last] + sizes[last])
                    if held is None or held[0] != paths[at]:
                        if held:
                            held[1].close()
                        system, inner = file_system(paths[at])
                        held = (paths[at], system.open_input_file(inner))
                    data = held[1].read_at(end - starts[at], starts[at])
                    got = [data[s - starts[at] : s - starts[at] + n] if 0 <= s - starts[at] and s - starts[at] + n <= len(data) else None for s, n in zip(starts[at : last + 1], sizes[at : last + 1])]
                else:
                    got = [None]
                found += got
                fetched += end - starts[at] if end is not None else 0
                at = last + 1
                if fetched >= MOST_AT_ONCE or at == len(paths):
                    part = batch.slice(sent, at - sent)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, name])
                    sent, found, fetched = at, [], 0
        if held:
            held[1].close()

    return whole.mapInArrow(run, schema)
