"""Container source and sink, and parsers on hostile bytes: hand-made fixtures, not the library's own writers, where a rule of a format is at stake."""

from __future__ import annotations

import os
import struct
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinograph.sources import containers as C
from kinograph.sources import matroska as M
from kinograph.sources import ranges as R
from kinograph.sources import sink as S
from kinograph.sources import writers as W

FILE = "path string, content binary"


def rows_of(spark, walker, schema, content):
    return C.walk(spark.createDataFrame([("f", content)], FILE), walker, schema).orderBy("seq").collect()


# parsers never fail the job

UNKNOWN = b"\x01" + b"\xff" * 7
LIVE_HEAD = b"\x1a\x45\xdf\xa3\x80" + b"\x18\x53\x80\x67" + UNKNOWN


def live_cluster(ms, payload=b"abc"):
    return b"\x1f\x43\xb6\x75" + UNKNOWN + b"\xe7\x82" + struct.pack(">H", ms) + b"\xa3" + bytes([0x80 | 4 + len(payload)]) + b"\x81\x00\x05\x80" + payload


def test_live_files_with_many_clusters_of_unknown_size(spark):
    content = LIVE_HEAD + b"".join(live_cluster(10 * i) for i in range(1200))
    rows = rows_of(spark, M.mkv_walker, M.SCHEMA, content)
    assert len(rows) == 1200 and not any(r["error"] for r in rows)
    assert [r["at_ns"] for r in rows] == [(10 * i + 5) * 1_000_000 for i in range(1200)]
    assert [content[r["offset"] : r["offset"] + r["size"]] for r in rows[:3]] == [b"abc"] * 3
    # cues end an open cluster, a second segment ends an open one
    after = LIVE_HEAD + live_cluster(7) + b"\x1c\x53\xbb\x6b\x82\xec\x80" + live_cluster(9) + LIVE_HEAD + live_cluster(11)
    assert [r["at_ns"] // 1_000_000 for r in rows_of(spark, M.mkv_walker, M.SCHEMA, after)] == [12, 14, 16]


def test_deep_nesting_and_large_numbers_are_errors_of_the_file(spark):
    boxes = b""
    for _ in range(1200):
        boxes = struct.pack(">I4s", len(boxes) + 8, b"moov") + boxes
    assert [r["error"] for r in rows_of(spark, C.mp4_walker, C.MP4_SCHEMA, boxes)] == ["boxes nested too deeply"]
    groups = b"".join(b"\xae" + (len(range(i)) * 5 | 1 << 28).to_bytes(4, "big") for i in range(1199, -1, -1))
    head = b"\x16\x54\xae\x6b" + (len(groups) | 1 << 28).to_bytes(4, "big")
    rows = rows_of(spark, M.mkv_walker, M.SCHEMA, b"\x18\x53\x80\x67" + UNKNOWN + head + groups)
    assert rows and all(r["error"] for r in rows)
    segments = (b"\x18\x53\x80\x67" + (2**50 | 1 << 56).to_bytes(8, "big")) * 1200
    assert [bool(r["error"]) for r in rows_of(spark, M.mkv_walker, M.SCHEMA, segments)] == [True]
    scale = b"\x18\x53\x80\x67" + UNKNOWN + b"\x15\x49\xa9\x66\x8c\x2a\xd7\xb1\x88" + b"\xff" * 8 + live_cluster(60000)
    assert [r["error"] for r in rows_of(spark, M.mkv_walker, M.SCHEMA, scale)] == ["a number over 64 bits"]
    files = spark.createDataFrame([("bad", scale), ("good", LIVE_HEAD + live_cluster(1)), ("none", None)], FILE)
    assert {r["path"]: r["error"] for r in C.walk(files, M.mkv_walker, M.SCHEMA).collect()} == {"bad": "a number over 64 bits", "good": None}


def test_noise_never_fails_the_job(spark):
    import random

    rng = random.Random(4)
    whole = {C.mp4_walker: W.mp4([(i * 40, i % 5 == 0, b"x" * i) for i in range(30)]), M.mkv_walker: W.mkv([(i * 40, i % 5 == 0, b"x" * i) for i in range(30)], 3, 3), C.avi_walker: W.avi([(i, True, b"y" * i) for i in range(9)])}
    for walker, content in whole.items():
        schema = {C.mp4_walker: C.MP4_SCHEMA, M.mkv_walker: M.SCHEMA, C.avi_walker: C.AVI_SCHEMA}[walker]
        files = []
        for i in range(120):
            noisy = bytearray(content[: rng.randrange(len(content)) + 1])
            for _ in range(rng.randrange(1, 6)):
                noisy[rng.randrange(len(noisy))] = rng.choice([0, 255, rng.randrange(256)])
            files.append((str(i), bytes(noisy)))
        C.walk(spark.createDataFrame(files, FILE), walker, schema).write.format("noop").mode("overwrite").save()


# fixtures by the formats' rules


def test_lacing_by_hand(spark):
    """Block lacing as the format describes it: Xiph 300, 2, rest; EBML 4, +2, rest; fixed thirds."""
    cluster = lambda *blocks: b"\x1f\x43\xb6\x75" + UNKNOWN + b"\xe7\x81\x00" + b"".join(b"\xa3" + (len(b) | 1 << 28).to_bytes(4, "big") + b for b in blocks)
    head = lambda flags: b"\x81\x00\x00" + bytes([flags])
    xiph = head(0x82) + b"\x02\xff\x2d\x02" + b"a" * 300 + b"bb" + b"c" * 9
    ebml = head(0x86) + b"\x02\x84\xc1" + b"d" * 4 + b"e" * 6 + b"f" * 5  # 0xc1: one byte, 65 - 63 = +2
    fixed = head(0x84) + b"\x02" + b"gghhii"
    content = b"\x18\x53\x80\x67" + UNKNOWN + cluster(xiph, ebml, fixed)
    packets = M.mkv_packets(M.mkv_rows(spark.createDataFrame([("f", content)], FILE))).orderBy("seq", "lace").collect()
    assert [content[p["offset"] : p["offset"] + p["size"]] for p in packets] == [b"a" * 300, b"bb", b"c" * 9, b"dddd", b"e" * 6, b"f" * 5, b"gg", b"hh", b"ii"]


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi_by_hand(index, data=(b"one", b"four", b"sixsix"), before=b""):
    strh = chunk(b"strh", b"vidsMJPG" + bytes(12) + struct.pack("<II", 1, 25) + bytes(28))
    head = chunk(b"LIST", b"hdrl" + chunk(b"LIST", b"strl" + strh + before))
    movi = chunk(b"LIST", b"movi" + b"".join(chunk(b"00dc", d) for d in data))
    return b"RIFF" + struct.pack("<I", 0) + b"AVI " + head + movi + index(12 + len(head) + 8)


@pytest.mark.parametrize("absolute", [False, True])
def test_avi_index_by_place(spark, absolute):
    """The second chunk is missing from the index and the order is another: samples follow the index, not the chunks' numbers."""

    def index(movi):
        place = {0: 4, 2: 4 + 12 + 12}
        return chunk(b"idx1", b"".join(b"00dc" + struct.pack("<III", flags, place[i] + (movi if absolute else 0), size) for i, flags, size in ((2, 0x10, 6), (0, 0, 3))))

    content = avi_by_hand(index)
    rows = C.avi_packets(spark.createDataFrame([("f", content)], FILE)).orderBy("n").collect()
    assert [(content[r["offset"] : r["offset"] + r["size"]], r["is_key"], r["pts_us"]) for r in rows] == [(b"sixsix", True, 0), (b"one", False, 40_000)]


def test_avi_long_index(spark):
    """An index of indexes in the stream's header counts before the short one."""
    content = avi_by_hand(lambda movi: b"", before=chunk(b"indx", bytes(40)))
    at = {d: content.index(d) for d in (b"one", b"four", b"sixsix")}
    base = at[b"one"] - 10
    inner = struct.pack("<HBBI4sQI", 2, 0, 1, 3, b"00dc", base, 0) + b"".join(struct.pack("<II", at[d] - base, len(d) | key << 31) for d, key in ((b"one", 0), (b"four", 1), (b"sixsix", 0)))
    place = len(content)
    outer = struct.pack("<HBBI4s12x", 4, 0, 0, 1, b"00dc") + struct.pack("<QII", place, 8 + len(inner), 3)
    content = content.replace(chunk(b"indx", bytes(40)), chunk(b"indx", outer)) + chunk(b"ix00", inner)
    rows = C.avi_packets(spark.createDataFrame([("f", content)], FILE)).orderBy("n").collect()
    assert [(content[r["offset"] : r["offset"] + r["size"]], r["is_key"]) for r in rows] == [(b"one", True), (b"four", False), (b"sixsix", True)]


def test_fragment_run_by_hand(spark):
    """A run with durations, sizes and flags but neither a data offset nor first flags."""
    b = lambda name, body: struct.pack(">I4s", 8 + len(body), name) + body
    trun = b(b"trun", struct.pack(">II", 0x700, 2) + struct.pack(">III", 40, 7, 0x02000000) + struct.pack(">III", 60, 9, 0x01010000))
    content = b(b"moof", b(b"traf", b(b"tfdt", struct.pack(">IQ", 1 << 24, 5 << 33)) + trun))
    rows = C.mp4_fragments(spark.createDataFrame([("f", content)], FILE)).orderBy("n").collect()
    assert [(r["dts"], r["duration"], r["size"], r["is_key"]) for r in rows] == [(5 << 33, 40, 7, True), ((5 << 33) + 40, 60, 9, False)]


def test_ogg_checksum_is_the_bitwise_one():
    def bitwise(data):
        crc = 0
        for byte in data:
            crc ^= byte << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    for data in (b"", b"\0", b"OggS", bytes(range(256)), os.urandom(999)):
        assert C.ogg_crc(data) == bitwise(data)


# source


def packets(n, size=100):
    return [(i * 40, i % 10 == 0, zlib.crc32(b"%d" % i).to_bytes(4, "big") * (size // 4 + i % 3)) for i in range(n)]


def listed(spark, folder, container, **options):
    return R.read(spark, str(folder), container, **options)


@pytest.mark.parametrize("container", ["mp4", "matroska"])
def test_range_reads_equal_whole_reads(spark, tmp_path, container):
    layout, suffix = (W.mp4, "mp4") if container == "mp4" else (W.mkv, "mkv")
    contents = {f"{i}.{suffix}": layout(packets(n)) for i, n in enumerate((0, 1, 400))} | {f"cut.{suffix}": layout(packets(300))[:-900], f"none.{suffix}": b"", f"noise.{suffix}": b"\x00\x01noise"}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "other.txt").write_text("no media")
    names = [c.split()[0] for c in R.SCHEMAS[container].split(", ")] + ["error"]
    plain = lambda rows: sorted(str((os.path.basename(r["path"]), *[r[c] for c in names])) for r in rows)
    walker = C.mp4_walker if container == "mp4" else M.mkv_walker
    whole = C.walk(C.files(spark, f"{tmp_path}/*.{suffix}"), walker, R.SCHEMAS[container]).collect()
    for options in ({}, {"splitBytes": 3000, "readAhead": 300}):
        found = listed(spark, tmp_path, container, **options)
        assert plain(found.collect()) == plain(whole)
    split = listed(spark, tmp_path / f"2.{suffix}", container, splitBytes=3000)
    assert split.rdd.getNumPartitions() >= (8 if container == "matroska" else 1)
    samples = M.mkv_packets(split) if container == "matroska" else C.mp4_samples(split)
    assert sorted(r["data"] for r in R.payloads(samples).collect()) == sorted(p[2] for p in packets(400))
    assert R.payloads(samples.limit(0)).count() == 0


def test_payloads_beyond_the_file_are_null(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(bytes(range(100)))
    rows = [(f"{tmp_path}/a.bin", o, n) for o, n in ((0, 3), (98, 2), (98, 3), (200, 1), (50, 0), (10, 5), (10, 5), (None, 1))]
    found = R.payloads(spark.createDataFrame(rows, "path string, offset long, size long")).collect()
    got = sorted((str(r["offset"]), r["size"], r["data"]) for r in found if r["data"] is not None)
    assert got == [("0", 3, b"\0\1\2"), ("10", 5, bytes(range(10, 15))), ("10", 5, bytes(range(10, 15))), ("50", 0, b""), ("98", 2, b"bc")]
    assert len(found) == len(rows)


def sparse(path, head, sizes):
    """A file of the given pieces: bytes are written, numbers are holes."""
    with open(path, "wb") as f:
        for part in [head, *sizes]:
            f.seek(part, 1) if isinstance(part, int) else f.write(part)
        f.truncate()


def fetched(folder, container, **options):
    """Rows and bytes that planning and reading fetch, in this process."""
    total, rows, made = [0], [], R.Ranged.bytes

    def counted(self, a, b):
        before = self.fetched
        out = made(self, a, b)
        total[0] += self.fetched - before
        return out

    R.Ranged.bytes = counted
    try:
        reader = R.ContainerReader({"path": str(folder), "container": container, **options})
        parts = reader.partitions()
        for p in parts:
            rows += [r for b in reader.read(p) for r in b.to_pylist()]
    finally:
        R.Ranged.bytes = made
    return rows, total[0], len(parts)


def test_a_large_mp4_is_listed_from_its_headers(tmp_path):
    """Three gigabytes, moov behind them: a megabyte is fetched at most."""
    whole = W.mp4(packets(2000))
    moov, hole = whole[whole.index(b"moov") - 4 :], 3 << 30
    sparse(tmp_path / "a.mp4", whole[: whole.index(b"mdat") - 4], [struct.pack(">I4sQ", 1, b"mdat", 16 + hole), hole, moov])
    rows, n_bytes, _ = fetched(tmp_path, "mp4")
    assert os.path.getsize(tmp_path / "a.mp4") > hole and n_bytes < 1 << 20
    assert sum(r["what"] == "stsz" for r in rows) == 2000 and not any(r["error"] for r in rows)


def test_a_large_matroska_file_is_split_between_clusters(tmp_path):
    """Three gigabytes in clusters of eight megabyte blocks: 12 partitions, under a hundred megabytes fetched."""
    cluster = lambda i: [b"\x1f\x43\xb6\x75" + (7 + 8 * ((1 << 20) + 9) - 4 | 1 << 56).to_bytes(8, "big") + b"\xe7\x81" + bytes([i % 256])] + [x for k in range(8) for x in (b"\xa3" + ((1 << 20) + 4 | 1 << 28).to_bytes(4, "big") + b"\x81" + struct.pack(">hB", k, 0x80), 1 << 20)]
    sparse(tmp_path / "a.mkv", LIVE_HEAD, [x for i in range(384) for x in cluster(i)])
    rows, n_bytes, parts = fetched(tmp_path, "matroska", splitbytes=256 << 20)
    assert os.path.getsize(tmp_path / "a.mkv") > 3 << 30 and parts == 13 and n_bytes < 100 << 20
    assert len(rows) == 384 * 8 and not any(r["error"] for r in rows)
    assert [r["at_ns"] // 1_000_000 for r in sorted(rows, key=lambda r: r["seq"])] == [i % 256 + k for i in range(384) for k in range(8)]


# sink


def two_streams(spark, n=300):
    rows = [(key, i % 2, (i // 2) * 20 - (7 if i % 50 == 4 else 0), i % 10 == 0, f"{key}-{i}".encode() * (1 + i % 5), i) for key in ("a", "b/c", "ä ö") for i in range(n)]
    return spark.createDataFrame(rows, "key string, stream int, ms long, is_key boolean, data binary, i long").repartition(7), rows


@pytest.mark.parametrize("container", ["mp4", "matroska", "ogg"])
def test_two_streams_come_back_whole(spark, tmp_path, container):
    frame, rows = two_streams(spark)
    S.write_containers(frame, str(tmp_path), container, order=["i"])
    assert sorted(os.listdir(tmp_path)) == sorted(n + {"mp4": ".mp4", "matroska": ".mkv", "ogg": ".ogg"}[container] for n in ("a", "b%2Fc", "%C3%A4%20%C3%B6"))
    if container == "ogg":
        back = C.ogg_packets(C.files(spark, f"{tmp_path}/*.ogg")).where("packet >= 2").withColumn("at", F.col("granule") / 48)
    elif container == "mp4":
        back = C.mp4_samples(listed(spark, tmp_path, container)).withColumn("at", F.col("dts_us") / 1000)
        heads = C.track_headers(listed(spark, tmp_path, container)).collect()
        assert {(h["type"], h["codec"]) for h in heads} == {("vide", "avc1.42e01e"), ("soun", "Opus")}
    else:
        back = M.mkv_packets(listed(spark, tmp_path, container)).withColumn("at", F.col("pts_us") / 1000)
        assert {(r["type"], r["codec"], r["channels"]) for r in M.mkv_tracks(listed(spark, tmp_path, container)).collect()} == {("video", "V_MPEG4/ISO/AVC", None), ("audio", "A_OPUS", 2)}
    got = sorted(r["data"] for r in R.payloads(back).collect())
    assert got == sorted(r[4] for r in rows)


def test_ogg_pages_by_their_rules(spark, tmp_path):
    """Sequence numbers, first and last marks, granules only where a packet ends, packets over several pages, read page by page here."""
    rows = [("a", 1, i * 20, True, bytes([i % 256]) * size) for i, size in enumerate([10, 255, 510, 70_000, 0, 3])]
    S.write_containers(spark.createDataFrame(rows, "key string, stream int, ms long, is_key boolean, data binary"), str(tmp_path), "ogg")
    data, at, pages = (tmp_path / "a.ogg").read_bytes(), 0, []
    while at < len(data):
        magic, _, kind, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
        sizes = data[at + 27 : at + 27 + n]
        assert magic == b"OggS"
        pages.append((kind, granule, number, sizes))
        at += 27 + n + sum(sizes)
    assert [p[2] for p in pages] == list(range(len(pages))) and [p[0] & 2 for p in pages] == [2] + [0] * (len(pages) - 1)
    assert [p[0] & 4 for p in pages] == [0] * (len(pages) - 1) + [4]
    for before, page in zip(pages, pages[1:]):
        assert bool(page[0] & 1) == (before[3][-1] == 255)
    assert all((p[1] == -1) == (set(p[3]) == {255}) for p in pages)
    assert pages[-1][1] == 5 * 20 * 48


def test_failed_writes_leave_no_file(spark, tmp_path):
    frame, _ = two_streams(spark)
    bad = frame.withColumn("data", F.when((F.col("key") == "a") & (F.col("i") == 299), None).otherwise(F.col("data")))
    with pytest.raises(Exception, match="without stream, time or data"):
        S.write_containers(bad, str(tmp_path / "out"), "mp4")
    assert os.listdir(tmp_path / "out") == []
    with pytest.raises(Exception, match="columns"):
        frame.select("key").write.format("containers").mode("append").save(str(tmp_path / "out"))
    S.write_containers(frame.limit(0), str(tmp_path / "out"), "mp4")
    assert os.listdir(tmp_path / "out") == []


def test_an_mp4_over_four_gigabytes(tmp_path):
    """Chunks beyond 4 GiB get 64-bit offsets and mdat a 64-bit size; the samples are holes."""
    out = S.Output(str(tmp_path / "a.mp4"))
    layout = S.Mp4(out, {})
    for i in range(10):
        for stream, size in ((0, 500 << 20), (1, 1000)):
            layout.place(stream, i * 40, True, size)
            out.skip(size)
    layout.close()
    out.close()
    rows, n_bytes, _ = fetched(tmp_path / "a.mp4", "mp4")
    assert os.path.getsize(tmp_path / "a.mp4") > 4 << 30 and n_bytes < 1 << 20
    places = [r["a"] for r in rows if r["what"] == "stco"]
    assert places == [40 + i * ((500 << 20) + 1000) for i in range(10)] + [40 + i * ((500 << 20) + 1000) + (500 << 20) for i in range(10)]
    assert not any(r["error"] for r in rows)


def test_matroska_clusters_are_cut_by_span(tmp_path):
    out = S.Output(str(tmp_path / "a.mkv"))
    layout = S.Matroska(out, {})
    for i in range(100):
        layout.add(0, i * 100 + (100_000 if i > 50 else 0), i == 0, b"x" * 10)
    layout.close()
    out.close()
    data = (tmp_path / "a.mkv").read_bytes()
    starts, at = [], data.index(b"\x1f\x43\xb6\x75")
    while at < len(data):
        name, size, body = M.element_at(data, at)
        assert name == M.CLUSTER
        field, n, value = M.element_at(data, body)
        starts.append(int.from_bytes(data[value : value + n], "big"))
        at = body + size
    assert starts == [0, 2000, 4000, 105_100, 107_100, 109_100]


def test_written_files_leave_a_task_in_bounded_batches(spark):
    """A task that writes thousands of files never sends more than some of them on at once."""
    rows = spark.range(0, 60_000, 1, 1).select((F.col("id") % 3000).cast("string").alias("f"), F.col("id").alias("n"), F.col("id").alias("ms"), F.lit(True).alias("is_key"), F.encode(F.rpad(F.lit("x"), 200, "x"), "UTF-8").alias("data"))
    made = W.files(rows.coalesce(1), "f", "n", W.mp4)
    sizes = made.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]}) for b in batches), "rows long, bytes long")
    assert made.count() == 3000 and sizes.agg(F.sum("rows")).first()[0] == 3000
    lists = "collect_list" in made._jdf.queryExecution().toString()
    assert not lists


def test_small_ranges_share_partitions(tmp_path):
    """Many files cut into many ranges: as many ranges, few partitions."""
    for i in range(700):
        (tmp_path / f"{i}.mkv").write_bytes(W.mkv(packets(60)))
    rows, _, parts = fetched(tmp_path, "matroska", splitbytes=3000)
    assert parts <= 2 * R.SPREAD + 2 and len(rows) == 700 * 61 and max(r["seq"] for r in rows) > R.SPLIT_ROWS
    whole, _, _ = fetched(tmp_path, "matroska")
    plain = lambda found: sorted((r["path"], r["at_ns"] or -1, r["offset"] or -1, r["size"] or -1) for r in found)
    assert plain(rows) == plain(whole)


def test_ogg_files_share_partitions_and_are_read_by_pages(spark, tmp_path):
    """Pages through noise, from the source as from whole files; 600 files are no more than a few partitions."""
    out = S.Output(str(tmp_path / "0.ogg"))
    layout = S.Ogg(out, {})
    for ms, is_key, data in packets(400, 3000):
        layout.add(0, ms, is_key, data)
    layout.close()
    out.close()
    content = (tmp_path / "0.ogg").read_bytes()
    (tmp_path / "1.ogg").write_bytes(b"noise" * 40_000 + content[:90_000] + b"OggS" + content[200_000:])
    for i in range(2, 600):
        (tmp_path / f"{i}.ogg").write_bytes(content[:5000])
    names = ("path", "serial", "packet", "offset", "size", "complete")
    plain = lambda df: sorted((os.path.basename(r["path"]), *[r[n] for n in names[1:]]) for r in df.collect())
    found = listed(spark, tmp_path, "ogg")
    assert plain(C.ogg_joined(found)) == plain(C.ogg_packets(C.files(spark, f"{tmp_path}/*.ogg")))
    assert found.rdd.getNumPartitions() <= 8
