"""Containers built from bytes, streaming twins, and properties of operators."""

from __future__ import annotations

import random
import struct

from pyspark.sql import functions as F

from kinograph import catalogue
from kinograph.operators import joins, sequences, timeline
from kinograph.operators.pipeline import Pipeline
from kinograph.sources import containers as C
from tests.oracle import DATA


def in_files(spark, tmp_path, **data):
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    return C.files(spark, str(tmp_path))


def by_name(rows, name):
    return [r for r in rows if r["path"].endswith("/" + name)]


def flv_tag(kind, dts, body):
    return bytes([kind]) + len(body).to_bytes(3, "big") + (dts & 0xFFFFFF).to_bytes(3, "big") + bytes([dts >> 24]) + bytes(3) + body + (len(body) + 11).to_bytes(4, "big")


def test_flv(spark, tmp_path):
    head = b"FLV\x01\x05" + (9).to_bytes(4, "big") + bytes(4)
    good = head + flv_tag(9, 0, b"\x17\x00\x00\x00\x00cfg") + flv_tag(9, 40, b"\x17\x01\xff\xff\xf6xx") + flv_tag(8, 45, b"\xaf\x01yy") + flv_tag(9, 1 << 24, b"\x27\x01\x00\x00\x05z")
    rows = C.flv_packets(in_files(spark, tmp_path, good=good, cut=good[:-8], bad=b"nothing")).orderBy("path", "seq").collect()
    found = by_name(rows, "good")
    assert [(r["kind"], r["pts_us"], r["is_key"], r["is_config"]) for r in found] == [("video", 0, True, True), ("video", 30_000, True, False), ("audio", 45_000, False, False), ("video", (1 << 24) * 1000 + 5000, False, False)]
    assert [r["error"] is None for r in by_name(rows, "cut")] == [True, True, True, False] and by_name(rows, "bad")[0]["error"]


def ogg_page(serial, page, sizes, granule=0):
    head = b"OggS\x00\x00" + struct.pack("<qII", granule, serial, page) + bytes(4) + bytes([len(sizes)]) + bytes(sizes)
    data = head + bytes(sum(sizes))
    return data[:22] + struct.pack("<I", C.ogg_crc(data)) + data[26:]


def test_ogg(spark, tmp_path):
    broken = bytearray(ogg_page(1, 7, [9]))
    broken[-1] ^= 1
    data = ogg_page(1, 0, [255, 10]) + b"junk" + ogg_page(2, 0, [3]) + bytes(broken) + ogg_page(1, 1, [255, 255]) + ogg_page(1, 2, [1, 0, 255])
    rows = C.ogg_packets(in_files(spark, tmp_path, a=data)).orderBy("serial", "packet").collect()
    assert [(r["serial"], r["size"], r["complete"]) for r in rows] == [(1, 265, True), (1, 511, True), (1, 0, True), (1, 255, False), (2, 3, True)]


def riff(tag, body):
    return tag + struct.pack("<I", len(body)) + body + bytes(len(body) & 1)


def test_avi(spark, tmp_path):
    header = lambda kind, scale, rate: riff(b"strh", kind + bytes(16) + struct.pack("<II", scale, rate) + bytes(28))
    movi = riff(b"00dc", b"abc") + riff(b"01wb", b"de") + riff(b"00dc", b"f") + riff(b"01wb", b"ghi")
    data = b"RIFF" + struct.pack("<I", 999) + b"AVI " + b"LIST" + struct.pack("<I", 9) + b"hdrl" + header(b"vids", 1, 25) + header(b"auds", 1, 50) + b"LIST" + struct.pack("<I", len(movi) + 4) + b"movi" + movi
    rows = C.avi_packets(in_files(spark, tmp_path, a=data)).orderBy("stream", "n").collect()
    assert [(r["type"], r["pts_us"], r["size"], data[r["offset"] : r["offset"] + r["size"]]) for r in rows] == [("vids", 0, 3, b"abc"), ("vids", 40_000, 1, b"f"), ("auds", 0, 2, b"de"), ("auds", 20_000, 3, b"ghi")]


def box(name, *body):
    body = b"".join(body)
    return struct.pack(">I", len(body) + 8) + name + body


def full(name, *numbers):
    return box(name, bytes(4), b"".join(n if isinstance(n, bytes) else struct.pack(">i", n) for n in numbers))


def test_mp4(spark, tmp_path):
    table = box(b"stbl", full(b"stts", 2, 3, 100, 2, 50), full(b"ctts", 2, 1, 200, 4, -50), full(b"stsc", 2, 1, 2, 1, 2, 3, 1), full(b"stsz", 0, 5, 10, 20, 30, 40, 50), full(b"stco", 2, 1000, 5000), full(b"stss", 2, 1, 4))
    track = box(b"trak", box(b"mdia", full(b"mdhd", 0, 0, 1000, 500, 0), full(b"hdlr", 0, b"vide", 0), box(b"minf", table)))
    data = box(b"ftyp", b"isom") + box(b"moov", track)
    rows = C.mp4_packets(in_files(spark, tmp_path, a=data, cut=data[:60])).orderBy("sample").collect()
    assert [(r["dts_us"], r["pts_us"], r["offset"], r["size"], r["is_key"]) for r in rows] == [
        (0, 200_000, 1000, 10, True), (100_000, 50_000, 1010, 20, False), (200_000, 150_000, 5000, 30, False), (300_000, 250_000, 5030, 40, True), (350_000, 300_000, 5070, 50, False),
    ]
    assert {r["type"] for r in rows} == {"vide"} and {r["dur_us"] for r in rows} == {100_000, 50_000}


def test_wav(spark):
    row = C.wav_bytes(spark.createDataFrame([(1, [0.0, 1.0, -1.0, 2.0])], "id long, x array<double>"), "id", "x", 8000).first()
    assert row["wav"][:4] == b"RIFF" and struct.unpack("<4h", row["wav"][44:]) == (0, 32767, -32768, 32767)


def test_bucketed_joins_equal_plain_ones(spark):
    rng = random.Random(1)
    spans = [(i, lo, lo + rng.choice([0, 1, 3, 40, 900])) for i in range(300) for lo in [rng.randrange(1000)]]
    intervals = spark.createDataFrame(spans, "id long, lo long, hi long")
    points = spark.range(0, 1000, 13).withColumnRenamed("id", "t")
    plain = sorted(map(tuple, joins.stab(points, intervals, "t", "lo", "hi").select("t", "id").collect()))
    for levels in (0, 3, 12):
        assert sorted(map(tuple, joins.stab_bucketed(points, intervals, "t", "lo", "hi", 4, levels=levels).select("t", "id").collect())) == plain
    keyed = intervals.withColumn("k", F.lit(1))
    pairs = joins.overlap(keyed, keyed, "lo", "hi", 16, ["k"]).select("id", "other_id").collect()
    want = sorted((a[0], b[0]) for a in spans for b in spans if a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and a[2] > b[1])
    assert sorted(map(tuple, pairs)) == want
    plan = joins.stab_bucketed(points, intervals, "t", "lo", "hi", 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_asof_without_facts_and_before_the_first(spark):
    probes = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t long")
    facts = spark.createDataFrame([("a", 3, "x"), ("a", 5, "y")], "k string, at long, v string")
    found = {(r["k"], r["t"]): r["v"] for r in joins.asof(probes, facts, ["k"], "t", "at", ["v"]).collect()}
    assert found == {("a", 1): None, ("a", 5): "y", ("b", 5): None}
    first = {(r["k"], r["t"]): r["v"] for r in joins.asof(probes, facts, ["k"], "t", "at", ["v"], clamp_first=True).collect()}
    assert first == {("a", 1): "x", ("a", 5): "y", ("b", 5): None}


def test_rle_round_trip(spark):
    rng = random.Random(2)
    values = [(1, i, rng.choice("ab")) for i in range(200)]
    coded = sequences.rle_encode(spark.createDataFrame(values, "k long, i long, v string"), ["k"], ["i"], "v")
    back = sequences.rle_expand(coded, "n").orderBy("run", "k").select("v").collect()
    assert "".join(r["v"] for r in back) == "".join(v for _, _, v in values)


def test_grouped_fold_streams_keys(spark):
    def make():
        total = 0

        def add(_, v):
            nonlocal total
            total += v
            return [total]

        return add

    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), F.lit(1).cast("long").alias("v"))
    out = sequences.grouped_fold(rows, "k", ["i"], "v", make, "k long, i long, total long")
    assert out.where(F.col("total") != F.expr("i div 3 + 1")).isEmpty() and out.count() == 3000


def test_overlaps_are_pushed_from_clip_to_clip(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, lo, lo + rng.randrange(1, 40)) for i in range(900) for lo in [rng.randrange(4000)]]
    want = set()
    for track in range(3):
        end = None
        shift = 0
        for lo, i, hi in sorted((lo, i, hi) for i, t, lo, hi in rows if t == track):
            shift += max(0, end - (lo + shift)) if end is not None else 0
            end = hi + shift
            want.add((track, i, lo + shift, end))
    clips = spark.createDataFrame(rows, "clip_id long, track long, lo long, hi long")
    assert set(map(tuple, timeline.resolve_overlaps(clips, ["track"], "clip_id").collect())) == want


def test_whole_queries_read_every_row(spark):
    d = str(DATA)
    rows = lambda name: spark.read.parquet(f"{d}/{name}.parquet").count()
    whole = catalogue.queries()
    assert whole["resolve_overlaps"](spark, d).count() == rows("orders")
    assert whole["dft_magnitude"](spark, d).select("source_id").distinct().count() == rows("embeddings")
    assert whole["spectral_flux"](spark, d).select("source_id").distinct().count() == rows("embeddings")
    assert whole["comp_flatten"](spark, d).count() == rows("orders")
    wide = str(DATA.parent / "sf0.01")  # sf0.001 has 200 parts
    assert whole["point_in_rotated_rect"](spark, wide).agg(F.max("top")).first()[0] >= 200


def test_whole_queries_read_every_frame_and_long_tracks(spark, tmp_path):
    whole = catalogue.queries()
    events = spark.range(700).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "id % 7 DIV 6 AS user_id", "'view' AS event_type", "CAST(id * 37 % 490 AS double) AS value", "'{}' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    for name in ("kalman_smooth", "ducking_gain"):
        found = whole[name](spark, str(tmp_path))
        assert sorted(r["n"] for r in found.where("track = 0").collect()) == list(range(1, 601))
    values = [i * 37 % 490 / 100 for i in range(700) if i % 7 != 6]
    step = sequences.kalman_steps()
    want = [round(step(v), 4) for v in values]
    p, x = 1.0, 0.0
    for v in values:
        gain = (p + 1e-5) / (p + 1e-5 + 1e-2)
        p, x = (1 - gain) * (p + 1e-5), x + gain * (v - x)
    assert want[-1] == round(x, 4)
    assert all(abs(a["x"] - b) < 2e-4 for a, b in zip(whole["kalman_smooth"](spark, str(tmp_path)).where("track = 0").orderBy("n").collect(), want))
    days = whole["composite_layers"](spark, str(DATA)).agg(F.max("day")).first()[0]
    assert days == spark.read.parquet(f"{DATA}/orders.parquet").selectExpr("max(datediff(to_date(o_orderdate), date'1995-01-01') + o_orderkey % 50)").first()[0] > 400
    changed = whole["changed_frames"](spark, str(DATA)).agg(F.count_distinct("track"), F.max("day")).first()
    assert changed[0] == 16 and changed[1] > 400


def test_diff_apply_undo(spark):
    row = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"})], "o map<string,string>, n map<string,string>")
    patched = row.withColumn("p", timeline.map_diff(F.col("o"), F.col("n")))
    out = patched.select(timeline.apply_patches(F.col("o"), F.col("p")).alias("n"), timeline.apply_patches(F.col("n"), F.col("p"), undo=True).alias("o")).first()
    assert out["n"] == {"b": "3", "c": "4"} and out["o"] == {"a": "1", "b": "2"}


def test_pipeline_order(spark):
    add = lambda n: lambda df: df.withColumn("v", F.col("v") * 10 + n)
    out = Pipeline().use(before=add(1)).use(after=add(3)).run(spark.range(1).select(F.lit(0).alias("v")), add(2))
    assert out.first()["v"] == 123


def test_streams_equal_batches(spark, tmp_path):
    from kinograph.sources.tables import packets
    from kinograph.streaming import live
    from tests.oracle import DATA

    rows = packets(spark, str(DATA)).withColumn("ts", F.timestamp_micros("pts")).orderBy("pts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, plan, mode in (("rebased", live.rebase(stream), "append"), ("tumbled", live.tumbling(stream), "complete"), ("sessions", live.sessions(stream), "complete")):
        q = plan.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    first = {r["track"]: r["p"] for r in rows.groupBy("track").agg(F.min("pts").alias("p")).collect()}
    want = sorted((r["track"], r["event_id"], r["pts"] - first[r["track"]]) for r in rows.collect())
    assert sorted(map(tuple, spark.table("rebased").collect())) == want
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == rows.count()
    batch = rows.groupBy("track", F.session_window("ts", "30 minutes")).count().count()
    assert spark.table("sessions").count() == batch


def test_asof_before_the_first_fact_of_a_long_key(spark):
    """One key with many probes and facts takes seconds; probes before the first fact get that one."""
    n = 300_000
    facts = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 2 + 1000).alias("ft"), F.col("id").alias("v"))
    probes = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    rows = joins.asof(probes, facts, ["k"], "t", "ft", ["ft", "v"], clamp_first=True)
    want = F.when(F.col("t") < 1000, 0).otherwise(F.expr("(t - 1000) div 2"))
    assert rows.where(F.col("v") != want).count() == 0 and rows.count() == n


def test_upper_median_and_gaps_without_arrays(spark):
    rows = spark.createDataFrame([(k, float(v)) for k, vs in ((1, [3, 1, 2]), (2, [4, 1, 2, 2]), (3, [5]), (4, [7, 7, 7, 1])) for v in vs] + [(5, None)], "k long, v double")
    assert {r["k"]: r["median"] for r in sequences.upper_median(rows, ["k"], "v").collect()} == {1: 2.0, 2: 2.0, 3: 5.0, 4: 7.0}
    step = sequences.greedy_gap_steps(2)
    assert [t for t in (0, 1, 2, 3, 3, 5, 6, 9) if step(t)] == [0, 3, 6, 9]


def test_gcd_of_neighbouring_fibonacci_numbers(spark):
    a, b = 1, 1
    while a + b < 2**63:
        a, b = a + b, a
    from kinograph.functions.curves import gcd

    assert spark.range(1).select(gcd(F.lit(a), F.lit(b))).first()[0] == 1


PACKETS_WRITTEN = [(i * 40 + (i % 3), i % 10 == 0, f"packet {i} ".encode() * (1 + i % 4 * 10)) for i in range(200)]


def test_written_files_hold_their_packets_where_the_parsers_say(spark):
    from kinograph.sources import matroska as M
    from kinograph.sources import writers as W

    same = [(ms, key, b"%08d" % ms) for ms, key, _ in PACKETS_WRITTEN]
    layouts = {"mp4": W.mp4, "avi": W.avi, "mkv": W.mkv, "xiph": lambda p: W.mkv(p, 1, 3), "ebml": lambda p: W.mkv(p, 3, 4), "fixed": lambda p: W.mkv(p, 2, 5)}
    contents = {name: make(same if name == "fixed" else PACKETS_WRITTEN) for name, make in layouts.items()}
    for name, content in contents.items():
        files = spark.createDataFrame([(name, content)], "path string, content binary")
        rows = C.mp4_packets(files) if name == "mp4" else C.avi_packets(files) if name == "avi" else M.mkv_packets(M.mkv_rows(files))
        found = sorted((r["offset"], r["size"], r["is_key"]) for r in rows.collect())
        want = same if name == "fixed" else PACKETS_WRITTEN
        assert [content[a : a + n] for a, n, _ in found] == [p[2] for p in want]
        if name in ("mp4", "avi", "mkv"):
            assert [k for *_, k in found] == [p[1] for p in want]
        assert len({a for a, *_ in found}) == len(want)


def test_matroska_damage_groups_and_unknown_sizes(spark):
    from kinograph.sources import matroska as M
    from kinograph.sources import writers as W

    whole = W.mkv(PACKETS_WRITTEN)
    group = W.element(0xA0, W.element(0xA1, W.number(1), struct.pack(">hB", 7, 1), b"abc"), W.unsigned(0x9B, 30))
    open_ended = b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + W.element(0x1F43B675, W.unsigned(0xE7, 100), group)
    names = {"cut": whole[: len(whole) // 2], "garbage": b"\x00\x01\x02", "empty": b"", "open": open_ended, "laces": W.element(0x18538067, W.element(0x1F43B675, W.element(0xA3, W.number(1), b"\x00\x00\x02", b"\x05\xff\xff\x01")))}
    rows = M.mkv_rows(spark.createDataFrame(list(names.items()), "path string, content binary")).collect()
    errors = {r["path"] for r in rows if r["error"]}
    assert errors == {"cut", "garbage", "laces"} and sum(r["path"] == "cut" and r["what"] == "block" for r in rows) > 0
    packets = M.mkv_packets(M.mkv_rows(spark.createDataFrame([("open", open_ended)], "path string, content binary"))).collect()
    assert [(p["pts_us"], p["dur_us"], p["is_key"], p["discardable"], p["size"]) for p in packets] == [(107_000, 30_000, False, True, 3)]
    assert C.damage(spark.createDataFrame([("a", b"RIFF\x00\x00\x00\x00AVI 00dc\xff\xff\x00\x00")], "path string, content binary"), C.avi_walker, C.AVI_SCHEMA).count() == 1


def test_codecs_enhanced_tags_and_corrupt_counts(spark):
    entries = [("avc1", bytes.fromhex("0164001f")), ("avc1", None), ("vp09", bytes.fromhex("01000000021fa0")), ("mp4a", None), ("av01", None)]
    entries += [("hvc1", bytes.fromhex("01a16000000090000000000078")), ("hev1", bytes.fromhex("01026000")), ("hev1", None), ("av01", bytes.fromhex("81494c00")), ("av01", bytes.fromhex("81056000"))]
    rows = spark.createDataFrame(entries, "e string, c binary").select(C.codec_string(F.col("e"), F.col("c"))).collect()
    assert [r[0] for r in rows] == ["avc1.64001f", "avc1.42E01E", "vp09.02.31.10", "mp4a.40.2", "av01.0.08M.08", "hvc1.B1.H120", "hev1.2.L93", "hev1.1.6.L93.B0", "av01.2.09M.10", "av01.0.05M.10"]
    head = b"FLV\x01\x05\x00\x00\x00\x09" + bytes(4)
    tags = [flv_tag(9, 0, b"\x90hvc1"), flv_tag(9, 10, b"\x91hvc1\xff\xff\xfe!"), flv_tag(9, 20, b"\xa3hvc1!"), flv_tag(9, 30, b"\x12\x01\x02\x03\x04")]
    found = C.flv_packets(spark.createDataFrame([("f", head + b"".join(tags))], "path string, content binary")).orderBy("seq").collect()
    assert [(r["pts_us"], r["is_key"], r["is_config"]) for r in found] == [(0, True, True), (8000, True, False), (20_000, False, False), (30_000, True, False)]
    stsz = box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", full(b"stsz", 1, b"\xff\xff\xff\xff"))))))
    assert C.walk(spark.createDataFrame([("m", stsz)], "path string, content binary"), C.mp4_walker, C.MP4_SCHEMA).count() <= len(stsz)


def test_subtitle_rules(spark):
    from kinograph.functions import text as T

    vtt = "WEBVTT\n\n1:02:03.5 --> 01:02:04.25 align:start position:10%\n  <b>one</b> \n\nid\n00:00:01.000 --> 00:00:02.000 align:right\ntwo"
    cues = spark.createDataFrame([(vtt,)], "t string").select(T.vtt_cues(F.col("t"))).first()[0]
    assert [(c["start_ms"], c["end_ms"], c["align"], c["text"]) for c in cues] == [(3_723_500, 3_724_250, "center", "one"), (1000, 2000, "right", "two")]
    srt = "1\n00:00:01,000 --> 00:00:02,000\na\n\nword\n00:00:03,000 --> 00:00:04,000\nb\n\n00:00:05,000 --> 00:00:06,000\nc"
    found = spark.createDataFrame([(srt,)], "t string").select(T.srt_cues(F.col("t"))).first()[0]
    assert [c["text"] for c in found] == ["a", "c"]
