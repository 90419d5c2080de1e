"""Two-sided streams and upserts: what comes late, or twice, gives the batch query's rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinograph.sources.tables import packets
from kinograph.streaming import live
from tests.oracle import DATA


@pytest.fixture(scope="module")
def flow(spark):
    return packets(spark, str(DATA)).withColumn("ts", F.timestamp_micros("pts")).cache()


def run(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return q


def sides(df):
    left = df.where("event_type = 'view'").select("track", "event_id", "ts")
    right = df.where("event_type = 'click'").select("track", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    return left, right


def test_interval_join_of_two_streams(spark, flow, tmp_path):
    ordered = flow.orderBy("pts")
    for i, part in enumerate(ordered.withColumn("n", F.ntile(5).over(Window.orderBy("pts"))).where(f"n = {i + 1}").drop("n") for i in range(5)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(flow.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    joined = live.interval_join(*sides(stream), ["track"], "ts", "click_ts", "6 hours", "30 minutes", late="40 days")
    assert joined.isStreaming
    run(joined, tmp_path, "joined")
    batch = live.interval_join(*sides(flow), ["track"], "ts", "click_ts", "6 hours", "30 minutes")
    want = sorted((r["event_id"], r["click_id"]) for r in batch.collect())
    left, right = (x.collect() for x in sides(flow))
    plain = sorted((a["event_id"], b["click_id"]) for a in left for b in right if a["track"] == b["track"] and -6 * 3600 <= (b["click_ts"] - a["ts"]).total_seconds() <= 1800)
    assert want == plain and want
    assert sorted((r["event_id"], r["click_id"]) for r in spark.table("joined").collect()) == want


def rows(table):
    return sorted(tuple(r) for r in table.select("track", "name", "value", "pts").collect())


@pytest.mark.parametrize("fanout", [2, 100])
def test_upserts_survive_late_and_repeated_batches(spark, flow, tmp_path, fanout):
    facts = flow.select("track", F.col("event_type").alias("name"), "value", "pts", "event_id")
    batches = [facts.where(f"event_id % 7 = {k}") for k in (3, 0, 6, 1, 5, 2, 4)]  # times go back and forth between batches
    held = live.Upserts(str(tmp_path / "table"), ["track", "name"], ["pts", "event_id"], fanout=fanout)
    assert held.read(spark) is None
    for i, batch in enumerate(batches):
        held.write(batch.where("event_id % 2 = 0"), i)  # a first try that got half of the rows
        held.write(batch, i)
        held.write(batch, i)
        held.write(batch, max(0, i - 3)) if fanout == 2 and i - 3 >= 0 and i - 3 <= max(held.parts(spark, "run"), default=-1) else None
        seen = batches[0]
        for b in batches[1 : i + 1]:
            seen = seen.unionByName(b)
        assert rows(held.read(spark)) == rows(seen.groupBy("track", "name").agg(F.max_by("value", "pts").alias("value"), F.max("pts").alias("pts")))
    assert len(held.parts(spark, "batch")) <= fanout + 1 and len(held.parts(spark, "run")) == (fanout == 2)


def test_upserts_by_a_stream_that_restarts(spark, flow, tmp_path):
    held = live.Upserts(str(tmp_path / "table"), ["track", "name"], ["pts", "event_id"], fanout=2)
    facts = flow.select("track", F.col("event_type").alias("name"), "value", "pts", "event_id")
    failed = []

    def write(batch, number):
        held.write(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost after the write")

    for k in range(4):
        facts.where(f"event_id % 4 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for attempt in range(2):
        stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception:
            assert attempt == 0
    assert failed == [1]
    assert rows(held.read(spark)) == rows(facts.groupBy("track", "name").agg(F.max_by("value", "pts").alias("value"), F.max("pts").alias("pts")))


def recorded(rows):
    """The recorder by a plain loop: rows (track, event_id, pts, kind) in order."""
    out, state = [], {}
    for track, event_id, pts, kind in rows:
        s = state.setdefault(track, {"first": None, "last": -1, "paused": 0, "since": None})
        if kind == "pause":
            s["since"] = pts if s["since"] is None else s["since"]
        elif kind == "resume":
            s["paused"] += max(0, pts - s["since"]) if s["since"] is not None else 0
            s["since"] = None
        elif s["since"] is None:
            s["first"] = pts if s["first"] is None else s["first"]
            if pts - s["first"] - s["paused"] >= 0:
                s["last"] = max(pts - s["first"] - s["paused"], s["last"] + 1)
                out.append((track, event_id, s["last"]))
    return sorted(out)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set(name, was)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_recorder_goes_on_after_a_restart(spark, flow, rocks, tmp_path):
    """Errors pause and purchases resume; one file a batch, the stream stopped and started between them."""
    kind = F.when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "purchase", "resume").otherwise("data")
    rows = flow.where("track < 6").select("track", "event_id", "pts", kind.alias("kind"), "ts").orderBy("pts").collect()
    cut = [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    want = recorded([tuple(r)[:4] for part in cut for r in part])
    for part in cut:
        spark.createDataFrame(part, flow.select("track", "event_id", "pts", kind.alias("kind"), "ts").schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("track long, event_id long, pts long, kind string, ts timestamp").parquet(str(tmp_path / "in"))
        q = live.recording(stream, idle="900 days", late="1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("track", "event_id", "pts").collect())
    assert got == want and len(got) > 20


def test_recorder_forgets_idle_tracks(spark, rocks, tmp_path):
    """A track that comes back after its timer starts at zero again."""
    start, out = 1_700_000_000_000_000, str(tmp_path / "out")
    files = [[(1, 1, start), (1, 2, start + 5)], [(2, 3, start + 10**12)], [(2, 4, start + 2 * 10**12)], [(1, 5, start + 2 * 10**12 + 7), (1, 6, start + 2 * 10**12 + 9)]]
    for part in files:
        df = spark.createDataFrame([(*r, "data") for r in part], "track long, event_id long, pts long, kind string").withColumn("ts", F.timestamp_micros("pts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = live.recording(stream, idle="1 day", late="1 second").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    got = {r["event_id"]: r["pts"] for r in spark.read.parquet(out).collect()}
    assert (got[1], got[2], got[5], got[6]) == (0, 5, 0, 2)
