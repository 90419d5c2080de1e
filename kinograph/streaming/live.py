"""Live packet flows: Structured Streaming twins of the batch operators, and state per track."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(packets: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Packets and bytes per track and window; rows later than ``late`` are dropped."""
    return packets.withWatermark("ts", late).groupBy("track", F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.sum("size").alias("size"))


def hopping(packets: DataFrame, size: str = "2 hours", hop: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return packets.withWatermark("ts", late).groupBy(F.window("ts", size, hop).alias("w")).agg(F.count("*").alias("n"))


def sessions(packets: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return packets.withWatermark("ts", late).groupBy("track", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def rebase(packets: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """(track, event_id, pts): times from the track's first packet on, never falling: a late one is put 1 us after the last.

    State per track is two numbers; a track silent for ``idle_ms`` is forgotten. Within a micro-batch rows are
    taken in order of time.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["pts", "event_id"])
        first, last = state.get if state.exists else (int(rows["pts"].iloc[0]), -1)
        out = []
        for pts in rows["pts"]:
            last = max(int(pts) - first, last + 1)
            out.append(last)
        state.update((first, last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"track": key[0], "event_id": rows["event_id"].to_numpy(), "pts": out})

    return packets.select("track", "event_id", "pts").groupBy("track").applyInPandasWithState(step, "track long, event_id long, pts long", "first long, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def interval_join(left: DataFrame, right: DataFrame, on: list[str], t: str, right_t: str, before: str, after: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of rows of two streams with equal keys, the right one's time from ``before`` earlier to ``after`` later than the left one's.

    Both sides have a watermark, and the bounds on time let each forget what no later row of the other can meet; rows
    later than ``late`` are dropped. Columns of the right side, keys but for, must have names of their own. On tables it is a plain join.
    """
    left, right = left.withWatermark(t, late), right.withWatermark(right_t, late)
    keys = right.select(*[F.col(k).alias(f"__{k}") if k in on else F.col(k) for k in right.columns])
    met = F.expr(f"{right_t} >= {t} - INTERVAL {before} AND {right_t} <= {t} + INTERVAL {after}")
    for k in on:
        met &= F.col(k) == F.col(f"__{k}")
    return left.join(keys, met).drop(*[f"__{k}" for k in on])


class Upserts:
    """A table of the latest row per key, kept by ``foreachBatch``: ``writeStream.foreachBatch(Upserts(...).write)``.

    A micro-batch is written under its own number, in place of what an earlier try of the same batch left, so
    that a repeated batch changes nothing. After ``fanout`` batches, those before the newest are merged
    into one run; the newest is left alone, as only that one can come again. Readers merge the run and the batches
    after it: of rows with one key, the one with the largest ``order`` counts, whichever batch brought it, so late rows don't replace newer ones.
    """

    def __init__(self, folder: str, key: list[str], order: list[str], fanout: int = 8):
        self.folder, self.key, self.order, self.fanout = folder.rstrip("/"), key, order, fanout

    def _files(self, spark):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def parts(self, spark, kind: str) -> list[int]:
        """Numbers of the complete ``batch`` or ``run`` folders, ascending."""
        system, path = self._files(spark)
        names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
        done = lambda n: system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))
        return sorted(int(n.split("-")[1]) for n in names if n.startswith(f"{kind}-") and done(n))

    def latest(self, rows: DataFrame) -> DataFrame:
        newest = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rows.columns), F.struct(*self.order)).alias("__row"))
        return newest.select("__row.*")

    def _held(self, spark) -> tuple[list[str], int]:
        """The folders that make up the table, and the batch that the run reaches to."""
        runs = self.parts(spark, "run")
        upto = runs[-1] if runs else -1
        return [*[f"run-{n:012d}" for n in runs[-1:]], *[f"batch-{n:012d}" for n in self.parts(spark, "batch") if n > upto]], upto

    def read(self, spark) -> DataFrame | None:
        """The table as it is; None before the first batch."""
        folders, _ = self._held(spark)
        return self.latest(spark.read.parquet(*[f"{self.folder}/{f}" for f in folders])) if folders else None

    def write(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _, upto = self._held(spark)
        if number <= upto:
            return  # merged already
        self.latest(batch).write.mode("overwrite").parquet(f"{self.folder}/batch-{number:012d}")
        older = [n for n in self.parts(spark, "batch") if upto < n < number]
        if len(older) >= self.fanout:
            folders = [f for f in self._held(spark)[0] if f != f"batch-{number:012d}"]
            self.latest(spark.read.parquet(*[f"{self.folder}/{f}" for f in folders])).write.mode("overwrite").parquet(f"{self.folder}/run-{older[-1]:012d}")
            system, _ = self._files(spark)
            for f in folders:  # readers take the run from now on
                system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{f}"), True)


class Recorder(StatefulProcessor):
    """Times of a recording from its first packet on, without the time it stood still.

    Per track: the first packet's time, the last time given out, the time paused so far and since when it is paused. A
    packet while paused is dropped, and so is one from before the first, whose time would be negative; times never fall, a late
    one is put 1 us after the last. A timer in event time, renewed by every batch, forgets a track that is ``idle_us`` behind the watermark.
    """

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("recording", "first long, last long, paused long, since long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, last, paused, since, timer = self.state.get() if self.state.exists() else (None, -1, 0, None, None)
        newest = None
        for part in rows:  # in order of time already: a part at a time, whatever the batch's size
            ids, out = [], []
            for event_id, pts, kind in zip(part["event_id"].tolist(), part["pts"].tolist(), part["kind"].tolist()):
                newest = pts if newest is None else max(newest, pts)
                if kind == "pause":
                    since = pts if since is None else since
                elif kind == "resume":
                    paused += max(0, pts - since) if since is not None else 0
                    since = None
                elif since is None:
                    first = pts if first is None else first
                    at = pts - first - paused
                    if at >= 0:
                        last = max(at, last + 1)
                        ids.append(event_id)
                        out.append(last)
            yield pd.DataFrame({"track": key[0], "event_id": ids, "pts": out}).astype({"event_id": "int64", "pts": "int64"})
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = (newest + self.idle_us) // 1000
        self.handle.registerTimer(timer)
        self.state.update((first, last, paused, since, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({"track": [], "event_id": [], "pts": []}).astype("int64")

    def close(self) -> None:
        pass


def recording(packets: DataFrame, idle: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """(track, event_id, pts) of a stream of (track, event_id, pts, kind, ts), kind "pause" and "resume" for the controls; see :class:`Recorder`.

    Needs the RocksDB state store. A restart from the checkpoint goes on where it was. A track's rows of one micro-batch are taken as they
    come, so they should come in order.
    """
    idle_us = pd.Timedelta(idle) // pd.Timedelta("1us")
    rows = packets.select("track", "event_id", "pts", "kind", "ts").withWatermark("ts", late)
    return rows.groupBy("track").transformWithStateInPandas(Recorder(idle_us), "track long, event_id long, pts long", "append", "eventTime")
