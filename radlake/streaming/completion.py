"""Receive stream: series completion per sender, duplicates, counters, periodic statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Silence after which a sender's last series counts as complete, and how long a complete series is remembered.
QUIET_MS, REMEMBERED_MS = 600_000, 7 * 86_400_000
OUT = "ae long, series_uid string, n long, first timestamp, last timestamp, sop_uids array<string>, paths array<string>"
ALL = f"{OUT}, late boolean"
_NAMES = [c.split()[0] for c in ALL.split(", ")]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Series(StatefulProcessor):
    """Of each sender: the open series, its files, its SOP UIDs, and the series that are complete.

    A series that begins and ends in one micro-batch never becomes state. Of one that
    stays open, files are appended to a list and SOP UIDs put into a map one by one,
    so a batch writes at most as much state as it has rows; only when the series ends
    are they read. Rows of a micro-batch come in no order: those of a sender are
    sorted by time.
    """

    def __init__(self, count_repeats: bool, drop_late: bool, quiet_ms: int):
        self.count_repeats, self.drop_late, self.quiet_ms = count_repeats, drop_late, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "series_uid string, n long, first timestamp, last timestamp")
        self.files = handle.getListState("files", "sop_uid string, path string")
        self.sops = handle.getMapState("sops", "sop_uid string", "n long")
        self.complete = handle.getMapState("complete", "series_uid string", "n long", ttlDurationMs=REMEMBERED_MS if self.drop_late else None)

    def ended(self, key: tuple, now: list, added: list[tuple], kept: bool) -> tuple:
        """The open series as a row, with files that came in this batch; kept: some of it is state, which goes."""
        uid, n, first, last = now
        files = (list(self.files.get()) if kept else []) + added
        sops = list(dict.fromkeys(f[0] for f in files))
        if kept:
            self.open.clear()
            self.files.clear()
            self.sops.clear()
        if self.drop_late:
            self.complete.updateValue((uid,), (n,))
        return key[0], uid, n, first, last, sops, [f[1] for f in files], False

    def quiet(self, timers, before: bool, again: bool) -> None:
        """The timer of the sender's silence, set anew; before: a series was open, so there is one."""
        if before:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if again:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.quiet_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat([b[["ts", "event_id", "series_uid", "sop_uid", "path", "released"]] for b in rows]).sort_values(["ts", "event_id"])
        before = self.open.exists()
        now, kept = (list(self.open.get()), True) if before else (None, False)
        out: list[tuple] = []
        late: dict[str, list] = {}
        # of the open series: files and SOP UIDs of this batch
        added: list[tuple] = []
        seen: set = set()
        complete: dict[str, bool] = {}

        def is_complete(uid) -> bool:
            if uid not in complete:
                complete[uid] = self.complete.containsKey((uid,))
            return complete[uid]

        for ts, uid, sop, path, released in zip(batch.ts, batch.series_uid, batch.sop_uid, batch.path, batch.released):
            if not released and self.drop_late and (now is None or now[0] != uid) and is_complete(uid):
                times = late.setdefault(uid, [0, ts, ts])
                times[0], times[2] = times[0] + 1, ts
                continue
            if now is not None and (released or now[0] != uid):
                out.append(self.ended(key, now, added, kept))
                complete[now[0]] = True
                now, kept, added, seen = None, False, [], set()
            if released:
                continue
            if now is None:
                now = [uid, 0, ts, ts]
            now[3] = ts
            fresh = sop not in seen and not (kept and self.sops.containsKey((sop,)))
            if fresh:
                seen.add(sop)
            if fresh or self.count_repeats:
                now[1] += 1
                added.append((sop, path))
        if now is not None:
            if added:
                self.files.appendList(added)
            for sop in seen:
                self.sops.updateValue((sop,), (1,))
            self.open.update(tuple(now))
        self.quiet(timerValues, before, now is not None)
        out += [(key[0], uid, n, first, last, [], [], True) for uid, (n, first, last) in late.items()]
        if out:
            yield pd.DataFrame(out, columns=_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield pd.DataFrame([self.ended(key, list(self.open.get()), [], True)], columns=_NAMES)

    def close(self) -> None:
        pass


def series_stream(received: DataFrame, count_repeats: bool = True, drop_late: bool = False, quiet_ms: int = QUIET_MS) -> DataFrame:
    """ALL from a stream of (event_id, ts, ae, series_uid[, sop_uid, path, released]): complete series, and late files.

    A series is complete when its sender goes on to another, releases its
    association (a row with released), or is silent past quiet_ms. count_repeats: a
    file whose SOP UID came before counts in n and paths, as in the studied
    application; sop_uids has each once. drop_late: a file of a series that is
    complete opens nothing and ends nothing; a row with late counts those of a
    batch. Needs the RocksDB state store, which is set here; a timeout by
    processing time asks for batches without data for ever: a query that is to end
    is run with run_to_end().
    """
    received.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for name, value in (("sop_uid", F.col("event_id").cast("string")), ("path", F.lit(None).cast("string")), ("released", F.lit(False))):
        if name not in received.columns:
            received = received.withColumn(name, value)
    return received.groupBy("ae").transformWithStateInPandas(Series(count_repeats, drop_late, quiet_ms), ALL, "Append", "ProcessingTime")


def completed_series(received: DataFrame, count_repeats: bool = False) -> DataFrame:
    """(ae, series_uid, n, first, last, sop_uids, paths) of series that are complete; see series_stream."""
    return series_stream(received, count_repeats).filter("NOT late").drop("late")


def run_to_end(spark: SparkSession, writer) -> None:
    """Runs a query over all that is there now, and ends."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)


def without_repeats(received: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Drops instances seen before, as long as the watermark remembers them."""
    return received.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def counters(received: DataFrame, by: str, size: str) -> DataFrame:
    """Running totals per key, for update or complete mode."""
    return received.groupBy(by).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))


def snapshots(received: DataFrame, ts: str, by: str, every: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Counts per period and key: the periodic statistics as a tumbling window."""
    return received.withWatermark(ts, late).groupBy(F.window(ts, every), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("period"), by, "n")


def append_log(received: DataFrame, path: str, checkpoint: str):
    """A writer of the transaction log: an append-only sink; its checkpoint makes a restart go on where it stopped."""
    return received.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
