"""Keyed state over event time: incidents of a feed whose batches overlap in time and come late."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegate.session import share_code
from tidegate.sources.stores import path_exists, write_changes

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
INCIDENT = "struct<opened_by:bigint,opened_at:timestamp,failure_count:bigint,last_failure_at:timestamp,resolved_at:timestamp>"
RESULT = f"failure_signature string, final boolean, incidents array<{INCIDENT}>"
_EPOCH = dt.datetime(1970, 1, 1)


def fold(open_: tuple | None, signals: list[tuple]) -> tuple[tuple | None, list[tuple]]:
    """Signals (micros, event_id, kind) in order, after an open incident or none: the incident that is then open,
    and those that were closed.  An incident is (opened_by, opened_at, failures, last_failure_at, resolved_at)."""
    closed = []
    for us, event_id, kind in signals:
        if kind == "FAIL":
            open_ = (event_id, us, 1, us, None) if open_ is None else (*open_[:2], open_[2] + 1, us, None)
        elif open_ is not None:
            closed.append((*open_[:4], us))
            open_ = None
    return open_, closed


class IncidentState(StatefulProcessor):
    """Per signature: the incident that is open at the watermark, and the signals after it.

    Signals wait in a list until the watermark has passed them; then they are folded in the order of time, whatever the
    order they came in, and incidents that close are given out once, as final.  What lies after the watermark is folded
    on top and given out as it stands; the newest such row of a signature replaces the one before.  A signal that is
    delivered again is found among those that wait, or lies behind the watermark like other late ones and is dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "opened_by long, opened_at long, failures long, last_at long")
        self.waiting = handle.getListState("waiting", "us long, event_id long, kind string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            us = (frame["timestamp"].astype("datetime64[us]").astype("int64")).tolist()
            new += zip(us, frame["event_id"].tolist(), frame["kind"].tolist())
        yield from self.advance(key, timerValues, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.advance(key, timerValues, [])

    def close(self) -> None:
        pass

    def advance(self, key, timerValues, new: list[tuple]) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = {(us, i, kind) for us, i, kind in new if us > watermark}
        waiting.update(tuple(r) for r in self.waiting.get())
        ordered = sorted(waiting)
        ready = [s for s in ordered if s[0] <= watermark]
        later = ordered[len(ready):]
        held = self.current.get() if self.current.exists() else None
        open_, closed = fold((*held, None) if held else None, ready)
        if open_ is None:
            self.current.clear()
        else:
            self.current.update(open_[:4])
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        ahead, more = fold(open_, later)
        rows = [(key[0], True, [self.row(c) for c in closed])] if closed else []
        rows.append((key[0], False, [self.row(c) for c in [*more, *([ahead] if ahead else [])]]))
        yield pd.DataFrame(rows, columns=["failure_signature", "final", "incidents"])

    @staticmethod
    def row(incident: tuple) -> dict:
        by, at, n, last, resolved = incident
        when = lambda us: None if us is None else _EPOCH + dt.timedelta(microseconds=us)
        return {"opened_by": by, "opened_at": when(at), "failure_count": n, "last_failure_at": when(last), "resolved_at": when(resolved)}


def incident_stream(signals: DataFrame, delay: str) -> DataFrame:
    """Changes of incidents from FAIL and RESOLVE signals, for deliveries up to ``delay`` behind the newest."""
    return signals.select("failure_signature", "event_id", "timestamp", "kind").withWatermark("timestamp", delay).groupBy(
        "failure_signature").transformWithStateInPandas(IncidentState(), RESULT, "Update", "EventTime")


def track_incidents(signals: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> None:
    """Process what is available; a batch writes its changes to a partition of its own, so a repeated one replaces them."""
    spark = share_code(signals.sparkSession)
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        query = (
            incident_stream(signals, delay).writeStream.outputMode("update")
            .foreachBatch(lambda batch, batch_id: write_changes(batch.withColumn("batch", F.lit(batch_id).cast("long")), path, f"batch-{batch_id}"))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """All incidents: the final ones, and of every signature those after the watermark as last seen."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"failure_signature string, opened_by long, i {INCIDENT}").select("failure_signature", "i.*")
    rows = spark.read.parquet(path)
    # one batch may give a signature several times (a row and a timer); the order of its rows is that of time
    newest = rows.where("NOT final").groupBy("failure_signature").agg(F.max_by("incidents", F.struct("batch", F.expr(
        "coalesce(aggregate(incidents, timestamp'1970-01-01', (a, x) -> greatest(a, x.last_failure_at, x.resolved_at)), timestamp'1970-01-01')"))).alias("incidents"))
    found = rows.where("final").select("failure_signature", "incidents").union(newest)
    return found.select("failure_signature", F.explode("incidents").alias("i")).select(
        F.concat(F.lit("inc_"), F.substring("failure_signature", 5, 12), F.lit("_"), F.col("i.opened_by").cast("string")).alias("incident_id"),
        "failure_signature", "i.*", F.when(F.col("i.resolved_at").isNull(), "OPEN").otherwise("RESOLVED").alias("status"))
