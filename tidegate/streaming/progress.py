"""What a streaming query read and dropped, added up over all of its batches."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.readwriter import DataStreamWriter

# seconds to wait for the last report of a query that has ended
PATIENCE = 60


@dataclass
class Counts:
    """Rows read from the sources, rows that stateful operators dropped as late, and batches."""

    read: int = 0
    dropped: int = 0
    batches: int = 0

    def __add__(self, other: "Counts") -> "Counts":
        return Counts(self.read + other.read, self.dropped + other.dropped, self.batches + other.batches)


class Progress(StreamingQueryListener):
    """Adds up the reports of one run; a query itself keeps only its last hundred."""

    def __init__(self):
        self.by_run: dict[str, Counts] = {}
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def end_of(self, run: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run, threading.Event())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            run = str(p.runId)
            self.by_run[run] = self.by_run.get(run, Counts()) + Counts(
                p.numInputRows, sum(op.numRowsDroppedByWatermark for op in p.stateOperators), 1)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.end_of(str(event.runId)).set()


def run_counted(writer: DataStreamWriter, stream: DataFrame) -> Counts:
    """Run a writer over what is available and give its counts.

    An operator behind a partial aggregate counts the groups it drops; put the stateful
    operator that should count rows (such as deduplication by id) first.
    """
    manager, progress = stream.sparkSession.streams, Progress()
    manager.addListener(progress)
    try:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        run = str(query.runId)
        if not progress.end_of(run).wait(PATIENCE):
            raise RuntimeError("the reports of the query did not arrive")
        return progress.by_run.get(run, Counts())
    finally:
        manager.removeListener(progress)


def append_counted(stream: DataFrame, path: str, checkpoint: str) -> Counts:
    """Write finished rows to Parquet files (exactly once), and count what was read and dropped."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return run_counted(writer, stream)
