"""Keyed state and counts of streams: late, overlapping and repeated deliveries."""

import datetime as dt
import random

from tidegate.session import scratch
from tidegate.streaming import jobs, progress, stateful

T0 = dt.datetime(2024, 1, 1)
SIGNALS = "failure_signature string, event_id long, timestamp timestamp, kind string"


def plain(signals):
    """Incidents by signature, signal after signal in the order of time."""
    open_, out = {}, []
    for signature, i, at, kind in sorted(set(signals), key=lambda s: (s[2], s[1])):
        if kind == "FAIL":
            if signature in open_:
                open_[signature][3:5] = [open_[signature][3] + 1, at]
            else:
                open_[signature] = [signature, i, at, 1, at, None]
        elif signature in open_:
            out.append(tuple([*open_.pop(signature)[:5], at]))
    return sorted(map(str, [*out, *[tuple(v) for v in open_.values()]]))


def deliver(spark, deliveries, delay):
    feed, path, state = scratch(spark, "feed"), scratch(spark, "incidents"), scratch(spark, "state")
    seen = []
    for i, rows in enumerate(deliveries):
        spark.createDataFrame(rows, SIGNALS).write.parquet(f"{feed}/{i}")
        stateful.track_incidents(spark.readStream.schema(SIGNALS).parquet(f"{feed}/*"), path, state, delay)
        got = stateful.read_incidents(spark, path).select(
            "failure_signature", "opened_by", "opened_at", "failure_count", "last_failure_at", "resolved_at")
        seen.append(sorted(str(tuple(r)) for r in got.collect()))
    return seen


def test_late_and_repeated_signals_give_the_batch_result(spark):
    rng = random.Random(5)
    signals = [(f"fp_{rng.randrange(3)}", i, T0 + dt.timedelta(minutes=rng.randrange(600)), rng.choice(["FAIL", "FAIL", "RESOLVE"])) for i in range(90)]
    signals.sort(key=lambda s: s[2])
    # deliveries of five hours that overlap by up to two, with some rows delivered again
    deliveries, sent = [[], [], []], []
    for s in signals:
        hour = (s[2] - T0).seconds / 3600
        k = min(2, int(max(0.0, hour - rng.random() * 2) // 3.4) + (rng.random() < 0.3))
        deliveries[min(k, 2)].append(s)
        if rng.random() < 0.2:
            deliveries[min(k + 1, 2)].append(s)
    got = deliver(spark, deliveries, "12 hours")
    for i, found in enumerate(got):
        sent += deliveries[i]
        assert found == plain(sent)


def test_signals_behind_the_watermark_are_dropped(spark):
    hour = lambda h: T0 + dt.timedelta(hours=h)
    first = [("fp_a", 1, hour(0), "FAIL"), ("fp_a", 2, hour(1), "RESOLVE"), ("fp_b", 3, hour(20), "FAIL")]
    second = [("fp_b", 4, hour(21), "FAIL"), ("fp_a", 5, hour(2), "FAIL"), ("fp_a", 1, hour(0), "FAIL")]
    got = deliver(spark, [first, second], "1 hour")
    assert got[-1] == plain([*first, second[0]])


def test_rows_are_counted_over_all_batches(spark):
    schema = "transaction_id long, ts timestamp"
    feed, path, state = scratch(spark, "feed"), scratch(spark, "kept"), scratch(spark, "state")
    total = progress.Counts()
    for i, rows in enumerate([
        [(n, T0 + dt.timedelta(hours=n)) for n in range(10)], [(10, T0 + dt.timedelta(hours=30)), (3, T0 + dt.timedelta(hours=9, minutes=30))],
        [(n, T0 + dt.timedelta(hours=n)) for n in (20, 21, 31)],
    ]):
        spark.createDataFrame(rows, schema).write.parquet(f"{feed}/{i}")
        stream = jobs.deduplicate_events(spark.readStream.schema(schema).parquet(f"{feed}/*"))
        total += progress.append_counted(stream, path, state)
    # two rows are behind 29:00, one id came twice
    assert (total.read, total.dropped) == (15, 2) and spark.read.parquet(path).count() == 13
