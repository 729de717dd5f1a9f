"""Registered queries: the publication gate, dataset pipelines, and the streaming jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegate.operators import freshness, lineage, scoring, spine, training
from tidegate.operators.catalog import catalog, entries
from tidegate.operators.customer import customer_features
from tidegate.operators.online import to_online
from tidegate.operators.customer import velocity_features
from tidegate.plans import publish
from tidegate.plans import table_contracts as c
from tidegate.plans.feature_queries import PARAMS, SESSIONS, TXN, bound
from tidegate.plans.operations_queries import CHECKS, DEDUP, FEAT, LIN, SERVED, served
from tidegate.plans.registry import ORACLES, query, r
from tidegate.session import scratch, stage_table
from tidegate.sources import derived, stores, visits
from tidegate.sources import tables as t
from tidegate.streaming import jobs, progress, stateful

SERVED_SLA = [(e[0], e[4]) for e in entries() if e[0] in SERVED and e[2] == "customer"]
COUNTED = """WITH n AS (SELECT count(DISTINCT user_id) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 720 HOUR)"""


def snapshot(spark, sf):
    now, txn = bound(spark, sf)
    return now, customer_features(
        txn, t.bind_customers(spark, sf), t.bind_merchants(spark, sf), now,
        history=t.bind_transactions(spark, sf, until=now), params=PARAMS,
    )


@query("publish_gate", COUNTED + """
SELECT CAST(p AS BIGINT) AS position, s AS stage, 'SUCCESS' AS status, CASE s WHEN 'FEATURE_COMPUTATION' THEN n WHEN 'OFFLINE_STORE' THEN n WHEN 'MATERIALIZATION' THEN n ELSE 0 END AS records
FROM n, (VALUES (0, 'DATA_SOURCE'), (1, 'FEATURE_COMPUTATION'), (2, 'CONTRACT_VALIDATION'), (3, 'SCHEMA_VALIDATION'), (4, 'DATA_QUALITY'), (5, 'OPENLINEAGE'),
 (6, 'AIRFLOW_ORCHESTRATION'), (7, 'OFFLINE_STORE'), (8, 'MATERIALIZATION'), (9, 'REDIS_ONLINE_STORE'), (10, 'ML_PREDICTION')) AS v(p, s)""")
def publish_gate(spark, sf):
    """A clean publication: all stages succeed, every entity is written to both tables."""
    now, features = snapshot(spark, sf)
    out = publish.publish_features(
        spark, lambda: features, c.CUSTOMER_FEATURES, "customer", "customer_id", scratch(spark, "store"), "run_1", now
    )
    counted = F.col("stage").isin("FEATURE_COMPUTATION", "OFFLINE_STORE", "MATERIALIZATION")
    return out.frame(spark).select("position", "stage", "status", F.when(counted, F.col("records")).otherwise(0).alias("records"))


@query("publish_gate_blocked", """
SELECT CAST(p AS BIGINT) AS position, s AS stage, CASE WHEN p < 4 THEN 'SUCCESS' WHEN p = 4 THEN 'FAILED' ELSE 'SKIPPED' END AS status,
 (SELECT count(*) FROM events WHERE false) AS online_rows, 'HIGH' AS incident_severity
FROM (VALUES (0, 'DATA_SOURCE'), (1, 'FEATURE_COMPUTATION'), (2, 'CONTRACT_VALIDATION'), (3, 'SCHEMA_VALIDATION'), (4, 'DATA_QUALITY'), (5, 'OPENLINEAGE'),
 (6, 'AIRFLOW_ORCHESTRATION'), (7, 'OFFLINE_STORE'), (8, 'MATERIALIZATION'), (9, 'REDIS_ONLINE_STORE'), (10, 'ML_PREDICTION')) AS v(p, s)""")
def publish_gate_blocked(spark, sf):
    """A snapshot with null keys: nothing is published and the later stages are skipped."""
    now, features = snapshot(spark, sf)
    spoiled = features.withColumn("customer_id", F.when(F.col("customer_id") > 3, F.col("customer_id")))
    root = scratch(spark, "store")
    out = publish.publish_features(
        spark, lambda: spoiled, c.CUSTOMER_FEATURES, "customer", "customer_id", root, "run_1", now
    )
    current = stores.read_online(spark, root)
    return out.frame(spark).select(
        "position", "stage", "status", F.lit(current.count() if current is not None else 0).cast("bigint").alias("online_rows"),
        F.lit(out.incident["incident_severity"]).alias("incident_severity"),
    )


@query("publish_gate_reopened", """
WITH n AS (SELECT max(ts) AS t FROM events)
SELECT 'run_' || d AS run_id, t + d * INTERVAL 1 HOUR AS opened_at, CASE d WHEN 1 THEN 'RESOLVED' ELSE 'OPEN' END AS status, CAST(2 AS BIGINT) AS failing_runs
FROM n, (VALUES (1), (3)) AS v(d)""")
def publish_gate_reopened(spark, sf):
    """Four failing publications with null keys, the first incident resolved before the third: a new one opens, the fourth attaches."""
    now, txn = bound(spark, sf)
    root = scratch(spark, "store")
    spoiled = velocity_features(txn, now).withColumns({
        "customer_id": F.when(F.col("customer_id") > 3, F.col("customer_id")), "feature_timestamp": F.lit(now).cast("timestamp")})
    contract = {**c.CUSTOMER_FEATURES, "columns": [x for x in c.CUSTOMER_FEATURES["columns"] if x["name"] in spoiled.columns]}
    failed = []
    for i in range(1, 5):
        if i == 3:
            publish.resolve_incident(spark, root, failed[0].incident["failure_signature"], now + dt.timedelta(hours=2.5), "on-call")
        failed.append(publish.publish_features(
            spark, lambda: spoiled, contract, "customer", "customer_id", root, f"run_{i}", now + dt.timedelta(hours=i)))
    signature = failed[0].incident["failure_signature"]
    opened = stores.read_log(spark, root, "incidents").filter(F.col("failure_signature") == signature).select("run_id", "timestamp")
    still = publish.open_incidents(spark, root).filter(F.col("failure_signature") == signature).select(F.col("opened_at"), "status")
    runs = stores.read_log(spark, root, "quality_results").filter(
        (F.col("check_name") == failed[0].incident["check_name"]) & (F.col("status") == "FAIL")).select(F.col("timestamp").alias("failed_at"))
    states = opened.join(still, F.col("timestamp") == F.col("opened_at"), "left").select(
        "run_id", F.col("timestamp").alias("opened_at"), F.coalesce("status", F.lit("RESOLVED")).alias("status"))
    ends = F.lead("opened_at").over(Window.orderBy("opened_at"))
    spans = states.withColumn("_end", ends)
    return spans.join(runs, (F.col("failed_at") >= F.col("opened_at")) & (F.col("_end").isNull() | (F.col("failed_at") < F.col("_end")))).groupBy(
        "run_id", "opened_at", "status").agg(F.count(F.lit(1)).alias("failing_runs"))


@query("materialization_log", COUNTED + " SELECT 'run_1' AS run_id, 'customer' AS feature_group, n AS records_written, 'SUCCESS' AS status FROM n")
def materialization_log(spark, sf):
    """The log row of a materialization, its count read from the file footers."""
    now, features = snapshot(spark, sf)
    root = scratch(spark, "store")
    publish.publish_features(spark, lambda: features, c.CUSTOMER_FEATURES, "customer", "customer_id", root, "run_1", now)
    return stores.read_log(spark, root, "materializations").select("run_id", "feature_group", "records_written", "status")


@query("offline_snapshot", COUNTED + " SELECT CAST(max(ts) AS DATE) AS as_of_date, (SELECT n FROM n) AS entities FROM events")
def offline_snapshot(spark, sf):
    """A snapshot written twice to its day partition and read back once."""
    now, txn = bound(spark, sf)
    rows = velocity_features(txn, now).withColumn("feature_timestamp", F.lit(now).cast("timestamp"))
    root = scratch(spark, "store")
    for _ in range(2):
        stores.write_offline(rows, root, "customer")
    return stores.read_offline(spark, root, "customer").groupBy(F.to_date("feature_timestamp").alias("as_of_date")).agg(
        F.count(F.lit(1)).alias("entities")
    )


@query("merchant_visits", f"""WITH {TXN}
SELECT customer_id, merchant_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS visits FROM txn WHERE customer_id IS NOT NULL GROUP BY 1, 2""")
def merchant_visits(spark, sf):
    """The kept table of visits after six steps of five days each, the fourth of which folds what came before."""
    txn, root = t.bind_transactions(spark, sf), scratch(spark, "visits")
    now = t.latest_event_time(spark, sf)
    for days in range(25, -1, -5):
        visits.advance(txn, root, "customer_id", now - dt.timedelta(days=days), fold_after=2)
    return visits.table(spark, root, "customer_id")


@query("dataset_pipeline", """
SELECT 'CONTRACT_VALIDATION' AS stage, 'SUCCESS' AS status UNION ALL SELECT 'SCHEMA_VALIDATION', 'SUCCESS'
UNION ALL SELECT 'DATA_QUALITY', CASE WHEN count(*) FILTER (event_type NOT IN ('click', 'purchase', 'signup', 'view') OR value < 0.5 OR value > 300) > 0 THEN 'FAILED' ELSE 'SUCCESS' END FROM events""")
def dataset_pipeline(spark, sf):
    """Contract, schema and quality of the events table, as stage rows."""
    out = publish.validate_dataset(spark, t.table(spark, sf, "events"), c.EVENTS, "run_2", t.latest_event_time(spark, sf))
    return out.frame(spark).select("stage", "status")


@query("dataset_pipeline_records", """
WITH f AS (SELECT 'event_type' AS col FROM events WHERE event_type NOT IN ('click', 'purchase', 'signup', 'view') GROUP BY 1
  UNION ALL SELECT 'value' FROM events WHERE value < 0.5 OR value > 300 GROUP BY 1),
runs AS (SELECT unnest(['run_2', 'run_3']) AS run_id)
SELECT run_id, CASE WHEN (SELECT count(*) FROM f) > 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN (SELECT count(*) FROM f) > 0 THEN 'FAIL' ELSE 'COMPLETE' END AS last_event,
  (SELECT count(*) FROM f) AS failed_checks, CASE WHEN run_id = 'run_2' THEN (SELECT string_agg(col, ',' ORDER BY col) FROM f) END AS opened FROM runs""")
def dataset_pipeline_records(spark, sf):
    """What two runs of the dataset pipeline over events leave behind: the second finds the incidents of the first open."""
    events, root, now = t.table(spark, sf, "events"), scratch(spark, "runs"), t.latest_event_time(spark, sf)
    for i in (2, 3):
        publish.validate_dataset(spark, events, c.EVENTS, f"run_{i}", now + dt.timedelta(minutes=10 * i), root=root)
    runs = stores.read_log(spark, root, "pipeline_runs").select("run_id", "status")
    last = stores.read_log(spark, root, "lineage_events").filter("eventType <> 'START'").select(
        F.col("run.runId").alias("run_id"), F.col("eventType").alias("last_event"))
    failed = stores.read_log(spark, root, "quality_results").groupBy("run_id").agg(F.count_if(F.col("status") == "FAIL").alias("failed_checks"))
    out = runs.join(last, "run_id").join(failed, "run_id")
    if not stores.path_exists(spark, f"{root}/incidents"):
        return out.withColumn("opened", F.lit(None).cast("string"))
    # at most one row per check of the contract
    opened = stores.read_log(spark, root, "incidents").groupBy("run_id").agg(F.array_join(F.sort_array(F.collect_list("column")), ",").alias("opened"))
    return out.join(opened, "run_id", "left").select("run_id", "status", "last_event", "failed_checks", "opened")


@query("online_store_freshness", f"""WITH {TXN},
seen AS (SELECT customer_id, CASE WHEN bool_or(ts >= t - INTERVAL 30 DAY) THEN t ELSE t - INTERVAL 1 DAY END AS made FROM txn, now_at
  WHERE ts >= t - INTERVAL 30 DAY OR (ts <= t - INTERVAL 1 DAY AND ts >= t - INTERVAL 31 DAY) GROUP BY customer_id, t),
s AS (SELECT unnest({[x[0] for x in SERVED_SLA]}) AS name, unnest({[x[1] for x in SERVED_SLA]}) AS sla)
SELECT 'customer' AS entity_name, name, CAST(sla AS BIGINT) AS freshness_sla_minutes, count(*) AS entities,
  count(*) FILTER ((epoch_us(t) - epoch_us(made)) / 60e6 + 90 > sla) AS breaches FROM seen, s, now_at GROUP BY name, sla""")
def online_store_freshness(spark, sf):
    """Ages of the published features, read from the online store ninety minutes after the second of two publications."""
    now, root = t.latest_event_time(spark, sf), scratch(spark, "store")
    for days in (1, 0):
        at = now - dt.timedelta(days=days)
        rows = served(t.bind_transactions(spark, sf, at - dt.timedelta(days=30), at), at)
        stores.write_changes(to_online(rows, "customer", "customer_id", F.lit(now), columns=SERVED), f"{root}/online", f"day_{days}")
        stores.mark_published(spark, root, f"day_{days}", at)
    stores.compact_online(spark, root)
    return freshness.online_feature_freshness(stores.read_online(spark, root), catalog(spark), now + dt.timedelta(minutes=90)).withColumn(
        "freshness_sla_minutes", F.col("freshness_sla_minutes").cast("bigint"))


# -- streams ------------------------------------------------------------------------------------

CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def once(spark, stream, name):
    return jobs.run_append(stream, scratch(spark, f"{name}-out"), scratch(spark, f"{name}-state"))


@query("stream_sliding_velocity", f"""WITH {TXN},
x AS (SELECT customer_id, amount, unnest([0, 15, 30, 45]) AS back, ts FROM txn),
w AS (SELECT customer_id, amount, time_bucket(INTERVAL 15 MINUTE, ts) - back * INTERVAL 1 MINUTE AS s FROM x)
SELECT customer_id, s AS window_start, s + INTERVAL 1 HOUR AS window_end, count(*) AS txn_count, {r("sum(amount)")} AS amount_sum
FROM w GROUP BY customer_id, s HAVING s + INTERVAL 1 HOUR <= {CLOSED}""")
def stream_sliding_velocity(spark, sf):
    """Closed one-hour windows every 15 minutes."""
    return once(spark, jobs.sliding_velocity(jobs.event_stream(spark, sf)), "sliding")


@query("stream_hourly_merchants", f"""WITH {TXN}
SELECT merchant_id, date_trunc('hour', ts) AS hour_timestamp, {r("sum(amount)")} AS hourly_volume_usd, {r("avg(CAST(status = 'FAILED' AS INTEGER))")} AS decline_rate
FROM txn GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED}""")
def stream_hourly_merchants(spark, sf):
    return once(spark, jobs.hourly_merchants(jobs.event_stream(spark, sf)), "hourly")


@query("stream_daily_customers", f"""WITH {TXN}
SELECT customer_id, CAST(ts AS DATE) AS date, {r("sum(amount)")} AS daily_spend_usd, count(*) AS daily_txn_count
FROM txn GROUP BY 1, 2 HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= {CLOSED}""")
def stream_daily_customers(spark, sf):
    return once(spark, jobs.daily_customers(jobs.event_stream(spark, sf)), "daily")


@query("stream_sessions", f"""WITH {TXN}, {SESSIONS}
SELECT customer_id, min(ts) AS created_at, count(*) AS events, CAST(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS BIGINT) AS duration_seconds
FROM i GROUP BY customer_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}""")
def stream_sessions(spark, sf):
    return once(spark, jobs.sessions(jobs.event_stream(spark, sf)), "sessions")


@query("stream_deduplicate", "SELECT count(*) AS deliveries, count(DISTINCT event_id) AS transactions FROM events")
def stream_deduplicate(spark, sf):
    """Every event delivered twice comes out once."""
    twice = jobs.event_stream(spark, sf)
    twice = twice.union(jobs.event_stream(spark, sf))
    kept = once(spark, jobs.deduplicate_events(twice), "dedup")
    return kept.agg(F.count(F.lit(1)).alias("deliveries"), F.count_distinct("transaction_id").alias("transactions"))


@query("stream_online_upsert", f"""WITH {TXN}, {FEAT}
SELECT CAST(customer_id AS VARCHAR) AS entity_id, (SELECT t FROM now_at) AS feature_timestamp, {r("n24")} AS cust_txn_count_24h FROM feat""")
def stream_online_upsert(spark, sf):
    """Snapshots that arrive as files are upserted into the online table; the newest stays."""
    from tidegate.operators.online import newest

    now, txn = bound(spark, sf)
    feed = scratch(spark, "feed")
    for back in (1, 0):
        at = now - dt.timedelta(days=back)
        served(txn, at).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(spark.read.parquet(feed).schema).option("maxFilesPerTrigger", 1).parquet(feed)
    path = scratch(spark, "online")
    jobs.materialize_online(stream.select("customer_id", "feature_timestamp", *SERVED), "customer", "customer_id", path, scratch(spark, "online-state"), now)
    rows = newest(spark.read.parquet(path).drop("change_id"))
    return rows.select("entity_id", "feature_timestamp", F.col("features")["cust_txn_count_24h"].alias("cust_txn_count_24h"))


@query("stream_incidents", f"""WITH {CHECKS}, {DEDUP}
SELECT 'inc_' || substr(failure_signature, 5, 12) || '_' || opened_by AS incident_id, opened_at, failure_count, last_failure_at, resolved_at FROM inc""")
def stream_incidents(spark, sf):
    """Incident deduplication over deliveries that overlap in time, come late and repeat signals equals the batch result."""
    signals = derived.incident_signals(spark, sf).select("failure_signature", "event_id", "timestamp", "kind")
    feed, path, state = scratch(spark, "signals"), scratch(spark, "incidents"), scratch(spark, "incidents-state")
    # four deliveries, a folder and a run of the stream each: a fifth of the signals comes one delivery late,
    # and another fifth comes twice
    bounds = signals.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    step = (bounds["b"] - bounds["a"]) / 3 if bounds["a"] else dt.timedelta(1)
    turn = F.least(F.floor((F.unix_micros("timestamp") - F.unix_micros(F.lit(bounds["a"]).cast("timestamp"))) / (step / dt.timedelta(microseconds=1))), F.lit(2))
    late, twice = F.pmod("event_id", F.lit(5)) == 0, F.pmod("event_id", F.lit(5)) == 1
    for i in range(4):
        due = (turn == i) & ~late | (turn + 1 == i) & (late | twice)
        signals.filter(due).write.parquet(f"{feed}/{i}")
        stateful.track_incidents(spark.readStream.schema(signals.schema).parquet(f"{feed}/*"), path, state, f"{2 * step / dt.timedelta(seconds=1):.0f} seconds")
    return stateful.read_incidents(spark, path).select("incident_id", "opened_at", "failure_count", "last_failure_at", "resolved_at")


@query("stream_late_rows", """WITH e AS (SELECT event_id, ts, epoch_us(ts) AS us, (SELECT epoch_us(min(ts)) FROM events) AS lo, (SELECT (epoch_us(max(ts)) - epoch_us(min(ts))) // 3 FROM events) AS step FROM events),
d AS (SELECT *, least((us - lo) // step, 2) AS third, CASE WHEN event_id % 50 = 0 THEN 2 ELSE least((us - lo) // step, 2) END AS delivery FROM e),
m AS (SELECT max(us) FILTER (delivery < 2) - 3600000000 AS mark FROM d)
SELECT count(*) AS delivered, count(*) FILTER (NOT (delivery = 2 AND us <= mark // 1000 * 1000)) AS kept, count(*) FILTER (delivery = 2 AND us <= mark // 1000 * 1000) AS dropped FROM d, m""")
def stream_late_rows(spark, sf):
    """Rows kept and dropped of a feed in which every fiftieth event comes with the last delivery only, most of them too late."""
    txn = t.bind_transactions(spark, sf).select("transaction_id", "ts")
    feed, path, state = scratch(spark, "feed"), scratch(spark, "kept"), scratch(spark, "kept-state")
    us = F.unix_micros("ts")
    lo, hi = txn.agg(F.min(us), F.max(us)).first()
    third = F.least(F.floor((us - lo) / max(1, (hi - lo) // 3)), F.lit(2))
    delivery = F.when(F.col("transaction_id") % 50 == 0, 2).otherwise(third)
    total = progress.Counts()
    for i in range(3):
        txn.filter(delivery == i).write.parquet(f"{feed}/{i}")
        stream = spark.readStream.schema(txn.schema).parquet(f"{feed}/*")
        total += progress.append_counted(jobs.deduplicate_events(stream), path, state)
    kept = spark.read.schema(txn.schema).parquet(path)
    return kept.agg(F.lit(total.read).cast("bigint").alias("delivered"), F.count(F.lit(1)).alias("kept"), F.lit(total.dropped).cast("bigint").alias("dropped"))


@query("stream_freshness", """
SELECT event_type AS dataset, max(ts) AS last_record_timestamp, CASE WHEN d <= 60 THEN 'FRESH' WHEN d <= 120 THEN 'WARNING' ELSE 'STALE' END AS freshness_status
FROM (SELECT event_type, ts, (epoch_us((SELECT max(ts) FROM events) + INTERVAL 1 HOUR) - epoch_us(max(ts) OVER (PARTITION BY event_type))) / 60e6 AS d FROM events) GROUP BY event_type, d""")
def stream_freshness(spark, sf):
    """Newest arrival per source against its SLA."""
    now = t.latest_event_time(spark, sf) + dt.timedelta(hours=1)
    raw = spark.readStream.schema(t.table(spark, sf, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    arrivals = raw.select(F.col("event_type").alias("dataset"), F.col("ts").cast("timestamp").alias("ts"))
    path = scratch(spark, "freshness")
    jobs.monitor_freshness(arrivals, {"click": 60, "view": 60}, path, scratch(spark, "freshness-state"), now)
    rows = spark.read.parquet(path)
    latest = rows.groupBy("dataset").agg(F.max_by(F.struct("last_record_timestamp", "freshness_status"), "batch").alias("r"))
    return latest.select("dataset", "r.last_record_timestamp", "r.freshness_status")


@query("stream_quality_gate", f"""WITH {TXN}, v AS (SELECT *, status NOT IN ('APPROVED', 'FAILED') OR amount < 1 OR amount > 300 AS bad FROM txn)
SELECT CASE WHEN bad THEN 'quarantined' ELSE 'published' END AS outcome, count(*) AS n, {r("sum(amount)")} AS amount FROM v GROUP BY 1""")
def stream_quality_gate(spark, sf):
    """Rows split into published and quarantined ones, batch by batch."""
    good, bad = scratch(spark, "good"), scratch(spark, "bad")
    jobs.gate_batches(jobs.event_stream(spark, sf), c.TRANSACTIONS, good, bad, scratch(spark, "gate-state"))
    both = spark.read.parquet(good).select(F.lit("published").alias("outcome"), "amount").union(
        spark.read.parquet(bad).select(F.lit("quarantined").alias("outcome"), "amount")
    )
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("stream_scoring", f"""WITH {TXN}, {FEAT},
s AS (SELECT x.transaction_id, x.customer_id, x.ts, least(0.99, greatest(0.02, least(0.5, x.amount / 2000.0 * 0.3) + coalesce(b10, 0) * 0.25 + coalesce(f24, 0) * 0.20)) AS raw
  FROM txn x LEFT JOIN feat USING (customer_id))
SELECT 'pred_' || transaction_id AS prediction_id, {r("round(raw + 1e-12, 4)")} AS risk_score, CAST(raw >= 0.5 AS BIGINT) AS prediction, ts AS created_at FROM s""")
def stream_scoring(spark, sf):
    """Transactions scored as they arrive."""
    now, txn = bound(spark, sf)
    current = to_online(served(txn, now), "customer", "customer_id", F.lit(now), columns=SERVED)
    log = once(spark, jobs.score_stream(jobs.event_stream(spark, sf), current), "scores")
    return log.select("prediction_id", "risk_score", "prediction", "created_at")


@query("stream_labels", f"""WITH {TXN}
SELECT transaction_id, customer_id, CASE WHEN is_fraud = 1 THEN ts + INTERVAL 30 MINUTE END AS confirmed_at, CAST(is_fraud AS BIGINT) AS is_fraud FROM txn
WHERE is_fraud = 1 OR ts + INTERVAL 2 HOUR < (SELECT least(max(ts), max(ts) FILTER (is_fraud = 1) + INTERVAL 30 MINUTE) - INTERVAL 2 HOUR FROM txn)""")
def stream_labels(spark, sf):
    """Interval join of transactions with later confirmations; unlabelled rows leave when the watermark passes."""
    txn = jobs.event_stream(spark, sf)
    feed = scratch(spark, "fraud")
    fraud = t.bind_fraud_events(spark, sf)
    fraud.write.parquet(feed)
    confirmations = spark.readStream.schema(fraud.schema).parquet(feed)
    rows = once(spark, jobs.label_stream(txn, confirmations), "labels")
    return rows.select("transaction_id", "customer_id", "confirmed_at", "is_fraud")


@query("stream_lineage", f"""WITH {LIN}
SELECT run_id, 'pipe_' || max(j) AS pipeline_id, arg_max(state, ts) AS status, min(ts) AS start_time, max(ts) FILTER (state IN ('COMPLETE', 'FAIL')) AS end_time FROM st GROUP BY run_id""")
def stream_lineage(spark, sf):
    """Run events taken in as JSON lines, batch by batch, and folded per run."""
    events = derived.lineage_events(spark, sf)
    feed, path = scratch(spark, "run-events"), scratch(spark, "lineage")
    events.repartition(4, "eventTime").write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(feed)
    stream = lineage.read_events(spark, feed, stream=True)
    jobs.ingest_lineage(stream, path, scratch(spark, "lineage-state"))
    return jobs.read_runs(spark, path).select("run_id", "pipeline_id", "status", "start_time", "end_time")


def taken_in(spark, sf):
    """Lineage events delivered in two runs of the stream, the later half of the time first."""
    events = derived.lineage_events(spark, sf)
    feed, path, state = scratch(spark, "run-events"), scratch(spark, "lineage"), scratch(spark, "lineage-state")
    middle = events.agg(F.expr("timestamp_micros(cast(avg(unix_micros(eventTime)) AS bigint))")).first()[0]
    late = F.col("eventTime") >= F.lit(middle)
    for i, part in enumerate((events.filter(late), events.filter(~late))):
        part.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{feed}/{i}")
        jobs.ingest_lineage(lineage.read_events(spark, f"{feed}/*", stream=True), path, state)
    return path


@query("stream_lineage_edges", ORACLES["lineage_edges"])
def stream_lineage_edges(spark, sf):
    """Edges from files out of order equal those of the whole log."""
    return jobs.read_edges(spark, taken_in(spark, sf))


@query("stream_lineage_mappings", ORACLES["lineage_column_mappings"])
def stream_lineage_mappings(spark, sf):
    """Column mappings from files out of order equal those of the whole log."""
    return jobs.read_mappings(spark, taken_in(spark, sf)).drop("at")


@query("stored_model_scores", """
SELECT count(*) AS scored, count(*) AS in_bounds, CAST(0 AS BIGINT) AS other_than_fitted, count(*) AS streamed, 'v2' AS model_version FROM events""")
def stored_model_scores(spark, sf):
    """A forest trained, published as second version, read back, and applied to all rows as a batch and as a stream.

    Scores of a forest have no SQL: the rows are counted, and those whose score is not the fitted model's.
    """
    txn, root = t.bind_transactions(spark, sf), scratch(spark, "models")
    now = t.latest_event_time(spark, sf)
    feed = scratch(spark, "rows")
    training.training_set(txn, stage_table(spine.model_history(txn), "snapshots"), n=None).write.parquet(feed)
    rows = spark.read.parquet(feed)
    sample = stage_table(training.sample_rows(rows, "transaction_id", 5000), "sample")
    for i, trees in ((1, 2), (2, 20)):
        fitted = training.train(sample, model_version=f"v{i}", trees=trees)
        fitted.publish(root, now + dt.timedelta(minutes=i))
    stored = scoring.load_version(spark, root)
    batch = scoring.prediction_log(scoring.score_stored(rows, stored), "transaction_id", F.col("ts"))
    own = scoring.score_with_model(rows, fitted.model, "v2").select(
        F.concat(F.lit("pred_"), F.col("transaction_id").cast("string")).alias("prediction_id"), F.col("risk_score").alias("_own"))
    stream = spark.readStream.schema(rows.schema).parquet(feed)
    streamed = once(spark, scoring.prediction_log(scoring.score_stored(stream, stored), "transaction_id", F.col("ts")), "stored-scores")
    seen = streamed.select("prediction_id", F.col("risk_score").alias("_streamed"))
    return batch.join(own, "prediction_id").join(seen, "prediction_id", "left").agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(F.col("risk_score").between(0, 1)).alias("in_bounds"),
        F.count_if(F.col("risk_score") != F.col("_own")).alias("other_than_fitted"),
        F.count_if(F.col("_streamed") == F.col("risk_score")).alias("streamed"), F.max("model_version").alias("model_version"))
