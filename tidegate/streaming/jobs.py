"""Structured Streaming forms of the periodic jobs.

Builders turn a stream of transactions into a result stream; the ``run_*`` functions
process what is available and stop.  State and progress live in the folders the caller
names, which on a cluster lie in its shared storage.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators import lineage
from tidegate.operators import quality as q
from tidegate.operators.freshness import classify
from tidegate.functions.scalars import minutes_between
from tidegate.operators.online import assemble, to_online
from tidegate.operators.scoring import prediction_log, score
from tidegate.sources.stores import mark_published, write_changes
from tidegate.sources.tables import shape_transactions, table

WATERMARK = "1 hour"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """``events`` as a file stream of transactions."""
    reader = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return shape_transactions(reader.parquet(sf_dir))


def run_append(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write finished rows to Parquet files (exactly once) and read them back."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    query = (
        stream.writeStream.foreachBatch(handle).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


# -- windowed aggregates --------------------------------------------------------------

def sliding_velocity(txn: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Customer count and spend in one-hour windows that start every 15 minutes."""
    return (
        txn.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "customer_id")
        .agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("amount_sum"))
        .select("customer_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "txn_count", "amount_sum")
    )


def hourly_merchants(txn: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Volume and decline rate per merchant and hour."""
    return (
        txn.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 hour").alias("w"), "merchant_id")
        .agg(F.sum("amount").alias("hourly_volume_usd"), F.avg((F.col("status") == "FAILED").cast("int")).alias("decline_rate"))
        .select("merchant_id", F.col("w.start").alias("hour_timestamp"), "hourly_volume_usd", "decline_rate")
    )


def daily_customers(txn: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Spend and count per customer and day."""
    return (
        txn.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 day").alias("w"), "customer_id")
        .agg(F.sum("amount").alias("daily_spend_usd"), F.count(F.lit(1)).alias("daily_txn_count"))
        .select("customer_id", F.to_date("w.start").alias("date"), "daily_spend_usd", "daily_txn_count")
    )


def sessions(txn: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Customer sessions of a stream; ``operators.customer.sessions`` is the batch form."""
    s = F.session_window("ts", gap)
    return (
        txn.withWatermark("ts", watermark)
        .groupBy(s.alias("w"), "customer_id")
        .agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))
        .select(
            "customer_id", F.col("w.start").alias("created_at"), "events",
            F.round((F.unix_micros("last_ts") - F.unix_micros("w.start")) / 1e6).cast("bigint").alias("duration_seconds"),
        )
    )


# -- row-level streams ------------------------------------------------------------------

def deduplicate_events(txn: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Each transaction id once, however often it is delivered within the watermark."""
    return txn.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["transaction_id"])


def score_stream(txn: DataFrame, current: DataFrame, entity: str = "customer", created_at: str = "ts") -> DataFrame:
    """Transactions scored against the current online table, as prediction-log rows."""
    return prediction_log(score(assemble(txn, current, entity, "customer_id")), "transaction_id", F.col(created_at))


def label_stream(txn: DataFrame, fraud: DataFrame, within: str = "120 minutes", watermark: str = "2 hours") -> DataFrame:
    """Transactions with the fraud confirmation that follows within two hours, if any."""
    left = txn.withWatermark("ts", watermark)
    right = fraud.select(
        F.col("transaction_id").alias("fraud_txn"), "confirmed_at", "fraud_type"
    ).withWatermark("confirmed_at", watermark)
    in_time = (F.col("transaction_id") == F.col("fraud_txn")) & (F.col("confirmed_at") >= F.col("ts")) & (
        F.col("confirmed_at") <= F.col("ts") + F.expr(f"INTERVAL {within}")
    )
    return left.join(right, in_time, "left_outer").select(
        "transaction_id", "customer_id", "ts", "confirmed_at", "fraud_type",
        F.when(F.col("fraud_txn").isNotNull(), 1).otherwise(0).alias("is_fraud"),
    )


# -- micro-batch jobs ---------------------------------------------------------------------

def materialize_online(
    snapshots: DataFrame, entity: str, id_column: str, path: str, checkpoint: str, materialized_at: dt.datetime
) -> None:
    """Snapshot rows to online change rows; a batch writes its own partition only."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        write_changes(to_online(batch, entity, id_column, F.lit(materialized_at)), path, f"batch-{batch_id}")

    run_batches(snapshots, handle, checkpoint)


def publish_online(
    snapshots: DataFrame, entity: str, id_column: str, root: str, checkpoint: str, materialized_at: dt.datetime
) -> None:
    """Snapshot rows to the store below ``root``: each batch is a change that is visible once it is
    whole and that ``stores.compact_online`` folds into the next generation."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        change = f"{entity}-batch-{batch_id}"
        write_changes(to_online(batch, entity, id_column, F.lit(materialized_at)), f"{root}/online", change)
        mark_published(batch.sparkSession, root, change, materialized_at)

    run_batches(snapshots, handle, checkpoint)


def monitor_freshness(
    arrivals: DataFrame, sla_minutes: Mapping[str, int], path: str, checkpoint: str, ref_time: dt.datetime
) -> None:
    """Running newest time per dataset of a stream (dataset, ts), classified in every batch."""
    newest = arrivals.groupBy("dataset").agg(F.max("ts").alias("last_record_timestamp"))
    slas = F.create_map(*[F.lit(x) for pair in sla_minutes.items() for x in pair])

    def handle(batch: DataFrame, batch_id: int) -> None:
        sla = F.coalesce(F.try_element_at(slas, F.col("dataset")), F.lit(60))
        delay = F.greatest(F.lit(0.0), minutes_between(F.lit(ref_time).cast("timestamp"), F.col("last_record_timestamp")))
        rows = batch.select("dataset", "last_record_timestamp", F.round(delay, 2).alias("delay_minutes"),
                            classify(delay, sla).alias("freshness_status"), F.lit(batch_id).alias("batch"))
        write_changes(rows, path, f"batch-{batch_id}")

    run_batches(newest, handle, checkpoint, "update")


def gate_batches(txn: DataFrame, contract: Mapping, good: str, bad: str, checkpoint: str) -> None:
    """Row gate: rows that pass go to one table, the others with their reasons to another."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        marked = q.quarantine(batch, contract).persist()
        try:
            write_changes(marked.filter(F.size("violations") == 0).drop("violations"), good, f"batch-{batch_id}")
            write_changes(marked.filter(F.size("violations") > 0), bad, f"batch-{batch_id}")
        finally:
            marked.unpersist()

    run_batches(txn, handle, checkpoint)


def ingest_lineage(events: DataFrame, path: str, checkpoint: str) -> None:
    """Run events to edges, column mappings and events per batch; the readers fold them by event time."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write_changes(lineage.edges(batch), f"{path}/edges", f"batch-{batch_id}")
            write_changes(lineage.column_mappings(batch), f"{path}/mappings", f"batch-{batch_id}")
            write_changes(batch, f"{path}/events", f"batch-{batch_id}")
        finally:
            batch.unpersist()

    run_batches(events, handle, checkpoint)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run states over all batches: the fold is associative, so it runs over the kept events."""
    return lineage.runs(spark.read.parquet(f"{path}/events").drop("change_id"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges over all batches, the latest event that gave an edge winning, however late its file came."""
    newest = F.struct("at", "run_id")
    return spark.read.parquet(f"{path}/edges").groupBy("source_dataset", "target_dataset", "pipeline_id").agg(
        F.max_by("edge_type", newest).alias("edge_type"), F.max_by("run_id", newest).alias("run_id")
    )


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Column mappings over all batches, the latest event winning."""
    newest = F.struct("at", "run_id", "transformation")
    return spark.read.parquet(f"{path}/mappings").groupBy(
        "source_dataset", "source_column", "target_dataset", "target_column", "pipeline_id"
    ).agg(F.max_by("transformation", newest).alias("transformation"), F.max_by("run_id", newest).alias("run_id"), F.max("at").alias("at"))
