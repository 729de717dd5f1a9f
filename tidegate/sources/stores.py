"""Tables that jobs write: offline snapshots, the online table, and logs.

Upserts are appends of change rows in a partition of their own (one per run or batch);
readers take the newest row per key.  Writing a partition again replaces it, so a retried
run or batch changes nothing, and no job rewrites what others have published.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators.online import merge, newest
from tidegate.session import one_row


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def write_offline(snapshot: DataFrame, root: str, entity: str, ts: str = "feature_timestamp") -> str:
    """Snapshot rows below ``offline/<entity>/as_of_date=.../as_of=...``.

    A snapshot replaces an earlier one of exactly the same time; others of the day stay.
    """
    path = f"{root}/offline/{entity}"
    (
        snapshot.withColumns({"as_of_date": F.to_date(ts), "as_of": F.concat(F.lit("us_"), F.unix_micros(ts))})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("as_of_date", "as_of")
        .parquet(path)
    )
    return path


def read_offline(spark: SparkSession, root: str, entity: str) -> DataFrame:
    return spark.read.parquet(f"{root}/offline/{entity}").drop("as_of_date", "as_of")


def write_changes(rows: DataFrame, path: str, change_id: str) -> None:
    """Change rows of one run or batch; repeating the call replaces them."""
    (
        rows.withColumn("change_id", F.lit(change_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("change_id")
        .parquet(path)
    )


def change_count(spark: SparkSession, path: str, change_id: str) -> int:
    """Rows of one run or batch, from the footers of its files (no pass over the data)."""
    return spark.read.parquet(path).filter(F.col("change_id").cast("string") == change_id).count()


def write_log(rows: DataFrame, root: str, name: str, entry: str) -> None:
    """Log rows of one entry (a run, or a step of it); the same entry again replaces them."""
    rows.withColumn("log_entry", F.lit(f"entry_{entry}")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("log_entry").parquet(f"{root}/{name}")


def read_log(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}").drop("log_entry")


def mark_published(spark: SparkSession, root: str, run_id: str, at: dt.datetime) -> None:
    """The pointer row that makes a run's online rows visible, written last.

    Its token tells a run from the same run done again.
    """
    row = one_row(spark).select(
        F.lit(run_id).alias("change_id"), F.lit(at).cast("timestamp").alias("published_at"), F.lit(uuid.uuid4().hex).alias("token")
    )
    write_log(row, root, "published", run_id)


def _generation(spark: SparkSession, root: str):
    """The pointer row of the newest generation, or None."""
    if not path_exists(spark, f"{root}/generations"):
        return None
    order = F.struct("generation", "folder")
    return read_log(spark, root, "generations").agg(F.max_by(F.struct("generation", "folder", "buckets"), order).alias("g")).first()["g"]


def _generation_rows(spark: SparkSession, root: str, pointer) -> DataFrame:
    """The rows of a generation through a catalogue entry that tells Spark its buckets; any session can declare it."""
    name = f"online_{pointer['folder']}"
    if not spark.catalog.tableExists(name):
        path = f"{root}/online_generations/{pointer['folder']}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        location = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (row_key) SORTED BY (row_key) "
                  f"INTO {pointer['buckets']} BUCKETS LOCATION '{location}'")
    return spark.table(name)


def _pending(spark: SparkSession, root: str) -> DataFrame:
    """Published changes (change_id, token) that no generation holds yet."""
    published = read_log(spark, root, "published").select("change_id", "token")
    if _generation(spark, root) is None:
        return published
    # what a compaction that died has noted does not count
    made = read_log(spark, root, "generations").select("folder")
    held = read_log(spark, root, "absorbed").join(made, "folder", "left_semi").select("token")
    return published.join(held, "token", "left_anti").select("change_id", "token")


def _changes(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "false").parquet(f"{root}/online")
    visible = rows.withColumn("change_id", F.col("change_id").cast("string")).join(ids.select("change_id"), "change_id", "left_semi")
    return visible.drop("change_id")


def read_online(spark: SparkSession, root: str) -> DataFrame | None:
    """The current online table: newest row per key among published runs.

    With a generation (see ``compact_online``) only changes published since are folded, and
    without such changes the generation is the table: bucketed by key, so that a lookup or a
    join on the key does not shuffle it.
    """
    if not path_exists(spark, f"{root}/published"):
        return None
    pointer, pending = _generation(spark, root), _pending(spark, root)
    if pointer is None:
        return newest(_changes(spark, root, pending))
    current = _generation_rows(spark, root, pointer)
    return current if pending.isEmpty() else merge(current, newest(_changes(spark, root, pending)))


def compact_online(spark: SparkSession, root: str, buckets: int | None = None) -> bool:
    """Fold the published changes into a new generation, bucketed and sorted by key; False if there are none.

    The pointer is written last, so readers see the old generation or the new one.  One
    compaction runs at a time.  ``buckets`` defaults to the session's shuffle partitions, as Spark
    shuffles a table with fewer.  A run done again after its rows were folded is an upsert.
    """
    if not path_exists(spark, f"{root}/published"):
        return False
    tokens = _pending(spark, root).collect()  # one short row per run since the last compaction
    if not tokens:
        return False
    pointer = _generation(spark, root)
    number = 0 if pointer is None else pointer["generation"] + 1
    pending = spark.createDataFrame(tokens, "change_id string, token string")
    rows = newest(_changes(spark, root, pending))
    if pointer is not None:
        rows = merge(_generation_rows(spark, root, pointer), rows)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"g{number:06d}_{uuid.uuid4().hex[:12]}"
    (
        rows.repartition(n, "row_key").write.bucketBy(n, "row_key").sortBy("row_key")
        .option("path", f"{root}/online_generations/{folder}").saveAsTable(f"online_{folder}", format="parquet")
    )
    write_log(pending.select(F.lit(folder).alias("folder"), "token"), root, "absorbed", folder)
    row = one_row(spark).select(
        F.lit(number).cast("bigint").alias("generation"), F.lit(folder).alias("folder"), F.lit(n).alias("buckets")
    )
    write_log(row, root, "generations", folder)
    return True


def materialization_log_row(
    spark: SparkSession, run_id: str, group: str, start: dt.datetime, end: dt.datetime,
    records: int, status: str, error: str | None = None,
) -> DataFrame:
    return one_row(spark).select(
        F.lit(run_id).alias("run_id"), F.lit(group).alias("feature_group"),
        F.lit(start).cast("timestamp").alias("started_at"), F.lit(end).cast("timestamp").alias("finished_at"),
        F.lit(records).cast("bigint").alias("records_written"), F.lit(status).alias("status"),
        F.lit(error).cast("string").alias("error_message"),
    )


def write_quality(results: DataFrame, runs: DataFrame, root: str) -> None:
    """Persist a validation run and its check rows (one action each, both tiny); a run id written again is replaced."""
    entry = runs.first()["run_id"]
    write_log(results, root, "quality_results", entry)
    write_log(runs, root, "quality_runs", entry)
