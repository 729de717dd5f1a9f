"""The online store as a table: newest feature vector per entity, lookups, serving."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.scalars import minutes_between

KEY = ["entity_name", "entity_id"]
# The features the risk model reads.
MODEL_FEATURES = [
    "cust_txn_count_1h", "cust_txn_count_24h", "cust_txn_count_7d",
    "cust_txn_amount_sum_1h", "cust_txn_amount_sum_24h", "cust_txn_amount_avg_7d",
    "cust_failed_txn_count_24h", "cust_unique_merchants_7d", "cust_activity_score",
    "cust_night_owl_ratio_30d", "cust_declined_ratio_7d", "cust_risk_velocity_composite",
    "consecutive_failed_auth_count", "amount_dispersion_index_30d",
    "burst_txn_count_10min", "burst_txn_amount_10min",
]


def row_key(name: Column, entity_id: Column) -> Column:
    """The key of an online row as one text, which no other pair of name and id gives.

    Joins and buckets use it rather than the pair: requests for one entity have a constant
    name, which Spark takes out of the join keys, and then buckets of the pair are of no use.
    """
    return F.concat(F.char_length(name).cast("string"), F.lit(":"), name, F.lit(":"), entity_id)


def to_online(
    snapshot: DataFrame, entity_name: str, id_column: str, materialized_at: Column,
    version: str = "v1", source: str = "offline", ts: str = "feature_timestamp",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Snapshot rows as online rows: the key, a features map, and the JSON payload of the key."""
    names = list(columns) if columns else [c for c in snapshot.columns if c not in (id_column, ts)]
    features = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names])
    )
    rows = snapshot.filter(F.col(id_column).isNotNull()).select(
        F.lit(entity_name).alias("entity_name"), F.col(id_column).cast("string").alias("entity_id"),
        features.alias("features"), F.col(ts).alias("feature_timestamp"),
        F.lit(version).alias("feature_version"), F.lit(source).alias("source"),
        materialized_at.cast("timestamp").alias("materialized_at"),
    )
    return rows.withColumns({
        "row_key": row_key(F.col("entity_name"), F.col("entity_id")),
        "store_key": F.concat_ws(":", F.lit("features"), *KEY),
        "payload": F.to_json(F.struct(
            "entity_id", "entity_name", "features", "feature_timestamp", "feature_version", "source", "materialized_at"
        )),
    })


# what makes a row of a key newer than another
ORDER = ["feature_timestamp", "materialized_at", "payload"]


def newest(rows: DataFrame) -> DataFrame:
    """Latest row per key: by feature time, then by materialization; map-side combined."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*KEY).agg(F.max_by(row, F.struct(*ORDER)).alias("_r")).select("_r.*")


def merge(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The newer row per key of two tables that hold a key once each.

    A join and no aggregate, so that a table bucketed by key is read in place.
    """
    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("row_key", F.struct(*[F.col(c) for c in current.columns]).alias(name))

    def order(name: str) -> Column:
        return F.struct(*[F.col(f"{name}.{c}") for c in ORDER])

    both = packed(current, "_old").join(packed(changes, "_new"), "row_key", "full_outer")
    newer = F.col("_old").isNull() | (F.col("_new").isNotNull() & (order("_new") >= order("_old")))
    return both.select(F.when(newer, F.col("_new")).otherwise(F.col("_old")).alias("_r")).select("_r.*")


def upsert(current: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """The online table after incoming rows; writing the same rows again changes nothing."""
    return newest(incoming if current is None else current.unionByName(incoming))


def lookup(current: DataFrame, requests: DataFrame, now: dt.datetime) -> DataFrame:
    """Batch lookup: every request row, null where the key is unknown, with the age in minutes."""
    age = minutes_between(F.lit(now).cast("timestamp"), F.col("feature_timestamp"))
    vectors = current.select(F.col("row_key").alias("_key"), "features", "feature_timestamp", "feature_version")
    return requests.join(vectors, row_key(F.col("entity_name"), F.col("entity_id")) == F.col("_key"), "left").drop("_key").withColumn(
        "freshness_minutes", F.when(F.col("feature_timestamp").isNotNull(), F.greatest(F.lit(0.0), F.round(age, 2)))
    )


def assemble(
    requests: DataFrame, current: DataFrame, entity_name: str, id_column: str,
    features: Sequence[str] = tuple(MODEL_FEATURES),
) -> DataFrame:
    """Requests with the model's features; an unknown entity or feature counts as 0."""
    vectors = current.filter(F.col("entity_name") == entity_name).select(
        F.col("row_key").alias("_key"), F.col("features").alias("_features"),
        F.col("feature_timestamp").alias("_feature_ts"),
    )
    joined = requests.join(vectors, row_key(F.lit(entity_name), F.col(id_column).cast("string")) == F.col("_key"), "left")
    return joined.select(
        *requests.columns,
        *[F.coalesce(F.try_element_at("_features", F.lit(f)), F.lit(0.0)).alias(f) for f in features],
        F.col("_feature_ts").alias("feature_timestamp"),
    )
