"""Point-in-time joins: the newest feature row at or before each observation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.functions.scalars import DAY, MICROS, micros, slice_id
from tidegate.operators.slices import fit_slice


class LeakageError(RuntimeError):
    """A joined feature row is newer than its observation."""


@dataclass(frozen=True)
class FeatureGroup:
    """One snapshot table of an as-of join.

    ``tie_break`` orders rows of one entity with equal time (the last one wins); without
    it the feature values themselves decide, so the result never depends on row order.
    ``ttl_seconds <= 0`` turns the age limit off.
    """

    df: DataFrame
    columns: Sequence[str]
    ts: str = "feature_timestamp"
    ttl_seconds: int = 30 * DAY
    tie_break: Sequence[str] = field(default_factory=tuple)


def asof_join(
    observations: DataFrame,
    features: DataFrame,
    key: str,
    obs_ts: str,
    feature_ts: str = "feature_timestamp",
    columns: Sequence[str] | None = None,
    ttl_seconds: int = 30 * DAY,
    tie_break: Sequence[str] = (),
    slice_seconds: int | None = None,
) -> DataFrame:
    """Backward as-of join of one feature table; see ``asof_join_groups``."""
    if columns is None:
        columns = [c for c in features.columns if c not in (key, feature_ts)]
    group = FeatureGroup(features, list(columns), feature_ts, ttl_seconds, tie_break)
    return asof_join_groups(observations, [group], key, obs_ts, slice_seconds)


def asof_join_groups(
    observations: DataFrame,
    groups: Sequence[FeatureGroup],
    key: str,
    obs_ts: str,
    slice_seconds: int | None = None,
) -> DataFrame:
    """Backward as-of join of several feature tables on one observation set.

    One shuffle for all groups: observations and feature rows meet per (key, time slice),
    and each slice that has observations starts with a carried-in row holding the newest
    feature row of the earlier slices.  A feature row is taken as a whole (one struct), so
    a null in the newest row is not replaced by an older value.  Every observation is kept
    exactly once; null keys and times match nothing and bypass the shuffle.  Features are read
    more than once: give computed ones as a written table (``session.stage_table``).
    """
    if slice_seconds is None:
        slice_seconds = min(
            [fit_slice(observations, [key], obs_ts)] + [fit_slice(g.df, [key], g.ts) for g in groups]
        )
    matchable = F.col(key).isNotNull() & F.col(obs_ts).isNotNull()
    obs_cols = observations.columns
    slots = [f"_f{i}" for i in range(len(groups))]

    obs = observations.filter(matchable).select(
        F.col(key).alias("_k"),
        micros(obs_ts).alias("_us"),
        F.struct(*[F.col(c) for c in obs_cols]).alias("_obs"),
    ).withColumn("_slice", slice_id(F.col("_us"), slice_seconds))

    sides, newest = [], []
    for slot, g in zip(slots, groups):
        tie = [F.col(c) for c in (g.tie_break or g.columns)]
        side = g.df.filter(F.col(key).isNotNull() & F.col(g.ts).isNotNull()).select(
            F.col(key).alias("_k"),
            micros(g.ts).alias("_us"),
            F.struct(micros(g.ts).alias("us"), F.struct(*tie).alias("tie")).alias("_ord"),
            F.struct(F.col(g.ts).alias("ts"), *[F.col(c) for c in g.columns]).alias(slot),
        ).withColumn("_slice", slice_id(F.col("_us"), slice_seconds))
        # rows of equal entity and time reduce to the one that wins
        side = side.groupBy("_k", "_slice", "_us").agg(F.max_by(slot, "_ord").alias(slot))
        sides.append(side)
        newest.append(
            side.groupBy("_k", "_slice").agg(F.max_by(slot, "_us").alias(slot))
        )

    demand = obs.select("_k", "_slice").distinct().withColumn("_need", F.lit(True))
    per_slice = demand
    for part in newest:
        per_slice = per_slice.unionByName(part, allowMissingColumns=True)
    per_slice = per_slice.groupBy("_k", "_slice").agg(
        F.max("_need").alias("_need"), *[F.first(s, True).alias(s) for s in slots]
    )
    earlier = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        per_slice.select(
            "_k", "_slice", "_need", *[F.last(s, True).over(earlier).alias(s) for s in slots]
        )
        .filter(F.col("_need"))
        .drop("_need")
        .withColumn("_us", F.lit(None).cast("bigint"))
    )

    rows = obs.withColumn("_side", F.lit(1))
    for side in [carried, *sides]:
        rows = rows.unionByName(side.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    upto = (
        Window.partitionBy("_k", "_slice")
        .orderBy(F.asc_nulls_first("_us"), "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = rows.select(
        "_us", "_obs", *[F.last(s, True).over(upto).alias(s) for s in slots]
    ).filter(F.col("_obs").isNotNull())

    feature_cols = []
    for slot, g in zip(slots, groups):
        feature_cols.append(F.col(slot)["ts"].alias(g.ts))
        age = F.col("_us") - micros(F.col(slot)["ts"])
        for c in g.columns:
            value = F.col(slot)[c]
            if g.ttl_seconds > 0:
                value = F.when(age <= g.ttl_seconds * MICROS, value)
            feature_cols.append(value.alias(c))
    joined = matched.select(*[F.col("_obs")[c].alias(c) for c in obs_cols], *feature_cols)

    unmatchable = observations.filter(~matchable)
    return joined.unionByName(unmatchable, allowMissingColumns=True)


def leakage_audit(joined: DataFrame, obs_ts: str, feature_ts: str = "feature_timestamp") -> DataFrame:
    """One row: joined rows, and how many carry a feature newer than the observation."""
    return joined.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.count_if(F.col(feature_ts).isNotNull()).alias("rows_matched"),
        F.count_if(F.col(feature_ts) > F.col(obs_ts)).alias("rows_leaking"),
    )


def assert_no_leakage(joined: DataFrame, obs_ts: str, feature_ts: str = "feature_timestamp") -> None:
    leaking = leakage_audit(joined, obs_ts, feature_ts).first()["rows_leaking"]
    if leaking:
        raise LeakageError(f"{leaking} rows carry a feature newer than the observation")


def latest_values(features: DataFrame, key: str, feature_ts: str, columns: Sequence[str]) -> DataFrame:
    """Newest non-null value of each column per key, and the newest time."""
    return features.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.max(feature_ts).alias(feature_ts),
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col(feature_ts), F.col(c)))).alias(c) for c in columns],
    )


def naive_latest_join(
    observations: DataFrame,
    features: DataFrame,
    key: str,
    feature_ts: str = "feature_timestamp",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The deliberately leaky join: newest non-null value of each column, whatever its time."""
    if columns is None:
        columns = [c for c in features.columns if c not in (key, feature_ts)]
    latest = latest_values(features, key, feature_ts, columns)
    return observations.join(latest, key, "left")


def skew_report(
    observations: DataFrame,
    features: DataFrame,
    key: str,
    obs_ts: str,
    feature_ts: str = "feature_timestamp",
    columns: Sequence[str] | None = None,
    ttl_seconds: int = 30 * DAY,
) -> DataFrame:
    """Per feature: rows where the leaky join differs from the correct one, and rows it leaks into.

    The newest values, one row per key, meet the result of the as-of join; the observations are shuffled once.
    """
    if columns is None:
        columns = [c for c in features.columns if c not in (key, feature_ts)]
    right = asof_join(observations, features, key, obs_ts, feature_ts, columns, ttl_seconds)
    latest = latest_values(features, key, feature_ts, columns).select(
        key, F.col(feature_ts).alias("_naive_ts"), *[F.col(c).alias(f"_naive_{c}") for c in columns])
    both = right.join(latest, key, "left")
    counts = both.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_naive_ts") > F.col(obs_ts)).alias("leaking"),
        *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_naive_{c}"))).alias(f"_d_{c}") for c in columns],
    )
    per_feature = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"_d_{c}").alias("rows_differing")) for c in columns]
    )
    return counts.select("rows", "leaking", F.explode(per_feature).alias("x")).select(
        F.col("x.feature").alias("feature"),
        F.col("rows").alias("rows_compared"),
        F.col("x.rows_differing").alias("rows_differing"),
        F.col("leaking").alias("rows_leaking"),
    )
