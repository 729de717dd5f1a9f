"""The contract registry as tables: validation, registration, versions and listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields a contract must have, and the types and states it may use.
ROOT_KEYS = ["dataset", "version", "owner", "description", "freshness_sla_minutes", "columns", "constraints"]
COLUMN_KEYS = ["name", "type", "nullable", "unique", "description"]
COLUMN_TYPES = ["string", "numeric", "integer", "timestamp", "float"]
STATUSES = ["ACTIVE", "DEPRECATED", "DRAFT"]


def contract_columns(contracts: DataFrame, keep: tuple[str, ...] = ("dataset", "version")) -> DataFrame:
    """One row per declared column, with its position."""
    return contracts.select(*keep, F.posexplode("columns").alias("position", "c")).select(
        *keep, "position", "c.*"
    )


def _root_missing(key: str) -> Column:
    if key == "constraints":
        absent = F.col("constraint_map").isNull() & F.col("constraint_texts").isNull()
    else:
        absent = F.col(key).isNull()
    return F.when(F.col("root_keys").isNotNull(), ~F.array_contains("root_keys", key)).otherwise(absent)


def validate_contracts(contracts: DataFrame) -> DataFrame:
    """All rule violations of every contract: (dataset, version, errors, is_valid).

    An error is ``rule:subject``.  Columns are looked at inside their document, which is
    one array per contract; there is no shuffle.
    """
    def err(cond: Column, rule: str, subject: Column | None = None) -> Column:
        text = F.lit(rule) if subject is None else F.concat(F.lit(rule + ":"), subject)
        return F.when(F.coalesce(cond, F.lit(False)), text)

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    root = [err(_root_missing(k), "missing_root_field", F.lit(k)) for k in ROOT_KEYS]
    root += [
        err(blank("dataset"), "dataset_empty"),
        err(blank("version"), "version_empty"),
        err(~F.coalesce(F.col("status"), F.lit("ACTIVE")).isin(STATUSES), "invalid_status", F.col("status")),
        err(F.col("freshness_sla_minutes") <= 0, "sla_not_positive"),
        err(F.coalesce(F.size("columns"), F.lit(0)) <= 0, "columns_empty"),
    ]

    def of_column(c: Column, i: Column) -> Column:
        name = c["name"]
        label = F.coalesce(name, i.cast("string"))
        earlier = F.slice(F.transform(F.col("columns"), lambda x: x["name"]), F.lit(1), i)
        rules = [
            err(F.coalesce(name, F.lit("")) == "", "column_without_name", i.cast("string")),
            err((i > 0) & F.array_contains(earlier, name), "duplicate_column", name),
        ]
        for k in COLUMN_KEYS:
            gone = F.when(c["keys"].isNotNull(), ~F.array_contains(c["keys"], k)).otherwise(c[k].isNull())
            rules.append(err(gone, f"missing_column_field:{k}", label))
        rules += [
            err(c["type"].isNotNull() & ~c["type"].isin(COLUMN_TYPES), "invalid_type", F.concat(label, F.lit(":"), c["type"])),
            err(c["allowed_values"].isNotNull() & (F.size(c["allowed_values"]) == 0), "allowed_values_empty", label),
            err(c["min"] > c["max"], "min_above_max", label),
        ]
        return F.array_compact(F.array(*rules))

    per_column = F.flatten(F.coalesce(F.transform("columns", of_column), F.array().cast("array<array<string>>")))
    errors = F.concat(F.array_compact(F.array(*root)), per_column)
    return contracts.select("dataset", "version", errors.alias("errors")).withColumn(
        "is_valid", F.size("errors") == 0
    )


def register(incoming: DataFrame, existing: DataFrame, allow_skip: bool = False) -> DataFrame:
    """Registration outcome per incoming (dataset, version): REGISTERED, or SKIPPED / DUPLICATE.

    Among incoming rows of the same key the first (``registered_at``, ``contract_id``) wins.
    Rows that say REGISTERED are the ones to append.
    """
    taken = existing.select("dataset", "version").distinct().withColumn("_taken", F.lit(True))
    winner = incoming.groupBy("dataset", "version").agg(
        F.min(F.struct("registered_at", "contract_id"))["contract_id"].alias("_winner")
    )
    repeat = F.lit("SKIPPED" if allow_skip else "DUPLICATE")
    return (
        incoming.join(taken, ["dataset", "version"], "left")
        .join(winner, ["dataset", "version"], "left")
        .withColumn(
            "outcome",
            F.when(F.col("_taken") | (F.col("contract_id") != F.col("_winner")), repeat).otherwise("REGISTERED"),
        )
        .drop("_taken", "_winner")
    )


def latest_versions(registry: DataFrame) -> DataFrame:
    """The last registered version of each dataset (registration order, not version text)."""
    row = F.struct(*[F.col(c) for c in registry.columns])
    return registry.groupBy("dataset").agg(
        F.max_by(row, F.struct("registered_at", "contract_id")).alias("_r")
    ).select("_r.*")


def get_contract(registry: DataFrame, dataset: str, version: str | None = None) -> DataFrame:
    """Point lookup: one version, or the latest."""
    rows = registry.filter(F.col("dataset") == dataset)
    return rows.filter(F.col("version") == version) if version else latest_versions(rows)


def dataset_exists(registry: DataFrame, dataset: str) -> bool:
    return not registry.filter(F.col("dataset") == dataset).limit(1).isEmpty()


def version_history(registry: DataFrame, dataset: str) -> DataFrame:
    return registry.filter(F.col("dataset") == dataset).orderBy("registered_at", "contract_id")


def list_contracts(registry: DataFrame, owner=None, status=None, dataset=None, version=None) -> DataFrame:
    """Filtered listing with the number of columns."""
    out = registry
    for name, value in (("owner", owner), ("status", status), ("dataset", dataset), ("version", version)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out.withColumn("column_count", F.greatest(F.size("columns"), F.lit(0)))


def registry_totals(registry: DataFrame) -> DataFrame:
    """Contracts and datasets per version label."""
    # distinct datasets per label by two grouped counts instead of a distinct aggregate
    per_dataset = registry.groupBy("version", "dataset").agg(F.count(F.lit(1)).alias("n"))
    return per_dataset.groupBy("version").agg(
        F.sum("n").alias("contracts"), F.count(F.lit(1)).alias("datasets")
    )
