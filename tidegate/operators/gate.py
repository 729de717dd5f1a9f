"""The change gate: may these contract changes be merged?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.contracts import validate_contracts
from tidegate.operators.diff import schema_diff

QUALITY_FLOOR = 70.0


def remediation(change_type="change_type"):
    """Advice per kind of change."""
    kind = F.col(change_type)
    return (
        F.when(kind == "COLUMN_REMOVED", "keep the column as deprecated, or release a new major version")
        .when(kind == "TYPE_CHANGED", "prefer a widening type, or move the consumers first")
        .when(kind == "NULLABILITY_CHANGED", "backfill nulls before forbidding them")
        .when(kind == "ENUM_VALUE_REMOVED", "deprecate values before removing them")
        .when(kind.contains("CONSTRAINT") | kind.contains("RANGE"), "check stored values against the new bounds")
        .when(kind == "INVALID_CONTRACT_STRUCTURE", "correct the document")
        .otherwise("none needed")
    )


def gate_changes(base: DataFrame, target: DataFrame) -> DataFrame:
    """Every finding of the gate: structure errors, diff changes, or the note of a new contract.

    A target with structure errors is not diffed.
    """
    checked = validate_contracts(target)
    broken = checked.filter(~F.col("is_valid")).select(
        "dataset", F.explode("errors").alias("description")
    ).select(
        "dataset", F.lit(None).cast("string").alias("column"),
        F.lit("INVALID_CONTRACT_STRUCTURE").alias("change_type"), F.lit("BREAKING").alias("severity"), "description",
    )
    sound = target.join(checked.filter("is_valid").select("dataset"), "dataset", "left_semi")
    changed = schema_diff(base, sound).select("dataset", "column", "change_type", "severity", "description")
    new = sound.join(base.select("dataset"), "dataset", "left_anti").select(
        "dataset", F.lit(None).cast("string").alias("column"),
        F.lit("NEW_CONTRACT_ADDED").alias("change_type"), F.lit("SAFE").alias("severity"),
        F.lit("first version of this contract").alias("description"),
    )
    return broken.unionByName(changed).unionByName(new).withColumn("remediation", remediation())


def gate_verdicts(
    base: DataFrame, target: DataFrame, quality: DataFrame | None = None, findings: DataFrame | None = None
) -> DataFrame:
    """One verdict per target contract.

    ``quality`` (dataset, quality_score) holds scores on sample data where there is any; a
    score below the floor blocks, unless the contract is already blocked.
    """
    findings = findings if findings is not None else gate_changes(base, target)

    def n(s: str):
        return F.count_if(F.col("severity") == s)

    counted = findings.groupBy("dataset").agg(
        n("BREAKING").alias("breaking_count"), n("WARNING").alias("warning_count"), n("SAFE").alias("safe_count"),
        (F.count_if(F.col("change_type") == "INVALID_CONTRACT_STRUCTURE") == 0).alias("contract_valid"),
    )
    rows = target.select("dataset").join(counted, "dataset", "left").fillna(
        {"breaking_count": 0, "warning_count": 0, "safe_count": 0, "contract_valid": True}
    )
    if quality is None:
        rows = rows.withColumn("quality_score", F.lit(None).cast("double"))
    else:
        rows = rows.join(quality.select("dataset", "quality_score"), "dataset", "left")
    breaking = F.col("breaking_count") > 0
    regressed = ~breaking & F.coalesce(F.col("quality_score") < QUALITY_FLOOR, F.lit(False))
    verdict = (
        F.when(breaking | ~F.col("contract_valid") | regressed, "BREAKING")
        .when(F.col("warning_count") > 0, "WARNING")
        .otherwise("SAFE")
    )
    return rows.select(
        "dataset", "contract_valid", "breaking_count", "warning_count", "safe_count", "quality_score",
        verdict.alias("verdict"), (verdict != "BREAKING").alias("can_merge"),
    )


def gate_summary(verdicts: DataFrame, allow_breaking: bool = False) -> DataFrame:
    """The roll-up over a batch of contracts, with the exit code of the change."""
    def n(v: str):
        return F.count_if(F.col("verdict") == v)

    totals = verdicts.agg(
        F.count(F.lit(1)).alias("total_contracts"),
        n("BREAKING").alias("contracts_breaking"), n("WARNING").alias("contracts_warning"), n("SAFE").alias("contracts_safe"),
        *[F.coalesce(F.sum(f"{s}_count"), F.lit(0)).alias(f"total_{s}_changes") for s in ("breaking", "warning", "safe")],
    )
    blocked = (F.col("contracts_breaking") > 0) & F.lit(not allow_breaking)
    verdict = F.when(blocked, "BREAKING").when(F.col("contracts_warning") > 0, "WARNING").otherwise("SAFE")
    return totals.select(
        "*", verdict.alias("verdict"), (~blocked).alias("can_merge"),
        F.when(blocked, 1).otherwise(0).alias("exit_code"),
    )
