"""Contract-driven quality checks.

A contract is compiled on the driver (it is a small document) into check expressions.  All
checks that look at one row at a time are evaluated in a single aggregate; each uniqueness
check is one grouped count.  Every check gives one result row.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.scalars import is_missing

# Check types and the severity of their result rows.
ROW_COUNT = "expect_table_row_count_to_be_between"
EXISTS = "expect_column_to_exist"
NOT_NULL = "expect_column_values_to_not_be_null"
UNIQUE = "expect_column_values_to_be_unique"
IN_SET = "expect_column_values_to_be_in_set"
BETWEEN = "expect_column_values_to_be_between"
FRESHNESS = "expect_dataset_freshness_within_sla"
FOREIGN_KEY = "expect_column_values_to_match_foreign_key"
SCHEMA = "expect_schema_to_be_backward_compatible"
CHECK_SEVERITY = {
    ROW_COUNT: "HIGH",
    EXISTS: "CRITICAL",
    NOT_NULL: "HIGH",
    UNIQUE: "HIGH",
    IN_SET: "MEDIUM",
    BETWEEN: "MEDIUM",
    FRESHNESS: "HIGH",
    FOREIGN_KEY: "CRITICAL",
}

RESULT_COLUMNS = [
    "dataset", "check_name", "column", "expectation_type", "status", "severity",
    "observed_value", "expected_value", "success", "unexpected", "base", "details",
]


@dataclass(frozen=True)
class Check:
    kind: str
    column: str | None = None
    values: tuple = ()
    low: float | None = None
    high: float | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.column}" if self.column else self.kind

    @property
    def expected(self) -> str:
        if self.kind == IN_SET:
            return f"in {list(self.values)}"
        if self.kind in (BETWEEN, ROW_COUNT):
            return f"between {self.low} and {self.high}"
        return "Invariant satisfied"


def min_rows(contract: Mapping) -> int:
    """Row-count floor from a map or list of constraints; at least one row."""
    constraints = contract.get("constraints") or {}
    entries = constraints if isinstance(constraints, list) else [constraints]
    declared = [int(e["min_rows"]) for e in entries if isinstance(e, Mapping) and e.get("min_rows") is not None]
    return max([1, *declared])


def compile_checks(contract: Mapping) -> list[Check]:
    """The suite of a contract: row count, then per column existence and value rules."""
    checks = [Check(ROW_COUNT, low=min_rows(contract))]
    for c in contract.get("columns", []):
        name = c.get("name")
        if not name:
            continue
        checks.append(Check(EXISTS, name))
        if not c.get("nullable", True):
            checks.append(Check(NOT_NULL, name))
        if c.get("unique", False):
            checks.append(Check(UNIQUE, name))
        if c.get("allowed_values"):
            checks.append(Check(IN_SET, name, tuple(c["allowed_values"])))
        if c.get("min") is not None or c.get("max") is not None:
            low, high = c.get("min"), c.get("max")
            checks.append(Check(BETWEEN, name, low=None if low is None else float(low),
                                high=None if high is None else float(high)))
    return checks


def _quoted(text) -> str:
    """SQL literal of a text (or null)."""
    return "cast(NULL AS string)" if text is None else "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


def missing_sql(column: str, dtype: str) -> str:
    """SQL: null, or NaN in a floating column."""
    c = f"`{column}`"
    return f"({c} IS NULL OR isnan({c}))" if dtype in ("double", "float") else f"({c} IS NULL)"


def violation_sql(check: Check, dtype: str) -> str:
    """SQL: true on rows that break a row-level check; nulls only break the not-null check."""
    c, missing = f"`{check.column}`", missing_sql(check.column, dtype)
    if check.kind == NOT_NULL:
        return missing
    if check.kind == IN_SET:
        return f"(NOT {missing} AND cast({c} AS string) NOT IN ({', '.join(_quoted(v) for v in check.values)}))"
    out = []
    if check.low is not None:
        out.append(f"cast({c} AS double) < {check.low!r}D")
    if check.high is not None:
        out.append(f"cast({c} AS double) > {check.high!r}D")
    return f"(NOT {missing} AND ({' OR '.join(out)}))"


def _result(dataset: str, check: Check, unexpected: str, base: str, rows: str) -> str:
    """SQL: one check-result struct."""
    ok = f"({unexpected}) = 0"
    bad = f"cast({unexpected} AS string)"
    observed = (
        f"CASE WHEN {ok} THEN 'Compliant (0 unexpected)' WHEN {base} > 0 THEN concat({bad}, ' unexpected records (', "
        f"format_string('%.2f', 100D * ({unexpected}) / {base}), '%)') ELSE concat({bad}, ' unexpected') END"
    )
    if check.kind == ROW_COUNT:
        ok = f"{rows} >= {int(check.low)}"
        unexpected = f"CASE WHEN {ok} THEN 0 ELSE 1 END"
        observed = f"CASE WHEN {ok} THEN 'Compliant (0 unexpected)' ELSE concat(cast({rows} AS string), ' rows') END"
    return (
        f"named_struct('dataset', {_quoted(dataset)}, 'check_name', {_quoted(check.name)}, 'column', {_quoted(check.column)}, "
        f"'expectation_type', {_quoted(check.kind)}, 'status', CASE WHEN {ok} THEN 'PASS' ELSE 'FAIL' END, "
        f"'severity', {_quoted(CHECK_SEVERITY[check.kind])}, 'observed_value', {observed}, 'expected_value', {_quoted(check.expected)}, "
        f"'success', {ok}, 'unexpected', cast({unexpected} AS bigint), 'base', cast({base} AS bigint), 'details', "
        f"to_json(named_struct('unexpected_count', cast({unexpected} AS bigint), 'element_count', cast({rows} AS bigint))))"
    )


def _missing_column(dataset: str, check: Check) -> str:
    note = f'column "{check.column}" is missing'
    return (
        f"named_struct('dataset', {_quoted(dataset)}, 'check_name', {_quoted(check.name)}, 'column', {_quoted(check.column)}, "
        f"'expectation_type', {_quoted(check.kind)}, 'status', 'FAIL', 'severity', {_quoted(CHECK_SEVERITY[check.kind])}, "
        f"'observed_value', {_quoted(note)}, 'expected_value', {_quoted(check.expected)}, 'success', false, "
        "'unexpected', cast(NULL AS bigint), 'base', cast(NULL AS bigint), 'details', '{\"error\":\"column missing\"}')"
    )


def run_suite(df: DataFrame, contract: Mapping) -> DataFrame:
    """All checks of the contract on one frame: one row per check."""
    dataset = contract["dataset"]
    checks = compile_checks(contract)
    present, types = set(df.columns), dict(df.dtypes)
    usable = [c for c in checks if c.column is None or c.column in present]
    row_level = [c for c in usable if c.kind in (NOT_NULL, IN_SET, BETWEEN)]

    needed = sorted({c.column for c in row_level})
    aggregates = ["count(1) AS _rows"]
    aggregates += [f"count_if(NOT {missing_sql(c, types[c])}) AS _filled_{i}" for i, c in enumerate(needed)]
    aggregates += [f"count_if({violation_sql(c, types[c.column])}) AS _bad_{i}" for i, c in enumerate(row_level)]
    structs = []
    for check in checks:
        if check.column is not None and check.column not in present:
            structs.append(_missing_column(dataset, check))
        elif check.kind in (ROW_COUNT, EXISTS):
            structs.append(_result(dataset, check, "0L", "_rows", "_rows"))
        elif check.kind != UNIQUE:
            base = "_rows" if check.kind == NOT_NULL else f"_filled_{needed.index(check.column)}"
            structs.append(_result(dataset, check, f"_bad_{row_level.index(check)}", base, "_rows"))
    results = df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(structs)}))")

    for check in [c for c in usable if c.kind == UNIQUE]:
        counted = (
            df.filter(f"NOT {missing_sql(check.column, types[check.column])}")
            .groupBy(F.col(f"`{check.column}`").alias("_v"))
            .agg(F.count(F.lit(1)).alias("_n"))
            .selectExpr("coalesce(sum(_n), 0L) AS _base", "coalesce(sum(CASE WHEN _n > 1 THEN _n END), 0L) AS _bad")
        )
        results = results.unionByName(
            counted.selectExpr(f"inline(array({_result(dataset, check, '_bad', '_base', '_base')}))")
        )
    return results


def quarantine(df: DataFrame, contract: Mapping, reasons: str = "violations") -> DataFrame:
    """Attach to each row the names of the checks it breaks (an empty array: the row passes).

    Members of duplicate groups are found by a join with the duplicated values only.
    """
    checks = compile_checks(contract)
    present, types = set(df.columns), dict(df.dtypes)
    row_level = [c for c in checks if c.kind in (NOT_NULL, IN_SET, BETWEEN) and c.column in present]
    out, found = df, [
        F.expr(f"CASE WHEN {violation_sql(c, types[c.column])} THEN {_quoted(c.name)} END") for c in row_level
    ]
    found += [F.lit(c.name) for c in checks if c.kind == EXISTS and c.column not in present]
    for i, check in enumerate(c for c in checks if c.kind == UNIQUE and c.column in present):
        repeated = (
            df.filter(f"NOT {missing_sql(check.column, types[check.column])}")
            .groupBy(F.col(check.column).alias(f"_u{i}"))
            .agg(F.count(F.lit(1)).alias(f"_n{i}"))
            .filter(F.col(f"_n{i}") > 1)
        )
        out = out.join(repeated, F.col(check.column) == F.col(f"_u{i}"), "left")
        found.append(F.when(F.col(f"_n{i}").isNotNull(), F.lit(check.name)))
    return out.select(*df.columns, F.array_compact(F.array(*found)).alias(reasons))


def split_quarantine(df: DataFrame, contract: Mapping) -> tuple[DataFrame, DataFrame]:
    marked = quarantine(df, contract)
    return (
        marked.filter(F.size("violations") == 0).drop("violations"),
        marked.filter(F.size("violations") > 0),
    )


def score_runs(results: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Roll check rows up to runs: counts, score and overall status."""
    def n(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    total, passed, failed, warned = F.count(F.lit(1)), n("PASS"), n("FAIL"), n("WARNING")
    return results.groupBy(*keys).agg(
        total.alias("total_checks"),
        passed.alias("passed_checks"),
        failed.alias("failed_checks"),
        warned.alias("warning_checks"),
        F.round(100.0 * passed / total, 2).alias("quality_score"),
        F.when(failed > 0, "FAIL").when(warned > 0, "WARNING").otherwise("PASS").alias("overall_status"),
    )


def run_validation(
    df: DataFrame,
    contract: Mapping,
    run_id: str,
    ref_time: dt.datetime,
    pipeline: str = "default_pipeline",
    parents: Mapping[str, DataFrame] | None = None,
    relationships: Sequence[tuple[str, str, str]] = (),
    check_freshness: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Suite, freshness and foreign keys in one result frame, and the run row over it."""
    from tidegate.operators.freshness import freshness_check
    from tidegate.operators.referential import referential_checks

    parts = [run_suite(df, contract)]
    if check_freshness:
        parts.append(freshness_check(df, contract, ref_time))
    if relationships:
        parts.append(referential_checks(contract["dataset"], df, parents or {}, relationships))
    results = reduce(DataFrame.unionByName, parts).select(
        F.lit(run_id).alias("run_id"),
        *RESULT_COLUMNS,
        F.lit(pipeline).alias("pipeline"),
        F.lit(ref_time).cast("timestamp").alias("timestamp"),
    )
    runs = score_runs(results, ("run_id", "dataset", "pipeline", "timestamp")).withColumn(
        "contract_version", F.lit(contract.get("version", "v1.0.0"))
    )
    return results, runs


def list_results(results: DataFrame, dataset=None, status=None, pipeline=None, limit: int = 100) -> DataFrame:
    """Newest check results with optional filters."""
    out = results
    for name, value in (("dataset", dataset), ("status", status), ("pipeline", pipeline)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out.orderBy(F.desc("timestamp"), F.desc("run_id"), F.asc("check_name")).limit(limit)


def latest_runs(runs: DataFrame, per: str = "dataset", ts: str = "timestamp", run_id: str = "run_id") -> DataFrame:
    """The newest run per dataset, by a grouped maximum (no window over a whole dataset)."""
    newest = F.max_by(F.struct(*[F.col(c) for c in runs.columns]), F.struct(F.col(ts), F.col(run_id)))
    return runs.groupBy(per).agg(newest.alias("_r")).select("_r.*")


def run_history(runs: DataFrame, dataset: str, n: int, ts: str = "timestamp") -> DataFrame:
    """The last n runs of one dataset (top-n, no full sort)."""
    return runs.filter(F.col("dataset") == dataset).orderBy(F.desc(ts), F.desc("run_id")).limit(n)


def quality_summary(runs: DataFrame) -> DataFrame:
    """One row over the latest run of each dataset, with totals over all runs."""
    latest = latest_runs(runs).agg(
        F.count(F.lit(1)).alias("datasets_checked"),
        F.count_if(F.col("overall_status") == "PASS").alias("datasets_passing"),
        F.count_if(F.col("overall_status") != "PASS").alias("datasets_failing"),
        F.round(F.avg("quality_score"), 2).alias("average_quality_score"),
        F.count_if(F.col("freshness_status").isin("WARNING", "STALE")).alias("freshness_violations"),
        F.lit(1).alias("_one"),
    )
    totals = runs.agg(
        F.coalesce(F.sum("total_checks"), F.lit(0)).alias("total_checks"),
        F.coalesce(F.sum("passed_checks"), F.lit(0)).alias("passed_checks"),
        F.coalesce(F.sum("failed_checks"), F.lit(0)).alias("failed_checks"),
        F.lit(1).alias("_one"),
    )
    return latest.join(totals, "_one").drop("_one")


def null_rate_audit(df: DataFrame, limit: float = 0.05) -> DataFrame:
    """Share of missing values per column, in one pass."""
    types = dict(df.dtypes)
    rates = df.agg(*[F.avg(is_missing(F.col(f"`{c}`"), types[c]).cast("double")).alias(c) for c in df.columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("null_rate")) for c in df.columns])
    return rates.select(F.explode(cells).alias("x")).select(
        "x.column", F.coalesce("x.null_rate", F.lit(0.0)).alias("null_rate"),
        (F.coalesce("x.null_rate", F.lit(0.0)) > limit).alias("violation"),
    )


def row_count_audit(df: DataFrame, minimum: int = 10) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(minimum).alias("minimum"), (F.col("row_count") >= minimum).alias("passed")
    )
