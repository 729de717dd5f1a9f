"""The publication gate: compute, validate, and only then publish.

The snapshot is staged once; contract, schema and quality are checked on the staged files,
and nothing a reader sees is touched before all of them pass.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators import incidents, lineage
from tidegate.operators import quality as q
from tidegate.operators.contracts import validate_contracts
from tidegate.operators.diff import schema_diff
from tidegate.operators.online import assemble, to_online
from tidegate.operators.scoring import score
from tidegate.session import one_row, stage_table
from tidegate.sources import stores
from tidegate.sources.contracts import contracts_frame
from tidegate.sources.introspect import live_contract

# The stages of a publication in order.
STAGES = [
    "DATA_SOURCE", "FEATURE_COMPUTATION", "CONTRACT_VALIDATION", "SCHEMA_VALIDATION", "DATA_QUALITY",
    "OPENLINEAGE", "AIRFLOW_ORCHESTRATION", "OFFLINE_STORE", "MATERIALIZATION", "REDIS_ONLINE_STORE",
    "ML_PREDICTION",
]
PIPELINE = "integrated_feature_pipeline"
STAGE_SCHEMA = "run_id string, position int, stage string, status string, records bigint, duration_ms double, error string"


class StageFailed(Exception):
    def __init__(self, message: str, *checks: Mapping):
        super().__init__(message)
        self.checks = checks


@dataclass
class Publication:
    """What a run did: stage rows, and the check rows and incident of a failed one."""

    run_id: str
    status: str = "SUCCESS"
    stages: list[tuple] = field(default_factory=list)
    records: int = 0
    quality_score: float | None = None
    incident: dict | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.stages, STAGE_SCHEMA)


def _lineage_event(
    spark: SparkSession, run_id: str, kind: str, at: dt.datetime, inputs: list[str], outputs: list[str], pipeline: str = PIPELINE
) -> DataFrame:
    def names(items: list[str]):
        return F.array(*[F.struct(F.lit("default").alias("namespace"), F.lit(i).alias("name")) for i in items])

    none = F.expr(f"cast(null as struct<columnLineage:{lineage.FACET}>)")
    outs = F.array(*[
        F.struct(F.lit("default").alias("namespace"), F.lit(o).alias("name"), none.alias("facets")) for o in outputs
    ]) if outputs else F.expr(
        f"cast(array() as array<struct<namespace:string,name:string,facets:struct<columnLineage:{lineage.FACET}>>>)"
    )
    return one_row(spark).select(
        F.lit(kind).alias("eventType"), F.lit(at).cast("timestamp").alias("eventTime"),
        F.struct(F.lit(run_id).alias("runId"), F.expr("map('engine', 'spark')").alias("facets")).alias("run"),
        F.struct(F.lit("default").alias("namespace"), F.lit(pipeline).alias("name"),
                 F.create_map(F.lit("pipeline_id"), F.lit(pipeline)).alias("facets")).alias("job"),
        names(inputs).alias("inputs"), outs.alias("outputs"),
    )


def _run_row(
    spark: SparkSession, run_id: str, status: str, start: dt.datetime, ms: float, error: str | None, pipeline: str = PIPELINE
) -> DataFrame:
    return one_row(spark).select(
        F.lit(run_id).alias("run_id"), F.lit(pipeline).alias("pipeline_id"), F.lit(status).alias("status"),
        F.lit(start).cast("timestamp").alias("start_time"), F.lit(ms).alias("duration_ms"),
        F.lit(error).cast("string").alias("error_message"),
    )


def validate_contract_or_fail(spark: SparkSession, contract: Mapping) -> None:
    row = validate_contracts(contracts_frame(spark, [contract])).first()
    if not row["is_valid"]:
        raise StageFailed(f"contract is invalid: {list(row['errors'])}")


def breaking_changes(df: DataFrame, contract: Mapping) -> list[str]:
    """Breaking differences of a frame's schema from its contract (schema only, no scan)."""
    spark = df.sparkSession
    changes = schema_diff(contracts_frame(spark, [contract]), live_contract(df, contract["dataset"]), live=True)
    return [f"{r['column']}: {r['change_type']}" for r in changes.filter("severity = 'BREAKING'").collect()]


def publish_features(
    spark: SparkSession,
    compute: Callable[[], DataFrame],
    contract: Mapping,
    entity: str,
    id_column: str,
    root: str,
    run_id: str,
    ref_time: dt.datetime,
    inputs: tuple[str, ...] = ("transactions", "merchants"),
    allow_breaking: bool = False,
) -> Publication:
    """Run the gate and publish ``compute()`` to the offline and online tables below ``root``."""
    out, clock = Publication(run_id), time.perf_counter
    started, mark = clock(), clock()
    dataset = contract.get("dataset", "unknown")

    def done(stage: str, records: int | None = None) -> None:
        nonlocal mark
        now = clock()
        out.stages.append((run_id, STAGES.index(stage), stage, "SUCCESS", records, (now - mark) * 1000.0, None))
        mark = now

    stage = STAGES[0]
    stores.write_log(_lineage_event(spark, run_id, "START", ref_time, list(inputs), []), root, "lineage_events", f"{run_id}.start")
    try:
        features = compute()
        done(stage)

        stage = "FEATURE_COMPUTATION"
        staged = stage_table(features, f"stage-{entity}")
        out.records = staged.count()  # from the file footers
        if not out.records:
            raise StageFailed("feature computation gave no rows")
        done(stage, out.records)

        stage = "CONTRACT_VALIDATION"
        validate_contract_or_fail(spark, contract)
        done(stage)

        stage = "SCHEMA_VALIDATION"
        breaking = breaking_changes(staged, contract)
        if breaking and not allow_breaking:
            raise StageFailed(f"breaking schema changes: {breaking}", {
                "check_name": f"schema_compatibility_{dataset}", "column": None, "expectation_type": q.SCHEMA,
                "observed_value": "; ".join(breaking), "expected_value": "Backward compatible schema", "details": "{}",
            })
        done(stage, len(breaking))

        stage = "DATA_QUALITY"
        results, _ = q.run_validation(staged, contract, run_id, ref_time, PIPELINE)
        checks = results.collect()  # one row per check of the contract
        rows = spark.createDataFrame(checks, results.schema)
        stores.write_quality(rows, q.score_runs(rows, ("run_id", "dataset", "pipeline", "timestamp")), root)
        failed = [r for r in checks if r["status"] == "FAIL"]
        out.quality_score = round(100.0 * sum(r["status"] == "PASS" for r in checks) / len(checks), 2)
        if failed:
            raise StageFailed(f"{len(failed)} of {len(checks)} checks failed", *[r.asDict() for r in failed])
        done(stage, len(checks))

        # both records say that the run goes on; those that say it is complete are written when it is
        stage = "OPENLINEAGE"
        event = _lineage_event(spark, run_id, "RUNNING", ref_time, list(inputs), [dataset])
        stores.write_log(event, root, "lineage_events", f"{run_id}.running")
        done(stage, 1)

        stage = "AIRFLOW_ORCHESTRATION"
        stores.write_log(_run_row(spark, run_id, "RUNNING", ref_time, (clock() - started) * 1000.0, None), root, "pipeline_runs", run_id)
        done(stage, 1)

        stage = "OFFLINE_STORE"
        stores.write_offline(staged, root, entity)
        done(stage, out.records)

        stage = "MATERIALIZATION"
        stores.write_changes(to_online(staged, entity, id_column, F.lit(ref_time)), f"{root}/online", run_id)
        wrote = stores.change_count(spark, f"{root}/online", run_id)
        stores.mark_published(spark, root, run_id, ref_time)
        stores.write_log(
            stores.materialization_log_row(spark, run_id, entity, ref_time, ref_time, wrote, "SUCCESS"),
            root, "materializations", run_id,
        )
        done(stage, wrote)

        stage = "REDIS_ONLINE_STORE"
        probe = staged.select(F.col(id_column).alias("customer_id")).limit(1)
        request = probe.select("customer_id", F.lit(250.0).alias("amount"))
        current = stores.read_online(spark, root)
        vector = assemble(request, current, entity, "customer_id").first()
        if vector["feature_timestamp"] is None:
            raise StageFailed("the published entity cannot be read back")
        done(stage, 1)

        stage = "ML_PREDICTION"
        score(assemble(request, current, entity, "customer_id")).select("risk_score").first()
        done(stage, 1)
        stores.write_log(_lineage_event(spark, run_id, "COMPLETE", ref_time, list(inputs), [dataset]), root, "lineage_events", f"{run_id}.end")
        stores.write_log(_run_row(spark, run_id, "SUCCESS", ref_time, (clock() - started) * 1000.0, None), root, "pipeline_runs", run_id)
    except Exception as e:
        _abort(spark, out, root, dataset, contract, stage, e, ref_time, inputs, (clock() - started) * 1000.0, (clock() - mark) * 1000.0)
        if not isinstance(e, StageFailed):
            raise
    return out


def _resolutions(spark: SparkSession, root: str) -> DataFrame:
    """Resolve signals written so far (none: an empty frame)."""
    if stores.path_exists(spark, f"{root}/incident_resolutions"):
        return stores.read_log(spark, root, "incident_resolutions").select("failure_signature", "timestamp")
    return spark.createDataFrame([], "failure_signature string, timestamp timestamp")


def open_incidents(spark: SparkSession, root: str, except_run: str | None = None) -> DataFrame:
    """Incidents of failed publications that no later resolve has closed."""
    opened = stores.read_log(spark, root, "incidents")
    if except_run is not None:
        opened = opened.filter(F.col("run_id") != except_run)
    signals = opened.select(
        "failure_signature", "timestamp", F.lit("FAIL").alias("kind"), F.concat(F.lit("1_"), "run_id").alias("event_id")
    ).unionByName(_resolutions(spark, root).select(
        # a resolve comes after the failures of its own instant
        "failure_signature", "timestamp", F.lit("RESOLVE").alias("kind"), F.lit("2_resolve").alias("event_id")
    ))
    return incidents.deduplicate(signals).filter("status = 'OPEN'")


def resolve_incident(spark: SparkSession, root: str, signature: str, at: dt.datetime, actor: str) -> None:
    """Close the open incident of a signature; the next failure of it opens a new one."""
    row = one_row(spark).select(
        F.lit(signature).alias("failure_signature"), F.lit(at).cast("timestamp").alias("timestamp"), F.lit(actor).alias("actor")
    )
    stores.write_log(row, root, "incident_resolutions", f"{signature}_{at:%Y%m%dT%H%M%S%f}")


def _abort(spark, out: Publication, root, dataset, contract, stage, error, at, inputs, total_ms, stage_ms) -> None:
    """Record a failed run: FAIL event, incident, run row, and SKIPPED for what did not run."""
    out.status = "FAILED"
    out.stages.append((out.run_id, STAGES.index(stage), stage, "FAILED", None, stage_ms, str(error)))
    for later in STAGES[STAGES.index(stage) + 1:]:
        out.stages.append((out.run_id, STAGES.index(later), later, "SKIPPED", None, 0.0, f"halted in {stage}"))
    _record_failure(spark, out, root, dataset, contract, stage, error, at, list(inputs), total_ms, PIPELINE)


def _record_failure(spark, out: Publication, root, dataset, contract, stage, error, at, inputs, total_ms, pipeline) -> None:
    """FAIL event, run row, and an incident for every failing check that no open incident covers."""
    message = str(error)
    checks = getattr(error, "checks", ()) or [{
        "check_name": f"{stage.lower()}_check", "column": None,
        "expectation_type": f"expect_{stage.lower()}_to_succeed", "observed_value": message,
        "expected_value": "SUCCESS", "details": "{}",
    }]
    columns = ("check_name", "column", "expectation_type", "observed_value", "expected_value", "details")
    texts = [tuple(None if x[c] is None else str(x[c]) for c in columns) for x in checks]
    rows = spark.createDataFrame(texts, ", ".join(f"`{c}` string" for c in columns)).select(
        F.lit(dataset).alias("dataset"), F.lit(pipeline).alias("pipeline"), F.lit("FAIL").alias("status"),
        F.lit(False).alias("success"), F.lit(out.run_id).alias("run_id"), *columns, F.lit(at).cast("timestamp").alias("timestamp"),
    )
    owners = one_row(spark).select(F.lit(dataset).alias("dataset"), F.lit(contract.get("owner")).cast("string").alias("owner"))
    failures = incidents.failures(rows, owners)
    out.incident = failures.first().asDict()
    if stores.path_exists(spark, f"{root}/incidents"):
        # a failure whose incident another run has opened is the same incident, as long as that one is open
        known = open_incidents(spark, root, out.run_id).select("failure_signature")
        failures = failures.join(known, "failure_signature", "left_anti").select(failures.columns)
    stores.write_log(failures, root, "incidents", out.run_id)
    stores.write_log(_lineage_event(spark, out.run_id, "FAIL", at, inputs, [], pipeline), root, "lineage_events", f"{out.run_id}.end")
    stores.write_log(_run_row(spark, out.run_id, "FAILED", at, total_ms, message, pipeline), root, "pipeline_runs", out.run_id)


DATASET_PIPELINE = "dataset_pipeline"
DATASET_STAGES = ["CONTRACT_VALIDATION", "SCHEMA_VALIDATION", "DATA_QUALITY"]


def validate_dataset(
    spark: SparkSession, df: DataFrame, contract: Mapping, run_id: str, ref_time: dt.datetime,
    parents: Mapping[str, DataFrame] | None = None, relationships=(), check_freshness: bool = True, root: str | None = None,
) -> Publication:
    """The dataset pipeline: contract, schema, then freshness and quality; stage rows.

    With ``root`` the run is recorded below it: lineage events, the checks with their run row, the
    pipeline run, and incidents of a failure.  An exception other than a failed stage is recorded
    and raised.
    """
    out, clock = Publication(run_id), time.perf_counter
    dataset, started = contract.get("dataset", "unknown"), clock()

    def event(kind: str, outputs: list[str], entry: str) -> None:
        if root is not None:
            rows = _lineage_event(spark, run_id, kind, ref_time, [dataset], outputs, DATASET_PIPELINE)
            stores.write_log(rows, root, "lineage_events", f"{run_id}.{entry}")

    event("START", [], "start")
    for i, name in enumerate(DATASET_STAGES):
        mark, error, records = clock(), None, None
        try:
            if name == "CONTRACT_VALIDATION":
                validate_contract_or_fail(spark, contract)
            elif name == "SCHEMA_VALIDATION":
                breaking = breaking_changes(df, contract)
                if breaking:
                    raise StageFailed(f"breaking schema changes: {breaking}")
            else:
                results, runs = q.run_validation(
                    df, contract, run_id, ref_time, DATASET_PIPELINE, parents, relationships, check_freshness
                )
                checks = results.collect()  # one row per check of the contract
                records = len(checks)
                if root is not None:
                    rows = spark.createDataFrame(checks, results.schema)
                    stores.write_quality(rows, q.score_runs(rows, ("run_id", "dataset", "pipeline", "timestamp")), root)
                out.quality_score = round(100.0 * sum(r["status"] == "PASS" for r in checks) / records, 2)
                failed = [r.asDict() for r in checks if r["status"] == "FAIL"]
                if failed:
                    raise StageFailed(f"{len(failed)} of {records} checks failed", *failed)
        except Exception as e:
            error = e
        ms = (clock() - mark) * 1000.0
        out.stages.append((run_id, i, name, "FAILED" if error else "SUCCESS", records, ms, str(error) if error else None))
        if error:
            out.status = "FAILED"
            out.stages += [(run_id, j, later, "SKIPPED", None, 0.0, f"halted in {name}")
                           for j, later in enumerate(DATASET_STAGES) if j > i]
            if root is not None:
                _record_failure(spark, out, root, dataset, contract, name, error, ref_time, [dataset],
                                (clock() - started) * 1000.0, DATASET_PIPELINE)
            if not isinstance(error, StageFailed):
                raise error
            return out
    event("COMPLETE", [dataset], "end")
    if root is not None:
        row = _run_row(spark, run_id, "SUCCESS", ref_time, (clock() - started) * 1000.0, None, DATASET_PIPELINE)
        stores.write_log(row, root, "pipeline_runs", run_id)
    return out
