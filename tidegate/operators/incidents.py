"""Incidents: from failing checks to deduplicated incidents, their life cycle and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.scalars import failure_signature, seconds_between
from tidegate.operators import quality as q
from tidegate.operators.contracts import latest_versions
from tidegate.operators.slices import Running, running

DEFAULT_OWNER = "data-platform-team"
# Columns that are primary keys whatever their name looks like.
KEY_COLUMNS = [
    "order_id", "customer_id", "account_id", "transaction_id", "merchant_id",
    "payment_id", "item_id", "product_id", "event_id", "entity_id",
]


def severity(kind="expectation_type", column="column", details="details") -> Column:
    """Severity policy of a failed check.  A column named ``id`` or ending in ``_id`` is key-like."""
    k = F.col(kind)
    name = F.lower(F.coalesce(F.col(column), F.lit("")))
    state = F.upper(F.coalesce(F.get_json_object(F.col(details), "$.status"), F.lit("")))
    return (
        F.when(k.isin(q.FOREIGN_KEY, q.EXISTS, q.SCHEMA), "CRITICAL")
        .when(k == q.UNIQUE, F.when(name.isin(KEY_COLUMNS) | name.rlike("(^|_)id$"), "CRITICAL").otherwise("HIGH"))
        .when(
            k == q.FRESHNESS,
            F.when(state.contains("STALE"), "CRITICAL").when(state.contains("WARNING"), "MEDIUM").otherwise("CRITICAL"),
        )
        .when(k == q.NOT_NULL, "HIGH")
        .otherwise("MEDIUM")
    )


def failures(results: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """Failing check rows with owner, severity, signature and texts; passing rows are dropped.

    ``contracts`` (dataset, owner) gives the owner, of the last registered version if it is a
    registry; without one a default owns the failure.
    """
    failing = results.filter(~F.col("success") & (F.col("status") != "PASS"))
    if contracts is not None:
        if "registered_at" in contracts.columns:
            contracts = latest_versions(contracts)
        owners = contracts.groupBy("dataset").agg(F.max("owner").alias("_owner"))
        failing = failing.join(owners, "dataset", "left")
    else:
        failing = failing.withColumn("_owner", F.lit(None).cast("string"))

    def shown(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("N/A"))

    return failing.withColumns({
        "owner": F.coalesce(F.nullif(F.col("_owner"), F.lit("")), F.lit(DEFAULT_OWNER)),
        "incident_severity": severity(),
        "failure_signature": failure_signature("dataset", "pipeline", "check_name", "expectation_type", "column"),
        "title": F.concat(F.lit("Data quality failure: "), F.col("check_name"), F.lit(" on "), F.col("dataset")),
        "description": F.concat(
            F.lit("check "), F.col("check_name"), F.lit(" ("), F.col("expectation_type"), F.lit("); column "),
            shown("column"), F.lit("; observed "), shown("observed_value"), F.lit("; expected "), shown("expected_value"),
        ),
    }).drop("_owner")


def deduplicate(
    signals: DataFrame, signature: str = "failure_signature", ts: str = "timestamp",
    row_id: str = "event_id", kind: str = "kind", slice_seconds: int | None = None,
) -> DataFrame:
    """Incidents from a log of FAIL and RESOLVE signals per signature.

    An incident opens at the first failure while none is open; later failures attach to it
    until a resolve.  The epoch of a signal is the number of resolves before it.
    """
    resolved = (F.col(kind) == "RESOLVE").cast("bigint")
    epochs = running(
        signals, [signature], ts, row_id,
        {"_epoch": Running(resolved, exclusive=True)}, slice_seconds,
    ).withColumn("_epoch", F.coalesce("_epoch", F.lit(0)))
    fail, order = F.col(kind) == "FAIL", F.struct(ts, row_id)
    return (
        epochs.groupBy(signature, "_epoch")
        .agg(
            F.min(F.when(fail, order)).alias("_first"),
            F.count_if(fail).alias("failure_count"),
            F.max(F.when(fail, F.col(ts))).alias("last_failure_at"),
            F.min(F.when(~fail, F.col(ts))).alias("resolved_at"),
        )
        .filter(F.col("_first").isNotNull())
        .select(
            F.concat(F.lit("inc_"), F.substring(signature, 5, 12), F.lit("_"), F.col(f"_first.{row_id}").cast("string"))
            .alias("incident_id"),
            signature,
            F.col("_epoch").alias("epoch"),
            F.col(f"_first.{ts}").alias("opened_at"),
            F.col(f"_first.{row_id}").alias("opened_by"),
            "failure_count",
            "last_failure_at",
            "resolved_at",
            F.when(F.col("resolved_at").isNull(), "OPEN").otherwise("RESOLVED").alias("status"),
        )
    )


def _milestones(log: DataFrame) -> DataFrame:
    """Per incident: when it was created, first acknowledged while open, first resolved.

    The state machine only moves forward, so these three instants say everything.  An
    acknowledgement counts when it comes before the resolution; as the earliest one is the
    only one that changes the state, the minimum is enough.
    """
    order = F.struct("timestamp", "id")

    def first(state: str) -> Column:
        return F.min(F.when(F.col("new_status") == state, order))

    m = log.groupBy("incident_id").agg(
        F.min(order).alias("_created"), first("ACKNOWLEDGED").alias("_a"), first("RESOLVED").alias("_resolved")
    )
    return m.withColumn(
        "_acked", F.when(F.col("_resolved").isNull() | (F.col("_a") < F.col("_resolved")), F.col("_a"))
    ).drop("_a")


def audit_trail(log: DataFrame) -> DataFrame:
    """Every event with its outcome: CREATED, APPLIED, NOOP or REJECTED."""
    at, new = F.struct("timestamp", "id"), F.col("new_status")
    acked, resolved = F.col("_acked"), F.col("_resolved")
    rows = log.join(_milestones(log), "incident_id", "inner")
    outcome = (
        F.when(at == F.col("_created"), "CREATED")
        .when(at > resolved, "REJECTED")
        .when(at == resolved, "APPLIED")
        .when(new == "ACKNOWLEDGED", F.when(at == acked, "APPLIED").otherwise("NOOP"))
        .when(at > acked, "REJECTED")
        .otherwise("NOOP")
    )
    return rows.withColumn("outcome", outcome).drop("_created", "_acked", "_resolved")


def events_of(log: DataFrame, incident_id: str) -> DataFrame:
    """Audit trail of one incident in order."""
    return audit_trail(log.filter(F.col("incident_id") == incident_id)).orderBy("timestamp", "id")


def fold(log: DataFrame) -> DataFrame:
    """Current state of every incident from its event log."""
    m = _milestones(log)
    return m.select(
        "incident_id",
        F.when(F.col("_resolved").isNotNull(), "RESOLVED").when(F.col("_acked").isNotNull(), "ACKNOWLEDGED")
        .otherwise("OPEN").alias("status"),
        F.col("_created.timestamp").alias("created_at"),
        F.col("_acked.timestamp").alias("acknowledged_at"),
        F.col("_resolved.timestamp").alias("resolved_at"),
        F.greatest(F.col("_created.timestamp"), F.col("_acked.timestamp"), F.col("_resolved.timestamp"))
        .alias("updated_at"),
    )


def transition(incidents: DataFrame, new_status: str, at: Column, actor: str, notes: str | None = None) -> DataFrame:
    """Event rows that acknowledge or resolve the given incidents (append them to the log)."""
    kind = {"ACKNOWLEDGED": "INCIDENT_ACKNOWLEDGED", "RESOLVED": "INCIDENT_RESOLVED"}[new_status]
    allowed = F.col("status") == "OPEN" if new_status == "ACKNOWLEDGED" else F.col("status").isin("OPEN", "ACKNOWLEDGED")
    return incidents.filter(allowed).select(
        "incident_id", F.lit(kind).alias("event_type"), F.col("status").alias("old_status"),
        F.lit(new_status).alias("new_status"), F.lit(actor).alias("actor"), at.alias("timestamp"),
        F.lit(notes).cast("string").alias("notes"),
    )


def latencies(states: DataFrame) -> DataFrame:
    """Seconds to acknowledge and to resolve, per incident."""
    return states.withColumns({
        "ack_seconds": seconds_between(F.col("acknowledged_at"), F.col("created_at")),
        "resolve_seconds": seconds_between(F.col("resolved_at"), F.col("created_at")),
    })


def summary(states: DataFrame) -> DataFrame:
    """One row: counts by state and severity, oldest open incident, mean times."""
    rows = latencies(states)

    def n(c: str, v: str) -> Column:
        return F.count_if(F.col(c) == v)

    def mean(c: str) -> Column:
        return F.round(F.avg(F.when(F.col(c) >= 0, F.col(c))), 2)

    oldest = F.min(F.when(F.col("status") == "OPEN", F.struct("created_at", "incident_id")))
    return rows.agg(
        F.count(F.lit(1)).alias("total_incidents"),
        *[n("status", s).alias(f"{s.lower()}_incidents") for s in ("OPEN", "ACKNOWLEDGED", "RESOLVED")],
        *[n("severity", s).alias(f"{s.lower()}_incidents") for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
        oldest["incident_id"].alias("oldest_open_incident"),
        oldest["created_at"].alias("oldest_open_at"),
        mean("ack_seconds").alias("mtta_seconds"),
        mean("resolve_seconds").alias("mttr_seconds"),
    )


def severity_distribution(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("severity").agg(F.count(F.lit(1)).alias("incidents"))


def list_incidents(
    incidents: DataFrame, dataset=None, pipeline=None, severity=None, status=None, owner=None, limit: int = 100
) -> DataFrame:
    """Newest incidents with optional filters; severity and status ignore case."""
    out = incidents
    filters = {"dataset": dataset, "pipeline": pipeline, "owner": owner,
               "severity": severity and severity.upper(), "status": status and status.upper()}
    for name, value in filters.items():
        if value:
            out = out.filter(F.col(name) == value)
    return out.orderBy(F.desc("created_at"), F.desc("incident_id")).limit(limit)


def with_lineage(incidents: DataFrame, upstream: DataFrame) -> DataFrame:
    """Incidents with the datasets and pipelines upstream of the failing dataset.

    ``upstream`` is the closure (start, node, node_type); it reduces to one row per dataset
    before the join.
    """
    context = upstream.groupBy(F.col("start").alias("dataset")).agg(
        F.array_sort(F.collect_set(F.when(F.col("node_type") == "dataset", F.col("node")))).alias("upstream_datasets"),
        F.array_sort(F.collect_set(F.when(F.col("node_type") == "pipeline", F.col("node")))).alias("upstream_pipelines"),
    )
    return incidents.join(context, "dataset", "left")
