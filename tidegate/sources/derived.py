"""Operational tables (checks, runs, incidents, contracts, lineage) that follow from the
supplied tables row by row, so that every job over them grows with the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators import quality as q
from tidegate.sources.contracts import COLUMN_TYPE
from tidegate.sources.tables import table

CHECK_KINDS = [q.NOT_NULL, q.UNIQUE, q.IN_SET, q.BETWEEN, q.FOREIGN_KEY, q.EXISTS, q.ROW_COUNT]


def pick(options: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), index.cast("int") + 1)


def text(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("ts"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def check_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One check result per event: errors fail, views warn, the rest pass."""
    e = _events(spark, sf_dir)
    kind = pick(CHECK_KINDS, F.col("user_id") % 7)
    column = text("col_", F.col("user_id") % 5)
    status = F.when(F.col("event_type") == "error", "FAIL").when(F.col("event_type") == "view", "WARNING").otherwise("PASS")
    return e.select(
        "event_id",
        F.concat(text("run_", F.floor(F.col("event_id") / 20)), text("_", F.col("k") % 10)).alias("run_id"),
        text("ds_", F.col("k") % 10).alias("dataset"),
        F.concat_ws("_", kind, column).alias("check_name"),
        column.alias("column"),
        kind.alias("expectation_type"),
        status.alias("status"),
        pick(["LOW", "MEDIUM", "HIGH"], F.col("user_id") % 3).alias("severity"),
        F.concat(F.col("value").cast("bigint").cast("string"), F.lit(" unexpected")).alias("observed_value"),
        F.lit("Invariant satisfied").alias("expected_value"),
        (F.col("event_type") != "error").alias("success"),
        text("pipe_", F.col("k") % 4).alias("pipeline"),
        F.col("ts").alias("timestamp"),
        F.lit("{}").alias("details"),
        "event_type",
    )


def quality_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs rolled up from the check results; freshness state from the newest check."""
    r = check_results(spark, sf_dir)
    runs = q.score_runs(r, ("run_id", "dataset"))
    times = r.groupBy("run_id", "dataset").agg(
        F.max("timestamp").alias("timestamp"),
        F.max_by(
            F.when(F.col("event_type") == "error", "STALE").when(F.col("event_type") == "view", "WARNING").otherwise("FRESH"),
            F.struct("timestamp", "event_id"),
        ).alias("freshness_status"),
        F.max("pipeline").alias("pipeline"),
    )
    return runs.join(times, ["run_id", "dataset"], "inner")


def incident_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures (errors) and resolves (signups) per failure signature."""
    from tidegate.functions.scalars import failure_signature

    r = check_results(spark, sf_dir).filter(F.col("event_type").isin("error", "signup"))
    return r.select(
        failure_signature("dataset", "pipeline", "check_name", "expectation_type", "column").alias("failure_signature"),
        "event_id", "timestamp",
        F.when(F.col("event_type") == "error", "FAIL").otherwise("RESOLVE").alias("kind"),
        "dataset", "pipeline", "expectation_type", "column", "details",
    )


def incident_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events of incidents: six consecutive events make the log of one incident."""
    e = _events(spark, sf_dir)
    state = (
        F.when(F.col("event_id") % 6 == 0, "OPEN")
        .when(F.col("event_type") == "error", "ACKNOWLEDGED")
        .when(F.col("event_type") == "signup", "RESOLVED")
        .otherwise("OPEN")
    )
    return e.select(
        text("inc_", F.floor(F.col("event_id") / 6)).alias("incident_id"),
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), state.alias("new_status"),
        text("user_", F.col("user_id")).alias("actor"),
    )


def incident_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static attributes of the incidents of ``incident_log``."""
    e = _events(spark, sf_dir).filter(F.col("event_id") % 6 == 0)
    return e.select(
        text("inc_", F.floor(F.col("event_id") / 6)).alias("incident_id"),
        text("ds_", F.col("k") % 10).alias("dataset"),
        text("pipe_", F.col("k") % 20).alias("pipeline"),
        pick(["CRITICAL", "HIGH", "MEDIUM", "LOW"], F.col("user_id") % 4).alias("severity"),
        text("team_", F.col("user_id") % 3).alias("owner"),
    )


def pipeline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pipeline run per event."""
    e = _events(spark, sf_dir)
    return e.select(
        text("prun_", F.col("event_id")).alias("run_id"),
        text("pipe_", F.col("k") % 20).alias("pipeline_id"),
        F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "RUNNING")
        .otherwise("SUCCESS").alias("status"),
        F.col("ts").alias("start_time"),
        (F.col("value") * 10).alias("duration_ms"),
        pick(["compute", "contract", "schema", "quality", "publish"], F.col("user_id") % 5).alias("stage"),
        F.concat(text("run_", F.floor(F.col("event_id") / 20)), text("_", F.col("k") % 10)).alias("quality_run_id"),
    )


def pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipeline metadata from suppliers, with the time of each pipeline's last run."""
    last = pipeline_runs(spark, sf_dir).groupBy("pipeline_id").agg(F.max("start_time").alias("last_run_at"))
    return table(spark, sf_dir, "supplier").select(
        text("pipe_", F.col("s_suppkey")).alias("pipeline_id"),
        F.when(F.col("s_nationkey") % 5 == 0, "PAUSED").otherwise("ACTIVE").alias("status"),
        text("team_", F.col("s_nationkey") % 4).alias("owner"),
        (F.lit(60) * (1 + F.col("s_suppkey") % 48)).cast("int").alias("freshness_sla_minutes"),
    ).join(last, "pipeline_id", "left")


def feature_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature registrations from parts: four successive definitions per feature name."""
    return table(spark, sf_dir, "part").select(
        text("feature_", F.floor(F.col("p_partkey") / 4)).alias("name"),
        F.col("p_type").alias("feature_group"), F.col("p_brand").alias("entity"),
        F.col("p_size").alias("freshness_sla_minutes"), F.col("p_partkey").alias("updated_at"),
    )


COLUMNS_PER_CONTRACT = 20
TYPE_CYCLE = ["integer", "numeric", "string", "timestamp", "float"]


def contract_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registered versions per dataset; twenty consecutive parts are its columns.

    The second version differs by rules over the part key: columns come, go and are renamed,
    and types, nullability, keys, enums and ranges change.
    """
    p = F.col("p_partkey")

    def hit(n: int) -> Column:
        return p % n == 0

    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_brand", "p_type", F.floor(p / COLUMNS_PER_CONTRACT).alias("d")
    )
    slot = text("c_", p % COLUMNS_PER_CONTRACT)
    size = F.col("p_size")
    is_text = pick(TYPE_CYCLE, size % 5) == "string"

    def version(label: str, second: bool) -> DataFrame:
        def flips(n: int) -> Column:
            return hit(n) if second else F.lit(False)

        kept = part.filter(~hit(31)) if second else part.filter(~hit(37))
        low = size.cast("double")
        if second:
            low = low + F.when(hit(23), 1.0).when(hit(29), -1.0).otherwise(0.0)
        brand = F.array(F.col("p_brand"), F.col("p_type"))
        enum = F.when(flips(7), F.array(F.col("p_brand"), F.lit("extra"))).otherwise(brand)
        column = F.struct(
            (F.when(hit(97), text("r_", p % COLUMNS_PER_CONTRACT)).otherwise(slot) if second else slot).alias("name"),
            pick(TYPE_CYCLE, F.when(flips(13), size + 1).otherwise(size) % 5).alias("type"),
            F.when(flips(17), size % 2 != 0).otherwise(size % 2 == 0).alias("nullable"),
            F.when(flips(19), size % 10 != 0).otherwise(size % 10 == 0).alias("unique"),
            F.when(flips(11), "edited").otherwise("text").alias("description"),
            F.when(is_text, enum).alias("allowed_values"),
            low.alias("min"),
            F.lit(100.0).alias("max"),
            F.lit(None).cast("array<string>").alias("keys"),
        ).cast(COLUMN_TYPE)
        # the group is one document of at most twenty columns
        docs = kept.groupBy("d").agg(
            F.transform(F.array_sort(F.collect_list(F.struct(p, column.alias("c")))), lambda x: x["c"]).alias("columns")
        )
        d = F.col("d")
        n = 1 if second else 0
        return docs.select(
            text("ds_", d).alias("dataset"),
            F.lit(label).alias("version"),
            text("team_", d % 5).alias("owner"),
            F.when((d % 5 == 0) & F.lit(second), "second text").otherwise("first text").alias("description"),
            (F.when((d % 3 == 0) & F.lit(second), 30).when((d % 3 == 1) & F.lit(second), 120).otherwise(60)).cast("int")
            .alias("freshness_sla_minutes"),
            F.when(d % 4 == 3, "DRAFT").otherwise("ACTIVE").alias("status"),
            "columns",
            F.lit(None).cast("map<string,string>").alias("constraint_map"),
            F.array(F.lit("a > 0"), F.when((d % 4 == 0) & F.lit(second), "b > 1").otherwise("b > 0")).alias("constraint_texts"),
            F.lit(None).cast("array<string>").alias("root_keys"),
            F.timestamp_seconds(F.lit(1_700_000_000) + d * 10 + n).alias("registered_at"),
            (d * 2 + n).alias("contract_id"),
        )

    return version("v1", False).unionByName(version("v2", True))


def broken_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First versions with structure errors planted by rules over the keys."""
    c = contract_versions(spark, sf_dir).filter(F.col("version") == "v1")
    d = F.floor(F.col("contract_id") / 2)

    def spoil(x: Column, i: Column) -> Column:
        n = i + d
        return F.struct(
            F.when(n % 41 == 0, F.lit("c_0")).otherwise(x["name"]).alias("name"),
            F.when(n % 43 == 0, F.lit("money")).otherwise(x["type"]).alias("type"),
            F.when(n % 47 == 0, F.lit(None).cast("boolean")).otherwise(x["nullable"]).alias("nullable"),
            x["unique"].alias("unique"), x["description"].alias("description"),
            F.when(n % 53 == 0, F.array().cast("array<string>")).otherwise(x["allowed_values"]).alias("allowed_values"),
            F.when(n % 29 == 0, F.lit(1000.0)).otherwise(x["min"]).alias("min"),
            x["max"].alias("max"), x["keys"].alias("keys"),
        )

    return c.withColumns({
        "columns": F.transform("columns", spoil),
        "version": F.when(d % 10 == 9, F.lit(None).cast("string")).otherwise(F.col("version")),
        "status": F.when(d % 9 == 4, "RETIRED").otherwise(F.col("status")),
        "freshness_sla_minutes": F.when(d % 7 == 3, 0).otherwise(F.col("freshness_sla_minutes")),
        "owner": F.when(d % 8 == 5, F.lit(None).cast("string")).otherwise(F.col("owner")),
    })


def lineage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run events: consecutive events 2n and 2n+1 start and end run n."""
    e = _events(spark, sf_dir)
    rid = F.floor(F.col("event_id") / 2)
    ends = F.col("event_id") % 2 == 1
    j = rid % 40
    out_id = (j * 3 + 1) % 60

    def field(name: Column) -> Column:
        return F.struct(F.lit("default").alias("namespace"), text("ds_", j).alias("name"), name.alias("field"))

    mapped = F.struct(
        F.array(field(text("c_", j % 3)), field(text("c_", (j + 1) % 3))).alias("inputFields"),
        text("rule ", j % 7).alias("transformationDescription"),
    )
    facet = F.struct(F.struct(F.create_map(text("c_", (j + 2) % 3), mapped).alias("fields")).alias("columnLineage"))
    outputs = F.array(F.struct(F.lit("default").alias("namespace"), text("ds_", out_id).alias("name"), facet.alias("facets")))
    return e.select(
        F.when(~ends, "START").when(F.col("event_type") == "error", "FAIL")
        .when(F.col("event_type") == "view", "RUNNING").otherwise("COMPLETE").alias("eventType"),
        F.col("ts").alias("eventTime"),
        F.struct(
            text("run_", rid).alias("runId"),
            F.create_map(
                F.when(ends, "ended_by").otherwise("started_by"), F.col("event_type"),
                F.lit("attempt"), F.col("user_id").cast("string"),
            ).alias("facets"),
        ).alias("run"),
        F.struct(
            F.lit("default").alias("namespace"), text("job_", j).alias("name"),
            F.create_map(F.lit("pipeline_id"), text("pipe_", j)).alias("facets"),
        ).alias("job"),
        F.array(
            F.struct(F.lit("default").alias("namespace"), text("ds_", j).alias("name")),
            F.struct(F.lit("postgres").alias("namespace"), text("raw_", j % 7).alias("name")),
        ).alias("inputs"),
        F.when(ends, outputs).otherwise(F.filter(outputs, lambda x: F.lit(False))).alias("outputs"),
    )


def declared_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared column mappings from parts, for the pipelines of ``lineage_events``."""
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        text("postgres.src_", p % 11).alias("source_dataset"), text("s_", p % 13).alias("source_column"),
        text("ds_", (p % 40 * 3 + 1) % 60).alias("target_dataset"), text("t_", F.col("p_size") % 4).alias("target_column"),
        text("pipe_", p % 40).alias("pipeline_id"), F.concat(F.lit("CAST "), F.col("p_type")).alias("transformation"),
    ).distinct()
