"""Lineage: run events to jobs, datasets, runs, edges and column mappings; graph closures."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.session import stage_table

FIELD = "struct<namespace:string,name:string,field:string>"
FACET = f"struct<fields:map<string,struct<inputFields:array<{FIELD}>,transformationDescription:string>>>"
EVENT_SCHEMA = (
    "eventType string, eventTime timestamp, "
    "run struct<runId:string,facets:map<string,string>>, "
    "job struct<namespace:string,name:string,facets:map<string,string>>, "
    "inputs array<struct<namespace:string,name:string>>, "
    f"outputs array<struct<namespace:string,name:string,facets:struct<columnLineage:{FACET}>>>"
)


def read_events(spark, path: str, stream: bool = False) -> DataFrame:
    """Run events as JSON lines, with the explicit nested schema."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENT_SCHEMA).json(path)


def qualified(namespace: Column, name: Column) -> Column:
    """``namespace.name``, the bare name in the default namespace: the one id of a dataset."""
    ns = F.coalesce(namespace, F.lit("default"))
    return F.when(ns == "default", name).otherwise(F.concat_ws(".", ns, name))


def pipeline_of(events: DataFrame) -> Column:
    return F.coalesce(F.try_element_at(F.col("job.facets"), F.lit("pipeline_id")), F.col("job.name"))


def jobs(events: DataFrame) -> DataFrame:
    return events.select(
        qualified(F.col("job.namespace"), F.col("job.name")).alias("job_id"),
        F.col("job.name").alias("name"),
        F.coalesce("job.namespace", F.lit("default")).alias("namespace"),
        pipeline_of(events).alias("pipeline_id"),
    ).distinct()


def _io(events: DataFrame, side: str) -> DataFrame:
    return events.select(F.explode(side).alias("d")).select(
        qualified(F.col("d.namespace"), F.col("d.name")).alias("dataset_id"),
        F.col("d.name").alias("name"),
        F.coalesce("d.namespace", F.lit("default")).alias("namespace"),
    )


def datasets(events: DataFrame) -> DataFrame:
    """Every dataset that occurs as an input or output."""
    return _io(events, "inputs").unionByName(_io(events, "outputs")).distinct()


def runs(events: DataFrame) -> DataFrame:
    """Run state folded from its events; the last event decides the status."""
    kind = F.upper("eventType")
    state = F.when(kind.isin("START", "COMPLETE", "FAIL"), kind).otherwise("RUNNING")
    # the status breaks ties of time, so that an end beats a start
    order = F.struct(F.col("eventTime"), (kind != "START").cast("int"), state)
    def names(side: str) -> Column:
        return F.transform(side, lambda d: qualified(d["namespace"], d["name"]))

    return events.groupBy(F.col("run.runId").alias("run_id")).agg(
        F.max_by(pipeline_of(events), order).alias("pipeline_id"),
        F.max_by(state, order).alias("status"),
        F.coalesce(F.min(F.when(kind == "START", F.col("eventTime"))), F.min("eventTime")).alias("start_time"),
        F.max(F.when(kind.isin("COMPLETE", "FAIL"), F.col("eventTime"))).alias("end_time"),
        F.max_by(names("inputs"), order).alias("inputs"),
        F.max_by(names("outputs"), order).alias("outputs"),
    )


def run_facets(events: DataFrame) -> DataFrame:
    """Facets of each run, the later value of a key winning: (run_id, facet, value)."""
    order = F.struct(F.col("eventTime"), (F.upper("eventType") != "START").cast("int"))
    cells = events.select(
        F.col("run.runId").alias("run_id"), order.alias("o"), F.explode("run.facets").alias("facet", "value")
    )
    return cells.groupBy("run_id", "facet").agg(F.max_by("value", F.struct("o", "value")).alias("value"))


def edges(events: DataFrame) -> DataFrame:
    """Edges of three kinds, one row per (source, target, pipeline) with the last run."""
    pipe = pipeline_of(events)
    base = events.select(
        F.col("run.runId").alias("run_id"), F.col("eventTime").alias("at"), pipe.alias("pipeline_id"),
        "inputs", "outputs",
    )
    ins = base.select("*", F.explode("inputs").alias("i")).withColumn("src", qualified(F.col("i.namespace"), F.col("i.name")))
    outs = base.select("*", F.explode("outputs").alias("o")).withColumn("dst", qualified(F.col("o.namespace"), F.col("o.name")))
    both = ins.select("*", F.explode("outputs").alias("o")).withColumn("dst", qualified(F.col("o.namespace"), F.col("o.name")))
    parts = [
        ins.select("src", F.col("pipeline_id").alias("dst"), "pipeline_id", "run_id", "at", F.lit("INPUT_TO_PIPELINE").alias("edge_type")),
        outs.select(F.col("pipeline_id").alias("src"), "dst", "pipeline_id", "run_id", "at", F.lit("PIPELINE_TO_OUTPUT").alias("edge_type")),
        both.select("src", "dst", "pipeline_id", "run_id", "at", F.lit("DATASET_DEPENDENCY").alias("edge_type")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("src", "dst", "pipeline_id").agg(
        F.max_by("edge_type", F.struct("at", "run_id")).alias("edge_type"),
        F.max_by("run_id", F.struct("at", "run_id")).alias("run_id"), F.max("at").alias("at"),
    ).withColumnsRenamed({"src": "source_dataset", "dst": "target_dataset"})


def column_mappings(events: DataFrame) -> DataFrame:
    """Column-level lineage, one row per five-part key with the last transformation and run."""
    rows = events.select(
        F.col("run.runId").alias("run_id"), F.col("eventTime").alias("at"), pipeline_of(events).alias("pipeline_id"),
        F.explode("outputs").alias("o"),
    ).select(
        "run_id", "at", "pipeline_id", qualified(F.col("o.namespace"), F.col("o.name")).alias("target_dataset"),
        F.explode("o.facets.columnLineage.fields").alias("target_column", "f"),
    ).select(
        "run_id", "at", "pipeline_id", "target_dataset", "target_column",
        F.coalesce("f.transformationDescription", F.lit("TRANSFORM")).alias("transformation"),
        F.explode("f.inputFields").alias("i"),
    ).withColumns({
        "source_dataset": qualified(F.col("i.namespace"), F.col("i.name")), "source_column": F.col("i.field"),
    })
    newest = F.struct("at", "run_id", "transformation")
    return rows.groupBy("source_dataset", "source_column", "target_dataset", "target_column", "pipeline_id").agg(
        F.max_by("transformation", newest).alias("transformation"), F.max_by("run_id", newest).alias("run_id"), F.max("at").alias("at")
    )


def attach_declared(run_outputs: DataFrame, declared: DataFrame) -> DataFrame:
    """Column facets for outputs without one, from declared mappings.

    ``run_outputs`` (run_id, pipeline_id, dataset); ``declared`` (source_dataset,
    source_column, target_dataset, target_column, transformation, pipeline_id).  A store
    prefix is no part of the name a mapping is declared under.  The mappings are folded to one
    row per column before they meet the runs, so the join gives one row per run and column.
    """
    bare = F.regexp_replace("dataset", "^(postgres|redis)\\.", "")
    named = run_outputs.select("run_id", "pipeline_id", "dataset").distinct().withColumn("target_dataset", bare)
    rules = declared.withColumn("target_dataset", F.regexp_replace("target_dataset", "^(postgres|redis)\\.", "")).groupBy(
        "target_dataset", "pipeline_id", "target_column"
    ).agg(
        F.array_sort(F.collect_set(F.struct("source_dataset", "source_column"))).alias("input_fields"),
        F.max("transformation").alias("transformation"),
    )
    return named.join(rules, ["target_dataset", "pipeline_id"], "inner").drop("target_dataset").select(
        "run_id", "pipeline_id", "dataset", "target_column", "input_fields", "transformation")


def column_lineage(mappings: DataFrame, dataset: str, column: str | None = None) -> DataFrame:
    """Sources of each column of a dataset, named in full or without its namespace."""
    wanted = dataset.lower()
    name = F.lower("target_dataset")
    rows = mappings.filter((name == wanted) | name.endswith("." + wanted))
    if column is not None:
        rows = rows.filter(F.lower("target_column") == column.lower())
    newest = F.struct("at", "run_id", "transformation")
    return rows.groupBy("target_column").agg(
        F.array_sort(F.collect_set(F.struct("source_dataset", "source_column"))).alias("source_columns"),
        F.max_by("transformation", newest).alias("transformation"),
        F.max_by("pipeline_id", newest).alias("pipeline"),
        F.max_by("run_id", newest).alias("run_id"),
    )


def graph_nodes(dataset_rows: DataFrame, job_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Datasets, pipelines, and edge endpoints that neither table knows."""
    pipes = job_rows.groupBy(F.col("pipeline_id").alias("id")).agg(
        F.max("name").alias("name"), F.max("namespace").alias("namespace")
    ).withColumn("type", F.lit("pipeline"))
    data = dataset_rows.select(
        F.col("dataset_id").alias("id"), "name", "namespace", F.lit("dataset").alias("type")
    ).join(pipes.select("id"), "id", "left_anti")
    known = data.unionByName(pipes)
    ends = edge_rows.select(F.col("source_dataset").alias("id")).union(
        edge_rows.select(F.col("target_dataset").alias("id"))
    ).distinct()
    extra = ends.join(known.select("id"), "id", "left_anti").select(
        "id", F.element_at(F.split("id", "\\."), -1).alias("name"),
        F.lit("default").alias("namespace"), F.lit("dataset").alias("type"),
    )
    return known.unionByName(extra)


def closure(links: DataFrame, seeds: DataFrame, max_depth: int | None = 5) -> DataFrame:
    """Nodes reachable from each seed within ``max_depth`` hops (None: any number), with the fewest hops.

    ``links`` (src, dst) and ``seeds`` (start).  Breadth-first: each hop joins the frontier
    with the distinct links and keeps what was not seen before, so cycles end and no pair
    is expanded twice.  Every hop is written out, which keeps the plan short.
    """
    links = stage_table(links.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "links")
    frontier = seeds.select("start", F.col("start").alias("node")).distinct()
    seen = None
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(links, frontier["node"] == links["src"], "inner").select("start", F.col("dst").alias("node")).distinct()
        if seen is not None:
            step = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        frontier = stage_table(step.withColumn("hops", F.lit(depth)), "hop")
        seen = frontier if seen is None else seen.unionByName(frontier)
        if frontier.isEmpty():
            break
    return seen


def upstream(edge_rows: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    return closure(edge_rows.select(F.col("target_dataset").alias("src"), F.col("source_dataset").alias("dst")), seeds, max_depth)


def downstream(edge_rows: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    return closure(edge_rows.select(F.col("source_dataset").alias("src"), F.col("target_dataset").alias("dst")), seeds, max_depth)


def typed(reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """Closure rows with the node type, the start itself left out."""
    types = nodes.select(F.col("id").alias("node"), F.col("type").alias("node_type"))
    return reached.filter(F.col("start") != F.col("node")).join(types, "node", "left").select(
        "start", "node", F.coalesce("node_type", F.lit("dataset")).alias("node_type"), "hops"
    )


def matching_nodes(nodes: DataFrame, dataset: str) -> DataFrame:
    """Seeds for a name given in full or without namespace, in any case."""
    wanted, node = dataset.lower(), F.lower("id")
    return nodes.filter((node == wanted) | node.endswith("." + wanted)).select(F.col("id").alias("start"))


def dataset_summary(
    nodes: DataFrame, up: DataFrame, down: DataFrame, run_rows: DataFrame
) -> DataFrame:
    """Per dataset: numbers of producers, consumers and neighbours, and the latest run writing it.

    ``up`` and ``down`` are typed closures.
    """
    def counts(reached: DataFrame, data: str, pipes: str) -> DataFrame:
        return reached.groupBy(F.col("start").alias("id")).agg(
            F.count_if(F.col("node_type") == "dataset").alias(data),
            F.count_if(F.col("node_type") == "pipeline").alias(pipes),
        )

    writes = run_rows.select("run_id", F.coalesce("end_time", "start_time").alias("at"), "start_time", F.explode("outputs").alias("id"))
    latest = writes.groupBy("id").agg(F.max(F.struct("start_time", "run_id", "at")).alias("w"))
    return (
        nodes.filter(F.col("type") == "dataset").select("id", "namespace")
        .join(counts(up, "upstream_datasets", "producing_pipelines"), "id", "left")
        .join(counts(down, "downstream_datasets", "consuming_pipelines"), "id", "left")
        .join(latest, "id", "left")
        .fillna(0, ["upstream_datasets", "producing_pipelines", "downstream_datasets", "consuming_pipelines"])
        .select(
            F.col("id").alias("dataset"), "namespace", "producing_pipelines", "consuming_pipelines",
            "upstream_datasets", "downstream_datasets",
            F.col("w.run_id").alias("latest_run_id"), F.col("w.at").alias("last_updated"),
        )
    )


def trace_columns(mappings: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Transitive column lineage: (dataset.column) with all columns it feeds over any number of hops.

    ``columns`` (start) names the columns to trace; without it all are traced, which can be as
    many rows as pairs of columns.
    """
    links = mappings.select(
        F.concat_ws(".", "source_dataset", "source_column").alias("src"),
        F.concat_ws(".", "target_dataset", "target_column").alias("dst"),
    )
    return closure(links, links.select(F.col("src").alias("start")) if columns is None else columns, max_depth=None)


def counts(dataset_rows, job_rows, run_rows, edge_rows, mapping_rows) -> DataFrame:
    """Sizes of the five lineage tables."""
    parts = [
        df.agg(F.lit(name).alias("entity"), F.count(F.lit(1)).alias("n"))
        for name, df in (("datasets", dataset_rows), ("jobs", job_rows), ("runs", run_rows),
                         ("edges", edge_rows), ("column_mappings", mapping_rows))
    ]
    return reduce(DataFrame.unionByName, parts)
