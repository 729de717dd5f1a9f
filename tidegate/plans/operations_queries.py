"""Registered queries: incidents, lineage and graphs, pipeline runs, the online store, scoring."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidegate.operators import incidents, lineage, online, runs, scoring
from tidegate.operators import quality as q
from tidegate.operators.customer import velocity_features
from tidegate.plans.feature_queries import TXN, bound, inside
from tidegate.plans.quality_queries import CHECKS
from tidegate.plans.registry import query, r
from tidegate.session import scratch
from tidegate.sources import derived, stores
from tidegate.sources import tables as t

KINDS = "['" + "','".join(derived.CHECK_KINDS) + "']"
SIGNATURE = "'sig_' || substr(sha256(lower(dataset) || '|' || pipeline || '|' || lower(expectation_type || '_' || col) || '|' || expectation_type || '|' || col), 1, 16)"
SEVERITY = f"""CASE WHEN expectation_type IN ('{q.FOREIGN_KEY}', '{q.EXISTS}') THEN 'CRITICAL' WHEN expectation_type = '{q.UNIQUE}' THEN 'HIGH'
  WHEN expectation_type = '{q.NOT_NULL}' THEN 'HIGH' ELSE 'MEDIUM' END"""


# -- incidents -----------------------------------------------------------------------------

@query("failures", f"""WITH {CHECKS}
SELECT event_id, {SIGNATURE} AS failure_signature, {SEVERITY} AS incident_severity,
  CASE WHEN CAST(substr(dataset, 4) AS INTEGER) % 2 = 0 THEN 'team_' || dataset ELSE 'data-platform-team' END AS owner,
  'Data quality failure: ' || expectation_type || '_' || col || ' on ' || dataset AS title FROM checks WHERE status = 'FAIL'""")
def failures(spark, sf):
    """Failing checks with severity, owner, signature and title."""
    results = derived.check_results(spark, sf)
    owners = results.select("dataset").distinct().filter(F.substring("dataset", 4, 9).cast("int") % 2 == 0).select(
        "dataset", F.concat(F.lit("team_"), F.col("dataset")).alias("owner")
    )
    return incidents.failures(results, owners).select("event_id", "failure_signature", "incident_severity", "owner", "title")


@query("incident_per_run", f"""WITH {CHECKS}
SELECT run_id, count(DISTINCT {SIGNATURE}) AS incidents FROM checks WHERE status = 'FAIL' GROUP BY run_id""")
def incident_per_run(spark, sf):
    """Distinct failures of each quality run."""
    rows = incidents.failures(derived.check_results(spark, sf)).groupBy("run_id", "failure_signature").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("incidents"))


DEDUP = f"""sig AS (SELECT {SIGNATURE} AS s, event_id, ts, event_type FROM checks WHERE event_type IN ('error', 'signup')),
ep AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM sig),
inc AS (SELECT s AS failure_signature, CAST(epoch AS BIGINT) AS epoch, min(ts) FILTER (event_type = 'error') AS opened_at,
  arg_min(event_id, ts) FILTER (event_type = 'error') AS opened_by, count(*) FILTER (event_type = 'error') AS failure_count,
  max(ts) FILTER (event_type = 'error') AS last_failure_at, min(ts) FILTER (event_type = 'signup') AS resolved_at
  FROM ep GROUP BY s, epoch HAVING count(*) FILTER (event_type = 'error') > 0)"""


@query("incident_deduplication", f"""WITH {CHECKS}, {DEDUP}
SELECT 'inc_' || substr(failure_signature, 5, 12) || '_' || opened_by AS incident_id, *, CASE WHEN resolved_at IS NULL THEN 'OPEN' ELSE 'RESOLVED' END AS status FROM inc""")
def incident_deduplication(spark, sf):
    """One incident per signature until it is resolved, then a new one."""
    return incidents.deduplicate(derived.incident_signals(spark, sf))


LOG = """log AS (SELECT 'inc_' || (event_id // 6) AS incident_id, event_id AS id, ts,
  CASE WHEN event_id % 6 = 0 THEN 'OPEN' WHEN event_type = 'error' THEN 'ACKNOWLEDGED' WHEN event_type = 'signup' THEN 'RESOLVED' ELSE 'OPEN' END AS new_status FROM events),
ms AS (SELECT incident_id, min(ts) AS created_at, min(ts) FILTER (new_status = 'RESOLVED') AS res, min(ts) FILTER (new_status = 'ACKNOWLEDGED') AS ack0 FROM log GROUP BY incident_id),
states AS (SELECT incident_id, created_at, CASE WHEN res IS NULL OR ack0 < res THEN ack0 END AS acknowledged_at, res AS resolved_at FROM ms),
facts AS (SELECT 'inc_' || (event_id // 6) AS incident_id, 'ds_' || (k % 10) AS dataset, 'pipe_' || (k % 20) AS pipeline,
  ['CRITICAL','HIGH','MEDIUM','LOW'][CAST(user_id % 4 AS INTEGER) + 1] AS severity, 'team_' || (user_id % 3) AS owner
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_id % 6 = 0),
full_inc AS (SELECT *, CASE WHEN resolved_at IS NOT NULL THEN 'RESOLVED' WHEN acknowledged_at IS NOT NULL THEN 'ACKNOWLEDGED' ELSE 'OPEN' END AS status
  FROM states JOIN facts USING (incident_id))"""


def incident_table(spark, sf):
    states = incidents.fold(derived.incident_log(spark, sf))
    return states.join(derived.incident_facts(spark, sf), "incident_id", "inner")


@query("incident_audit_trail", f"""WITH {LOG}
SELECT l.incident_id, l.id, l.ts AS timestamp, new_status,
  CASE WHEN l.ts = created_at THEN 'CREATED' WHEN l.ts > resolved_at THEN 'REJECTED' WHEN l.ts = resolved_at THEN 'APPLIED'
    WHEN new_status = 'ACKNOWLEDGED' THEN CASE WHEN l.ts = acknowledged_at THEN 'APPLIED' ELSE 'NOOP' END
    WHEN l.ts > acknowledged_at THEN 'REJECTED' ELSE 'NOOP' END AS outcome FROM log l JOIN states USING (incident_id)""")
def incident_audit_trail(spark, sf):
    """Every status event with whether it was applied, repeated or rejected."""
    return incidents.audit_trail(derived.incident_log(spark, sf)).drop("actor")


@query("incident_states", f"WITH {LOG} SELECT incident_id, status, created_at, acknowledged_at, resolved_at, greatest(created_at, acknowledged_at, resolved_at) AS updated_at FROM full_inc")
def incident_states(spark, sf):
    return incidents.fold(derived.incident_log(spark, sf))


@query("incident_latencies", f"""WITH {LOG}
SELECT incident_id, {r("coalesce((epoch_us(acknowledged_at) - epoch_us(created_at)) / 1e6, -1)")} AS ack_seconds,
  {r("coalesce((epoch_us(resolved_at) - epoch_us(created_at)) / 1e6, -1)")} AS resolve_seconds FROM full_inc""")
def incident_latencies(spark, sf):
    rows = incidents.latencies(incidents.fold(derived.incident_log(spark, sf)))
    return rows.select("incident_id", "ack_seconds", "resolve_seconds").fillna(-1)


@query("incident_summary", f"""WITH {LOG}
SELECT count(*) AS total_incidents, count(*) FILTER (status = 'OPEN') AS open_incidents, count(*) FILTER (status = 'ACKNOWLEDGED') AS acknowledged_incidents,
  count(*) FILTER (status = 'RESOLVED') AS resolved_incidents, count(*) FILTER (severity = 'CRITICAL') AS critical_incidents, count(*) FILTER (severity = 'HIGH') AS high_incidents,
  count(*) FILTER (severity = 'MEDIUM') AS medium_incidents, count(*) FILTER (severity = 'LOW') AS low_incidents,
  arg_min(incident_id, created_at) FILTER (status = 'OPEN') AS oldest_open_incident, min(created_at) FILTER (status = 'OPEN') AS oldest_open_at,
  {r("round(avg((epoch_us(acknowledged_at) - epoch_us(created_at)) / 1e6), 2)")} AS mtta_seconds, {r("round(avg((epoch_us(resolved_at) - epoch_us(created_at)) / 1e6), 2)")} AS mttr_seconds
FROM full_inc""")
def incident_summary(spark, sf):
    return incidents.summary(incident_table(spark, sf))


@query("severity_distribution", f"WITH {LOG} SELECT severity, count(*) AS incidents FROM full_inc GROUP BY severity")
def severity_distribution(spark, sf):
    return incidents.severity_distribution(incident_table(spark, sf))


@query("list_incidents", f"""WITH {LOG}
SELECT incident_id, dataset, severity, status, created_at FROM full_inc WHERE severity = 'HIGH' AND status = 'OPEN' AND owner = 'team_1'
ORDER BY created_at DESC, incident_id DESC LIMIT 20""")
def list_incidents(spark, sf):
    rows = incidents.list_incidents(incident_table(spark, sf), severity="high", status="open", owner="team_1", limit=20)
    return rows.select("incident_id", "dataset", "severity", "status", "created_at")


@query("incident_transitions", f"""WITH {LOG}
SELECT incident_id, 'INCIDENT_ACKNOWLEDGED' AS event_type, status AS old_status, 'ACKNOWLEDGED' AS new_status FROM full_inc WHERE status = 'OPEN'
UNION ALL SELECT incident_id, 'INCIDENT_RESOLVED', status, 'RESOLVED' FROM full_inc WHERE status IN ('OPEN', 'ACKNOWLEDGED')""")
def incident_transitions(spark, sf):
    """Event rows that would acknowledge, and that would resolve, every incident that allows it."""
    table = incident_table(spark, sf)
    rows = incidents.transition(table, "ACKNOWLEDGED", F.col("updated_at"), "op").unionByName(
        incidents.transition(table, "RESOLVED", F.col("updated_at"), "op")
    )
    return rows.select("incident_id", "event_type", "old_status", "new_status")


# -- lineage ---------------------------------------------------------------------------------

LIN = """ev AS (SELECT 'run_' || (event_id // 2) AS run_id, event_id % 2 = 1 AS ends, (event_id // 2) % 40 AS j, ts, event_type, user_id FROM events),
st AS (SELECT *, CASE WHEN NOT ends THEN 'START' WHEN event_type = 'error' THEN 'FAIL' WHEN event_type = 'view' THEN 'RUNNING' ELSE 'COMPLETE' END AS state FROM ev),
raw_edges AS (
  SELECT 'ds_' || j AS src, 'pipe_' || j AS dst, 'pipe_' || j AS pipe, run_id, ts, 'INPUT_TO_PIPELINE' AS kind FROM st
  UNION ALL SELECT 'postgres.raw_' || (j % 7), 'pipe_' || j, 'pipe_' || j, run_id, ts, 'INPUT_TO_PIPELINE' FROM st
  UNION ALL SELECT 'pipe_' || j, 'ds_' || ((j * 3 + 1) % 60), 'pipe_' || j, run_id, ts, 'PIPELINE_TO_OUTPUT' FROM st WHERE ends
  UNION ALL SELECT 'ds_' || j, 'ds_' || ((j * 3 + 1) % 60), 'pipe_' || j, run_id, ts, 'DATASET_DEPENDENCY' FROM st WHERE ends
  UNION ALL SELECT 'postgres.raw_' || (j % 7), 'ds_' || ((j * 3 + 1) % 60), 'pipe_' || j, run_id, ts, 'DATASET_DEPENDENCY' FROM st WHERE ends),
edges AS (SELECT src, dst, pipe, arg_max(kind, ts) AS kind, arg_max(run_id, ts) AS run_id FROM raw_edges GROUP BY src, dst, pipe),
nodes AS (SELECT 'ds_' || j AS id, 'dataset' AS type FROM st UNION SELECT 'postgres.raw_' || (j % 7), 'dataset' FROM st
  UNION SELECT 'ds_' || ((j * 3 + 1) % 60), 'dataset' FROM st WHERE ends UNION SELECT 'pipe_' || j, 'pipeline' FROM st)"""


@query("lineage_jobs", f"WITH {LIN} SELECT DISTINCT 'job_' || j AS job_id, 'job_' || j AS name, 'default' AS namespace, 'pipe_' || j AS pipeline_id FROM st")
def lineage_jobs(spark, sf):
    return lineage.jobs(derived.lineage_events(spark, sf))


@query("lineage_datasets", f"""WITH {LIN} SELECT id AS dataset_id, CASE WHEN id LIKE 'postgres.%' THEN substr(id, 10) ELSE id END AS name,
  CASE WHEN id LIKE 'postgres.%' THEN 'postgres' ELSE 'default' END AS namespace FROM nodes WHERE type = 'dataset'""")
def lineage_datasets(spark, sf):
    return lineage.datasets(derived.lineage_events(spark, sf))


@query("lineage_runs", f"""WITH {LIN}
SELECT run_id, 'pipe_' || max(j) AS pipeline_id, arg_max(state, ts) AS status, min(ts) AS start_time, max(ts) FILTER (state IN ('COMPLETE', 'FAIL')) AS end_time,
  'ds_' || max(j) || '|postgres.raw_' || (max(j) % 7) AS inputs, CASE WHEN bool_or(ends) THEN 'ds_' || ((max(j) * 3 + 1) % 60) ELSE '' END AS outputs
FROM st GROUP BY run_id""")
def lineage_runs(spark, sf):
    """Run states folded from their events."""
    return lineage.runs(derived.lineage_events(spark, sf))


@query("lineage_run_facets", f"""WITH {LIN}
SELECT run_id, 'attempt' AS facet, CAST(arg_max(user_id, ts) AS VARCHAR) AS value FROM st GROUP BY run_id
UNION ALL SELECT run_id, CASE WHEN ends THEN 'ended_by' ELSE 'started_by' END, event_type FROM st""")
def lineage_run_facets(spark, sf):
    """Facets of each run, later values winning."""
    return lineage.run_facets(derived.lineage_events(spark, sf))


@query("lineage_edges", f"WITH {LIN} SELECT src AS source_dataset, dst AS target_dataset, pipe AS pipeline_id, kind AS edge_type, run_id FROM edges")
def lineage_edges(spark, sf):
    return lineage.edges(derived.lineage_events(spark, sf)).drop("at")


MAPPED = """map AS (SELECT 'ds_' || j AS sd, 'c_' || (x % 3) AS sc, 'ds_' || ((j * 3 + 1) % 60) AS td, 'c_' || ((j + 2) % 3) AS tc, 'pipe_' || j AS pipe,
  'rule ' || (j % 7) AS rule, arg_max(run_id, ts) AS run_id, max(ts) AS mapped_at FROM st, (VALUES (0), (1)) AS v(o), LATERAL (SELECT j + o AS x) WHERE ends GROUP BY ALL)"""


@query("lineage_column_mappings", f"""WITH {LIN}, {MAPPED}
SELECT sd AS source_dataset, sc AS source_column, td AS target_dataset, tc AS target_column, pipe AS pipeline_id, rule AS transformation, run_id FROM map""")
def lineage_column_mappings(spark, sf):
    return lineage.column_mappings(derived.lineage_events(spark, sf)).drop("at")


@query("lineage_column_lookup", f"""WITH {LIN}, {MAPPED}
SELECT tc AS target_column, '[' || string_agg(DISTINCT '{{"source_dataset":"' || sd || '","source_column":"' || sc || '"}}', ',' ORDER BY '{{"source_dataset":"' || sd || '","source_column":"' || sc || '"}}') || ']' AS source_columns,
  arg_max(rule, ROW(mapped_at, run_id, rule)) AS transformation, arg_max(pipe, ROW(mapped_at, run_id, rule)) AS pipeline, arg_max(run_id, ROW(mapped_at, run_id, rule)) AS run_id FROM map WHERE td = 'ds_4' GROUP BY tc""")
def lineage_column_lookup(spark, sf):
    """Sources of every column of one dataset, its name given in another case."""
    return lineage.column_lineage(lineage.column_mappings(derived.lineage_events(spark, sf)), "DS_4")


@query("lineage_declared_facets", f"""WITH {LIN},
decl AS (SELECT DISTINCT 'postgres.src_' || (p_partkey % 11) AS sd, 's_' || (p_partkey % 13) AS sc, 'ds_' || ((p_partkey % 40 * 3 + 1) % 60) AS td, 't_' || (p_size % 4) AS tc,
  'pipe_' || (p_partkey % 40) AS pipe, 'CAST ' || p_type AS rule FROM part)
SELECT run_id, pipe AS pipeline_id, td AS dataset, tc AS target_column, count(DISTINCT sd || '.' || sc) AS inputs, max(rule) AS transformation
FROM st JOIN decl ON 'ds_' || ((j * 3 + 1) % 60) = td AND 'pipe_' || j = pipe WHERE ends GROUP BY ALL""")
def lineage_declared_facets(spark, sf):
    """Column facets from declared mappings for the outputs of every run."""
    rows = lineage.runs(derived.lineage_events(spark, sf)).select("run_id", "pipeline_id", F.explode("outputs").alias("dataset"))
    return lineage.attach_declared(rows, derived.declared_mappings(spark, sf)).select(
        "run_id", "pipeline_id", "dataset", "target_column", F.size("input_fields").cast("bigint").alias("inputs"), "transformation"
    )


def graph(spark, sf):
    """(nodes, edges), staged once as the traversals read them repeatedly."""
    from tidegate.session import stage_table

    events = derived.lineage_events(spark, sf)
    edge_rows = stage_table(lineage.edges(events), "edges")
    return stage_table(lineage.graph_nodes(lineage.datasets(events), lineage.jobs(events), edge_rows), "nodes"), edge_rows


@query("lineage_graph_nodes", f"WITH {LIN} SELECT id, type, count(*) AS n FROM nodes GROUP BY id, type")
def lineage_graph_nodes(spark, sf):
    nodes, _ = graph(spark, sf)
    return nodes.groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))


def closure_sql(a: str, b: str, seeds: str) -> str:
    return f"""WITH RECURSIVE {LIN}, link AS (SELECT DISTINCT {a} AS a, {b} AS b FROM edges),
walk(start, node, hops) AS (SELECT id, id, 0 FROM ({seeds}) UNION SELECT start, b, hops + 1 FROM walk JOIN link ON node = a WHERE hops < 5),
near AS (SELECT start, node, CAST(min(hops) AS BIGINT) AS hops FROM walk WHERE start <> node GROUP BY start, node)
SELECT start, node, type AS node_type, hops FROM near JOIN nodes ON node = id"""


@query("lineage_upstream", closure_sql("dst", "src", "SELECT 'ds_31' AS id"))
def lineage_upstream(spark, sf):
    """Everything within five hops upstream of one dataset; the graph has cycles."""
    nodes, edge_rows = graph(spark, sf)
    return lineage.typed(lineage.upstream(edge_rows, lineage.matching_nodes(nodes, "DS_31")), nodes)


@query("lineage_downstream", closure_sql("src", "dst", "SELECT 'postgres.raw_3' AS id"))
def lineage_downstream(spark, sf):
    nodes, edge_rows = graph(spark, sf)
    return lineage.typed(lineage.downstream(edge_rows, lineage.matching_nodes(nodes, "raw_3")), nodes)


@query("lineage_closure", closure_sql("dst", "src", "SELECT id FROM nodes"))
def lineage_closure(spark, sf):
    """Upstream closure of every node at once."""
    nodes, edge_rows = graph(spark, sf)
    return lineage.typed(lineage.upstream(edge_rows, nodes.select(F.col("id").alias("start"))), nodes)


@query("lineage_dataset_summary", f"""WITH RECURSIVE {LIN}, link AS (SELECT DISTINCT src, dst FROM edges),
up(start, node, hops) AS (SELECT id, id, 0 FROM nodes UNION SELECT start, src, hops + 1 FROM up JOIN link ON node = dst WHERE hops < 5),
dn(start, node, hops) AS (SELECT id, id, 0 FROM nodes UNION SELECT start, dst, hops + 1 FROM dn JOIN link ON node = src WHERE hops < 5),
u AS (SELECT start, count(DISTINCT node) FILTER (type = 'dataset') AS d, count(DISTINCT node) FILTER (type = 'pipeline') AS p FROM up JOIN nodes ON node = id WHERE start <> node GROUP BY start),
w AS (SELECT start, count(DISTINCT node) FILTER (type = 'dataset') AS d, count(DISTINCT node) FILTER (type = 'pipeline') AS p FROM dn JOIN nodes ON node = id WHERE start <> node GROUP BY start),
rn AS (SELECT run_id, max(j) AS j, min(ts) AS s, max(ts) FILTER (state IN ('COMPLETE', 'FAIL')) AS e, bool_or(ends) AS ended FROM st GROUP BY run_id),
lr AS (SELECT 'ds_' || ((j * 3 + 1) % 60) AS id, arg_max(run_id, s) AS run_id, arg_max(coalesce(e, s), s) AS at FROM rn WHERE ended GROUP BY 1)
SELECT n.id AS dataset, CASE WHEN n.id LIKE 'postgres.%' THEN 'postgres' ELSE 'default' END AS namespace, coalesce(u.p, 0) AS producing_pipelines, coalesce(w.p, 0) AS consuming_pipelines,
  coalesce(u.d, 0) AS upstream_datasets, coalesce(w.d, 0) AS downstream_datasets, lr.run_id AS latest_run_id, lr.at AS last_updated
FROM nodes n LEFT JOIN u ON u.start = n.id LEFT JOIN w ON w.start = n.id LEFT JOIN lr ON lr.id = n.id WHERE n.type = 'dataset'""")
def lineage_dataset_summary(spark, sf):
    """Producers, consumers and latest run of every dataset."""
    nodes, edge_rows = graph(spark, sf)
    seeds = nodes.select(F.col("id").alias("start"))
    up = lineage.typed(lineage.upstream(edge_rows, seeds), nodes)
    down = lineage.typed(lineage.downstream(edge_rows, seeds), nodes)
    return lineage.dataset_summary(nodes, up, down, lineage.runs(derived.lineage_events(spark, sf)))


@query("lineage_column_trace", f"""WITH RECURSIVE {LIN}, {MAPPED}, link AS (SELECT DISTINCT sd || '.' || sc AS a, td || '.' || tc AS b FROM map),
walk(start, node, hops) AS (SELECT a, a, 0 FROM link UNION SELECT start, b, hops + 1 FROM walk JOIN link ON node = a WHERE hops < (SELECT count(*) FROM link))
SELECT start, node, CAST(min(hops) AS BIGINT) AS hops FROM walk WHERE hops > 0 GROUP BY start, node""")
def lineage_column_trace(spark, sf):
    """Every column with all columns it feeds, directly or not."""
    return lineage.trace_columns(lineage.column_mappings(derived.lineage_events(spark, sf)))


@query("lineage_counts", f"""WITH {LIN}, {MAPPED}
SELECT 'datasets' AS entity, count(*) AS n FROM nodes WHERE type = 'dataset' UNION ALL SELECT 'jobs', count(DISTINCT j) FROM st
UNION ALL SELECT 'runs', count(DISTINCT run_id) FROM st UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'column_mappings', count(*) FROM map""")
def lineage_counts(spark, sf):
    e = derived.lineage_events(spark, sf)
    return lineage.counts(lineage.datasets(e), lineage.jobs(e), lineage.runs(e), lineage.edges(e), lineage.column_mappings(e))


@query("incidents_with_lineage", f"""WITH RECURSIVE {LIN}, {LOG}, link AS (SELECT DISTINCT dst AS a, src AS b FROM edges),
walk(start, node, hops) AS (SELECT id, id, 0 FROM nodes UNION SELECT start, b, hops + 1 FROM walk JOIN link ON node = a WHERE hops < 5),
near AS (SELECT DISTINCT start, node, type FROM walk JOIN nodes ON node = id WHERE start <> node),
ctx AS (SELECT start, coalesce(string_agg(node, '|' ORDER BY node) FILTER (type = 'dataset'), '') AS d, coalesce(string_agg(node, '|' ORDER BY node) FILTER (type = 'pipeline'), '') AS p FROM near GROUP BY start)
SELECT incident_id, dataset, coalesce(d, '') AS upstream_datasets, coalesce(p, '') AS upstream_pipelines FROM full_inc LEFT JOIN ctx ON dataset = start""")
def incidents_with_lineage(spark, sf):
    """Incidents with what lies upstream of the failing dataset."""
    nodes, edge_rows = graph(spark, sf)
    reached = lineage.typed(lineage.upstream(edge_rows, nodes.select(F.col("id").alias("start"))), nodes)
    rows = incidents.with_lineage(incident_table(spark, sf), reached)
    return rows.select("incident_id", "dataset", "upstream_datasets", "upstream_pipelines")


# -- pipeline runs -------------------------------------------------------------------------------

RUNS = """prun AS (SELECT 'prun_' || event_id AS run_id, 'pipe_' || (k % 20) AS pipeline_id,
  CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'RUNNING' ELSE 'SUCCESS' END AS status, ts AS start_time, value * 10 AS duration_ms,
  ['compute','contract','schema','quality','publish'][CAST(user_id % 5 AS INTEGER) + 1] AS stage, 'run_' || (event_id // 20) || '_' || (k % 10) AS quality_run_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
latest AS (SELECT * FROM prun QUALIFY row_number() OVER (PARTITION BY pipeline_id ORDER BY start_time DESC, run_id DESC) = 1),
pipes AS (SELECT 'pipe_' || s_suppkey AS pipeline_id, CASE WHEN s_nationkey % 5 = 0 THEN 'PAUSED' ELSE 'ACTIVE' END AS status, 'team_' || (s_nationkey % 4) AS owner,
  CAST(60 * (1 + s_suppkey % 48) AS BIGINT) AS sla, start_time AS last_run_at FROM supplier LEFT JOIN latest ON pipeline_id = 'pipe_' || s_suppkey)"""


@query("latest_pipeline_runs", f"WITH {RUNS} SELECT pipeline_id, run_id, status, start_time FROM latest")
def latest_pipeline_runs(spark, sf):
    return runs.latest_run(derived.pipeline_runs(spark, sf)).select("pipeline_id", "run_id", "status", "start_time")


@query("list_pipelines", f"WITH {RUNS} SELECT pipeline_id, status, owner, sla AS freshness_sla_minutes, 'Pipe ' || substr(pipeline_id, 6) AS display_name FROM pipes WHERE status = 'ACTIVE' AND owner = 'team_2'")
def list_pipelines(spark, sf):
    return runs.list_pipelines(derived.pipelines(spark, sf), "ACTIVE", "team_2").drop("last_run_at")


@query("list_pipeline_runs", f"WITH {RUNS} SELECT run_id, status, start_time FROM prun WHERE pipeline_id = 'pipe_7' ORDER BY start_time DESC, run_id DESC LIMIT 30")
def list_pipeline_runs(spark, sf):
    return runs.list_runs(derived.pipeline_runs(spark, sf), "pipe_7", 30).select("run_id", "status", "start_time")


@query("pipeline_summary", f"""WITH {RUNS}
SELECT (SELECT count(*) FROM pipes) AS total_pipelines, (SELECT count(*) FROM pipes WHERE status = 'ACTIVE') AS active_pipelines,
  (SELECT count(*) FROM pipes, (SELECT max(ts) AS t FROM events) WHERE epoch_us(last_run_at) < epoch_us(t) - sla * 60000000) AS stale_pipelines,
  count(*) AS total_runs, count(*) FILTER (status = 'FAILED') AS failed_runs, {r("round(100.0 * count(*) FILTER (status = 'SUCCESS') / count(*) + 1e-9, 2)")} AS success_rate,
  (SELECT count(*) FROM latest WHERE status = 'SUCCESS') AS successful_pipelines, (SELECT count(*) FROM latest WHERE status = 'FAILED') AS failed_pipelines,
  (SELECT count(*) FROM latest WHERE status = 'RUNNING') AS running_pipelines FROM prun""")
def pipeline_summary(spark, sf):
    now = t.latest_event_time(spark, sf)
    return runs.pipeline_summary(derived.pipelines(spark, sf), derived.pipeline_runs(spark, sf), now)


@query("pipeline_health", f"""WITH {RUNS}, {CHECKS}, {LOG},
oi AS (SELECT pipeline, count(*) AS n FROM full_inc WHERE status <> 'RESOLVED' GROUP BY pipeline),
h AS (SELECT p.pipeline_id, p.status, l.run_id AS last_run_id, l.status AS last_status, coalesce(n, 0) AS active_incidents, q.quality_score,
  coalesce(q.freshness_status, CASE WHEN (epoch_us((SELECT max(ts) FROM events)) - epoch_us(last_run_at)) / 60e6 > sla THEN 'STALE' ELSE 'FRESH' END) AS freshness_status
  FROM pipes p LEFT JOIN latest l USING (pipeline_id) LEFT JOIN qruns q ON l.quality_run_id = q.run_id LEFT JOIN oi ON oi.pipeline = p.pipeline_id)
SELECT pipeline_id, status, (last_status IS NULL OR last_status = 'SUCCESS') AND active_incidents = 0 AND freshness_status <> 'STALE' AS is_healthy,
  freshness_status, last_run_id, last_status, {r("quality_score")} AS quality_score, active_incidents FROM h""")
def pipeline_health(spark, sf):
    """Health of every pipeline in one job."""
    return runs.pipeline_health(
        derived.pipelines(spark, sf), derived.pipeline_runs(spark, sf), derived.quality_runs(spark, sf),
        incident_table(spark, sf), t.latest_event_time(spark, sf),
    )


@query("duration_stats", f"""WITH {RUNS}
SELECT pipeline_id, stage, count(*) AS n, {r("quantile_cont(duration_ms, 0.50)")} AS p50_ms, {r("quantile_cont(duration_ms, 0.95)")} AS p95_ms,
  {r("quantile_cont(duration_ms, 0.99)")} AS p99_ms, {r("avg(duration_ms)")} AS mean_ms, {r("stddev_pop(duration_ms)")} AS std_ms, {r("min(duration_ms)")} AS min_ms,
  {r("max(duration_ms)")} AS max_ms, {r("count(*) / (sum(duration_ms) / 1000.0)")} AS throughput_per_sec FROM prun GROUP BY pipeline_id, stage""")
def duration_stats(spark, sf):
    """Exact latency quantiles per pipeline and stage."""
    return runs.duration_stats(derived.pipeline_runs(spark, sf), ["pipeline_id", "stage"])


@query("stage_breakdown", f"""WITH {RUNS}, m AS (SELECT stage, count(*) AS runs, avg(duration_ms) AS a FROM prun GROUP BY stage)
SELECT stage, runs, {r("a")} AS mean_ms, {r("100 * a / sum(a) OVER ()")} AS share_percent FROM m""")
def stage_breakdown(spark, sf):
    return runs.stage_breakdown(derived.pipeline_runs(spark, sf))


@query("quality_trend", f"""WITH {CHECKS},
d AS (SELECT dataset, CAST(ts AS DATE) AS day, count(*) AS runs, 100.0 * sum(passed_checks) / sum(total_checks) AS rate FROM qruns GROUP BY ALL)
SELECT dataset, day, runs, {r("rate")} AS pass_rate, {r("avg(rate) OVER (PARTITION BY dataset ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")} AS pass_rate_7d FROM d""")
def quality_trend(spark, sf):
    return runs.quality_trend(derived.quality_runs(spark, sf))


# -- online store and scoring ---------------------------------------------------------------------

SERVED = ["cust_txn_count_24h", "cust_failed_txn_count_24h", "cust_txn_amount_sum_7d", "burst_txn_count_10min"]
FEAT = f"""feat AS (SELECT customer_id, count(*) FILTER ({inside("24h")}) AS n24, count(*) FILTER ({inside("24h")} AND status = 'FAILED') AS f24,
  coalesce(sum(amount) FILTER ({inside("7d")}), 0) AS a7, count(*) FILTER (ts >= t - INTERVAL 10 MINUTE) AS b10 FROM txn, now_at WHERE {inside("30d")} GROUP BY customer_id)"""


def served(txn, at):
    """The published features of every customer at one time."""
    burst = txn.filter(F.col("ts").between(F.lit(at - dt.timedelta(minutes=10)).cast("timestamp"), F.lit(at).cast("timestamp")))
    counts = burst.groupBy("customer_id").agg(F.count(F.lit(1)).alias("burst_txn_count_10min"))
    return velocity_features(txn, at).join(counts, "customer_id", "left").fillna(0, ["burst_txn_count_10min"]).withColumn(
        "feature_timestamp", F.lit(at).cast("timestamp"))


def online_table(spark, sf):
    """Two generations of customer vectors, the newer one a day later, upserted."""
    now, txn = bound(spark, sf)
    before = now - dt.timedelta(days=1)
    fresh = served(txn, now)
    old = served(t.bind_transactions(spark, sf, before - dt.timedelta(days=30), before), before)
    rows = [online.to_online(x, "customer", "customer_id", F.lit(now), columns=SERVED) for x in (old, fresh)]
    return online.upsert(rows[0], rows[1])


@query("online_vectors", f"""WITH {TXN}, {FEAT}
SELECT 'features:customer:' || customer_id AS store_key, CAST(customer_id AS VARCHAR) AS entity_id, (SELECT t FROM now_at) AS feature_timestamp, {r("n24")} AS cust_txn_count_24h,
  {r("f24")} AS cust_failed_txn_count_24h, {r("a7")} AS cust_txn_amount_sum_7d, {r("b10")} AS burst_txn_count_10min FROM feat""")
def online_vectors(spark, sf):
    """Newest vector per entity after two materializations."""
    return online_table(spark, sf).select(
        "store_key", "entity_id", "feature_timestamp", *[F.col("features")[f].alias(f) for f in SERVED]
    )


@query("online_lookup", f"""WITH {TXN}, {FEAT}
SELECT CAST(c_custkey AS VARCHAR) AS entity_id, {r("coalesce(a7, -1)")} AS cust_txn_amount_sum_7d,
  {r("CASE WHEN customer_id IS NULL THEN -1 ELSE 90 END")} AS freshness_minutes FROM customer LEFT JOIN feat ON c_custkey = customer_id""")
def online_lookup(spark, sf):
    """Batch lookup of all customers; unknown ones give nulls (-1 here)."""
    requests = t.table(spark, sf, "customer").select(
        F.lit("customer").alias("entity_name"), F.col("c_custkey").cast("string").alias("entity_id")
    )
    later = t.latest_event_time(spark, sf) + dt.timedelta(minutes=90)
    rows = online.lookup(online_table(spark, sf), requests, later)
    return rows.select(
        "entity_id", F.coalesce(F.col("features")["cust_txn_amount_sum_7d"], F.lit(-1.0)).alias("cust_txn_amount_sum_7d"),
        F.coalesce("freshness_minutes", F.lit(-1.0)).alias("freshness_minutes"),
    )


@query("online_lookup_compacted", f"""WITH {TXN},
days AS (SELECT t - d * INTERVAL 1 DAY AS snap FROM now_at, (SELECT unnest(range(6)) AS d)),
newest AS (SELECT customer_id, max(snap) AS snap FROM days, txn WHERE ts <= snap AND ts >= snap - INTERVAL 30 DAY GROUP BY customer_id),
v AS (SELECT n.customer_id, n.snap, sum(amount) FILTER (ts >= n.snap - INTERVAL 7 DAY) AS a7 FROM newest n JOIN txn x ON x.customer_id = n.customer_id AND x.ts <= n.snap GROUP BY 1, 2)
SELECT CAST(c_custkey AS VARCHAR) AS entity_id, snap AS feature_timestamp, {r("CASE WHEN snap IS NULL THEN -1 ELSE coalesce(a7, 0) END")} AS cust_txn_amount_sum_7d
FROM customer LEFT JOIN v ON c_custkey = customer_id""")
def online_lookup_compacted(spark, sf):
    """Lookup of all customers after six daily publications, folded after the third and the fifth; the last one is a change still."""
    now, root = t.latest_event_time(spark, sf), scratch(spark, "store")
    for day in range(5, -1, -1):
        at = now - dt.timedelta(days=day)
        rows = served(t.bind_transactions(spark, sf, at - dt.timedelta(days=30), at), at)
        stores.write_changes(online.to_online(rows, "customer", "customer_id", F.lit(at), columns=SERVED), f"{root}/online", f"day_{day}")
        stores.mark_published(spark, root, f"day_{day}", at)
        if day in (3, 1):
            stores.compact_online(spark, root, buckets=32)
    requests = t.table(spark, sf, "customer").select(
        F.lit("customer").alias("entity_name"), F.col("c_custkey").cast("string").alias("entity_id")
    )
    return online.lookup(stores.read_online(spark, root), requests, now).select(
        "entity_id", "feature_timestamp", F.coalesce(F.col("features")["cust_txn_amount_sum_7d"], F.lit(-1.0)).alias("cust_txn_amount_sum_7d"))


SCORED = f"""{FEAT},
s AS (SELECT x.transaction_id, x.customer_id, x.ts, least(0.99, greatest(0.02, least(0.5, x.amount / 2000.0 * 0.3) + coalesce(b10, 0) * 0.25 + coalesce(f24, 0) * 0.20)) AS raw
  FROM txn x LEFT JOIN feat USING (customer_id))"""


def scored(spark, sf):
    txn = t.bind_transactions(spark, sf).select("transaction_id", "customer_id", "amount", "ts")
    rows = online.assemble(txn, online_table(spark, sf), "customer", "customer_id")
    return scoring.score(rows)


@query("rule_scores", f"""WITH {TXN}, {SCORED}
SELECT transaction_id, {r("round(raw + 1e-12, 4)")} AS risk_score, CAST(raw >= 0.5 AS BIGINT) AS prediction FROM s""")
def rule_scores(spark, sf):
    """Every transaction scored with the online vector of its customer."""
    return scored(spark, sf).select("transaction_id", "risk_score", "prediction")


@query("prediction_log", f"""WITH {TXN}, {SCORED}
SELECT 'pred_' || transaction_id AS prediction_id, CAST(customer_id AS VARCHAR) AS customer_id, {r("round(raw + 1e-12, 4)")} AS risk_score,
  CAST(raw >= 0.5 AS BIGINT) AS prediction, 'rules-v1' AS model_version, ts AS created_at FROM s""")
def prediction_log(spark, sf):
    return scoring.prediction_log(scored(spark, sf), "transaction_id", F.col("ts"))
