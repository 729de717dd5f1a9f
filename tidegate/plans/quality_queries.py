"""Registered queries: quality checks, freshness, foreign keys, audits, runs of checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidegate.operators import freshness, referential
from tidegate.operators import quality as q
from tidegate.operators.catalog import catalog
from tidegate.plans import table_contracts as c
from tidegate.plans.feature_queries import TXN, bound, inside
from tidegate.plans.registry import query, r
from tidegate.sources import derived, records
from tidegate.sources import tables as t
from tidegate.sources.introspect import introspect

REF = dt.datetime(2001, 8, 2, 12, 0)
REF_SQL = "TIMESTAMP '2001-08-02 12:00:00'"


# -- suites ----------------------------------------------------------------------------

def suite_sql(contract: dict, source: str, existing: set[str], with_: str = "") -> str:
    """Reference SQL of a suite, one branch per check."""
    name = contract["dataset"]
    floor = contract["constraints"]["min_rows"]
    rows = []

    def branch(kind, column, bad, base, expected):
        check = f"{kind}_{column}" if column else kind
        text = (f"CASE WHEN bad = 0 THEN 'Compliant (0 unexpected)' ELSE bad || ' unexpected records (' || "
                f"printf('%.2f', 100.0 * bad / base) || '%)' END")
        exp = expected.replace("'", "''")
        col = f"'{column}'" if column else "''"
        rows.append(f"""SELECT '{check}' AS check_name, {col} AS "column", CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status,
 {text} AS observed_value, '{exp}' AS expected_value, CAST(bad AS BIGINT) AS unexpected, CAST(base AS BIGINT) AS base
 FROM (SELECT {bad} AS bad, {base} AS base FROM {source})""")

    def gone(kind, column, expected):
        exp = expected.replace("'", "''")
        rows.append(f"""SELECT '{kind}_{column}', '{column}', 'FAIL', 'column "{column}" is missing', '{exp}', CAST(-1 AS BIGINT), CAST(-1 AS BIGINT)""")

    branch(q.ROW_COUNT, None, f"CASE WHEN count(*) >= {floor} THEN 0 ELSE 1 END", "count(*)", f"between {floor} and None")
    for col in contract["columns"]:
        n = col["name"]
        there = n in existing
        specs = [(q.EXISTS, "0", "count(*)", "Invariant satisfied")]
        if not col["nullable"]:
            specs.append((q.NOT_NULL, f"count(*) FILTER ({n} IS NULL)", "count(*)", "Invariant satisfied"))
        if col["unique"]:
            specs.append((q.UNIQUE, None, None, "Invariant satisfied"))
        if "allowed_values" in col:
            values = ", ".join(f"'{v}'" for v in col["allowed_values"])
            specs.append((q.IN_SET, f"count(*) FILTER (CAST({n} AS VARCHAR) NOT IN ({values}))", f"count({n})", f"in {col['allowed_values']}"))
        if "min" in col or "max" in col:
            low = None if col.get("min") is None else float(col["min"])
            high = None if col.get("max") is None else float(col["max"])
            tests = [x for x in (low is not None and f"{n} < {low}", high is not None and f"{n} > {high}") if x]
            specs.append((q.BETWEEN, f"count(*) FILTER ({' OR '.join(tests)})", f"count({n})", f"between {low} and {high}"))
        for kind, bad, base, expected in specs:
            if not there:
                gone(kind, n, expected)
            elif kind == q.UNIQUE:
                rows.append(f"""SELECT '{kind}_{n}', '{n}', CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END,
 CASE WHEN bad = 0 THEN 'Compliant (0 unexpected)' ELSE bad || ' unexpected records (' || printf('%.2f', 100.0 * bad / base) || '%)' END,
 'Invariant satisfied', CAST(bad AS BIGINT), CAST(base AS BIGINT)
 FROM (SELECT coalesce(sum(k) FILTER (k > 1), 0) AS bad, coalesce(sum(k), 0) AS base FROM (SELECT {n}, count(*) AS k FROM {source} WHERE {n} IS NOT NULL GROUP BY {n}))""")
            else:
                branch(kind, n, bad, base, expected)
    return with_ + "\nUNION ALL ".join(rows)


def suite(df, contract):
    return q.run_suite(df, contract).select(
        "check_name", F.coalesce("column", F.lit("")).alias("column"), "status", "observed_value", "expected_value",
        F.coalesce("unexpected", F.lit(-1)).alias("unexpected"), F.coalesce("base", F.lit(-1)).alias("base"),
    )


SUITES = {
    "orders": (c.ORDERS, {"o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"}),
    "lineitem": (c.LINEITEM, {"l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"}),
    "customer": (c.CUSTOMER, {"c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"}),
    "events": (c.EVENTS, {"event_id", "ts", "user_id", "event_type", "value", "props"}),
}


def _register_suite(name: str) -> None:
    contract, columns = SUITES[name]

    @query(f"quality_suite_{name}", suite_sql(contract, name, columns))
    def run(spark, sf):
        return suite(t.table(spark, sf, name), contract)

    run.__doc__ = f"The compiled contract of {name}."


for _name in SUITES:
    _register_suite(_name)


@query("quality_run", f"""
WITH k AS ({suite_sql(c.ORDERS, "orders", SUITES["orders"][1])}),
f AS (SELECT CASE WHEN d <= 1440 THEN 'PASS' WHEN d <= 2880 THEN 'WARNING' ELSE 'FAIL' END AS status
  FROM (SELECT greatest(0, date_diff('minute', max(o_orderdate), {REF_SQL})) AS d FROM orders)),
o AS (SELECT CASE WHEN count(*) FILTER (c_custkey IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_custkey IS NOT NULL),
a AS (SELECT status FROM k UNION ALL SELECT status FROM f UNION ALL SELECT status FROM o)
SELECT 'run_1' AS run_id, 'orders' AS dataset, count(*) AS total_checks, count(*) FILTER (status = 'PASS') AS passed_checks,
  count(*) FILTER (status = 'FAIL') AS failed_checks, count(*) FILTER (status = 'WARNING') AS warning_checks,
  {r("round(100.0 * count(*) FILTER (status = 'PASS') / count(*), 2)")} AS quality_score,
  CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (status = 'WARNING') > 0 THEN 'WARNING' ELSE 'PASS' END AS overall_status
FROM a""")
def quality_run(spark, sf):
    """Suite, freshness and foreign key of orders rolled up to one run."""
    _, runs = q.run_validation(
        t.table(spark, sf, "orders"), c.ORDERS, "run_1", REF,
        parents={"customer": t.table(spark, sf, "customer")}, relationships=c.FOREIGN_KEYS["orders"],
    )
    return runs.drop("pipeline", "timestamp", "contract_version")


@query("quarantine_events", """
WITH v AS (SELECT event_id, concat_ws('|',
    CASE WHEN event_type NOT IN ('click', 'purchase', 'signup', 'view') THEN 'expect_column_values_to_be_in_set_event_type' END,
    CASE WHEN value < 0.5 OR value > 300 THEN 'expect_column_values_to_be_between_value' END) AS violations FROM events)
SELECT * FROM v WHERE violations <> ''""")
def quarantine_events(spark, sf):
    """Rows that break their contract, with the checks they break."""
    _, bad = q.split_quarantine(t.table(spark, sf, "events"), c.EVENTS)
    return bad.select("event_id", "violations")


@query("quarantine_duplicates", """
WITH d AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)
SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('|',
  CASE WHEN l_quantity < 1 OR l_quantity > 45 THEN 'expect_column_values_to_be_between_l_quantity' END,
  CASE WHEN l_discount < 0 OR l_discount > 0.1 THEN 'expect_column_values_to_be_between_l_discount' END,
  CASE WHEN l_orderkey IN (SELECT l_orderkey FROM d) THEN 'expect_column_values_to_be_unique_l_orderkey' END) AS violations
FROM lineitem""")
def quarantine_duplicates(spark, sf):
    """Every line item with its violations, members of duplicate groups included."""
    marked = q.quarantine(t.table(spark, sf, "lineitem"), c.LINEITEM)
    return marked.select("l_orderkey", F.col("l_linenumber").cast("int"), "l_partkey", "violations")


# -- foreign keys and freshness -----------------------------------------------------------

def fk_sql() -> str:
    rows = []
    for child, specs in c.FOREIGN_KEYS.items():
        for column, parent, key in specs:
            rows.append(f"""SELECT 'foreign_key_{child}_{column}_in_{parent}_{key}' AS check_name, total AS base, orphans AS unexpected,
 CASE WHEN orphans = 0 THEN 'PASS' ELSE 'FAIL' END AS status, coalesce(sample, '') AS sample
 FROM (SELECT count(*) AS total, count(*) FILTER (p IS NULL) AS orphans,
   array_to_string(list_slice(list_sort(list(DISTINCT CAST(k AS VARCHAR)) FILTER (p IS NULL)), 1, 5), ',') AS sample
   FROM (SELECT x.{column} AS k, y.{key} AS p FROM {child} x LEFT JOIN {parent} y ON x.{column} = y.{key} WHERE x.{column} IS NOT NULL))""")
    return "\nUNION ALL ".join(rows)


@query("referential_checks", fk_sql())
def referential_checks(spark, sf):
    """All relationships of the supplied tables."""
    names = set(c.FOREIGN_KEYS) | {p for specs in c.FOREIGN_KEYS.values() for _, p, _ in specs}
    tables = {n: t.table(spark, sf, n) for n in names}
    rows = referential.all_referential_checks(tables, c.FOREIGN_KEYS)
    sample = F.from_json(F.get_json_object("details", "$.sample_orphan_keys"), "array<string>")
    return rows.select(
        "check_name", "base", "unexpected", "status", F.coalesce(F.array_join(sample, ","), F.lit("")).alias("sample")
    )


# monitored name -> (table, time column, SLA in minutes)
FRESH = {
    "orders_monthly": ("orders", "o_orderdate", 43200), "orders_daily": ("orders", "o_orderdate", 1440),
    "orders_hourly": ("orders", "o_orderdate", 60), "lineitem": ("lineitem", "l_shipdate", 1000), "events": ("events", "ts", 60),
}


def freshness_sql() -> str:
    rows = []
    for name, (source, column, sla) in FRESH.items():
        rows.append(f"""SELECT '{name}' AS dataset, '{column}' AS column_used, CAST({sla} AS BIGINT) AS sla_minutes, m AS last_record_timestamp,
 {r("round(d, 2)")} AS delay_minutes, CASE WHEN d <= {sla} THEN 'FRESH' WHEN d <= {2 * sla} THEN 'WARNING' ELSE 'STALE' END AS freshness_status
 FROM (SELECT max({column}) AS m, greatest(0.0, (epoch_us({REF_SQL}) - epoch_us(max({column}))) / 60e6) AS d FROM {source})""")
    return "\nUNION ALL ".join(rows)


def report(spark, sf):
    return freshness.freshness_report(
        {n: (t.table(spark, sf, source), column, sla) for n, (source, column, sla) in FRESH.items()}, REF
    )


@query("freshness_report", freshness_sql())
def freshness_report(spark, sf):
    return report(spark, sf)


@query("freshness_breaches", f"""SELECT dataset, 'freshness_sla_' || dataset AS check_name,
CASE WHEN freshness_status = 'WARNING' THEN 'WARNING' ELSE 'FAIL' END AS status,
CASE freshness_status WHEN 'STALE' THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity FROM ({freshness_sql()}) WHERE freshness_status <> 'FRESH'""")
def freshness_breaches(spark, sf):
    """Late datasets as failing checks, with the severity of the incident they open."""
    from tidegate.operators.incidents import severity

    return freshness.freshness_breaches(report(spark, sf)).select("dataset", "check_name", "status", severity().alias("severity"))


@query("online_feature_freshness", f"""WITH {TXN},
last AS (SELECT customer_id, max(ts) AS ts FROM txn GROUP BY customer_id),
s AS (SELECT * FROM (VALUES ('cust_txn_count_1h', 15), ('cust_txn_count_24h', 60), ('cust_txn_count_7d', 360)) AS v(name, sla))
SELECT 'customer' AS entity_name, name, CAST(sla AS BIGINT) AS freshness_sla_minutes, count(*) AS entities,
  count(*) FILTER ((epoch_us(t) - epoch_us(ts)) / 60e6 > sla) AS breaches
FROM last, s, now_at GROUP BY name, sla""")
def online_feature_freshness(spark, sf):
    """Online features older than the SLA of their definition, per feature."""
    now = t.latest_event_time(spark, sf)
    current = t.bind_transactions(spark, sf).groupBy("customer_id").agg(F.max("ts").alias("feature_timestamp")).select(
        F.lit("customer").alias("entity_name"), "feature_timestamp",
        F.expr("map('cust_txn_count_1h', 1d, 'cust_txn_count_24h', 2d, 'cust_txn_count_7d', 3d)").alias("features"),
    )
    return freshness.online_feature_freshness(current, catalog(spark), now)


# -- audits -----------------------------------------------------------------------------------

@query("null_rate_audit", f"""WITH {TXN}, g AS (SELECT customer_id, CASE WHEN count(*) FILTER ({inside("24h")}) > 0 THEN avg(amount) FILTER ({inside("24h")}) END AS a,
  avg(amount) FILTER ({inside("7d")}) AS b FROM txn, now_at WHERE {inside("30d")} GROUP BY customer_id)
SELECT 'avg_24h' AS "column", {r("avg(CAST(a IS NULL AS INTEGER))")} AS null_rate, avg(CAST(a IS NULL AS INTEGER)) > 0.05 AS violation FROM g
UNION ALL SELECT 'avg_7d', {r("avg(CAST(b IS NULL AS INTEGER))")}, avg(CAST(b IS NULL AS INTEGER)) > 0.05 FROM g
UNION ALL SELECT 'customer_id', {r("avg(CAST(customer_id IS NULL AS INTEGER))")}, false FROM g""")
def null_rate_audit(spark, sf):
    """Share of missing values per column of a raw feature frame."""
    from tidegate.operators.customer import velocity

    now, txn = bound(spark, sf)
    return q.null_rate_audit(velocity(txn, "customer_id", now).select("customer_id", "avg_24h", "avg_7d"))


@query("row_count_audit", "SELECT count(DISTINCT user_id) AS row_count, CAST(10 AS BIGINT) AS minimum, count(DISTINCT user_id) >= 10 AS passed FROM events")
def row_count_audit(spark, sf):
    return q.row_count_audit(t.bind_transactions(spark, sf).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")))


@query("introspect_orders", "\nUNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{n}' AS name, '{p}' AS physical_type, '{k}' AS contract_type, "
    f"count(*) FILTER ({n} IS NULL) AS null_count, count(*) FILTER ({n} IS NULL) > 0 AS observed_nullable FROM orders"
    for i, (n, p, k) in enumerate([
        ("o_orderkey", "bigint", "bigint"), ("o_custkey", "bigint", "bigint"), ("o_orderstatus", "string", "string"),
        ("o_totalprice", "double", "float"), ("o_orderdate", "timestamp_ntz", "timestamp"), ("o_orderpriority", "string", "string"),
    ])))
def introspect_orders(spark, sf):
    """Physical types, contract types and observed nulls of a table."""
    return introspect(t.table(spark, sf, "orders"))


# -- stored check results ---------------------------------------------------------------------

CHECKS = f"""checks AS (
  SELECT event_id, 'run_' || (event_id // 20) || '_' || (k % 10) AS run_id, 'ds_' || (k % 10) AS dataset,
    ['{"','".join(derived.CHECK_KINDS)}'][CAST(user_id % 7 AS INTEGER) + 1] AS expectation_type, 'col_' || (user_id % 5) AS col,
    CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'view' THEN 'WARNING' ELSE 'PASS' END AS status, event_type,
    'pipe_' || (k % 4) AS pipeline, ts, value, user_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
qruns AS (
  SELECT run_id, dataset, count(*) AS total_checks, count(*) FILTER (status = 'PASS') AS passed_checks, count(*) FILTER (status = 'FAIL') AS failed_checks,
    count(*) FILTER (status = 'WARNING') AS warning_checks, round(100.0 * count(*) FILTER (status = 'PASS') / count(*) + 1e-9, 2) AS quality_score,
    CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (status = 'WARNING') > 0 THEN 'WARNING' ELSE 'PASS' END AS overall_status,
    max(ts) AS ts, arg_max(CASE event_type WHEN 'error' THEN 'STALE' WHEN 'view' THEN 'WARNING' ELSE 'FRESH' END, ts) AS freshness_status, max(pipeline) AS pipeline
  FROM checks GROUP BY run_id, dataset)"""


@query("quality_scores", f"""WITH {CHECKS}
SELECT run_id, total_checks, passed_checks, failed_checks, warning_checks, {r("quality_score")} AS quality_score, overall_status FROM qruns""")
def quality_scores(spark, sf):
    """Check rows rolled up to runs."""
    return q.score_runs(derived.check_results(spark, sf))


@query("quality_summary", f"""WITH {CHECKS},
last AS (SELECT * FROM qruns QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY ts DESC, run_id DESC) = 1)
SELECT count(*) AS datasets_checked, count(*) FILTER (overall_status = 'PASS') AS datasets_passing, count(*) FILTER (overall_status <> 'PASS') AS datasets_failing,
  {r("round(avg(quality_score) + 1e-9, 2)")} AS average_quality_score, count(*) FILTER (freshness_status IN ('WARNING', 'STALE')) AS freshness_violations,
  (SELECT CAST(sum(total_checks) AS BIGINT) FROM qruns) AS total_checks, (SELECT CAST(sum(passed_checks) AS BIGINT) FROM qruns) AS passed_checks,
  (SELECT CAST(sum(failed_checks) AS BIGINT) FROM qruns) AS failed_checks FROM last""")
def quality_summary(spark, sf):
    return q.quality_summary(derived.quality_runs(spark, sf))


@query("latest_quality_runs", f"""WITH {CHECKS}
SELECT dataset, run_id, overall_status, {r("quality_score")} AS quality_score, ts AS timestamp FROM qruns
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY ts DESC, run_id DESC) = 1""")
def latest_quality_runs(spark, sf):
    return q.latest_runs(derived.quality_runs(spark, sf)).select("dataset", "run_id", "overall_status", "quality_score", "timestamp")


@query("quality_run_history", f"""WITH {CHECKS}
SELECT run_id, overall_status, ts AS timestamp FROM qruns WHERE dataset = 'ds_3' ORDER BY ts DESC, run_id DESC LIMIT 25""")
def quality_run_history(spark, sf):
    return q.run_history(derived.quality_runs(spark, sf), "ds_3", 25).select("run_id", "overall_status", "timestamp")


@query("list_check_results", f"""WITH {CHECKS}
SELECT run_id, expectation_type || '_' || col AS check_name, status, ts AS timestamp FROM checks
WHERE dataset = 'ds_2' AND status = 'FAIL' AND pipeline = 'pipe_0' ORDER BY ts DESC, run_id DESC, check_name LIMIT 50""")
def list_check_results(spark, sf):
    """Newest failing results of a dataset and pipeline."""
    rows = q.list_results(derived.check_results(spark, sf), "ds_2", "FAIL", "pipe_0", 50)
    return rows.select("run_id", "check_name", "status", "timestamp")


@query("datasets_with_runs", f"WITH {CHECKS} SELECT DISTINCT dataset FROM qruns")
def datasets_with_runs(spark, sf):
    return derived.quality_runs(spark, sf).select("dataset").distinct()


@query("record_intake", """
WITH x AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 1 WHEN event_id % 89 = 0 THEN 2 WHEN event_id % 83 = 0 THEN 3 WHEN event_id % 79 = 0 THEN 4 ELSE 0 END AS planted,
  event_type NOT IN ('click', 'view', 'purchase', 'signup') AS odd FROM events),
o AS (SELECT CASE planted WHEN 1 THEN 'malformed_record' ELSE concat_ws('|', CASE WHEN planted = 2 THEN 'type:value' END,
    CASE WHEN planted = 4 THEN 'expect_column_values_to_not_be_null_user_id' END, CASE WHEN odd THEN 'expect_column_values_to_be_in_set_event_type' END) END AS violations,
  CASE planted WHEN 1 THEN '_record' WHEN 2 THEN 'value' WHEN 3 THEN 'note' ELSE '' END AS rescued, planted = 1 AS broken FROM x)
SELECT violations, rescued, count(*) AS records, count(*) FILTER (NOT broken) AS with_id FROM o GROUP BY ALL""")
def record_intake(spark, sf):
    """Events as JSON texts, some cut short, of a wrong type, with a field too many or without a user, against a contract."""
    contract = {"dataset": "records", "columns": [
        {"name": "event_id", "type": "integer", "nullable": False}, {"name": "user_id", "type": "integer", "nullable": False},
        {"name": "event_type", "type": "string", "nullable": True, "allowed_values": ["click", "view", "purchase", "signup"]},
        {"name": "value", "type": "float", "nullable": True}, {"name": "ts", "type": "timestamp", "nullable": False}]}
    n = F.col("event_id")
    planted = F.when(n % 97 == 0, 1).when(n % 89 == 0, 2).when(n % 83 == 0, 3).when(n % 79 == 0, 4).otherwise(0)
    events = t.table(spark, sf, "events").withColumn("planted", planted)
    doc = F.to_json(F.struct(
        "event_id", F.when(F.col("planted") != 4, F.col("user_id")).alias("user_id"), "event_type",
        F.when(F.col("planted") == 2, F.lit("abc")).otherwise(F.col("value").cast("string")).alias("value"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.when(F.col("planted") == 3, F.lit("late")).alias("note")))
    cut = F.when(F.col("planted") == 1, F.substring(doc, F.lit(1), F.length(doc) - 3)).otherwise(doc)
    rows = records.check(events.select(cut.alias("value")), contract)
    return rows.groupBy(F.concat_ws("|", "violations").alias("violations"), F.concat_ws("|", F.map_keys("_rescued")).alias("rescued")).agg(
        F.count(F.lit(1)).alias("records"), F.count("event_id").alias("with_id"))
