"""Quality, contracts, diff, gate and incidents on small literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegate.operators import contracts, diff, freshness, gate, incidents, lineage, referential
from tidegate.operators import quality as q
from tidegate.operators.catalog import catalog, entries, feature_groups, list_features
from tidegate.functions.scalars import display_name, failure_signature, normalize_type
from tidegate.sources.contracts import contracts_frame, read_contracts
from tidegate.sources.introspect import live_contract

NOW = dt.datetime(2024, 3, 1, 12, 0)


def contract(**kw):
    doc = {
        "dataset": "orders", "version": "v1.0.0", "owner": "orders-team", "description": "orders", "freshness_sla_minutes": 60,
        "status": "ACTIVE", "constraints": {"min_rows": 5},
        "columns": [
            {"name": "order_id", "type": "string", "nullable": False, "unique": True, "description": "key"},
            {"name": "customer_id", "type": "string", "nullable": False, "unique": False, "description": "who"},
            {"name": "total", "type": "numeric", "nullable": False, "unique": False, "description": "sum", "min": 0.01, "max": 1000},
            {"name": "currency", "type": "string", "nullable": True, "unique": False, "description": "c", "allowed_values": ["USD", "EUR"]},
            {"name": "created_at", "type": "timestamp", "nullable": False, "unique": False, "description": "when"},
        ],
    }
    doc.update(kw)
    return doc


def orders(spark, change=lambda i, r: r, n=10):
    rows = [change(i, (f"o{i}", "c1", 10.0 + i, "USD", NOW - dt.timedelta(minutes=15))) for i in range(n)]
    return spark.createDataFrame(rows, "order_id string, customer_id string, total double, currency string, created_at timestamp")


def failing(df, doc=None):
    return {r["check_name"]: r["unexpected"] for r in q.run_suite(df, doc or contract()).collect() if not r["success"]}


def test_clean_frame_scores_100(spark):
    _, runs = q.run_validation(orders(spark), contract(), "r", NOW)
    row = runs.first()
    assert (row["quality_score"], row["overall_status"], row["failed_checks"]) == (100.0, "PASS", 0)


@pytest.mark.parametrize("change,expected", [
    (lambda i, r: (r[0], None, *r[2:]) if i < 3 else r, {q.NOT_NULL + "_customer_id": 3}),
    (lambda i, r: ("o0", *r[1:]) if i < 5 else r, {q.UNIQUE + "_order_id": 5}),
    (lambda i, r: (*r[:2], -250.0, *r[3:]) if i < 5 else r, {q.BETWEEN + "_total": 5}),
    (lambda i, r: (*r[:2], float("nan"), *r[3:]) if i < 2 else r, {q.NOT_NULL + "_total": 2}),
    (lambda i, r: (*r[:3], "XXX", r[4]) if i < 4 else r, {q.IN_SET + "_currency": 4}),
    (lambda i, r: (*r[:3], None, r[4]), {}),
])
def test_each_defect_fails_its_check(spark, change, expected):
    assert failing(orders(spark, change)) == expected


def test_missing_column_and_too_few_rows(spark):
    bad = failing(orders(spark, n=3).drop("total"))
    assert set(bad) == {q.ROW_COUNT, q.EXISTS + "_total", q.NOT_NULL + "_total", q.BETWEEN + "_total"}


def test_quarantine_splits_rows(spark):
    df = orders(spark, lambda i, r: ("o0", *r[1:]) if i < 2 else (*r[:2], -1.0, *r[3:]) if i == 2 else r)
    good, bad = q.split_quarantine(df, contract())
    assert (good.count(), bad.count()) == (7, 3)


@pytest.mark.parametrize("minutes,state", [(15, "FRESH"), (60, "FRESH"), (90, "WARNING"), (180, "STALE"), (-30, "FRESH")])
def test_freshness_classes(spark, minutes, state):
    df = spark.createDataFrame([(NOW - dt.timedelta(minutes=minutes),)], "created_at timestamp")
    row = freshness.evaluate_freshness(df, NOW, sla_minutes=60).first()
    assert row["freshness_status"] == state and row["delay_minutes"] == max(0, minutes)


def test_freshness_without_time_is_unknown(spark):
    for df in (spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("junk",)], "created_at string"),
               spark.createDataFrame([], "created_at timestamp")):
        assert freshness.evaluate_freshness(df, NOW).first()["freshness_status"] == "UNKNOWN"


def test_foreign_keys(spark):
    child = spark.createDataFrame([("001",), ("GHOST_999",), (None,)], "customer_id string")
    parent = spark.createDataFrame([("001",), ("002",)], "customer_id string")
    row = referential.foreign_key_check("orders", child, "customer_id", "customers", parent, "customer_id").first()
    assert (row["status"], row["unexpected"], row["base"]) == ("FAIL", 1, 2) and "GHOST_999" in row["details"]
    none = child.filter("customer_id IS NULL")
    assert referential.foreign_key_check("orders", none, "customer_id", "customers", parent, "customer_id").first()["status"] == "PASS"
    assert referential.foreign_key_check("orders", child, "nope", "customers", parent, "customer_id").first()["status"] == "FAIL"
    lost = referential.foreign_key_check("orders", child, "customer_id", "customers", None, "customer_id").first()
    assert (lost["status"], lost["success"]) == ("WARNING", False)


# -- types and diff ---------------------------------------------------------------------

@pytest.mark.parametrize("raw,kind", [("VARCHAR(255)", "string"), (" INT8 ", "bigint"), ("numeric(10,2)", "numeric"), ("", "string"),
                                      (None, "string"), ("double precision", "float"), ("geometry", "geometry"), ("bool", "boolean")])
def test_type_names(spark, raw, kind):
    assert spark.createDataFrame([(raw,)], "t string").select(normalize_type("t")).first()[0] == kind


@pytest.mark.parametrize("old,new,safe", [("integer", "bigint", True), ("integer", "numeric", True), ("float", "numeric", True),
                                          ("float", "integer", False), ("bigint", "integer", False), ("integer", "string", False)])
def test_widening(spark, old, new, safe):
    row = spark.range(1).select(F.expr(diff.type_change_sql(f"'{old}'", f"'{new}'")[0])).first()
    assert (row[0] == "SAFE") is safe


def mutate(name, **kw):
    doc = contract(version="v2")
    doc["columns"] = [{**c, **kw} if c["name"] == name else c for c in doc["columns"]]
    return doc


def dropped(name, extra=None):
    doc = contract(version="v2")
    doc["columns"] = [c for c in doc["columns"] if c["name"] != name] + ([extra] if extra else [])
    return doc


NEW = {"name": "note", "type": "timestamp", "nullable": True, "unique": False, "description": "n"}


@pytest.mark.parametrize("target,expected", [
    (contract(version="v2"), []),
    (dropped("", NEW), [("note", "COLUMN_ADDED", "SAFE")]),
    (dropped("", {**NEW, "nullable": False}), [("note", "COLUMN_ADDED", "WARNING")]),
    (dropped("currency"), [("currency", "COLUMN_REMOVED", "BREAKING")]),
    (dropped("created_at", NEW), [("created_at", "COLUMN_REMOVED", "BREAKING"), ("note", "COLUMN_ADDED", "SAFE"), ("note", "COLUMN_RENAMED", "BREAKING")]),
    (mutate("total", type="string"), [("total", "TYPE_CHANGED", "BREAKING")]),
    (mutate("total", type="decimal(12,2)"), []),
    (mutate("currency", nullable=False), [("currency", "NULLABILITY_CHANGED", "BREAKING")]),
    (mutate("total", nullable=True), [("total", "NULLABILITY_CHANGED", "SAFE")]),
    (mutate("customer_id", unique=True), [("customer_id", "UNIQUE_CHANGED", "BREAKING")]),
    (mutate("order_id", unique=False), [("order_id", "UNIQUE_CHANGED", "SAFE")]),
    (mutate("currency", allowed_values=["USD", "EUR", "GBP"]), [("currency", "ENUM_VALUE_ADDED", "SAFE")]),
    (mutate("currency", allowed_values=["USD"]), [("currency", "ENUM_VALUE_REMOVED", "BREAKING")]),
    (mutate("total", min=5), [("total", "RANGE_TIGHTENED", "WARNING")]),
    (mutate("total", max=5000), [("total", "RANGE_EXPANDED", "SAFE")]),
    (mutate("total", description="new"), [("total", "DESCRIPTION_CHANGED", "SAFE")]),
    (contract(version="v2", freshness_sla_minutes=30), [("(root)", "SLA_CHANGED", "WARNING")]),
    (contract(version="v2", freshness_sla_minutes=90), [("(root)", "SLA_CHANGED", "SAFE")]),
    (contract(version="v2", description="other"), [("(root)", "DESCRIPTION_CHANGED", "SAFE")]),
])
def test_diff_rules(spark, target, expected):
    changes = diff.schema_diff(contracts_frame(spark, [contract()]), contracts_frame(spark, [target]))
    assert sorted((r["column"], r["change_type"], r["severity"]) for r in changes.collect()) == sorted(expected)


def test_constraint_texts(spark):
    a, b = contract(constraints=["a > 0", "b > 0"]), contract(version="v2", constraints=["a > 0", "b > 1"])
    got = diff.schema_diff(contracts_frame(spark, [a]), contracts_frame(spark, [b])).collect()
    assert sorted((r["change_type"], r["severity"]) for r in got) == [("CONSTRAINT_ADDED", "WARNING"), ("CONSTRAINT_REMOVED", "WARNING")]


def test_live_frame_never_tightens(spark):
    changes = diff.schema_diff(contracts_frame(spark, [contract()]), live_contract(orders(spark), "orders", True), live=True)
    assert changes.filter("severity = 'BREAKING'").count() == 1  # string contract type kept, double is not numeric
    drift = diff.schema_diff(contracts_frame(spark, [contract()]), live_contract(orders(spark).drop("total"), "orders"), live=True)
    assert ("total", "COLUMN_REMOVED") in {(r["column"], r["change_type"]) for r in drift.collect()}


def test_contract_errors(spark):
    doc = contract(status="OLD", freshness_sla_minutes=-1)
    doc["columns"] += [{"name": "total", "type": "money", "nullable": True, "unique": False, "description": "", "min": 2, "max": 1},
                       {"name": "x", "type": "string", "allowed_values": []}]
    del doc["owner"]
    row = contracts.validate_contracts(contracts_frame(spark, [doc])).first()
    assert sorted(row["errors"]) == sorted([
        "missing_root_field:owner", "invalid_status:OLD", "sla_not_positive", "duplicate_column:total", "invalid_type:total:money",
        "min_above_max:total", "missing_column_field:nullable:x", "missing_column_field:unique:x", "missing_column_field:description:x",
        "allowed_values_empty:x",
    ])
    assert contracts.validate_contracts(contracts_frame(spark, [contract()])).first()["is_valid"]


def test_contract_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("dataset: a\nversion: v1\ncolumns:\n- {name: x, type: integer, allowed_values: [0, 1]}\n")
    (tmp_path / "b.json").write_text('{"dataset": "b", "version": "v1", "columns": []}')
    rows = {r["dataset"]: r for r in read_contracts(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["columns"][0]["allowed_values"] == ["0", "1"]


def test_gate(spark):
    base = contracts_frame(spark, [contract(), contract(dataset="b"), contract(dataset="q")])
    bad = contract(dataset="c")
    del bad["columns"]
    target = contracts_frame(spark, [dropped("total"), contract(dataset="b", freshness_sla_minutes=30), contract(dataset="new"), bad, contract(dataset="q")])
    quality = spark.createDataFrame([("q", 60.0)], "dataset string, quality_score double")
    v = {r["dataset"]: r["verdict"] for r in gate.gate_verdicts(base, target, quality).collect()}
    assert v == {"orders": "BREAKING", "b": "WARNING", "new": "SAFE", "c": "BREAKING", "q": "BREAKING"}
    blocked = gate.gate_summary(gate.gate_verdicts(base, target)).first()
    assert (blocked["verdict"], blocked["can_merge"], blocked["exit_code"]) == ("BREAKING", False, 1)
    allowed = gate.gate_summary(gate.gate_verdicts(base, target), allow_breaking=True).first()
    assert (allowed["verdict"], allowed["can_merge"], allowed["exit_code"]) == ("WARNING", True, 0)


# -- incidents -------------------------------------------------------------------------------

def test_dedup_and_reopen(spark):
    rows = [("s", 1, "FAIL"), ("s", 2, "FAIL"), ("s", 3, "RESOLVE"), ("s", 4, "FAIL"), ("t", 1, "RESOLVE"), ("t", 2, "FAIL")]
    log = spark.createDataFrame(rows, "failure_signature string, event_id bigint, kind string").withColumn(
        "timestamp", F.timestamp_seconds(F.col("event_id") * 100_000))
    got = sorted((r["failure_signature"], r["opened_by"], r["failure_count"], r["status"]) for r in incidents.deduplicate(log).collect())
    assert got == [("s", 1, 2, "RESOLVED"), ("s", 4, 1, "OPEN"), ("t", 2, 1, "OPEN")]


def test_life_cycle(spark):
    states = ["OPEN", "OPEN", "ACKNOWLEDGED", "ACKNOWLEDGED", "OPEN", "RESOLVED", "RESOLVED", "ACKNOWLEDGED"]
    log = spark.createDataFrame([("i", n, s) for n, s in enumerate(states)], "incident_id string, id bigint, new_status string").withColumn(
        "timestamp", F.timestamp_seconds("id"))
    got = [r["outcome"] for r in incidents.events_of(log, "i").collect()]
    assert got == ["CREATED", "NOOP", "APPLIED", "NOOP", "REJECTED", "APPLIED", "REJECTED", "REJECTED"]
    row = incidents.latencies(incidents.fold(log)).first()
    assert (row["status"], row["ack_seconds"], row["resolve_seconds"]) == ("RESOLVED", 2.0, 5.0)


@pytest.mark.parametrize("kind,column,details,expected", [
    (q.FOREIGN_KEY, "x", "{}", "CRITICAL"), (q.EXISTS, "x", "{}", "CRITICAL"), (q.UNIQUE, "order_id", "{}", "CRITICAL"),
    (q.UNIQUE, "email", "{}", "HIGH"), (q.FRESHNESS, "ts", '{"status":"STALE"}', "CRITICAL"), (q.FRESHNESS, "ts", '{"status":"WARNING"}', "MEDIUM"),
    (q.NOT_NULL, "x", "{}", "HIGH"), (q.IN_SET, "x", "{}", "MEDIUM"), ("other", None, None, "MEDIUM"),
])
def test_severity(spark, kind, column, details, expected):
    df = spark.createDataFrame([(kind, column, details)], "expectation_type string, column string, details string")
    assert df.select(incidents.severity()).first()[0] == expected


def test_signature_is_normalised(spark):
    import hashlib

    df = spark.createDataFrame([(" Orders ", None, "Check", "Kind", None)], "d string, p string, c string, k string, x string")
    expected = "sig_" + hashlib.sha256(b"orders|default_pipeline|check|kind|").hexdigest()[:16]
    assert df.select(failure_signature("d", "p", "c", "k", "x")).first()[0] == expected


def test_catalogue(spark):
    assert len(entries()) == 122 and len({e[0] for e in entries()}) == 122
    rows = catalog(spark)
    assert list_features(rows, entity="account").count() == 23
    assert feature_groups(rows).count() == 9
    assert spark.range(1).select(display_name(F.lit("fraud_score_job"))).first()[0] == "Fraud Score Job"


def test_columns_are_traced_over_any_number_of_hops(spark):
    chain = spark.createDataFrame(
        [("d", f"c{i}", "d", f"c{i + 1}") for i in range(12)] + [("d", "c12", "d", "c0")],
        "source_dataset string, source_column string, target_dataset string, target_column string")
    got = lineage.trace_columns(chain, spark.createDataFrame([("d.c0",)], "start string"))
    assert sorted(r["hops"] for r in got.collect()) == list(range(1, 14))


def test_newest_mapping_is_by_time(spark):
    rows = [("a", "x", "b", "y", "p", "old", "run_9", dt.datetime(2024, 1, 1)), ("a", "x", "b", "y", "q", "new", "run_10", dt.datetime(2024, 1, 2))]
    m = spark.createDataFrame(rows, "source_dataset string, source_column string, target_dataset string, target_column string, pipeline_id string, "
                                    "transformation string, run_id string, at timestamp")
    assert lineage.column_lineage(m, "b").select("transformation", "run_id").first() == ("new", "run_10")


def test_declared_facets_fold_before_the_join(spark):
    runs = spark.createDataFrame(
        [("r1", "p", "postgres.t"), ("r1", "p", "postgres.t"), ("r1", "p", "t"), ("r2", "p", "t"), ("r3", "q", "t")],
        "run_id string, pipeline_id string, dataset string")
    rules = [(f"s{i % 7}", f"c{i % 5}", "redis.t" if i % 2 else "t", f"x{i % 2}", f"rule {i % 3}", "p") for i in range(70)]
    declared = spark.createDataFrame(
        rules, "source_dataset string, source_column string, target_dataset string, target_column string, transformation string, pipeline_id string")
    got = lineage.attach_declared(runs, declared)
    rows = {(r["run_id"], r["dataset"], r["target_column"]): (len(r["input_fields"]), r["transformation"]) for r in got.collect()}
    assert got.count() == 6
    assert rows == {(r, d, x): (35, "rule 2") for r, d in (("r1", "postgres.t"), ("r1", "t"), ("r2", "t")) for x in ("x0", "x1")}
    # a mapping meets no run before it is folded: the sets are built below the join
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("collect_set")
