"""Lineage graphs, stores, the publication gate and catalogue coverage of the features."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegate.operators import lineage, online
from tidegate.operators.catalog import entries
from tidegate.plans import publish
from tidegate.plans import table_contracts as c
from tidegate.sources import stores
from tidegate.sources import tables as t

import __spark_entry__ as entry

NOW = dt.datetime(2024, 3, 1, 12, 0)


def test_every_catalogue_feature_is_computed(spark, sf_dir):
    q = entry.queries()
    got = {f for n in ("customer_features", "merchant_features", "account_features", "transaction_features")
           for f in q[n](spark, sf_dir).columns}
    assert {e[0] for e in entries()} <= got


def edges(spark, rows):
    return spark.createDataFrame(rows, "source_dataset string, target_dataset string")


def test_closure_on_a_chain_and_a_cycle(spark):
    chain = edges(spark, [("a", "p1"), ("p1", "b"), ("a", "b"), ("b", "p2"), ("p2", "c"), ("b", "c")])
    seeds = spark.createDataFrame([("c",)], "start string")
    assert {(r["node"], r["hops"]) for r in lineage.upstream(chain, seeds).collect()} == {("b", 1), ("p2", 1), ("a", 2), ("p1", 2)}
    loop = edges(spark, [("a", "b"), ("b", "a")])
    assert {r["node"] for r in lineage.downstream(loop, spark.createDataFrame([("a",)], "start string")).collect()} == {"a", "b"}


def test_catalog_resolution_order(spark, tmp_path):
    raw, offline = str(tmp_path / "raw"), str(tmp_path / "offline")
    spark.range(1).write.parquet(f"{raw}/x.parquet")
    spark.range(2).write.option("header", True).csv(f"{raw}/x.csv")
    spark.range(3).write.option("header", True).csv(f"{raw}/y.csv")
    spark.range(4).write.parquet(f"{offline}/z")
    catalog = t.Catalog(spark, raw, offline)
    assert [catalog.load(n).count() for n in "xyz"] == [1, 3, 4]
    with pytest.raises(t.DatasetNotFound):
        catalog.load("none")


def snapshot(spark, n, at=NOW, value=1.0):
    return spark.range(n).select(
        F.col("id").alias("customer_id"), F.lit(at).cast("timestamp").alias("feature_timestamp"),
        F.lit(1).cast("bigint").alias("cust_txn_count_1h"), F.lit(2).cast("bigint").alias("cust_txn_count_24h"),
        F.lit(value).alias("cust_txn_amount_sum_24h"),
    )


def run(spark, root, frame, run_id="r1", contract=c.CUSTOMER_FEATURES, **kw):
    return publish.publish_features(spark, lambda: frame, contract, "customer", "customer_id", root, run_id, NOW, **kw)


def states(out):
    return {s[2]: s[3] for s in out.stages}


@pytest.mark.parametrize("spoil,stage", [
    (lambda df: df.drop("cust_txn_count_24h"), "SCHEMA_VALIDATION"),
    (lambda df: df.withColumn("customer_id", F.when(F.col("customer_id") > 0, F.col("customer_id"))), "DATA_QUALITY"),
    (lambda df: df.withColumn("cust_txn_amount_sum_24h", F.lit(-5.0)), "DATA_QUALITY"),
    (lambda df: df.withColumn("feature_timestamp", F.lit(NOW - dt.timedelta(days=60)).cast("timestamp")), "DATA_QUALITY"),
])
def test_gate_blocks_and_leaves_published_rows(spark, tmp_path, spoil, stage):
    root = str(tmp_path)
    assert run(spark, root, snapshot(spark, 20)).status == "SUCCESS"
    before = sorted(map(str, stores.read_online(spark, root).collect()))
    offline = stores.read_offline(spark, root, "customer").count()
    out = run(spark, root, spoil(snapshot(spark, 30, value=9.0)), "r2")
    assert out.status == "FAILED" and states(out)[stage] == "FAILED"
    assert all(s == "SKIPPED" for n, s in states(out).items() if publish.STAGES.index(n) > publish.STAGES.index(stage))
    assert sorted(map(str, stores.read_online(spark, root).collect())) == before
    assert stores.read_offline(spark, root, "customer").count() == offline
    kinds = [r["eventType"] for r in stores.read_log(spark, root, "lineage_events").select("eventType").collect()]
    assert kinds.count("FAIL") == 1 and stores.read_log(spark, root, "incidents").count() == 1


def test_rerun_is_idempotent_and_invalid_contract_stops(spark, tmp_path):
    root = str(tmp_path)
    for _ in range(2):
        assert run(spark, root, snapshot(spark, 20)).status == "SUCCESS"
    assert stores.read_online(spark, root).count() == 20
    assert stores.read_offline(spark, root, "customer").count() == 20
    for name, rows in (("quality_runs", 1), ("pipeline_runs", 1), ("materializations", 1), ("published", 1), ("lineage_events", 3)):
        assert stores.read_log(spark, root, name).count() == rows, name
    bad = {**c.CUSTOMER_FEATURES, "status": "RETIRED"}
    assert states(run(spark, root, snapshot(spark, 20), "r3", bad))["CONTRACT_VALIDATION"] == "FAILED"


def test_failures_open_one_incident_each(spark, tmp_path):
    root, spoiled = str(tmp_path), snapshot(spark, 20).withColumns({
        "cust_txn_amount_sum_24h": F.lit(-5.0), "customer_id": F.when(F.col("customer_id") > 0, F.col("customer_id"))})
    for run_id in ("r1", "r2", "r2"):
        assert run(spark, root, spoiled, run_id).status == "FAILED"
    rows = stores.read_log(spark, root, "incidents").select("failure_signature", "run_id").collect()
    assert len(rows) == len({r["failure_signature"] for r in rows}) >= 2 and {r["run_id"] for r in rows} == {"r1"}
    assert {r["eventType"] for r in stores.read_log(spark, root, "lineage_events").collect()} == {"START", "FAIL"}


def test_a_resolved_incident_opens_again(spark, tmp_path):
    root = str(tmp_path)
    spoiled = snapshot(spark, 20).withColumn("customer_id", F.when(F.col("customer_id") > 0, F.col("customer_id")))

    def fail(run_id):
        out = run(spark, root, spoiled, run_id)
        assert out.status == "FAILED"
        return out.incident["failure_signature"]

    signature = fail("r1")
    assert fail("r2") == signature
    # other signatures, and a resolve before the failure, leave it open
    publish.resolve_incident(spark, root, "sig_other", NOW + dt.timedelta(hours=1), "me")
    publish.resolve_incident(spark, root, signature, NOW - dt.timedelta(hours=1), "me")
    assert [r["status"] for r in publish.open_incidents(spark, root).collect()] == ["OPEN"]
    publish.resolve_incident(spark, root, signature, NOW, "me")
    assert publish.open_incidents(spark, root).count() == 0
    fail("r3")
    assert sorted(r["run_id"] for r in stores.read_log(spark, root, "incidents").collect()) == ["r1", "r3"]


def test_every_snapshot_of_a_day_is_kept(spark, tmp_path):
    root = str(tmp_path)
    for hour in (10, 11, 11):
        stores.write_offline(snapshot(spark, 4, NOW.replace(hour=hour)), root, "customer")
    times = [r["feature_timestamp"].hour for r in stores.read_offline(spark, root, "customer").collect()]
    assert sorted(times) == [10] * 4 + [11] * 4


def test_breaking_schema_can_be_allowed(spark, tmp_path):
    wide = snapshot(spark, 20).withColumn("cust_txn_count_24h", F.lit("2"))
    assert states(run(spark, str(tmp_path / "a"), wide))["SCHEMA_VALIDATION"] == "FAILED"
    assert run(spark, str(tmp_path / "b"), wide, allow_breaking=True).status == "SUCCESS"


def test_newest_vector_and_lookup(spark):
    old, new = snapshot(spark, 3, NOW - dt.timedelta(days=1), 1.0), snapshot(spark, 2, NOW, 2.0)
    rows = [online.to_online(x, "customer", "customer_id", F.lit(NOW)) for x in (new, old)]
    table = online.upsert(*rows)
    got = {r["entity_id"]: r["features"]["cust_txn_amount_sum_24h"] for r in table.collect()}
    assert got == {"0": 2.0, "1": 2.0, "2": 1.0}
    again = online.upsert(table, rows[0])
    assert sorted(map(str, again.collect())) == sorted(map(str, table.collect()))
    requests = spark.createDataFrame([("customer", "0"), ("customer", "77")], "entity_name string, entity_id string")
    found = {r["entity_id"]: r["freshness_minutes"] for r in online.lookup(table, requests, NOW + dt.timedelta(minutes=5)).collect()}
    assert found == {"0": 5.0, "77": None}


def test_dataset_runs_are_recorded(spark, tmp_path):
    root = str(tmp_path)
    good = snapshot(spark, 20)
    bad = good.withColumn("cust_txn_amount_sum_24h", F.lit(-5.0))

    def check(df, run_id, contract=c.CUSTOMER_FEATURES):
        return publish.validate_dataset(spark, df, contract, run_id, NOW, root=root)

    assert check(good, "r1").status == "SUCCESS" and not stores.path_exists(spark, f"{root}/incidents")
    failed = check(bad, "r2")
    assert failed.status == "FAILED" and failed.incident["column"] == "cust_txn_amount_sum_24h"
    assert check(bad, "r3").incident["failure_signature"] == failed.incident["failure_signature"]
    assert {r["run_id"] for r in stores.read_log(spark, root, "incidents").collect()} == {"r2"}
    assert check(good, "r4", {**c.CUSTOMER_FEATURES, "status": "RETIRED"}).stages[0][3] == "FAILED"
    runs = {r["run_id"]: (r["pipeline_id"], r["status"]) for r in stores.read_log(spark, root, "pipeline_runs").collect()}
    assert runs == {f"r{i}": (publish.DATASET_PIPELINE, "SUCCESS" if i == 1 else "FAILED") for i in range(1, 5)}
    kinds = [(r["run_id"], r["eventType"]) for r in stores.read_log(spark, root, "lineage_events").select("run.runId", "eventType").toDF("run_id", "eventType").collect()]
    assert sorted(kinds) == sorted([(r, "START") for r in runs] + [("r1", "COMPLETE"), ("r2", "FAIL"), ("r3", "FAIL"), ("r4", "FAIL")])
    assert {r["run_id"] for r in stores.read_log(spark, root, "quality_runs").collect()} == {"r1", "r2", "r3"}
