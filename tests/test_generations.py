"""Generations of the online table: equal rows, no shuffle of the table, runs done again, a compaction that died."""

import datetime as dt

from pyspark.sql import functions as F

from tidegate.operators import online
from tidegate.sources import stores
from tidegate.streaming import jobs

NOW = dt.datetime(2024, 3, 1, 12, 0)


def publish(spark, root, run, ids, day, value):
    rows = spark.range(*ids).select(
        F.col("id").alias("customer_id"), F.lit(NOW + dt.timedelta(days=day)).cast("timestamp").alias("feature_timestamp"), F.lit(value).alias("v"))
    stores.write_changes(online.to_online(rows, "customer", "customer_id", F.lit(NOW)), f"{root}/online", run)
    stores.mark_published(spark, root, run, NOW)


def values(spark, root):
    return {int(r["entity_id"]): r["features"]["v"] for r in stores.read_online(spark, root).collect()}


def test_generations_hold_the_newest_rows(spark, tmp_path):
    root = str(tmp_path)
    assert stores.read_online(spark, root) is None and not stores.compact_online(spark, root)
    publish(spark, root, "r1", (0, 6), 1, 1.0)
    publish(spark, root, "r2", (4, 8), 0, 2.0)  # older features: known keys stay
    want = {**{i: 1.0 for i in range(6)}, 6: 2.0, 7: 2.0}
    assert values(spark, root) == want
    assert stores.compact_online(spark, root) and not stores.compact_online(spark, root)
    assert values(spark, root) == want
    publish(spark, root, "r3", (5, 10), 2, 3.0)
    want.update({i: 3.0 for i in range(5, 10)})
    assert values(spark, root) == want
    # noted, but without a pointer: the run counts as not folded
    published = stores.read_log(spark, root, "published").select(F.lit("g9").alias("folder"), "token")
    stores.write_log(published, root, "absorbed", "g9")
    assert values(spark, root) == want
    assert stores.compact_online(spark, root)
    assert values(spark, root) == want
    # a folded run done again is an upsert
    publish(spark, root, "r1", (0, 3), 4, 9.0)
    want.update({i: 9.0 for i in range(3)})
    assert values(spark, root) == want


def test_a_lookup_reads_one_generation_in_place(spark, tmp_path):
    root = str(tmp_path)
    for i in range(3):
        publish(spark, root, f"r{i}", (0, 50), i, float(i))
    stores.compact_online(spark, root)
    # another session knows no catalogue entry
    for table in [x.name for x in spark.catalog.listTables() if x.name.startswith("online_g")]:
        spark.sql(f"DROP TABLE {table}")
    current = stores.read_online(spark, root)
    requests = spark.range(200).select(F.lit("customer").alias("entity_name"), F.col("id").cast("string").alias("entity_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = online.lookup(current, requests, NOW + dt.timedelta(days=3))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.filter("features IS NOT NULL").count() == 50
        # the requests are the only side that is shuffled, though their entity is constant
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_stream_publishes_changes_that_are_folded(spark, tmp_path):
    root, feed = str(tmp_path / "store"), str(tmp_path / "feed")
    for day in range(3):
        spark.range(day, day + 4).select(
            F.col("id").alias("customer_id"), F.lit(NOW + dt.timedelta(days=day)).cast("timestamp").alias("feature_timestamp"), F.lit(float(day)).alias("v"),
        ).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema("customer_id bigint, feature_timestamp timestamp, v double").parquet(feed)
        jobs.publish_online(stream, "customer", "customer_id", root, str(tmp_path / "state"), NOW)
        if day == 1:
            assert stores.compact_online(spark, root)
    assert values(spark, root) == {0: 0.0, 1: 1.0, **{i: 2.0 for i in range(2, 6)}}
