import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegate.operators import asof

DAY0 = dt.datetime(2024, 5, 1, 12, 0)


def at(minutes):
    return DAY0 + dt.timedelta(minutes=minutes)


def obs(spark, rows):
    return spark.createDataFrame(rows, "id string, ts timestamp")


def feats(spark, rows):
    return spark.createDataFrame(rows, "id string, feature_timestamp timestamp, n bigint")


def joined(o, f, **kw):
    return sorted(tuple(r) for r in asof.asof_join(o, f, "id", "ts", **kw).select("id", "ts", "feature_timestamp", "n").collect())


def test_future_rows_are_ignored(spark):
    out = joined(obs(spark, [("a", at(0))]), feats(spark, [("a", at(-10), 2), ("a", at(5), 999)]))
    assert out == [("a", at(0), at(-10), 2)]


def test_no_history_keeps_the_observation(spark):
    assert joined(obs(spark, [("a", at(0))]), feats(spark, [("a", at(60), 1)])) == [("a", at(0), None, None)]


def test_equal_time_matches_and_ties_are_decided(spark):
    out = joined(obs(spark, [("a", at(0))]), feats(spark, [("a", at(0), 3), ("a", at(0), 8)]))
    assert out == [("a", at(0), at(0), 8)]


def test_entities_do_not_mix(spark):
    f = feats(spark, [("a", at(60), 10), ("a", at(300), 99), ("b", at(120), 20), ("b", at(240), 88)])
    assert joined(obs(spark, [("a", at(120)), ("b", at(180))]), f) == [("a", at(120), at(60), 10), ("b", at(180), at(120), 20)]


@pytest.mark.parametrize("extra,expected", [(0, 7), (1, None)])
def test_ttl_voids_values_but_keeps_the_time(spark, extra, expected):
    o = obs(spark, [("a", at(60) + dt.timedelta(seconds=extra))])
    out = joined(o, feats(spark, [("a", at(0), 7)]), ttl_seconds=3600)
    assert out[0][2:] == (at(0), expected)


def test_ttl_off(spark):
    assert joined(obs(spark, [("a", at(10**6))]), feats(spark, [("a", at(0), 7)]), ttl_seconds=0)[0][3] == 7


def test_null_in_the_newest_row_is_not_replaced(spark):
    f = feats(spark, [("a", at(-20), 5), ("a", at(-10), None)])
    assert joined(obs(spark, [("a", at(0))]), f) == [("a", at(0), at(-10), None)]


def test_null_keys_and_times_are_kept(spark):
    rows = [(None, at(0)), ("a", None)]
    out = asof.asof_join(obs(spark, rows), feats(spark, [("a", at(-1), 1), (None, at(-1), 2)]), "id", "ts").collect()
    assert len(out) == 2 and all(r["n"] is None for r in out)


def test_empty_feature_side_keeps_observations(spark):
    assert joined(obs(spark, [("a", at(0))]), feats(spark, [])) == [("a", at(0), None, None)]


def test_many_rows_match_brute_force_at_any_slice(spark):
    o = [(f"e{i % 5}", at(300 * i + i)) for i in range(50)]
    f = [(f"e{i % 5}", at(120 * i), i) for i in range(120)]
    expected = []
    for e, t in o:
        past = [(ft, n) for k, ft, n in f if k == e and ft <= t]
        best = max(past) if past else (None, None)
        expected.append((e, t, *best))
    for width in (86_400, 3_600, 60):
        assert joined(obs(spark, o), feats(spark, f), ttl_seconds=0, slice_seconds=width) == sorted(expected)


def test_leakage_is_detected(spark):
    bad = spark.createDataFrame([(at(0), at(5)), (at(0), at(-5))], "ts timestamp, feature_timestamp timestamp")
    assert asof.leakage_audit(bad, "ts").first()["rows_leaking"] == 1
    with pytest.raises(asof.LeakageError):
        asof.assert_no_leakage(bad, "ts")


def test_naive_join_takes_the_last_non_null(spark):
    f = feats(spark, [("a", at(-20), 5), ("a", at(500), None)])
    row = asof.naive_latest_join(obs(spark, [("a", at(0))]), f, "id").first()
    assert row["n"] == 5 and row["feature_timestamp"] == at(500)


def test_groups_share_one_pass(spark):
    a = feats(spark, [("a", at(-10), 1)])
    b = spark.createDataFrame([("a", at(-3), 2.5)], "id string, b_ts timestamp, b double")
    out = asof.asof_join_groups(
        obs(spark, [("a", at(0)), ("z", at(0))]),
        [asof.FeatureGroup(a, ["n"]), asof.FeatureGroup(b, ["b"], "b_ts")], "id", "ts",
    ).orderBy("id").collect()
    assert (out[0]["n"], out[0]["b"], out[0]["b_ts"]) == (1, 2.5, at(-3)) and out[1]["n"] is None


def test_plan_never_groups_a_whole_key_of_rows(spark):
    """Every shuffle and window over rows is by (key, slice); only one-row-per-slice tables are by key alone."""
    o, f = obs(spark, [("a", at(0))]), feats(spark, [("a", at(-10), 2)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = asof.asof_join(o, f, "id", "ts")
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    by_key = []
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning(" in line and "_slice" not in line.split("hashpartitioning(")[1].split(")")[0]:
            by_key.append(lines[i + 1])
    # what is dealt by the key alone has been reduced to a row per slice first
    assert all("HashAggregate" in line or "SortAggregate" in line or "ObjectHashAggregate" in line for line in by_key), by_key
