"""Sliced windows equal plain windows, for hot keys, ties and every slice width."""

import math
import datetime as dt
import random
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegate.operators import slices
from tidegate.operators.training import roc_auc, stratified_split
from tidegate.operators.transaction import customer_chain
from tidegate.operators.customer import RiskParams, daily_profile, profile

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        key = 1 if i % 3 else rng.randrange(2, 8)  # two thirds of the rows have one key
        ts = T0 + dt.timedelta(seconds=rng.randrange(0, 5 * 86_400) // 60 * 60)  # many ties
        rows.append((i, key, ts, float(rng.randrange(1, 200))))
    return spark.createDataFrame(rows, "transaction_id bigint, customer_id bigint, ts timestamp, amount double").cache()


@pytest.mark.parametrize("width", [86_400, 3_600, 60])
@pytest.mark.parametrize("descending", [False, True])
def test_running_equals_a_plain_window(events, width, descending):
    order = [F.desc("ts"), F.desc("transaction_id")] if descending else ["ts", "transaction_id"]
    plain = Window.partitionBy("customer_id").orderBy(*order)
    expected = events.withColumns({
        "s": F.sum("amount").over(plain.rowsBetween(Window.unboundedPreceding, 0)),
        "m": F.max("amount").over(plain.rowsBetween(Window.unboundedPreceding, -1)),
    })
    got = slices.running(
        events, ["customer_id"], "ts", "transaction_id",
        {"s": slices.Running(F.col("amount")), "m": slices.Running(F.col("amount"), "max", True)}, width, descending,
    )
    columns = ["transaction_id", "s", "m"]
    assert sorted(got.select(columns).collect()) == sorted(expected.select(columns).collect())


def test_previous_row(events):
    plain = Window.partitionBy("customer_id").orderBy("ts", "transaction_id")
    expected = events.select("transaction_id", F.lag("transaction_id").over(plain).alias("p")).collect()
    got = slices.with_previous(events, ["customer_id"], "ts", "transaction_id").select("transaction_id", F.col("_prev.transaction_id").alias("p"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in expected}


@pytest.mark.parametrize("width", [3_600, 600, 60])
def test_trailing_equals_range_windows(events, width):
    windows = {"1h": 3_600, "6h": 21_600, "2d": 172_800}
    got = slices.trailing(events, ["customer_id"], "ts", {"n": "1", "a": "amount"}, windows, width)
    seconds = F.col("ts").cast("long")
    expected = events.select("transaction_id", *[
        f.over(Window.partitionBy("customer_id").orderBy(seconds).rangeBetween(-s, 0)).cast("double").alias(f"{m}_{w}")
        for w, s in windows.items() for m, f in (("n", F.count("amount")), ("a", F.sum("amount")))
    ])
    columns = expected.columns
    assert sorted(got.select(columns).collect()) == sorted(expected.collect())


@pytest.mark.parametrize("width,offset", [(3_600, 0.0), (600, 5e7), (60, 5e7)])
def test_trailing_spread_keeps_small_differences(spark, events, width, offset):
    """Against exact arithmetic: a large level, a value a million times larger now and then, and nulls."""
    rows = [(r.customer_id, r.ts, r.transaction_id, None if r.transaction_id % 7 == 0 else offset + 0.1 * (r.transaction_id % 10) + (1e9 if r.transaction_id % 41 == 0 else 0))
            for r in events.collect()]
    windows = {"1h": 3_600, "6h": 21_600, "2d": 172_800}
    df = spark.createDataFrame(rows, "customer_id int, ts timestamp, transaction_id long, v double")
    got = {r.transaction_id: r for r in slices.trailing(df, ["customer_id"], "ts", {"n": "1"}, windows, width, spread={"v": ("v", list(windows))}).collect()}
    assert len(got) == len(rows)
    for k, ts, i, _ in rows:
        for w, s in windows.items():
            inside = [Fraction(v) for k2, t2, _, v in rows if k2 == k and ts - dt.timedelta(seconds=s) <= t2 <= ts and v is not None]
            want = 0.0
            if len(inside) > 1:
                mean = sum(inside) / len(inside)
                want = math.sqrt(sum((x - mean) ** 2 for x in inside) / (len(inside) - 1))
            assert got[i][f"v_std_{w}"] == pytest.approx(want, rel=1e-6, abs=1e-7)


def test_spread_of_ten_close_values(spark):
    rows = [(1, T0 + dt.timedelta(minutes=i), i, 5e7 + 0.1 * i) for i in range(10)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, i long, v double")
    out = slices.trailing(df, ["k"], "ts", {"n": "1"}, {"1h": 3_600}, 60, spread={"v": ("v", ["1h"])}).orderBy("i").collect()
    assert out[-1].v_std_1h == pytest.approx(0.30277, abs=1e-4)


@pytest.mark.parametrize("width", [3_600, 60])
def test_high_value_runs(events, width):
    rows = sorted((r.customer_id, r.ts, r.transaction_id, r.amount) for r in events.collect())
    expected = {}
    for k, ts, i, _ in rows:
        run = 0
        for k2, ts2, i2, amount in reversed([r for r in rows if r[0] == k and (r[1], r[2]) <= (ts, i)]):
            if ts2 < ts - dt.timedelta(hours=1) or not amount > 100:
                break
            run += 1
        expected[i] = run
    got = customer_chain(events, RiskParams(high_value=100.0), width)
    assert {r.transaction_id: r.high_run for r in got.collect()} == expected


def test_fit_slice_narrows_for_a_hot_key(events):
    assert slices.fit_slice(events, ["customer_id"], "ts") == 86_400
    assert slices.fit_slice(events, ["customer_id"], "ts", target_rows=20) < 86_400


def test_profile_does_not_depend_on_the_slice(spark, events, monkeypatch):
    txn = events.withColumns({"status": F.when(F.col("transaction_id") % 4 == 0, "FAILED").otherwise("APPROVED"),
                              "channel": F.lit("ATM"), "merchant_id": F.lit(1)})
    as_of = T0 + dt.timedelta(days=5)

    def result():
        return sorted(map(str, profile(daily_profile(txn, "customer_id", as_of), "customer_id", as_of).selectExpr(
            "customer_id", "n_30d", "gaps", "round(gap_sum, 3)", "round(sqrt(gap_m2), 3)", "round(sqrt(amt_m2), 6)", "fail_streak", "best_day_n", "last").collect()))

    whole = result()
    import tidegate.operators.customer as c
    monkeypatch.setattr(c, "fit_slice", lambda *a, **k: 600)
    assert result() == whole


def test_split_cuts_every_label(events):
    rows = events.withColumn("label", (F.col("amount") > 150).cast("int"))
    for r in stratified_split(rows, "transaction_id", "label").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_train").alias("k")
    ).collect():
        assert abs(r["k"] - 0.75 * r["n"]) <= 1


def test_auc_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(round(rng.random(), 2), float(rng.random() < 0.3)) for _ in range(300)]
    pos, neg = [p for p, y in rows if y == 1], [p for p, y in rows if y == 0]
    expected = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    got = roc_auc(spark.createDataFrame(rows, "p double, label double"), "p").first()["roc_auc"]
    assert abs(got - expected) < 1e-12
    assert roc_auc(spark.createDataFrame([(0.5, 1.0)], "p double, label double"), "p").first()["roc_auc"] is None


def test_large_amounts_leave_no_trace(spark):
    rows = [(1, dt.datetime(2024, 1, 1 + d, h), v) for d, h, v in ((0, 1, 5e8), (0, 2, 20.0), (9, 0, 7e8), (9, 23, 1.0))]
    rows += [(1, dt.datetime(2024, 3, 1, h), 20.0 + h / 100) for h in range(10)] + [(1, dt.datetime(2024, 1, 8, 1, 30), 3.0)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, v double")
    for width in (86_400, 3600, 60):
        out = slices.trailing(df, ["k"], "ts", {"v": "v", "sq": "v * v"}, {"7d": 7 * 86_400, "30d": 30 * 86_400}, width).collect()
        for r in out:
            for w, days in (("7d", 7), ("30d", 30)):
                inside = [v for _, t, v in rows if r["ts"] - dt.timedelta(days=days) <= t <= r["ts"]]
                assert abs(r[f"v_{w}"] - sum(inside)) <= 1e-12 * sum(inside) + 1e-9
                assert abs(r[f"sq_{w}"] - sum(v * v for v in inside)) <= 1e-12 * sum(v * v for v in inside) + 1e-9


def test_rows_without_a_time_are_kept(spark):
    df = spark.createDataFrame([(1, None, 1), (1, dt.datetime(2024, 1, 1), 2), (None, dt.datetime(2024, 1, 1), 3)], "k long, ts timestamp, i long")
    out = slices.running(df, ["k"], "ts", "i", {"n": slices.Running(F.lit(1))}, 60)
    assert sorted(r["i"] for r in out.collect()) == [1, 2, 3]


def test_sparse_keys_need_no_slices(spark, events):
    rows = spark.range(400).selectExpr(
        "id AS transaction_id", "id % 40 AS customer_id", "timestamp_seconds(1704067200 + id * 43200 + id % 7) AS ts",
        "CASE WHEN id % 97 = 0 THEN 1e9D + id ELSE 0.25D * id END AS amount")

    def windows(df, width=None):
        out = slices.trailing(df, ["customer_id"], "ts", {"a": "amount", "n": "1"}, {"7d": 7 * 86_400, "30d": 30 * 86_400}, width,
                              wanted={"n": ["30d"]}, spread={"a": ("amount", ["30d"])})
        return out.select("transaction_id", F.round("a_7d", 4), F.round("a_30d", 4), "n_30d", F.round(F.log1p("a_std_30d"), 9))

    direct = windows(rows)
    assert sorted(direct.collect()) == sorted(windows(rows, 86_400).collect())
    plan = direct._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # no row is copied and none is met again
    assert slices.sparse(rows, ["customer_id"], "ts", 30 * 86_400) and slices.sparse(rows.limit(0), ["customer_id"], "ts", 86_400)
    # a dense or a hot key keeps its slices
    assert not slices.sparse(events, ["customer_id"], "ts", 30 * 86_400)
    assert not slices.sparse(rows, ["customer_id"], "ts", 30 * 86_400, target_rows=5)


def test_expiring_rows_go_before_the_second_sort(events):
    lines = customer_chain(events, RiskParams(), 3_600)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, x in enumerate(lines) if "Filter (_role" in x)
    above, below = ([x for x in part if "Window [" in x and "_us" in x] for part in (lines[:at], lines[at:]))
    assert above and not any("DESC" in x for x in above)  # event rows alone are sorted by (time, id)
    assert any("DESC" in x for x in below)
