"""The kept table of visits: equal features from a short history, steps done again, folds."""

import datetime as dt

from pyspark.sql import functions as F

from tidegate.operators import account, customer
from tidegate.sources import tables as t
from tidegate.sources import visits


def long_history(spark, sf_dir):
    """The events three times: as they are, 45 and 90 days earlier with other merchants."""
    txn = t.bind_transactions(spark, sf_dir)
    parts = [txn.withColumns({
        "ts": F.col("ts") - F.expr(f"INTERVAL {45 * i} DAYS"), "transaction_id": F.col("transaction_id") + 10_000_000 * i,
        "merchant_id": F.when(F.col("transaction_id") % 7 != i, F.col("merchant_id") + i)}) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rows(df):
    names = sorted(df.columns)
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*names).collect())


def test_features_with_the_kept_table_equal_those_of_all_history(spark, sf_dir, tmp_path):
    txn, now = long_history(spark, sf_dir), t.latest_event_time(spark, sf_dir)
    recent = txn.filter(F.col("ts") >= F.lit(now - dt.timedelta(days=30)).cast("timestamp"))
    root = str(tmp_path)
    for key in ("customer_id", "account_id"):
        # the last step is within the 30 days and must not be used
        for days in (100, 60, 40, 31, 10):
            visits.advance(txn, root, key, now - dt.timedelta(days=days), fold_after=1)
        short = visits.history(txn, root, key, now)
        assert short.count() < txn.count()
        if key == "customer_id":
            args = (recent, t.bind_customers(spark, sf_dir), t.bind_merchants(spark, sf_dir), now)
            make = customer.customer_features
        else:
            args, make = (recent, t.bind_accounts(spark, sf_dir), now), account.account_features
        assert rows(make(*args, history=short)) == rows(make(*args, history=txn))


def test_steps_again_folds_and_an_early_snapshot(spark, sf_dir, tmp_path):
    txn, now, root = long_history(spark, sf_dir), t.latest_event_time(spark, sf_dir), str(tmp_path)
    want = rows(txn.groupBy("customer_id", "merchant_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("visits")))
    assert visits.table(spark, root, "customer_id") is None and visits.mark(spark, root, "customer_id") is None
    assert visits.history(txn, root, "customer_id", now).count() == txn.count()
    for days in (80, 80, 60, 70, 40, 20, 0, 0):
        visits.advance(txn, root, "customer_id", now - dt.timedelta(days=days), fold_after=2)
    assert rows(visits.table(spark, root, "customer_id")) == want
    early = now - dt.timedelta(days=41)
    assert visits.mark(spark, root, "customer_id", early) == now - dt.timedelta(days=60)
    upto = txn.filter(F.col("ts") <= F.lit(now - dt.timedelta(days=60)).cast("timestamp"))
    assert visits.table(spark, root, "customer_id", early).agg(F.sum("visits")).first()[0] == upto.count()


def test_rows_without_key_or_merchant_and_an_empty_table(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows_ = [(1, None, at, 1.0), (None, 5, at, 1.0), (1, None, at + dt.timedelta(hours=1), 2.0)]
    txn = spark.createDataFrame(rows_, "customer_id bigint, merchant_id bigint, ts timestamp, amount double")
    visits.advance(txn, str(tmp_path), "customer_id", at + dt.timedelta(days=1))
    assert [(r["customer_id"], r["merchant_id"], r["visits"]) for r in visits.table(spark, str(tmp_path), "customer_id").collect()] == [(1, None, 2)]
    empty = str(tmp_path / "empty")
    visits.advance(txn.limit(0), empty, "customer_id", at)
    assert visits.table(spark, empty, "customer_id").count() == 0


def test_quarantine_and_suite_agree_on_nan(spark):
    from tidegate.operators import quality as q

    contract = {"dataset": "x", "columns": [{"name": "v", "type": "float", "nullable": True, "unique": True}]}
    df = spark.createDataFrame([(float("nan"),), (float("nan"),), (1.0,), (None,)], "v double")
    assert all(r["success"] for r in q.run_suite(df, contract).collect())
    assert q.quarantine(df, contract).filter(F.size("violations") > 0).count() == 0
