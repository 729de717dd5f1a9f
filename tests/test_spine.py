"""Snapshots of a spine against plain Python, at several steps, with events on the edges of windows."""

import datetime as dt
import random
import statistics

import pytest

from tidegate.operators import slices, spine

T0 = dt.datetime(2024, 1, 1)
SPANS = {"10min": 600, "1h": 3_600, "24h": 86_400, "7d": 7 * 86_400, "30d": 30 * 86_400}


def make(seed, days, n, edges=True):
    rng, rows = random.Random(seed), []
    for i in range(n):
        key = 1 if i % 2 else rng.randrange(2, 5)
        at = T0 + dt.timedelta(seconds=rng.randrange(0, days * 86_400))
        if edges and i % 5 == 0:  # exactly on a step
            at = T0 + dt.timedelta(hours=rng.choice([0, 6, 12, 24]) + 24 * rng.randrange(days))
        rows.append((i, None if i % 50 == 49 else key, rng.choice([None, 7, 8, 9]), None if i % 37 == 0 else 5e6 + rng.randrange(100) / 8, at,
                     rng.choice(["FAILED", "FAILED", "APPROVED"])))
    return rows


def brute(rows, step):
    end = max(r[4] for r in rows)
    grid, t = [], T0
    while t - dt.timedelta(seconds=step) < end:
        grid.append(t)
        t += dt.timedelta(seconds=step)
    out = {}
    for key in {r[1] for r in rows} - {None}:
        own = [r for r in rows if r[1] == key]
        for t in grid:
            seen = {w: [r for r in own if t - dt.timedelta(seconds=s) <= r[4] <= t] for w, s in SPANS.items()}
            month = sorted(seen["30d"], key=lambda r: (r[4], r[0]), reverse=True)
            if not month:
                continue
            streak = next((i for i, r in enumerate(month) if r[5] != "FAILED"), len(month))
            amounts = [r[3] for r in month if r[3] is not None]
            out[key, t] = (
                {w: len(v) for w, v in seen.items()}, {w: sum(r[3] or 0 for r in v) for w, v in seen.items()},
                {w: sum(r[5] == "FAILED" for r in v) for w, v in seen.items()}, streak,
                statistics.stdev(amounts) if len(amounts) > 1 else 0.0, max(amounts, default=None),
                {w: len({r[2] for r in seen[w]} - {None}) for w in ("24h", "7d", "30d")})
    return out


@pytest.mark.parametrize("step,days,rows,target", [(86_400, 70, 300, None), (86_400, 12, 200, 3), (6 * 3_600, 9, 80, None), (43_200, 35, 120, 5)])
def test_snapshots_match_plain_python(spark, monkeypatch, step, days, rows, target):
    if target:  # slices far shorter than a step
        monkeypatch.setattr(spine, "fit_slice", lambda df, key, ts, widest: slices.fit_slice(df, key, ts, widest, target))
    data = make(step + days, days, rows)
    txn = spark.createDataFrame(data, "transaction_id long, customer_id int, merchant_id int, amount double, ts timestamp, status string")
    got = spine.folded(txn, "customer_id", step, other="merchant_id", distinct=["24h", "7d", "30d"]).collect()
    want = brute(data, step)
    assert len(got) == len(want)
    for r in got:
        n, amt, failed, streak, std, top, distinct = want[r._k, r.feature_timestamp]
        assert {w: r[f"n_{w}"] for w in SPANS} == n and {w: r[f"failed_{w}"] for w in SPANS} == failed
        assert {w: r[f"amt_{w}"] for w in SPANS} == pytest.approx(amt)
        assert (r.streak, r.top_30d) == (streak, top) and r.std_30d == pytest.approx(std, rel=1e-6, abs=1e-6)
        assert {w: r[f"d_{w}"] for w in distinct} == distinct


def test_no_events_give_no_snapshots(spark):
    txn = spark.createDataFrame([], "transaction_id long, customer_id int, merchant_id int, amount double, ts timestamp, status string, is_fraud int")
    assert spine.model_history(txn).count() == spine.merchant_history(txn).count() == 0


def test_steps_that_do_not_divide_a_window_are_rejected(spark):
    txn = spark.createDataFrame([(1, 1, T0)], "transaction_id long, customer_id int, ts timestamp")
    for step in (600, 7 * 3_600, 40 * 86_400):
        with pytest.raises(ValueError):
            spine.folded(txn, "customer_id", step)


def test_no_row_holds_the_states_of_its_window(spark):
    """Runs that only grow keep the spread of large amounts; lists of states in sliding frames cost time per row and step."""
    day = dt.timedelta(days=1)
    rows = [(i, 1, 7, 5e7 + 0.1 * (i % 10), T0 + dt.timedelta(hours=5) + i // 2 * day, "FAILED" if i % 40 else "APPROVED") for i in range(130)]
    txn = spark.createDataFrame(rows, "transaction_id long, customer_id int, merchant_id int, amount double, ts timestamp, status string")
    got = spine.folded(txn, "customer_id")
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = brute(rows, 86_400)
    got = got.collect()
    assert len(got) == len(want) == 65
    for r in got:
        assert r.streak == want[1, r.feature_timestamp][3] and r.std_30d == pytest.approx(want[1, r.feature_timestamp][4], rel=1e-5, abs=1e-7)
