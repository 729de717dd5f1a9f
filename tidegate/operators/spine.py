"""Snapshots at every as-of time of a spine, in one job.

History is what makes a point-in-time join useful: with snapshots at many times each
observation finds the features as they were.

Events fold into one mergeable state per (entity, step), a snapshot into the states of the steps
its windows cover.  A state holds sums, extremes, the run of failures at its end, and number, mean
and squared deviations of the amounts; states are merged and never taken away from each other.
Windows shorter than a step are taken from the events of the snapshot's own step.  Distinct values
need no sets: a visit is seen by the snapshots of one interval, and the intervals of a value that
overlap count once.  Spread over a month of steps is the end of one aligned month and the beginning
of the next, two runs that only grow; a run of failures is counted back to the last step with a
success.  No row holds the states of its window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions import moments
from tidegate.functions.scalars import DAY, HOUR, MICROS
from tidegate.operators.customer import aggregate, ratio_sql
from tidegate.operators.slices import LADDER, fit_slice, slice_sql

WINDOWS = {"1h": HOUR, "24h": DAY, "7d": 7 * DAY, "30d": 30 * DAY}
SHORT = {"10min": 600}
# what adds up, as SQL over the events
MEASURES = {
    "n": "1L", "amt": "amount", "failed": "_failed", "night": "cast(hour(ts) < 5 AS bigint)",
}


def states(txn: DataFrame, key: str, step_seconds: int, row_id: str, more: dict[str, str]) -> DataFrame:
    """One state per (entity ``_k``, step ``_s``); step s covers ``((s - 1) * step, s * step]``.

    ``e_`` columns hold the part at exactly the end of the step: windows include both bounds, so a
    window that begins there needs these events and no others of the step.  The runs of failures
    are taken by slices of a step, so no task needs a whole step of a hot entity.
    """
    rows = txn.filter(f"{key} IS NOT NULL AND ts IS NOT NULL")
    width = fit_slice(rows, [key], "ts", max(w for w in LADDER if step_seconds % w == 0))
    measures = {**MEASURES, **more}
    us, step = "unix_micros(ts)", step_seconds * MICROS
    # steps and slices are closed at their end
    rows = rows.selectExpr(
        f"{key} AS _k", f"{row_id} AS _id", "ts", "amount", f"{slice_sql(f'{us} - 1', step_seconds)} + 1 AS _s",
        f"{slice_sql(f'{us} - 1', width)} AS _slice", "cast(coalesce(status = 'FAILED', false) AS bigint) AS _failed",
        *[f"{v} AS _more_{m}" for m, v in more.items()],
    ).selectExpr(
        "*", f"_s * {step}L - unix_micros(ts) AS _left",
        "sum(1 - _failed) OVER (PARTITION BY _k, _slice ORDER BY ts DESC, _id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _ok_after",
    )
    value = {m: f"_more_{m}" if m in more else v for m, v in measures.items()}
    inner = {w: s for w, s in {**SHORT, **WINDOWS}.items() if s < step_seconds}
    sums = [f"sum({v}) AS {m}" for m, v in value.items()]
    sums += [f"sum(CASE WHEN _left = 0 THEN {v} END) AS e_{m}" for m, v in value.items()]
    sums += [f"sum(CASE WHEN _left <= {s * MICROS}L THEN {v} END) AS {m}_{w}" for w, s in inner.items() for m, v in value.items()]
    spread = {"m": "amount", "e_m": "CASE WHEN _left = 0 THEN amount END"}
    per_slice = aggregate(rows, ["_k", "_s", "_slice"], [
        *sums, "max(amount) AS top", "max(CASE WHEN _left = 0 THEN amount END) AS e_top",
        "sum(1 - _failed) AS ok", "count_if(_ok_after = 0) AS tail",
        "sum(CASE WHEN _left = 0 THEN 1 - _failed END) AS e_ok", "count_if(_left = 0 AND _ok_after = 0) AS e_tail",
        *[f"{e} AS {p}_{c}" for p, v in spread.items() for c, e in zip(("n", "mean", "m2"), moments.state(v))],
    ])
    step_rows = "OVER (PARTITION BY _k, _s)"
    marked = per_slice.selectExpr(
        "*", "coalesce(sum(ok) OVER (PARTITION BY _k, _s ORDER BY _slice DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _later_ok",
        *[f"sum({p}_n * {p}_mean) {step_rows} / nullif(sum({p}_n) {step_rows}, 0) AS _{p}_mean" for p in spread],
    )
    names = [*value, *[f"e_{m}" for m in value], *[f"{m}_{w}" for w in inner for m in value], "ok", "e_ok", "e_tail"]
    return aggregate(marked, ["_k", "_s"], [
        *[f"sum({c}) AS {c}" for c in names], "max(top) AS top", "max(e_top) AS e_top",
        "sum(CASE WHEN _later_ok = 0 THEN tail ELSE 0 END) AS tail",
        *[e for p in spread for e in (
            f"sum({p}_n) AS {p}_n", f"max(_{p}_mean) AS {p}_mean", f"sum({p}_m2 + {p}_n * pow({p}_mean - _{p}_mean, 2)) AS {p}_m2")],
    ])


def seen(txn: DataFrame, key: str, other: str, step_seconds: int, windows: Sequence[str]) -> DataFrame:
    """Changes per (entity, snapshot) of the number of distinct ``other`` in each window: ``d_{window}``.

    The visits of a value in one step are seen by the same snapshots.  Where the intervals of two
    steps overlap, the later one counts from where the earlier one ends.
    """
    us = "unix_micros(ts)"
    steps = {w: WINDOWS[w] // step_seconds for w in windows}
    visits = aggregate(
        txn.filter(f"{key} IS NOT NULL AND ts IS NOT NULL AND {other} IS NOT NULL").selectExpr(
            f"{key} AS _k", f"{other} AS _o", f"{slice_sql(f'{us} - 1', step_seconds)} + 1 AS _s",
            f"cast(pmod({us}, {step_seconds * MICROS}L) = 0 AS bigint) AS _end"),
        ["_k", "_o", "_s"], ["max(_end) AS _end"])
    along = "OVER (PARTITION BY _k, _o ORDER BY _s)"
    intervals = visits.selectExpr("_k", "_s", *[
        f"named_struct('from', greatest(_s, coalesce(lag(_s + _end) {along} + {k}, _s)), 'to', _s + _end + {k}) AS i_{w}" for w, k in steps.items()])
    none = ", ".join(f"'{w}', 0L" for w in windows)

    def change(w: str, at: str, by: int) -> str:
        values = none.replace(f"'{w}', 0L", f"'{w}', {by}L")
        return f"named_struct('s', i_{w}.{at}, {values})"

    changes = ", ".join(change(w, at, by) for w in windows for at, by in (("from", 1), ("to", -1)))
    return aggregate(
        intervals.selectExpr("_k", f"explode(array({changes})) AS _c"),
        ["_k", "_c.s"], [f"sum(_c.`{w}`) AS d_{w}" for w in windows]).withColumnRenamed("s", "_s")


def folded(
    txn: DataFrame, key: str, step_seconds: int = DAY, row_id: str = "transaction_id", other: str | None = None,
    distinct: Sequence[str] = (), more: dict[str, str] | None = None,
) -> DataFrame:
    """Windows at every multiple of ``step_seconds``: ``_k``, ``feature_timestamp`` and, per window w,
    ``n_w amt_w failed_w night_w`` and the sums of ``more``; ``top_30d``, ``std_30d``, ``streak`` and ``d_w``.

    A snapshot at T covers ``[T - w, T]``, both ends included.  An entity has a snapshot wherever
    it has an event in the 30 days before, up to the first step at or after the end of data.
    ``streak`` is the run of failures that ends at T; ``d_w`` counts distinct ``other``.
    """
    if step_seconds % HOUR:
        raise ValueError("the step must be a multiple of one hour")
    outer = {w: s // step_seconds for w, s in WINDOWS.items() if s >= step_seconds}
    for w in outer:
        if WINDOWS[w] % step_seconds:
            raise ValueError(f"the window {w} is no multiple of the step")
    if "30d" not in outer or not set(distinct) <= set(outer):
        raise ValueError("the step is longer than a window that needs whole steps")
    more = more or {}
    measures = [*MEASURES, *more]
    blocks = states(txn, key, step_seconds, row_id, more)
    reach = outer["30d"]
    end = txn.filter(f"{key} IS NOT NULL").agg(F.max("ts").alias("t")).selectExpr(
        f"{slice_sql('unix_micros(t) - 1', step_seconds)} + 1 AS s").first()["s"]
    # a state is followed by the snapshots that see it, up to the next state of the entity
    state_columns = ", ".join(c for c in blocks.columns if c not in ("_k", "_s"))
    along = "OVER (PARTITION BY _k ORDER BY _s"
    chain = blocks.selectExpr("_k", "_s", f"struct({state_columns}) AS _state", "e_n", "tail", "m_n", "m_mean", "m_m2", f"floor(_s / {reach}) AS _month").selectExpr(
        "*", f"least(_s + {reach - 1} + cast(coalesce(e_n, 0) > 0 AS bigint), coalesce(lead(_s) {along}) - 1, {end or 0}L), {end or 0}L) AS _to",
        f"sum(tail) {along} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _tails")
    for name, order in (("end", "DESC"), ("begin", "ASC")):
        chain = running_months(chain, name, order)
    spread = [f"{name}_{c}" for name in ("end", "begin") for c in ("n", "mean", "m2")]
    points = chain.selectExpr(
        "_k", "_s AS _own", "_to", "_state", f"struct(_s AS s, _month AS month, _tails AS tails, _tails - tail AS before, {', '.join(f'_{c} AS {c}' for c in spread)}) AS _run",
    ).selectExpr("_k", "_state", "_run", "_own", "explode(sequence(_own, greatest(_own, _to))) AS _s").selectExpr(
        "_k", "_s", "true AS _point", "CASE WHEN _s = _own THEN _run END AS _run", "CASE WHEN _s = _own THEN _state END AS _state",
    ).select("_k", "_s", "_point", "_run", "_state.*")
    if distinct:
        points = points.unionByName(seen(txn, key, other, step_seconds, distinct), allowMissingColumns=True)
    by_step = "OVER (PARTITION BY _k ORDER BY _s RANGE BETWEEN"
    out = []
    for w, k in outer.items():
        frame, edge = f"{by_step} {k - 1} PRECEDING AND CURRENT ROW)", f"{by_step} {k} PRECEDING AND {k} PRECEDING)"
        out += [f"coalesce(sum({m}) {frame}, 0) + coalesce(sum(e_{m}) {edge}, 0) AS w_{m}_{w}" for m in measures]
    month, start = f"{by_step} {reach - 1} PRECEDING AND CURRENT ROW)", f"{by_step} {reach} PRECEDING AND {reach} PRECEDING)"
    upto = f"{by_step} UNBOUNDED PRECEDING AND CURRENT ROW)"
    out += [
        f"greatest(max(top) {month}, max(e_top) {start}) AS top_30d",
        f"coalesce(sum(tail) {month}, 0) + coalesce(sum(e_tail) {start}, 0) AS _failed_month",
        f"first(_run, true) {month} AS _oldest", f"last(_run, true) {upto} AS _latest", f"last(CASE WHEN ok > 0 THEN _run END, true) {upto} AS _success",
        *[f"max(e_m_{c}) {start} AS _e_{c}" for c in ("n", "mean", "m2")],
        *[f"sum(d_{w}) {upto} AS _d_{w}" for w in distinct],
    ]
    folds = points.selectExpr("_k", "_s", "_point", *[f"{m}_{w} AS w_{m}_{w}" for w in {**SHORT, **WINDOWS} if w not in outer for m in measures], *out)
    # the end of one month of steps, the beginning of the next, and the events at exactly the start of the window
    this = f"floor(_s / {reach})"
    earlier = [f"CASE WHEN _oldest.month < {this} THEN _oldest.end_{c} END" for c in ("n", "mean", "m2")]
    later = [f"CASE WHEN _latest.month = {this} THEN _latest.begin_{c} END" for c in ("n", "mean", "m2")]
    parts = [tuple(earlier), tuple(later), ("_e_n", "_e_mean", "_e_m2")]
    n, mean = moments.merged(parts)
    folds = folds.filter("_point").selectExpr("*", f"{n} AS _n", f"{mean} AS _mean").selectExpr("*", f"{moments.merged_m2(parts, '_mean')} AS _m2")
    return folds.selectExpr(
        "_k", f"timestamp_micros(_s * {step_seconds * MICROS}L) AS feature_timestamp",
        *[f"coalesce(w_{m}_{w}, 0) AS {m}_{w}" for w in {**SHORT, **WINDOWS} for m in measures],
        "top_30d", f"{moments.std('_n', '_m2')} AS std_30d",
        f"CASE WHEN _success.s > _s - {reach} THEN _latest.tails - _success.before ELSE _failed_month END AS streak",
        *[f"coalesce(_d_{w}, 0) AS d_{w}" for w in distinct],
    )


def running_months(rows: DataFrame, name: str, order: str) -> DataFrame:
    """The state of the amounts from one end of a month of steps to each of its states: ``_{name}_n``, ``_mean``, ``_m2``."""
    for step in moments.running("coalesce(m_n, 0)", "m_mean", "m_m2", f"PARTITION BY _k, _month ORDER BY _s {order}"):
        rows = rows.selectExpr("*", *step)
    names = {f"_r{c}": f"_{name}_{c}" for c in ("n", "mean", "m2")}
    return rows.withColumnsRenamed(names).drop("_bn", "_bsum", "_inc")


def snapshot_history(txn: DataFrame, key: str, step_seconds: int = DAY, prefix: str = "cust") -> DataFrame:
    """Count, sum, mean and failures per window at every multiple of ``step_seconds``."""
    return folded(txn, key, step_seconds).selectExpr(
        f"_k AS {key}", "feature_timestamp",
        *[f"n_{w} AS {prefix}_txn_count_{w}" for w in WINDOWS],
        *[f"cast(amt_{w} AS double) AS {prefix}_txn_amount_sum_{w}" for w in WINDOWS],
        *[f"{ratio_sql(f'amt_{w}', f'n_{w}')} AS {prefix}_txn_amount_avg_{w}" for w in WINDOWS],
        *[f"failed_{w} AS {prefix}_failed_txn_count_{w}" for w in WINDOWS],
    )


def model_history(txn: DataFrame, key: str = "customer_id", other: str = "merchant_id", step_seconds: int = DAY) -> DataFrame:
    """The features that the risk model reads, at every multiple of ``step_seconds``."""
    return folded(txn, key, step_seconds, other=other, distinct=["7d"]).selectExpr(
        f"_k AS {key}", "feature_timestamp",
        *[f"n_{w} AS cust_txn_count_{w}" for w in ("1h", "24h", "7d")],
        *[f"cast(amt_{w} AS double) AS cust_txn_amount_sum_{w}" for w in ("1h", "24h")],
        f"{ratio_sql('amt_7d', 'n_7d')} AS cust_txn_amount_avg_7d",
        "failed_24h AS cust_failed_txn_count_24h", "d_7d AS cust_unique_merchants_7d",
        "least(n_30d / 50D, 1D) AS cust_activity_score",
        f"{ratio_sql('night_30d', 'n_30d')} AS cust_night_owl_ratio_30d",
        f"{ratio_sql('failed_7d', 'n_7d')} AS cust_declined_ratio_7d",
        "least(1D, 0.3D * n_1h + 0.7D * failed_24h) AS cust_risk_velocity_composite",
        "streak AS consecutive_failed_auth_count",
        f"std_30d / ({ratio_sql('amt_30d', 'n_30d')} + 1e-5D) AS amount_dispersion_index_30d",
        "n_10min AS burst_txn_count_10min", "cast(amt_10min AS double) AS burst_txn_amount_10min",
    )


def merchant_history(txn: DataFrame, step_seconds: int = DAY) -> DataFrame:
    """Volume, fraud, declines, reach and largest amount of every merchant at every multiple of ``step_seconds``."""
    return folded(txn, "merchant_id", step_seconds, other="customer_id", distinct=["24h", "7d", "30d"], more={
        "fraud": "cast(is_fraud AS bigint)", "refunded": "CASE WHEN status = 'REFUNDED' THEN amount END"},
    ).selectExpr(
        "_k AS merchant_id", "feature_timestamp",
        *[f"n_{w} AS merch_txn_count_{w}" for w in WINDOWS],
        *[f"{ratio_sql(f'amt_{w}', f'n_{w}')} AS merch_avg_txn_amount_{w}" for w in ("24h", "7d", "30d")],
        *[f"{ratio_sql(f'fraud_{w}', f'n_{w}')} AS merch_fraud_rate_{w}" for w in ("7d", "30d")],
        *[f"{ratio_sql(f'failed_{w}', f'n_{w}')} AS merch_declined_txn_rate_{w}" for w in ("24h", "7d")],
        *[f"d_{w} AS merch_unique_customers_{w}" for w in ("24h", "7d", "30d")],
        "top_30d AS merch_max_txn_amount_30d",
        "least(n_1h / (n_24h / 24D + 1e-5D), 10D) AS merch_velocity_spike_index",
        f"{ratio_sql('refunded_30d', 'amt_30d')} AS merch_refund_ratio_30d",
    )
