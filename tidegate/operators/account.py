"""Account features of one snapshot time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions import moments
from tidegate.functions.scalars import DAY
from tidegate.operators.customer import (
    DEFAULTS, UNUSUAL_HOUR, RiskParams, aggregate, daily_profile, in_horizon, instant, profile, ratio_sql, since,
    visited,
)
from tidegate.operators.slices import Running, running

SPANS = {"24h": DAY, "7d": 7 * DAY, "30d": 30 * DAY}


def overdraft_counts(txn: DataFrame, accounts: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Times in 30 days an account's balance crossed below zero.

    Balances are rebuilt backwards from the current one: the balance after an event is the
    current balance plus the settled amounts of all later events.
    """
    settled = in_horizon(txn, "account_id", as_of).filter("status != 'FAILED'").select(
        "account_id", "transaction_id", "ts", "amount"
    )
    later = running(
        settled, ["account_id"], "ts", "transaction_id",
        {"spent_later": Running(F.col("amount"), exclusive=True)}, descending=True,
    )
    after = later.join(accounts.select("account_id", "current_balance"), "account_id", "inner").selectExpr(
        "account_id", "amount", "current_balance + coalesce(spent_later, 0D) AS balance_after"
    )
    return aggregate(after, ["account_id"], ["count_if(balance_after < 0 AND balance_after + amount >= 0) AS overdrafts"])


def account_features(
    txn: DataFrame,
    accounts: DataFrame,
    as_of: dt.datetime,
    history: DataFrame | None = None,
    params: RiskParams = DEFAULTS,
) -> DataFrame:
    """All account features at ``as_of``, one row per account with an event in 30 days."""
    extremes = aggregate(in_horizon(txn, "account_id", as_of), ["account_id"], [
        f"max(CASE WHEN {since(as_of, SPANS['7d'])} THEN amount END) AS max_7d",
        "max(amount) AS max_30d", "min(amount) AS min_30d",
        *[f"count_if({since(as_of, s)} AND amount > {params.high_value}D) AS high_{w}" for w, s in SPANS.items()],
    ])
    firsts = aggregate(visited(history if history is not None else txn, "account_id", as_of), ["account_id"], [
        "min(first_ts) AS first_event",
        f"count_if(merchant_id IS NOT NULL AND {since(as_of, SPANS['7d'], 'first_ts')}) AS new_7d",
    ])
    f = (
        profile(daily_profile(txn, "account_id", as_of, params), "account_id", as_of, params)
        .join(extremes, "account_id", "inner")
        .join(firsts, "account_id", "left")
        .join(overdraft_counts(txn, accounts, as_of), "account_id", "left")
        .join(
            accounts.selectExpr("account_id", "account_type", "created_at", "current_balance AS balance", "credit_limit"),
            "account_id", "left",
        )
    )

    def spend(w: str) -> str:
        return f"coalesce(amt_{w}, 0D)"

    def drained(w: str) -> str:
        return ratio_sql(spend(w), f"(balance + {spend(w)})")

    cap = f"{params.streak_cap}D"
    takeover = (f"(least(1D, fail_streak / {cap}) + least(1D, coalesce(new_7d, 0) / {cap}) + {UNUSUAL_HOUR}) / 3D")
    return f.selectExpr(
        "account_id",
        f"{instant(as_of)} AS feature_timestamp",
        *[f"{ratio_sql(spend(w), 'balance')} AS acc_balance_ratio_{w}" for w in ("24h", "7d")],
        f"cast(datediff({instant(as_of)}, created_at) AS bigint) AS acc_age_days",
        "balance AS acc_current_balance",
        *[f"{spend(w)} / {d}D AS acc_avg_daily_spend_{w}" for w, d in (("7d", 7), ("14d", 14), ("30d", 30))],
        "coalesce(max_7d, 0D) AS acc_max_txn_amount_7d", "max_30d AS acc_max_txn_amount_30d",
        "min_30d AS acc_min_txn_amount_30d",
        f"{moments.std('amt_n', 'amt_m2')} AS acc_stddev_txn_amount_30d",
        *[f"{drained(w)} AS acc_balance_drain_rate_{w}" for w in ("24h", "7d")],
        *[f"high_{w} AS acc_high_val_txn_count_{w}" for w in SPANS],
        "cast(coalesce(balance < 0, false) AS bigint) AS acc_is_overdrawn_flag",
        "coalesce(overdrafts, 0) AS acc_overdraft_count_30d",
        f"CASE WHEN account_type = 'CREDIT' THEN {ratio_sql('greatest(0D, credit_limit - balance)', 'credit_limit')} END "
        "AS acc_credit_utilization_ratio",
        f"cast(datediff({instant(as_of)}, first_event) AS bigint) AS acc_days_since_first_txn",
        f"least(1D, {drained('24h')}) AS acc_rapid_depletion_score",
        f"least(1D, atm_streak / {cap}) AS atm_cash_drain_score_24h",
        f"least(1D, {takeover}) AS account_takeover_risk_index",
    )
