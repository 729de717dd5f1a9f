"""Merchant features of one snapshot time, from one pass reduced to (merchant, customer) pairs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from tidegate.functions.scalars import DAY, HOUR
from tidegate.operators.customer import DEFAULTS, RiskParams, aggregate, in_horizon, instant, ratio_sql, since
from tidegate.sources.tables import HIGH_RISK_CATEGORIES

WINDOWS = {"1h": HOUR, "24h": DAY, "7d": 7 * DAY, "30d": 30 * DAY}


def merchant_pairs(txn: DataFrame, as_of: dt.datetime) -> DataFrame:
    """One row per (merchant, customer) of the last 30 days; all measures add up over pairs."""
    measures = ["max(amount) AS max_amount", "sum(CASE WHEN status = 'REFUNDED' THEN amount END) AS refunded"]
    for w, seconds in WINDOWS.items():
        inside = since(as_of, seconds)
        measures += [
            f"count_if({inside}) AS n_{w}",
            f"sum(CASE WHEN {inside} THEN amount END) AS amt_{w}",
            f"count_if({inside} AND status = 'FAILED') AS failed_{w}",
            f"sum(CASE WHEN {inside} THEN is_fraud END) AS fraud_{w}",
        ]
    return aggregate(in_horizon(txn, "merchant_id", as_of), ["merchant_id", "customer_id"], measures)


def merchant_features(
    txn: DataFrame,
    customers: DataFrame,
    merchants: DataFrame,
    as_of: dt.datetime,
    params: RiskParams = DEFAULTS,
) -> DataFrame:
    """All merchant features at ``as_of``, one row per merchant with an event in 30 days."""
    homes = customers.selectExpr("customer_id", "country AS home_country")
    traits = merchants.selectExpr("merchant_id", "merchant_category", "risk_score", "country AS merchant_country")
    rich = merchant_pairs(txn, as_of).join(homes, "customer_id", "left").join(traits, "merchant_id", "left")
    added = [f"{m}_{w}" for w in WINDOWS for m in ("n", "amt", "failed", "fraud")] + ["refunded"]
    f = aggregate(rich, ["merchant_id"], [
        *[f"sum({c}) AS {c}" for c in added],
        *[f"count_if(customer_id IS NOT NULL AND n_{w} > 0) AS cust_{w}" for w in ("24h", "7d", "30d")],
        "max(max_amount) AS max_amount", "max(amt_30d) AS top_customer",
        "sum(CASE WHEN home_country != merchant_country THEN n_7d END) AS abroad_7d",
        f"coalesce(max(risk_score), {params.default_risk}D) AS risk", "max(merchant_category) AS category",
    ])
    risky = ", ".join(f"'{c}'" for c in HIGH_RISK_CATEGORIES)
    return f.selectExpr(
        "merchant_id",
        f"{instant(as_of)} AS feature_timestamp",
        "risk AS merch_risk_score",
        *[f"n_{w} AS merch_txn_count_{w}" for w in WINDOWS],
        *[f"{ratio_sql(f'amt_{w}', f'n_{w}')} AS merch_avg_txn_amount_{w}" for w in ("24h", "7d", "30d")],
        *[f"{ratio_sql(f'fraud_{w}', f'n_{w}')} AS merch_fraud_rate_{w}" for w in ("7d", "30d")],
        *[f"{ratio_sql(f'failed_{w}', f'n_{w}')} AS merch_declined_txn_rate_{w}" for w in ("24h", "7d")],
        *[f"cust_{w} AS merch_unique_customers_{w}" for w in ("24h", "7d", "30d")],
        f"cast(coalesce(category IN ({risky}), false) AS bigint) AS merch_high_risk_cat_flag",
        f"{ratio_sql('coalesce(abroad_7d, 0)', 'n_7d')} AS merch_cross_border_ratio_7d",
        "max_amount AS merch_max_txn_amount_30d",
        "least(n_1h / (n_24h / 24D + 1e-5D), 10D) AS merch_velocity_spike_index",
        f"{ratio_sql('coalesce(refunded, 0D)', 'amt_30d')} AS merch_refund_ratio_30d",
        "risk * 1.2D AS merch_category_risk_index",
        f"{ratio_sql('top_customer', 'amt_30d')} AS merchant_collusion_risk_score",
    )
