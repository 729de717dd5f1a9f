"""Customer features of one snapshot time: velocity, behaviour, risk.

Two passes over the transactions.  The first shuffles the last 30 days by (customer, day)
for everything that needs the order of events (gaps, streaks) and rolls up to one row per
customer and day (or shorter slice), then to one row per customer.  The second reduces to one row per
(customer, merchant) with map-side combine, from which all distinct counts and all
features that depend on merchant attributes follow without a distinct aggregate.

Expressions are SQL text: a plan has hundreds of them, and one text is one call to the JVM.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions import moments
from tidegate.functions.scalars import DAY, HOUR
from tidegate.operators.slices import Running, fit_slice, running, slice_sql, with_previous
from tidegate.sources.tables import CHANNELS

WINDOWS = {"1h": HOUR, "6h": 6 * HOUR, "12h": 12 * HOUR, "24h": DAY, "3d": 3 * DAY,
           "7d": 7 * DAY, "14d": 14 * DAY, "30d": 30 * DAY}
HORIZON = WINDOWS["30d"]


@dataclass(frozen=True)
class RiskParams:
    """Thresholds of the pattern features."""

    high_value: float = 1000.0
    micro_amount: float = 5.0
    micro_count: int = 3
    reporting_threshold: float = 10000.0
    structuring_count: int = 2
    high_risk_score: float = 0.5
    default_risk: float = 0.1
    repeat_seconds: int = 120
    streak_cap: float = 5.0


DEFAULTS = RiskParams()


def instant(as_of: dt.datetime) -> str:
    """SQL literal of a snapshot time (UTC)."""
    return f"timestamp'{as_of:%Y-%m-%d %H:%M:%S.%f} UTC'"


def since(as_of: dt.datetime, seconds: int, ts: str = "ts") -> str:
    """SQL: inside ``[as_of - seconds, ...]``; the lower bound is inclusive."""
    return f"{ts} >= {instant(as_of - dt.timedelta(seconds=seconds))}"


def ratio_sql(num: str, den: str) -> str:
    """SQL: num / den, 0 where undefined."""
    return f"coalesce(cast({num} AS double) / nullif(cast({den} AS double), 0D), 0D)"


def in_horizon(txn: DataFrame, key: str, as_of: dt.datetime) -> DataFrame:
    return txn.filter(f"{key} IS NOT NULL AND {since(as_of, HORIZON)} AND ts <= {instant(as_of)}")


def flag_columns(txn: DataFrame) -> DataFrame:
    """The 0/1 flags every aggregate is built from."""
    return txn.selectExpr(
        "*", "cast(status = 'FAILED' AS int) AS is_failed", "cast(hour(ts) < 5 AS int) AS is_night",
        "cast(weekday(ts) >= 5 AS int) AS is_weekend",
        *[f"cast(channel = '{c}' AS int) AS on_{c.lower()}" for c in CHANNELS],
    )


def aggregate(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Grouped aggregate from SQL texts ``<aggregate> AS <name>``."""
    from pyspark.sql import functions as F

    return df.groupBy(*keys).agg(*[F.expr(m) for m in measures])


def velocity(txn: DataFrame, key: str, as_of: dt.datetime) -> DataFrame:
    """Counts, sums, means and failures per window by one grouped aggregate."""
    measures = []
    for name, seconds in WINDOWS.items():
        inside = since(as_of, seconds)
        measures.append(f"count_if({inside}) AS n_{name}")
        if name in ("1h", "6h", "24h", "7d", "30d"):
            measures.append(f"sum(CASE WHEN {inside} THEN amount END) AS amt_{name}")
        if name in ("1h", "24h", "7d", "30d"):
            measures.append(f"avg(CASE WHEN {inside} THEN amount END) AS avg_{name}")
            measures.append(f"count_if({inside} AND status = 'FAILED') AS failed_{name}")
    return aggregate(in_horizon(txn, key, as_of), [key], measures)


def velocity_features(txn: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The customer_velocity group except its distinct counts (see ``visited``)."""
    return velocity(txn, "customer_id", as_of).selectExpr(
        "customer_id",
        *[f"n_{w} AS cust_txn_count_{w}" for w in WINDOWS],
        *[f"coalesce(amt_{w}, 0D) AS cust_txn_amount_sum_{w}" for w in ("1h", "6h", "24h", "7d", "30d")],
        *[f"coalesce(avg_{w}, 0D) AS cust_txn_amount_avg_{w}" for w in ("1h", "24h", "7d", "30d")],
        *[f"failed_{w} AS cust_failed_txn_count_{w}" for w in ("1h", "24h", "7d")],
    )


def daily_profile(txn: DataFrame, key: str, as_of: dt.datetime, params: RiskParams = DEFAULTS) -> DataFrame:
    """One row per (key, slice) of the last 30 days with everything that adds up over slices.

    Slices are days, or shorter if a key is too hot for that.  Gaps and trailing failure
    streaks are taken inside the shuffle by (key, slice), so a key of any size is spread
    over its slices; gaps across their borders follow in ``profile``.
    """
    recent = in_horizon(txn, key, as_of)
    part = f"(PARTITION BY {key}, _slice ORDER BY ts, transaction_id)"
    back = (f"(PARTITION BY {key}, _slice ORDER BY ts DESC, transaction_id DESC "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    rows = flag_columns(recent).selectExpr(
        "*", f"{slice_sql('unix_micros(ts)', fit_slice(recent, [key], 'ts'))} AS _slice"
    ).selectExpr(
        "*",
        f"(unix_micros(ts) - unix_micros(lag(ts) OVER {part})) / 1e6D AS _gap",
        f"sum(1 - is_failed) OVER {back} AS _ok_after",
        f"sum(1 - on_atm) OVER {back} AS _not_atm_after",
        "cast(hour(ts) DIV 6 AS int) AS _band",
    )
    in_1h, in_24h = since(as_of, HOUR), since(as_of, DAY)
    low, high = 0.9 * params.reporting_threshold, params.reporting_threshold
    measures = []
    for w, seconds in WINDOWS.items():
        inside = since(as_of, seconds)
        measures += [
            f"count_if({inside}) AS n_{w}",
            f"sum(CASE WHEN {inside} THEN amount END) AS amt_{w}",
            f"count_if({inside} AND is_failed = 1) AS failed_{w}",
        ]
    measures += [
        *[f"{e} AS amt_{c}" for c, e in zip(("n", "mean", "m2"), moments.state("amount"))],
        "sum(is_night) AS night",
        "sum(CASE WHEN is_weekend = 1 THEN amount END) AS weekend_amt",
        *[f"sum(on_{c.lower()}) AS on_{c.lower()}" for c in CHANNELS],
        *[f"max(CASE WHEN {in_24h} THEN on_{c.lower()} END) AS seen_{c.lower()}" for c in CHANNELS],
        "count(_gap) AS gaps", "sum(_gap) AS gap_sum", "var_pop(_gap) * count(_gap) AS gap_m2",
        f"count_if({in_24h} AND _gap <= {params.repeat_seconds}) AS repeats_24h",
        *[f"count_if(_band = {b}) AS band_{b}" for b in range(4)],
        "min(ts) AS first_ts",
        "max(struct(ts, transaction_id, _band, _gap)) AS last",
        "count_if(_ok_after = 0) AS fail_tail", "sum(1 - is_failed) AS ok",
        f"count_if({in_24h} AND _not_atm_after = 0) AS atm_tail", "sum(1 - on_atm) AS not_atm",
        f"count_if({in_1h} AND amount < {params.micro_amount}D) AS micro_1h",
        f"count_if({in_24h} AND amount >= {low}D AND amount < {high}D) AS structured_24h",
        f"count_if({since(as_of, 600)}) AS n_10min",
        f"sum(CASE WHEN {since(as_of, 600)} THEN amount END) AS amt_10min",
    ]
    return aggregate(rows, [key, "_slice"], measures)


def profile(days: DataFrame, key: str, as_of: dt.datetime, params: RiskParams = DEFAULTS) -> DataFrame:
    """Roll ``daily_profile`` up to one row per key; a key has one row per slice here."""
    later = f"(PARTITION BY {key} ORDER BY _slice DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    marked = days.selectExpr(
        "*",
        f"coalesce(sum(ok) OVER {later}, 0) AS _later_ok",
        f"coalesce(sum(not_atm) OVER {later}, 0) AS _later_not_atm",
        f"(unix_micros(first_ts) - unix_micros(lag(last.ts) OVER (PARTITION BY {key} ORDER BY _slice))) / 1e6D AS _join_gap",
        # slices never cross midnight; without finer ones this is the slice itself
        f"sum(n_30d) OVER (PARTITION BY {key}, to_date(first_ts)) AS _day_n",
        f"sum(amt_30d) OVER (PARTITION BY {key}, to_date(first_ts)) AS _day_amt",
        f"sum(amt_n * amt_mean) OVER (PARTITION BY {key}) / nullif(sum(amt_n) OVER (PARTITION BY {key}), 0) AS _amt_mean",
    ).selectExpr(
        "*",
        f"(coalesce(sum(gap_sum) OVER (PARTITION BY {key}), 0D) + coalesce(sum(_join_gap) OVER (PARTITION BY {key}), 0D))"
        f" / nullif(sum(gaps) OVER (PARTITION BY {key}) + count(_join_gap) OVER (PARTITION BY {key}), 0) AS _gap_mean",
    )
    added = [c for w in WINDOWS for c in (f"n_{w}", f"amt_{w}", f"failed_{w}")] + [
        "amt_n", "night", "weekend_amt", *[f"on_{c.lower()}" for c in CHANNELS],
        *[f"band_{b}" for b in range(4)], "micro_1h", "structured_24h", "n_10min", "amt_10min",
    ]
    return aggregate(marked, [key], [
        *[f"sum({c}) AS {c}" for c in added],
        *[f"max(seen_{c.lower()}) AS seen_{c.lower()}" for c in CHANNELS],
        "sum(gaps) + count(_join_gap) AS gaps",
        "coalesce(sum(gap_sum), 0D) + coalesce(sum(_join_gap), 0D) AS gap_sum",
        "coalesce(sum(amt_m2 + amt_n * pow(amt_mean - _amt_mean, 2)), 0D) AS amt_m2",
        "coalesce(sum(gap_m2 + gaps * pow(gap_sum / nullif(gaps, 0) - _gap_mean, 2)), 0D)"
        " + coalesce(sum(pow(_join_gap - _gap_mean, 2)), 0D) AS gap_m2",
        f"sum(repeats_24h) + count_if({since(as_of, DAY, 'first_ts')} AND _join_gap <= {params.repeat_seconds}) AS repeats_24h",
        "max(struct(last.ts, last.transaction_id, last._band, coalesce(last._gap, _join_gap) AS _gap)) AS last",
        "max(_day_n) AS best_day_n", "max(_day_amt) AS best_day_amt",
        "sum(CASE WHEN _later_ok = 0 THEN fail_tail ELSE 0 END) AS fail_streak",
        "sum(CASE WHEN _later_not_atm = 0 THEN atm_tail ELSE 0 END) AS atm_streak",
    ])


def visited(txn: DataFrame, key: str, as_of: dt.datetime) -> DataFrame:
    """One row per (key, merchant) over all history up to ``as_of``.

    A column ``first_ts`` marks rows that stand for several visits (see ``sources.visits``).
    """
    first = "first_ts" if "first_ts" in txn.columns else "ts"
    month, week = since(as_of, HORIZON), since(as_of, WINDOWS["7d"])
    return aggregate(txn.filter(f"ts <= {instant(as_of)} AND {key} IS NOT NULL"), [key, "merchant_id"], [
        f"min({first}) AS first_ts", "max(ts) AS last_ts", f"max(CASE WHEN NOT ({month}) THEN ts END) AS older_ts",
        f"count_if({week}) AS n_7d", f"count_if({month}) AS n_30d",
        f"sum(CASE WHEN {week} THEN amount END) AS amt_7d", f"sum(CASE WHEN {month} THEN amount END) AS amt_30d",
    ])


def merchant_habits(
    pairs: DataFrame,
    customers: DataFrame,
    merchants: DataFrame,
    as_of: dt.datetime,
    params: RiskParams = DEFAULTS,
) -> DataFrame:
    """Per customer: distinct and new merchants, cross-border counts, risk spend, entropy, centrality."""
    degree = aggregate(pairs.filter("n_30d > 0 AND merchant_id IS NOT NULL"), ["merchant_id"], ["count(1) - 1 AS others"])
    traits = merchants.selectExpr("merchant_id", "merchant_category", "risk_score", "country AS merchant_country")
    homes = customers.selectExpr("customer_id", "country AS home_country")
    rich = (
        pairs.join(traits, "merchant_id", "left")
        .join(degree, "merchant_id", "left")
        .join(homes, "customer_id", "left")
        .selectExpr(
            "*", "merchant_id IS NOT NULL AS known", "home_country != merchant_country AS abroad",
            f"coalesce(risk_score, {params.default_risk}D) > {params.high_risk_score}D AS risky",
        )
    )
    week = WINDOWS["7d"]
    # a null category (unknown merchant) is a category of its own
    per_category = aggregate(rich, ["customer_id", "merchant_category"], [
        f"count_if(known AND {since(as_of, DAY, 'last_ts')}) AS uniq_24h",
        f"count_if(known AND {since(as_of, week, 'last_ts')}) AS uniq_7d",
        f"count_if(known AND {since(as_of, week, 'first_ts')}) AS new_7d",
        f"count_if(known AND {since(as_of, HORIZON, 'first_ts')}) AS new_30d",
        *[f"sum(CASE WHEN abroad THEN n_{w} END) AS abroad_{w}" for w in ("7d", "30d")],
        *[f"sum(CASE WHEN risky THEN amt_{w} END) AS risky_{w}" for w in ("7d", "30d")],
        "sum(n_30d) AS n_30d", "sum(amt_7d) AS amt_7d", "sum(amt_30d) AS amt_30d", "max(older_ts) AS older_ts",
        "sum(CASE WHEN n_30d > 0 THEN others END) AS shared",
    ])
    counts = ["uniq_24h", "uniq_7d", "new_7d", "new_30d", "abroad_7d", "abroad_30d", "shared"]
    per_customer = aggregate(per_category, ["customer_id"], [
        *[f"coalesce(sum({c}), 0) AS h_{c}" for c in counts],
        *[f"sum({c}) AS {c}" for c in ("risky_7d", "risky_30d", "amt_7d", "amt_30d")],
        "cast(sum(n_30d) AS double) AS n",
        "sum(n_30d * ln(nullif(cast(n_30d AS double), 0D))) AS n_log_n",
        "max(older_ts) AS h_older_ts",
    ])
    return per_customer.selectExpr(
        "customer_id", *[f"h_{c}" for c in counts],
        ratio_sql("risky_7d", "amt_7d") + " AS h_risky_7d", ratio_sql("risky_30d", "amt_30d") + " AS h_risky_30d",
        "coalesce(greatest(ln(nullif(n, 0D)) - n_log_n / nullif(n, 0D), 0D), 0D) AS h_entropy", "h_older_ts",
    )


# 1 minus the share of events in the 6-hour band of the latest event
UNUSUAL_HOUR = "1D - " + ratio_sql(
    "CASE last._band WHEN 0 THEN band_0 WHEN 1 THEN band_1 WHEN 2 THEN band_2 ELSE band_3 END", "n_30d"
)


def customer_features(
    txn: DataFrame,
    customers: DataFrame,
    merchants: DataFrame,
    as_of: dt.datetime,
    history: DataFrame | None = None,
    params: RiskParams = DEFAULTS,
) -> DataFrame:
    """All customer features at ``as_of``, one row per customer with an event in 30 days.

    ``history`` is the unrestricted transaction table, or the short one that
    ``sources.visits.history`` makes of a kept table; pass it when ``txn`` is already cut to the last 30 days (so that the cut reaches the scan).
    """
    p = profile(daily_profile(txn, "customer_id", as_of, params), "customer_id", as_of, params)
    habits = merchant_habits(
        visited(history if history is not None else txn, "customer_id", as_of),
        customers, merchants, as_of, params,
    )
    # the gap before the latest event may reach back beyond the 30 days
    last_gap = "coalesce(last._gap, (unix_micros(last.ts) - unix_micros(h_older_ts)) / 1e6D, 0D)"
    channel_max = "greatest(" + ", ".join(f"on_{c.lower()}" for c in CHANNELS) + ")"
    channels_24h = " + ".join(f"coalesce(seen_{c.lower()}, 0)" for c in CHANNELS)

    def count(c: str) -> str:
        return f"cast(coalesce({c}, 0) AS bigint)"

    return p.join(habits, "customer_id", "left").selectExpr(
        "customer_id",
        f"{instant(as_of)} AS feature_timestamp",
        # customer_velocity
        *[f"{count(f'n_{w}')} AS cust_txn_count_{w}" for w in WINDOWS],
        *[f"coalesce(amt_{w}, 0D) AS cust_txn_amount_sum_{w}" for w in ("1h", "6h", "24h", "7d", "30d")],
        *[f"{ratio_sql(f'amt_{w}', f'n_{w}')} AS cust_txn_amount_avg_{w}" for w in ("1h", "24h", "7d", "30d")],
        *[f"{count(f'failed_{w}')} AS cust_failed_txn_count_{w}" for w in ("1h", "24h", "7d")],
        *[f"{count(f'h_uniq_{w}')} AS cust_unique_merchants_{w}" for w in ("24h", "7d")],
        # temporal_behavioral
        "least(n_30d / 50D, 1D) AS cust_activity_score",
        f"{ratio_sql('night', 'n_30d')} AS cust_night_owl_ratio_30d",
        f"{ratio_sql('coalesce(weekend_amt, 0D)', 'amt_30d')} AS cust_weekend_spend_ratio_30d",
        f"{ratio_sql(channel_max, 'n_30d')} AS cust_preferred_channel_ratio_30d",
        *[f"{count(f'h_new_{w}')} AS cust_new_merchants_count_{w}" for w in ("7d", "30d")],
        *[f"{count(f'h_abroad_{w}')} AS cust_cross_border_count_{w}" for w in ("7d", "30d")],
        f"{ratio_sql('gap_sum', 'gaps')} / {DAY} AS cust_avg_days_between_txns_30d",
        f"{moments.std('gaps', 'gap_m2')} / {DAY} AS cust_stddev_days_between_txns_30d",
        "coalesce(h_entropy, 0D) AS cust_preferred_category_entropy_30d",
        *[f"{ratio_sql(f'on_{c}', 'n_30d')} AS cust_{n}_usage_ratio_30d"
          for c, n in (("mobile_app", "mobile"), ("pos", "pos"), ("wire", "wire"))],
        *[f"{ratio_sql(f'failed_{w}', f'n_{w}')} AS cust_declined_ratio_{w}" for w in ("7d", "30d")],
        f"{count('best_day_n')} AS cust_max_daily_txn_count_30d",
        "coalesce(best_day_amt, 0D) AS cust_max_daily_spend_30d",
        f"cast(floor({last_gap} / {DAY}) AS bigint) AS cust_dormancy_days_before_latest_txn",
        f"{count('repeats_24h')} AS cust_rapid_repeat_txn_count_24h",
        # velocity_and_risk_scores
        "least(1D, 0.3D * n_1h + 0.7D * failed_24h) AS cust_risk_velocity_composite",
        f"{count('fail_streak')} AS consecutive_failed_auth_count",
        f"{UNUSUAL_HOUR} AS unusual_hour_spending_index",
        f"({moments.std('amt_n', 'amt_m2')}) / ({ratio_sql('amt_30d', 'n_30d')} + 1e-5D) AS amount_dispersion_index_30d",
        *[f"coalesce(h_risky_{w}, 0D) AS high_risk_merchant_spend_ratio_{w}" for w in ("7d", "30d")],
        f"cast(micro_1h >= {params.micro_count} AS bigint) AS card_testing_pattern_flag",
        f"cast(structured_24h >= {params.structuring_count} AS bigint) AS structuring_pattern_flag",
        f"{count('n_10min')} AS burst_txn_count_10min",
        "coalesce(amt_10min, 0D) AS burst_txn_amount_10min",
        f"({channels_24h}) / {len(CHANNELS)}D AS device_fingerprint_anomaly_score",
        # d / (d + 100) keeps the degree in [0, 1) on a graph of any size
        "coalesce(h_shared / (h_shared + 100D), 0D) AS network_risk_centrality_score",
    )


def sessions(txn: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Customer sessions: runs of events closer together than the gap, by slices of a customer's time.

    A session starts where the event before is a gap or more away; its number is a running
    count, so no task needs a whole customer.
    """
    rows = txn.filter("customer_id IS NOT NULL AND ts IS NOT NULL").select("customer_id", "ts", "transaction_id")
    order = ["customer_id"], "ts", "transaction_id"
    width = fit_slice(rows, ["customer_id"], "ts")
    marked = with_previous(rows, *order, slice_seconds=width).withColumn("_new", F.expr(
        f"CASE WHEN _prev IS NULL OR unix_micros(ts) - unix_micros(_prev.ts) >= {gap_seconds} * 1000000L THEN 1L ELSE 0L END"))
    numbered = running(marked, *order, {"_session": Running(F.col("_new"))}, width)
    return numbered.groupBy("customer_id", "_session").agg(
        F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("events"), F.max("ts").alias("_last")
    ).selectExpr("customer_id", "created_at", "events",
                 "cast(round((unix_micros(_last) - unix_micros(created_at)) / 1e6) AS bigint) AS duration_seconds")
