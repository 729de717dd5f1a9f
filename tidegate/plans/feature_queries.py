"""Registered queries: features, joins, windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidegate.functions.scalars import DAY, HOUR
from tidegate.operators import account, asof, customer, merchant, spine, training, transaction
from tidegate.operators.customer import RiskParams
from tidegate.operators.slices import trailing
from tidegate.plans.registry import query, r
from tidegate.session import stage_table
from tidegate.sources import tables as t

# amounts in the supplied events stay below 500, so the thresholds are set to match
PARAMS = RiskParams(high_value=100.0, reporting_threshold=300.0)

TXN = """
txn AS (
  SELECT event_id AS transaction_id, user_id AS customer_id, user_id AS account_id,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS merchant_id, value AS amount, ts,
         CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'REFUNDED' ELSE 'APPROVED' END AS status,
         ['WEB','MOBILE_APP','POS','ATM','WIRE'][CAST(event_id % 5 AS INTEGER) + 1] AS channel,
         CASE WHEN event_type = 'purchase' AND value > 100 THEN 1 ELSE 0 END AS is_fraud
  FROM events),
now_at AS (SELECT max(ts) AS t FROM events),
cust AS (SELECT c_custkey AS customer_id, n_name AS country FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
merch AS (
  SELECT s_suppkey AS merchant_id, n_name AS country,
         ['RETAIL','GROCERY','TRAVEL','CRYPTO','GAMBLING','DINING','ELECTRONICS'][CAST(s_suppkey % 7 AS INTEGER) + 1] AS merchant_category,
         least(1.0, greatest(0.01, (s_acctbal + 1000) / 11000)) AS risk_score
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""

HOURS = {"1h": 1, "6h": 6, "12h": 12, "24h": 24, "3d": 72, "7d": 168, "14d": 336, "30d": 720}


def inside(window: str, ts: str = "ts", now: str = "t") -> str:
    return f"{ts} >= {now} - INTERVAL {HOURS[window]} HOUR"


def bound(spark, sf, history: bool = False):
    """(snapshot time, transactions of the last 30 days with the bounds pushed into the scan)."""
    now = t.latest_event_time(spark, sf)
    return now, t.bind_transactions(spark, sf, now - dt.timedelta(days=30), now)


# -- customer velocity -----------------------------------------------------------------

def velocity_sql(cutoff: str = "t") -> str:
    parts = [f"count(*) FILTER ({inside(w, now='n.t')}) AS cust_txn_count_{w}" for w in HOURS]
    for w in ("1h", "6h", "24h", "7d", "30d"):
        parts.append(r(f"coalesce(sum(amount) FILTER ({inside(w, now='n.t')}), 0)") + f" AS cust_txn_amount_sum_{w}")
    for w in ("1h", "24h", "7d", "30d"):
        parts.append(r(f"coalesce(avg(amount) FILTER ({inside(w, now='n.t')}), 0)") + f" AS cust_txn_amount_avg_{w}")
    for w in ("1h", "24h", "7d"):
        parts.append(f"count(*) FILTER ({inside(w, now='n.t')} AND status = 'FAILED') AS cust_failed_txn_count_{w}")
    return f"""WITH {TXN}, n AS (SELECT {cutoff} AS t FROM now_at)
SELECT customer_id, {", ".join(parts)}
FROM txn, n WHERE {inside("30d", now="n.t")} AND ts <= n.t AND customer_id IS NOT NULL GROUP BY customer_id"""


@query("customer_velocity", velocity_sql())
def customer_velocity(spark, sf):
    """Window aggregates per customer in one grouped aggregate."""
    now, txn = bound(spark, sf)
    return customer.velocity_features(txn, now)


@query("customer_velocity_cutoff", velocity_sql("t - INTERVAL 240 HOUR"))
def customer_velocity_cutoff(spark, sf):
    """The same ten days earlier: events after the cutoff do not count."""
    now = t.latest_event_time(spark, sf) - dt.timedelta(days=10)
    return customer.velocity_features(t.bind_transactions(spark, sf, now - dt.timedelta(days=30), now), now)


def flags_sql() -> str:
    return f"""WITH {TXN} SELECT transaction_id, CAST(status = 'FAILED' AS BIGINT) AS is_failed,
CAST(hour(ts) < 5 AS BIGINT) AS is_night, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend,
CAST(channel = 'WIRE' AS BIGINT) AS on_wire, CAST(channel = 'MOBILE_APP' AS BIGINT) AS on_mobile_app,
CAST(channel = 'POS' AS BIGINT) AS on_pos FROM txn"""


@query("transaction_flags", flags_sql())
def transaction_flags(spark, sf):
    txn = customer.flag_columns(t.bind_transactions(spark, sf))
    return txn.select("transaction_id", "is_failed", "is_night", "is_weekend", "on_wire", "on_mobile_app", "on_pos")


@query("latest_event_time", "SELECT max(ts) AS latest, count(*) AS events FROM events")
def latest_event_time(spark, sf):
    return t.bind_transactions(spark, sf).agg(F.max("ts").alias("latest"), F.count(F.lit(1)).alias("events"))


# -- all customer features -----------------------------------------------------------------

def customer_sql() -> str:
    agg = [f"count(*) FILTER ({inside(w)}) AS n_{w}" for w in HOURS]
    agg += [f"coalesce(sum(amount) FILTER ({inside(w)}), 0) AS amt_{w}" for w in HOURS]
    agg += [f"count(*) FILTER ({inside(w)} AND failed = 1) AS failed_{w}" for w in HOURS]
    cols = [f"n_{w} AS cust_txn_count_{w}" for w in HOURS]
    cols += [r(f"amt_{w}") + f" AS cust_txn_amount_sum_{w}" for w in ("1h", "6h", "24h", "7d", "30d")]
    cols += [r(f"coalesce(amt_{w} / nullif(n_{w}, 0), 0)") + f" AS cust_txn_amount_avg_{w}" for w in ("1h", "24h", "7d", "30d")]
    cols += [f"failed_{w} AS cust_failed_txn_count_{w}" for w in ("1h", "24h", "7d")]
    return f"""WITH {TXN},
e AS (
  SELECT x.*, n.t, c.country AS home, m.country AS away, m.merchant_category AS cat, coalesce(m.risk_score, 0.1) AS risk,
    CAST(status = 'FAILED' AS INTEGER) AS failed,
    lag(ts) OVER (PARTITION BY x.customer_id ORDER BY ts, transaction_id) AS prev_all,
    min(ts) OVER (PARTITION BY x.customer_id, x.merchant_id) AS first_visit
  FROM txn x CROSS JOIN now_at n LEFT JOIN cust c USING (customer_id) LEFT JOIN merch m ON x.merchant_id = m.merchant_id
  WHERE x.customer_id IS NOT NULL),
w AS (
  SELECT *, CASE WHEN prev_all >= t - INTERVAL 720 HOUR THEN epoch_us(ts) - epoch_us(prev_all) END / 1e6 AS gap,
    sum(1 - failed) OVER (PARTITION BY customer_id ORDER BY ts DESC, transaction_id DESC) AS ok_after,
    row_number() OVER (PARTITION BY customer_id ORDER BY ts DESC, transaction_id DESC) AS back,
    hour(ts) // 6 AS band
  FROM e WHERE {inside("30d")}),
lastrow AS (SELECT customer_id, band AS last_band, epoch_us(ts) - epoch_us(prev_all) AS last_gap FROM w WHERE back = 1),
main AS (
  SELECT customer_id, {", ".join(agg)},
    coalesce(stddev_samp(amount), 0) AS std30, avg(CAST(hour(ts) < 5 AS INTEGER)) AS night,
    coalesce(sum(amount) FILTER (isodow(ts) >= 6), 0) AS weekend_amt,
    greatest(count(*) FILTER (channel = 'WEB'), count(*) FILTER (channel = 'MOBILE_APP'), count(*) FILTER (channel = 'POS'),
             count(*) FILTER (channel = 'ATM'), count(*) FILTER (channel = 'WIRE')) AS top_channel,
    count(DISTINCT merchant_id) FILTER ({inside("24h")}) AS uniq_24h, count(DISTINCT merchant_id) FILTER ({inside("7d")}) AS uniq_7d,
    count(DISTINCT merchant_id) FILTER ({inside("7d", "first_visit")}) AS new_7d,
    count(DISTINCT merchant_id) FILTER ({inside("30d", "first_visit")}) AS new_30d,
    count(*) FILTER ({inside("7d")} AND home <> away) AS abroad_7d, count(*) FILTER (home <> away) AS abroad_30d,
    coalesce(avg(gap), 0) / 86400 AS gap_mean, coalesce(stddev_samp(gap), 0) / 86400 AS gap_std,
    avg(CAST(channel = 'MOBILE_APP' AS INTEGER)) AS mobile, avg(CAST(channel = 'POS' AS INTEGER)) AS pos,
    avg(CAST(channel = 'WIRE' AS INTEGER)) AS wire,
    count(*) FILTER (ok_after = 0) AS streak,
    count(*) FILTER ({inside("24h")} AND gap <= 120) AS repeats,
    coalesce(sum(amount) FILTER ({inside("7d")} AND risk > 0.5), 0) AS risky_7d, coalesce(sum(amount) FILTER (risk > 0.5), 0) AS risky_30d,
    count(*) FILTER ({inside("1h")} AND amount < 5) AS micro, count(*) FILTER ({inside("24h")} AND amount >= 270 AND amount < 300) AS structured,
    count(*) FILTER (ts >= t - INTERVAL 10 MINUTE) AS burst_n, coalesce(sum(amount) FILTER (ts >= t - INTERVAL 10 MINUTE), 0) AS burst_amt,
    count(DISTINCT channel) FILTER ({inside("24h")}) AS channels
  FROM w GROUP BY customer_id),
days AS (SELECT customer_id, max(n) AS best_n, max(a) AS best_amt FROM
  (SELECT customer_id, CAST(ts AS DATE) AS d, count(*) AS n, sum(amount) AS a FROM w GROUP BY ALL) GROUP BY customer_id),
ent AS (SELECT customer_id, -sum(p * ln(p)) AS entropy FROM
  (SELECT customer_id, cat, count(*) / CAST(sum(count(*)) OVER (PARTITION BY customer_id) AS DOUBLE) AS p FROM w GROUP BY customer_id, cat)
  GROUP BY customer_id),
degree AS (SELECT merchant_id, count(DISTINCT customer_id) - 1 AS others FROM w WHERE merchant_id IS NOT NULL GROUP BY merchant_id),
net AS (SELECT customer_id, CAST(sum(others) AS BIGINT) AS shared FROM (SELECT DISTINCT customer_id, merchant_id FROM w) JOIN degree USING (merchant_id) GROUP BY customer_id),
bands AS (SELECT w.customer_id, count(*) AS in_band FROM w JOIN lastrow l ON w.customer_id = l.customer_id AND w.band = l.last_band GROUP BY w.customer_id)
SELECT m.customer_id, (SELECT t FROM now_at) AS feature_timestamp, {", ".join(cols)},
  uniq_24h AS cust_unique_merchants_24h, uniq_7d AS cust_unique_merchants_7d,
  {r("least(n_30d / 50.0, 1.0)")} AS cust_activity_score, {r("night")} AS cust_night_owl_ratio_30d,
  {r("weekend_amt / amt_30d")} AS cust_weekend_spend_ratio_30d, {r("top_channel / CAST(n_30d AS DOUBLE)")} AS cust_preferred_channel_ratio_30d,
  new_7d AS cust_new_merchants_count_7d, new_30d AS cust_new_merchants_count_30d,
  abroad_7d AS cust_cross_border_count_7d, abroad_30d AS cust_cross_border_count_30d,
  {r("gap_mean")} AS cust_avg_days_between_txns_30d, {r("gap_std")} AS cust_stddev_days_between_txns_30d,
  {r("greatest(entropy, 0)")} AS cust_preferred_category_entropy_30d, {r("mobile")} AS cust_mobile_usage_ratio_30d,
  {r("pos")} AS cust_pos_usage_ratio_30d, {r("wire")} AS cust_wire_usage_ratio_30d,
  {r("coalesce(failed_7d / CAST(nullif(n_7d, 0) AS DOUBLE), 0)")} AS cust_declined_ratio_7d,
  {r("failed_30d / CAST(n_30d AS DOUBLE)")} AS cust_declined_ratio_30d,
  best_n AS cust_max_daily_txn_count_30d, {r("best_amt")} AS cust_max_daily_spend_30d,
  CAST(floor(coalesce(last_gap, 0) / 86400e6) AS BIGINT) AS cust_dormancy_days_before_latest_txn,
  repeats AS cust_rapid_repeat_txn_count_24h,
  {r("least(1.0, 0.3 * n_1h + 0.7 * failed_24h)")} AS cust_risk_velocity_composite, streak AS consecutive_failed_auth_count,
  {r("1 - in_band / CAST(n_30d AS DOUBLE)")} AS unusual_hour_spending_index,
  {r("std30 / (amt_30d / n_30d + 1e-5)")} AS amount_dispersion_index_30d,
  {r("coalesce(risky_7d / nullif(amt_7d, 0), 0)")} AS high_risk_merchant_spend_ratio_7d, {r("risky_30d / amt_30d")} AS high_risk_merchant_spend_ratio_30d,
  CAST(micro >= 3 AS BIGINT) AS card_testing_pattern_flag, CAST(structured >= 2 AS BIGINT) AS structuring_pattern_flag,
  burst_n AS burst_txn_count_10min, {r("burst_amt")} AS burst_txn_amount_10min, {r("channels / 5.0")} AS device_fingerprint_anomaly_score,
  {r("shared / (shared + 100.0)")} AS network_risk_centrality_score
FROM main m JOIN days USING (customer_id) JOIN ent USING (customer_id) JOIN net USING (customer_id)
JOIN lastrow USING (customer_id) JOIN bands USING (customer_id)"""


@query("customer_features", customer_sql())
def customer_features(spark, sf):
    """All customer features: velocity, behaviour and risk."""
    now, txn = bound(spark, sf)
    return customer.customer_features(
        txn, t.bind_customers(spark, sf), t.bind_merchants(spark, sf), now,
        history=t.bind_transactions(spark, sf, until=now), params=PARAMS,
    )


# -- merchants and accounts ------------------------------------------------------------------

def merchant_sql() -> str:
    cols = [f"count(*) FILTER ({inside(w)}) AS merch_txn_count_{w}" for w in ("1h", "24h", "7d", "30d")]
    cols += [r(f"coalesce(avg(amount) FILTER ({inside(w)}), 0)") + f" AS merch_avg_txn_amount_{w}" for w in ("24h", "7d", "30d")]
    cols += [r(f"coalesce(avg(is_fraud) FILTER ({inside(w)}), 0)") + f" AS merch_fraud_rate_{w}" for w in ("7d", "30d")]
    cols += [r(f"coalesce(avg(CAST(status = 'FAILED' AS INTEGER)) FILTER ({inside(w)}), 0)") + f" AS merch_declined_txn_rate_{w}" for w in ("24h", "7d")]
    cols += [f"count(DISTINCT customer_id) FILTER ({inside(w)}) AS merch_unique_customers_{w}" for w in ("24h", "7d", "30d")]
    return f"""WITH {TXN},
e AS (SELECT x.*, n.t, c.country AS home, m.country AS away, m.merchant_category AS cat, coalesce(m.risk_score, 0.1) AS risk
  FROM txn x CROSS JOIN now_at n LEFT JOIN cust c USING (customer_id) LEFT JOIN merch m ON x.merchant_id = m.merchant_id
  WHERE {inside("30d")} AND x.merchant_id IS NOT NULL),
top AS (SELECT merchant_id, max(a) AS best FROM (SELECT merchant_id, customer_id, sum(amount) AS a FROM e GROUP BY ALL) GROUP BY merchant_id)
SELECT merchant_id, max(t) AS feature_timestamp, {r("max(risk)")} AS merch_risk_score, {", ".join(cols)},
  CAST(coalesce(max(cat) IN ('CRYPTO', 'GAMBLING'), false) AS BIGINT) AS merch_high_risk_cat_flag,
  {r(f"coalesce(count(*) FILTER ({inside('7d')} AND home <> away) / CAST(nullif(count(*) FILTER ({inside('7d')}), 0) AS DOUBLE), 0)")} AS merch_cross_border_ratio_7d,
  {r("max(amount)")} AS merch_max_txn_amount_30d,
  {r(f"least(count(*) FILTER ({inside('1h')}) / (count(*) FILTER ({inside('24h')}) / 24.0 + 1e-5), 10.0)")} AS merch_velocity_spike_index,
  {r("coalesce(sum(amount) FILTER (status = 'REFUNDED'), 0) / sum(amount)")} AS merch_refund_ratio_30d,
  {r("max(risk) * 1.2")} AS merch_category_risk_index, {r("max(best) / sum(amount)")} AS merchant_collusion_risk_score
FROM e JOIN top USING (merchant_id) GROUP BY merchant_id"""


@query("merchant_features", merchant_sql())
def merchant_features(spark, sf):
    now, txn = bound(spark, sf)
    return merchant.merchant_features(txn, t.bind_customers(spark, sf), t.bind_merchants(spark, sf), now)


def account_sql() -> str:
    return f"""WITH {TXN},
acct AS (SELECT c_custkey AS account_id, DATE '2024-01-01' - CAST(c_custkey % 400 AS INTEGER) AS opened, c_acctbal AS bal,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'CREDIT' WHEN 'MACHINERY' THEN 'SAVINGS' ELSE 'CHECKING' END AS kind FROM customer),
e AS (SELECT x.*, n.t, CAST(status = 'FAILED' AS INTEGER) AS failed, min(ts) OVER (PARTITION BY account_id) AS first_ts,
    min(ts) OVER (PARTITION BY account_id, merchant_id) AS first_visit FROM txn x, now_at n WHERE account_id IS NOT NULL),
w AS (SELECT *, hour(ts) // 6 AS band,
    sum(1 - failed) OVER (PARTITION BY account_id ORDER BY ts DESC, transaction_id DESC) AS ok_after,
    sum(CASE WHEN channel = 'ATM' THEN 0 ELSE 1 END) OVER (PARTITION BY account_id ORDER BY ts DESC, transaction_id DESC) AS other_after,
    row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, transaction_id DESC) AS back,
    sum(CASE WHEN failed = 0 THEN amount ELSE 0 END) OVER (PARTITION BY account_id ORDER BY ts DESC, transaction_id DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent_later
  FROM e WHERE {inside("30d")}),
od AS (SELECT account_id, count(*) AS overdrafts FROM w JOIN acct USING (account_id)
  WHERE failed = 0 AND bal + coalesce(spent_later, 0) < 0 AND bal + coalesce(spent_later, 0) + amount >= 0 GROUP BY account_id),
bands AS (SELECT w.account_id, count(*) AS in_band FROM w JOIN (SELECT account_id, band FROM w WHERE back = 1) l
  ON w.account_id = l.account_id AND w.band = l.band GROUP BY w.account_id),
g AS (SELECT account_id, max(t) AS t, count(*) AS n,
    coalesce(sum(amount) FILTER ({inside("24h")}), 0) AS s1, coalesce(sum(amount) FILTER ({inside("7d")}), 0) AS s7,
    coalesce(sum(amount) FILTER ({inside("14d")}), 0) AS s14, sum(amount) AS s30,
    coalesce(max(amount) FILTER ({inside("7d")}), 0) AS max7, max(amount) AS max30, min(amount) AS min30, coalesce(stddev_samp(amount), 0) AS sd,
    count(*) FILTER ({inside("24h")} AND amount > 100) AS h1, count(*) FILTER ({inside("7d")} AND amount > 100) AS h7,
    count(*) FILTER (amount > 100) AS h30, min(first_ts) AS first_ts, count(*) FILTER (ok_after = 0) AS streak,
    count(*) FILTER (other_after = 0 AND {inside("24h")}) AS atm, count(DISTINCT merchant_id) FILTER ({inside("7d", "first_visit")}) AS new7
  FROM w GROUP BY account_id)
SELECT account_id, t AS feature_timestamp,
  {r("coalesce(s1 / nullif(bal, 0), 0)")} AS acc_balance_ratio_24h, {r("coalesce(s7 / nullif(bal, 0), 0)")} AS acc_balance_ratio_7d,
  date_diff('day', opened, CAST(t AS DATE)) AS acc_age_days, {r("bal")} AS acc_current_balance,
  {r("s7 / 7")} AS acc_avg_daily_spend_7d, {r("s14 / 14")} AS acc_avg_daily_spend_14d, {r("s30 / 30")} AS acc_avg_daily_spend_30d,
  {r("max7")} AS acc_max_txn_amount_7d, {r("max30")} AS acc_max_txn_amount_30d, {r("min30")} AS acc_min_txn_amount_30d,
  {r("sd")} AS acc_stddev_txn_amount_30d, {r("coalesce(s1 / nullif(bal + s1, 0), 0)")} AS acc_balance_drain_rate_24h,
  {r("coalesce(s7 / nullif(bal + s7, 0), 0)")} AS acc_balance_drain_rate_7d,
  h1 AS acc_high_val_txn_count_24h, h7 AS acc_high_val_txn_count_7d, h30 AS acc_high_val_txn_count_30d,
  CAST(coalesce(bal < 0, false) AS BIGINT) AS acc_is_overdrawn_flag, coalesce(overdrafts, 0) AS acc_overdraft_count_30d,
  CASE WHEN kind = 'CREDIT' THEN {r("greatest(0.0, 10000 - bal) / 10000")} END AS acc_credit_utilization_ratio,
  date_diff('day', CAST(first_ts AS DATE), CAST(t AS DATE)) AS acc_days_since_first_txn,
  {r("least(1.0, coalesce(s1 / nullif(bal + s1, 0), 0))")} AS acc_rapid_depletion_score, {r("least(1.0, atm / 5.0)")} AS atm_cash_drain_score_24h,
  {r("least(1.0, (least(1.0, streak / 5.0) + least(1.0, new7 / 5.0) + 1 - in_band / CAST(n AS DOUBLE)) / 3)")} AS account_takeover_risk_index
FROM g JOIN bands USING (account_id) LEFT JOIN acct USING (account_id) LEFT JOIN od USING (account_id)"""


@query("account_features", account_sql())
def account_features(spark, sf):
    now, txn = bound(spark, sf)
    return account.account_features(
        txn, t.bind_accounts(spark, sf), now, history=t.bind_transactions(spark, sf, until=now), params=PARAMS
    )


# -- transactions ---------------------------------------------------------------------------------

def transaction_sql() -> str:
    def win(key: str, w: str) -> str:
        return f"(PARTITION BY x.{key} ORDER BY ts RANGE BETWEEN INTERVAL {HOURS[w]} HOUR PRECEDING AND CURRENT ROW)"

    def dist(a, b, c, d):
        return f"""12742.0 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2)
          + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"""

    channels = ", ".join(
        f"CAST(channel = '{c}' AS BIGINT) AS txn_channel_is_{n}"
        for c, n in (("MOBILE_APP", "mobile"), ("WEB", "web"), ("POS", "pos"), ("ATM", "atm"), ("WIRE", "wire"))
    )
    return f"""WITH {TXN},
place AS (SELECT n_name AS country, n_nationkey * 6.0 - 72.0 AS lat, n_nationkey * 13.0 - 160.0 AS lon FROM nation),
e AS (SELECT x.*, m.country AS away, p.lat, p.lon, h.lat AS hlat, h.lon AS hlon
  FROM txn x LEFT JOIN merch m ON x.merchant_id = m.merchant_id LEFT JOIN place p ON m.country = p.country
  LEFT JOIN cust c ON x.customer_id = c.customer_id LEFT JOIN place h ON c.country = h.country),
w AS (SELECT x.*,
  avg(amount) OVER {win("customer_id", "7d")} AS c7, avg(amount) OVER {win("customer_id", "30d")} AS c30,
  avg(amount) OVER {win("merchant_id", "7d")} AS m7, avg(amount) OVER {win("merchant_id", "30d")} AS m30,
  stddev_samp(amount) OVER {win("customer_id", "30d")} AS sd30,
  count(*) OVER {win("customer_id", "1h")} AS n1, count(*) OVER {win("customer_id", "24h")} AS n24,
  lag(ts) OVER u AS pts, lag(lat) OVER u AS plat, lag(lon) OVER u AS plon,
  row_number() OVER u AS rn,
  sum(CASE WHEN amount > 100 THEN 0 ELSE 1 END) OVER u AS island,
  row_number() OVER (PARTITION BY x.customer_id, x.merchant_id ORDER BY ts, transaction_id) AS nm,
  row_number() OVER (PARTITION BY x.customer_id, away ORDER BY ts, transaction_id) AS nc
  FROM e x WINDOW u AS (PARTITION BY x.customer_id ORDER BY ts, transaction_id)),
v AS (SELECT *, (epoch_us(ts) - epoch_us(pts)) / 1e6 AS since,
  count(*) FILTER (amount > 100) OVER (PARTITION BY customer_id, island ORDER BY ts, transaction_id) AS run FROM w)
SELECT transaction_id, customer_id, merchant_id, ts AS feature_timestamp,
  {r("coalesce(amount / nullif(c7, 0), 0)")} AS txn_amount_to_cust_avg_ratio_7d, {r("coalesce(amount / nullif(c30, 0), 0)")} AS txn_amount_to_cust_avg_ratio_30d,
  {r("coalesce(amount / nullif(m7, 0), 0)")} AS txn_amount_to_merch_avg_ratio_7d, {r("coalesce(amount / nullif(m30, 0), 0)")} AS txn_amount_to_merch_avg_ratio_30d,
  {r("coalesce(since, 0)")} AS txn_time_since_last_txn_sec,
  CAST(hour(ts) < 5 AS BIGINT) AS txn_is_night_time_flag, CAST(isodow(ts) >= 6 AS BIGINT) AS txn_is_weekend_flag,
  hour(ts) AS txn_hour_of_day, isodow(ts) - 1 AS txn_day_of_week, {channels},
  {r("coalesce((amount - c30) / nullif(sd30, 0), 0)")} AS txn_amount_zscore_30d,
  least(run, n1) AS txn_consecutive_high_val_count,
  CAST(merchant_id IS NOT NULL AND nm = 1 AS BIGINT) AS txn_is_first_time_merchant, CAST(away IS NOT NULL AND nc = 1 AS BIGINT) AS txn_is_first_time_country,
  {r("coalesce(n1 / (n24 / 24.0), 0)")} AS txn_velocity_spike_ratio_1h_vs_24h,
  CAST(amount > 0 AND amount % 100 = 0 AS BIGINT) AS txn_is_round_amount_flag, {r("least(1.0, n1 / 10.0)")} AS txn_velocity_score,
  {r("coalesce(" + dist("hlat", "hlon", "lat", "lon") + ", 0)")} AS geo_distance_from_home_km,
  {r("coalesce(" + dist("plat", "plon", "lat", "lon") + " / nullif(since / 3600.0, 0), 0)")} AS geo_velocity_kph
FROM v"""


@query("transaction_features", transaction_sql())
def transaction_features(spark, sf):
    return transaction.transaction_features(
        t.bind_transactions(spark, sf), t.bind_customers(spark, sf), t.bind_merchants(spark, sf),
        t.bind_countries(spark, sf), PARAMS,
    )


@query("burst_windows", f"""WITH {TXN},
w AS (SELECT customer_id, count(*) OVER b AS n, sum(amount) OVER b AS a FROM txn
  WINDOW b AS (PARTITION BY customer_id ORDER BY ts RANGE BETWEEN INTERVAL 10 MINUTE PRECEDING AND CURRENT ROW))
SELECT customer_id, CAST(max(n) AS BIGINT) AS most_txns_10min, {r("max(a)")} AS most_amount_10min FROM w GROUP BY customer_id""")
def burst_windows(spark, sf):
    """The busiest ten minutes of every customer."""
    rows = trailing(
        t.bind_transactions(spark, sf).select("transaction_id", "customer_id", "ts", "amount"), ["customer_id"], "ts",
        {"n": "1", "a": "amount"}, {"10min": 600},
    )
    return rows.groupBy("customer_id").agg(
        F.max("n_10min").cast("bigint").alias("most_txns_10min"), F.max("a_10min").alias("most_amount_10min")
    )


# -- history and point-in-time joins ---------------------------------------------------------------

SPINE = """
per_hour AS (SELECT customer_id, ts, amount, CAST(status = 'FAILED' AS INTEGER) AS failed FROM txn),
steps AS (SELECT unnest(generate_series((SELECT min(ts) FROM txn)::DATE::TIMESTAMP, (SELECT max(ts) FROM txn) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS s),
snap AS (
  SELECT customer_id, s AS feature_timestamp,
    """ + ", ".join(
    f"count(*) FILTER (ts >= s - INTERVAL {h} HOUR) AS n_{w}, coalesce(sum(amount) FILTER (ts >= s - INTERVAL {h} HOUR), 0) AS a_{w}, "
    f"count(*) FILTER (ts >= s - INTERVAL {h} HOUR AND failed = 1) AS f_{w}"
    for w, h in (("1h", 1), ("24h", 24), ("7d", 168), ("30d", 720))
) + """
  FROM per_hour JOIN steps ON ts <= s AND ts >= s - INTERVAL 720 HOUR
  WHERE s <= date_trunc('day', (SELECT max(ts) FROM txn) - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY
  GROUP BY customer_id, s)"""


@query("snapshot_history", f"""WITH {TXN}, {SPINE}
SELECT customer_id, feature_timestamp, """ + ", ".join(
    [f"n_{w} AS cust_txn_count_{w}" for w in ("1h", "24h", "7d", "30d")]
    + [r(f"a_{w}") + f" AS cust_txn_amount_sum_{w}" for w in ("1h", "24h", "7d", "30d")]
    + [r(f"coalesce(a_{w} / nullif(n_{w}, 0), 0)") + f" AS cust_txn_amount_avg_{w}" for w in ("1h", "24h", "7d", "30d")]
    + [f"f_{w} AS cust_failed_txn_count_{w}" for w in ("1h", "24h", "7d", "30d")]
) + " FROM snap")
def snapshot_history(spark, sf):
    """Features of every customer at every midnight."""
    return spine.snapshot_history(t.bind_transactions(spark, sf), "customer_id")


# snapshot times at which something of an entity is in sight, with the events they see
def sight(key: str) -> str:
    return f"""
steps AS (SELECT unnest(generate_series((SELECT min(ts) FROM txn)::DATE::TIMESTAMP, (SELECT max(ts) FROM txn) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS s),
sight AS (SELECT txn.*, s AS t, CAST(status = 'FAILED' AS INTEGER) AS failed,
    sum(CASE WHEN status = 'FAILED' THEN 0 ELSE 1 END) OVER (PARTITION BY {key}, s ORDER BY ts DESC, transaction_id DESC) AS ok_after
  FROM txn JOIN steps ON ts <= s AND ts >= s - INTERVAL 720 HOUR
  WHERE s <= date_trunc('day', (SELECT max(ts) FROM txn) - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY AND {key} IS NOT NULL)"""


# The features of the risk model, in its order, as SQL over the events in sight.
MODEL_SQL = {
    **{f"cust_txn_count_{w}": f"count(*) FILTER ({inside(w)})" for w in ("1h", "24h", "7d")},
    **{f"cust_txn_amount_sum_{w}": f"coalesce(sum(amount) FILTER ({inside(w)}), 0)" for w in ("1h", "24h")},
    "cust_txn_amount_avg_7d": f"coalesce(avg(amount) FILTER ({inside('7d')}), 0)",
    "cust_failed_txn_count_24h": f"count(*) FILTER ({inside('24h')} AND failed = 1)",
    "cust_unique_merchants_7d": f"count(DISTINCT merchant_id) FILTER ({inside('7d')})",
    "cust_activity_score": "least(count(*) / 50.0, 1.0)",
    "cust_night_owl_ratio_30d": "avg(CAST(hour(ts) < 5 AS INTEGER))",
    "cust_declined_ratio_7d": f"coalesce(avg(failed) FILTER ({inside('7d')}), 0)",
    "cust_risk_velocity_composite": f"least(1.0, 0.3 * count(*) FILTER ({inside('1h')}) + 0.7 * count(*) FILTER ({inside('24h')} AND failed = 1))",
    "consecutive_failed_auth_count": "count(*) FILTER (ok_after = 0)",
    "amount_dispersion_index_30d": "coalesce(stddev_samp(amount), 0) / (avg(amount) + 1e-5)",
    "burst_txn_count_10min": "count(*) FILTER (ts >= t - INTERVAL 10 MINUTE)",
    "burst_txn_amount_10min": "coalesce(sum(amount) FILTER (ts >= t - INTERVAL 10 MINUTE), 0)",
}
WHOLE = {c for c in MODEL_SQL if "count" in c or "unique" in c}
MODEL_SNAPS = sight("customer_id") + ", snap AS (SELECT customer_id, t AS feature_timestamp, " + ", ".join(
    f"{e} AS {c}" for c, e in MODEL_SQL.items()) + " FROM sight GROUP BY customer_id, t)"


@query("snapshot_history_model", f"WITH {TXN}, {MODEL_SNAPS} SELECT customer_id, feature_timestamp, " + ", ".join(
    c if c in WHOLE else f"{r(c)} AS {c}" for c in MODEL_SQL) + " FROM snap")
def snapshot_history_model(spark, sf):
    """The sixteen features of the risk model for every customer at every midnight."""
    return spine.model_history(t.bind_transactions(spark, sf))


@query("snapshot_history_merchants", f"WITH {TXN}, {sight('merchant_id')} SELECT merchant_id, t AS feature_timestamp, " + ", ".join(
    [f"count(*) FILTER ({inside(w)}) AS merch_txn_count_{w}" for w in ("1h", "24h", "7d", "30d")]
    + [r(f"coalesce(avg(amount) FILTER ({inside(w)}), 0)") + f" AS merch_avg_txn_amount_{w}" for w in ("24h", "7d", "30d")]
    + [r(f"coalesce(avg(is_fraud) FILTER ({inside(w)}), 0)") + f" AS merch_fraud_rate_{w}" for w in ("7d", "30d")]
    + [r(f"coalesce(avg(failed) FILTER ({inside(w)}), 0)") + f" AS merch_declined_txn_rate_{w}" for w in ("24h", "7d")]
    + [f"count(DISTINCT customer_id) FILTER ({inside(w)}) AS merch_unique_customers_{w}" for w in ("24h", "7d", "30d")]
    + [r("max(amount)") + " AS merch_max_txn_amount_30d",
       r(f"least(count(*) FILTER ({inside('1h')}) / (count(*) FILTER ({inside('24h')}) / 24.0 + 1e-5), 10.0)") + " AS merch_velocity_spike_index",
       r("coalesce(coalesce(sum(amount) FILTER (status = 'REFUNDED'), 0) / nullif(sum(amount), 0), 0)") + " AS merch_refund_ratio_30d"]
) + " FROM sight GROUP BY merchant_id, t")
def snapshot_history_merchants(spark, sf):
    """Measures of every merchant at every midnight."""
    return spine.merchant_history(t.bind_transactions(spark, sf))


def asof_parts(spark, sf):
    """Purchases as observations, daily customer snapshots as features."""
    obs = t.bind_transactions(spark, sf).filter(F.col("status") == "APPROVED").select(
        "transaction_id", "customer_id", "ts", "amount", "is_fraud"
    )
    return obs, stage_table(spine.snapshot_history(t.bind_transactions(spark, sf), "customer_id"), "snapshots")


FEATURES = ["cust_txn_count_24h", "cust_txn_count_7d", "cust_txn_amount_sum_30d", "cust_failed_txn_count_7d"]
OBS = "obs AS (SELECT transaction_id, customer_id, ts, amount, is_fraud FROM txn WHERE status = 'APPROVED')"


@query("asof_join", f"""WITH {TXN}, {SPINE}, {OBS}
SELECT o.transaction_id, o.customer_id, o.ts, {r("o.amount")} AS amount, CAST(o.is_fraud AS BIGINT) AS is_fraud,
  s.feature_timestamp, coalesce(s.n_24h, -1) AS cust_txn_count_24h, coalesce(s.n_7d, -1) AS cust_txn_count_7d,
  {r("coalesce(s.a_30d, -1)")} AS cust_txn_amount_sum_30d, coalesce(s.f_7d, -1) AS cust_failed_txn_count_7d
FROM obs o ASOF LEFT JOIN snap s ON o.customer_id = s.customer_id AND o.ts >= s.feature_timestamp""")
def asof_join(spark, sf):
    """The leak-free training join; -1 stands for no history."""
    obs, snaps = asof_parts(spark, sf)
    return asof.asof_join(obs, snaps, "customer_id", "ts", columns=FEATURES).fillna(-1, FEATURES)


@query("asof_join_ttl", f"""WITH {TXN}, {OBS},
f AS (SELECT customer_id, ts AS feature_timestamp, amount AS refund FROM txn WHERE status = 'REFUNDED')
SELECT o.transaction_id, f.feature_timestamp,
  {r("CASE WHEN epoch_us(o.ts) - epoch_us(f.feature_timestamp) <= 86400000000 THEN f.refund ELSE -1 END")} AS refund
FROM obs o ASOF LEFT JOIN f ON o.customer_id = f.customer_id AND o.ts >= f.feature_timestamp""")
def asof_join_ttl(spark, sf):
    """Values older than a day are void; the time they were found at stays."""
    obs = t.bind_transactions(spark, sf).filter(F.col("status") == "APPROVED").select("transaction_id", "customer_id", "ts")
    refunds = t.bind_transactions(spark, sf).filter(F.col("status") == "REFUNDED").select(
        "customer_id", F.col("ts").alias("feature_timestamp"), F.col("amount").alias("refund")
    )
    joined = asof.asof_join(obs, refunds, "customer_id", "ts", ttl_seconds=DAY)
    return joined.select("transaction_id", "feature_timestamp", F.coalesce("refund", F.lit(-1.0)).alias("refund"))


@query("asof_join_groups", f"""WITH {TXN}, {SPINE}, {OBS},
v AS (SELECT customer_id, ts AS refund_ts, amount AS refund FROM txn WHERE status = 'REFUNDED')
SELECT o.transaction_id, s.feature_timestamp, coalesce(s.n_7d, -1) AS cust_txn_count_7d, v.refund_ts, {r("coalesce(v.refund, -1)")} AS refund
FROM obs o ASOF LEFT JOIN snap s ON o.customer_id = s.customer_id AND o.ts >= s.feature_timestamp
ASOF LEFT JOIN v ON o.customer_id = v.customer_id AND o.ts >= v.refund_ts""")
def asof_join_groups(spark, sf):
    """Two feature tables joined to one observation set in one pass."""
    obs, snaps = asof_parts(spark, sf)
    refunds = t.bind_transactions(spark, sf).filter(F.col("status") == "REFUNDED").select(
        "customer_id", F.col("ts").alias("refund_ts"), F.col("amount").alias("refund")
    )
    joined = asof.asof_join_groups(
        obs,
        [asof.FeatureGroup(snaps, ["cust_txn_count_7d"]), asof.FeatureGroup(refunds, ["refund"], "refund_ts", 0)],
        "customer_id", "ts",
    )
    return joined.select("transaction_id", "feature_timestamp", "cust_txn_count_7d", "refund_ts", "refund").fillna(
        -1, ["cust_txn_count_7d", "refund"]
    )


@query("naive_latest_join", f"""WITH {TXN}, {SPINE}, {OBS},
latest AS (SELECT customer_id, max(feature_timestamp) AS feature_timestamp, arg_max(n_7d, feature_timestamp) AS n_7d,
  arg_max(a_30d, feature_timestamp) AS a_30d FROM snap GROUP BY customer_id)
SELECT transaction_id, feature_timestamp, coalesce(n_7d, -1) AS cust_txn_count_7d, {r("coalesce(a_30d, -1)")} AS cust_txn_amount_sum_30d
FROM obs LEFT JOIN latest USING (customer_id)""")
def naive_latest_join(spark, sf):
    obs, snaps = asof_parts(spark, sf)
    wanted = ["cust_txn_count_7d", "cust_txn_amount_sum_30d"]
    joined = asof.naive_latest_join(obs, snaps, "customer_id", columns=wanted)
    return joined.select("transaction_id", "feature_timestamp", *wanted).fillna(-1, wanted)


SKEW = ["cust_txn_count_24h", "cust_txn_count_7d", "cust_failed_txn_count_7d"]


@query("skew_report", f"""WITH {TXN}, {SPINE}, {OBS},
latest AS (SELECT customer_id, max(feature_timestamp) AS lt, arg_max(n_24h, feature_timestamp) AS l24,
  arg_max(n_7d, feature_timestamp) AS l7, arg_max(f_7d, feature_timestamp) AS lf FROM snap GROUP BY customer_id),
b AS (SELECT o.ts, s.n_24h, s.n_7d, s.f_7d, l.lt, l.l24, l.l7, l.lf
  FROM obs o ASOF LEFT JOIN snap s ON o.customer_id = s.customer_id AND o.ts >= s.feature_timestamp
  LEFT JOIN latest l ON o.customer_id = l.customer_id),
c AS (SELECT count(*) AS n, count(*) FILTER (lt > ts) AS leak, count(*) FILTER (n_24h IS DISTINCT FROM l24) AS d24,
  count(*) FILTER (n_7d IS DISTINCT FROM l7) AS d7, count(*) FILTER (f_7d IS DISTINCT FROM lf) AS df FROM b)
SELECT 'cust_txn_count_24h' AS feature, n AS rows_compared, d24 AS rows_differing, leak AS rows_leaking FROM c
UNION ALL SELECT 'cust_txn_count_7d', n, d7, leak FROM c UNION ALL SELECT 'cust_failed_txn_count_7d', n, df, leak FROM c""")
def skew_report(spark, sf):
    obs, snaps = asof_parts(spark, sf)
    return asof.skew_report(obs, snaps, "customer_id", "ts", columns=SKEW)


@query("leakage_audit", f"""WITH {TXN}, {SPINE}, {OBS}
SELECT count(*) AS rows_checked, count(s.feature_timestamp) AS rows_matched, count(*) FILTER (s.feature_timestamp > o.ts) AS rows_leaking
FROM obs o ASOF LEFT JOIN snap s ON o.customer_id = s.customer_id AND o.ts >= s.feature_timestamp""")
def leakage_audit(spark, sf):
    obs, snaps = asof_parts(spark, sf)
    return asof.leakage_audit(asof.asof_join(obs, snaps, "customer_id", "ts", columns=FEATURES), "ts")


# -- plain joins and roll-ups ---------------------------------------------------------------------

@query("window_merge", f"""WITH {TXN},
a AS (SELECT customer_id, count(*) AS n_30d FROM txn, now_at WHERE {inside("30d")} GROUP BY customer_id),
b AS (SELECT customer_id, count(*) AS n_24h, sum(amount) AS amt_24h FROM txn, now_at WHERE {inside("24h")} GROUP BY customer_id)
SELECT customer_id, n_30d, coalesce(n_24h, 0) AS n_24h, {r("coalesce(amt_24h, 0)")} AS amt_24h FROM a LEFT JOIN b USING (customer_id)""")
def window_merge(spark, sf):
    """Windows from separate frames merged on the entity, missing ones as 0."""
    now, txn = bound(spark, sf)
    month = txn.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_30d"))
    day = t.bind_transactions(spark, sf, now - dt.timedelta(hours=24), now).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_24h"), F.sum("amount").alias("amt_24h")
    )
    return month.join(day, "customer_id", "left").fillna(0, ["n_24h", "amt_24h"])


@query("merchant_risk_lookup", f"""WITH {TXN}
SELECT transaction_id, merchant_id, {r("coalesce(risk_score, 0.1)")} AS merchant_risk_score FROM txn LEFT JOIN merch USING (merchant_id)""")
def merchant_risk_lookup(spark, sf):
    """Static lookup with a default; Spark broadcasts the side if its size allows."""
    risk = t.bind_merchants(spark, sf).select("merchant_id", "risk_score")
    return t.bind_transactions(spark, sf).join(risk, "merchant_id", "left").select(
        "transaction_id", "merchant_id", F.coalesce("risk_score", F.lit(0.1)).alias("merchant_risk_score")
    )


@query("label_join", f"""WITH {TXN},
fraud AS (SELECT transaction_id, ts + INTERVAL 30 MINUTE AS confirmed_at,
  ['CARD_TESTING','ACCOUNT_TAKEOVER','IDENTITY_THEFT'][CAST(transaction_id % 3 AS INTEGER) + 1] AS fraud_type FROM txn WHERE is_fraud = 1)
SELECT transaction_id, customer_id, confirmed_at, coalesce(fraud_type, '') AS fraud_type,
  CAST(confirmed_at IS NOT NULL AS BIGINT) AS is_fraud FROM txn LEFT JOIN fraud USING (transaction_id)""")
def label_join(spark, sf):
    """Transactions labelled by their fraud confirmations."""
    fraud = t.bind_fraud_events(spark, sf).select("transaction_id", "confirmed_at", "fraud_type")
    return t.bind_transactions(spark, sf).join(fraud, "transaction_id", "left").select(
        "transaction_id", "customer_id", "confirmed_at", F.coalesce("fraud_type", F.lit("")).alias("fraud_type"),
        F.col("confirmed_at").isNotNull().cast("bigint").alias("is_fraud"),
    )


@query("daily_customer_aggregates", f"""WITH {TXN}
SELECT customer_id, CAST(ts AS DATE) AS date, {r("sum(amount)")} AS daily_spend_usd, count(*) AS daily_txn_count FROM txn GROUP BY 1, 2""")
def daily_customer_aggregates(spark, sf):
    return t.bind_transactions(spark, sf).groupBy("customer_id", F.to_date("ts").alias("date")).agg(
        F.sum("amount").alias("daily_spend_usd"), F.count(F.lit(1)).alias("daily_txn_count")
    )


@query("hourly_merchant_metrics", f"""WITH {TXN}
SELECT merchant_id, date_trunc('hour', ts) AS hour_timestamp, {r("sum(amount)")} AS hourly_volume_usd,
  {r("avg(CAST(status = 'FAILED' AS INTEGER))")} AS decline_rate FROM txn GROUP BY 1, 2""")
def hourly_merchant_metrics(spark, sf):
    return t.bind_transactions(spark, sf).groupBy("merchant_id", F.date_trunc("hour", "ts").alias("hour_timestamp")).agg(
        F.sum("amount").alias("hourly_volume_usd"), F.avg((F.col("status") == "FAILED").cast("int")).alias("decline_rate")
    )


SESSIONS = """
g AS (SELECT customer_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY customer_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM txn),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY customer_id ORDER BY ts) AS s FROM g)"""


@query("user_sessions", f"""WITH {TXN}, {SESSIONS}
SELECT customer_id, min(ts) AS created_at, count(*) AS events, CAST(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS BIGINT) AS duration_seconds
FROM i GROUP BY customer_id, s""")
def user_sessions(spark, sf):
    return customer.sessions(t.bind_transactions(spark, sf))


# -- training ----------------------------------------------------------------------------------------

@query("trailing_extremes", f"""WITH priced AS (
  SELECT l_orderkey * 10 + l_linenumber AS line_id, l_suppkey, l_shipdate AS ts,
         CASE WHEN l_orderkey % 97 = 0 THEN 1e9 + l_extendedprice ELSE l_extendedprice END AS price, l_quantity FROM lineitem)
SELECT line_id, CAST(sum(CAST(price AS DECIMAL(18,2))) OVER w7 AS DECIMAL(18,2)) AS price_7d,
  CAST(sum(CAST(price AS DECIMAL(18,2))) OVER w30 AS DECIMAL(18,2)) AS price_30d,
  CAST(count(*) OVER w30 AS DOUBLE) AS n_30d,
  {r("round(ln(1 + coalesce(stddev_samp(price) OVER w7, 0)), 4)")} AS log_std_7d, {r("round(ln(1 + coalesce(stddev_samp(1e5 + l_quantity / 10) OVER w30, 0)), 4)")} AS log_std_30d
FROM priced
WINDOW w7 AS (PARTITION BY l_suppkey ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW),
  w30 AS (PARTITION BY l_suppkey ORDER BY ts RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)""")
def trailing_extremes(spark, sf):
    """Trailing sums and spreads per supplier at every line, with prices a million times larger in between, and the
    spread of values that differ by little from a large one."""
    priced = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr(
        "l_orderkey * 10 + l_linenumber AS line_id", "l_suppkey", "cast(l_shipdate AS timestamp) AS ts",
        "CASE WHEN l_orderkey % 97 = 0 THEN 1e9D + l_extendedprice ELSE l_extendedprice END AS price", "1e5D + l_quantity / 10 AS level")
    out = trailing(priced, ["l_suppkey"], "ts", {"price": "price", "n": "1"}, {"7d": 7 * DAY, "30d": 30 * DAY}, wanted={"n": ["30d"]},
                   spread={"price": ("price", ["7d"]), "level": ("level", ["30d"])})
    return out.selectExpr("line_id", "cast(price_7d AS decimal(18,2)) AS price_7d", "cast(price_30d AS decimal(18,2)) AS price_30d", "n_30d",
                          "round(ln(1 + price_std_7d), 4) AS log_std_7d", "round(ln(1 + level_std_30d), 4) AS log_std_30d")


@query("stratified_split", f"""WITH {TXN}
SELECT CAST(is_fraud AS BIGINT) AS is_fraud, CAST(round(count(*) * 0.75) AS BIGINT) AS train_rows,
  count(*) - CAST(round(count(*) * 0.75) AS BIGINT) AS test_rows FROM txn GROUP BY is_fraud""")
def stratified_split(spark, sf):
    """Rows per label on both sides of the split."""
    rows = t.bind_transactions(spark, sf).select("transaction_id", "is_fraud")
    return training.stratified_split(rows, "transaction_id", "is_fraud").groupBy("is_fraud").agg(
        F.count_if("is_train").alias("train_rows"), F.count_if(~F.col("is_train")).alias("test_rows")
    )


@query("sample_rows", f"""WITH {TXN}
SELECT transaction_id, customer_id, {r("amount")} AS amount, ts, CAST(is_fraud AS BIGINT) AS is_fraud
FROM txn ORDER BY md5(CAST(transaction_id AS VARCHAR) || '-42'), transaction_id LIMIT 5000""")
def sample_rows(spark, sf):
    """A repeatable sample of 5,000 observations."""
    rows = t.bind_transactions(spark, sf).select("transaction_id", "customer_id", "amount", "ts", "is_fraud")
    return training.sample_rows(rows, "transaction_id", 5000)


@query("training_set", f"""WITH {TXN}, {MODEL_SNAPS}
SELECT o.transaction_id, o.customer_id, o.ts, """ + ", ".join(f"{r(f'coalesce(s.{c}, 0)')} AS {c}" for c in MODEL_SQL) + f""", {r("o.is_fraud")} AS label
FROM txn o ASOF LEFT JOIN snap s ON o.customer_id = s.customer_id AND o.ts >= s.feature_timestamp""")
def training_set(spark, sf):
    """Every transaction with the sixteen point-in-time features of the model and its label."""
    txn = t.bind_transactions(spark, sf)
    return training.training_set(txn, stage_table(spine.model_history(txn), "snapshots"), n=None)


@query("train_fraud_model", f"""WITH {TXN},
drawn AS (SELECT is_fraud FROM txn ORDER BY md5(CAST(transaction_id AS VARCHAR) || '-42'), transaction_id LIMIT 5000),
sides AS (SELECT is_fraud, count(*) AS n, CAST(round(count(*) * 0.75) AS BIGINT) AS train FROM drawn GROUP BY is_fraud)
SELECT CAST(sum(train) AS BIGINT) AS train_rows, CAST(sum(train) FILTER (is_fraud = 1) AS BIGINT) AS train_positives,
  CAST(sum(n - train) AS BIGINT) AS test_rows, CAST(sum(n - train) FILTER (is_fraud = 1) AS BIGINT) AS test_positives,
  CAST(sum(n - train) AS BIGINT) AS measured_rows FROM sides""")
def train_fraud_model(spark, sf):
    """The forest on fraud labels: rows and positives of both sides, and the rows its metrics count.

    Scores of a forest have no SQL; its metrics are tested by properties.
    """
    txn = t.bind_transactions(spark, sf)
    fitted = training.train(training.training_set(txn, stage_table(spine.model_history(txn), "snapshots")))
    sides = fitted.split.agg(
        F.count_if("is_train").alias("train_rows"), F.count_if(F.col("is_train") & (F.col("label") == 1)).alias("train_positives"),
        F.count_if(~F.col("is_train")).alias("test_rows"), F.count_if(~F.col("is_train") & (F.col("label") == 1)).alias("test_positives"))
    measured = fitted.metrics.selectExpr("tp + fp + fn + tn AS measured_rows")
    return sides.join(measured, how="cross")
