"""Per-event features: trailing windows ending at each transaction, sequence and geography."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.functions.scalars import DAY, HOUR
from tidegate.operators.customer import DEFAULTS, RiskParams, ratio_sql
from tidegate.operators.slices import Running, fit_slice, running, trailing

CUSTOMER_WINDOWS = {"1h": HOUR, "24h": DAY, "7d": 7 * DAY, "30d": 30 * DAY}
MERCHANT_WINDOWS = {"7d": 7 * DAY, "30d": 30 * DAY}
EARTH_DIAMETER_KM = 12742.0


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """SQL: great-circle distance in kilometres."""
    return (
        f"{EARTH_DIAMETER_KM}D * asin(sqrt(least(1D, pow(sin(radians({lat2} - {lat1}) / 2), 2D) + cos(radians({lat1}))"
        f" * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2D))))"
    )


def customer_chain(txn: DataFrame, params: RiskParams = DEFAULTS, slice_seconds: int | None = None) -> DataFrame:
    """Trailing windows, previous event and run of high-value events, by slices of (customer, time).

    The run counts the high-value events up to this one within an hour: the events since the
    last one that is not of high value, from running row numbers, but no more than the hour's.
    ``txn`` may carry ``lat`` and ``lon``; the previous event then carries its own.
    """
    place = [c for c in ("lat", "lon") if c in txn.columns]

    def previous(prefix: str) -> str:
        return "struct(" + ", ".join(f"{prefix}{c}" for c in ("ts", "transaction_id", *place)) + ")"

    upto = "{rows} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    steps = [[
        f"sum(CASE WHEN _role = -1 THEN 1 END) OVER ({upto}) AS _n",
        f"max(CASE WHEN _role = -1 THEN {previous('_row.')} END) OVER ({{rows}} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _before",
    ]]
    rows = txn.filter("customer_id IS NOT NULL AND ts IS NOT NULL")
    width = slice_seconds or fit_slice(rows, ["customer_id"], "ts", HOUR)
    calm = f"NOT coalesce(amount > {params.high_value}D, false)"
    out = trailing(
        rows, ["customer_id"], "ts", {"c_n": "1", "c_amt": "amount"}, CUSTOMER_WINDOWS, width,
        wanted={"c_amt": ["7d", "30d"]}, spread={"c": ("amount", ["30d"])}, row_id="transaction_id",
        steps=steps, carried={"_last": f"max({previous('')})"},
        after=["coalesce(_before, _last) AS prev", "cast(_own_c_n AS bigint) - _n AS _later_peers"],
    )
    order = ["customer_id"], "ts", "transaction_id"
    out = running(out, *order, {"_rn": Running(F.lit(1).cast("bigint"))}, width)
    out = running(out, *order, {"_calm_rn": Running(F.expr(f"CASE WHEN {calm} THEN _rn END"), "max")}, width)
    return out.withColumn(
        "high_run", F.expr("least(_rn - coalesce(_calm_rn, 0), cast(c_n_1h AS bigint) - _later_peers)")
    ).drop("_rn", "_calm_rn", "_later_peers")


def merchant_windows(txn: DataFrame, slice_seconds: int | None = None) -> DataFrame:
    """Trailing count and sum per merchant at each event."""
    return trailing(
        txn.filter("merchant_id IS NOT NULL AND ts IS NOT NULL").select("transaction_id", "merchant_id", "ts", "amount"),
        ["merchant_id"], "ts", {"m_n": "1", "m_amt": "amount"}, MERCHANT_WINDOWS, slice_seconds,
    ).drop("merchant_id", "ts", "amount")


def first_visits(txn: DataFrame, where: list[str], flag: str) -> DataFrame:
    """Ids of the events that are the customer's first with this value of ``where``.

    Minimum per group with map-side combine; the ids are unique, so the join back to the
    events is on a key without skew."""
    firsts = txn.groupBy(*where).agg(F.min(F.struct("ts", "transaction_id")).alias("_first"))
    return firsts.selectExpr("_first.transaction_id AS transaction_id", f"1L AS {flag}")


def locate(txn: DataFrame, customers: DataFrame, merchants: DataFrame, countries: DataFrame) -> DataFrame:
    """Attach merchant country with its centroid, and the centroid of the customer's home."""
    here = merchants.selectExpr("merchant_id", "country AS merchant_country").join(
        countries.selectExpr("country AS merchant_country", "lat", "lon"), "merchant_country", "left"
    )
    home = customers.selectExpr("customer_id", "country AS home_country").join(
        countries.selectExpr("country AS home_country", "lat AS home_lat", "lon AS home_lon"), "home_country", "left"
    )
    return txn.join(here, "merchant_id", "left").join(home.drop("home_country"), "customer_id", "left")


def transaction_features(
    txn: DataFrame,
    customers: DataFrame,
    merchants: DataFrame,
    countries: DataFrame,
    params: RiskParams = DEFAULTS,
) -> DataFrame:
    """All transaction-level features, one row per transaction.

    The customer chain and the merchant windows each shuffle narrow rows by (key, time
    slice); their results meet on the unique transaction id.  Events without a customer,
    merchant or time keep their row with the features that need none.
    """
    base = txn.select("transaction_id", "customer_id", "merchant_id", "amount", "ts", "channel")
    located = locate(base, customers, merchants, countries)
    placed = located.filter("customer_id IS NOT NULL AND ts IS NOT NULL")
    # the width is taken before the lookups, whose size estimates multiply
    width = fit_slice(base, ["customer_id"], "ts", HOUR)
    f = customer_chain(located, params, width).unionByName(
        located.filter("customer_id IS NULL OR ts IS NULL"), allowMissingColumns=True
    )
    for part in (
        merchant_windows(base),
        first_visits(placed.filter("merchant_id IS NOT NULL"), ["customer_id", "merchant_id"], "new_merchant"),
        first_visits(placed.filter("merchant_country IS NOT NULL"), ["customer_id", "merchant_country"], "new_country"),
    ):
        f = f.join(part, "transaction_id", "left")
    elapsed = "(unix_micros(ts) - unix_micros(prev.ts)) / 1e6D"
    channels = (("MOBILE_APP", "mobile"), ("WEB", "web"), ("POS", "pos"), ("ATM", "atm"), ("WIRE", "wire"))

    def flag(cond: str) -> str:
        return f"cast(coalesce({cond}, false) AS bigint)"

    return f.selectExpr(
        "transaction_id", "customer_id", "merchant_id", "ts AS feature_timestamp",
        *[f"{ratio_sql('amount', f'(c_amt_{w} / nullif(c_n_{w}, 0D))')} AS txn_amount_to_cust_avg_ratio_{w}" for w in ("7d", "30d")],
        *[f"{ratio_sql('amount', f'(m_amt_{w} / nullif(m_n_{w}, 0D))')} AS txn_amount_to_merch_avg_ratio_{w}" for w in ("7d", "30d")],
        f"coalesce({elapsed}, 0D) AS txn_time_since_last_txn_sec",
        f"{flag('hour(ts) < 5')} AS txn_is_night_time_flag",
        f"{flag('weekday(ts) >= 5')} AS txn_is_weekend_flag",
        "cast(hour(ts) AS bigint) AS txn_hour_of_day",
        "cast(weekday(ts) AS bigint) AS txn_day_of_week",
        *[f"""{flag(f"channel = '{c}'")} AS txn_channel_is_{n}""" for c, n in channels],
        "coalesce((amount - c_amt_30d / nullif(c_n_30d, 0D)) / nullif(c_std_30d, 0D), 0D) AS txn_amount_zscore_30d",
        "coalesce(high_run, 0L) AS txn_consecutive_high_val_count",
        "coalesce(new_merchant, 0L) AS txn_is_first_time_merchant",
        "coalesce(new_country, 0L) AS txn_is_first_time_country",
        f"{ratio_sql('c_n_1h', '(c_n_24h / 24D)')} AS txn_velocity_spike_ratio_1h_vs_24h",
        f"{flag('amount > 0 AND pmod(amount, 100D) = 0')} AS txn_is_round_amount_flag",
        "least(1D, coalesce(c_n_1h, 0D) / 10D) AS txn_velocity_score",
        f"coalesce({haversine_sql('home_lat', 'home_lon', 'lat', 'lon')}, 0D) AS geo_distance_from_home_km",
        f"coalesce({haversine_sql('prev.lat', 'prev.lon', 'lat', 'lon')} / nullif({elapsed} / 3600D, 0D), 0D) AS geo_velocity_kph",
    )
