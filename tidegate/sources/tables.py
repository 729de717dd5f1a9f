"""Dataset scans, and the roles the supplied test tables play.

``Catalog`` resolves a dataset name to files.  The ``bind_*`` functions give the supplied
tables the shape of the domain tables (transactions, customers, merchants, accounts); they
only rename and derive columns, so filters and column pruning still reach the scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Payment channels and merchant categories of the domain.
CHANNELS = ["WEB", "MOBILE_APP", "POS", "ATM", "WIRE"]
CATEGORIES = ["RETAIL", "GROCERY", "TRAVEL", "CRYPTO", "GAMBLING", "DINING", "ELECTRONICS"]
HIGH_RISK_CATEGORIES = ["CRYPTO", "GAMBLING"]


class DatasetNotFound(LookupError):
    pass


class Catalog:
    """Find a dataset by name: raw Parquet, then raw CSV, then the offline store."""

    def __init__(self, spark: SparkSession, raw: str, offline: str | None = None):
        self.spark, self.raw, self.offline = spark, raw.rstrip("/"), offline and offline.rstrip("/")

    def _exists(self, path: str) -> bool:
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return bool(fs.exists(hadoop_path))

    def load(
        self,
        name: str,
        columns: Sequence[str] | None = None,
        csv_schema: T.StructType | None = None,
    ) -> DataFrame:
        parquet, csv = f"{self.raw}/{name}.parquet", f"{self.raw}/{name}.csv"
        if self._exists(parquet):
            df = self.spark.read.parquet(parquet)
        elif self._exists(csv):
            reader = self.spark.read.option("header", True)
            df = (reader.schema(csv_schema) if csv_schema else reader).csv(csv)
        elif self.offline and self._exists(f"{self.offline}/{name}"):
            df = self.spark.read.parquet(f"{self.offline}/{name}")
        elif self.offline and self._exists(f"{self.offline}/{name}.parquet"):
            df = self.spark.read.parquet(f"{self.offline}/{name}.parquet")
        else:
            raise DatasetNotFound(name)
        return df.select(*columns) if columns else df


# Declared schemas of the supplied tables: reading them needs no job to infer one.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def latest_event_time(spark: SparkSession, sf_dir: str) -> dt.datetime:
    """The global snapshot time: one scalar, read from one column."""
    return table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]


def sql_list(values: Sequence[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def shape_transactions(events: DataFrame) -> DataFrame:
    """Transactions from rows of ``events`` (batch or stream)."""
    return events.selectExpr(
        "event_id AS transaction_id", "user_id AS customer_id", "user_id AS account_id",
        "cast(get_json_object(props, '$.k') AS bigint) AS merchant_id",
        "value AS amount", "cast(ts AS timestamp) AS ts",
        "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'REFUNDED' ELSE 'APPROVED' END AS status",
        f"element_at({sql_list(CHANNELS)}, cast(pmod(event_id, {len(CHANNELS)}) AS int) + 1) AS channel",
        "cast(event_type = 'purchase' AND value > 100 AS int) AS is_fraud",
    )


def bind_transactions(
    spark: SparkSession,
    sf_dir: str,
    since: dt.datetime | None = None,
    until: dt.datetime | None = None,
) -> DataFrame:
    """``events`` as transactions.  The bounds (both inclusive) are put on the stored
    column, below the cast, so that they reach the Parquet reader."""
    events = table(spark, sf_dir, "events")
    stored = events.schema["ts"].dataType
    if since is not None:
        events = events.filter(F.col("ts") >= F.lit(since).cast(stored))
    if until is not None:
        events = events.filter(F.col("ts") <= F.lit(until).cast(stored))
    return shape_transactions(events)


def with_nation(df: DataFrame, key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").selectExpr(f"n_nationkey AS {key}", "n_name AS country")
    return df.join(nations, key, "left")


def bind_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey AS customer_id", "c_nationkey")
    return with_nation(rows, "c_nationkey", spark, sf_dir).select("customer_id", "country")


def bind_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS merchant_id", "s_nationkey",
        f"element_at({sql_list(CATEGORIES)}, cast(pmod(s_suppkey, {len(CATEGORIES)}) AS int) + 1) AS merchant_category",
        "least(1D, greatest(0.01D, (s_acctbal + 1000) / 11000)) AS risk_score",
    )
    return with_nation(rows, "s_nationkey", spark, sf_dir).drop("s_nationkey")


def bind_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS account_id", "c_custkey AS customer_id",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'CREDIT' WHEN 'MACHINERY' THEN 'SAVINGS' ELSE 'CHECKING' END AS account_type",
        "cast(date_sub(DATE'2024-01-01', cast(pmod(c_custkey, 400) AS int)) AS timestamp) AS created_at",
        "c_acctbal AS current_balance",
        "CASE WHEN c_mktsegment = 'BUILDING' THEN 10000D END AS credit_limit",
    )


def bind_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country centroids: a spread of points over the globe, one per nation."""
    return table(spark, sf_dir, "nation").selectExpr(
        "n_name AS country", "n_nationkey * 6D - 72D AS lat", "n_nationkey * 13D - 160D AS lon"
    )


def bind_fraud_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fraud confirmations: one per fraudulent transaction, 30 minutes later."""
    fraud = bind_transactions(spark, sf_dir).filter(F.col("is_fraud") == 1)
    return fraud.select(
        F.concat(F.lit("fevt_"), F.col("transaction_id").cast("string")).alias("event_id"),
        "transaction_id",
        "customer_id",
        (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("confirmed_at"),
        F.element_at(
            F.array(F.lit("CARD_TESTING"), F.lit("ACCOUNT_TAKEOVER"), F.lit("IDENTITY_THEFT")),
            F.pmod(F.col("transaction_id"), F.lit(3)).cast("int") + 1,
        ).alias("fraud_type"),
    )
