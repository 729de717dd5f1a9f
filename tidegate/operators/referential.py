"""Foreign-key checks: child keys that no parent row has."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.session import one_row

# The domain's relationships, child -> (child column, parent, parent column).
RELATIONSHIPS = {
    "orders": [("customer_id", "customers", "customer_id")],
    "order_items": [("order_id", "orders", "order_id"), ("product_id", "products", "product_id")],
    "payments": [("order_id", "orders", "order_id")],
    "accounts": [("customer_id", "customers", "customer_id")],
    "transactions": [
        ("customer_id", "customers", "customer_id"),
        ("account_id", "accounts", "account_id"),
        ("merchant_id", "merchants", "merchant_id"),
    ],
    "fraud_events": [("transaction_id", "transactions", "transaction_id")],
    "user_sessions": [("customer_id", "customers", "customer_id")],
    "card_tokens": [("customer_id", "customers", "customer_id")],
    "chargeback_disputes": [("transaction_id", "transactions", "transaction_id")],
}
SAMPLE_SIZE = 5


def orphan_keys(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Distinct child keys with their row count and whether a parent has them.

    The child reduces to its distinct keys before the join, so a hot key is one row there.
    Keys compare as text, as two sources may type the same key differently.
    """
    keys = (
        child.filter(F.col(child_column).isNotNull())
        .groupBy(F.col(child_column).cast("string").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = (
        parent.filter(F.col(parent_column).isNotNull())
        .select(F.col(parent_column).cast("string").alias("key"))
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    return keys.join(known, "key", "left").select("key", "n", F.col("_known").isNull().alias("orphan"))


def foreign_key_check(
    dataset: str, child: DataFrame, child_column: str,
    parent_name: str, parent: DataFrame | None, parent_column: str,
) -> DataFrame:
    """One check-result row for one relationship."""
    from tidegate.operators.quality import FOREIGN_KEY

    spark = child.sparkSession
    head = {
        "dataset": F.lit(dataset),
        "check_name": F.lit(f"foreign_key_{dataset}_{child_column}_in_{parent_name}_{parent_column}"),
        "column": F.lit(child_column),
        "expectation_type": F.lit(FOREIGN_KEY),
    }

    def row(df, status, severity, observed, expected, success, unexpected, base, details):
        return df.select(
            *[v.alias(k) for k, v in head.items()],
            status.alias("status"), severity.alias("severity"), observed.alias("observed_value"),
            expected.alias("expected_value"), success.alias("success"),
            unexpected.cast("bigint").alias("unexpected"), base.cast("bigint").alias("base"),
            details.alias("details"),
        )

    one, none = one_row(spark), F.lit(None)
    if parent is None:
        return row(one, F.lit("WARNING"), F.lit("MEDIUM"),
                   F.lit(f"Error evaluating referential check: {parent_name} not found"),
                   F.lit(f"Reference to {parent_name}.{parent_column}"), F.lit(False), none, none,
                   F.lit('{"error":"parent not found"}'))
    for df, column, text in ((child, child_column, "Column missing"), (parent, parent_column, "Parent PK missing")):
        if column not in df.columns:
            return row(one, F.lit("FAIL"), F.lit("CRITICAL"), F.lit(text), F.lit(f"Column '{column}' exists"),
                       F.lit(False), none, none, F.lit('{"error":"column missing"}'))
    keys = orphan_keys(child, child_column, parent, parent_column)
    sample = keys.filter("orphan").orderBy("key").limit(SAMPLE_SIZE).agg(
        F.array_sort(F.collect_list("key")).alias("sample"), F.lit(1).alias("_one")
    )
    counts = keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("orphan"), F.col("n"))), F.lit(0)).alias("orphans"),
        F.lit(1).alias("_one"),
    )
    both = counts.join(sample, "_one")
    total, orphans = F.col("total"), F.col("orphans")
    percent = F.when(total > 0, F.round(100.0 * orphans / total, 2)).otherwise(F.lit(0.0))
    ok = orphans == 0
    observed = F.when(total == 0, F.lit("0 child records")).otherwise(
        F.concat(orphans.cast("string"), F.lit(" orphan(s) ("), percent.cast("string"), F.lit("%)"))
    )
    details = F.to_json(F.struct(
        F.lit(parent_name).alias("parent_dataset"), F.lit(parent_column).alias("parent_pk_column"),
        total.alias("total_child_records"), orphans.alias("orphan_count"), percent.alias("orphan_percent"),
        F.col("sample").alias("sample_orphan_keys"),
    ))
    return row(both, F.when(ok, "PASS").otherwise("FAIL"), F.lit("CRITICAL"), observed,
               F.lit("0 orphans (100% referential match)"), ok, orphans, total, details)


def referential_checks(
    dataset: str, child: DataFrame, parents: Mapping[str, DataFrame],
    relationships: Sequence[tuple[str, str, str]],
) -> DataFrame:
    """All relationships of one child dataset."""
    rows = [
        foreign_key_check(dataset, child, column, parent, parents.get(parent), parent_column)
        for column, parent, parent_column in relationships
    ]
    return reduce(DataFrame.unionByName, rows)


def all_referential_checks(
    tables: Mapping[str, DataFrame], relationships: Mapping[str, Sequence[tuple[str, str, str]]] = RELATIONSHIPS
) -> DataFrame:
    """Every relationship whose child table is present."""
    rows = [
        referential_checks(child, tables[child], tables, specs)
        for child, specs in relationships.items() if child in tables
    ]
    return reduce(DataFrame.unionByName, rows)
