"""Describe a live frame in contract terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.session import one_row

from tidegate.functions.scalars import is_missing, normalize_type


def introspect(df: DataFrame) -> DataFrame:
    """One row per column: name, physical type, contract type, and whether a null occurs."""
    types = dict(df.dtypes)
    nulls = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(is_missing(F.col(f"`{c}`"), types[c])).alias(f"_n{i}") for i, c in enumerate(df.columns)],
    )
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("name"), F.lit(types[c]).alias("physical_type"),
            F.col(f"_n{i}").alias("null_count"),
        )
        for i, c in enumerate(df.columns)
    ])
    return nulls.select("_rows", F.explode(cells).alias("x")).select(
        "x.position", "x.name", "x.physical_type",
        normalize_type(F.col("x.physical_type")).alias("contract_type"),
        "x.null_count", (F.col("x.null_count") > 0).alias("observed_nullable"),
    )


def live_contract(df: DataFrame, dataset: str, scan_nulls: bool = False) -> DataFrame:
    """A frame's schema as a contract row for the schema diff.

    The types are the physical ones, so a drift of type is visible.  Nullability is what
    the schema declares, unless ``scan_nulls`` asks for the observed one.
    """
    if scan_nulls:
        columns = introspect(df).agg(
            F.array_sort(F.collect_list(F.struct("position", "name", "physical_type", "observed_nullable"))).alias("c")
        ).select(F.transform("c", lambda x: F.struct(
            x["name"].alias("name"), x["physical_type"].alias("type"), x["observed_nullable"].alias("nullable"),
        )).alias("c"))
    else:
        columns = one_row(df.sparkSession).select(F.array(*[
            F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
                     F.lit(f.nullable).alias("nullable"))
            for f in df.schema.fields
        ]).alias("c"))
    return columns.select(
        F.lit(dataset).alias("dataset"),
        F.lit("live").alias("version"),
        F.lit(None).cast("string").alias("owner"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("int").alias("freshness_sla_minutes"),
        F.lit("ACTIVE").alias("status"),
        F.transform("c", lambda x: F.struct(
            x["name"].alias("name"), x["type"].alias("type"), x["nullable"].alias("nullable"),
            F.lit(None).cast("boolean").alias("unique"), F.lit(None).cast("string").alias("description"),
            F.lit(None).cast("array<string>").alias("allowed_values"),
            F.lit(None).cast("double").alias("min"), F.lit(None).cast("double").alias("max"),
            F.lit(None).cast("array<string>").alias("keys"),
        )).alias("columns"),
        F.lit(None).cast("map<string,string>").alias("constraint_map"),
        F.lit(None).cast("array<string>").alias("constraint_texts"),
        F.lit(None).cast("array<string>").alias("root_keys"),
    )
