"""Column helpers shared by the operators.  All stay inside JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000
HOUR = 3_600
DAY = 86_400

# Physical and SQL type names and the contract type they stand for.
TYPE_ALIASES = {
    "int": "integer",
    "int4": "integer",
    "integer": "integer",
    "smallint": "integer",
    "tinyint": "integer",
    "int8": "bigint",
    "bigint": "bigint",
    "float": "float",
    "float4": "float",
    "float8": "float",
    "double": "float",
    "double precision": "float",
    "real": "float",
    "numeric": "numeric",
    "decimal": "numeric",
    "str": "string",
    "string": "string",
    "text": "string",
    "varchar": "string",
    "char": "string",
    "bool": "boolean",
    "boolean": "boolean",
    "date": "timestamp",
    "datetime": "timestamp",
    "time": "timestamp",
    "timestamp": "timestamp",
    "timestamptz": "timestamp",
    "timestamp_ntz": "timestamp",
}

# Type changes that lose nothing.
SAFE_WIDENINGS = [
    ("integer", "bigint"),
    ("integer", "numeric"),
    ("integer", "float"),
    ("bigint", "numeric"),
    ("float", "numeric"),
]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_type(c: str | Column) -> Column:
    """Canonical contract type: parameters stripped, aliases resolved, empty is string."""
    base = F.trim(F.lower(F.substring_index(F.trim(col(c)), "(", 1)))
    aliases = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in TYPE_ALIASES.items()) + ")")
    return F.when(F.coalesce(base, F.lit("")) == "", F.lit("string")).otherwise(
        F.coalesce(F.try_element_at(aliases, base), base)
    )


def micros(c: str | Column) -> Column:
    return F.unix_micros(col(c))


def slice_id(ts_micros: Column, seconds: int) -> Column:
    """Index of the time slice a microsecond instant falls into (floor, exact)."""
    width = F.lit(seconds * MICROS)
    return ((ts_micros - F.pmod(ts_micros, width)) / width).cast("bigint")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS))


def minutes_between(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier) / F.lit(60.0)


def is_missing(c: Column, dtype: str) -> Column:
    """Null, or NaN in a floating column."""
    if dtype in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def failure_signature(dataset, pipeline, check_name, check_type, column) -> Column:
    """Stable id of a failure: ``sig_`` and 16 hex digits of a SHA-256."""
    def part(c, default=""):
        return F.lower(F.trim(F.coalesce(col(c), F.lit(default))))

    canonical = F.concat_ws(
        "|",
        part(dataset),
        part(pipeline, "default_pipeline"),
        part(check_name),
        part(check_type),
        part(column),
    )
    return F.concat(F.lit("sig_"), F.substring(F.sha2(canonical, 256), 1, 16))


def display_name(identifier: str | Column) -> Column:
    """``fraud_score_job`` -> ``Fraud Score Job``."""
    return F.initcap(F.translate(col(identifier), "_", " "))
