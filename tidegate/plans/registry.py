"""The registered queries: each with the Spark job and, where SQL can say it, a reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidegate.session import tune

DIGITS = 6
# added before rounding so that exact ties do not depend on the order of a float sum
NUDGE = 1e-9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def presentable(df: DataFrame) -> DataFrame:
    """Result columns in engine-neutral types: rounded doubles, zone-free times, text for arrays."""
    out = []
    for f in df.schema.fields:
        name = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            e = f"round({name} + {NUDGE:.9f}D, {DIGITS})"
        elif isinstance(f.dataType, T.TimestampType):
            e = f"cast({name} AS timestamp_ntz)"
        elif isinstance(f.dataType, T.ArrayType):
            e = f"concat_ws('|', {name})" if isinstance(f.dataType.elementType, T.StringType) else f"to_json({name})"
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            e = f"cast({name} AS bigint)"
        else:
            e = name
        out.append(f"{e} AS {name}")
    return df.selectExpr(*out)


def query(name: str, sql: str | None = None):
    """Register a query under ``name``."""
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presentable(fn(tune(spark), sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def r(expr: str) -> str:
    """The SQL twin of the rounding in ``presentable``."""
    return f"round(CAST({expr} AS DOUBLE) + {NUDGE}, {DIGITS})"
