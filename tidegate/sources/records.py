"""Ad-hoc JSON records to a checked frame: typed by a contract, with what did not fit kept beside."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators import quality as q

# Types a contract may name, and the type a frame gets for them.
TYPES = {
    "integer": "bigint", "int": "bigint", "bigint": "bigint", "long": "bigint",
    "float": "double", "double": "double", "number": "double",
    "boolean": "boolean", "bool": "boolean",
    "timestamp": "timestamp", "datetime": "timestamp", "date": "date", "string": "string",
}
MALFORMED = "malformed_record"


def _text(column: str) -> Column:
    return F.col("_fields").getItem(column)


def parse(records: DataFrame, contract: Mapping, value: str = "value") -> DataFrame:
    """One row per record: the contract's columns, ``_rescued`` and ``_errors``.

    A record is one JSON object.  A field that is missing or null is null.  A field whose text
    is not of the contract's type is null, is kept in ``_rescued`` and named in ``_errors``
    as ``type:<column>``; fields the contract does not name are kept in ``_rescued`` only.  Text that
    is no JSON object (null and empty text too) has null columns, itself under ``_record`` in
    ``_rescued``, and the error ``malformed_record``.  Types unknown here are text.  A record
    gives one row whatever it holds; the plan is one narrow pass without Python.
    """
    columns = [(c["name"], TYPES.get(str(c.get("type", "string")).lower(), "string"))
               for c in contract.get("columns", []) if c.get("name")]
    names = F.array(*[F.lit(n) for n, _ in columns]).cast("array<string>")
    raw = F.col(f"`{value}`").cast("string")
    # a map of texts keeps every field, whatever its type; an object that ends early is no object
    parsed = records.select(raw.alias("_raw"), F.from_json(raw, "map<string,string>", {"mode": "PERMISSIVE"}).alias("_map")).select(
        "_raw", F.when(F.coalesce(F.col("_raw").rlike(r"^\s*\{"), F.lit(False)), F.col("_map")).alias("_fields"))

    def typed(name: str, kind: str) -> Column:
        return _text(name) if kind == "string" else F.trim(_text(name)).try_cast(kind)

    bad = {n: _text(n).isNotNull() & typed(n, k).isNull() for n, k in columns}
    misfits = F.array_compact(F.array(*[F.when(bad[n], F.lit(n)) for n, _ in columns]).cast("array<string>"))
    rescued = F.map_filter("_fields", lambda k, v: ~F.array_contains(names, k) | F.array_contains(F.col("_misfits"), k))
    broken = F.col("_fields").isNull()
    return parsed.withColumn("_misfits", F.coalesce(misfits, F.array().cast("array<string>"))).select(
        *[typed(n, k).alias(n) for n, k in columns],
        F.when(broken, F.create_map(F.lit("_record"), F.col("_raw"))).otherwise(rescued).alias("_rescued"),
        F.when(broken, F.array(F.lit(MALFORMED))).otherwise(F.transform("_misfits", lambda c: F.concat(F.lit("type:"), c))).alias("_errors"),
    )


def check(records: DataFrame, contract: Mapping, value: str = "value") -> DataFrame:
    """Parsed records with ``violations``: the parse errors, then the checks a record breaks."""
    marked = q.quarantine(parse(records, contract, value), contract)
    # a malformed record has no columns to check
    broken = F.array_contains("_errors", MALFORMED)
    found = F.when(broken, F.col("_errors")).otherwise(F.concat("_errors", "violations"))
    return marked.withColumn("violations", found).drop("_errors")


def suite(records: DataFrame, contract: Mapping, value: str = "value") -> DataFrame:
    """The contract's suite on ad-hoc records: one row per check."""
    return q.run_suite(parse(records, contract, value).drop("_rescued", "_errors"), contract)
