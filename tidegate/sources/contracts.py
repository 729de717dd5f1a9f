"""Reading data contracts: a set of YAML or JSON documents becomes a contract table."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.session import one_row

COLUMN_TYPE = (
    "struct<name:string,type:string,nullable:boolean,unique:boolean,description:string,"
    "allowed_values:array<string>,min:double,max:double,keys:array<string>>"
)
CONTRACT_SCHEMA = (
    "dataset string, version string, owner string, description string, "
    "freshness_sla_minutes int, status string, "
    f"columns array<{COLUMN_TYPE}>, constraint_map map<string,string>, "
    "constraint_texts array<string>, root_keys array<string>"
)


def flatten_contract(doc: Mapping) -> dict:
    """A contract document in the shape of ``CONTRACT_SCHEMA``.

    ``keys`` and ``root_keys`` remember which fields were written down, so that a missing
    field and an explicit null stay apart.  What is no mapping counts as an empty document.
    """
    doc = doc if isinstance(doc, Mapping) else {}

    def text(v):
        return None if v is None else str(v)

    def number(v):
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None

    constraints = doc.get("constraints")
    columns = []
    for c in doc.get("columns") or []:
        if not isinstance(c, Mapping):
            continue
        values = c.get("allowed_values")
        columns.append({
            "name": text(c.get("name")),
            "type": text(c.get("type")),
            "nullable": c.get("nullable"),
            "unique": c.get("unique"),
            "description": text(c.get("description")),
            "allowed_values": [str(v) for v in values] if isinstance(values, list) else None,
            "min": number(c.get("min")),
            "max": number(c.get("max")),
            "keys": [str(k) for k in c],
        })
    sla = doc.get("freshness_sla_minutes")
    return {
        "dataset": text(doc.get("dataset")),
        "version": text(doc.get("version")),
        "owner": text(doc.get("owner")),
        "description": text(doc.get("description")),
        "freshness_sla_minutes": sla if isinstance(sla, int) else None,
        "status": text(doc.get("status", "ACTIVE")),
        "columns": columns,
        "constraint_map": {str(k): json.dumps(v) if isinstance(v, (dict, list)) else str(v)
                           for k, v in constraints.items()} if isinstance(constraints, Mapping) else None,
        "constraint_texts": [str(v) for v in constraints] if isinstance(constraints, list) else None,
        "root_keys": [str(k) for k in doc],
    }


def contracts_frame(spark: SparkSession, docs: list[Mapping]) -> DataFrame:
    """Contract documents that the driver already holds, as a table."""
    lines = F.array(*[F.lit(json.dumps(flatten_contract(d))) for d in docs])
    return one_row(spark).select(F.explode(lines).alias("j")).select(
        F.from_json("j", CONTRACT_SCHEMA).alias("c")
    ).select("c.*")


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """A folder of ``*.yaml`` / ``*.yml`` / ``*.json`` contracts, one document per file."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{yaml,yml,json}")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import yaml
            load = yaml.safe_load  # JSON is a subset of YAML
        except ImportError:
            load = json.loads
        for batch in batches:
            yield pd.DataFrame({"j": [json.dumps(flatten_contract(load(v))) for v in batch["value"]]})

    return files.mapInPandas(parse, "j string").select(
        F.from_json("j", CONTRACT_SCHEMA).alias("c")
    ).select("c.*")
