"""Digest columns of span lists, shared by the scanners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:long,end:long>>"


def joined(column: str) -> Column:
    """kind:start:end of every span, comma-joined in the order given."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(column: str, kind: str) -> Column:
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")


def digest(spans, kinds: tuple[str, ...]):
    """Query columns from frames with doc_id, base and spans."""
    return spans.select(
        "doc_id", *[of_kind("base", k).alias(f"n_{k}") for k in kinds],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def ordered(found: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> list[dict]:
    """By start, then kind as listed, then end."""
    rank = {k: i for i, k in enumerate(kinds)}
    return [{"kind": k, "start": s, "end": e} for k, s, e in sorted(set(found), key=lambda x: (x[1], rank[x[0]], x[2]))]
