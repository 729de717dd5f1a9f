"""First and latest visits per (key, merchant), kept as a table.

New merchants and dormancy need all history.  Instead of scanning it for every snapshot, each
day adds one delta with the visits of its own rows, up to a high-water mark; now and then the
deltas are folded into a base.  A snapshot then reads the table up to its horizon and the rows
after the mark.  The log names the time range of every folder and is written after the
folder, so a step that dies leaves nothing a reader sees, and a step done again replaces itself.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators.customer import HORIZON, instant
from tidegate.session import one_row
from tidegate.sources import stores

# deltas that a reader folds at most before the next step writes a base
FOLD_AFTER = 16


def _log(key: str) -> str:
    return f"visits_{key}_log"


def _steps(spark: SparkSession, root: str, key: str, until: dt.datetime | None = None) -> list:
    """The folders that cover history up to the latest mark (not after ``until``): a base, then
    deltas.  The log has one row per step ever made, some hundreds a year."""
    if not stores.path_exists(spark, f"{root}/{_log(key)}"):
        return []
    log = stores.read_log(spark, root, _log(key))
    if until is not None:
        log = log.filter(F.col("upto") <= F.lit(until).cast("timestamp"))
    rows = sorted(log.collect(), key=lambda r: r["upto"])
    bases = [r for r in rows if r["after"] is None]
    if not bases:
        return []
    chain = [bases[-1]]
    for row in rows:
        if row["after"] is not None and row["after"] == chain[-1]["upto"]:
            chain.append(row)
    return chain


def _fold(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key, "merchant_id").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("visits").alias("visits")
    )


def _read(spark: SparkSession, steps: list) -> DataFrame:
    return spark.read.parquet(*[s["folder"] for s in steps])


def mark(spark: SparkSession, root: str, key: str, until: dt.datetime | None = None) -> dt.datetime | None:
    """The time up to which the table (as of ``until``) knows all visits; None without a table."""
    steps = _steps(spark, root, key, until)
    return steps[-1]["upto"] if steps else None


def advance(txn: DataFrame, root: str, key: str, until: dt.datetime, fold_after: int = FOLD_AFTER) -> None:
    """Add the visits after the mark and not after ``until``; only those rows of ``txn`` are read.

    Rows without a key have no visits; a null merchant is a merchant of its own.  A call with
    ``until`` not after the mark changes nothing.  Rows that arrive behind the mark are not
    seen, so keep the mark as far behind the present as rows come late (a snapshot needs it
    30 days behind anyway).
    """
    spark = txn.sparkSession
    steps = _steps(spark, root, key)
    after = steps[-1]["upto"] if steps else None
    if after is not None and until <= after:
        return
    rows = txn.filter(f"{key} IS NOT NULL AND ts <= {instant(until)}")
    if after is not None:
        rows = rows.filter(f"ts > {instant(after)}")
    new = _fold(rows.selectExpr(key, "merchant_id", "ts AS first_ts", "ts AS last_ts", "1L AS visits"), key)
    if len(steps) > fold_after:
        new, after = _fold(_read(spark, steps).select(*new.columns).unionByName(new), key), None
    kind = "base" if after is None else "delta"
    entry = f"{kind}_{until:%Y%m%dT%H%M%S%f}"
    folder = f"{root}/visits_{key}/{entry}"
    new.write.mode("overwrite").parquet(folder)
    row = one_row(spark).select(
        F.lit(folder).alias("folder"), F.lit(after).cast("timestamp").alias("after"), F.lit(until).cast("timestamp").alias("upto")
    )
    stores.write_log(row, root, _log(key), entry)


def table(spark: SparkSession, root: str, key: str, until: dt.datetime | None = None) -> DataFrame | None:
    """Visits per (key, merchant) up to the mark: first and latest time, and their number."""
    steps = _steps(spark, root, key, until)
    return _fold(_read(spark, steps), key) if steps else None


def history(txn: DataFrame, root: str, key: str, as_of: dt.datetime) -> DataFrame:
    """What ``customer_features`` and ``account_features`` need as history at ``as_of``.

    The rows after the mark as they are, and before it one row per (key, merchant) at its
    latest visit, which carries its first one.  The mark used lies before the 30 days, whose rows are
    needed one by one; where none does, all of ``txn`` is read.
    """
    spark = txn.sparkSession
    before = as_of - dt.timedelta(seconds=HORIZON, microseconds=1)
    steps = _steps(spark, root, key, before)
    rows = txn.filter(f"ts <= {instant(as_of)}")
    if steps:
        rows = rows.filter(f"ts > {instant(steps[-1]['upto'])}")
    rows = rows.selectExpr(key, "merchant_id", "ts", "amount", "ts AS first_ts")
    if not steps:
        return rows
    # a stored visit lies before every window, so its amount counts nowhere
    stored = _read(spark, steps).selectExpr(key, "merchant_id", "last_ts AS ts", "cast(NULL AS double) AS amount", "first_ts")
    return rows.unionByName(stored)
