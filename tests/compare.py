"""Run registered queries against their reference SQL in DuckDB.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canon(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if v is not None and type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(canon(row[i]) for i in order) for row in rows), key=repr), [names[i] for i in order]


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message) of one query."""
    df = fn(spark, sf_dir)
    ours, our_names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs, their_names = rows_of(names, cur.fetchall())
    if our_names != their_names:
        return False, f"columns differ: {sorted(set(our_names) ^ set(their_names))}"
    if len(ours) != len(theirs):
        return False, f"rows {len(ours)} vs {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            diff = [(n, x, y) for n, x, y in zip(our_names, a, b) if x != y or type(x) is not type(y)]
            return False, f"first difference {diff[:6]} in {a[:4]}"
    return True, f"{len(ours)} rows"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, bad = e.oracle_sql(), []
    for name, fn in e.queries().items():
        if args and not any(a in name for a in args):
            continue
        start = time.time()
        try:
            if name in oracles:
                ok, message = compare(spark, con, name, fn, oracles[name], sf_dir)
            else:
                ok, message = True, f"{fn(spark, sf_dir).count()} rows (no SQL)"
        except Exception as ex:  # report and go on
            ok, message = False, f"{type(ex).__name__}: {str(ex)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:6.2f}s {message}", flush=True)
        if not ok:
            bad.append(name)
    print("failing:", bad)
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
