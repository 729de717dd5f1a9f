"""Ad-hoc JSON records: typed columns, what did not fit, and the checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegate.sources import records

CONTRACT = {"dataset": "x", "columns": [
    {"name": "id", "type": "integer", "nullable": False, "unique": True}, {"name": "amount", "type": "float", "nullable": True, "min": 0},
    {"name": "at", "type": "timestamp", "nullable": True}, {"name": "ok", "type": "boolean", "nullable": True},
    {"name": "note", "type": "string", "nullable": True}]}
NOT_NULL, UNIQUE, BETWEEN = (f"expect_column_values_to_{x}" for x in ("not_be_null_id", "be_unique_id", "be_between_amount"))


@pytest.mark.parametrize("text,columns,rescued,violations", [
    ('{"id": 1, "amount": 2.5, "at": "2024-01-02 03:04:05", "ok": true, "note": "n"}', (1, 2.5, dt.datetime(2024, 1, 2, 3, 4, 5), True, "n"), {}, []),
    ('{"id": "7", "note": 5}', (7, None, None, None, "5"), {}, []),
    ('{"id": 1, "amount": "abc", "extra": [1, 2]}', (1, None, None, None, None), {"amount": "abc", "extra": "[1,2]"}, ["type:amount"]),
    ('{"id": 1, "ok": {"a": 1}, "note": {"b": 2}}', (1, None, None, None, '{"b":2}'), {"ok": '{"a":1}'}, ["type:ok"]),
    ('{"id": null, "amount": -1}', (None, -1.0, None, None, None), {}, [NOT_NULL, BETWEEN]),
    ('{}', (None,) * 5, {}, [NOT_NULL]),
    ('{"id": 1, "amount": 2', (None,) * 5, {"_record": '{"id": 1, "amount": 2'}, ["malformed_record"]),
    ('[{"id": 1}]', (None,) * 5, {"_record": '[{"id": 1}]'}, ["malformed_record"]),
    ('12', (None,) * 5, {"_record": "12"}, ["malformed_record"]),
    ('', (None,) * 5, {"_record": ""}, ["malformed_record"]),
    (None, (None,) * 5, {"_record": None}, ["malformed_record"]),
])
def test_one_record(spark, text, columns, rescued, violations):
    row = records.check(spark.createDataFrame([(text,)], "value string"), CONTRACT).first()
    assert tuple(row[c["name"]] for c in CONTRACT["columns"]) == columns
    assert (row["_rescued"], row["violations"]) == (rescued, violations)


def test_duplicates_empty_input_and_the_suite(spark):
    df = spark.createDataFrame([('{"id": 1}',), ('{"id": 1}',), ('{"id": 2}',), ("x",)], "value string")
    got = sorted(tuple(r["violations"]) for r in records.check(df, CONTRACT).collect())
    assert got == [(), (UNIQUE,), (UNIQUE,), ("malformed_record",)]
    assert records.check(df.limit(0), CONTRACT).count() == 0
    status = {r["check_name"]: r["status"] for r in records.suite(df, CONTRACT).collect()}
    assert status[UNIQUE] == "FAIL" and status[NOT_NULL] == "FAIL" and status[BETWEEN] == "PASS"
    assert "Python" not in records.parse(df, CONTRACT)._jdf.queryExecution().executedPlan().toString()
