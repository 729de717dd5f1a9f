from pathlib import Path

import pytest

from tidegate.llm.common import prepare

CASES = [
    (1, "", "src0"), (2, None, "src0"), (3, "word", None), (4, "word", "src1"), (None, "no id here at all today", "src1"),
    (5, "same row twice is a case of its own here", "src0"), (5, "same row twice is a case of its own here", "src0"),
    (6, "   \n\t ", "src0"), (7, "long " * 20000, "src0"),
]



@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    prepare(spark)
    rows = [(i, t, s, 0, 1, "k", "n") for i, t, s in CASES]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key int, node int, lo string, score string")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return prepare(spark).read.parquet(f"{Path(sf_dir)}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture
def many_tasks(monkeypatch):
    """Small partitions stay apart, so that keys span tasks."""
    from tidegate import session

    monkeypatch.setitem(session.RUNTIME_CONF, "spark.sql.adaptive.coalescePartitions.enabled", "false")
