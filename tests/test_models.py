"""Models read back by version: equal scores, null and absent features, an unknown version."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegate.operators import scoring, training

NOW = dt.datetime(2024, 3, 1)


def test_a_published_model_scores_as_the_fitted_one(spark, tmp_path):
    root = str(tmp_path)
    data = spark.range(120).select(
        F.col("id").alias("transaction_id"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"),
        (F.col("id") % 10 > 6).cast("double").alias("label"))
    fitted = {}
    for minute, version, trees in ((1, "v1", 1), (0, "v2", 4), (2, "v1", 3)):
        fitted[version] = training.train(data, ["a", "b"], model_version=version, trees=trees, depth=3)
        fitted[version].publish(root, NOW + dt.timedelta(minutes=minute))
    newest = scoring.load_version(spark, root)
    assert (newest.version, newest.features) == ("v1", ["a", "b"])
    # a version published again is replaced
    assert len(newest.model.stages[-1].trees) == 3 and len(scoring.load_version(spark, root, "v2").model.stages[-1].trees) == 4
    with pytest.raises(LookupError):
        scoring.load_version(spark, root, "v9")

    def scores(df):
        return {r["transaction_id"]: r["risk_score"] for r in df.select("transaction_id", "risk_score").collect()}

    assert scores(scoring.score_stored(data, newest)) == scores(scoring.score_with_model(data, fitted["v1"].model, "v1"))
    zero = scores(scoring.score_stored(data.withColumns({"a": F.lit(0), "b": F.lit(0.0)}), newest))
    assert scores(scoring.score_stored(data.withColumn("a", F.lit(None).cast("double")).drop("b"), newest)) == zero
    assert scoring.score_stored(data.limit(0), newest).count() == 0
