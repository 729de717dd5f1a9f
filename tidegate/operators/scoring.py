"""Rule scores, the prediction log, and model scores on assembled rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.5


def rule_score(amount: Column, burst: Column, failed: Column) -> Column:
    """Bounded sum of an amount part and a burst and a failure part."""
    amount_part = F.least(F.lit(0.5), amount / F.lit(2000.0) * F.lit(0.3))
    return F.least(F.lit(0.99), F.greatest(F.lit(0.02), amount_part + burst * F.lit(0.25) + failed * F.lit(0.20)))


def score(assembled: DataFrame, amount: str = "amount", model_version: str = "rules-v1") -> DataFrame:
    """Rows with risk score (4 digits) and prediction, by the rule score."""
    raw = rule_score(F.col(amount), F.col("burst_txn_count_10min"), F.col("cust_failed_txn_count_24h"))
    return assembled.withColumns({
        "risk_score": F.round(raw, 4),
        "prediction": F.when(raw >= THRESHOLD, 1).otherwise(0),
        "model_version": F.lit(model_version),
    })


def score_with_model(assembled: DataFrame, model, model_version: str) -> DataFrame:
    """Rows scored by a fitted pipeline model."""
    from pyspark.ml.functions import vector_to_array

    raw = vector_to_array("probability")[1]
    return model.transform(assembled).withColumns({
        "risk_score": F.round(raw, 4),
        "prediction": F.when(raw >= THRESHOLD, 1).otherwise(0),
        "model_version": F.lit(model_version),
    }).drop("rawPrediction", "probability", "features_vector")


@dataclass(frozen=True)
class StoredModel:
    """A model read back from disk, with what its metadata say."""

    model: object
    version: str
    features: list[str]


def load_model(spark: SparkSession, path: str) -> StoredModel:
    """The model that ``training.Fitted.save`` wrote at ``path``."""
    from pyspark.ml import PipelineModel

    row = spark.read.parquet(f"{path}/metadata").first()
    return StoredModel(PipelineModel.load(f"{path}/model"), row["model_version"], list(row["features_used"]))


def load_version(spark: SparkSession, root: str, version: str | None = None) -> StoredModel:
    """The model of a version below ``root``, or of the one published last."""
    from tidegate.sources.stores import read_log

    rows = read_log(spark, root, "models")
    if version is not None:
        rows = rows.filter(F.col("model_version") == version)
    found = rows.agg(F.max_by("path", F.struct("published_at", "model_version")).alias("path")).first()["path"]
    if found is None:
        raise LookupError(f"no model {version or ''} below {root}")
    return load_model(spark, found)


def score_stored(rows: DataFrame, stored: StoredModel) -> DataFrame:
    """Batch or stream rows scored by a stored model; a null or absent feature counts as 0."""
    known = set(rows.columns)
    filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in known else F.lit(0.0) for f in stored.features}
    return score_with_model(rows.withColumns(filled), stored.model, stored.version)


def prediction_log(scored: DataFrame, row_id: str, created_at: Column) -> DataFrame:
    """Scored rows in the shape of the prediction log."""
    return scored.select(
        F.concat(F.lit("pred_"), F.col(row_id).cast("string")).alias("prediction_id"),
        F.col("customer_id").cast("string").alias("customer_id"),
        "risk_score", "prediction", "model_version", created_at.cast("timestamp").alias("created_at"),
    )
