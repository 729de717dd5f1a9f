"""Training: sample, point-in-time features, stratified split, forest, metrics."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.operators.asof import asof_join
from tidegate.operators.online import MODEL_FEATURES

SEED = 42
# split shares are measured in 1/HASH_BUCKETS of the hash range
HASH_BUCKETS = 1 << 20


def hash_order(row_id: str, seed: int = SEED) -> Column:
    """A pseudo-random but repeatable order: it depends on the row, not on partitioning."""
    return F.xxhash64(F.col(row_id), F.lit(seed))


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows without replacement (all of them if fewer), first by the md5 of id and seed, which any engine has."""
    # a column of its own, or every comparison would take the md5 of both rows
    hashed = df.withColumn("_md5", F.md5(F.concat_ws("-", F.col(row_id), F.lit(seed)).cast("binary")))
    return hashed.orderBy("_md5", row_id).limit(n).drop("_md5")


def stratified_split(
    df: DataFrame, row_id: str, label: str, train_share: float = 0.75, seed: int = SEED
) -> DataFrame:
    """Mark rows as train or test so that every label is cut at ``train_share``.

    Rows are ranked per label by hash.  A label can hold most rows, so ranks come from
    counts per hash bucket: only the one bucket per label that contains the cut is ranked.
    """
    ranked = df.withColumn("_h", hash_order(row_id, seed)).withColumn(
        "_b", F.pmod(F.col("_h"), F.lit(HASH_BUCKETS))
    )
    from pyspark.sql import Window

    sizes = ranked.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(label).orderBy("_b")
    whole = Window.partitionBy(label)
    starts = sizes.select(
        label, "_b",
        (F.sum("_c").over(upto) - F.col("_c")).alias("_start"), F.sum("_c").over(whole).alias("_n"),
    )
    inside = Window.partitionBy(label, "_b").orderBy("_h", row_id)
    rank = F.col("_start") + F.row_number().over(inside)
    # rows without a label are a class of their own
    met = ranked.alias("r").join(starts.alias("s"), F.expr(f"r.{label} <=> s.{label} AND r._b = s._b"), "inner")
    return (
        met.select("r.*", "s._start", "s._n")
        .withColumn("is_train", rank <= F.round(F.col("_n") * train_share))
        .drop("_h", "_b", "_start", "_n")
    )


def training_set(
    observations: DataFrame, snapshots: DataFrame, key: str = "customer_id", obs_ts: str = "ts",
    label: str = "is_fraud", row_id: str = "transaction_id", n: int | None = 5000,
    features: list[str] | None = None,
) -> DataFrame:
    """Sampled observations with their point-in-time features, nulls as 0, and the label.

    ``n`` bounds the labelled rows the classifier is fitted on; None takes all.
    """
    names = features or MODEL_FEATURES
    rows = observations.select(row_id, key, "amount", obs_ts, label)
    if n is not None:
        rows = sample_rows(rows, row_id, n)
    joined = asof_join(rows, snapshots, key, obs_ts, columns=names)
    return joined.select(
        row_id, key, obs_ts,
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names],
        F.col(label).cast("double").alias("label"),
    )


@dataclass(frozen=True)
class Fitted:
    model: object
    metrics: DataFrame
    metadata: DataFrame
    split: DataFrame

    def save(self, path: str) -> None:
        """The model and, beside it, its metadata; an earlier one at the path is replaced."""
        self.model.write().overwrite().save(f"{path}/model")
        self.metadata.write.mode("overwrite").parquet(f"{path}/metadata")

    def publish(self, root: str, at: dt.datetime) -> None:
        """Save the model below ``root`` in a folder of its own; the row that makes it its version's model is written last."""
        from tidegate.session import one_row
        from tidegate.sources.stores import write_log

        version = self.metadata.first()["model_version"]
        path = f"{root}/models_saved/{version}-{uuid.uuid4().hex[:12]}"
        self.save(path)
        row = one_row(self.metadata.sparkSession).select(
            F.lit(version).alias("model_version"), F.lit(path).alias("path"), F.lit(at).cast("timestamp").alias("published_at"))
        write_log(row, root, "models", version)


def roc_auc(scored: DataFrame, probability: str, label: str = "label") -> DataFrame:
    """One row: the area under the ROC curve, ties counted half; null without both labels.

    Scores reduce to counts per distinct value.  Negatives below a value are those in lower
    bands (at most 10,001 rows) plus those below it in its own band.
    """
    y = F.col(label) == 1
    values = scored.groupBy(F.col(probability).alias("_p")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")
    ).withColumn("_band", F.floor(F.col("_p") * 10_000))
    below = "OVER ({} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    bands = values.groupBy("_band").agg(F.sum("neg").alias("_neg")).selectExpr(
        "_band", f"coalesce(sum(_neg) {below.format('ORDER BY _band')}, 0) AS _lower"
    )
    ranked = values.join(bands, "_band", "inner").selectExpr(
        "pos", "neg", f"_lower + coalesce(sum(neg) {below.format('PARTITION BY _band ORDER BY _p')}, 0) AS _below"
    )
    return ranked.selectExpr(
        "sum(pos * (_below + neg / 2D)) / nullif(cast(sum(pos) AS double) * sum(neg), 0D) AS roc_auc"
    )


def metrics_of(scored: DataFrame, auc: float | None) -> DataFrame:
    """Precision, recall and F1 at 0.5 from confusion counts; 0 where undefined."""
    p, y = F.col("prediction") == 1, F.col("label") == 1
    c = scored.agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"),
    )
    precision = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2.0 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return c.select(
        "tp", "fp", "fn", "tn", F.lit(auc).cast("double").alias("roc_auc"),
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1_score"),
    )


def train(data: DataFrame, features: list[str] | None = None, row_id: str = "transaction_id",
          model_version: str = "v1.0.0", trees: int = 50, depth: int = 8) -> Fitted:
    """Fit the forest on the training share and measure it on the rest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from tidegate.operators.scoring import score_with_model
    from tidegate.session import stage_table

    names = features or MODEL_FEATURES
    # the forest reads its input once per level: stage it instead of recomputing the join
    split = stage_table(stratified_split(data, row_id, "label"), "training-set")
    pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=list(names), outputCol="features_vector"),
        RandomForestClassifier(
            labelCol="label", featuresCol="features_vector", numTrees=trees, maxDepth=depth, seed=SEED,
            probabilityCol="probability", rawPredictionCol="rawPrediction", predictionCol="_class",
        ),
    ])
    model = pipeline.fit(split.filter("is_train"))
    test = split.filter("NOT is_train")
    scored = model.transform(test).select("label", vector_to_array("probability")[1].alias("p"))
    auc = roc_auc(scored, "p").first()["roc_auc"]
    measured = metrics_of(score_with_model(test, model, model_version), auc)
    metadata = measured.select(
        F.lit(model_version).alias("model_version"), F.lit("RandomForestClassifier").alias("algorithm"),
        F.array(*[F.lit(n) for n in names]).alias("features_used"),
        F.struct("roc_auc", "precision", "recall", "f1_score").alias("metrics"),
    )
    return Fitted(model, measured, metadata, split)
