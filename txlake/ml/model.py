"""The ensemble: train, evaluate, predict, save, load."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txlake.functions.risk import MODEL_VERSION, model_score_with_floor, policy_columns
from txlake.functions.values import round_half_up
from txlake.functions.vocabulary import FEATURE_WEIGHTS, feature_label, training_category
from txlake.ml.features import BINS, CATEGORICAL, FEATURES, FeatureState, fit_features, learn_edges, stratified_split
from txlake.ml.forest import anomaly_score, fit_forest
from txlake.session import durable, ensure_checkpoint_dir

# Shape of the boosted trees and weights of the ensemble.
ROUNDS, DEPTH, LEARNING_RATE = 100, 6, 0.1
ANOMALY_WEIGHT, CLASSIFIER_WEIGHT = 0.4, 0.6
DECISION_AT = 0.5


@dataclass
class FraudModel:
    features: FeatureState
    boosted: GBTClassificationModel
    forest: DataFrame
    metrics: dict[str, float] = field(default_factory=dict)

    # -- scores -----------------------------------------------------------------

    def raw_scores(self, rows: DataFrame) -> DataFrame:
        """Rows with ``anomaly`` (higher is stranger) and ``probability`` of fraud."""
        scored = self.with_probability(self.features.transform(rows))
        return scored.withColumn("anomaly", anomaly_score(self.forest)).drop("features", "bins", *[f"{n}_scaled" for n in FEATURES])

    def with_probability(self, binned: DataFrame) -> DataFrame:
        """Add ``probability`` of fraud by the boosted trees.

        The trees see nothing of a row but its bins, so they are walked once per vector of bins that occurs, and every
        row takes what its vector got. How many vectors there are is bounded by the bins, not by the rows.
        """
        numbered = binned.withColumn("_point", point_number("bins"))
        points = numbered.select("_point", "bins").dropDuplicates(["_point"])
        scored = durable(self.boosted.transform(points).select("_point", vector_to_array("probability")[1].alias("probability")), "point-scores")
        return numbered.drop("probability").join(scored, "_point").drop("_point")

    def ensemble(self, rows: DataFrame, normalize: str = "batch") -> DataFrame:
        """Add ``model_score`` = 0.4 * anomaly share + 0.6 * probability.

        ``batch`` scales the anomaly by the range found in these rows. ``row`` scores every row as a
        batch of its own, where the share is always one. The forest runs once: its scores are stored
        before the range is taken.
        """
        if normalize not in ("batch", "row"):
            raise ValueError(f"unknown normalization: {normalize}")
        if normalize == "row":
            raw = self.raw_scores(rows)
            share = F.lit(1.0)
        else:
            raw = durable(self.raw_scores(rows), "raw-scores")
            low, high = raw.select(F.min("anomaly")).scalar(), raw.select(F.max("anomaly")).scalar()
            # decision value = -anomaly, so the smallest decision is the strangest row
            share = F.lit(1.0) - (high - F.col("anomaly")) / (high - low + 1e-10)
        combined = share * ANOMALY_WEIGHT + F.col("probability") * CLASSIFIER_WEIGHT
        return raw.withColumn("model_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), combined)))

    def predict(self, rows: DataFrame, normalize: str = "batch") -> DataFrame:
        """Scores with floor, policy bands and model version."""
        aligned = rows.withColumn("merchant_category", training_category("merchant_category"))
        scored = self.ensemble(aligned, normalize)
        floored = scored.withColumn("_score", model_score_with_floor(
            "model_score", "amount", "hour", "is_weekend", "is_international", "payment_method"))
        return floored.withColumns({
            **policy_columns("_score"), "model_version": F.lit(MODEL_VERSION)}).drop("_score")

    # -- quality ----------------------------------------------------------------

    def evaluate(self, test: DataFrame, label: str = "label") -> DataFrame:
        """One row of test metrics at the decision threshold, from confusion counts and the exact ROC area."""
        scored = durable(self.ensemble(test).select("model_score", F.col(label).cast("int").alias("label")), "test")
        auc = 0.0
        if scored.select("label").distinct().count() == 2:
            auc = BinaryClassificationEvaluator(
                rawPredictionCol="model_score", labelCol="label", numBins=0).evaluate(scored)
        flagged, fraud = F.col("model_score") >= DECISION_AT, F.col("label") == 1
        counts = scored.agg(
            F.count("*").alias("n"), F.count_if(fraud).alias("frauds"),
            F.count_if(flagged & fraud).alias("tp"), F.count_if(flagged & ~fraud).alias("fp"),
            F.count_if(flagged == fraud).alias("right"))

        def ratio(part, whole):
            return F.when(whole > 0, part / whole).otherwise(0.0)

        precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
        recall = ratio(F.col("tp"), F.col("frauds"))
        return counts.select(
            ratio(F.col("right"), F.col("n")).alias("accuracy"), precision.alias("precision"),
            recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1_score"),
            F.lit(float(auc)).alias("auc_roc"), F.col("n").alias("total_samples"),
            F.col("frauds").alias("total_frauds"), F.col("tp").alias("detected_frauds"),
            F.col("fp").alias("false_positives"),
        )

    def importance(self, spark: SparkSession) -> DataFrame:
        """Feature and importance, most important first."""
        pairs = [(n, float(v)) for n, v in zip(FEATURES, self.boosted.featureImportances.toArray())]
        return spark.createDataFrame(pairs, "feature string, importance double").orderBy(
            F.desc("importance"), "feature")

    # -- storage ----------------------------------------------------------------

    def save(self, spark: SparkSession, path: str) -> None:
        self.boosted.write().overwrite().save(f"{path}/boosted")
        self.forest.coalesce(1).write.mode("overwrite").parquet(f"{path}/forest")
        for name, codes in self.features.vocabularies.items():
            codes.write.mode("overwrite").parquet(f"{path}/vocabulary/{name}")
        learnt = {"means": self.features.means, "scales": self.features.scales, "edges": self.features.edges}
        state = json.dumps({"features": learnt, "metrics": self.metrics})
        spark.range(1).select(F.lit(state).alias("value")).write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FraudModel:
        state = json.loads(spark.read.text(f"{path}/state").first()["value"])
        return cls(
            FeatureState({name: spark.read.parquet(f"{path}/vocabulary/{name}") for name in CATEGORICAL}, **state["features"]), GBTClassificationModel.load(f"{path}/boosted"),
            spark.read.parquet(f"{path}/forest"), state["metrics"])


def class_weight(train: DataFrame, label: str) -> float:
    """Negatives per positive, so that both classes weigh the same."""
    row = train.agg(
        F.count_if(F.col(label) == 0).alias("negative"), F.count_if(F.col(label) == 1).alias("positive")).first()
    return row["negative"] / max(row["positive"], 1)


def point_number(bins: str) -> Column:
    """A vector of bins as one number: bins are counted from 0, and with the one of NaN there are fewer than 64 a feature."""
    places = vector_to_array(bins)
    return reduce(add, [F.shiftleft(F.get(places, F.lit(i)).cast("long"), 6 * i) for i in range(len(FEATURES))])


def training_points(binned: DataFrame, label: str) -> DataFrame:
    """Rows of equal bins and label as one point with its number of rows in ``copies``.

    Trees that part bins treat such rows alike in every round, so they learn the same from the point and its weight; the
    number of points is bounded by the bins, not by the rows.
    """
    return binned.groupBy("bins", label).agg(F.count("*").alias("copies"))


def train(rows: DataFrame, label: str = "label", key: str = "transaction_id", rounds: int = ROUNDS,
          depth: int = DEPTH, seed: int = 42) -> FraudModel:
    """Split, learn features, grow forest and boosted trees on the training part, evaluate on the rest."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    stored = durable(rows.withColumn(label, F.col(label).cast("int")), "training")
    fit_part, test_part = stratified_split(stored, label, key)
    fit_part = durable(fit_part, "train")
    features = fit_features(fit_part)
    features = replace(features, edges=learn_edges(features.transform(fit_part)))
    weight = class_weight(fit_part, label)
    points = durable(training_points(features.transform(fit_part), label), "points")
    weighted = F.col("copies") * F.when(F.col(label) == 1, F.lit(weight)).otherwise(1.0)
    booster = GBTClassifier(
        labelCol=label, featuresCol="bins", weightCol="weight", maxDepth=depth, maxIter=rounds, maxBins=BINS,
        stepSize=LEARNING_RATE, seed=seed, cacheNodeIds=False, checkpointInterval=10)
    boosted = booster.fit(points.withColumn("weight", weighted))
    scaled = replace(features, edges={}).transform(fit_part).select(key, "features")
    forest = durable(fit_forest(scaled, key, seed=seed), "forest")
    model = FraudModel(features, boosted, forest)
    model.metrics = model.evaluate(test_part, label).first().asDict()
    return model


def resolve_weights(spark: SparkSession, importance: DataFrame | None) -> DataFrame:
    """Weights to show: the model's, or the fixed ones until a model is trained."""
    fixed = spark.createDataFrame(list(FEATURE_WEIGHTS.items()), "feature string, importance double")
    rows = fixed if importance is None or importance.isEmpty() else importance
    return rows.select(
        "feature", feature_label("feature").alias("label"), F.col("importance").alias("weight"),
        round_half_up(F.col("importance") * 100, 1).alias("percent"),
    ).orderBy(F.desc("weight"), "feature")
