"""Model features, forest, boosted trees, ensemble."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from txlake.catalog.lake import cleaned
from txlake.catalog.registry import query, stored
from txlake.catalog.sqlparts import rule_score, with_parts
from txlake.functions.risk import MODEL_VERSION, RELEASE_BELOW, heuristic_score
from txlake.functions.vocabulary import FEATURE_LABELS, feature_label
from txlake.ml.features import FEATURES, fit_features, stratified_split, training_rows
from txlake.ml.forest import SUBSAMPLE, TREES, anomaly_score, fit_forest, usual_path
from txlake.ml.model import FraudModel, resolve_weights, train
from txlake.operators.ranking import running_counts
from txlake.session import durable, scratch_path
from txlake.sources import sample

_models: dict[tuple[str, str], str] = {}


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Training rows; the label is what the rules flag, so that there is something to learn."""
    def build() -> DataFrame:
        rows = training_rows(cleaned(spark, folder))
        score = heuristic_score("amount", "hour", "is_weekend", "is_international", "payment_method", "merchant_category")
        return rows.select("transaction_id", *FEATURES[:4], "merchant_category", "payment_method",
                           (score >= RELEASE_BELOW).cast("int").alias("label"))

    return stored(spark, folder, "labelled", build)


_LABELLED = with_parts("featured") + f""", base as (select transaction_id, amount, transaction_hour "hour", is_weekend,
  case when user_country <> merchant_country then 1 else 0 end is_international,
  case when merchant_category = 'Eletrônicos' then 'Eletronicos' else merchant_category end merchant_category, payment_method from featured),
labelled as (select *, case when {rule_score()} >= 0.60::double then 1 else 0 end "label" from base)\n"""


def model(spark: SparkSession, folder: str) -> FraudModel:
    """The model trained on these tables, saved once per application and loaded from then on."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _models:
        path = scratch_path(spark, "model")
        train(labelled(spark, folder)).save(spark, path)
        _models[key] = path
    return FraudModel.load(spark, _models[key])


@query("ml_features", _LABELLED + "select * from labelled")
def ml_features(spark, folder):
    return labelled(spark, folder)


@query("ml_encoded", _LABELLED + """
select transaction_id, cast(dense_rank() over (order by merchant_category) - 1 as int) merchant_category_encoded,
  cast(dense_rank() over (order by payment_method) - 1 as int) payment_method_encoded, round(ln(1 + amount), 9) log_amount from labelled""")
def ml_encoded(spark, folder):
    rows = labelled(spark, folder)
    return fit_features(rows).encode(rows).select(
        "transaction_id", "merchant_category_encoded", "payment_method_encoded", F.round("log_amount", 9).alias("log_amount"))


@query("ml_scaled", _LABELLED + """
select transaction_id, round((amount - avg(amount) over ()) / stddev_pop(amount) over (), 6) amount_scaled,
  round(("hour" - avg("hour") over ()) / stddev_pop("hour") over (), 6) hour_scaled,
  round((is_weekend - avg(is_weekend) over ()) / stddev_pop(is_weekend) over (), 6) is_weekend_scaled from labelled""")
def ml_scaled(spark, folder):
    rows = labelled(spark, folder)
    return fit_features(rows).transform(rows).select(
        "transaction_id", *[F.round(f"{n}_scaled", 6).alias(f"{n}_scaled") for n in ("amount", "hour", "is_weekend")])


@query("ml_split", _LABELLED + """
select transaction_id, "label", row_number() over (partition by "label" order by ('0x' || left(md5(transaction_id), 12))::bigint)
  <= floor(count(*) over (partition by "label") * 0.8::double + 0.5::double) train from labelled""")
def ml_split(spark, folder):
    fit_part, test_part = stratified_split(labelled(spark, folder), "label")
    names = ["transaction_id", "label"]
    return fit_part.select(*names, F.lit(True).alias("train")).unionByName(
        test_part.select(*names, F.lit(False).alias("train")))


# Trained scores have no SQL. What must hold of every row of them is checked instead, beside ids, labels and counts.

@query("ml_iforest", _LABELLED + "select transaction_id, true bounded, true alike from labelled")
def ml_iforest(spark, folder):
    """Anomaly of every row by a forest grown on these tables: within (0, 1), and the same for rows of equal features."""
    rows = labelled(spark, folder)
    scaled = fit_features(rows).transform(rows)
    forest = stored(spark, folder, "forest", lambda: fit_forest(scaled))
    scores = durable(scaled.select("transaction_id", vector_to_array("features").alias("v"), anomaly_score(forest).alias("anomaly")), "anomalies")
    groups = scores.groupBy("v").agg(F.min("anomaly").alias("low"), F.max("anomaly").alias("high"))
    return scores.join(groups, "v").select(
        "transaction_id", ((F.col("anomaly") > 0) & (F.col("anomaly") < 1)).alias("bounded"), (F.col("low") == F.col("high")).alias("alike"))


@query("ml_forest_shape", _LABELLED + f"""
select unnest(range({TREES}))::int tree, (select least({SUBSAMPLE}, count(*)) from labelled)::int points, true two_way, true shallow""")
def ml_forest_shape(spark, folder):
    """Every tree grew from a full sample: one leaf more than inner nodes, no path longer than the depth limit and what it stands for."""
    rows = labelled(spark, folder)
    forest = stored(spark, folder, "forest", lambda: fit_forest(fit_features(rows).transform(rows)))
    limit = math.ceil(math.log2(SUBSAMPLE))
    return forest.groupBy("tree").agg(
        F.max("points").alias("points"), (F.count_if(F.col("feature") < 0) == F.count_if(F.col("feature") >= 0) + 1).alias("two_way"),
        (F.max("path") <= limit + F.lit(usual_path(SUBSAMPLE))).alias("shallow"))


@query("ml_gbt", _LABELLED + 'select transaction_id, "label", true in_unit, true separates from labelled')
def ml_gbt(spark, folder):
    """Fraud probability of every row by the boosted trees: within [0, 1], and frauds apart from the rest by half the scale."""
    trained = model(spark, folder)
    scored = trained.with_probability(trained.features.transform(labelled(spark, folder)))
    scored = durable(scored.select("transaction_id", "label", "probability"), "probabilities")
    fraud = F.col("label") == 1
    apart = scored.select(F.avg(F.when(fraud, F.col("probability"))) - F.avg(F.when(~fraud, F.col("probability"))) > 0.5).scalar()
    return scored.select("transaction_id", "label", F.col("probability").between(0, 1).alias("in_unit"), apart.alias("separates"))


@query("ml_ensemble", _LABELLED + "select transaction_id, true weighted, true in_unit from labelled")
def ml_ensemble(spark, folder):
    """The ensemble's score against its definition, from the parts that it returns."""
    rows = durable(model(spark, folder).ensemble(labelled(spark, folder)).select("transaction_id", "anomaly", "probability", "model_score"), "ensemble")
    low, high = rows.select(F.min("anomaly")).scalar(), rows.select(F.max("anomaly")).scalar()
    # The decision value is the negative anomaly; scaled to its range it is turned over.
    share = 1 - (-F.col("anomaly") + high) / (-low + high + 1e-10)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * share + 0.6 * F.col("probability")))
    return rows.select("transaction_id", (F.abs(F.col("model_score") - score) < 1e-9).alias("weighted"), F.col("model_score").between(0, 1).alias("in_unit"))


@query("ml_metrics", _LABELLED + """, placed as (select "label", row_number() over (partition by "label" order by ('0x' || left(md5(transaction_id), 12))::bigint)
  > floor(count(*) over (partition by "label") * 0.8::double + 0.5::double) test from labelled)
select count(*) total_samples, count(*) filter ("label" = 1) total_frauds, true counts_agree, true rates_agree, true auc_agrees from placed where test""")
def ml_metrics(spark, folder):
    """Test metrics of the trained model against counts over its predictions; the ROC area against ranks."""
    _, test_part = stratified_split(labelled(spark, folder), "label")
    trained = model(spark, folder)
    told = trained.evaluate(test_part)
    rows = durable(trained.ensemble(test_part).select("label", "model_score"), "test-scores")
    right, tp, fp, fn = (F.count_if(c).cast("double") for c in (
        (F.col("model_score") >= 0.5) == (F.col("label") == 1), (F.col("model_score") >= 0.5) & (F.col("label") == 1),
        (F.col("model_score") >= 0.5) & (F.col("label") == 0), (F.col("model_score") < 0.5) & (F.col("label") == 1)))
    mine = rows.agg(right.alias("right"), tp.alias("_tp"), fp.alias("_fp"), fn.alias("_fn"), F.count("*").cast("double").alias("_n"))
    # A fraud is ahead of the others below its score and of half of those at it.
    upto = running_counts(rows, "model_score", {"others": F.col("label") == 0})
    here = rows.groupBy("model_score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    ahead = here.join(upto, "model_score").agg(
        F.sum(F.col("p") * (F.col("others") - F.col("q") / 2.0)).alias("ahead"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    both = told.crossJoin(F.broadcast(mine)).crossJoin(F.broadcast(ahead))  # one row each
    near = lambda a, b: F.abs(F.col(a) - b) < 1e-9
    recall, precision = F.try_divide("_tp", F.col("_tp") + F.col("_fn")), F.try_divide("_tp", F.col("_tp") + F.col("_fp"))
    return both.select(
        "total_samples", "total_frauds", ((F.col("detected_frauds") == F.col("_tp")) & (F.col("false_positives") == F.col("_fp"))).alias("counts_agree"),
        (near("accuracy", F.col("right") / F.col("_n")) & near("recall", recall) & near("precision", precision)
         & near("f1_score", 2 * precision * recall / (precision + recall))).alias("rates_agree"),
        near("auc_roc", F.col("ahead") / (F.col("p") * F.col("q"))).alias("auc_agrees"))


_NAMES = "(values " + ", ".join(f"('{name}')" for name in FEATURES) + ") f(feature)"


@query("ml_importance", f"select feature, true in_unit, true sums_to_one from {_NAMES}, (select 1 from lineitem limit 1)")
def ml_importance(spark, folder):
    rows = durable(model(spark, folder).importance(spark), "importance")
    whole = rows.select(F.abs(F.sum("importance") - 1) < 1e-9).scalar()
    return rows.select("feature", F.col("importance").between(0, 1).alias("in_unit"), whole.alias("sums_to_one"))


@query("importance_sorted", f"select unnest(range(1, {len(FEATURES) + 1}))::int place, true falling")
def importance_sorted(spark, folder):
    """The model's features in the order given: none weighs more than the one before."""
    rows = model(spark, folder).importance(spark).limit(len(FEATURES)).collect()
    weights = [r["importance"] for r in rows]
    places = [(n + 1, n == 0 or weights[n - 1] >= w) for n, w in enumerate(weights)]
    return spark.createDataFrame(places, "place int, falling boolean")


_LABELS = "(values " + ", ".join(f"('{name}', '{label}')" for name, label in FEATURE_LABELS.items()) + ") l(feature, label)"


@query("feature_weights", f"select feature, label, true percent_agrees from {_LABELS}, (select 1 from lineitem limit 1)")
def feature_weights(spark, folder):
    """Weights with labels and percent, from the trained model."""
    rows = resolve_weights(spark, model(spark, folder).importance(spark))
    return rows.select("feature", "label", (F.abs(F.col("percent") - F.col("weight") * 100) <= 0.05 + 1e-9).alias("percent_agrees"))


@query("feature_labels", f"""
select coalesce(l.feature, e.feature) feature, coalesce(label, upper(e.feature[1]) || split_part(e.feature[2:], '_', 1) || ' Rate (' || e.feature || ')') label, n from (
  select case when event_id % 2 = 0 then {FEATURES}[event_id % {len(FEATURES)} + 1] else event_type || '_rate' end feature, count(*) n from events group by 1) e
left join {_LABELS} on e.feature = l.feature""")
def feature_labels(spark, folder):
    """Labels of the model's features, and of names that it doesn't know: rates of the event types."""
    known = F.element_at(F.array(*[F.lit(f) for f in FEATURES]), (F.col("event_id") % len(FEATURES) + 1).cast("int"))
    name = F.when(F.col("event_id") % 2 == 0, known).otherwise(F.concat("event_type", F.lit("_rate")))
    counted = sample.table(spark, folder, "events").groupBy(name.alias("feature")).agg(F.count("*").alias("n"))
    return counted.select("feature", feature_label("feature").alias("label"), "n")


@query("ml_predict", _LABELLED + f"select transaction_id, true bands, '{MODEL_VERSION}' model_version from labelled")
def ml_predict(spark, folder):
    """Predictions, their bands against the score; a score that rounds onto a bound may lie on either side of it."""
    rows = model(spark, folder).predict(labelled(spark, folder))
    score = F.col("fraud_score")
    fraud = F.when(score == 0.6, F.col("is_fraud")).otherwise(score > 0.6)
    risk = F.when(score > 0.75, "CRITICAL").when(score > 0.6, "HIGH").when(score >= 0.3, "MEDIUM").otherwise("LOW")
    action = F.when(score > 0.75, "BLOCK").when(score > 0.6, "REVIEW").otherwise("APPROVE")
    status = F.when(F.col("is_fraud"), "OPEN").otherwise("RELEASED")
    edge = score.isin(0.3, 0.6, 0.75)
    bands = (F.col("is_fraud") == fraud) & (F.col("review_status") == status) & (
        edge | (F.col("risk_level") == risk) & (F.col("recommended_action") == action))
    return rows.select("transaction_id", bands.alias("bands"), "model_version")
