"""Operating figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txlake.functions.risk import BLOCK_ABOVE, RELEASE_BELOW
from txlake.functions.values import number_or, round_half_up
from txlake.functions.vocabulary import DEFAULT_CATEGORY
from txlake.operators.listing import open_fraud


def _share(part, whole):
    return F.when(whole > 0, part / whole).otherwise(0.0)


def batch_summary(scored: DataFrame) -> DataFrame:
    frauds = F.count_if("is_fraud")
    return scored.agg(
        F.count("*").alias("total_analyzed"), frauds.alias("total_frauds_detected"),
        round_half_up(_share(frauds, F.count("*")), 4).alias("fraud_rate"),
    )


def dashboard_kpis(scored: DataFrame, profiles: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Headline figures. ``errors``: one row per failed request, where a log of them exists."""
    frauds = F.count_if(open_fraud())
    profile_count = profiles.select(F.count("*")).scalar()
    failed = F.lit(0) if errors is None else errors.select(F.count("*")).scalar()
    latency = F.avg(F.coalesce("processing_time_ms", F.lit(0.0)))
    return scored.agg(
        F.count("*").alias("total_transactions"),
        frauds.alias("total_frauds"),
        F.count_if(F.col("review_status") == "RELEASED").alias("total_released"),
        _share(frauds, F.count("*")).alias("fraud_rate"),
        F.coalesce(round_half_up(latency, 2), F.lit(0.0)).alias("avg_processing_time_ms"),
    ).select(
        "total_transactions", "total_frauds", "total_released", profile_count.alias("mongodb_profiles"),
        "fraud_rate", "avg_processing_time_ms",
        _share(failed, F.col("total_transactions")).alias("error_rate"),
    )


def breakdown(scored: DataFrame) -> DataFrame:
    """Transactions and frauds per category and per payment method, both dimensions in one pass."""
    labelled = scored.select(
        F.coalesce("merchant_category", F.lit(DEFAULT_CATEGORY)).alias("category"),
        F.coalesce("payment_method", F.lit(DEFAULT_CATEGORY)).alias("payment"), "is_fraud")
    sets = labelled.groupingSets([["category"], ["payment"]], "category", "payment").agg(
        F.grouping("category").alias("_no_category"),
        F.count("*").alias("transactions"), F.count_if("is_fraud").alias("frauds"))
    by_category = F.col("_no_category") == 0
    return sets.select(
        F.when(by_category, "category").otherwise("payment").alias("dimension"),
        F.when(by_category, F.col("category")).otherwise(F.col("payment")).alias("label"),
        "transactions", "frauds",
    )


def score_distribution(scored: DataFrame) -> DataFrame:
    """Counts by the rounded score, as the screen shows them."""
    score = F.col("fraud_score")
    return scored.agg(
        F.count_if(score < RELEASE_BELOW).alias("approved_below_60"),
        F.count_if((score >= RELEASE_BELOW) & (score <= BLOCK_ABOVE)).alias("review_60_75"),
        F.count_if(score > BLOCK_ABOVE).alias("blocked_above_75"),
    )


def open_frauds_by_category(scored: DataFrame) -> DataFrame:
    counts = scored.filter(open_fraud()).groupBy("merchant_category").agg(F.count("*").alias("fraudes"))
    return counts.orderBy(F.desc("fraudes"), "merchant_category")


def alert_statistics(alerts: DataFrame) -> DataFrame:
    resolved = F.count_if(F.col("status") == "RESOLVED")
    return alerts.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "PENDING").alias("pending"),
        resolved.alias("resolved"),
        F.count_if(F.col("status") == "FALSE_POSITIVE").alias("falsePositive"),
        _share(resolved, F.count("*")).alias("resolutionRate"),
    )


def alert_list_summary(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "OPEN").alias("open"))


def file_statistics(landing: DataFrame) -> DataFrame:
    frauds = F.count_if("is_fraud")
    return landing.agg(
        F.count("*").alias("total"), frauds.alias("frauds"),
        _share(frauds, F.count("*")).alias("fraud_rate"),
        F.coalesce(round_half_up(F.avg(number_or("amount")), 2), F.lit(0.0)).alias("amount_mean"),
    )


def profile_statistics(profiles: DataFrame, history: DataFrame) -> DataFrame:
    loaded = profiles.select(F.count("*")).scalar()
    return history.agg(
        F.count("*").alias("transaction_history_count"),
        F.count_if(F.col("cosmos_sync_status") == "PENDING").alias("transaction_history_cosmos_pending"),
    ).select(
        loaded.alias("mongodb_profiles_loaded"), "transaction_history_count",
        "transaction_history_cosmos_pending", (loaded > 0).alias("batch_ready"),
    )


def processing_metrics(log: DataFrame) -> DataFrame:
    """Figures of a processing log: kind (transaction, error, false_positive), is_fraud, processing_time."""
    is_transaction = F.col("kind") == "transaction"
    processed = F.count_if(is_transaction)
    frauds = F.count_if(is_transaction & F.col("is_fraud"))
    errors = F.count_if(F.col("kind") == "error")
    false_positives = F.count_if(F.col("kind") == "false_positive")
    timed = F.when(is_transaction & (F.col("processing_time") > 0), F.col("processing_time"))
    return log.agg(
        processed.alias("transactions_processed"), frauds.alias("frauds_detected"),
        false_positives.alias("false_positives"), errors.alias("errors"),
        F.coalesce(F.avg(timed), F.lit(0.0)).alias("processing_time_avg"),
        _share(frauds, processed).alias("fraud_rate"),
        _share(errors, processed).alias("error_rate"),
        _share(frauds - false_positives, frauds).alias("precision"),
    )


def list_summary(scored: DataFrame, which: str, limit: int) -> DataFrame:
    """What accompanies a list: total, filter, rows returned, history and rows waiting for sync."""
    matches = {
        "fraud": open_fraud(), "released": F.col("review_status") == "RELEASED",
    }.get((which or "all").lower(), F.lit(True))
    return scored.agg(
        F.count("*").alias("total"),
        F.count(F.col("transaction_id")).alias("history_mongodb"),
        F.count_if(F.col("cosmos_sync_status") == "PENDING").alias("history_cosmos_pending"),
        F.lit(which).alias("filter"),
        F.least(F.count_if(matches), F.lit(limit)).alias("returned"),
    )


def run_summary(records: DataFrame, existing: DataFrame, written: DataFrame) -> DataFrame:
    """Rows read, profiles written, and how many of those replaced or added a stored profile."""
    replaced = written.join(existing.select("user_id"), "user_id", "left_semi").select(F.count("*")).scalar()
    read = records.select(F.count("*")).scalar()
    return written.agg(F.count("*").alias("profiles_written")).select(
        read.alias("records_read"), "profiles_written", replaced.alias("replaced"),
        (F.col("profiles_written") - replaced).alias("inserted"),
    )


