"""Silver statistics and the gold projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txlake.functions.values import only_existing
from txlake.operators.cleaning import add_time_features

# Columns of the gold table, in order.
GOLD_COLUMNS = [
    "transaction_id", "transaction_date", "user_id", "amount", "merchant_category", "is_weekend",
    "is_night", "user_avg_amount", "user_amount_stddev", "merchant_transaction_count", "is_fraud",
]


def user_stats(rows: DataFrame) -> DataFrame:
    """Mean, count and sample deviation of the amount per user."""
    return rows.groupBy("user_id").agg(
        F.avg("amount").alias("user_avg_amount"),
        F.count("*").alias("user_total_transactions"),
        F.stddev("amount").alias("user_amount_stddev"),
    )


def merchant_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("merchant_id").agg(
        F.count("*").alias("merchant_transaction_count"),
        F.avg("amount").alias("merchant_avg_amount"),
    )


def with_user_stats(rows: DataFrame) -> DataFrame:
    """Statistics joined back, not windowed: partial aggregation absorbs hot users, the adaptive
    skew join splits their rows, and rows without a user keep null statistics."""
    return rows.join(user_stats(rows), "user_id", "left")


def with_merchant_stats(rows: DataFrame) -> DataFrame:
    """As for users; frames without a merchant column pass unchanged."""
    if "merchant_id" not in rows.columns:
        return rows
    return rows.join(merchant_stats(rows), "merchant_id", "left")


def enrich(cleaned: DataFrame) -> DataFrame:
    """Clean rows plus time features and both statistics: the silver table."""
    featured = add_time_features(cleaned)
    with_users = featured.join(user_stats(featured), "user_id", "left")
    if "merchant_id" not in featured.columns:
        return with_users
    return with_users.join(merchant_stats(featured), "merchant_id", "left")


def gold(silver: DataFrame) -> DataFrame:
    """Gold columns that exist, labelled rows only."""
    projected = silver.select(*only_existing(silver.columns, GOLD_COLUMNS))
    if "is_fraud" in projected.columns:
        projected = projected.filter(F.col("is_fraud").isNotNull())
    return projected
