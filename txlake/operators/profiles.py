"""Behaviour profile per user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from txlake.functions.calendar import hour_from_iso
from txlake.functions.values import exact_mean, number_or, or_default, round_half_even
from txlake.functions.vocabulary import (
    DEFAULT_CATEGORY, DEFAULT_PAYMENT, crosses_border, profile_owner,
)
from txlake.operators.ranking import lower_p95, top_labels

# Version and source written on every profile.
PROFILE_VERSION = "batch-v1"
PROFILE_SOURCE = "historical_json"
TOP_CATEGORIES = 5
TOP_PAYMENTS = 3


def profile_rows(tx: DataFrame) -> DataFrame:
    """The seven fields a profile needs, with defaults for missing ones."""
    text_time = dict(tx.dtypes)["timestamp"] == "string"
    hour = hour_from_iso("timestamp") if text_time else F.coalesce(F.hour("timestamp"), F.lit(12))
    return tx.select(
        profile_owner("user_id").alias("user_id"),
        number_or("amount").alias("amount"),
        hour.alias("hour"),
        or_default("merchant_category", DEFAULT_CATEGORY).alias("merchant_category"),
        or_default("payment_method", DEFAULT_PAYMENT).alias("payment_method"),
        crosses_border("user_country", "merchant_country").alias("abroad"),
        F.coalesce("is_fraud", F.lit(False)).cast("int").alias("fraud"),
    )


def user_p95(rows: DataFrame) -> DataFrame:
    return lower_p95(rows, ["user_id"], "amount", "p95_amount").withColumn(
        "p95_amount", round_half_even("p95_amount", 2))


def user_top_categories(rows: DataFrame) -> DataFrame:
    return top_labels(rows, "user_id", "merchant_category", TOP_CATEGORIES, "typical_categories")


def user_top_payments(rows: DataFrame) -> DataFrame:
    return top_labels(rows, "user_id", "payment_method", TOP_PAYMENTS, "typical_payment_methods")


def user_basics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(
        F.count("*").alias("tx_count"),
        round_half_even(exact_mean("amount"), 2).alias("avg_amount"),
        round_half_even(F.stddev_pop("amount"), 2).alias("std_amount"),
        round_half_even(F.max("amount"), 2).alias("max_amount"),
        round_half_even(F.min("amount"), 2).alias("min_amount"),
        round_half_even(F.avg("abroad"), 4).alias("pct_international"),
        round_half_even(F.avg("hour"), 1).alias("avg_hour"),
        round_half_even(F.avg("fraud"), 4).alias("historical_fraud_rate"),
    )


def build_profiles(rows: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """Profiles from :func:`profile_rows`. All four parts end hash-partitioned by user, so joining
    them adds no shuffle. Pass stored rows where they are costly to compute: they are read five times."""
    updated_at = F.current_timestamp() if updated_at is None else updated_at
    return (
        user_basics(rows)
        .join(user_p95(rows), "user_id")
        .join(user_top_categories(rows), "user_id")
        .join(user_top_payments(rows), "user_id")
        .select(
            "user_id", "tx_count", "avg_amount", "std_amount", "max_amount", "p95_amount", "min_amount",
            "typical_categories", "typical_payment_methods", "pct_international", "avg_hour",
            "historical_fraud_rate",
            F.lit(PROFILE_VERSION).alias("profile_version"),
            F.lit(PROFILE_SOURCE).alias("source"),
            updated_at.alias("updated_at"),
        )
    )
