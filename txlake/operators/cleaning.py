"""Bronze rows to clean rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from txlake.functions.calendar import small_hours_flag, weekend_flag
from txlake.functions.values import only_existing

# Which copy of a duplicated id stays: earliest, then largest amount, then by the remaining columns.
DEDUP_FIRST = ["timestamp", "amount", "merchant_id", "merchant_category", "payment_method"]
# What replaces a missing field.
NULL_DEFAULTS = {"amount": 0, "merchant_category": "UNKNOWN", "user_country": "UNKNOWN"}


def dedup(rows: DataFrame, key: str = "transaction_id") -> DataFrame:
    """One row per key, null counted as one key, chosen by a total order over all columns.

    ``row_number() = 1`` lets Spark drop all but one copy per task before the shuffle, so a key
    with very many copies reaches one task only as one row per map task.
    """
    leading = only_existing(rows.columns, DEDUP_FIRST)
    order = [F.desc_nulls_last(c) if c == "amount" else F.asc_nulls_first(c) for c in leading]
    order += [F.asc_nulls_first(c) for c in sorted(rows.columns) if c not in leading and c != key]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def fill_and_clip(rows: DataFrame) -> DataFrame:
    """Fill missing fields where the column exists, and raise negative amounts to zero."""
    defaults = {c: v for c, v in NULL_DEFAULTS.items() if c in rows.columns}
    return rows.fillna(defaults).withColumn("amount", F.greatest("amount", F.lit(0.0)))


def add_date_parts(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "transaction_date": F.to_date("timestamp"),
        "transaction_hour": F.hour("timestamp"),
    })


def add_time_features(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "is_weekend": weekend_flag("transaction_date"),
        "is_night": small_hours_flag("transaction_hour"),
        "transaction_month": F.month("transaction_date"),
    })


def clean(rows: DataFrame) -> DataFrame:
    """Deduplicate, fill, clip, and derive the date and hour."""
    return add_date_parts(fill_and_clip(dedup(rows)))
