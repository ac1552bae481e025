"""History of scored transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from txlake.functions.values import only_existing
from txlake.operators.merge import insert_missing
from txlake.schemas import SCORED_TRANSACTION

_TEXT_FIELDS = [f.name for f in SCORED_TRANSACTION if f.dataType.simpleString() == "string"]


def history_rows(scored: DataFrame) -> DataFrame:
    """Typed history documents: absent texts are empty, a row not yet synchronized is pending."""
    pending = F.lit("PENDING")
    status = F.coalesce("cosmos_sync_status", pending) if "cosmos_sync_status" in scored.columns else pending
    rows = scored.withColumn("cosmos_sync_status", status)
    fields = {f.name: f.dataType for f in SCORED_TRANSACTION}
    kinds = dict(rows.dtypes)
    return rows.select(*[
        F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) if name in _TEXT_FIELDS
        else F.col(name) if kinds[name].startswith("timestamp")
        else F.col(name).cast(fields[name]).alias(name)
        for name in only_existing(rows.columns, list(fields))
    ])


def first_of_each_id(history: DataFrame) -> DataFrame:
    """One document per transaction id: the earliest; Spark keeps one per id and task before the shuffle."""
    others = [c for c in sorted(history.columns) if c not in ("timestamp", "transaction_id")]
    order = Window.partitionBy("transaction_id").orderBy(
        F.asc_nulls_last("timestamp"), *[F.asc_nulls_first(c) for c in others])
    return history.withColumn("_place", F.row_number().over(order)).filter("_place = 1").drop("_place")


def new_history(scored: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents to append: unique in the batch and not stored yet."""
    return insert_missing(first_of_each_id(history_rows(scored)), stored, ["transaction_id"])


def rejected_history(scored: DataFrame, stored: DataFrame) -> DataFrame:
    """Per id, scored rows that the unique key turns away."""
    counts = scored.groupBy("transaction_id").agg(F.count("*").alias("scored_rows"))
    marked = counts.join(stored.select("transaction_id", F.lit(1).alias("_stored")), "transaction_id", "left")
    rejected = F.col("scored_rows") - F.when(F.col("_stored").isNull(), 1).otherwise(0)
    return marked.select("transaction_id", rejected.alias("rejected_rows")).filter("rejected_rows > 0")
