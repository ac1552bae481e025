"""Lists, lookups and views of scored transactions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from txlake.functions.identity import with_identity
from txlake.functions.masking import card_last4, mask_cpf
from txlake.functions.rendering import transaction_line
from txlake.functions.values import only_existing
from txlake.functions.vocabulary import payment_name
from txlake.operators.ranking import last_rows

REVIEW_CONTEXT_LIMIT = 15


def where_equal(rows: DataFrame, **wanted: Any) -> DataFrame:
    """Keep rows equal on every argument that is given; arguments left None filter nothing."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    return rows


def open_fraud() -> Column:
    return F.coalesce(F.col("is_fraud"), F.lit(False)) & ~F.col("review_status").eqNullSafe("RELEASED")


def list_filter(scored: DataFrame, which: str | None = "all") -> DataFrame:
    """``fraud``: flagged and not released. ``released``: released. Anything else: all rows."""
    which = (which or "all").lower()
    if which == "fraud":
        return scored.filter(open_fraud())
    if which == "released":
        return scored.filter(F.col("review_status") == "RELEASED")
    return scored


def lookup(rows: DataFrame, key: str, value: Any) -> DataFrame:
    """All rows of a key. For many keys, join instead."""
    return rows.filter(F.col(key) == F.lit(value))


def public_view(scored: DataFrame) -> DataFrame:
    """The 19 fields shown to clients, document and card masked."""
    holder = with_identity(scored.columns)
    passed_on = [
        "user_country", "merchant_country", "fraud_score", "is_fraud", "risk_level", "recommended_action",
        "review_status", "anomaly_reasons", "profile_found", "processing_time_ms", "timestamp",
        "cosmos_sync_status",
    ]
    return scored.select(
        "transaction_id", "amount", "merchant_category", payment_name("payment_method").alias("payment_method"),
        *only_existing(scored.columns, passed_on),
        F.lit(True).alias("history_stored"),
        mask_cpf(holder["holder_document"]).alias("holder_document"),
        card_last4(holder["card_number"]).alias("card_last4"),
    )


def display_table(public: DataFrame) -> DataFrame:
    """Table of the operators' screen: a dash for absent masked fields, two columns renamed."""
    wanted = [
        "transaction_id", "holder_document", "card_last4", "amount", "merchant_category", "payment_method",
        "fraud_score", "is_fraud", "review_status", "cosmos_sync_status", "anomaly_reasons", "recommended_action",
    ]
    for name in ("holder_document", "card_last4"):
        if name not in public.columns:
            public = public.withColumn(name, F.lit("—"))
    return public.select(*only_existing(public.columns, wanted)).withColumnsRenamed(
        {"holder_document": "cpf_mascarado", "card_last4": "cartao_ult4"})


def with_releasable(scored: DataFrame) -> DataFrame:
    """True for rows a reviewer may release: in review and not released yet."""
    in_review = F.upper("recommended_action").eqNullSafe("REVIEW")
    return scored.withColumn("can_release", in_review & ~F.col("review_status").eqNullSafe("RELEASED"))


def review_context(scored: DataFrame, order: list[str], limit: int = REVIEW_CONTEXT_LIMIT, shown: int = REVIEW_CONTEXT_LIMIT) -> DataFrame:
    """Lines about the last open frauds, oldest first; beyond ``shown`` of them one line says so.

    Holds at most ``limit`` rows before rendering, so one task numbers them.
    """
    limit = limit if limit > 0 else REVIEW_CONTEXT_LIMIT
    recent = public_view(last_rows(list_filter(scored, "fraud"), order, limit))
    lines = recent.select(*order, transaction_line().alias("line"))
    packed = lines.agg(F.sort_array(F.collect_list(F.struct(*order, "line"))).alias("_all"))
    rendered = F.transform(F.slice("_all", 1, shown), lambda x: x["line"])
    omitted = F.when(
        F.size("_all") > shown,
        F.array_append(rendered, F.lit("... (mais transações omitidas)\n"))).otherwise(rendered)
    return packed.select(F.posexplode(omitted).alias("position", "line"))
