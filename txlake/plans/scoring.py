"""The scoring flow, one plan for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from txlake.functions.identity import with_identity
from txlake.functions.risk import heuristic_score, policy_columns
from txlake.operators.adapters import request_defaults
from txlake.operators.anomaly import with_anomaly
from txlake.schemas import SCORED_TRANSACTION
from txlake.sources.oltp import with_profiles

def score_rows(requests: DataFrame, boost: Column | None = None) -> DataFrame:
    """Score and policy columns for rows with hour, weekend and border flags. ``score`` is unrounded."""
    scored = requests.withColumn("score", heuristic_score(
        "amount", "hour", "is_weekend", "is_international", "payment_method", "merchant_category", boost))
    return scored.withColumns(policy_columns("score"))


def profile_context(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requests with the outcome of the comparison against their user's profile."""
    return with_anomaly(with_profiles(requests, profiles))


def analyze(requests: DataFrame, profiles: DataFrame, clock: Column | None = None) -> DataFrame:
    """Defaults, profile, anomaly, score, policy: the 20 fields of a scored transaction."""
    known = profile_context(request_defaults(requests, clock), profiles)
    scored = score_rows(known, F.col("anomaly_score_boost"))
    latency = F.col("processing_time_ms").cast("double") if "processing_time_ms" in scored.columns \
        else F.lit(0.0)
    filled = scored.withColumns({
        **with_identity(requests.columns),
        "processing_time_ms": latency,
        "cosmos_sync_status": F.lit("PENDING"),
    })
    return filled.select(*SCORED_TRANSACTION.fieldNames())
