"""Alerts from scored rows, and what reviewers decide about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from txlake.functions.risk import (
    ENTERPRISE_FRAUD_FROM, enterprise_reason, enterprise_score, seed_severity, severity,
)
from txlake.operators.merge import insert_missing


def stable_uuid(*parts: Column | str) -> Column:
    """UUID-shaped id from the row's own key, so that a retried task writes the same id."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))


def session_alerts(scored: DataFrame) -> DataFrame:
    """One open alert per scored fraud."""
    return scored.filter("is_fraud").select(
        stable_uuid(F.lit("alert"), "transaction_id").alias("alert_id"),
        "transaction_id", "fraud_score", "risk_level", "amount", "timestamp", F.lit("OPEN").alias("status"),
    )


def enterprise_verdicts(tx: DataFrame, jitter: Column | float = 0.0) -> DataFrame:
    """Rule score, flag at the enterprise threshold, and reason for frauds."""
    hour = F.hour("timestamp")
    scored = tx.withColumn(
        "fraud_score", enterprise_score("amount", "user_country", "merchant_country", hour, jitter))
    is_fraud = F.col("fraud_score") >= ENTERPRISE_FRAUD_FROM
    reason = enterprise_reason("amount", "user_country", "merchant_country", hour, "fraud_score")
    return scored.withColumns({"is_fraud": is_fraud, "fraud_reason": F.when(is_fraud, reason)})


def enterprise_alerts(verdicts: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Pending alerts of the enterprise service from rows flagged as fraud."""
    return verdicts.filter("is_fraud").select(
        stable_uuid(F.lit("enterprise-alert"), "transaction_id").alias("id"),
        "transaction_id", "user_id", "fraud_score", "fraud_reason",
        severity("fraud_score").alias("severity"), F.lit("PENDING").alias("status"),
        F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("timestamp").alias("reviewed_at"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def seeded_alerts(tx: DataFrame, alerts: DataFrame) -> DataFrame:
    """Pending alerts for labelled frauds that have none yet."""
    wanted = tx.filter("is_fraud").select(
        "transaction_id", "user_id", "fraud_score", "fraud_reason",
        seed_severity("fraud_score").alias("severity"), F.lit("PENDING").alias("status"))
    return insert_missing(wanted, alerts, ["transaction_id"])


def missing_audit_events(events: DataFrame, audit: DataFrame) -> DataFrame:
    """Audit rows absent from the trail by entity and event type."""
    return insert_missing(events, audit, ["entity_id", "event_type"])


def _decisions(decisions: DataFrame, key: str, **fields: Column) -> DataFrame:
    """One whole decision per key, columns prefixed for the join.

    The latest by ``decided_at`` if the decisions have that column; of equally late ones the smallest by its fields.
    """
    names = [f"_{n}" for n in fields]
    late = F.col("decided_at") if "decided_at" in decisions.columns else F.lit(0)
    picked = decisions.select(F.col(key), *[c.alias(n) for n, c in zip(names, fields.values())], late.alias("_late"))
    if names:
        latest = picked.groupBy(key).agg(F.max("_late").alias("_latest"))
        picked = picked.join(latest, key).filter(F.col("_late").eqNullSafe(F.col("_latest")))
        picked = picked.groupBy(key).agg(F.min(F.struct(*names)).alias("_one")).select(key, "_one.*")
    else:
        picked = picked.select(key).distinct()
    return picked.withColumn("_hit", F.lit(True))


def _update(rows: DataFrame, decisions: DataFrame, key: str, changes: dict[str, Column]) -> DataFrame:
    joined = rows.join(decisions, key, "left")
    hit = F.col("_hit").isNotNull()
    before = {n: F.col(n) if n in rows.columns else F.lit(None) for n in changes}
    changed = joined.withColumns({n: F.when(hit, c).otherwise(before[n]) for n, c in changes.items()})
    return changed.select(*rows.columns, *[n for n in changes if n not in rows.columns])


def release(scored: DataFrame, releases: DataFrame, released_at: Column | None = None) -> DataFrame:
    """Put listed transactions back to the normal flow. ``releases``: transaction_id, released_by."""
    decisions = _decisions(releases, "transaction_id", by=F.coalesce("released_by", F.lit("analyst")))
    return _update(scored, decisions, "transaction_id", {
        "review_status": F.lit("RELEASED"),
        "recommended_action": F.lit("APPROVE"),
        "is_fraud": F.lit(False),
        "risk_level": F.lit("LOW"),
        "released_by": F.col("_by"),
        "released_at": F.current_timestamp() if released_at is None else released_at,
    })


def release_alerts(alerts: DataFrame, releases: DataFrame) -> DataFrame:
    """Close the alerts of released transactions."""
    decisions = _decisions(releases, "transaction_id")
    return _update(alerts, decisions, "transaction_id", {"status": F.lit("RELEASED")})


def review_alerts(alerts: DataFrame, reviews: DataFrame, reviewed_at: Column | None = None) -> DataFrame:
    """Set status, reviewer and time of the listed alerts. ``reviews``: id, status, reviewed_by."""
    decisions = _decisions(reviews, "id", status=F.col("status"), by=F.col("reviewed_by"))
    return _update(alerts, decisions, "id", {
        "status": F.col("_status"),
        "reviewed_by": F.col("_by"),
        "reviewed_at": F.current_timestamp() if reviewed_at is None else reviewed_at,
    })


def update_fraud_status(tx: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Write fraud flag, score and reason onto the listed transactions."""
    fields = {n: F.col(n) for n in ("is_fraud", "fraud_score", "fraud_reason")}
    decisions = _decisions(verdicts, "transaction_id", **fields)
    return _update(tx, decisions, "transaction_id", {n: F.col(f"_{n}") for n in fields})


def unknown_keys(decisions: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Decisions about keys that do not exist, to be reported to the caller."""
    return decisions.join(rows.select(key), key, "left_anti")
