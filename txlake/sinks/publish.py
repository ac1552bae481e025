"""Messages for the event log and for notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from txlake.functions.rendering import notification_body, notification_subject
from txlake.operators.alerts import stable_uuid


def with_envelope(tx: DataFrame, event_id: Column | None = None, at: Column | None = None) -> DataFrame:
    """Add ``event_id`` and ``event_timestamp``. The default id is random, so each attempt is its own event."""
    moment = F.current_timestamp() if at is None else at
    return tx.withColumns({
        "event_id": F.uuid() if event_id is None else event_id,
        "event_timestamp": F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    })


def as_messages(enveloped: DataFrame, key: str = "user_id") -> DataFrame:
    """JSON in ``value`` and the partition key in ``key``."""
    return enveloped.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def publish(messages: DataFrame, sink: str = "text", location: str | None = None, **options: str) -> None:
    """Send a batch of messages: ``kafka`` with its connection options, or JSON lines in a folder."""
    if sink == "kafka":
        messages.write.format("kafka").options(**options).save()
    else:
        messages.select("value").write.mode("append").text(location)


def notifications(scored: DataFrame, brand: str = "txlake") -> DataFrame:
    """One message per detected fraud, holder masked."""
    frauds = scored.filter("is_fraud").withColumns({
        "alert_id": stable_uuid(F.lit("alert"), "transaction_id"),
        "detected_at": F.col("timestamp"),
    })
    return frauds.select(
        "alert_id", "transaction_id", "fraud_score", "risk_level", "recommended_action", "amount",
        "merchant_category", "payment_method", "detected_at",
        notification_subject(brand).alias("subject"), notification_body(brand).alias("body"),
    )
