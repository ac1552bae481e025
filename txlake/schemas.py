"""One explicit schema per entity."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _DOUBLE, _INT = T.StringType(), T.DoubleType(), T.IntegerType()
_LONG, _BOOL, _TS = T.LongType(), T.BooleanType(), T.TimestampType()
_TEXTS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LANDING_TRANSACTION = _struct(
    transaction_id=_STRING, user_id=_STRING, amount=_DOUBLE, currency=_STRING,
    merchant_id=_STRING, merchant_category=_STRING, timestamp=_STRING,
    user_country=_STRING, merchant_country=_STRING, payment_method=_STRING,
    device_id=_STRING, ip_address=_STRING, is_fraud=_BOOL,
    holder_document=_STRING, card_number=_STRING, card_holder_name=_STRING,
)

EVENT_ENVELOPE = T.StructType(
    [f for f in LANDING_TRANSACTION.fields if f.name != "is_fraud"]
    + [T.StructField("event_id", _STRING), T.StructField("event_timestamp", _STRING)]
)

CANONICAL_FEATURES = _struct(
    amount=_DOUBLE, merchant_category=_STRING, payment_method=_STRING,
    hour=_INT, is_weekend=_INT, is_international=_INT,
)

ANALYZE_REQUEST = _struct(
    amount=_DOUBLE, merchant_category=_STRING, user_country=_STRING, merchant_country=_STRING,
    payment_method=_STRING, hour=_INT, is_weekend=_INT, is_international=_INT,
    transaction_id=_STRING, holder_document=_STRING, card_number=_STRING,
    card_holder_name=_STRING, profile_user_id=_STRING, user_id=_STRING,
)

# Everything a queue message may carry: the landing layout, the flat request layout and the envelope.
QUEUE_MESSAGE = T.StructType(
    EVENT_ENVELOPE.fields
    + [f for f in ANALYZE_REQUEST.fields if f.name not in EVENT_ENVELOPE.fieldNames()]
)

VENDOR_CSV = _struct(
    vlr_transacao=_STRING, amount=_STRING, categoria=_STRING, merchant_category=_STRING,
    meio_pagamento=_STRING, payment_method=_STRING, hora=_STRING,
    fim_semana=_STRING, internacional=_STRING,
)

USER_PROFILE = _struct(
    user_id=_STRING, tx_count=_LONG, avg_amount=_DOUBLE, std_amount=_DOUBLE, max_amount=_DOUBLE,
    p95_amount=_DOUBLE, min_amount=_DOUBLE, typical_categories=_TEXTS,
    typical_payment_methods=_TEXTS, pct_international=_DOUBLE, avg_hour=_DOUBLE,
    historical_fraud_rate=_DOUBLE, profile_version=_STRING, source=_STRING, updated_at=_TS,
)

SCORED_TRANSACTION = _struct(
    transaction_id=_STRING, profile_user_id=_STRING, holder_document=_STRING, card_number=_STRING,
    card_holder_name=_STRING, amount=_DOUBLE, merchant_category=_STRING, payment_method=_STRING,
    user_country=_STRING, merchant_country=_STRING, fraud_score=_DOUBLE, is_fraud=_BOOL,
    risk_level=_STRING, recommended_action=_STRING, review_status=_STRING,
    anomaly_reasons=_TEXTS, profile_found=_BOOL, processing_time_ms=_DOUBLE, timestamp=_TS,
    cosmos_sync_status=_STRING,
)

SESSION_ALERT = _struct(
    alert_id=_STRING, transaction_id=_STRING, fraud_score=_DOUBLE, risk_level=_STRING,
    amount=_DOUBLE, timestamp=_TS, status=_STRING,
)

OLTP_TRANSACTION = T.StructType(
    [T.StructField("id", _STRING, False), T.StructField("transaction_id", _STRING, False),
     T.StructField("user_id", _STRING, False), T.StructField("amount", T.DecimalType(19, 2), False),
     T.StructField("currency", _STRING, False), T.StructField("merchant_id", _STRING, False),
     T.StructField("merchant_category", _STRING), T.StructField("timestamp", T.TimestampNTZType(), False),
     T.StructField("user_country", _STRING), T.StructField("merchant_country", _STRING),
     T.StructField("payment_method", _STRING), T.StructField("device_id", _STRING),
     T.StructField("ip_address", _STRING), T.StructField("fraud_score", _DOUBLE),
     T.StructField("is_fraud", _BOOL), T.StructField("fraud_reason", _STRING),
     T.StructField("created_at", _TS, False), T.StructField("updated_at", _TS, False)]
)

FRAUD_ALERT = T.StructType(
    [T.StructField("id", _STRING, False), T.StructField("transaction_id", _STRING, False),
     T.StructField("user_id", _STRING, False), T.StructField("fraud_score", _DOUBLE, False),
     T.StructField("fraud_reason", _STRING), T.StructField("severity", _STRING, False),
     T.StructField("status", _STRING, False), T.StructField("reviewed_by", _STRING),
     T.StructField("reviewed_at", _TS), T.StructField("created_at", _TS, False)]
)

AUDIT_EVENT = _struct(
    id=_LONG, event_type=_STRING, entity_type=_STRING, entity_id=_STRING, actor=_STRING,
    payload=_STRING, created_at=_TS,
)

BATCH_RUN = _struct(
    job=_STRING, input_file=_STRING, records_read=_LONG, profiles_written=_LONG,
    started_at=_TS, status=_STRING,
)
