"""Text lines for review context and notifications."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from txlake.functions.masking import holder_text
from txlake.functions.values import as_column


def _shown(value: Column | str, missing: str) -> Column:
    return F.coalesce(as_column(value).cast("string"), F.lit(missing))


def transaction_line() -> Column:
    """One line per public-view row."""
    parts = [
        ("- id=", _shown("transaction_id", "null")),
        (" | doc=", _shown("holder_document", "—")),
        (" | cartao=", _shown("card_last4", "—")),
        (" | R$ ", _shown("amount", "null")),
        (" | ", _shown("merchant_category", "null")),
        (" | ", _shown("payment_method", "null")),
        (" | score=", _shown("fraud_score", "null")),
        (" | fraude=", _shown("is_fraud", "null")),
        (" | acao=", _shown("recommended_action", "null")),
        (" | status=", _shown("review_status", "null")),
        (" | motivos=[", F.coalesce(F.array_join("anomaly_reasons", ", "), F.lit(""))),
    ]
    return F.concat(*[piece for label, value in parts for piece in (F.lit(label), value)], F.lit("]\n"))


def notification_subject(brand: str) -> Column:
    return F.format_string(
        f"[{brand}] Fraude detectada — %s (score %.2f)",
        _shown("transaction_id", "null"), F.coalesce("fraud_score", F.lit(0.0)),
    )


def notification_body(brand: str) -> Column:
    fields = [
        ("ID alerta", _shown("alert_id", "-")),
        ("Transacao", _shown("transaction_id", "-")),
        ("Score", _shown("fraud_score", "null")),
        ("Nivel de risco", _shown("risk_level", "-")),
        ("Acao recomendada", _shown("recommended_action", "-")),
        ("Valor", _shown("amount", "null")),
        ("Categoria", _shown("merchant_category", "-")),
        ("Pagamento", _shown("payment_method", "-")),
        ("Titular", holder_text("card_holder_name", "holder_document")),
        ("Detectado em", _shown("detected_at", "null")),
    ]
    lines = [F.concat(F.lit(f"{label}: "), value) for label, value in fields]
    return F.concat_ws("\n", F.lit(f"Alerta de fraude — {brand}\n"), *lines)
