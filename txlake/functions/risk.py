"""Risk scores, policy bands, severities and reasons."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from txlake.functions.calendar import late_or_early
from txlake.functions.values import as_column, round_half_up
from txlake.functions.vocabulary import crosses_border_strict, plain_category

HEURISTIC_VERSION = "1.0.0-java-balanced"
MODEL_VERSION = "1.0.0"
FEATURES_USED = [
    "amount", "hour", "is_weekend", "is_international",
    "merchant_category_encoded", "payment_method_encoded", "log_amount",
]

# Bands of the operating policy.
RELEASE_BELOW = 0.60
BLOCK_ABOVE = 0.75
MEDIUM_FROM = 0.30
ENTERPRISE_FRAUD_FROM = 0.70


def _points(condition: Column, points: float) -> Column:
    return F.when(condition, points).otherwise(0.0)


def _extreme_floor(amount: Column, hour: Column, weekend: Column, abroad: Column, card: Column,
                   at_night: float, otherwise: float) -> Column:
    pattern = (abroad == 1) & (weekend == 1) & card
    return (
        F.when(pattern & (amount >= 42_000) & late_or_early(hour), at_night)
        .when(pattern & (amount >= 40_000), otherwise)
        .otherwise(0.0)
    )


def heuristic_score(amount, hour, weekend, abroad, payment, category, boost=None) -> Column:
    """Additive rule score with the floor for extreme cases and the profile boost on top.

    Unrounded: the bands are cut on this value. A missing or negative amount counts as zero.
    """
    amount = F.greatest(F.coalesce(as_column(amount), F.lit(0.0)), F.lit(0.0))
    hour = F.coalesce(as_column(hour), F.lit(12))
    weekend = F.coalesce(as_column(weekend), F.lit(0))
    abroad = F.coalesce(as_column(abroad), F.lit(0))
    card = F.coalesce(F.upper(as_column(payment)), F.lit("CREDIT_CARD")) == "CREDIT_CARD"
    parts = [
        F.lit(0.07),
        F.least(F.lit(0.30), F.log1p(amount) / 13.0),
        _points(abroad == 1, 0.10),
        _points(late_or_early(hour), 0.08),
        _points(weekend == 1, 0.05),
        _points(card, 0.08),
        _points(plain_category(category) == "Eletronicos", 0.06),
        _points(amount >= 8_000, 0.04),
        _points((abroad == 1) & card & (amount >= 5_000), 0.04),
    ]
    score = F.least(F.lit(1.0), reduce(add, parts))
    score = F.greatest(score, _extreme_floor(amount, hour, weekend, abroad, card, 0.76, 0.74))
    if boost is None:
        return score
    boost = F.coalesce(as_column(boost), F.lit(0.0))
    return F.when(boost > 0, F.least(F.lit(1.0), score + boost)).otherwise(score)


def model_score_with_floor(score, amount, hour, weekend, abroad, payment) -> Column:
    """Floor of the trained model's score for extreme cases."""
    card = F.coalesce(F.upper(as_column(payment)), F.lit("")) == "CREDIT_CARD"
    floor = _extreme_floor(
        F.coalesce(as_column(amount), F.lit(0.0)), F.coalesce(as_column(hour), F.lit(12)),
        F.coalesce(as_column(weekend), F.lit(0)), F.coalesce(as_column(abroad), F.lit(0)), card, 0.68, 0.64,
    )
    return F.greatest(as_column(score), floor)


def policy_columns(score: Column | str) -> dict[str, Column]:
    """Rounded score, flag, risk level, action and review status for an unrounded score."""
    score = as_column(score)
    release, review = score < RELEASE_BELOW, score <= BLOCK_ABOVE
    low_or_medium = F.when(score >= MEDIUM_FROM, "MEDIUM").otherwise("LOW")
    return {
        "fraud_score": round_half_up(score, 4),
        "is_fraud": ~release,
        "risk_level": F.when(release, low_or_medium).when(review, "HIGH").otherwise("CRITICAL"),
        "recommended_action": F.when(release, "APPROVE").when(review, "REVIEW").otherwise("BLOCK"),
        "review_status": F.when(release, "RELEASED").otherwise("OPEN"),
    }


def enterprise_score(amount, user_country, merchant_country, hour, jitter: Column | float = 0.0) -> Column:
    """Three-rule score; ``jitter`` stands where a random term may be added."""
    parts = [
        F.lit(0.0),
        _points(as_column(amount) > 10_000, 0.3),
        _points(crosses_border_strict(user_country, merchant_country), 0.2),
        _points(as_column(hour).between(0, 5), 0.15),
    ]
    jitter = jitter if isinstance(jitter, Column) else F.lit(float(jitter))
    return F.least(F.lit(1.0), reduce(add, parts) + jitter)


def enterprise_reason(amount, user_country, merchant_country, hour, score) -> Column:
    return F.concat(
        F.when(as_column(amount) > 10_000, "Valor alto; ").otherwise(""),
        F.when(crosses_border_strict(user_country, merchant_country),
               "Transação internacional suspeita; ").otherwise(""),
        F.when(as_column(hour).between(0, 5), "Horário incomum; ").otherwise(""),
        F.format_string("Score: %.2f", as_column(score)),
    )


def _severity(score: Column | str, critical: float, high: float, medium: float) -> Column:
    score = as_column(score)
    return (
        F.when(score >= critical, "CRITICAL").when(score >= high, "HIGH")
        .when(score >= medium, "MEDIUM").otherwise("LOW")
    )


def severity(score: Column | str) -> Column:
    """Severity of the online enterprise service."""
    return _severity(score, 0.9, 0.8, 0.7)


def seed_severity(score: Column | str) -> Column:
    """Severity of alerts loaded in batch."""
    return _severity(score, 0.9, 0.7, 0.4)


