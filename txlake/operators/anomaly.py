"""Transactions against their users' profiles."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from txlake.functions.behaviour import anomaly_boost, anomaly_flags, anomaly_reasons
from txlake.functions.vocabulary import plain_category

PROFILE_FIELDS = [
    "tx_count", "avg_amount", "std_amount", "p95_amount", "avg_hour", "typical_categories", "typical_payment_methods",
]
_RULES = ["far_above", "above_p95", "new_category", "new_payment", "odd_hour"]


def with_anomaly(joined: DataFrame) -> DataFrame:
    """Boost, reasons and flags for requests that carry a ``profile`` struct.

    Rule flags become columns first, so that the generated code evaluates each rule once.
    """
    profile = {name: F.col(f"profile.{name}") for name in PROFILE_FIELDS}
    amount = F.coalesce("amount", F.lit(0.0))
    hour, payment = F.coalesce("hour", F.lit(12)), F.col("payment_method")
    plain = joined.withColumn("_category", plain_category("merchant_category"))
    category = F.col("_category")
    found = profile["tx_count"].isNotNull()
    rules = anomaly_flags(amount, category, payment, hour, profile)
    flagged = plain.withColumns({f"_{name}": F.coalesce(found & rules[name], F.lit(False)) for name in _RULES})
    flags = {name: F.col(f"_{name}") for name in _RULES}
    return flagged.withColumns({
        "profile_found": found,
        "historical_tx_count": profile["tx_count"],
        "anomaly_score_boost": anomaly_boost(flags, profile["tx_count"]),
        "anomaly_reasons": anomaly_reasons(flags, amount, category, payment, hour, profile),
        "is_unusual": reduce(or_, flags.values()),
    }).drop("profile", "_category", *[f"_{name}" for name in _RULES])
