"""A transaction against its user's profile."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from txlake.functions.values import round_half_up
from txlake.functions.vocabulary import holds_category

MAX_BOOST = 0.22
NO_PROFILE_REASON = "Sem perfil batch para o usuario: rode o job de perfis"


def _by_history(n: Column, full: float, soft: float, two: float, one: float, none: float) -> Column:
    """A value by length of history: five and more, three or four, two, one, none."""
    return F.when(n >= 5, full).when(n >= 3, soft).when(n == 2, two).when(n == 1, one).otherwise(none)


def anomaly_flags(amount, category, payment, hour, profile: dict[str, Column]) -> dict[str, Column]:
    """Which of the five rules a row breaks. ``profile`` maps profile fields to columns of the joined
    row; a null ``tx_count`` means the user has no profile."""
    n, avg, p95 = profile["tx_count"], profile["avg_amount"], profile["p95_amount"]
    categories, payments = profile["typical_categories"], profile["typical_payment_methods"]
    sigmas = _by_history(n, 2.5, 2.9, 3.4, 3.4, 3.4)
    slack = F.when(n < 5, 1.08).otherwise(1.0)
    return {
        "far_above": amount > avg + sigmas * F.greatest(profile["std_amount"], F.lit(1.0)),
        "above_p95": amount > p95 * slack,
        # Stored lists may hold legacy labels.
        "new_category": (n >= 3) & (F.size(categories) > 0) & ~holds_category(categories, category),
        "new_payment": (n >= 3) & (F.size(payments) > 0) & ~F.array_contains(payments, payment),
        "odd_hour": (n >= 5) & (F.abs(hour - profile["avg_hour"]) >= 6),
    }


def anomaly_boost(flags: dict[str, Column], n: Column) -> Column:
    """Score boost of the broken rules, weighted by the length of the history."""
    confidence = _by_history(n, 1.0, 0.88, 0.72, 0.58, 1.0)
    scale = _by_history(n, 1.0, 0.55, 0.0, 0.0, 0.0)
    boost = reduce(add, [
        F.when(flags["far_above"], 0.15 * confidence).when(flags["above_p95"], 0.09 * confidence).otherwise(0.0),
        F.when(flags["new_category"], 0.06 * scale).otherwise(0.0),
        F.when(flags["new_payment"], 0.05 * scale).otherwise(0.0),
        F.when(flags["odd_hour"], 0.04).otherwise(0.0),
    ])
    return F.when(n.isNotNull(), round_half_up(F.least(F.lit(MAX_BOOST), boost), 4)).otherwise(0.0)


def anomaly_reasons(flags: dict[str, Column], amount, category, payment, hour, profile: dict[str, Column]) -> Column:
    """One sentence per broken rule, in rule order."""
    def reason(condition: Column, text: Column) -> Column:
        return F.when(condition, text).otherwise("")

    # array_remove compiles to plain code where a lambda filter would be interpreted per row
    reasons = F.array_remove(F.array(
        F.when(flags["far_above"], F.format_string(
            "Valor R$ %.2f acima do padrao historico (media R$ %.2f, p95 R$ %.2f)",
            amount, profile["avg_amount"], profile["p95_amount"],
        )).when(flags["above_p95"], F.format_string(
            "Valor acima do P95 historico (R$ %.2f)", profile["p95_amount"])).otherwise(""),
        reason(flags["new_category"], F.concat(
            F.lit("Categoria '"), category, F.lit("' atipica para o usuario (historico: ["),
            F.array_join(profile["typical_categories"], ", "), F.lit("])"))),
        reason(flags["new_payment"], F.concat(
            F.lit("Meio de pagamento '"), payment, F.lit("' incomum no historico"))),
        reason(flags["odd_hour"], F.format_string(
            "Horario %dh distante do padrao (media %.1fh)", hour, profile["avg_hour"])),
    ), F.lit(""))
    return F.when(profile["tx_count"].isNotNull(), reasons).otherwise(F.array(F.lit(NO_PROFILE_REASON)))
