"""Data quality: rules compiled to one aggregate pass, reports, and the advisory gate."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from txlake.functions.values import round_half_even, round_half_up
from txlake.operators.ranking import exact_median

EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+$"


@dataclass(frozen=True)
class Rule:
    """One expectation. Kinds: exists, unique, not_null, range, in_set, mean_range, regex, positive."""

    column: str
    kind: str
    severity: str = "error"
    args: dict[str, Any] = field(default_factory=dict)


# The rule file of the platform.
GOVERNANCE_RULES = [
    Rule("amount", "not_null"),
    Rule("amount", "range", "warning", {"min": 0, "max": 1_000_000}),
    Rule("transaction_id", "unique"),
    Rule("email", "regex", "warning", {"pattern": EMAIL_PATTERN}),
]

# The rule file itself, parsed.
RULE_FILE = [
    {"column": "amount", "rules": [
        {"type": "not_null", "severity": "error"}, {"type": "range", "min": 0, "max": 1_000_000, "severity": "warning"}]},
    {"column": "transaction_id", "rules": [{"type": "uniqueness", "severity": "error"}]},
    {"column": "email", "rules": [{"type": "regex", "pattern": EMAIL_PATTERN, "severity": "warning"}]},
]

# The expectation suite over landed transactions.
LANDING_RULES = [
    Rule("transaction_id", "exists"),
    Rule("user_id", "exists"),
    Rule("amount", "exists"),
    Rule("timestamp", "exists"),
    Rule("transaction_id", "unique"),
    Rule("amount", "not_null"),
    Rule("amount", "range", "error", {"min": 0, "max": 1_000_000}),
    Rule("currency", "in_set", "error", {"values": ["BRL", "USD", "EUR", "GBP"]}),
    Rule("amount", "mean_range", "error", {"min": 100, "max": 5000}),
]

# Constraints declared on the transactional tables.
TRANSACTION_CONSTRAINTS = [
    Rule("transaction_id", "not_null"),
    Rule("transaction_id", "unique"),
    Rule("user_id", "not_null"),
    Rule("amount", "not_null"),
    Rule("amount", "positive"),
    Rule("currency", "not_null"),
    Rule("merchant_id", "not_null"),
    Rule("timestamp", "not_null"),
]
ALERT_CONSTRAINTS = [
    Rule("transaction_id", "not_null"),
    Rule("user_id", "not_null"),
    Rule("fraud_score", "not_null"),
    Rule("severity", "in_set", "error", {"values": ["LOW", "MEDIUM", "HIGH", "CRITICAL"]}),
    Rule("status", "in_set", "error", {"values": ["PENDING", "REVIEWED", "RESOLVED", "FALSE_POSITIVE"]}),
]


class DataQualityError(ValueError):
    """Raised only where a caller asked failures to stop the job."""


def rules_from_config(config: list[dict]) -> list[Rule]:
    """Rules from the parsed rule file: columns, each with typed rules and a severity."""
    names = {"uniqueness": "unique"}
    rules = []
    for entry in config:
        for spec in entry["rules"]:
            args = {k: v for k, v in spec.items() if k not in ("type", "severity")}
            kind = names.get(spec["type"], spec["type"])
            rules.append(Rule(entry["column"], kind, spec.get("severity", "error"), args))
    return rules


def _violation(rule: Rule) -> Column:
    """True where a row breaks the rule. Nulls break only ``not_null``."""
    column, args = F.col(rule.column), rule.args
    if rule.kind == "not_null":
        return column.isNull()
    if rule.kind == "range":
        broken = ~column.between(args["min"], args["max"])
    elif rule.kind == "in_set":
        broken = ~column.isin(list(args["values"]))
    elif rule.kind == "regex":
        broken = ~column.rlike(args["pattern"])
    elif rule.kind == "positive":
        broken = column <= 0
    else:
        raise ValueError(f"unknown rule kind: {rule.kind}")
    return F.coalesce(broken, F.lit(False))


def _result(rule: Rule, evaluated: Column, failed: Column) -> Column:
    return F.struct(
        F.lit(rule.kind).alias("rule"), F.lit(rule.column).alias("column"), F.lit(rule.severity).alias("severity"),
        evaluated.cast("bigint").alias("evaluated"), failed.cast("bigint").alias("failed"),
        (failed == 0).alias("passed"),
    )


def evaluate(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """One result row per rule.

    All rules share one scan. With a uniqueness rule, its counts per key carry those of the row and mean rules along, and are
    summed up then; without one, a row per task is left. Further uniqueness rules count per key on their own.
    """
    unique = [r for r in rules if r.kind == "unique" and r.column in rows.columns]
    carried: dict[str, Column] = {}

    def summed(name: str, column: Column) -> Column:
        """A count or sum over all rows: taken per key and then over keys where keys are counted anyway."""
        if not unique:
            return column
        carried[name] = column
        return F.sum(name)

    total = F.coalesce(summed("_n", F.count("*")), F.lit(0))
    results = []
    for rule in rules:
        if rule.kind == "exists":
            results.append(_result(rule, F.lit(1), F.lit(0 if rule.column in rows.columns else 1)))
        elif rule.column not in rows.columns:
            results.append(_result(rule, F.lit(0), F.lit(1)))
        elif rule.kind == "unique":
            continue
        elif rule.kind == "mean_range":
            at = len(results)
            mean = F.try_divide(summed(f"_sum_{at}", F.sum(rule.column)), summed(f"_of_{at}", F.count(rule.column))) if unique else F.avg(rule.column)
            outside = ~F.coalesce(mean.between(rule.args["min"], rule.args["max"]), F.lit(False))
            results.append(_result(rule, total, outside.cast("int")))
        else:
            failed = summed(f"_failed_{len(results)}", F.count_if(_violation(rule)))
            results.append(_result(rule, total, F.coalesce(failed, F.lit(0))))
    frames = []
    if unique:
        key = F.col(unique[0].column)
        known = F.coalesce(F.sum(F.when(F.col("_key").isNotNull(), F.col("_n"))), F.lit(0))
        results.append(_result(unique[0], known, known - F.count("_key")))
        per_key = rows.groupBy(key.alias("_key")).agg(*[c.alias(n) for n, c in carried.items()])
        frames.append(per_key.agg(F.array(*results).alias("_r")).select(F.inline("_r")))
    elif results:
        frames.append(rows.agg(F.array(*results).alias("_r")).select(F.inline("_r")))
    for rule in unique[1:]:
        copies = rows.select(rule.column).dropna().groupBy(rule.column).agg(F.count("*").alias("_n"))
        evaluated = F.coalesce(F.sum("_n"), F.lit(0))
        one = copies.agg(_result(rule, evaluated, evaluated - F.count("*")).alias("_r"))
        frames.append(one.select("_r.*"))
    return reduce(DataFrame.unionByName, frames)


def report(results: DataFrame) -> DataFrame:
    """One row: success, the three counts, and the failed expectations. Add the time when writing."""
    failure = F.struct("rule", "column", "severity", "failed")
    return results.agg(
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("success"),
        F.count("*").alias("evaluated_expectations"),
        F.count_if("passed").alias("successful_expectations"),
        F.count_if(~F.col("passed")).alias("unsuccessful_expectations"),
        F.sort_array(F.collect_list(F.when(~F.col("passed"), failure))).alias("failed_expectations"),
    )


def enforce(results: DataFrame, fail_on: str | None = None) -> None:
    """Advisory by default. ``error`` or ``warning`` makes failures of that severity or worse stop the job.

    Reads one row per rule.
    """
    if fail_on is None:
        return
    severities = ["error"] if fail_on == "error" else ["error", "warning"]
    failures = results.filter(~F.col("passed") & F.col("severity").isin(severities)).collect()
    if failures:
        raise DataQualityError("; ".join(f"{r['rule']}({r['column']}): {r['failed']}" for r in failures))


def duplicate_count(rows: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Rows beyond the first of each key, null counted as one key."""
    copies = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return copies.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_records"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count("*")).alias("duplicate_ids"),
    )


def _one_row(*facts: DataFrame) -> DataFrame:
    """Merge one-row frames with distinct columns into one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def batch_counters(rows: DataFrame) -> DataFrame:
    """Counters of the batch check on bronze rows."""
    labelled = F.count_if("is_fraud") if "is_fraud" in rows.columns else F.count_if(F.lit(False))
    # One scan: what is counted over all rows is carried along with the counts per id.
    per_id = rows.groupBy("transaction_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("amount").isNull()).alias("_null"), labelled.alias("_fraud"))
    merged = per_id.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (
        ("total_records", "_n"), ("null_amount", "_null"), ("fraud_labeled", "_fraud"))], F.count("*").alias("_ids")).withColumn(
        "duplicate_ids", F.col("total_records") - F.col("_ids"))
    rate = round_half_even(F.col("fraud_labeled") / F.col("total_records"), 4)
    return merged.select(
        "total_records", "null_amount", "duplicate_ids", "fraud_labeled",
        F.when(F.col("total_records") > 0, rate).otherwise(0.0).alias("fraud_rate"),
        ((F.col("null_amount") == 0) & (F.col("duplicate_ids") == 0)).alias("success"),
    )


def statistics(scored: DataFrame) -> DataFrame:
    """Amount and score statistics of scored rows. The median is exact and fully distributed."""
    plain = scored.agg(
        round_half_up(F.avg("amount"), 2).alias("amount_mean"),
        round_half_up(F.stddev_pop("amount"), 2).alias("amount_stddev"),
        round_half_up(F.min("amount"), 2).alias("amount_min"),
        round_half_up(F.max("amount"), 2).alias("amount_max"),
        round_half_up(F.avg("fraud_score"), 4).alias("fraud_score_mean"),
        round_half_up(F.avg(F.col("is_fraud").cast("int")), 4).alias("fraud_rate"),
    )
    middle = exact_median(scored, "amount", "amount_median")
    return _one_row(plain, middle).withColumn("amount_median", round_half_up("amount_median", 2))


def _api_facts(scored: DataFrame) -> DataFrame:
    plain = scored.agg(
        F.count_if(F.col("amount").isNull()).alias("nulls"),
        F.count_if(~F.col("amount").between(0, 1_000_000)).alias("outside"),
        F.count_if("is_fraud").alias("frauds"),
    )
    return _one_row(plain, duplicate_count(scored))


def api_checks(scored: DataFrame) -> DataFrame:
    """The four checks of the service's report, one row each; no rows when there is no data."""
    rate = F.col("frauds") / F.col("total_records")

    def check(name: str, passed: Column, details: Column) -> Column:
        return F.struct(F.lit(name).alias("rule"), passed.alias("passed"), details.alias("details"))

    checks = F.array(
        check("amount_not_null", F.col("nulls") == 0, F.format_string("%d valores nulos encontrados", "nulls")),
        check("amount_range_0_1M", F.col("outside") == 0, F.format_string("%d valores fora do range", "outside")),
        check("transaction_id_unique", F.col("duplicate_ids") == 0,
              F.format_string("%d IDs duplicados", "duplicate_ids")),
        check("fraud_rate_below_50pct", rate < 0.5, F.format_string("Taxa de fraude: %.2f%%", rate * 100)),
    )
    return _api_facts(scored).filter("total_records > 0").select(F.inline(checks))


def api_report(scored: DataFrame) -> DataFrame:
    """One row: status (``no_data`` when empty), record count, overall result and statistics."""
    facts = _api_facts(scored)
    rate = F.col("frauds") / F.col("total_records")
    passed = (F.col("nulls") == 0) & (F.col("outside") == 0) & (F.col("duplicate_ids") == 0) & (rate < 0.5)
    head = facts.select(
        F.when(F.col("total_records") > 0, "ok").otherwise("no_data").alias("status"),
        "total_records",
        F.when(F.col("total_records") > 0, passed).alias("all_passed"),
    )
    return _one_row(head, statistics(scored))
