"""Profiles from a state that adds up: a day's rows update them without the history being read again."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from txlake.functions.values import round_half_even
from txlake.operators.profiles import PROFILE_SOURCE, PROFILE_VERSION, TOP_CATEGORIES, TOP_PAYMENTS
from txlake.operators.ranking import few_and_many, order_statistics
from txlake.sinks.keyed import KeyedTable

NUMBERS = ["amount", "hour", "abroad", "fraud"]
LABELS = ["merchant_category", "payment_method"]
STATE = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("field", T.StringType()),
    T.StructField("number", T.DoubleType()), T.StructField("label", T.StringType()), T.StructField("n", T.LongType())])
_TAG = "tag"


def facts(rows: DataFrame) -> DataFrame:
    """How often each user has each value of each field of :func:`profile_rows`. Two such tables add up row by row.

    Pass stored rows: they are read three times. Each is shuffled once; those of a user of many rows are counted before that.
    """
    missing = F.lit(None)
    values = [F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("number"), missing.cast("string").alias("label")) for c in NUMBERS]
    values += [F.struct(F.lit(c).alias("field"), missing.cast("double").alias("number"), F.col(c).cast("string").alias("label")) for c in LABELS]
    few, many = few_and_many(rows, ["user_id"])
    return _summed(part.select("user_id", F.inline(F.array(*values)), F.lit(1).cast("long").alias("n")) for part in (few, many))


def _summed(parts: Iterable[DataFrame]) -> DataFrame:
    """Parts that share no user, each with one row per fact."""
    return reduce(DataFrame.unionByName, [part.groupBy(*STATE.fieldNames()[:-1]).agg(F.sum("n").alias("n")) for part in parts])


def profiles_from(state: DataFrame) -> DataFrame:
    """The profiles of all rows that the state has counted; the same as from the rows."""
    def of(field: str, value: Column) -> Column:
        return F.when(F.col("field") == field, value)

    amount, n = F.col("number"), F.col("n")
    exact = amount.try_cast("decimal(30,6)")
    odd = F.count_if((F.col("field") == "amount") & amount.isNotNull() & exact.isNull())
    total, count = F.sum(of("amount", amount * n)), F.sum(of("amount", n))
    mean = F.when(odd > 0, total / count).otherwise(F.sum(of("amount", (exact * n.cast("decimal(18,0)")).cast("decimal(38,6)"))).cast("double") / count)
    variance = F.sum(of("amount", amount * amount * n)) / count - (total / count) * (total / count)

    def share(field: str) -> Column:
        return F.sum(of(field, amount * n)) / F.sum(of(field, n))

    basics = state.where(F.col("field").isin(NUMBERS)).groupBy("user_id").agg(
        count.alias("tx_count"), round_half_even(mean, 2).alias("avg_amount"),
        round_half_even(F.sqrt(F.greatest(variance, F.lit(0.0))), 2).alias("std_amount"),
        round_half_even(F.max(of("amount", amount)), 2).alias("max_amount"), round_half_even(F.min(of("amount", amount)), 2).alias("min_amount"),
        round_half_even(share("abroad"), 4).alias("pct_international"), round_half_even(share("hour"), 1).alias("avg_hour"),
        round_half_even(share("fraud"), 4).alias("historical_fraud_rate"))
    p95 = order_statistics(state.where("field = 'amount'"), ["user_id"], "number", {"p95": lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(0.95)))}, "n")
    p95 = p95.select("user_id", round_half_even("value", 2).alias("p95_amount"))

    def top(field: str, k: int, alias: str) -> DataFrame:
        best = Window.partitionBy("user_id").orderBy(F.desc("n"), "label")
        ranked = state.where(F.col("field") == field).withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= k)
        places = F.sort_array(F.collect_list(F.struct("_place", "label")))
        return ranked.groupBy("user_id").agg(F.transform(places, lambda p: p["label"]).alias(alias))

    return basics.join(p95, "user_id").join(top("merchant_category", TOP_CATEGORIES, "typical_categories"), "user_id").join(
        top("payment_method", TOP_PAYMENTS, "typical_payment_methods"), "user_id").select(
        "user_id", "tx_count", "avg_amount", "std_amount", "max_amount", "p95_amount", "min_amount", "typical_categories",
        "typical_payment_methods", "pct_international", "avg_hour", "historical_fraud_rate",
        F.lit(PROFILE_VERSION).alias("profile_version"), F.lit(PROFILE_SOURCE).alias("source"), F.current_timestamp().alias("updated_at"))


class ProfileState:
    """The stored state, in buckets by user. Its size is that of the distinct values per user and field, not of the history."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = 64):
        self.store = KeyedTable(spark, base, STATE, "user_id", buckets)

    def add(self, rows: DataFrame, tag: str) -> None:
        """Count more rows of :func:`profile_rows`. ``tag`` names the batch and is stored in the same commit; a batch that comes
        again, after a failed job or from another writer, changes nothing. Only files that the rows' users reach are rewritten."""
        spark, mine = rows.sparkSession, (F.col("field") == _TAG) & (F.col("label") == tag)
        key = f"{_TAG}:{tag}"
        if not self.store.of_key(key).where(mine).isEmpty():
            return
        mark = spark.createDataFrame([(key, _TAG, None, tag, 1)], STATE)

        def count_up(old: DataFrame, new: DataFrame) -> DataFrame | None:
            # Another writer may have been first.
            if not old.where((F.col("user_id") == key) & mine).isEmpty():
                return None
            return _summed(few_and_many(old.unionByName(new), ["user_id"]))

        self.store.merge(facts(rows).unionByName(mark), count_up, dealt=True)

    def profiles(self) -> DataFrame:
        return profiles_from(self.store.read())
