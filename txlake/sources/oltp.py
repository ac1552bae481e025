"""Transactional tables and the profile store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from txlake.functions.vocabulary import profile_owner


def read_table(spark: SparkSession, location: str, jdbc: dict | None = None) -> DataFrame:
    """A transactional table: Parquet at ``location``, or table ``location`` over JDBC.

    ``jdbc`` carries url, driver and, for a parallel read, partitionColumn, lowerBound, upperBound
    and numPartitions.
    """
    if jdbc is None:
        return spark.read.parquet(location)
    return spark.read.format("jdbc").options(**{**jdbc, "dbtable": location}).load()


def as_oltp_transactions(tx: DataFrame) -> DataFrame:
    """Amounts as exact decimals, the rest as stored."""
    return tx.withColumn("amount", F.col("amount").cast("decimal(19,2)"))


def with_profiles(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each request with its user's profile in a ``profile`` struct, null where there is none.

    Size decides the join: small stores broadcast under the session's threshold, larger ones are
    shuffled, and a hot user's requests are split by the adaptive skew join.
    """
    owner = profile_owner(*[c for c in ("profile_user_id", "user_id") if c in requests.columns])
    stored = profiles.select(F.col("user_id").alias("_owner"), F.struct(
        "tx_count", "avg_amount", "std_amount", "p95_amount", "avg_hour", "typical_categories",
        "typical_payment_methods").alias("profile"))
    keyed = requests.withColumn("_owner", owner).drop("profile_user_id")
    return keyed.join(stored, "_owner", "left").withColumnRenamed("_owner", "profile_user_id")
