"""Dictionary coding of labels in any number: codes by alphabetical order, without a list in the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from txlake.session import durable


def dense_codes(rows: DataFrame, column: str) -> DataFrame:
    """``label`` and ``code`` (from 0, in code point order) of the distinct values of a column, as text; null is left out.

    Labels are sorted in ranges. A label's code is its place in its range plus the labels of the ranges before, of which
    there are as many counts as tasks.
    """
    labels = rows.select(F.col(column).cast("string").alias("label")).where("label is not null").distinct()
    dealt = durable(labels.repartitionByRange("label").sortWithinPartitions("label").select(
        "label", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")), "labels")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return dealt.join(counts, "part").select("label", (F.col("at") + F.col("before")).cast("int").alias("code"))


def with_code(rows: DataFrame, column: str, codes: DataFrame, alias: str) -> DataFrame:
    """``rows`` with the code of a column's label, -1 for null and for labels that the dictionary lacks.

    Size decides the join: Spark broadcasts a small dictionary; beside a large one a frequent label is split by the skew join.
    """
    keyed = codes.select(F.col("label").alias(f"_{alias}_label"), F.col("code").alias(alias))
    joined = rows.join(keyed, F.col(column).cast("string") == F.col(f"_{alias}_label"), "left").drop(f"_{alias}_label")
    return joined.withColumn(alias, F.coalesce(alias, F.lit(-1)))
