"""Exact ranks and order statistics that never gather many values of one key in one task.

A key of few rows is put in order as it is, in one shuffle. For others, values are counted, with partial counts before the
shuffle, then per bucket: the bounded bucket counts tell which bucket holds the wanted rank, and only that bucket is put in order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from txlake.functions.ordering import magnitude_bucket

# Buckets per power of two, as bits. One key has at most some two million buckets however many rows
# it has, and a bucket spans 1/65536 of its value: below sixteen distinct cents for amounts under a million.
BUCKET_BITS = 16
# Rows of one key that a task may put in order.
ORDERED_AT_ONCE = 100_000


def order_statistics(
    rows: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]], copies: str | None = None,
) -> DataFrame:
    """Per key, one row per entry of ``ranks``: its name in ``statistic`` and in ``value`` the value at
    position ``rank(number of rows)`` in ascending order (1-based).

    ``keys`` may be empty for statistics over all rows. Rows with a null value or key are left out. ``copies`` names a column
    that says how many rows a row stands for.
    """
    keys = list(keys)
    values = rows.select(*keys, F.col(value).cast("double").alias("value"), *([F.col(copies).alias("_of")] if copies else []))
    for name in [*keys, "value"]:
        values = values.filter(F.col(name).isNotNull())
    few, many = few_and_many(values, keys) if keys else (None, values)
    # Equal values become one row; of large keys before anything is shuffled by key, so that a user whose amounts are
    # mostly the same leaves few rows.
    few, many = (
        None if part is None else part.groupBy(*keys, "value").agg((F.sum("_of") if copies else F.count("*")).alias("_copies"))
        for part in (few, many))
    found = _found_by_buckets(many, keys, ranks)
    return found if few is None else _found_in_order(few, keys, ranks).unionByName(found)


def few_and_many(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of keys of few rows, dealt by key, so that grouping and ordering by key need no other shuffle; and rows of the
    other keys, as they are. ``rows`` are read three times, the same each time."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    # Few by their size: each has its share of all rows.
    large = F.broadcast(sizes.filter(F.col("_rows") > ORDERED_AT_ONCE).select(*keys))
    return rows.join(large, list(keys), "left_anti").repartition(*keys), rows.join(large, list(keys), "left_semi")


def _places(ranks: dict[str, Callable[[Column], Column]], before: Column | int = 0) -> Column:
    return F.array(*[
        F.struct(F.lit(name).alias("statistic"), (rank(F.col("_total")) - before).alias("_place"))
        for name, rank in ranks.items()])


def _found_in_order(counted: DataFrame, keys: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    of_key = Window.partitionBy(*keys)
    upto = F.sum("_copies").over(of_key.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumns({"_upto": upto, "_total": F.sum("_copies").over(of_key)})
    return ranked.select(*keys, "value", "_upto", "_copies", F.inline(_places(ranks))).filter(
        (F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_copies") < F.col("_place"))
    ).select(*keys, "statistic", "value")


def _found_by_buckets(counted: DataFrame, keys: list[str], ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    counted = counted.withColumn("_bucket", magnitude_bucket("value", BUCKET_BITS))
    all_of_key, in_order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bucket")
    histogram = counted.groupBy(*keys, "_bucket").agg(F.sum("_copies").alias("_held")).withColumns({
        "_before": F.sum("_held").over(in_order) - F.col("_held"),
        "_total": F.sum("_held").over(all_of_key),
    })
    wanted = histogram.select(*keys, "_bucket", "_held", F.inline(_places(ranks, F.col("_before")))).filter(
        (F.col("_place") >= 1) & (F.col("_place") <= F.col("_held"))).drop("_held")

    group = [*keys, "statistic"]
    upto = F.sum("_copies").over(Window.partitionBy(*group).orderBy("value"))
    return counted.join(wanted, [*keys, "_bucket"]).withColumn("_upto", upto).filter(
        (F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_copies") < F.col("_place"))
    ).select(*group, "value")


def order_statistic(
    rows: DataFrame, keys: Sequence[str], value: str, rank_of: Callable[[Column], Column], alias: str,
) -> DataFrame:
    """One order statistic per key, in a column of its own."""
    found = order_statistics(rows, keys, value, {alias: rank_of})
    return found.select(*keys, F.col("value").alias(alias))


def lower_p95(rows: DataFrame, keys: Sequence[str], value: str, alias: str) -> DataFrame:
    """95th percentile by truncated index, not interpolated: position ``max(1, int(n * 0.95))``."""
    return order_statistic(rows, keys, value, lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(0.95))), alias)


def exact_median(rows: DataFrame, value: str, alias: str) -> DataFrame:
    """Median over all rows: the middle value, or the mean of the two middle ones."""
    middle = order_statistics(rows, [], value, {
        "low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor(n / 2) + 1})
    return middle.agg((F.sum("value") / 2).alias(alias))


def running_counts(rows: DataFrame, value: str, flags: dict[str, Column], bits: int = BUCKET_BITS) -> DataFrame:
    """Per distinct value, how many rows of each flag have a value up to it.

    A global running total without a global sort: totals per bucket, running totals over the
    bounded buckets, and running totals inside each bucket.
    """
    names = list(flags)
    per_value = (
        rows.select(F.col(value).cast("double").alias(value), *[flags[n].cast("bigint").alias(n) for n in names])
        .dropna(subset=[value])
        .groupBy(value).agg(*[F.sum(n).alias(n) for n in names])
        .withColumn("_bucket", magnitude_bucket(value, bits))
    )
    totals = per_value.groupBy("_bucket").agg(*[F.sum(n).alias(n) for n in names])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in names])
    inside = Window.partitionBy("_bucket").orderBy(value)
    return per_value.join(offsets, "_bucket").select(
        value, *[(F.sum(n).over(inside) + F.col(f"_before_{n}")).alias(n) for n in names])


def top_labels(rows: DataFrame, key: str, label: str, k: int, alias: str) -> DataFrame:
    """The ``k`` most frequent labels per key, most frequent first, equal counts by label.

    Rows are counted per key and label first; Spark then keeps the best ``k`` per key inside each
    task before it shuffles (window group limit).
    """
    counts = rows.groupBy(key, label).agg(F.count("*").alias("_n"))
    best_first = Window.partitionBy(key).orderBy(F.desc("_n"), F.asc(label))
    ranked = counts.withColumn("_place", F.row_number().over(best_first)).filter(F.col("_place") <= k)
    places = F.sort_array(F.collect_list(F.struct("_place", label)))
    return ranked.groupBy(key).agg(F.transform(places, lambda p: p[label]).alias(alias))


def last_rows(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows by ``order``, given back ascending."""
    tail = rows.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(n)
    return tail.orderBy(*[F.asc_nulls_first(c) for c in order])


def first_rows(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by ``order``; 0 means all."""
    if n <= 0:
        return rows
    return rows.orderBy(*[F.asc_nulls_first(c) for c in order]).limit(n)


def page(rows: DataFrame, order: Sequence[str], number: int = 0, size: int = 20) -> DataFrame:
    """Page ``number`` (from zero) of ``size`` rows under a stated order."""
    return rows.orderBy(*[F.asc_nulls_first(c) for c in order]).offset(number * size).limit(size)
