"""Drift of many columns at once, each by the test that its kind, its number of values and the rows call for.

All columns go into one table of value counts in one scan of both sides; every statistic is computed from those counts. Up to
``SMALL`` rows of reference, numbers of more than ``FEW`` values take the Kolmogorov-Smirnov test, two values the test of two
proportions, anything else chi-square, all against a p-value; beyond, where such tests reject any difference, numbers take the
Wasserstein distance in reference deviations and the rest the Jensen-Shannon distance, against a distance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from txlake.functions.ordering import magnitude_bucket
from txlake.operators.drift import P_LIMIT, ks_p_value, chi2_p_value
from txlake.operators.ranking import BUCKET_BITS
from txlake.session import durable

# Where the preset changes its tests, and from which distance on a column has drifted.
SMALL, FEW, DISTANCE_LIMIT, LEAST_DEVIATION = 1000, 5, 0.1, 0.001


def value_counts(reference: DataFrame, current: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """``column``, ``number`` or ``label``, and how many rows of each side have that value (``r``, ``c``). Missing numbers are left
    out; a missing label is a value."""
    def melted(side: DataFrame, ref: bool) -> DataFrame:
        cells = [F.struct(F.lit(n).alias("column"), F.lit(True).alias("numeric"), F.col(n).cast("double").alias("number"), F.lit(None).cast("string").alias("label")) for n in numeric]
        cells += [F.struct(F.lit(n).alias("column"), F.lit(False).alias("numeric"), F.lit(None).cast("double").alias("number"), F.col(n).cast("string").alias("label")) for n in categorical]
        return side.select(F.inline(F.array(*cells)), F.lit(ref).alias("ref"))

    both = melted(reference, True).unionByName(melted(current, False)).where("not numeric or number is not null")
    return both.groupBy("column", "numeric", "number", "label").agg(F.count_if("ref").alias("r"), F.count_if(~F.col("ref")).alias("c"))


def _shares(counts: DataFrame, totals: DataFrame) -> DataFrame:
    return counts.join(F.broadcast(totals), "column").withColumns({
        "rs": F.try_divide(F.col("r").cast("double"), "n"), "cs": F.try_divide(F.col("c").cast("double"), "m")})


def _ordered(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Per column the largest gap between both distribution functions and the area between them. Running counts go over bounded
    buckets first and inside a bucket then, so no column is put in order in one task."""
    values = counts.where("numeric").withColumn("bucket", magnitude_bucket("number", BUCKET_BITS))
    held = values.groupBy("column", "bucket").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.min("number").alias("low"))
    order = Window.partitionBy("column").orderBy("bucket")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("column", "bucket", F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"),
                       F.lead("low").over(order).alias("after"))
    inside = Window.partitionBy("column", "bucket").orderBy("number")
    placed = values.withColumns({"upto_r": F.sum("r").over(inside), "upto_c": F.sum("c").over(inside), "next": F.lead("number").over(inside)}).drop("r", "c")
    placed = placed.join(held, ["column", "bucket"]).join(F.broadcast(totals), "column")
    gap = F.abs(F.try_divide(F.col("upto_r") + F.col("r0"), F.col("n")) - F.try_divide(F.col("upto_c") + F.col("c0"), F.col("m")))
    width = F.coalesce("next", "after") - F.col("number")
    return placed.groupBy("column").agg(F.max(gap).alias("ks"), F.coalesce(F.sum(gap * width), F.lit(0.0)).alias("area"))


def _half_divergence(share: str) -> Column:
    middle = (F.col("rs") + F.col("cs")) / 2
    return F.when(F.col(share) > 0, F.col(share) * F.log(F.col(share) / middle)).otherwise(0.0)


def preset(reference: DataFrame, current: DataFrame, numeric: Sequence[str], categorical: Sequence[str], small: int = SMALL) -> DataFrame:
    """One row per column: ``column``, ``test``, ``statistic``, ``p_value`` (null for distances) and ``drifted``.

    A column without rows on one side has null statistics and has not drifted.
    """
    counts = durable(value_counts(reference, current, numeric, categorical), "value-counts")
    known = counts.where("r > 0 or c > 0")
    mean = F.sum(F.col("number") * F.col("r")) / F.sum("r")
    totals = known.groupBy("column", "numeric").agg(
        F.sum("r").cast("double").alias("n"), F.sum("c").cast("double").alias("m"), F.count("*").alias("values"), mean.alias("mean"))
    # One row per column.
    totals = durable(totals, "totals")
    spread = known.where("numeric").join(F.broadcast(totals.select("column", "mean")), "column").groupBy("column").agg(
        F.sqrt(F.sum(F.pow(F.col("number") - F.col("mean"), F.lit(2)) * F.col("r")) / F.sum("r")).alias("deviation"))
    ordered = _ordered(known, totals.select("column", "n", "m"))
    shares = _shares(known, totals.select("column", "n", "m"))
    pooled = (F.col("r") + F.col("c")) / (F.col("n") + F.col("m"))

    def apart(seen: str, of: str) -> Column:
        return F.try_divide(F.pow(F.col(seen) - pooled * F.col(of), F.lit(2)), pooled * F.col(of))

    spreads = shares.groupBy("column").agg(
        F.sqrt(F.greatest(F.sum(_half_divergence("rs") + _half_divergence("cs")) / 2, F.lit(0.0))).alias("js"),
        F.sum(apart("r", "n") + apart("c", "m")).alias("chi2"),
        # Of two values either share tells all; the difference of shares over its deviation.
        F.max(F.try_divide(F.abs(F.col("rs") - F.col("cs")), F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / F.col("m"))))).alias("z"))
    rows = totals.join(ordered, "column", "left").join(spread, "column", "left").join(spreads, "column", "left")
    many = F.col("numeric") & (F.col("values") > FEW)
    test = F.when(F.col("n") > small, F.when(many, "wasserstein").otherwise("jensen_shannon")).when(many, "ks").when(F.col("values") == 2, "two_proportions").otherwise("chi_square")
    statistic = (
        F.when(F.col("test") == "wasserstein", F.col("area") / F.greatest("deviation", F.lit(LEAST_DEVIATION)))
        .when(F.col("test") == "jensen_shannon", F.col("js")).when(F.col("test") == "ks", F.col("ks"))
        .when(F.col("test") == "two_proportions", F.coalesce("z", F.lit(0.0))).otherwise(F.col("chi2")))
    scaled = F.col("ks") * F.sqrt(F.try_divide(F.col("n") * F.col("m"), F.col("n") + F.col("m")))
    tail = chi2_p_value(F.when(F.col("test") == "two_proportions", F.col("statistic") * F.col("statistic")).otherwise(F.col("chi2")),
                        F.when(F.col("test") == "two_proportions", F.lit(1)).otherwise((F.col("values") - 1).cast("int")))
    told = rows.withColumn("test", test).withColumn("statistic", F.when((F.col("n") > 0) & (F.col("m") > 0), statistic))
    told = told.withColumn("p_value", F.when(F.col("statistic").isNull() | F.col("test").isin("wasserstein", "jensen_shannon"), F.lit(None).cast("double"))
                           .when(F.col("test") == "ks", ks_p_value(scaled)).otherwise(tail))
    drifted = F.when(F.col("p_value").isNotNull(), F.col("p_value") < P_LIMIT).otherwise(F.col("statistic") >= DISTANCE_LIMIT)
    return told.select("column", "test", "statistic", "p_value", F.coalesce(drifted, F.lit(False)).alias("drifted"))
