"""Drift of current against reference rows, on whole tables instead of driver samples."""

from __future__ import annotations

import math
import sys
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from txlake.operators.ranking import running_counts

# Task functions travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Share given to an empty bin, so that the logarithm exists.
EMPTY_SHARE = 0.0001
PSI_LIMIT = 0.1
P_LIMIT = 0.05
DRIFTED_SHARE_LIMIT = 0.5
_KS_TERMS = 50


def _tagged(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    return reference.select(*columns, F.lit(True).alias("_ref")).unionByName(
        current.select(*columns, F.lit(False).alias("_ref")))


def bin_frequencies(both: DataFrame, bin_column: Column) -> DataFrame:
    """Rows of each side per bin: a full outer comparison in one aggregation."""
    return both.groupBy(bin_column.alias("bin")).agg(
        F.count_if("_ref").alias("reference_rows"), F.count_if(~F.col("_ref")).alias("current_rows"))


def equal_width_bin(value: str, low: Column, high: Column, bins: int) -> Column:
    """Bin by the reference's range; values outside it fall into the end bins."""
    position = F.floor(F.try_divide(F.col(value) - low, high - low) * bins)
    # A reference of one value has no width: everything is in the first bin.
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.coalesce(position, F.lit(0))))


def _psi(frequencies: DataFrame, column: str) -> DataFrame:
    totals = frequencies.agg(
        F.sum("reference_rows").alias("_r"), F.sum("current_rows").alias("_c"),
        F.collect_list(F.struct("reference_rows", "current_rows")).alias("_bins"))

    def term(cell: Column) -> Column:
        r = F.greatest(F.try_divide(cell["reference_rows"], F.col("_r")), F.lit(EMPTY_SHARE))
        c = F.greatest(F.try_divide(cell["current_rows"], F.col("_c")), F.lit(EMPTY_SHARE))
        return (c - r) * F.log(c / r)

    psi = F.aggregate(F.transform("_bins", term), F.lit(0.0), lambda a, b: a + b)
    return totals.select(F.lit(column).alias("column"), psi.alias("psi"))


def numeric_bins(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Per equal-width bin of the reference's range, rows of each side."""
    known = F.col(column).isNotNull()
    low = reference.select(F.min(column)).scalar()
    high = reference.select(F.max(column)).scalar()
    both = _tagged(reference.filter(known), current.filter(known), [column])
    return bin_frequencies(both, equal_width_bin(column, low, high, bins))


def category_bins(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Per label, rows of each side; missing labels are a bin of their own, whose label is null."""
    both = _tagged(reference, current, [column])
    return bin_frequencies(both, F.col(column).cast("string"))


def psi(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str],
        bins: int = 10) -> DataFrame:
    """Population stability index per column. Bins are bounded for numbers and one per label for texts."""
    parts = [_psi(numeric_bins(reference, current, c, bins), c) for c in numeric]
    for c in categorical:
        # the sum over labels runs as a plain aggregate: labels may be many
        frequencies = category_bins(reference, current, c)
        r_total = frequencies.select(F.sum("reference_rows")).scalar()
        c_total = frequencies.select(F.sum("current_rows")).scalar()
        r = F.greatest(F.try_divide(F.col("reference_rows"), r_total), F.lit(EMPTY_SHARE))
        k = F.greatest(F.try_divide(F.col("current_rows"), c_total), F.lit(EMPTY_SHARE))
        parts.append(frequencies.agg(F.sum((k - r) * F.log(k / r)).alias("psi"))
                     .select(F.lit(c).alias("column"), "psi"))
    return reduce(DataFrame.unionByName, parts)


def ks_p_value(scaled: Column) -> Column:
    """Limit distribution of the scaled two-sample statistic, as a series."""
    def term(j: Column) -> Column:
        sign = F.when(j % 2 == 1, 2.0).otherwise(-2.0)
        return sign * F.exp(-2.0 * j * j * scaled * scaled)

    series = F.aggregate(F.sequence(F.lit(1), F.lit(_KS_TERMS)), F.lit(0.0), lambda total, j: total + term(j))
    # The series does not converge next to zero, where the probability is one.
    return F.when(scaled.isNull(), F.lit(None).cast("double")).when(scaled < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ks(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Exact two-sample Kolmogorov-Smirnov statistic per column, with its asymptotic p-value; null if a side is empty."""
    parts = []
    for column in columns:
        both = _tagged(reference, current, [column])
        counts = running_counts(both, column, {"r": F.col("_ref"), "c": ~F.col("_ref")})
        # The last running count of each side is its size.
        sizes = counts.agg(F.max("r").cast("double").alias("n"), F.max("c").cast("double").alias("m"))
        n, m = sizes.select("n").scalar(), sizes.select("m").scalar()
        gap = counts.agg(F.max(F.abs(F.try_divide(F.col("r"), n) - F.try_divide(F.col("c"), m))).alias("ks")).select("ks", n.alias("n"), m.alias("m"))
        scaled = gap.withColumn("scaled", F.col("ks") * F.sqrt(F.try_divide(F.col("n") * F.col("m"), F.col("n") + F.col("m"))))
        parts.append(scaled.select(F.lit(column).alias("column"), "ks", ks_p_value(F.col("scaled")).alias("p_value")))
    return reduce(DataFrame.unionByName, parts)


def _chi2_tail(statistic: float, freedom: int) -> float:
    """Upper tail of the chi-square distribution: the regularized incomplete gamma function.

    Left of the mean by the power series of the lower part, right of it by the continued fraction of the upper one; their
    common factor, which may exceed 1 or be next to nothing, is put in as a logarithm.
    """
    x, a = statistic / 2.0, freedom / 2.0
    if freedom <= 0 or x <= 0:
        return 1.0
    scale = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - math.exp(scale + math.log(total)))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    fraction, i, change = d, 0, 0.0
    while abs(change - 1) > 1e-15:
        i += 1
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        change = c * d
        fraction *= change
    return min(1.0, math.exp(scale + math.log(fraction)))


@F.pandas_udf(T.DoubleType())
def chi2_p_value(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(s) else _chi2_tail(float(s), int(k)) for s, k in zip(statistic, freedom)], dtype="float64")


def chi_square(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Two-sample chi-square of homogeneity per categorical column."""
    parts = []
    for column in columns:
        cells = category_bins(reference, current, column)
        r_total = cells.select(F.sum("reference_rows").cast("double")).scalar()
        c_total = cells.select(F.sum("current_rows").cast("double")).scalar()
        both = (F.col("reference_rows") + F.col("current_rows")).cast("double")
        share = both / (r_total + c_total)
        distance = (
            F.try_divide(F.pow(F.col("reference_rows") - share * r_total, F.lit(2)), share * r_total)
            + F.try_divide(F.pow(F.col("current_rows") - share * c_total, F.lit(2)), share * c_total)
        )
        one = cells.agg(F.sum(distance).alias("chi2"), (F.count("*") - 1).alias("freedom"))
        parts.append(one.select(F.lit(column).alias("column"), "chi2", "freedom"))
    return reduce(DataFrame.unionByName, parts).withColumn("p_value", chi2_p_value("chi2", "freedom"))


def drift_share(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str],
                p_limit: float = P_LIMIT, share_limit: float = DRIFTED_SHARE_LIMIT) -> DataFrame:
    """One row: columns tested, columns drifted, their share, and whether the data set drifted."""
    tests = ks(reference, current, numeric).select("column", "p_value").unionByName(
        chi_square(reference, current, categorical).select("column", "p_value"))
    drifted = F.count_if(F.col("p_value") < p_limit)
    return tests.agg(
        F.count("*").alias("columns_tested"), drifted.alias("columns_drifted"),
        (drifted / F.count("*")).alias("drifted_share"),
        (drifted / F.count("*") >= share_limit).alias("dataset_drift"),
    )
