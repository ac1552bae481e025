"""Order-keeping buckets for numbers, the basis of skew-free ranks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from txlake.functions.values import as_column

# Lifts every exponent of a double above zero.
_EXPONENT_SHIFT = 1100


def magnitude_bucket(value: Column | str, bits: int) -> Column:
    """Bucket number that never falls as ``value`` grows: 2^bits buckets per power of two.

    Null falls in bucket zero, infinities before and after all numbers, and NaN last. The bucket depends on the value alone, so partial aggregation can run before any shuffle, and the
    number of buckets has a bound that does not grow with the rows.
    """
    value = as_column(value).cast("double")
    size = F.abs(value)
    size = F.when(F.isnan(size) | (size == float("inf")), 1.0).otherwise(size)
    exponent = F.floor(F.log2(size))
    steps = float(2**bits)
    within = F.floor((size / F.pow(F.lit(2.0), exponent) - 1.0) * steps)
    bucket = (exponent + _EXPONENT_SHIFT) * int(steps) + within
    last = F.lit(2 * _EXPONENT_SHIFT * int(steps)).cast("bigint")
    infinite = F.abs(value) == float("inf")
    signed = (
        F.when(F.isnan(value), last + 1).when(infinite & (value > 0), last).when(infinite, -last)
        .when(value > 0, bucket).when(value < 0, -bucket))
    # Zero, like null, has no exponent.
    return F.coalesce(signed, F.lit(0).cast("bigint"))
