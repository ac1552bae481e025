"""Request rates and latency quantiles over an event log; the same frames work as batch and stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Upper bounds of the latency buckets, in the unit of the value column.
LATENCY_BOUNDS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 150.0, 200.0, 300.0, 500.0)


def request_rates(log: DataFrame, time: str, by: Sequence[str] = (), width: str = "1 minute",
                  seconds: float = 60.0) -> DataFrame:
    """Requests per second in each window, in total or per group."""
    return log.groupBy(F.window(time, width).alias("window"), *by).agg(
        F.count("*").alias("requests")
    ).select(F.col("window.start").alias("window_start"), *by, "requests",
             (F.col("requests") / seconds).alias("rate"))


def bucket_counts(value: str, bounds: Sequence[float]) -> list[Column]:
    """Counts of values up to each bound, the last one for all values."""
    return [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)] + [
        F.count(value).alias(f"le_{len(bounds)}")]


def quantile_from_buckets(bounds: Sequence[float], q: float) -> Column:
    """Quantile from cumulative bucket counts, linear inside its bucket.

    Null where it lies beyond the last bound: the buckets don't know how far. ``bounds`` are the caller's to choose.
    """
    cells = [F.col(f"le_{i}") for i in range(len(bounds) + 1)]
    rank = q * cells[-1]
    result = F.lit(None).cast("double")
    for i in reversed(range(len(bounds))):
        low = float(bounds[i - 1]) if i else 0.0
        below = cells[i - 1] if i else F.lit(0)
        inside = low + (bounds[i] - low) * ((rank - below) / (cells[i] - below))
        result = F.when(cells[i] >= rank, inside).otherwise(result)
    return F.when(cells[-1] > 0, result)


def latency_quantile(log: DataFrame, time: str, value: str, q: float = 0.95, width: str = "5 minutes",
                     slide: str = "1 minute", bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """Quantile per sliding window from bucket counts, whose size does not grow with the log.

    Rows are counted once per step of the slide; only those counts are spread over the windows. For
    a stream, set the watermark on ``log`` first and write in append mode.
    """
    names = [f"le_{i}" for i in range(len(bounds) + 1)]
    per_step = log.groupBy(F.window(time, slide).alias("step")).agg(*bucket_counts(value, bounds))
    spread = per_step.groupBy(F.window(F.window_time("step"), width, slide).alias("window"))
    counted = spread.agg(*[F.sum(n).alias(n) for n in names])
    return counted.select(
        F.col("window.start").alias("window_start"), F.col(names[-1]).alias("requests"),
        quantile_from_buckets(bounds, q).alias("quantile"))
