"""Writers of the lake."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from txlake.session import durable
from txlake.sinks.layout import DEFAULT_ENTITY, LakeLayout


def write_bronze(rows: DataFrame, layout: LakeLayout) -> str:
    path = layout.bronze()
    rows.write.mode("overwrite").parquet(path)
    return path


def save_layer(rows: DataFrame, layout: LakeLayout, layer: str, entity: str | None = None,
               only_touched_dates: bool = False) -> str:
    """Overwrite a layer, one folder per ``transaction_date``; ``only_touched_dates`` keeps other dates.

    The rebalance hint sends a date to few tasks, yet splits a date too large for one.
    """
    path = layout.path(layer, entity)
    (
        rows.hint("rebalance", "transaction_date").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if only_touched_dates else "static")
        .partitionBy("transaction_date").parquet(path)
    )
    return path


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_quality_report(report: DataFrame, layout: LakeLayout, name: str = "dq") -> None:
    """The report as latest and in the history, with its time. It is made once, so the two can't disagree."""
    timed = durable(report.withColumn("validation_time", F.current_timestamp()), "report")
    timed.write.mode("overwrite").json(layout.reports(f"{name}_latest"))
    timed.write.mode("append").json(layout.reports(f"{name}_history"))


def run_record(spark: SparkSession, job: str, input_file: str, records_read: int, profiles_written: int,
               status: str = "completed") -> DataFrame:
    return spark.range(1).select(
        F.lit(job).alias("job"), F.lit(input_file).alias("input_file"),
        F.lit(records_read).cast("bigint").alias("records_read"),
        F.lit(profiles_written).cast("bigint").alias("profiles_written"),
        F.current_timestamp().alias("started_at"), F.lit(status).alias("status"),
    )


def append_run(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)


def lake_readiness(spark: SparkSession, layout: LakeLayout) -> DataFrame:
    """One row per layer: whether it holds any row. A missing or empty layer is not ready."""
    frames = []
    for layer in DEFAULT_ENTITY:
        try:
            found = spark.read.parquet(layout.path(layer)).limit(1).agg((F.count("*") > 0).alias("ready"))
        except AnalysisException:
            found = spark.range(1).select(F.lit(False).alias("ready"))
        frames.append(found.select(F.lit(layer).alias("layer"), "ready"))
    return reduce(DataFrame.unionByName, frames)
