"""Landing files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from txlake.functions.calendar import parse_instant
from txlake.operators.adapters import CORRUPT, normalize
from txlake.schemas import LANDING_TRANSACTION


class EmptyLandingError(ValueError):
    """The landing file holds an array without records."""


def read_landing_json(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Landing records with ``timestamp`` parsed; lines that do not fit land in ``_corrupt_record``.

    JSON lines are split over tasks. ``array`` reads files that hold one JSON array each: Spark cannot
    split such a file, so large landings should come as lines or as many files. An array without
    records is an error.
    """
    schema = T.StructType([*LANDING_TRANSACTION.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT)
    rows = reader.option("multiLine", array).json(path)
    if array and rows.isEmpty():
        raise EmptyLandingError(f"no records in {path}")
    return rows.withColumn("timestamp", parse_instant("timestamp"))


def read_by_format(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Read a layer by format name."""
    if file_format == "parquet":
        return spark.read.parquet(path)
    if file_format == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if file_format == "json":
        return spark.read.json(path)
    raise ValueError(f"unknown file format: {file_format}")


def load_normalized(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """A landing file as canonical features."""
    rows = read_landing_json(spark, path, array)
    iso = rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
    return normalize(iso, "simulator")
