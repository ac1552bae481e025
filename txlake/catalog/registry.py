"""Registration of queries and the tables several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from txlake.operators.profiles import build_profiles, profile_rows
from txlake.plans.scoring import analyze
from txlake.session import BASE_CONF, scratch_path, tidy
from txlake.sources import sample

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Session settings a query needs at run time; the rest of BASE_CONF is up to whoever built the session.
_RUNTIME = [
    "spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.adaptive.forceOptimizeSkewedJoin",
]
_paths: dict[tuple[str, str, str], str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL of its check where there is one."""
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            for key in _RUNTIME:
                spark.conf.set(key, BASE_CONF[key])
            return function(spark, folder)

        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table of the pipeline, written once per application and input folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _paths:
        path = scratch_path(spark, name)
        frame = build()
        with tidy(spark):
            frame.write.parquet(path)
        _paths[key] = path
    return spark.read.parquet(_paths[key])


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """All landed transactions, joined once for the profiles and the scores."""
    return stored(spark, folder, "landed", lambda: sample.transactions(spark, folder))


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """The profile store built from all landed transactions."""
    return stored(spark, folder, "profiles", lambda: build_profiles(profile_rows(landed(spark, folder))))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """The history of scored transactions: every landed transaction through the scoring flow."""
    return stored(spark, folder, "scored", lambda: analyze(landed(spark, folder), profiles(spark, folder), F.col("timestamp")))


def text_time(column: str) -> object:
    """Time as text, the same in every engine."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)
