"""The event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_event_log(spark: SparkSession, location: str, source: str = "text", **options: str) -> DataFrame:
    """Raw messages in a ``value`` column, from the beginning of the log.

    ``kafka`` subscribes to topic ``location`` with the given connection options; ``text`` follows a
    folder of JSON lines. The position is kept by the checkpoint of the query that writes.
    """
    if source == "kafka":
        defaults = {"subscribe": location, "startingOffsets": "earliest"}
        return spark.readStream.format("kafka").options(**{**defaults, **options}).load().select("value")
    return spark.readStream.options(**options).text(location)


def replay_event_log(spark: SparkSession, location: str, source: str = "text", **options: str) -> DataFrame:
    """The whole log as a batch frame."""
    if source == "kafka":
        return spark.read.format("kafka").options(subscribe=location, **options).load().select("value")
    return spark.read.options(**options).text(location)
