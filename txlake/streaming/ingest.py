"""Event log to clean events, with a dead-letter sink.

No event is lost: one that comes late is taken like any other, and one that comes again, however much later, is known. The
ids that a query has seen are its keyed state, kept by RocksDB on the executors' disks and in the checkpoint, so a
micro-batch asks only for its own ids. What other runs have stored in the same sink is read once when a query starts and
enters the state with its first micro-batch.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from txlake.functions.calendar import parse_instant
from txlake.operators.adapters import CORRUPT, decode_messages
from txlake.sinks.publish import as_messages, with_envelope

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _event_time() -> Column:
    return F.coalesce(parse_instant("timestamp"), parse_instant("event_timestamp")).cast("timestamp")


def decoded(messages: DataFrame) -> DataFrame:
    """Messages as fields, with the event time and whether the message is usable."""
    rows = decode_messages(messages).withColumn("event_time", _event_time())
    usable = F.col(CORRUPT).isNull() & F.col("transaction_id").isNotNull() & F.col("event_time").isNotNull()
    return rows.withColumn("_usable", usable)


def good_events(messages: DataFrame) -> DataFrame:
    """Usable events, late and repeated ones included; the sinks keep each transaction once."""
    return decoded(messages).filter("_usable").drop("_usable", CORRUPT)


def run_name(checkpoint: str) -> str:
    """The run of a checkpoint. The letter keeps partition discovery from taking digits for a number."""
    return f"r-{hashlib.md5(checkpoint.encode()).hexdigest()[:12]}"


def batch_folder(base: str, checkpoint: str, batch_id: int) -> str:
    """Where a micro-batch writes: one folder per checkpoint and batch, overwritten when the batch is retried."""
    return f"{base}/run={run_name(checkpoint)}/batch_id={batch_id}"


STORED_IDS = "transaction_id string, run string, batch_id long"


def stored_by_others(spark: SparkSession, stored: str, checkpoint: str) -> DataFrame:
    """Ids that runs with other checkpoints have stored in a sink."""
    try:
        # A stated schema: run folders are text, whatever they look like.
        known = spark.read.schema(STORED_IDS).parquet(stored)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return spark.createDataFrame([], "transaction_id string")
    return known.filter(F.col("run") != run_name(checkpoint)).select("transaction_id").distinct()


def start_keyed(events: DataFrame, stored: str, checkpoint: str, write: Callable[[DataFrame, int], None],
                once: bool = True) -> StreamingQuery:
    """Run ``write`` with the events of each micro-batch whose transactions neither this query nor the sink ``stored`` has.

    Every start writes the ids of other runs that it has not written before beside the checkpoint; they come as a second
    source, whose rows only fill the state. The micro-batch that brings them is also joined against the sink, as its events
    may come before them. Later ones read nothing but their own events and states. Of rows of one transaction in one
    micro-batch one is kept. Runs that write the same transactions at the same time don't see each other until they start again.
    """
    spark = events.sparkSession
    seeds = f"{checkpoint.rstrip('/')}-ids"
    others = stored_by_others(spark, stored, checkpoint)
    try:
        before = spark.read.schema("transaction_id string").parquet(f"{seeds}/*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        before = None
    fresh = others if before is None else others.join(before, "transaction_id", "left_anti")
    if before is None or not fresh.isEmpty():
        fresh.write.parquet(f"{seeds}/{uuid.uuid4().hex}")
    known = spark.readStream.schema("transaction_id string").parquet(f"{seeds}/*").withColumn("_known", F.lit(True))
    keyed = events.withColumn("_known", F.lit(False)).unionByName(known, allowMissingColumns=True).dropDuplicates(["transaction_id"])
    first = [True]

    def new_only(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter(~F.col("_known")).select(*events.columns)
        if first[0]:
            rows = rows.join(stored_by_others(spark, stored, checkpoint), "transaction_id", "left_anti").select(*events.columns)
        write(rows, batch_id)
        first[0] = False

    provider, usual = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(provider, ROCKSDB)
    try:
        writer = keyed.writeStream.foreachBatch(new_only).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(provider, usual)


def start_unique(events: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write usable events to files, each transaction once over all runs and checkpoints that share ``path``."""
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(batch_folder(path, checkpoint, batch_id))

    return start_keyed(events, path, checkpoint, write, once)


def dead_letters(messages: DataFrame) -> DataFrame:
    """The raw text of unusable messages and why they were turned away."""
    kept = messages.select(F.col("value").cast("string").alias("raw"), F.col("value"))
    reason = (
        F.when(F.col(CORRUPT).isNotNull(), "malformed")
        .when(F.col("transaction_id").isNull(), "no_transaction_id").otherwise("no_event_time")
    )
    return decoded(kept).filter(~F.col("_usable")).select("raw", reason.alias("reason"))


def start(rows: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = True) -> StreamingQuery:
    """Append to files with exactly-once bookkeeping. ``once`` drains what is there and stops."""
    writer = rows.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.outputMode("append").start()


def publish_stream(tx: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Emit a transaction stream as enveloped JSON lines."""
    messages = as_messages(with_envelope(tx)).select("value")
    return start(messages, path, checkpoint, "text", once)
