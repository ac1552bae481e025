"""Serving view of a stream's sink: a batch view up to an offset, and the micro-batches beyond it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from txlake.sinks.keyed import Folder

# Exact sums: the same in any order and any grouping.
_AMOUNT = "decimal(28,6)"
_SCHEMA = "user_id string, tx_count long, amount_sum decimal(38,6), first_time timestamp, last_time timestamp"


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("user_id").agg(
        F.sum("tx_count").alias("tx_count"), F.sum("amount_sum").cast("decimal(38,6)").alias("amount_sum"),
        F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"))


class ServingView:
    """Activity per user over everything that a stream has stored, for any number of runs into one sink.

    A micro-batch of a run either lies at or before the run's offset in the newest batch view or beyond it, so it counts once.
    ``refresh`` moves the offsets on: it adds what lies beyond the old ones to the old view, writes a new view, and claims the
    next number for it and its offsets together. ``read`` adds what came after. Only micro-batches that are whole are looked at.
    """

    def __init__(self, spark: SparkSession, sink: str, base: str):
        self.spark, self.sink, self.base = spark, sink.rstrip("/"), base.rstrip("/")
        self.stored, self.views = Folder(spark, self.sink), Folder(spark, self.base)

    def offsets(self) -> tuple[int, dict[str, int], str | None]:
        """Number, last micro-batch per run, and folder of the newest view."""
        last = max((int(n) for n in self.views.names("log") if not n.startswith(".")), default=0)
        if not last:
            return 0, {}, None
        entry = json.loads(self.spark.read.text(f"{self.base}/log/{last:010d}").first()["value"])
        return last, entry["upto"], entry["view"]

    def whole_batches(self) -> dict[str, int]:
        """Last micro-batch per run before which all are whole."""
        found = {}
        for folder in self.stored.names("."):
            if folder.startswith("run="):
                numbers = sorted(int(b.removeprefix("batch_id=")) for b in self.stored.names(folder) if b.startswith("batch_id="))
                # A run writes its micro-batches one after the other; only the last can be under way.
                if numbers and "_SUCCESS" not in self.stored.names(f"{folder}/batch_id={numbers[-1]}"):
                    numbers.pop()
                if numbers:
                    found[folder.removeprefix("run=")] = numbers[-1]
        return found

    def _beyond(self, after: dict[str, int], upto: dict[str, int]) -> DataFrame:
        """Activity in the micro-batches between two offsets; the others' folders aren't opened."""
        chosen = F.lit(False)
        for run, last in upto.items():
            chosen |= (F.col("run") == run) & (F.col("batch_id") > after.get(run, -1)) & (F.col("batch_id") <= last)
        schema = "transaction_id string, user_id string, amount double, event_time timestamp, run string, batch_id long"
        rows = self.spark.read.schema(schema).parquet(self.sink).where(chosen) if upto else self.spark.createDataFrame([], schema)
        return rows.groupBy("user_id").agg(
            F.count("*").alias("tx_count"), F.sum(F.col("amount").cast(_AMOUNT)).cast("decimal(38,6)").alias("amount_sum"),
            F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))

    def _view(self, folder: str | None) -> DataFrame:
        return self.spark.read.schema(_SCHEMA).parquet(f"{self.base}/{folder}") if folder else self.spark.createDataFrame([], _SCHEMA)

    def refresh(self) -> bool:
        """Make a new batch view. False if another job made one meanwhile; its view stands."""
        number, after, folder = self.offsets()
        upto = self.whole_batches()
        view = f"view-{uuid.uuid4().hex}"
        _merged(self._view(folder).unionByName(self._beyond(after, upto))).write.parquet(f"{self.base}/{view}")
        return self.views.create(f"log/{number + 1:010d}", json.dumps({"upto": {**after, **upto}, "view": view}))

    def read(self) -> DataFrame:
        """The newest batch view with everything beyond its offsets."""
        _, after, folder = self.offsets()
        return _merged(self._view(folder).unionByName(self._beyond(after, self.whole_batches())))
