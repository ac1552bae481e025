"""Keyed tables on plain files: merges that rewrite only what they touch, under a log of numbered commits.

Rows lie in buckets by a hash of their key, and in a bucket in files whose range of keys the log knows. A merge reads and
replaces only files whose bucket and range its incoming rows reach. It then claims the next commit number by creating that
file, which only one writer can: the loser looks whether a commit in between shares a bucket with it. If not, it claims the
number after that; if so, it merges again, on what is there now. So no write is lost and none is half visible: readers see
the files that the log has added and not removed. Every ``SNAPSHOT_EVERY`` commits their list is written as a table, so that
opening a table doesn't read all its history.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from txlake.operators.merge import insert_missing, last_of_key, replace_by_key, upsert_columns
from txlake.session import durable, tidy

BUCKETS = 64
SNAPSHOT_EVERY = 16
RETRIES = 50
_FILE = "path string, bucket int, low string, high string, rows long"
_COMMIT = f"sequence long, buckets array<int>, add array<struct<{_FILE.replace(' ', ':').replace(',:', ',')}>>, remove array<string>"


class CommitConflict(RuntimeError):
    """Other writers kept changing the same buckets."""


class Folder:
    """The little that Spark's own readers and writers don't offer: names in a folder, and a file that must not exist yet."""

    def __init__(self, spark: SparkSession, base: str):
        self.jvm, self.base = spark.sparkContext._jvm, base
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.files = self.path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, name: str) -> list[str]:
        folder = self.path(f"{self.base}/{name}")
        return sorted(s.getPath().getName() for s in self.files.listStatus(folder)) if self.files.exists(folder) else []

    def create(self, name: str, text: str) -> bool:
        """Whether the file is now ours, whole. Local files are linked, others renamed; both refuse a name that is taken."""
        folder, target = self.path(f"{self.base}/{name}").getParent(), self.path(f"{self.base}/{name}")
        self.files.mkdirs(folder)
        draft = self.path(f"{folder}/.{uuid.uuid4().hex}")
        out = self.files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.files.getScheme() == "file":
                local = [self.jvm.java.io.File(self.files.makeQualified(p).toUri().getPath()).toPath() for p in (target, draft)]
                self.jvm.java.nio.file.Files.createLink(*local)
            else:
                plain = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.files.getConf()).rename(draft, target, plain)
            return True
        except Py4JJavaError as error:
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        finally:
            self.files.delete(draft, False)


class KeyedTable:
    """A table with one row per key, for any number of writers. The number of buckets is fixed when it is made."""

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, key: str, buckets: int = BUCKETS):
        self.spark, self.base, self.schema, self.key, self.buckets = spark, base.rstrip("/"), schema, key, buckets
        self.folder = Folder(spark, self.base)

    # -- the log ------------------------------------------------------------------

    def _commits(self, numbers: Sequence[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], _COMMIT)
        return self.spark.read.schema(_COMMIT).json([f"{self.base}/commits/{n:020d}.json" for n in numbers])

    def files(self) -> tuple[int, DataFrame]:
        """The last commit's number (0: none), and the files in force."""
        numbers = [int(n.removesuffix(".json")) for n in self.folder.names("commits") if n.endswith(".json") and not n.startswith(".")]
        last = max(numbers, default=0)
        whole = [int(n) for n in self.folder.names("snapshots") if int(n) <= last and "_SUCCESS" in self.folder.names(f"snapshots/{n}")]
        start = max(whole, default=0)
        log = self._commits([n for n in numbers if n > start])
        added = log.select(F.inline("add"))
        if start:
            added = self.spark.read.schema(_FILE).parquet(f"{self.base}/snapshots/{start:020d}").unionByName(added)
        return last, added.join(log.select(F.explode("remove").alias("path")), "path", "left_anti")

    def _commit(self, seen: int, add: list[dict], remove: list[str], buckets: set[int]) -> int | None:
        """The number under which the change is in force; ``None`` if another writer changed one of the buckets after ``seen``."""
        number = seen + 1
        while True:
            change = {"sequence": number, "buckets": sorted(buckets), "add": add, "remove": remove}
            if self.folder.create(f"commits/{number:020d}.json", json.dumps(change)):
                return number
            if buckets & set(self._commits([number]).first()["buckets"]):
                return None
            number += 1

    # -- rows ---------------------------------------------------------------------

    def _rows(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows([r["path"] for r in self.files()[1].select("path").collect()])

    def of_key(self, key: object) -> DataFrame:
        """The rows of a key, from the files that may hold it."""
        value = F.lit(key).cast(self.schema[self.key].dataType)
        text = value.cast("string")
        mine = self.files()[1].filter((F.col("bucket") == self._bucket(value)) & (F.col("low") <= text) & (F.col("high") >= text))
        return self._rows([r["path"] for r in mine.select("path").collect()]).filter(F.col(self.key) == value)

    def _bucket(self, key: Column | None = None) -> Column:
        # The hash by which Spark deals rows to tasks, so that a task of rows dealt by the key holds few buckets.
        return F.pmod(F.hash(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> list[dict]:
        """New files of rows that come in any order: they are dealt by bucket, and a large bucket may fill several files."""
        return self._store(rows.withColumn("_bucket", self._bucket()).hint("rebalance", "_bucket"))

    def _store(self, rows: DataFrame) -> list[dict]:
        """New files, sorted by key, by the tasks that hold the rows, and what the log says of them."""
        folder = f"{self.base}/data/{uuid.uuid4().hex}"
        placed = rows.select(*self.schema.fieldNames(), self._bucket().alias("_bucket")).sortWithinPartitions("_bucket", self.key)
        with tidy(self.spark):
            placed.write.option("compression", "zstd").partitionBy("_bucket").parquet(folder)
        schema = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])
        text = F.col(self.key).cast("string")
        found = self.spark.read.schema(schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_bucket").alias("bucket")).agg(
            F.min(text).alias("low"), F.max(text).alias("high"), F.count("*").alias("rows"))
        return [r.asDict() for r in found.collect()]

    def _merge(self, incoming: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame | None], replaces: bool,
               dealt: bool = False, keys: DataFrame | None = None) -> int:
        """``combine`` gives what is to be written, or ``None`` if nothing changes, from the rows of the files reached and the incoming
        ones, which are stored first unless ``keys`` has their keys."""
        incoming = durable(incoming, "incoming") if keys is None else incoming
        text = F.col(self.key).cast("string")
        # One row per bucket at most.
        reach = (incoming if keys is None else keys).groupBy(self._bucket().alias("bucket")).agg(
            F.min(text).alias("first"), F.max(text).alias("last")).collect()
        if not reach:
            return self.files()[0]
        reached = self.spark.createDataFrame(reach, "bucket int, first string, last string")
        for _ in range(RETRIES):
            seen, files = self.files()
            # A null end, of rows without a key, meets everything.
            meets = F.coalesce((F.col("high") >= F.col("first")) & (F.col("low") <= F.col("last")), F.lit(True))
            old = [r["path"] for r in files.join(reached, "bucket").filter(meets).select("path").collect()]
            rows = combine(self._rows(old), incoming)
            if rows is None:
                return seen
            add = self._store(rows) if dealt else self._write(rows)
            number = self._commit(seen, add, old if replaces else [], {r["bucket"] for r in reach})
            if number is not None:
                if number % SNAPSHOT_EVERY == 0:
                    self._snapshot(number)
                return number
        raise CommitConflict(f"{self.base}: no commit in {RETRIES} tries")

    def _snapshot(self, number: int) -> None:
        last, files = self.files()
        if last == number:
            files.coalesce(1).write.mode("ignore").parquet(f"{self.base}/snapshots/{number:020d}")

    def merge(self, incoming: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame | None], dealt: bool = False) -> int:
        """Replace the rows that share files with incoming keys by ``combine(those rows, incoming)``, which keeps the other keys' rows;
        ``None`` leaves all as it is. ``dealt``: ``combine`` leaves its rows dealt to tasks by their key."""
        return self._merge(incoming, combine, True, dealt)

    def upsert(self, incoming: DataFrame, order: Sequence[str] = ()) -> int:
        """Incoming rows replace those of the same key whole; of several of one key the last by ``order``. The commit's number."""
        return self._merge(incoming, lambda old, new: replace_by_key(old, new, self.key, order), True)

    def upsert_columns(self, incoming: DataFrame, update: Sequence[str], touched: dict[str, Column] | None = None, order: Sequence[str] = ()) -> int:
        """New keys are inserted whole; known ones take the ``update`` columns and set the ``touched`` ones."""
        return self._merge(incoming, lambda old, new: upsert_columns(old, new, self.key, update, touched, order), True)

    def insert(self, incoming: DataFrame, order: Sequence[str] = (), keys: DataFrame | None = None) -> int:
        """Rows of keys that the table doesn't have, the last by ``order`` of each; files in force stay as they are.

        For many rows give ``keys``, stored rows whose keys are those of ``incoming``. Then ``incoming``, with one row per key
        and the same rows each time, is neither stored nor put in order: its keys alone are compared first, and its rows
        are shuffled once, if any is new.
        """
        if keys is None:
            return self._merge(incoming, lambda old, new: insert_missing(last_of_key(new, self.key, order), old, [self.key]), False)

        def missing(old: DataFrame, new: DataFrame) -> DataFrame | None:
            if not old.inputFiles():
                return new
            known = old.select(F.col(self.key).alias("_known")).filter(F.col("_known").isNotNull())
            with tidy(self.spark):
                if keys.select(self.key).distinct().join(known, F.col(self.key) == F.col("_known"), "left_anti").isEmpty():
                    return None
            # An outer join: an anti join would be moved below what makes the rows unique, and shuffle all of them.
            return new.join(known, F.col(self.key) == F.col("_known"), "left").filter(F.col("_known").isNull()).drop("_known")

        return self._merge(incoming, missing, False, dealt=True, keys=keys)
