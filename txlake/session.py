"""Session construction and the shared scratch folder."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small shuffles keep all cores busy, as when one task would write thousands of date folders.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # A user or merchant may hold a third of all rows: let joins split that partition
    # even where the split costs one more exchange further up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Wide scoring projections outgrow the size HotSpot compiles; Spark then splits them into methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_tidied: dict[int, tuple[str, int]] = {}


def build_session(app: str = "txlake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on. Keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.lru_cache(maxsize=None)
def _local_scratch(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="txlake-scratch-")


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_scratch(context.applicationId)


def scratch_path(spark: SparkSession, label: str) -> str:
    """Fresh path under the scratch folder; paths are never reused or cleared."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``checkpoint()`` at the scratch folder unless the cluster already named one."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside drop their shuffle files when they end, so that what is written and read again doesn't add up on disk.

    Several threads of a session may be inside; the last one out restores its setting.
    """
    session = spark._jsparkSession.hashCode()
    with _lock:
        before, inside = _tidied.get(session, (spark.conf.get(_CLEAN_UP), 0))
        _tidied[session] = before, inside + 1
        spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        with _lock:
            before, inside = _tidied.pop(session)
            if inside > 1:
                _tidied[session] = before, inside - 1
            else:
                spark.conf.set(_CLEAN_UP, before)


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table of the scratch folder and read it back.

    Cuts the lineage for frames that several later scans share; the files outlive lost executors.
    """
    path = scratch_path(df.sparkSession, label)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
