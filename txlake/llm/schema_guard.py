"""How the operators of this package take frames whose columns may be missing, null or named like their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from txlake.session import scratch_path


def column(df: DataFrame, name: str, kind: str) -> Column:
    """Column ``name`` of ``df`` as ``kind``, found by its exact name."""
    return df[f"`{name}`"].cast(kind).alias(name)


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; others, whatever their names, can't get in the way, also if they differ by case only."""
    names = df.columns
    if len({n.lower() for n in names}) < len(names):
        df = df.toDF(*[n if n in kinds and names.index(n) == at else f"_{at}" for at, n in enumerate(names)])
    return df.select(*[column(df, name, kind) for name, kind in kinds.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of ``df`` is called so."""
    taken = {n.lower() for n in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, label: str) -> DataFrame:
    """``df`` written under the shared folder and read again: later steps don't depend on the executors that made it.

    The shuffle files that the write needed go as soon as it is done, so that steps don't add up on disk.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, label), spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, name: str = "text") -> Column:
    """Bytes of the text column, 0 for null."""
    return F.coalesce(F.octet_length(df[f"`{name}`"]), F.lit(0)).cast("long")
