"""Ranks and running values inside groups of any size, without a task per group. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from txlake.llm.schema_guard import durable

#: Rows of a group that one window of ``running`` takes; longer groups are cut and their parts' totals carried on.
RUN = 4096


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, joined on ``keys``, where null equals null."""
    right = right.withColumnsRenamed({key: f"_right_{key}" for key in keys})
    condition = F.lit(True)
    for key in keys:
        condition &= F.col(key).eqNullSafe(F.col(f"_right_{key}"))
    return left.join(right, condition, how).drop(*[f"_right_{key}" for key in keys])


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the place from 0 of each row in its group by ``order``. Written to the shared folder.

    Rows are dealt by ranges of group and order, so a group may lie in many tasks; a task's rows are counted where they
    lie, and what the tasks before it hold of the same group (a row per task and group) is added. Rows equal in ``order``
    may change places among themselves.
    """
    keys = [*[F.col(g) for g in group], *order]
    dealt = durable(df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")), "ranged")
    held = dealt.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return attach(dealt, held, [*group, "_part"]).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))


def running(df: DataFrame, group: list[str], place: str, values: dict[str, str]) -> DataFrame:
    """``df`` with its ``values`` columns replaced by their running ``sum`` or ``xor`` in order of ``place``, own row included.

    Places count from 0 and are unique in a group; groups hold no null. Windows hold ``RUN`` places; a group's parts are
    summed up and run over in the same way, so no task takes a whole group.
    """
    kinds = {"sum": F.sum, "xor": F.bit_xor}
    longest = df.agg(F.max(place)).first()[0]
    run = f"{place}_run"
    cut = df.withColumn(run, F.floor(F.col(place) / RUN))
    window = Window.partitionBy(*group, run).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumns({name: kinds[kind](name).over(window) for name, kind in values.items()})
    if longest is None or longest < RUN:
        return inside.select(*df.columns)
    totals = cut.groupBy(*group, run).agg(*[kinds[kind](name).alias(name) for name, kind in values.items()])
    reached = running(totals, group, run, values)
    # The total after part r is what part r + 1 starts from.
    reached = reached.select(*group, (F.col(run) + 1).alias(run), *[F.col(name).alias(f"_before_{name}") for name in values])
    joined = inside.join(reached, [*group, run], "left")

    def with_before(name: str, kind: str) -> Column:
        before = F.coalesce(F.col(f"_before_{name}"), F.lit(0))
        return (F.col(name) + before if kind == "sum" else F.col(name).bitwiseXOR(before)).alias(name)

    return joined.select(*[with_before(c, values[c]) if c in values else F.col(c) for c in df.columns])
