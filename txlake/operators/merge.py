"""Keyed merges without a table format: a new version of the whole table from old and new rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def last_of_key(rows: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the last by ``order``, then by all columns. Rows without a key stay.

    Spark keeps one row per key and task before it shuffles; it only does so for a filter on the place alone, so rows
    without a key go past the window.
    """
    rest = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}).desc() for c in sorted(rows.columns) if c not in (key, *order)]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order], *rest, F.lit(0)))
    keyed = rows.filter(F.col(key).isNotNull()).withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")
    return keyed.unionByName(rows.filter(F.col(key).isNull()))


def replace_by_key(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """Incoming rows replace existing rows of the same key whole; the others stay. Of incoming rows of one key the last counts."""
    incoming = last_of_key(incoming, key, order)
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def upsert_columns(existing: DataFrame, incoming: DataFrame, key: str, update: Sequence[str],
                   touched: dict[str, Column] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Insert new keys whole. For known keys take only the ``update`` columns from the incoming row,
    nulls included, and set the ``touched`` columns. Of incoming rows of one key the last by ``order`` counts."""
    touched = touched or {}
    incoming = last_of_key(incoming, key, order)
    old, new = existing.alias("old"), incoming.alias("new")
    known, given = F.col(f"old.{key}").isNotNull(), F.col(f"new.{key}").isNotNull()

    def merged(name: str) -> Column:
        before = F.col(f"old.{name}") if name in existing.columns else F.lit(None)
        after = F.col(f"new.{name}") if name in incoming.columns else F.lit(None)
        if name == key:
            return F.coalesce(before, after)
        if name in touched:
            return F.when(known & given, touched[name]).when(known, before).otherwise(
                F.coalesce(after, touched[name]))
        if name in update:
            return F.when(given, after).otherwise(before)
        return F.when(known, before).otherwise(after)

    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    return joined.select(*[merged(name).alias(name) for name in existing.columns])


def insert_missing(candidates: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate rows whose keys are not in the table yet."""
    return candidates.join(existing.select(*keys), list(keys), "left_anti").select(*candidates.columns)
