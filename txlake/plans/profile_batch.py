"""Profiles from history into the profile store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from txlake.operators.profiles import build_profiles, profile_rows
from txlake.session import durable
from txlake.sinks.lake import append_run, run_record
from txlake.sinks.keyed import KeyedTable


def run_profile_batch(history: DataFrame, store: KeyedTable, runs_path: str, input_name: str = "history",
                      job: str = "profile_batch") -> DataFrame:
    """Build profiles, replace stored ones of the same users, log the run, return the new store.

    The narrow profile rows are stored once and then scanned five times. Only the store's files that hold users of these
    rows are written anew, and runs over other users may go on at the same time.
    """
    spark = history.sparkSession
    rows = durable(profile_rows(history), "profile-rows")
    fresh = durable(build_profiles(rows), "profiles")
    store.upsert(fresh)
    append_run(run_record(spark, job, input_name, rows.count(), fresh.count()), runs_path)
    return store.read()
