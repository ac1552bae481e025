"""Time features."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from txlake.functions.values import as_column


def parse_instant(text: Column | str) -> Column:
    """ISO text to timestamp, null when unreadable."""
    return F.try_to_timestamp(as_column(text))


def weekend_flag(moment: Column | str) -> Column:
    """1 on Saturday and Sunday; 0 otherwise, also for null."""
    return F.when(F.dayofweek(as_column(moment)).isin(1, 7), 1).otherwise(0)


def weekend_flag_from_iso(text: Column | str) -> Column:
    """Weekend by the calendar date written in the text, whatever its zone."""
    text = as_column(text)
    readable = parse_instant(text).isNotNull()
    return F.when(readable, weekend_flag(F.to_date(F.substring(text, 1, 10)))).otherwise(0)


def friday_saturday_flag(moment: Column | str) -> Column:
    """The console's weekend: Friday and Saturday."""
    return F.when(F.dayofweek(as_column(moment)).isin(6, 7), 1).otherwise(0)


def small_hours_flag(hour: Column | str) -> Column:
    """Lake and enterprise rule: midnight up to six."""
    return F.when(as_column(hour).between(0, 5), 1).otherwise(0)


def late_or_early(hour: Column | str) -> Column:
    """Scorer rule: before six or after twenty-two."""
    hour = as_column(hour)
    return (hour < 6) | (hour > 22)


def hour_from_iso(text: Column | str, default: int = 12) -> Column:
    """Hour as written after the ``T``, without zone conversion."""
    written = F.regexp_extract(as_column(text), r"T\s*(\d+)\s*(?::|$)", 1)
    return F.coalesce(written.try_cast("int"), F.lit(default))
