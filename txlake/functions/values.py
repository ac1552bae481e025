"""Defaults, lenient casts and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_WHITE_SPACE = " \t\n\r\f\v"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Drop white space of any kind at both ends."""
    return F.btrim(as_column(value), F.lit(_WHITE_SPACE))


def present(value: Column | str) -> Column:
    """Stripped text, null when nothing but white space is left."""
    return F.nullif(strip(value), F.lit(""))


def or_default(value: Column | str, default: str) -> Column:
    """The text as given, or ``default`` when it is null or blank."""
    value = as_column(value)
    return F.when(present(value).isNotNull(), value).otherwise(F.lit(default))


def number_or(value: Column | str, default: float = 0.0) -> Column:
    """The number, or ``default`` for what is none: null, other text, NaN."""
    other = F.lit(default).cast("double")
    return F.coalesce(F.nanvl(as_column(value).try_cast("double"), other), other)


def integer_or(value: Column | str, default: int) -> Column:
    return F.coalesce(as_column(value).try_cast("int"), F.lit(default))


def round_half_up(value: Column | str, digits: int) -> Column:
    """``floor(v * 10^n + 0.5) / 10^n``: the rounding of the API-side reports."""
    scale = float(10**digits)
    return F.floor(as_column(value) * scale + 0.5) / scale


def round_half_even(value: Column | str, digits: int) -> Column:
    """Round the exact binary value, ties to even: the rounding of the batch profiles."""
    pattern = "0." + "0" * digits
    # + 0.0 turns a rounded negative zero into zero
    return F.call_function("format_number", as_column(value), F.lit(pattern)).cast("double") + F.lit(0.0)


def only_existing(columns: list[str], wanted: list[str]) -> list[str]:
    """The wanted columns that the frame has, in wanted order."""
    return [name for name in wanted if name in columns]


def exact_mean(value: Column | str) -> Column:
    """Mean from an exact decimal sum: the same on every run, whatever order tasks finish in.

    Where a value is beyond 24 digits, infinite or NaN, the mean is that of the doubles.
    """
    value = as_column(value)
    exact = value.cast("double").try_cast("decimal(30,6)")
    odd = F.count_if(value.isNotNull() & exact.isNull())
    return F.when(odd > 0, F.avg(value.cast("double"))).otherwise(F.sum(exact).cast("double") / F.count(value))
