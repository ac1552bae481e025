"""Source records to the canonical feature record, and to scoring requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from txlake import schemas
from txlake.functions.calendar import (
    friday_saturday_flag, hour_from_iso, parse_instant, weekend_flag, weekend_flag_from_iso,
)
from txlake.functions.values import integer_or, or_default, present
from txlake.functions.vocabulary import (
    DEFAULT_CATEGORY, DEFAULT_PAYMENT, HOME_COUNTRY, crosses_border, crosses_border_raw,
    payment_name, strip_accents,
)

CORRUPT = "_corrupt_record"


def _field(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or a typed null where the source has none."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _text_or(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def _from_api(df: DataFrame) -> dict[str, Column]:
    abroad = crosses_border(_field(df, "user_country", "string"), _field(df, "merchant_country", "string"))
    return {
        "amount": _field(df, "amount", "double"),
        "merchant_category": _text_or(_field(df, "merchant_category", "string"), DEFAULT_CATEGORY),
        "payment_method": _text_or(_field(df, "payment_method", "string"), DEFAULT_PAYMENT),
        "hour": F.coalesce(_field(df, "hour", "int"), F.lit(12)),
        "is_weekend": F.coalesce(_field(df, "is_weekend", "int"), F.lit(0)),
        "is_international": F.coalesce(_field(df, "is_international", "int"), abroad),
    }


def _from_simulator(df: DataFrame) -> dict[str, Column]:
    moment = _field(df, "timestamp", "string")
    category = _text_or(_field(df, "merchant_category", "string"), DEFAULT_CATEGORY)
    return {
        "amount": F.coalesce(_field(df, "amount", "double"), F.lit(0.0)),
        "merchant_category": strip_accents(category),
        "payment_method": _text_or(_field(df, "payment_method", "string"), DEFAULT_PAYMENT),
        "hour": hour_from_iso(moment),
        "is_weekend": weekend_flag_from_iso(moment),
        "is_international": crosses_border(
            _field(df, "user_country", "string"), _field(df, "merchant_country", "string")),
    }


def _from_csv(df: DataFrame) -> dict[str, Column]:
    def text(vendor: str, fallback: str | None = None) -> Column:
        value = F.nullif(_field(df, vendor, "string"), F.lit(""))
        if fallback is None:
            return value
        return F.coalesce(value, F.nullif(_field(df, fallback, "string"), F.lit("")))

    return {
        # A text that is no number stays null, to be counted by the quality rules.
        "amount": F.coalesce(text("vlr_transacao", "amount"), F.lit("0")).try_cast("double"),
        "merchant_category": _text_or(text("categoria", "merchant_category"), DEFAULT_CATEGORY),
        "payment_method": _text_or(text("meio_pagamento", "payment_method"), DEFAULT_PAYMENT),
        "hour": integer_or(text("hora"), 12),
        "is_weekend": integer_or(text("fim_semana"), 0),
        "is_international": integer_or(text("internacional"), 0),
    }


def _choose(condition: Column, yes: dict[str, Column], no: dict[str, Column]) -> dict[str, Column]:
    return {name: F.when(condition, yes[name]).otherwise(no[name]) for name in yes}


def _auto(df: DataFrame) -> dict[str, Column]:
    simulated = _field(df, "timestamp", "string").isNotNull() & _field(df, "transaction_id", "string").isNotNull()
    return _choose(simulated, _from_simulator(df), _from_api(df))


def _event(df: DataFrame) -> dict[str, Column]:
    landed = _field(df, "timestamp", "string").isNotNull() & _field(df, "merchant_category", "string").isNotNull()
    return _choose(landed, _from_simulator(df), _from_api(df))


_SOURCES: dict[str, Callable[[DataFrame], dict[str, Column]]] = {
    "api": _from_api, "simulator": _from_simulator, "csv": _from_csv, "auto": _auto, "event": _event,
}


def decode_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON text or bytes to message fields; unreadable JSON goes to ``_corrupt_record`` whole."""
    schema = T.StructType([*schemas.QUEUE_MESSAGE.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    others = [c for c in messages.columns if c != value]
    parsed = messages.select(*others, F.from_json(F.col(value).cast("string"), schema, options).alias("_m"))
    return parsed.select(*others, "_m.*")


def normalize(df: DataFrame, source: str = "auto", keep: list[str] | None = None) -> DataFrame:
    """Canonical features of every row. The label never passes; ``keep`` names columns carried along.

    ``event`` also accepts raw messages in a ``value`` column.
    """
    if source not in _SOURCES:
        raise ValueError(f"unknown source: {source}")
    if source == "event" and "value" in df.columns:
        df = decode_messages(df)
    return df.select(*(keep or []), *[c.alias(n) for n, c in _SOURCES[source](df).items()])


def to_analyze_request(landing: DataFrame, legacy_weekend: bool = False) -> DataFrame:
    """Landing rows to scoring requests. ``legacy_weekend`` counts Friday and Saturday instead."""
    moment = _field(landing, "timestamp", "string")
    when = parse_instant(moment)
    weekend = friday_saturday_flag(when) if legacy_weekend else weekend_flag(when)
    method = _field(landing, "payment_method", "string")
    passed_on = [
        "amount", "merchant_category", "user_country", "merchant_country", "transaction_id", "user_id",
        "holder_document", "card_number", "card_holder_name",
    ]
    kinds = {f.name: f.dataType.simpleString() for f in schemas.LANDING_TRANSACTION}
    return landing.select(
        *[_field(landing, name, kinds[name]).alias(name) for name in passed_on],
        F.when(present(method).isNull() | (F.upper(method) == "PIX"), DEFAULT_PAYMENT)
        .otherwise(method).alias("payment_method"),
        F.coalesce(F.hour(when), F.lit(12)).alias("hour"),
        weekend.alias("is_weekend"),
        crosses_border_raw(
            _field(landing, "user_country", "string"), _field(landing, "merchant_country", "string"),
        ).alias("is_international"),
    )


def request_defaults(requests: DataFrame, clock: Column | None = None) -> DataFrame:
    """Fill a scoring request: blank texts, and hour, weekend and border flags from clock and countries.

    ``clock`` is the time of the request; event time where the caller has one.
    """
    clock = F.current_timestamp() if clock is None else clock
    user = or_default(_field(requests, "user_country", "string"), HOME_COUNTRY)
    merchant = or_default(_field(requests, "merchant_country", "string"), HOME_COUNTRY)
    return requests.withColumns({
        "amount": F.coalesce(_field(requests, "amount", "double"), F.lit(0.0)),
        "merchant_category": or_default(_field(requests, "merchant_category", "string"), DEFAULT_CATEGORY),
        "user_country": user,
        "merchant_country": merchant,
        "payment_method": payment_name(_field(requests, "payment_method", "string")),
        "hour": F.coalesce(_field(requests, "hour", "int"), F.hour(clock)),
        "is_weekend": F.coalesce(_field(requests, "is_weekend", "int"), weekend_flag(clock)),
        "is_international": F.coalesce(_field(requests, "is_international", "int"), (user != merchant).cast("int")),
        "timestamp": clock,
    })

