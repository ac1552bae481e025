"""CPF check digits and deterministic stand-in identities."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from txlake.functions.masking import only_digits
from txlake.functions.values import as_column, present

# First and last names of the stand-in holders.
FIRST_NAMES = ["Ana", "Bruno", "Carla", "Diego", "Elena", "Felipe", "Gabriela", "Henrique"]
LAST_NAMES = ["Silva", "Santos", "Oliveira", "Souza", "Lima", "Costa", "Ferreira", "Almeida"]
# Leading digits of the stand-in cards.
CARD_PREFIXES = ["4", "5", "2"]


def _weighted(digits: Column, first_weight: int) -> Column:
    """Nine digits times falling weights, summed."""
    return reduce(add, [digits.substr(i + 1, 1).cast("int") * (first_weight - i) for i in range(9)])


def _check_digit(total: Column) -> Column:
    """``11 - total % 11``, with ten and eleven counted as zero."""
    return total * 10 % 11 % 10


def cpf_from_base(base9: Column | str) -> Column:
    """Append both check digits to nine base digits."""
    base9 = as_column(base9)
    first = _check_digit(_weighted(base9, 10))
    second = _check_digit(_weighted(base9, 11) + first * 2)
    return F.concat(base9, first.cast("string"), second.cast("string"))


def format_cpf(digits: Column | str) -> Column:
    return F.regexp_replace(as_column(digits), r"^(\d{3})(\d{3})(\d{3})(\d{2})$", "$1.$2.$3-$4")


def cpf_is_valid(document: Column | str) -> Column:
    """Eleven digits whose last two are the right check digits."""
    d = F.nullif(F.regexp_extract(only_digits(document), "^([0-9]{11})$", 1), F.lit(""))
    return F.coalesce(cpf_from_base(d.substr(1, 9)) == d, F.lit(False))


def _number(seed: Column, salt: str) -> Column:
    """52 bits of a hash that every engine has."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", seed, F.lit(salt))), 1, 13), 16, 10).cast("long")


def _digits_of(seed: Column, salt: str, count: int) -> Column:
    return F.lpad((_number(seed, salt) % 10**count).cast("string"), count, "0")


def _pick(seed: Column, salt: str, choices: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (_number(seed, salt) % len(choices) + 1).cast("int"))


def not_one_digit(base9: Column) -> Column:
    """Nine equal digits, as a number, are no document: they are moved on to a number that has others."""
    return F.when(base9 % 111_111_111 == 0, (base9 + 12) % 10**9).otherwise(base9)


def _marked(digits: Column, marks: dict[int, str]) -> Column:
    """Digits with marks put in at these places; the digits are named once, so that plans stay small."""
    for place, mark in marks.items():
        digits = F.overlay(digits, F.lit(mark), F.lit(place), F.lit(0))
    return digits


def stand_in_document(seed: Column | str) -> Column:
    """A document in its usual form. Its digits are taken from the number: cutting texts and reading them back costs far more."""
    base9 = not_one_digit(_number(as_column(seed), "document") % 10**9)
    digits = [F.call_function("div", base9, F.lit(10**(8 - i))) % 10 for i in range(9)]
    first = _check_digit(reduce(add, [d * (10 - i) for i, d in enumerate(digits)]))
    second = _check_digit(reduce(add, [d * (11 - i) for i, d in enumerate(digits)]) + first * 2)
    number = F.lpad((base9 * 100 + first * 10 + second).cast("string"), 11, "0")
    return _marked(number, {4: ".", 8: ".", 12: "-"})


def stand_in_card(seed: Column | str) -> Column:
    seed = as_column(seed)
    d = F.concat(_pick(seed, "prefix", CARD_PREFIXES), _digits_of(seed, "card", 15))
    return _marked(d, {5: " ", 10: " ", 15: " "})


def stand_in_name(seed: Column | str) -> Column:
    seed = as_column(seed)
    return F.concat_ws(" ", _pick(seed, "first", FIRST_NAMES), _pick(seed, "last", LAST_NAMES))


def with_identity(columns: list[str], seed: Column | str = "transaction_id") -> dict[str, Column]:
    """Holder columns with gaps filled from the seed, so a retried task fills the same values."""

    def filled(name: str, stand_in: Column) -> Column:
        return F.coalesce(present(name), stand_in) if name in columns else stand_in

    return {
        "holder_document": filled("holder_document", stand_in_document(seed)),
        "card_number": filled("card_number", stand_in_card(seed)),
        "card_holder_name": filled("card_holder_name", stand_in_name(seed)),
    }
