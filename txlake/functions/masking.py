"""Masks for personal data. Text that does not look like the expected kind is returned unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from txlake.functions.values import as_column, present, strip


def only_digits(text: Column | str) -> Column:
    return F.regexp_replace(as_column(text), "[^0-9]", "")


def _stars(count: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(count, F.lit(0)))


def _initial_and_stars(word: Column) -> Column:
    return F.when(F.length(word) > 1, F.concat(F.left(word, F.lit(1)), _stars(F.length(word) - 1))).otherwise("*")


def mask_cpf(document: Column | str) -> Column:
    document = as_column(document)
    d = only_digits(document)
    shown = F.concat(F.lit("***."), d.substr(4, 3), F.lit("*."), d.substr(8, 2), F.lit("-"), d.substr(10, 2))
    return F.when(F.length(d) == 11, shown).otherwise(document)


def mask_email(address: Column | str) -> Column:
    address = as_column(address)
    at = F.instr(address, "@")
    local = F.left(address, at - 1)
    domain = F.substr(address, at + 1)
    dot = F.instr(domain, ".")
    # An empty host has no first letter to show.
    host = F.when(dot > 0, F.left(domain, dot - 1)).otherwise(domain)
    rest = F.when(dot > 0, F.substr(domain, dot)).otherwise(F.lit(""))
    shown = F.concat(_initial_and_stars(local), F.lit("@"), F.left(host, F.lit(1)), F.lit("***"), rest)
    return F.when(at > 0, shown).otherwise(address)


def mask_phone(number: Column | str) -> Column:
    number = as_column(number)
    d = only_digits(number)
    area, tail = d.substr(1, 2), F.right(d, F.lit(4))
    mobile = F.concat(F.lit("("), area, F.lit(") "), d.substr(3, 1), F.lit("****-"), tail)
    other = F.concat(F.lit("("), area, F.lit(") ****-"), tail)
    return F.when(F.length(d) < 10, number).when(F.length(d) == 11, mobile).otherwise(other)


def mask_name(name: Column | str) -> Column:
    words = F.filter(F.split(strip(name), r"\s+"), lambda word: word != "")
    return F.array_join(F.transform(words, _initial_and_stars), " ")


def mask_card(number: Column | str) -> Column:
    """All but the last four digits starred; regrouped by four if the input had spaces."""
    number = as_column(number)
    d = only_digits(number)
    starred = F.concat(_stars(F.length(d) - 4), F.right(d, F.lit(4)))
    grouped = F.regexp_replace(starred, "(.{4})(?=.)", "$1 ")
    return (
        F.when(F.length(d) < 4, number)
        .when(F.instr(number, " ") > 0, grouped)
        .otherwise(starred)
    )


def card_last4(number: Column | str) -> Column:
    d = only_digits(number)
    return F.when(F.length(d) < 4, F.lit("****")).otherwise(F.concat(F.lit("**** "), F.right(d, F.lit(4))))


def pseudonym(identifier: Column | str, salt: str = "") -> Column:
    """First 16 hex digits of SHA-256 over identifier and salt; empty stays empty."""
    identifier = as_column(identifier)
    digest = F.sha2(F.concat(identifier, F.lit(salt)), 256)
    return F.when(identifier == "", identifier).otherwise(F.left(digest, F.lit(16)))


def holder_text(name: Column | str, document: Column | str, hide_name: bool = True) -> Column:
    """Holder for notifications: name, else the document's last four, else a dash.

    ``hide_name`` masks the name, so that no notification carries it in full.
    """
    name, document = as_column(name), as_column(document)
    shown = mask_name(name) if hide_name else name
    tail = F.concat(F.lit("***"), F.right(document, F.lit(4)))
    return (
        F.when(present(name).isNotNull(), shown)
        .when(present(document).isNotNull() & (F.length(document) > 4), tail)
        .otherwise("-")
    )


# Column names known to hold personal data and their mask.
PII_MASKS: dict[str, Callable[[Column | str], Column]] = {
    "cpf": mask_cpf,
    "email": mask_email,
    "phone": mask_phone,
    "telefone": mask_phone,
    "name": mask_name,
    "nome": mask_name,
    "card_number": mask_card,
    "numero_cartao": mask_card,
}

# Columns of scored transactions that hold personal data too; masked on request.
EXTRA_PII_MASKS: dict[str, Callable[[Column | str], Column]] = {
    "holder_document": mask_cpf,
    "card_holder_name": mask_name,
}
