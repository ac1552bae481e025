"""Category, payment, country and label vocabularies."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from txlake.functions.values import as_column, present

# Accented category labels of older files and their plain form.
LEGACY_CATEGORIES = {
    "Eletrônicos": "Eletronicos",
    "Alimentação": "Alimentacao",
    "Vestuário": "Vestuario",
    "Serviços": "Servicos",
}
DEFAULT_CATEGORY = "Outros"
DEFAULT_PAYMENT = "CREDIT_CARD"
HOME_COUNTRY = "BR"

def _bare_letters() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, and that letter, by Unicode's own tables."""
    marked, bare = [], []
    for code in range(0x80, 0x10000):
        parts = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(parts) == 1 and parts[0] != chr(code) and unicodedata.category(chr(code)).startswith("L"):
            marked.append(chr(code))
            bare.append(parts[0])
    return "".join(marked), "".join(bare)


ACCENTED, UNACCENTED = _bare_letters()

# Display labels of the model features, and the weights shown until a model is trained.
FEATURE_LABELS = {
    "amount": "Valor da transacao (amount)",
    "log_amount": "Valor em escala log (log_amount)",
    "hour": "Hora do dia (hour)",
    "is_weekend": "Fim de semana (is_weekend)",
    "is_international": "Compra internacional (is_international)",
    "merchant_category_encoded": "Categoria do comercio (merchant_category_encoded)",
    "payment_method_encoded": "Meio de pagamento (payment_method_encoded)",
}
FEATURE_WEIGHTS = {
    "amount": 0.28,
    "log_amount": 0.22,
    "is_international": 0.18,
    "hour": 0.12,
    "payment_method_encoded": 0.10,
    "merchant_category_encoded": 0.06,
    "is_weekend": 0.04,
}


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in table.items() for part in pair])


def strip_accents(text: Column | str) -> Column:
    """Drop diacritics of letters of any script, composed or as separate combining marks."""
    plain = F.translate(as_column(text), ACCENTED, UNACCENTED)
    return F.regexp_replace(plain, r"\p{Mn}+", "")


def plain_category(label: Column | str) -> Column:
    """Scorer form: legacy labels mapped, blank to the default, null to the default."""
    label = as_column(label)
    plain = F.when(present(label).isNull(), DEFAULT_CATEGORY)
    for legacy, name in LEGACY_CATEGORIES.items():
        plain = plain.when(label == legacy, name)
    return plain.otherwise(label)


def holds_category(labels: Column, plain: Column) -> Column:
    """Whether a list of labels holds a category in its plain or its legacy spelling."""
    legacy = F.lit("")
    for accented, name in LEGACY_CATEGORIES.items():
        legacy = F.when(plain == name, accented).otherwise(legacy)
    return F.array_contains(labels, plain) | F.array_contains(labels, legacy)


def training_category(label: Column | str) -> Column:
    """Model form: also trims and treats ``0`` as missing."""
    return plain_category(F.nullif(present(label), F.lit("0")))


def payment_name(method: Column | str) -> Column:
    """Upper case, blank to the default, instant transfers scored as cards."""
    name = F.upper(present(method))
    return F.when(name.isNull() | (name == "PIX"), F.lit(DEFAULT_PAYMENT)).otherwise(name)


def crosses_border(user_country: Column | str, merchant_country: Column | str) -> Column:
    """1 when the two countries differ, each missing one counted as the home country."""
    home = F.lit(HOME_COUNTRY)
    differs = F.coalesce(as_column(user_country), home) != F.coalesce(as_column(merchant_country), home)
    return differs.cast("int")


def crosses_border_strict(user_country: Column | str, merchant_country: Column | str) -> Column:
    """Enterprise rule: a known user country that is not the merchant's, known or not."""
    user = as_column(user_country)
    return user.isNotNull() & ~user.eqNullSafe(as_column(merchant_country))


def crosses_border_raw(user_country: Column | str, merchant_country: Column | str) -> Column:
    """Console rule: no defaults, so one missing country also differs."""
    return (~as_column(user_country).eqNullSafe(as_column(merchant_country))).cast("int")


def profile_owner(*candidates: Column | str) -> Column:
    """First candidate that is not blank, else ``anonymous``."""
    return F.coalesce(*[present(c) for c in candidates], F.lit("anonymous"))


def feature_label(name: Column | str) -> Column:
    name = as_column(name)
    titled = F.initcap(F.trim(F.replace(name, F.lit("_"), F.lit(" "))))
    return F.coalesce(F.try_element_at(literal_map(FEATURE_LABELS), name), F.concat(titled, F.lit(" ("), name, F.lit(")")))
