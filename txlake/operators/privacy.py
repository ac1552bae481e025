"""Masking of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txlake.functions.identity import cpf_is_valid
from txlake.functions.masking import EXTRA_PII_MASKS, PII_MASKS
from txlake.functions.values import present


def mask_pii(rows: DataFrame, cover_scored: bool = False) -> DataFrame:
    """Mask the columns known to hold personal data; blank values and other columns stay as they are.

    ``cover_scored`` also masks document and holder name of scored transactions.
    """
    masks = {**PII_MASKS, **(EXTRA_PII_MASKS if cover_scored else {})}
    return rows.withColumns({
        name: F.when(present(name).isNotNull(), mask(F.col(name).cast("string"))).otherwise(F.col(name).cast("string"))
        for name, mask in masks.items() if name in rows.columns
    })


def document_validity(rows: DataFrame, document: str, source: str) -> DataFrame:
    """Valid and invalid documents per source."""
    valid = cpf_is_valid(document)
    return rows.groupBy(source).agg(
        F.count_if(valid).alias("valid_documents"), F.count_if(~valid).alias("invalid_documents"))
