"""Builders of raw records; whatever is not named is null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspark.schemas import AIR, ITEM, PARTY, RAIL, RAW

_ITEM_FIELDS = ["name", "spec", "unit", "quantity", "unit_price", "amount", "tax_rate", "tax_amount"]
_RAW_FIELDS = ["document_type", "invoice_type", "invoice_number", "invoice_code", "issue_date", "seller", "buyer", "items",
               "amount_without_tax", "tax_amount", "amount_with_tax", "amount_in_words", "remark", "checksum", "extra"]


def _or_null(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def party(name=None, tax_id=None) -> Column:
    return F.struct(_or_null(name).alias("name"), _or_null(tax_id).alias("tax_id"), F.lit(None).alias("address"), F.lit(None).alias("bank")).cast(PARTY)


def item(**fields) -> Column:
    return F.struct(*[_or_null(fields.get(f)).alias(f) for f in _ITEM_FIELDS]).cast(ITEM)


def no_items() -> Column:
    return F.array().cast(f"array<{ITEM}>")


def extra(rail: Column | None = None, air: Column | None = None) -> Column:
    return F.struct(_or_null(rail).cast(RAIL).alias("rail_12306"), _or_null(air).cast(AIR).alias("air_itinerary"))


def raw(**fields) -> Column:
    defaults = {"seller": party(), "buyer": party(), "items": no_items(), "extra": extra()}
    return F.struct(*[_or_null(fields.get(f, defaults.get(f))).alias(f) for f in _RAW_FIELDS]).cast(RAW)
