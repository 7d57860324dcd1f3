"""Raw records in their normal form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspark.functions.money import date_text, date_value, money, money_value
from quillspark.functions.text import present
from quillspark.schemas import DATA

PARSER_VERSION = "quillspark-0.1.0"


def document_type(form: Column, invoice_type: Column) -> Column:
    air = invoice_type == "air_itinerary"
    return (
        F.when(form == "ofd", F.when(air, "ofd-air-itinerary").otherwise("ofd-fapiao"))
        .when(form == "image", F.when(air, "image-air-itinerary").otherwise("image-fapiao"))
        .when(invoice_type == "rail_12306", "pdf-rail-12306").otherwise("pdf-fapiao"))


def _party(p: Column) -> Column:
    return F.struct(*[present(p[f]).alias(f) for f in ("name", "tax_id", "address", "bank")])


def _item(x: Column) -> Column:
    texts = {f: present(x[f]) for f in ("name", "spec", "unit", "tax_rate")}
    sums = {f: money(x[f]) for f in ("quantity", "unit_price", "amount", "tax_amount")}
    return F.struct(*[(texts | sums)[f].alias(f) for f in ("name", "spec", "unit", "quantity", "unit_price", "amount", "tax_rate", "tax_amount")])


def normalized(raw: Column, form: Column, extracted_by: Column, ocr_vendor: Column) -> Column:
    """The record that callers get: trimmed texts, two-decimal sums, checked dates, no missing keys."""
    source = F.struct(F.coalesce(form, F.lit("pdf")).alias("format"), F.lit(PARSER_VERSION).alias("parser_version"),
                      F.coalesce(extracted_by, F.lit("text_layer")).alias("extracted_by"), present(ocr_vendor).alias("ocr_vendor"))
    kind = F.coalesce(present(raw["document_type"]), document_type(form, raw["invoice_type"]))
    return F.struct(
        kind.alias("document_type"), raw["invoice_type"].alias("invoice_type"), present(raw["invoice_number"]).alias("invoice_number"),
        present(raw["invoice_code"]).alias("invoice_code"), date_text(raw["issue_date"]).alias("issue_date"), _party(raw["seller"]).alias("seller"),
        _party(raw["buyer"]).alias("buyer"), F.transform(raw["items"], _item).alias("items"),
        *[money(raw[f]).alias(f) for f in ("amount_without_tax", "tax_amount", "amount_with_tax")],
        *[present(raw[f]).alias(f) for f in ("amount_in_words", "remark", "checksum")], raw["extra"].alias("extra"), source.alias("source"),
    ).cast(DATA)


def typed(data: Column) -> list[Column]:
    """Date and decimal columns beside the texts of a record."""
    return [date_value(data["issue_date"]).alias("issue_day"),
            *[money_value(data[f]).alias(f"{f}_value") for f in ("amount_without_tax", "tax_amount", "amount_with_tax")]]
