"""Amounts, dates and other values in their normal form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspark.functions.text import group, trimmed

EXACT = "decimal(38,12)"


def money(value: Column) -> Column:
    """Two decimals, half to even, as text; commas and currency signs go; null if it is no number."""
    clean = trimmed(F.translate(value, ",¥￥", ""))
    return F.bround(clean.try_cast(EXACT), 2).cast("decimal(38,2)").cast("string")


def money_value(value: Column) -> Column:
    return money(value).cast("decimal(38,2)")


def date_text(value: Column) -> Column:
    """A text of the shape yyyy-mm-dd, else null."""
    return group(trimmed(value), r"^(\d{4}-\d{2}-\d{2})\z")


def date_value(value: Column) -> Column:
    """The date of a text yyyy-mm-dd; null for impossible days."""
    return F.try_to_date(date_text(value), "yyyy-MM-dd")


def _number(value: Column) -> Column:
    """A plain number, exactly; null for all else."""
    return group(trimmed(value), r"^([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)\z").try_cast(EXACT)


def percent(value: Column) -> Column:
    """``9%`` as ``0.09``, half to even; other texts as they are; null if empty."""
    number = _number(F.regexp_extract(value, r"^(.*)%$", 1))
    share = F.bround((number / 100).cast(EXACT), 2).cast("decimal(38,2)").cast("string")
    return F.when(value == "", None).otherwise(F.coalesce(F.when(value.endswith("%"), share), value))


def two_decimals(value: Column) -> Column:
    """A number with two decimals, half to even; other texts as they are; null if empty."""
    number = F.bround(_number(value), 2).cast("decimal(38,2)").cast("string")
    return F.when(value == "", None).otherwise(F.coalesce(number, value))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole of two amounts with two decimals, half to even; null where the whole is none."""
    share = F.try_divide(part.try_cast(EXACT), whole.try_cast(EXACT)).cast(EXACT)
    return F.bround(share, 2).cast("decimal(38,2)").cast("string")
