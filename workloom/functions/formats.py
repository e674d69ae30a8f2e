"""Number texts. ``format_number`` rounds the exact binary value half to even, as printf does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grouped(value: Column, digits: int = 0) -> Column:
    """1234.5 -> '1,234.5'"""
    return F.format_number(value, digits)


def fixed(value: Column, digits: int) -> Column:
    """1234.5 -> '1234.5'"""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def with_unit(value: Column, digits: int, suffix: str, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), fixed(value, digits), F.lit(suffix))


def rounded(value: Column, digits: int) -> Column:
    """Round half up by plain double arithmetic, the same on every engine."""
    scale = 10 ** digits
    return F.floor(value * F.lit(float(scale)) + 0.5) / F.lit(float(scale))


def rounded_sql(value: str, digits: int) -> str:
    scale = 10 ** digits
    return f"(floor(({value}) * {scale}.0::DOUBLE + 0.5::DOUBLE) / {scale}.0::DOUBLE)"
