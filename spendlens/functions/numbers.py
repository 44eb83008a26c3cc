"""Turning exported text cells into numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions.guards import col, evaluated_once

DECORATION = "₹$€£%, \t\n\r\x0b\x0c\xa0"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _number(text: Column) -> Column:
    """A plain decimal literal, else null (no hex, suffix or infinity forms)."""
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def clean_numeric(value: Column | str) -> Column:
    """Text to double: currency, percent and separators stripped, K/M/L/Cr/B expanded, junk 0."""
    return numeric_cell(value)["value"]


def numeric_cell(value: Column | str) -> Column:
    """Cleaned ``value`` of a cell and whether it ``changed``, i.e. was not the plain number already.

    Null words hold no number and end at 0 like any other junk. Each step of the way is evaluated
    once: a plain number is taken as it is, in generated code, then the stripped text, then its shorthand.
    """
    factors = F.create_map(*[F.lit(x) for pair in fx.SHORTHAND_FACTORS.items() for x in pair])

    def short(text: Column) -> Column:
        factor = F.coalesce(F.try_element_at(factors, F.lower(F.regexp_extract(text, fx.SHORTHAND_PATTERN, 2))), F.lit(1.0))
        digits = F.regexp_extract(text, fx.SHORTHAND_PATTERN, 1)
        return F.when(digits != "", digits.try_cast("double") * factor)

    def decorated(text: Column) -> Column:
        return evaluated_once(F.translate(text, DECORATION, ""), lambda t: F.coalesce(_number(t), short(t), F.lit(0.0)))

    text = col(value).cast("string")
    plain = _number(F.trim(text))
    return F.struct(F.coalesce(plain, decorated(text)).alias("value"), plain.isNull().alias("changed"))


def clean_web_numeric(value: Column | str) -> Column:
    """Web-analytics cells: everything but digits, dot and minus is dropped; nothing left is 0."""
    digits = F.regexp_replace(col(value).cast("string"), r"[^0-9.\-]", "")
    return F.coalesce(_number(digits), F.lit(0.0))
