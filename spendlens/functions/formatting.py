"""Number and text formats used in messages and exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions.guards import col, rnd


def decimals(value: Column | str, digits: int) -> Column:
    """Fixed-point text; rounding first keeps half-way cases independent of the formatter."""
    return F.format_string(f"%.{digits}f", rnd(value, digits))


def grouped(value: Column | str) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(rnd(value), 0)


def times(value: Column | str) -> Column:
    return F.coalesce(F.concat(decimals(value, 2), F.lit("x")), F.lit("N/A"))


def percent(value: Column | str, digits: int = 1) -> Column:
    return F.coalesce(F.concat(decimals(value, digits), F.lit("%")), F.lit("N/A"))


def rupees(value: Column | str) -> Column:
    """Indian grouping: the last three digits, then pairs (``Rs 1,23,456``)."""
    value = col(value).cast("double")
    whole = F.floor(F.abs(value)).cast("string")
    tail = F.right(whole, F.lit(3))
    head = F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))
    # a comma goes before every pair counted from the right end of the leading digits
    paired = F.regexp_replace(head, r"(?<=\d)(?=(\d{2})+$)", ",")
    body = F.when(F.length(whole) > 3, F.concat_ws(",", paired, tail)).otherwise(whole)
    sign = F.when(value < 0, F.lit("-Rs ")).otherwise(F.lit("Rs "))
    return (
        F.when(value.isNull(), F.lit("N/A"))
        .when(value == 0, F.lit("Rs 0"))
        .otherwise(F.concat(sign, body))
    )


def repair_mojibake(text: Column | str) -> Column:
    """Replace known byte-mangled sequences with the characters they stood for."""
    text = col(text)
    for broken, wanted in fx.MOJIBAKE.items():
        text = F.replace(text, F.lit(broken), F.lit(wanted))
    return text
