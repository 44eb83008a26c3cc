"""Normalising date cells and period labels to ISO dates.

A cell is cut into its words and numbers once and recognised by its shape; year, month and
day are then read by position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions.guards import col, evaluated_once

DAY_MONTH = r"^(\d{1,2})[-/\.](\d{1,2})[-/\.]\d{2,4}$"
WEEK = r"^[Ww](?:eek\s*|[Kk]\s*)?\d{1,2}"
# notation -> pattern, in the order they are tried
DATE_SHAPES = {
    "excel": r"^\d{5}$",
    "year month day": r"^\d{4}[-/\.]\d{1,2}[-/\.]\d{1,2}$",
    "compact": r"^\d{8}$",
    "ambiguous": r"^\d{1,2}[-/\.]\d{1,2}[-/\.](\d{4}|\d{2})$|^\d{1,2}\s+\d{1,2}\s+\d{4}$",
    "day name year": r"^\d{1,2}[-/\.\s][a-zA-Z]+[-/\.\s](\d{4}|\d{2})$",
    "name day year": r"^[a-zA-Z]+\s+\d{1,2},?\s+\d{4}(\s*[-–]\s*.+)?$",
    "year name day": r"^\d{4}[-/\.][a-zA-Z]+[-/\.]\d{1,2}$",
    "ambiguous range": r"^\d{1,2}[-/\.]\d[-/\.](\d{4}|\d{2})\s*[-–]\s*.+$",
}
LABEL_SHAPES = {
    "quarter year": r"^[Qq][1-4][\s/\-]\d{4}$",
    "year quarter": r"^\d{4}[\s/\-][Qq][1-4]$",
    "half year": r"^[Hh][12][\s/\-]\d{4}$",
    "year half": r"^\d{4}[\s/\-][Hh][12]$",
    "fiscal": r"^[Ff][Yy][\s\-]?(\d{4}|\d{2})$|^[Ff][Yy]\d{4}[-/]\d{2,4}$",
    "week year": WEEK + r"[\s/\-]\d{4}$",
    "week": WEEK + "$",
    "month year": r"^[a-zA-Z]+[\s\-/]\d{4}$",
    "year month": r"^\d{4}[\s\-/][a-zA-Z]+$",
}


def _int(text: Column) -> Column:
    return text.try_cast("int")


def _full_year(year: Column) -> Column:
    """Two-digit years below the pivot belong to this century, the others to the last."""
    return F.when(year < fx.TWO_DIGIT_YEAR_PIVOT, year + 2000).when(year < 100, year + 1900).otherwise(year)


def _month_number(name: Column) -> Column:
    """Number of a month given by its full or three-letter name, else null."""
    known = F.array(*[F.lit(m) for m in fx.MONTH_NAMES])
    short = F.array(*[F.lit(m) for m in fx.MONTHS])
    place = F.greatest(F.array_position(known, F.lower(name)), F.array_position(short, F.lower(name)))
    return F.nullif(place, F.lit(0)).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    parts = [F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string")]
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.concat_ws("-", *parts).try_cast("date"))


def _shape(text: Column, shapes: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in shapes.items()])


def _parts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z]+|\d+"), F.lit(0))


def _date_of(cell: Column) -> Column:
    """Date of a recognised cell (fields text, shape, parts, day_first)."""
    shape, parts = cell["shape"], cell["parts"]
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
    one, two = _int(a), _int(b)
    day_leads = F.when(one > 12, True).when(two > 12, False).otherwise(cell["day_first"])
    ambiguous = shape.startswith("ambiguous")
    year = (
        F.when(shape == "compact", _int(F.left(a, F.lit(4))))
        .when(shape.startswith("year"), one).otherwise(_full_year(_int(c)))
    )
    month = (
        F.when(shape == "compact", _int(F.substring(a, 5, 2))).when(shape == "year month day", two)
        .when(ambiguous, F.when(day_leads, two).otherwise(one))
        .otherwise(_month_number(F.when(shape == "name day year", a).otherwise(b)))
    )
    day = (
        F.when(shape == "compact", _int(F.right(a, F.lit(2)))).when(shape.startswith("year"), _int(c))
        .when(ambiguous, F.when(day_leads, one).otherwise(two))
        .otherwise(F.when(shape == "name day year", two).otherwise(one))
    )
    serial = F.when(one.between(fx.EXCEL_FIRST, fx.EXCEL_LAST), F.date_add(F.lit(fx.EXCEL_EPOCH).cast("date"), one))
    return F.when(shape == "excel", serial).otherwise(_date(year, month, day))


def _period_of(label: Column, fy_start_month: int, as_of_year: int | None) -> Column:
    """First day of a recognised period label (fields shape, parts)."""
    shape, parts = label["shape"], label["parts"]
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
    first = F.lit(1)
    year_leads = shape.startswith("year")
    year = (
        F.when(year_leads, _int(a)).when(shape == "month year", _int(b)).when(shape == "fiscal", _full_year(_int(b)))
        .when(shape == "week", F.lit(as_of_year).cast("int")).otherwise(_int(c))
    )
    count = _int(F.when(year_leads, c).otherwise(b))
    month = (
        F.when(shape.endswith("quarter") | shape.startswith("quarter"), (count - 1) * 3 + 1)
        .when(shape.endswith("half") | shape.startswith("half"), (count - 1) * 6 + 1)
        .when(shape == "fiscal", F.lit(fy_start_month))
        .when(shape == "year month", _month_number(b)).when(shape == "month year", _month_number(a))
    )
    # ISO week 1 is the week of 4 January
    monday = F.date_trunc("week", _date(year, first, F.lit(4))).cast("date")
    return F.when(shape.startswith("week"), F.date_add(monday, (count - 1) * 7)).otherwise(_date(year, month, first))


def period_start(value: Column | str, fy_start_month: int = 4, as_of_year: int | None = None) -> Column:
    """First day of the period a label names (quarter, half, fiscal year, ISO week, month).

    A week without a year needs ``as_of_year``.
    """
    text = F.trim(col(value).cast("string"))
    label = F.struct(_shape(text, LABEL_SHAPES).alias("shape"), _parts(text).alias("parts"))
    return evaluated_once(label, lambda p: F.when(p["shape"].isNotNull(), _period_of(p, fy_start_month, as_of_year)))


def parse_date(value: Column | str, day_first: Column | None = None, as_of_year: int | None = None,
               fy_start_month: int = 4) -> Column:
    """Date of a cell in any of the supported notations; null when it is not one."""
    text = F.trim(col(value).cast("string"))
    order = F.lit(True) if day_first is None else F.coalesce(day_first, F.lit(True))
    cell = F.struct(_shape(text, DATE_SHAPES).alias("shape"), _parts(text).alias("parts"), order.alias("day_first"))
    date = evaluated_once(cell, lambda c: F.when(c["shape"].isNotNull(), _date_of(c)))
    known = ~F.lower(text).isin(fx.DATE_NULL_WORDS)
    return F.when(known, F.coalesce(date, period_start(text, fy_start_month, as_of_year)))


def normalize_date(value: Column | str, day_first: Column | None = None, as_of_year: int | None = None) -> Column:
    """ISO text of the date; cells that are not dates stay as they are."""
    return F.coalesce(parse_date(value, day_first, as_of_year).cast("string"), col(value).cast("string"))


def shows_day_first(value: Column | str) -> Column:
    """True or false where a cell settles the order of day and month, else null."""
    text = F.trim(col(value).cast("string"))
    one, two = _int(F.regexp_extract(text, DAY_MONTH, 1)), _int(F.regexp_extract(text, DAY_MONTH, 2))
    return F.when(one > 12, True).when(two > 12, False)
