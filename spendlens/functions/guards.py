"""Small column helpers that keep arithmetic null-safe and zero-safe."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def evaluated_once(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it by name, keeping long expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ratio(num: Column | str, den: Column | str, default: float | None = 0.0) -> Column:
    """``num / den``; ``default`` when the denominator is zero or missing."""
    num, den = col(num), col(den)
    guarded = F.when(den != 0, num / den)
    return guarded if default is None else guarded.otherwise(F.lit(default))


def rnd(value: Column | str, digits: int = 0) -> Column:
    """Round by scaling, so the result depends on the binary value as in other engines."""
    value = col(value).cast("double")
    if digits == 0:
        return F.round(value)
    scale = float(10**digits)
    return F.round(value * scale) / scale


def zero_if_null(value: Column | str) -> Column:
    return F.coalesce(col(value), F.lit(0.0))


def present(value: Column | str) -> Column:
    """Null when the value is zero: a stored 0 means "not set" for rules and targets."""
    return F.nullif(col(value), F.lit(0.0))


def first_present(*values: Column | str) -> Column:
    return F.coalesce(*[present(v) for v in values])


def pct_change(current: Column | str, baseline: Column | str) -> Column:
    """Change in percent of the absolute baseline, one decimal; 0 without a baseline."""
    current, baseline = col(current), col(baseline)
    change = rnd((current - baseline) / F.abs(baseline) * 100, 1)
    return F.when(present(baseline).isNull(), F.lit(0.0)).otherwise(change)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def contains_any(text: Column | str, words: list[str] | tuple[str, ...]) -> Column:
    """True when ``text`` holds one of the literal words."""
    text = col(text)
    return any_of([text.contains(w) for w in words])


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def total(value: Column | str) -> Column:
    """Sum taken in wide decimals (millionths, up to 32 digits before them), so it does not depend on
    the order partitions are combined in; larger values stay null instead of ending the job."""
    return F.sum(col(value).try_cast("decimal(38,6)")).cast("double")


def mean(value: Column | str) -> Column:
    """Mean over non-null values, from the order-independent sum."""
    value = col(value)
    return ratio(total(value), F.count(value), None)
