"""Cleaning raw exports: rows to drop, numbers, dates, and a report of what changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions import dates, numbers
from spendlens.functions.guards import col, count_where
from spendlens.operators import columns as headers
from spendlens.session import stored


@dataclass(frozen=True)
class Source:
    """How one kind of export is cleaned."""

    aliases: dict[str, list[str]]
    name: str
    numeric: tuple[str, ...]
    spend: str | None = None


GOOGLE = Source(fx.GOOGLE_ALIASES, "campaign", ("impressions", "clicks", "cost", "conversions", "conversion value"), "cost")
META = Source(
    fx.META_ALIASES, "campaign name",
    ("impressions", "reach", "frequency", "clicks", "amount spent", "results", "purchase roas", "purchase value"),
    "amount spent",
)
FUNNEL = Source(fx.FUNNEL_ALIASES, "campaign", tuple(fx.FUNNEL_STAGES))


def is_summary_name(name: Column | str) -> Column:
    """Totals, subtotals and blank names."""
    return F.coalesce(F.trim(col(name).cast("string")).rlike(fx.SUMMARY_NAME_PATTERN), F.lit(False))


def is_blank_name(name: Column | str) -> Column:
    return F.coalesce(F.trim(col(name).cast("string")) == "", F.lit(True))


def date_columns(names: list[str]) -> list[str]:
    return [c for c in names if any(word in c.lower() for word in fx.DATE_WORDS)]


def date_cells(df: DataFrame, file: str, ordinal: str, names: list[str]) -> DataFrame:
    """Distinct cells per file and date column (``at``, its number), with the order of day and month that holds there.

    The first cell that can only be read one way decides for its whole file column; null where no
    cell tells. Which cell comes first matters, and is looked up by ``ordinal``, only in file columns
    whose cells disagree.
    """
    each = F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in names])).alias("at", "cell")
    all_cells = df.select(F.col(f"`{file}`").alias("file"), F.col(f"`{ordinal}`").alias("place"), each).where(F.col("cell").isNotNull())
    cells = stored(all_cells.select("file", "at", "cell").distinct())
    vote = dates.shows_day_first("cell")
    votes = cells.groupBy(F.col("file").alias("of_file"), F.col("at").alias("of_column")).agg(
        F.min(vote).alias("one"), F.max(vote).alias("other"))
    same = F.col("file").eqNullSafe(F.col("of_file")) & (F.col("at") == F.col("of_column"))
    split = votes.where("one <> other").select("of_file", "of_column")
    if split.isEmpty():
        return cells.join(votes, same).select("file", "at", "cell", F.col("one").alias("day_first"))
    first = all_cells.join(split, same, "left_semi").where(vote.isNotNull()).groupBy("file", "at").agg(F.min_by(vote, "place").alias("first"))
    settled = votes.join(first, same, "left").select("of_file", "of_column", F.coalesce("first", "one").alias("day_first"))
    return cells.join(settled, same).select("file", "at", "cell", "day_first")


def normalize_dates(df: DataFrame, file: str, ordinal: str, as_of_year: int | None = None) -> DataFrame:
    """Normalise every date-like column; each file's own day/month order applies, day first without one.

    An export repeats few dates in many rows: every distinct cell of a file is parsed once and joined back.
    Parsed cells are stored, so Spark knows their size and joins few of them without a shuffle of the rows.
    """
    names = [c for c in date_columns(df.columns) if c not in (file, ordinal)]
    if not names:
        return df
    cells = date_cells(df, file, ordinal, names)
    parsed = stored(cells.select("file", "at", "cell", dates.normalize_date("cell", F.col("day_first"), as_of_year).alias("clean")))
    rows = df
    for at, name in enumerate(names):
        of_column = parsed.where(F.col("at") == at).select(*[F.col(c).alias(f"{c} {name}") for c in ("file", "cell", "clean")])
        same = F.col(f"`{file}`").eqNullSafe(F.col(f"`file {name}`")) & (F.col(f"`{name}`").cast("string") == F.col(f"`cell {name}`"))
        rows = rows.join(of_column, same, "left")
    differs = [F.coalesce(F.col(f"`clean {c}`") != F.col(f"`cell {c}`"), F.lit(False)).alias(f"changed {c}") for c in names]
    return rows.select(*[F.col(f"`clean {c}`").alias(c) if c in names else F.col(f"`{c}`") for c in df.columns], *differs)


def flagged_export(df: DataFrame, source: Source, file: str, ordinal: str,
                   pre_rename: dict[str, str] | None = None, as_of_year: int | None = None) -> DataFrame:
    """Mapped and cleaned rows, none removed: ``dropped`` says why a row does not count,
    ``changed <column>`` which cells were altered. Numbers are cleaned before the zero-spend test."""
    mapped = headers.map_columns(df, source.aliases, pre_rename)
    names = [c for c in source.numeric if c in mapped.columns]
    cells = mapped.withColumns({f"cell {c}": numbers.numeric_cell(f"`{c}`") for c in names})
    rows = cells.select(*[F.col(f"`cell {c}`.value").alias(c) if c in names else F.col(f"`{c}`") for c in mapped.columns],
                        *[F.col(f"`cell {c}`.changed").alias(f"changed {c}") for c in names])
    dropped = F.lit(None).cast("string")
    if source.spend and source.spend in mapped.columns:
        dropped = F.when(F.col(f"`{source.spend}`") == 0, "zero spend").otherwise(dropped)
    if source.name in mapped.columns:
        if source.spend:
            dropped = F.when(is_blank_name(f"`{source.name}`"), "blank name").otherwise(dropped)
        dropped = F.when(is_summary_name(f"`{source.name}`"), "summary row").otherwise(dropped)
    return normalize_dates(rows.withColumn("dropped", dropped), file, ordinal, as_of_year)


def clean_rows(flagged: DataFrame) -> DataFrame:
    """The rows that count, without the bookkeeping columns."""
    marks = [c for c in flagged.columns if c.startswith("changed ")]
    return flagged.where(F.col("dropped").isNull()).drop("dropped", *marks)


def cleaning_report(flagged: DataFrame, file: str) -> DataFrame:
    """Per file: rows loaded, dropped by reason, kept, and cells changed per column, as (step, count)."""
    kept = F.col("dropped").isNull()
    counts = {"rows loaded": F.count(F.lit(1)), "rows kept": count_where(kept)}
    for reason in ("summary row", "blank name", "zero spend"):
        counts[f"dropped {reason}"] = count_where(F.coalesce(F.col("dropped") == reason, F.lit(False)))
    for name in [c for c in flagged.columns if c.startswith("changed ")]:
        counts[name] = count_where(kept & F.col(f"`{name}`"))
    wide = flagged.groupBy(file).agg(*[v.cast("long").alias(k) for k, v in counts.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"`{k}`").alias("count")) for k in counts])
    return wide.select(file, F.explode(pairs).alias("entry")).select(file, "entry.step", "entry.count")


def clean_web_rows(df: DataFrame, pre_rename: dict[str, str] | None = None) -> DataFrame:
    """Web-analytics rows with canonical columns, clean numbers and a usable ``join_key``."""
    mapped = headers.map_web_columns(df, pre_rename)
    key = F.trim(F.col(headers.web_join_key(mapped.columns)).cast("string"))
    cleaned = {c: numbers.clean_web_numeric(c) for c in fx.WEB_NUMERIC if c in mapped.columns}
    rows = mapped.withColumns({**cleaned, "join_key": key})
    return rows.where(F.col("join_key").isNotNull() & (F.lower("join_key") != "nan"))
