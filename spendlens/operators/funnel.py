"""Sales-funnel enrichment of campaigns and its summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions.guards import present, ratio, rnd, total, zero_if_null
from spendlens.operators import columns as headers
from spendlens.operators import matching

STAGES = fx.FUNNEL_STAGES
COSTS = {"cost_per_lead": "leads", "cost_per_mql": "mqls", "cost_per_sql": "sqls", "cost_per_customer": "customers"}
RATES = {"mql_rate": ("mqls", "leads"), "sql_rate": ("sqls", "mqls"), "close_rate": ("customers", "sqls")}


def load_funnel(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Canonical funnel rows per campaign name: stages found by header, last row of a name wins,
    first appearance gives the order. Missing stages stay null. Exports without a campaign column
    are read by ``load_funnel_totals``."""
    name = headers.first_header(df.columns, fx.FUNNEL_CAMPAIGN_HEADERS)
    if name is None:
        raise ValueError("funnel export has no campaign column")
    rows = df.select(*keys, F.trim(F.col(f"`{name}`")).alias("funnel_name"), F.col(ordinal).alias("place"), *_stages(df))
    named = rows.where(F.col("funnel_name").isNotNull() & ~F.lower("funnel_name").isin("", "nan", "total", "grand total"))
    return named.groupBy(*keys, "funnel_name").agg(
        F.min("place").alias("place"), F.max_by(F.struct(*STAGES), "place").alias("last")
    ).select(*keys, "funnel_name", "place", "last.*")


def _stages(df: DataFrame) -> list[Column]:
    """Stage columns of an export as numbers, null where it has no such column."""
    return [
        (F.regexp_replace(F.col(f"`{c}`").cast("string"), ",", "").try_cast("double") if c else F.lit(None).cast("double")).alias(s)
        for s, c in headers.funnel_stages(df.columns).items()
    ]


def load_funnel_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Account totals per key of an export without campaigns: one row per date, or one row in all.

    With a date column, closing totals and rows without a date do not count twice: only dated rows
    are summed.
    """
    day = headers.first_header(df.columns, fx.FUNNEL_DATE_HEADERS)
    rows = df
    if day is not None:
        label = F.lower(F.trim(F.col(f"`{day}`").cast("string")))
        rows = df.where(label.isNotNull() & ~label.isin("", "nan", "total", "grand total"))
    return funnel_totals(rows.select(*keys, *_stages(df)), keys)


def funnel_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[total(s).alias(s) for s in STAGES])


def merge_by_campaign(campaigns: DataFrame, funnel: DataFrame, keys: list[str], order: str = "funnel_name") -> DataFrame:
    """Attach the funnel row of each campaign: same name first, else the first name containing or contained."""
    pairs = matching.first_match(campaigns, funnel, keys, "campaign_name", "funnel_name", order)
    pairs = pairs.withColumnsRenamed({"campaign_name": "name_key", "funnel_name": "funnel_key"})
    rows = funnel.withColumn("funnel_key", matching.name_key("funnel_name")).groupBy(*keys, "funnel_key").agg(
        F.max_by(F.struct(*STAGES), order).alias("row")
    )
    known = pairs.join(rows, [*keys, "funnel_key"]).select(*keys, "name_key", "funnel_key", "row.*")
    return campaigns.withColumn("name_key", matching.name_key("campaign_name")).join(
        known, [*keys, "name_key"], "left"
    ).drop("name_key")


def distribute_by_spend(campaigns: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Share account totals among campaigns in proportion to spend, rounded to whole counts."""
    spend = campaigns.groupBy(*keys).agg(total("spend").alias("key_spend"))
    shared = campaigns.join(spend, keys).join(totals, keys)
    share = ratio(zero_if_null("spend"), "key_spend")
    return shared.withColumns({s: rnd(F.col(s) * share) for s in STAGES}).drop("key_spend")


def attach_totals(campaigns: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Date-level funnels: every campaign of the key carries the key's totals."""
    return campaigns.join(totals, keys)


def with_funnel_metrics(campaigns: DataFrame) -> DataFrame:
    """Cost per stage and stage-to-stage rates; null where the stage is missing or zero."""
    spend = zero_if_null("spend")
    costs = {name: rnd(spend / present(stage), 2) for name, stage in COSTS.items()}
    rates = {name: rnd(zero_if_null(a) / present(b) * 100, 1) for name, (a, b) in RATES.items()}
    return campaigns.withColumns({**costs, **rates})


def worst_stage(rates: dict[str, Column]) -> tuple[Column, Column]:
    """Name and value of the lowest rate below 100; the earlier stage wins ties."""
    entries = [
        F.when(rate < 100, F.struct(rate.alias("rate"), F.lit(i).alias("place"), F.lit(name).alias("stage")))
        for i, (name, rate) in enumerate(rates.items())
    ]
    lowest = F.array_min(F.array_compact(F.array(*entries)))
    return lowest["stage"], F.coalesce(lowest["rate"], F.lit(100.0))


def funnel_summary(campaigns: DataFrame, keys: list[str], totals_once: bool = False) -> DataFrame:
    """Totals, cost per stage, conversion rates and the worst stage per key.

    With ``totals_once`` the stages are account totals repeated on each campaign (date-level
    funnels) and are counted a single time.
    """
    stage_total = (lambda s: F.max(s)) if totals_once else total
    sums = campaigns.groupBy(*keys).agg(total("spend").alias("total_spend"), *[stage_total(s).alias(f"total_{s}") for s in STAGES])

    def rate(part: str, whole: str, digits: int = 1) -> Column:
        return rnd(F.col(f"total_{part}") / present(f"total_{whole}") * 100, digits)

    rates = {
        "lead_to_mql": rate("mqls", "leads"), "mql_to_sql": rate("sqls", "mqls"), "sql_to_customer": rate("customers", "sqls"),
    }
    stage, value = worst_stage(rates)
    return sums.select(
        *keys, rnd("total_spend", 2).alias("total_spend"), *[f"total_{s}" for s in STAGES],
        *[rnd(F.col("total_spend") / present(f"total_{s}"), 2).alias(c) for c, s in COSTS.items()],
        *[r.alias(f"{n}_rate") for n, r in rates.items()],
        rate("customers", "leads", 2).alias("overall_conversion_rate"),
        stage.alias("worst_funnel_stage"), value.alias("worst_funnel_rate"),
    )
