"""Rolling keyword, ad and ad-group rows up, and insights below campaign level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions import formatting as fmt
from spendlens.functions.guards import ratio, rnd, total, zero_if_null
from spendlens.operators import columns as headers
from spendlens.operators import metrics
from spendlens.operators.dashboard import ranked_within


def roll_up(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum volumes, take the best quality score, weight rates by spend (plain mean without spend)."""
    spend = headers.first_header(df.columns, fx.SPEND_HEADERS)
    weight = zero_if_null(F.col(f"`{spend}`")) if spend else F.lit(0.0)

    def weighted(column: str) -> Column:
        value = F.col(f"`{column}`")
        return F.coalesce(ratio(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)), None), F.avg(value))

    present = df.columns
    sums = [total(f"`{c}`").alias(c) for c in [*fx.ROLLUP_SUM, *fx.ROLLUP_SUM_EXTRA] if c in present]
    best = [F.max(f"`{c}`").alias(c) for c in fx.ROLLUP_MAX if c in present]
    rates = [weighted(c).alias(c) for c in fx.ROLLUP_WEIGHTED if c in present]
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*sums, *best, *rates)


def to_campaigns(df: DataFrame, group: list[str]) -> DataFrame:
    return roll_up(df, [*group, headers.first_header(df.columns, fx.CAMPAIGN_HEADERS)])


def to_adgroups(df: DataFrame, group: list[str]) -> DataFrame:
    """Ad groups stay apart per campaign even when they share a name."""
    campaign = headers.first_header(df.columns, fx.CAMPAIGN_HEADERS)
    return roll_up(df, [*group, campaign, headers.first_header(df.columns, fx.ADGROUP_HEADERS)])


def level_note(df: DataFrame, group: list[str]) -> DataFrame:
    """Rows, campaigns and ad groups a granular export covers."""
    campaign = headers.first_header(df.columns, fx.CAMPAIGN_HEADERS)
    adgroup = headers.first_header(df.columns, fx.ADGROUP_HEADERS)
    level = headers.granularity(df.columns)
    rows = F.count(F.lit(1))
    campaigns = F.countDistinct(F.col(f"`{campaign}`"))
    adgroups = F.countDistinct(F.col(f"`{adgroup}`")) if adgroup else F.lit(None)
    tail = F.lit(" campaigns). Aggregated to campaign level for main audit.")
    text = {
        "keyword": lambda: F.concat(F.lit("Keyword-level data detected ("), rows, F.lit(" keywords across "), campaigns,
                                    F.lit(" campaigns, "), F.coalesce(adgroups.cast("string"), F.lit("?")),
                                    F.lit(" ad groups). Aggregated to campaign level for main audit.")),
        "ad": lambda: F.concat(F.lit("Ad-level data detected ("), rows, F.lit(" ads across "), campaigns, tail),
        "ad_group": lambda: F.concat(F.lit("Ad group level data detected ("), rows, F.lit(" ad groups across "), campaigns, tail),
        "placement": lambda: F.concat(F.lit("Placement-level data detected ("), rows,
                                      F.lit(" placements). Aggregated to campaign level for main audit.")),
    }
    note = text.get(level, lambda: F.concat(F.lit("Campaign-level data ("), rows, F.lit(" campaigns).")))()
    return df.groupBy(*group).agg(rows.alias("rows"), campaigns.alias("campaigns"), F.lit(level).alias("level"), note.alias("note"))


def insights(df: DataFrame, level: str, group: list[str]) -> DataFrame:
    """ROAS, cost and severity per ad group, keyword or ad row."""
    spend = zero_if_null("cost")
    conversions = zero_if_null("conversions")
    given = zero_if_null("roas") if "roas" in df.columns and level == "ad group" else F.lit(0.0)
    roas = F.when(spend != 0, rnd(zero_if_null("`conversion value`") / spend, 2)).otherwise(given)
    ctr = rnd(zero_if_null("ctr"), 2) if "ctr" in df.columns else F.lit(0.0)
    shared = [
        *group, "campaign", F.col("ad group").alias("adgroup"), rnd(spend, 2).alias("spend"), roas.alias("roas"),
        ctr.alias("ctr"), conversions.cast("long").alias("conversions"), metrics.severity_of(roas).alias("severity"),
    ]
    clicks = F.coalesce(F.nullif(zero_if_null("clicks"), F.lit(0.0)), F.lit(1.0))
    own = {
        "ad group": [rnd(ratio(spend, conversions), 2).alias("cac")],
        "keyword": [F.col("keyword"), rnd(spend / clicks, 2).alias("cpc"),
                    F.coalesce(F.col("quality score"), F.lit(0)).cast("int").alias("quality_score")],
        "ad": [F.col("ad")],
    }
    return df.select(*shared, *own[level])


def best_and_worst(df: DataFrame, group: list[str], name: str, top: int = 10, shown: int = 3) -> DataFrame:
    """Of the ten rows with most spend per group, the three with the lowest and highest ROAS."""
    largest = ranked_within(df, group, [F.desc("spend"), F.asc(name)], top, "by_spend")
    worst = ranked_within(largest, group, [F.asc("roas"), F.asc("by_spend")], shown, "place").withColumn("side", F.lit("worst"))
    best = ranked_within(largest, group, [F.desc("roas"), F.asc("by_spend")], shown, "place").withColumn("side", F.lit("best"))
    text = F.concat(F.col(name), F.lit(" (ROAS "), fmt.decimals("roas", 2), F.lit("x, spend "), fmt.grouped("spend"), F.lit(")"))
    return worst.unionByName(best).select(*group, "side", "place", name, text.alias("text"))
