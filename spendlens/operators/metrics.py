"""Campaign metrics, platform summaries and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions.guards import col, count_where, mean, ratio, rnd, total


def severity_of(roas: Column | str) -> Column:
    roas = col(roas)
    return (
        F.when(roas < fx.ROAS_CRITICAL_BELOW, "critical")
        .when(roas < fx.ROAS_WARNING_BELOW, "warning")
        .otherwise("ok")
    )


def wasted_of(spend: Column | str, severity: Column | str) -> Column:
    spend, severity = col(spend), col(severity)
    return (
        F.when(severity == "critical", spend)
        .when(severity == "warning", spend * fx.WARNING_WASTE_SHARE)
        .otherwise(F.lit(0.0))
    )


def rate_columns(spend: str, clicks: str, impressions: str, conversions: str) -> dict[str, Column]:
    return {
        "cac": ratio(spend, conversions),
        "ctr": ratio(clicks, impressions) * 100,
        "cpc": ratio(spend, clicks),
        "efficiency": ratio(conversions, spend) * 1000,
    }


def google_metrics(df: DataFrame) -> DataFrame:
    """Search-ads metrics: ROAS comes from the reported conversion value."""
    return df.withColumns(
        {"roas": ratio("conversion value", "cost"), **rate_columns("cost", "clicks", "impressions", "conversions")}
    ).transform(_judge, "cost")


def meta_metrics(df: DataFrame) -> DataFrame:
    """Social-ads metrics: ROAS is reported by the platform."""
    return df.withColumns(
        {"roas": F.col("purchase roas"), **rate_columns("amount spent", "clicks", "impressions", "results")}
    ).transform(_judge, "amount spent")


def _judge(df: DataFrame, spend: str) -> DataFrame:
    return df.withColumn("severity", severity_of("roas")).withColumn("wasted", wasted_of(spend, "severity"))


def learning_phase(impressions: Column | str, conversions: Column | str) -> Column:
    few_views = col(impressions) < fx.LEARNING_IMPRESSIONS
    return F.coalesce(few_views & (col(conversions).cast("int") < fx.LEARNING_CONVERSIONS), F.lit(False))


def stored_metrics(df: DataFrame) -> DataFrame:
    """Unified campaign row as stored: severity from the exact ROAS, then rounded metrics."""
    exact_roas = ratio("conversion_value", "spend")
    with_rates = df.withColumns(
        {
            "severity": severity_of(exact_roas),
            "roas": rnd(exact_roas, 2),
            "cac": rnd(ratio("spend", "conversions"), 2),
            "ctr": rnd(ratio("clicks", "impressions") * 100, 2),
            "cpc": rnd(ratio("spend", "clicks"), 2),
            "efficiency": rnd(ratio("conversions", "spend") * 1000, 3),
        }
    )
    return with_rates.withColumns(
        {
            "wasted_spend": wasted_of("spend", "severity"),
            "pct_new_users": rnd(100.0 * ratio("new_users", F.col("new_users") + F.col("returning_users"), None), 1),
            "cost_per_new_user": rnd(ratio("spend", "new_users", None), 2),
        }
    )


def canonical_google(df: DataFrame) -> DataFrame:
    """Search-ads rows in the shape of the fact table."""
    return _canonical(google_metrics(df), "campaign", "cost", "conversions", F.col("conversion value"), "google")


def canonical_meta(df: DataFrame) -> DataFrame:
    """Social-ads rows in the shape of the fact table; revenue only when exported."""
    revenue = F.col("purchase value") if "purchase value" in df.columns else F.lit(None).cast("double")
    return _canonical(meta_metrics(df), "campaign name", "amount spent", "results", revenue, "meta")


def _canonical(df: DataFrame, name: str, spend: str, conversions: str, revenue: Column, platform: str) -> DataFrame:
    def optional(column: str) -> Column:
        return F.col(column) if column in df.columns else F.lit(None).cast("double")

    extra = [c for c in ("client", "client_id", "upload_id", "sent_as", "sent_at") if c in df.columns]
    return df.select(
        *extra,
        F.lit(platform).alias("platform"),
        F.col(name).cast("string").alias("campaign_name"),
        F.col(spend).alias("spend"),
        revenue.alias("conversion_value"),
        F.col(conversions).cast("long").cast("double").alias("conversions"),
        "impressions",
        "clicks",
        rnd("roas", 2).alias("roas"),
        rnd("cac", 2).alias("cac"),
        rnd("ctr", 2).alias("ctr"),
        rnd("cpc", 2).alias("cpc"),
        rnd("efficiency", 3).alias("efficiency"),
        learning_phase("impressions", conversions).alias("learning_phase"),
        "severity",
        F.col("wasted").alias("wasted_spend"),
        optional("reach").alias("reach"),
        rnd(F.nullif(optional("frequency"), F.lit(0.0)), 2).alias("frequency"),
    )


def trend_of(current: Column | str, prior: Column | str) -> Column:
    """Direction of ROAS against the prior period, with a dead band."""
    prior = F.nullif(col(prior), F.lit(0.0))
    change = (col(current) - prior) / prior
    return (
        F.when(prior.isNull(), "unknown")
        .when(change > fx.TREND_BAND, "improving")
        .when(change < -fx.TREND_BAND, "declining")
        .otherwise("stable")
    )


def with_prior_roas(campaigns: DataFrame, prior: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Attach ROAS of a separate prior-period export by campaign name and the resulting trend.

    A name listed twice in the prior export counts with its last row.
    """
    last = prior.groupBy(*keys, "campaign_name").agg(rnd(F.max_by("roas", ordinal), 2).alias("prior_roas"))
    joined = campaigns.join(last, [*keys, "campaign_name"], "left")
    return joined.withColumn("trend", trend_of("roas", "prior_roas"))


def delta(current: Column | str, previous: Column | str) -> Column:
    """Struct of absolute change, size in percent and direction."""
    current, previous = col(current), col(previous)
    pct = rnd((current - previous) / F.nullif(previous, F.lit(0.0)) * 100, 1)
    return F.struct(
        F.when(previous == 0, current).otherwise(rnd(current - previous, 2)).alias("value"),
        F.coalesce(F.abs(pct), F.lit(0.0)).alias("pct"),
        F.when(pct > 0, "up").when(pct < 0, "down").otherwise("flat").alias("direction"),
    )


def platform_summary(campaigns: DataFrame, keys: list[str], roas_is_ratio: Column | None = None) -> DataFrame:
    """Totals per key and platform; ROAS as ratio of sums, or as mean where no revenue is known."""
    use_ratio = roas_is_ratio if roas_is_ratio is not None else F.count("conversion_value") > 0
    return campaigns.groupBy(*keys, "platform").agg(*_summary_columns(use_ratio))


def _summary_columns(use_ratio: Column) -> list[Column]:
    ratio_of_sums = ratio(total("conversion_value"), total("spend"))
    mean_roas = mean(F.coalesce("roas", F.lit(0.0)))
    return [
        rnd(total("spend"), 2).alias("total_spend"),
        rnd(total("conversion_value"), 2).alias("total_revenue"),
        rnd(F.when(use_ratio, ratio_of_sums).otherwise(mean_roas), 2).alias("overall_roas"),
        rnd(total("conversions")).alias("total_conversions"),
        rnd(ratio(total("spend"), total("conversions")), 2).alias("overall_cac"),
        rnd(mean(F.coalesce("ctr", F.lit(0.0))), 2).alias("overall_ctr"),
        rnd(total("wasted_spend"), 2).alias("wasted_spend"),
        F.count(F.lit(1)).alias("campaign_count"),
        count_where(F.col("severity") == "critical").alias("critical_count"),
        count_where(F.col("severity") == "warning").alias("warning_count"),
        count_where(F.col("severity") == "ok").alias("ok_count"),
    ]


#: Levels of ``account_rollup`` by their grouping id.
LEVELS = {7: "all", 3: "client", 1: "platform", 0: "campaign"}


def account_rollup(campaigns: DataFrame) -> DataFrame:
    """The summary of every campaign, of each client's platforms, of each client and of everything, in one aggregation.

    Sums, means and ratios of a level come from its own rows. ``level`` tells the levels apart: a
    null name is a key that was rolled up only above its level.
    """
    by_level = campaigns.rollup("client_id", "platform", "campaign_name").agg(
        F.grouping_id("client_id", "platform", "campaign_name").alias("at"), *_summary_columns(F.count("conversion_value") > 0))
    level = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])[F.col("at").cast("int")]
    return by_level.select(level.alias("level"), *[c for c in by_level.columns if c != "at"])


def rebuilt_summary(campaigns: DataFrame, keys: list[str]) -> DataFrame:
    """The summary as rebuilt from stored rows: social ads report mean ROAS and no revenue."""
    summary = platform_summary(campaigns, keys, roas_is_ratio=F.max("platform") == "google")
    return summary.withColumn("total_revenue", F.when(F.col("platform") == "google", F.col("total_revenue")))


def cross_platform(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Both platforms side by side, for keys that have both."""
    sides = summary.groupBy(*keys).pivot("platform", ["google", "meta"]).agg(
        F.max("total_spend").alias("spend"), F.max("overall_roas").alias("roas"),
        F.max("overall_cac").alias("cac"), F.max("wasted_spend").alias("wasted"),
    )
    return sides.where(F.col("google_spend").isNotNull() & F.col("meta_spend").isNotNull()).select(
        *keys,
        *[f"{p}_{m}" for m in ("spend", "roas", "cac", "wasted") for p in ("google", "meta")],
        F.when(F.col("google_roas") >= F.col("meta_roas"), "google").otherwise("meta").alias("better_platform"),
        rnd(F.col("google_spend") + F.col("meta_spend"), 2).alias("total_spend"),
        rnd(F.col("google_wasted") + F.col("meta_wasted"), 2).alias("total_wasted"),
    )


def period_comparison(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Deltas of spend, ROAS, CAC and conversions between two platform summaries."""
    measures = {"spend": "total_spend", "roas": "overall_roas", "cac": "overall_cac", "conversions": "total_conversions"}
    on = [*keys, "platform"]
    before = previous.select(*on, *[F.col(c).alias(f"previous_{c}") for c in measures.values()])
    deltas = [delta(c, f"previous_{c}").alias(name) for name, c in measures.items()]
    return current.join(before, on).select(*on, *deltas)
