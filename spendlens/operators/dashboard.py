"""Executive dashboard: KPIs with deltas, splits, top lists, audience signals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions import formatting as fmt
from spendlens.functions.guards import (
    col, contains_any, first_present, mean, present, ratio, rnd, total, zero_if_null,
)

RANGES = {"7": 7, "30": 30, "90": 90, "all": None}


def window_members(facts: DataFrame, as_of: date) -> DataFrame:
    """Repeat each row for every dashboard range it counts in, as current or as prior window."""
    day, today = F.col("period_date"), F.lit(as_of)
    slots = []
    for name, days in RANGES.items():
        if days is None:
            slots.append(F.struct(F.lit(name).alias("date_range"), F.lit(True).alias("is_current")))
            continue
        start, prior_start = F.date_sub(today, days), F.date_sub(today, 2 * days)
        member = F.when(day >= start, True).when((day >= prior_start) & (day <= F.date_sub(start, 1)), False)
        slots.append(
            F.when(member.isNotNull(), F.struct(F.lit(name).alias("date_range"), member.alias("is_current")))
        )
    return facts.withColumn("slot", F.explode(F.array_compact(F.array(*slots)))).select(
        "*", "slot.date_range", "slot.is_current"
    ).drop("slot")


def kpi_summary(facts: DataFrame, as_of: date) -> DataFrame:
    """KPIs, deltas against the preceding window and P&L per client and range, in one pass."""
    now = F.col("is_current")

    def current(column: str) -> Column:
        return F.when(now, F.col(column))

    def prior(column: str) -> Column:
        return F.when(~now, F.col(column))

    sums = {"spend": "spend", "conversions": "conversions", "revenue": "conversion_value"}
    grouped = window_members(facts, as_of).groupBy("client_id", "date_range").agg(
        *[total(current(c)).alias(n) for n, c in sums.items()],
        *[total(prior(c)).alias(f"prior_{n}") for n, c in sums.items()],
        mean(current("ctr")).alias("avg_ctr"),
        mean(current("cpc")).alias("avg_cpc"),
        F.countDistinct(current("campaign_name")).alias("campaign_count"),
        F.countDistinct(current("upload_id")).alias("upload_count"),
    )

    def positive_ratio(num: str, den: str) -> Column:
        return F.when(F.col(den) > 0, F.col(num) / F.col(den)).otherwise(F.lit(0.0))

    derived = grouped.withColumns(
        {
            "blended_roas": positive_ratio("revenue", "spend"),
            "cpa": positive_ratio("spend", "conversions"),
            "prior_blended_roas": F.when(F.col("prior_spend").isNotNull(), positive_ratio("prior_revenue", "prior_spend")),
            "prior_cpa": F.when(F.col("prior_spend").isNotNull(), positive_ratio("prior_spend", "prior_conversions")),
        }
    )

    def change(column: str) -> Column:
        before = present(f"prior_{column}")
        return rnd((zero_if_null(column) - before) / F.abs(before) * 100, 1)

    revenue, spend = rnd(zero_if_null("revenue"), 2), rnd(zero_if_null("spend"), 2)
    profit = rnd(zero_if_null("revenue") - zero_if_null("spend"), 2)
    return derived.select(
        "client_id", "date_range",
        *[rnd(zero_if_null(c), 2).alias(n) for n, c in {
            "total_spend": "spend", "total_conversions": "conversions", "total_revenue": "revenue",
            "blended_roas": "blended_roas", "cpa": "cpa", "avg_ctr": "avg_ctr", "avg_cpc": "avg_cpc"}.items()],
        "campaign_count", "upload_count",
        rnd(ratio(zero_if_null("revenue"), zero_if_null("spend")), 2).alias("mer"),
        *[change(c).alias(f"{n}_delta") for n, c in {
            "spend": "spend", "revenue": "revenue", "conversions": "conversions", "roas": "blended_roas",
            "cpa": "cpa"}.items()],
        profit.alias("gross_profit"),
        F.when(revenue > 0, rnd(profit / revenue * 100, 1)).otherwise(F.lit(0.0)).alias("gross_margin_pct"),
    )


def _volume(facts: DataFrame, *keys: str) -> DataFrame:
    return facts.groupBy(*keys).agg(
        total("spend").alias("spend"), total("conversions").alias("conversions"),
        total("conversion_value").alias("revenue"), mean("ctr").alias("ctr"), mean("cpc").alias("cpc"),
    )


def _tidy(*columns: str) -> list[Column]:
    return [rnd(zero_if_null(c), 2).alias(c) for c in columns]


def upload_trend(facts: DataFrame) -> DataFrame:
    label = F.coalesce("period_label", F.col("period_date").cast("string"))
    return _volume(facts, "client_id", "upload_id", "period_label", "period_date").select(
        "client_id", "upload_id", label.alias("label"), "period_date", *_tidy("spend", "revenue", "conversions"),
        rnd(ratio("revenue", "spend"), 2).alias("roas"),
    )


def channel_split(facts: DataFrame) -> DataFrame:
    return _volume(facts, "client_id", "platform").select(
        "client_id", "platform", *_tidy("spend", "conversions", "revenue"),
        rnd(ratio("revenue", "spend"), 2).alias("roas"),
        rnd("ctr", 2).alias("avg_ctr"), rnd("cpc", 2).alias("avg_cpc"),
    )


def ranked_within(df: DataFrame, keys: list[str], order: list[Column], limit: int, name: str = "position") -> DataFrame:
    """First ``limit`` rows per key; Spark keeps only that many per task before the shuffle."""
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(spec)).where(F.col(name) <= limit)


def top_campaigns(facts: DataFrame, limit: int = 10) -> DataFrame:
    volume = _volume(facts, "client_id", "campaign_name", "platform")
    best = ranked_within(volume, ["client_id"], [F.desc("spend"), F.asc("campaign_name"), F.asc("platform")], limit)
    return best.select(
        "client_id", "position", "campaign_name", "platform", *_tidy("spend", "conversions", "revenue"),
        rnd(ratio("revenue", "spend"), 2).alias("roas"), rnd(ratio("spend", "conversions"), 2).alias("cpa"),
        rnd("ctr", 2).alias("ctr"),
    )


def funnel_totals(funnel: DataFrame) -> DataFrame:
    return funnel.groupBy("client_id").agg(
        *[total(s).alias(f"total_{s}") for s in fx.FUNNEL_STAGES],
        rnd(mean("cost_per_lead"), 2).alias("avg_cpl"), rnd(mean("cost_per_customer"), 2).alias("avg_cac"),
    )


def reach_and_frequency(facts: DataFrame) -> DataFrame:
    reached = facts.where((F.col("platform") == "meta") & F.col("reach").isNotNull())
    return reached.groupBy("client_id", "campaign_name").agg(
        rnd(total("spend"), 2).alias("spend"), rnd(total("reach"), 2).alias("reach"),
        mean("frequency").alias("frequency"), total("conversions").alias("conversions"),
        F.when(total("reach") > 0, total("impressions") / total("reach")).alias("calc_frequency"),
    )


def frequency_fatigue(facts: DataFrame, threshold: float = 3.0) -> DataFrame:
    seen = first_present("frequency", "calc_frequency")
    action = F.concat(
        F.lit("Refresh creative or pause — audience has seen this ad "), fmt.decimals(seen, 1), F.lit("x on average.")
    )
    tired = reach_and_frequency(facts).where(F.coalesce(seen, F.lit(0.0)) >= threshold)
    return tired.select("client_id", "campaign_name", rnd(seen, 2).alias("frequency"), action.alias("action"))


def user_split(facts: DataFrame, limit: int = 15) -> DataFrame:
    """The largest rows with user data per client, with the share of new users."""
    rows = facts.where(F.col("new_users").isNotNull())
    order = [F.desc("spend"), F.asc("campaign_name"), F.asc("platform"), F.asc("upload_id")]
    return ranked_within(rows, ["client_id"], order, limit).select(
        "client_id", "position", "upload_id", "campaign_name", "platform", "spend", "new_users", "returning_users",
        "pct_new_users", "cost_per_new_user",
    )


def user_totals(facts: DataFrame) -> DataFrame:
    new, back = total("new_users"), total("returning_users")
    return facts.where(F.col("new_users").isNotNull()).groupBy("client_id").agg(
        new.alias("total_new_users"), back.alias("total_returning_users"),
        rnd(total("spend"), 2).alias("spend_with_user_data"),
        F.when(new + back > 0, rnd(new / (new + back) * 100, 1)).alias("pct_new"),
    )


def misclassified_spend(facts: DataFrame) -> DataFrame:
    """All rows that mostly reach known users although their name does not say so."""
    pct = zero_if_null("pct_new_users")
    flag = F.concat(
        F.lit("Mostly returning users ("), fmt.decimals(pct, 0),
        F.lit("% new) — budget may be retargeting, not acquiring."),
    )
    named = contains_any(F.lower("campaign_name"), fx.RETARGETING_WORDS)
    return facts.where(F.col("new_users").isNotNull() & (pct < 20) & ~named).select(
        "client_id", "upload_id", "campaign_name", "platform", pct.alias("pct_new_users"), flag.alias("flag")
    )


def month_label(start: Column | str, end: Column | str, fallback: Column) -> Column:
    """``2026-01``, or ``2026-01 - 2026-03`` when the period spans months."""
    first, last = F.date_format(col(start), "yyyy-MM"), F.date_format(col(end), "yyyy-MM")
    spans = last.isNotNull() & (first != last)
    return F.when(first.isNull(), fallback).when(spans, F.concat_ws(" - ", first, last)).otherwise(first)


def upload_timeline(facts: DataFrame) -> DataFrame:
    keys = ["client_id", "upload_id", "period_label", "period_start", "period_end", "uploaded_on"]
    label = month_label(
        "period_start", "period_end", F.coalesce("period_label", F.date_format("uploaded_on", "yyyy-MM-dd"))
    )
    return facts.groupBy(*keys).agg(
        rnd(total("spend"), 2).alias("total_spend"), rnd(mean("roas"), 2).alias("avg_roas"),
        rnd(total("conversions")).alias("total_conversions"), rnd(mean("ctr"), 2).alias("avg_ctr"),
        rnd(total("wasted_spend"), 2).alias("total_wasted"), F.countDistinct("campaign_name").alias("campaign_count"),
    ).withColumn("label", label)


def campaign_timeline(facts: DataFrame) -> DataFrame:
    label = F.coalesce(F.date_format("period_start", "yyyy-MM"), F.date_format("uploaded_on", "yyyy-MM-dd"))
    return facts.select(
        "client_id", "campaign_name", "platform", "upload_id", label.alias("label"), "period_label",
        *_tidy("spend", "roas", "cac", "ctr", "conversions"), "severity",
    )


def trend_points(facts: DataFrame, funnel: DataFrame) -> DataFrame:
    """Per-upload sparkline points; means skip zeros, cost per lead comes from funnel rows."""

    def nonzero_mean(column: str) -> Column:
        return F.coalesce(mean(present(column)), F.lit(0.0))

    points = facts.groupBy("client_id", "upload_id", "period_label", "period_start", "uploaded_on").agg(
        rnd(total("spend"), 2).alias("spend"), rnd(nonzero_mean("roas"), 2).alias("roas"),
        rnd(total("conversions")).alias("conversions"), rnd(nonzero_mean("ctr"), 2).alias("ctr"),
        rnd(nonzero_mean("cac"), 2).alias("cac"),
    )
    leads = funnel.groupBy("upload_id").agg(rnd(mean(present("cost_per_lead")), 2).alias("cpl"))
    label = F.coalesce(
        F.date_format("period_start", "yyyy-MM"), F.col("period_label"), F.date_format("uploaded_on", "yyyy-MM-dd")
    )
    return points.join(leads, "upload_id", "left").select(
        "client_id", "upload_id", label.alias("date"), "period_label", "spend", "roas", "conversions", "ctr", "cac", "cpl"
    )


def top_spenders(facts: DataFrame, limit: int = 8) -> DataFrame:
    spend = facts.groupBy("client_id", "campaign_name").agg(total("spend").alias("spend"))
    return ranked_within(spend, ["client_id"], [F.desc("spend"), F.asc("campaign_name")], limit).select(
        "client_id", "position", "campaign_name", rnd("spend", 2).alias("spend")
    )


def period_pivot(facts: DataFrame, ranks: list[int]) -> DataFrame:
    """Uploads side by side per campaign; ``ranks`` count back from the latest (0)."""
    chosen = facts.withColumn("back", (F.col("upload_count") - F.col("upload_rank")).cast("int")).where(
        F.col("back").isin(ranks)
    )
    metrics = ["spend", "roas", "cac", "ctr", "conversions", "severity"]
    wide = chosen.groupBy("client_id", "campaign_name", "platform").pivot("back", ranks).agg(
        *[F.first(c).alias(c) for c in metrics]
    )
    renamed = [
        (F.col(f"`{r}_{m}`") if m == "severity" else rnd(f"`{r}_{m}`", 2)).alias(f"p{r}_{m}")
        for r in ranks for m in metrics
    ]
    return wide.select("client_id", "campaign_name", "platform", *renamed)
