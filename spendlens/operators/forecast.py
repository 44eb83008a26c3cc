"""Projections from weighted recent periods, trend and seasonality."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions.guards import ratio, rnd, total, zero_if_null
from spendlens.operators import history

POINTS = len(fx.WMA_WEIGHTS)


def _weight() -> Column:
    """Weight of a row by its distance from the newest one (``age`` 0)."""
    weights = F.array(*[F.lit(w) for w in fx.WMA_WEIGHTS])
    return F.get(weights, F.lit(POINTS - 1) - F.col("age"))


def weighted_mean(value: Column | str) -> Column:
    value = zero_if_null(value)
    return ratio(total(value * F.col("weight")), F.sum("weight"))


def slope(value: str) -> Column:
    """Average change per period: last minus first over the number of steps."""
    oldest, newest = F.max_by(zero_if_null(value), "age"), F.min_by(zero_if_null(value), "age")
    steps = F.count(F.lit(1)) - 1
    return F.when(steps > 0, (newest - oldest) / steps).otherwise(F.lit(0.0))


def direction(change: Column, latest: Column, points: Column) -> Column:
    pct = change / F.coalesce(F.nullif(latest, F.lit(0.0)), F.lit(1.0)) * 100
    return F.when(points < 2, "flat").when(pct > 3, "up").when(pct < -3, "down").otherwise("flat")


def latest_points(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest twelve rows per key with their age and weight."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    aged = df.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= POINTS)
    return aged.withColumn("age", F.col("position") - 1).drop("position").withColumn("weight", _weight())


def period_totals(facts: DataFrame) -> DataFrame:
    keys = ["client_id", "upload_id", "period_label", "period_start", "period_end", "period_date"]
    sums = facts.groupBy(*keys).agg(
        total("spend").alias("spend"), total("conversions").alias("conversions"), total("conversion_value").alias("revenue")
    )
    return sums.withColumn("roas", ratio("revenue", "spend"))


def season_factor(facts: DataFrame, month: int) -> DataFrame:
    """Latest spend of the target month against the mean month, per client; 1 without history."""
    monthly = facts.groupBy(
        "client_id", F.year("period_date").alias("year"), F.month("period_date").alias("month")
    ).agg(total("spend").alias("spend"))
    target = F.col("month") == month
    paid = F.when(F.col("spend") > 0, F.col("spend"))
    stats = monthly.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("months"),
        F.max_by(F.when(target, zero_if_null("spend")), F.when(target, F.col("year"))).alias("same_month"),
        ratio(total(paid), F.count(paid), None).alias("average"),
    )
    factor = F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("same_month") / F.col("average")))
    usable = (F.col("months") >= 6) & F.col("same_month").isNotNull() & F.col("average").isNotNull()
    return stats.select("client_id", F.when(usable, factor).otherwise(F.lit(1.0)).alias("season_factor"))


def average_period_days(points: DataFrame) -> DataFrame:
    """Mean period length from start and end, else mean gap between starts, else 30 days."""
    spans = F.when(F.col("period_end") > F.col("period_start"), F.datediff("period_end", "period_start"))
    first, last = F.min("period_date"), F.max("period_date")
    gap = F.nullif(F.datediff(last, first), F.lit(0)) / (F.count("period_date") - 1)
    return points.groupBy("client_id").agg(
        F.coalesce(
            ratio(F.sum(spans), F.count(spans), None),
            F.when(F.count("period_date") > 1, gap),
            F.lit(fx.DEFAULT_PERIOD_DAYS),
        ).alias("avg_period_days")
    )


def account_forecast(facts: DataFrame, as_of: date, horizon_days: int = 30) -> DataFrame:
    """One projection per client from its latest twelve periods."""
    points = latest_points(period_totals(facts), ["client_id"], ["period_date", "upload_id"])
    measures = ("spend", "revenue", "roas", "conversions")
    stats = points.groupBy("client_id").agg(
        *[weighted_mean(m).alias(f"base_{m}") for m in measures],
        *[slope(m).alias(f"slope_{m}") for m in ("spend", "revenue", "roas")],
        *[F.min_by(zero_if_null(m), "age").alias(f"last_{m}") for m in ("spend", "roas")],
        F.count(F.lit(1)).alias("periods_used"),
    )
    joined = stats.join(average_period_days(points), "client_id").join(season_factor(facts, as_of.month), "client_id")
    scale = F.lit(float(horizon_days)) / F.col("avg_period_days")

    def project(base: Column) -> Column:
        return F.greatest(F.lit(0.0), base * scale * F.col("season_factor"))

    projected = joined.withColumns(
        {
            "spend": project(F.col("base_spend") + F.col("slope_spend")),
            "revenue": project(F.col("base_revenue") + F.col("slope_revenue")),
            "conversions": project(F.col("base_conversions")),
        }
    )
    return projected.select(
        "client_id", F.lit(horizon_days).cast("long").alias("horizon_days"),
        rnd("spend").alias("proj_spend"), rnd("revenue").alias("proj_revenue"),
        rnd(F.when(F.col("spend") != 0, F.col("revenue") / F.col("spend")).otherwise(F.col("base_roas")), 2).alias("proj_roas"),
        rnd("conversions").alias("proj_conversions"),
        direction(F.col("slope_spend"), F.col("last_spend"), F.col("periods_used")).alias("spend_trend"),
        direction(F.col("slope_roas"), F.col("last_roas"), F.col("periods_used")).alias("roas_trend"),
        rnd("season_factor", 2).alias("season_factor"), "periods_used", rnd("avg_period_days").alias("avg_period_days"),
    )


def campaign_forecast(facts: DataFrame, as_of: date, horizon_days: int = 30) -> DataFrame:
    """One projection per campaign and platform; scale and season are the client's."""
    points = latest_points(facts, history.CAMPAIGN, ["period_date", "upload_id"])
    stats = points.groupBy(*history.CAMPAIGN).agg(
        *[weighted_mean(m).alias(f"base_{m}") for m in ("spend", "roas", "cac")],
        slope("spend").alias("slope_spend"), F.min_by(zero_if_null("spend"), "age").alias("last_spend"),
        F.count(F.lit(1)).alias("periods_used"),
    )
    account = latest_points(period_totals(facts), ["client_id"], ["period_date", "upload_id"])
    scaled = stats.join(average_period_days(account), "client_id").join(season_factor(facts, as_of.month), "client_id")
    spend = F.greatest(
        F.lit(0.0),
        (F.col("base_spend") + F.col("slope_spend")) * (F.lit(float(horizon_days)) / F.col("avg_period_days"))
        * F.col("season_factor"),
    )
    return scaled.select(
        *history.CAMPAIGN, rnd(spend).alias("proj_spend"), rnd("base_roas", 2).alias("proj_roas"),
        rnd("base_cac").alias("proj_cpa"),
        direction(F.col("slope_spend"), F.col("last_spend"), F.col("periods_used")).alias("trend"), "periods_used",
    )


def history_chart(facts: DataFrame) -> DataFrame:
    points = latest_points(period_totals(facts), ["client_id"], ["period_date", "upload_id"])
    label = F.coalesce("period_label", F.col("period_start").cast("string"), F.lit(""))
    return points.select(
        "client_id", "upload_id", label.alias("label"), rnd("spend").alias("spend"), rnd("revenue").alias("revenue"),
        rnd("roas", 2).alias("roas"),
    )
