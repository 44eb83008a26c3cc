"""Web-analytics enrichment of campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions.guards import count_where, mean, present, ratio, rnd, total
from spendlens.operators import matching

MEASURES = ["sessions", "users", "new_users", "engaged_sessions", "bounce_rate", "avg_session_duration",
            "pages_per_session", "ga_conversions", "ga_revenue"]


def merge_traffic(campaigns: DataFrame, traffic: DataFrame, keys: list[str], order: str = "traffic_name") -> DataFrame:
    """Attach web metrics by name: equal names first, else containment of at least ten characters.

    A traffic name given twice keeps its first position but its last values.
    """
    pairs = matching.first_match(
        campaigns, traffic, keys, "campaign_name", "traffic_name", order, min_length=fx.WEB_MIN_CONTAINED
    ).withColumnsRenamed({"campaign_name": "name_key", "traffic_name": "traffic_key"})
    rows = traffic.withColumn("traffic_key", matching.name_key("traffic_name")).groupBy(*keys, "traffic_key").agg(
        F.max_by(F.struct(*MEASURES), order).alias("row")
    )
    known = pairs.join(rows, [*keys, "traffic_key"]).select(*keys, "name_key", "traffic_key", "row.*")
    joined = campaigns.withColumn("name_key", matching.name_key("campaign_name")).join(known, [*keys, "name_key"], "left")
    users, new = F.col("users"), F.col("new_users")
    spend = present("spend")
    return joined.drop("name_key").withColumns(
        {
            "returning_users": users - new,
            "pct_new_users": rnd(new / F.nullif(users, F.lit(0)) * 100, 1),
            "bounce_rate": rnd("bounce_rate", 1),
            "avg_session_duration": rnd("avg_session_duration", 1),
            "pages_per_session": rnd("pages_per_session", 2),
            "ga_revenue": rnd("ga_revenue", 2),
            "cost_per_session": rnd(spend / F.nullif(F.col("sessions"), F.lit(0)), 2),
            "cost_per_new_user": rnd(spend / F.nullif(new, F.lit(0)), 2),
        }
    )


def traffic_summary(enriched: DataFrame, keys: list[str]) -> DataFrame:
    """Totals over campaigns with sessions; the bounce rate is weighted by sessions."""
    sessions = F.nullif(F.col("sessions"), F.lit(0))
    weighted = F.when(F.col("bounce_rate").isNotNull(), sessions)
    grouped = enriched.groupBy(*keys).agg(
        F.sum(sessions).alias("total_sessions"),
        rnd(ratio(total(F.col("bounce_rate") * weighted), F.sum(weighted), None), 1).alias("avg_bounce_rate"),
        F.sum(F.nullif(F.col("ga_conversions"), F.lit(0))).alias("total_ga_conversions"),
        rnd(mean(present("cost_per_session")), 2).alias("avg_cost_per_session"),
        F.count(sessions).alias("campaigns_matched"),
    )
    return grouped.where(F.col("campaigns_matched") > 0)


def traffic_table(enriched: DataFrame) -> DataFrame:
    """Report rows of campaigns with sessions, with a band for the bounce rate."""
    band = F.when(F.col("bounce_rate") > 50, "high").when(F.col("bounce_rate") > 35, "mid").otherwise("low")
    return enriched.where(F.col("sessions") > 0).withColumn("bounce_band", band)


def traffic_table_totals(enriched: DataFrame, keys: list[str]) -> DataFrame:
    """Header of the report table: plain means, unlike the weighted summary."""
    return traffic_table(enriched).groupBy(*keys).agg(
        F.sum("sessions").alias("total_sessions"), rnd(mean("bounce_rate"), 1).alias("mean_bounce_rate"),
        rnd(mean("cost_per_session"), 2).alias("mean_cost_per_session"), F.count(F.lit(1)).alias("campaigns"),
        *[count_where(F.col("bounce_band") == b).alias(f"{b}_bounce") for b in ("high", "mid", "low")],
    )
