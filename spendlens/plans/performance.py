"""Campaign metrics, summaries and comparisons over the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions import formatting as fmt
from spendlens.functions.guards import rnd
from spendlens.operators import history, metrics
from spendlens.plans.registry import query
from spendlens.sources import model

SUMMARY_COLUMNS = """
  round(SUM4(spend), 2) AS total_spend, round(SUM4(conversion_value), 2) AS total_revenue,
  round(CASE WHEN SUM4(spend) <> 0 THEN SUM4(conversion_value) / SUM4(spend) ELSE 0 END, 2) AS overall_roas,
  round(SUM4(conversions)) AS total_conversions,
  round(CASE WHEN SUM4(conversions) <> 0 THEN SUM4(spend) / SUM4(conversions) ELSE 0 END, 2) AS overall_cac,
  round(AVG4(ctr), 2) AS overall_ctr, round(SUM4(wasted_spend), 2) AS wasted_spend, count(*) AS campaign_count,
  count(*) FILTER (WHERE severity = 'critical') AS critical_count,
  count(*) FILTER (WHERE severity = 'warning') AS warning_count,
  count(*) FILTER (WHERE severity = 'ok') AS ok_count
"""


@query("platform_summary", f"SELECT client_id, platform, {SUMMARY_COLUMNS} FROM campaigns GROUP BY client_id, platform")
def platform_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.platform_summary(model.campaigns(spark, sf), ["client_id"])


@query("account_rollup", f"""
SELECT CASE GROUPING(client_id, platform, campaign_name) WHEN 7 THEN 'all' WHEN 3 THEN 'client' WHEN 1 THEN 'platform' ELSE 'campaign' END AS level,
  client_id, platform, campaign_name, {SUMMARY_COLUMNS}
FROM campaigns GROUP BY ROLLUP (client_id, platform, campaign_name)""")
def account_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.account_rollup(model.campaigns(spark, sf))


@query("upload_platform_summary",
       f"SELECT client_id, upload_id, platform, {SUMMARY_COLUMNS} FROM campaigns GROUP BY client_id, upload_id, platform")
def upload_platform_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.platform_summary(model.campaigns(spark, sf), ["client_id", "upload_id"])


@query("rebuilt_summary", f"""
SELECT * EXCLUDE (mean_roas) REPLACE (CASE WHEN platform = 'google' THEN total_revenue END AS total_revenue,
                  CASE WHEN platform = 'google' THEN overall_roas ELSE mean_roas END AS overall_roas)
FROM (SELECT client_id, upload_id, platform, {SUMMARY_COLUMNS}, round(AVG4(roas), 2) AS mean_roas
      FROM campaigns GROUP BY client_id, upload_id, platform)""")
def rebuilt_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rebuilt_summary(model.campaigns(spark, sf), ["client_id", "upload_id"])


@query("campaign_metrics", """
SELECT client_id, upload_id, platform, campaign_name, spend, conversion_value, conversions, roas, cac, ctr, cpc,
  efficiency, severity, wasted_spend, reach, frequency, impressions < 1000 AND conversions < 10 AS learning_phase
FROM campaigns""")
def campaign_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return model.campaigns(spark, sf).select(
        "client_id", "upload_id", "platform", "campaign_name", "spend", "conversion_value", "conversions", "roas",
        "cac", "ctr", "cpc", "efficiency", "severity", "wasted_spend", "reach", "frequency",
        metrics.learning_phase("impressions", "conversions").alias("learning_phase"),
    )


@query("event_campaign_metrics", """
SELECT client_id, platform, campaign_name, period, spend,
  round(CASE WHEN spend <> 0 THEN conversion_value / spend ELSE 0 END, 2) AS roas,
  round(CASE WHEN conversions <> 0 THEN spend / conversions ELSE 0 END, 2) AS cac,
  CASE WHEN (CASE WHEN spend <> 0 THEN conversion_value / spend ELSE 0 END) < 1 THEN 'critical'
       WHEN (CASE WHEN spend <> 0 THEN conversion_value / spend ELSE 0 END) < 2 THEN 'warning' ELSE 'ok' END AS severity,
  sessions, users, new_users
FROM event_facts""")
def event_campaign_metrics(spark: SparkSession, sf: str) -> DataFrame:
    roas = metrics.ratio("conversion_value", "spend")
    return model.event_facts(spark, sf).select(
        "client_id", "platform", "campaign_name", "period", "spend", rnd(roas, 2).alias("roas"),
        rnd(metrics.ratio("spend", "conversions"), 2).alias("cac"), metrics.severity_of(roas).alias("severity"),
        "sessions", "users", "new_users",
    )


@query("cross_platform", f"""
WITH s AS (SELECT client_id, upload_id, platform, {SUMMARY_COLUMNS} FROM campaigns GROUP BY client_id, upload_id, platform)
SELECT client_id, upload_id, g.total_spend AS google_spend, m.total_spend AS meta_spend, g.overall_roas AS google_roas,
  m.overall_roas AS meta_roas, g.overall_cac AS google_cac, m.overall_cac AS meta_cac, g.wasted_spend AS google_wasted,
  m.wasted_spend AS meta_wasted, CASE WHEN g.overall_roas >= m.overall_roas THEN 'google' ELSE 'meta' END AS better_platform,
  round(g.total_spend + m.total_spend, 2) AS total_spend, round(g.wasted_spend + m.wasted_spend, 2) AS total_wasted
FROM (SELECT * FROM s WHERE platform = 'google') g JOIN (SELECT * FROM s WHERE platform = 'meta') m USING (client_id, upload_id)""")
def cross_platform(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["client_id", "upload_id"]
    return metrics.cross_platform(metrics.platform_summary(model.campaigns(spark, sf), keys), keys)


def _delta_sql(column: str, name: str) -> str:
    pct = f"round((c.{column} - p.{column}) / nullif(p.{column}, 0) * 100, 1)"
    return f"""CASE WHEN p.{column} = 0 THEN c.{column} ELSE round(c.{column} - p.{column}, 2) END AS {name}_change,
      coalesce(abs({pct}), 0) AS {name}_pct,
      CASE WHEN {pct} > 0 THEN 'up' WHEN {pct} < 0 THEN 'down' ELSE 'flat' END AS {name}_direction"""


@query("period_comparison", f"""
WITH s AS (SELECT client_id, upload_rank, platform, {SUMMARY_COLUMNS} FROM campaigns GROUP BY client_id, upload_rank, platform)
SELECT client_id, upload_rank, platform, {_delta_sql('total_spend', 'spend')}, {_delta_sql('overall_roas', 'roas')},
  {_delta_sql('overall_cac', 'cac')}, {_delta_sql('total_conversions', 'conversions')}
FROM s c JOIN (SELECT * REPLACE (upload_rank + 1 AS upload_rank) FROM s) p USING (client_id, upload_rank, platform)""")
def period_comparison(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["client_id", "upload_rank"]
    current = metrics.platform_summary(history.ranked_campaigns(spark, sf), keys)
    previous = current.withColumn("upload_rank", F.col("upload_rank") + 1)
    compared = metrics.period_comparison(current, previous, keys)
    measures = ("spend", "roas", "cac", "conversions")
    return compared.select(
        *keys, "platform",
        *[F.col(f"{m}.value").alias(f"{m}_change") for m in measures],
        *[F.col(f"{m}.pct").alias(f"{m}_pct") for m in measures],
        *[F.col(f"{m}.direction").alias(f"{m}_direction") for m in measures],
    )


@query("roas_trend", """
SELECT c.client_id, c.upload_id, c.platform, c.campaign_name, c.roas, p.roas AS prior_roas,
  CASE WHEN p.roas IS NULL OR p.roas = 0 THEN 'unknown'
       WHEN (c.roas - p.roas) / p.roas > 0.05 THEN 'improving'
       WHEN (c.roas - p.roas) / p.roas < -0.05 THEN 'declining' ELSE 'stable' END AS trend
FROM campaigns c LEFT JOIN campaigns p
  ON p.client_id = c.client_id AND p.platform = c.platform AND p.campaign_name = c.campaign_name
 AND p.upload_rank = c.upload_rank - 1""")
def roas_trend(spark: SparkSession, sf: str) -> DataFrame:
    facts = history.with_prior(history.ranked_campaigns(spark, sf), ["roas"])
    return facts.select(
        "client_id", "upload_id", "platform", "campaign_name", "roas", "prior_roas",
        metrics.trend_of("roas", "prior_roas").alias("trend"),
    )


@query("number_formats", r"""
SELECT client_id, upload_id, platform, campaign_name,
  CASE WHEN spend = 0 THEN 'Rs 0' WHEN length(w) > 3
       THEN 'Rs ' || regexp_replace(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(\d{2})', '\1,', 'g')), '^,', '')
            || ',' || right(w, 3)
       ELSE 'Rs ' || w END AS spend_text,
  printf('%.2f', roas) || 'x' AS roas_text, printf('%.1f', round(ctr, 1)) || '%' AS ctr_text
FROM (SELECT *, CAST(CAST(floor(spend) AS BIGINT) AS VARCHAR) AS w FROM campaigns)""")
def number_formats(spark: SparkSession, sf: str) -> DataFrame:
    return model.campaigns(spark, sf).select(
        "client_id", "upload_id", "platform", "campaign_name",
        fmt.rupees("spend").alias("spend_text"), fmt.times("roas").alias("roas_text"),
        fmt.percent("ctr").alias("ctr_text"),
    )
