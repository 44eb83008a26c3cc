"""Dashboard, timeline and comparison queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.guards import mean, ratio, rnd, total
from spendlens.operators import dashboard, history
from spendlens.plans.registry import query
from spendlens.session import stored
from spendlens.sources import model, sinks

AS_OF = date(2001, 7, 15)

VOLUME = """SUM4(spend) AS spend, SUM4(conversions) AS conversions, SUM4(conversion_value) AS revenue,
  AVG4(ctr) AS ctr, AVG4(cpc) AS cpc"""
ROAS = "round(CASE WHEN spend <> 0 THEN revenue / spend ELSE 0 END, 2) AS roas"


def _change(column: str, name: str) -> str:
    return f"round(({column} - nullif(prior_{column}, 0)) / abs(nullif(prior_{column}, 0)) * 100, 1) AS {name}_delta"


@query("dashboard_kpis", f"""
WITH r AS (SELECT * FROM (VALUES ('7', 7), ('30', 30), ('90', 90), ('all', NULL)) t(date_range, days)),
m AS (SELECT c.*, date_range,
    days IS NULL OR period_date >= DATE '{AS_OF}' - days AS is_now
  FROM campaigns c, r
  WHERE days IS NULL OR period_date >= DATE '{AS_OF}' - 2 * days),
g AS (SELECT client_id, date_range,
    SUM4(CASE WHEN is_now THEN spend END) AS s0, SUM4(CASE WHEN NOT is_now THEN spend END) AS prior_spend,
    SUM4(CASE WHEN is_now THEN conversions END) AS c0, SUM4(CASE WHEN NOT is_now THEN conversions END) AS prior_conversions,
    SUM4(CASE WHEN is_now THEN conversion_value END) AS v0, SUM4(CASE WHEN NOT is_now THEN conversion_value END) AS prior_revenue,
    AVG4(CASE WHEN is_now THEN ctr END) AS ctr0, AVG4(CASE WHEN is_now THEN cpc END) AS cpc0,
    count(DISTINCT CASE WHEN is_now THEN campaign_name END) AS campaign_count,
    count(DISTINCT CASE WHEN is_now THEN upload_id END) AS upload_count
  FROM m GROUP BY ALL),
k AS (SELECT *, coalesce(s0, 0) AS spend, coalesce(c0, 0) AS conversions, coalesce(v0, 0) AS revenue,
    CASE WHEN s0 > 0 THEN v0 / s0 ELSE 0 END AS roas, CASE WHEN c0 > 0 THEN s0 / c0 ELSE 0 END AS cost,
    CASE WHEN prior_spend > 0 THEN prior_revenue / prior_spend WHEN prior_spend IS NOT NULL THEN 0 END AS prior_roas,
    CASE WHEN prior_conversions > 0 THEN prior_spend / prior_conversions WHEN prior_spend IS NOT NULL THEN 0 END AS prior_cost
  FROM g)
SELECT client_id, date_range, round(spend, 2) AS total_spend, round(conversions, 2) AS total_conversions,
  round(revenue, 2) AS total_revenue, round(roas, 2) AS blended_roas, round(cost, 2) AS cpa,
  round(coalesce(ctr0, 0), 2) AS avg_ctr, round(coalesce(cpc0, 0), 2) AS avg_cpc, campaign_count, upload_count,
  round(CASE WHEN spend <> 0 THEN revenue / spend ELSE 0 END, 2) AS mer,
  {_change('spend', 'spend')}, {_change('revenue', 'revenue')}, {_change('conversions', 'conversions')},
  {_change('roas', 'roas')}, {_change('cost', 'cpa')},
  round(revenue - spend, 2) AS gross_profit,
  CASE WHEN round(revenue, 2) > 0 THEN round(round(revenue - spend, 2) / round(revenue, 2) * 100, 1) ELSE 0 END AS gross_margin_pct
FROM k""")
def dashboard_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.kpi_summary(model.campaigns(spark, sf), AS_OF)


@query("upload_trend", f"""
SELECT client_id, upload_id, coalesce(period_label, CAST(period_date AS VARCHAR)) AS label, period_date,
  round(spend, 2) AS spend, round(revenue, 2) AS revenue, round(conversions, 2) AS conversions, {ROAS}
FROM (SELECT client_id, upload_id, period_label, period_date, {VOLUME} FROM campaigns GROUP BY ALL)""")
def upload_trend(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.upload_trend(model.campaigns(spark, sf))


@query("channel_split", f"""
SELECT client_id, platform, round(spend, 2) AS spend, round(conversions, 2) AS conversions, round(revenue, 2) AS revenue,
  {ROAS}, round(ctr, 2) AS avg_ctr, round(cpc, 2) AS avg_cpc
FROM (SELECT client_id, platform, {VOLUME} FROM campaigns GROUP BY ALL)""")
def channel_split(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.channel_split(model.campaigns(spark, sf))


@query("top_campaigns", f"""
SELECT client_id, position, campaign_name, platform, round(spend, 2) AS spend, round(conversions, 2) AS conversions,
  round(revenue, 2) AS revenue, {ROAS},
  round(CASE WHEN conversions <> 0 THEN spend / conversions ELSE 0 END, 2) AS cpa, round(ctr, 2) AS ctr
FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY spend DESC, campaign_name, platform) AS position
      FROM (SELECT client_id, campaign_name, platform, {VOLUME} FROM campaigns GROUP BY ALL))
WHERE position <= 10""")
def top_campaigns(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.top_campaigns(model.campaigns(spark, sf))


@query("funnel_totals", """
SELECT client_id, SUM4(leads) AS total_leads, SUM4(mqls) AS total_mqls, SUM4(sqls) AS total_sqls,
  SUM4(customers) AS total_customers, round(AVG4(cost_per_lead), 2) AS avg_cpl, round(AVG4(cost_per_customer), 2) AS avg_cac
FROM funnel_data GROUP BY client_id""")
def funnel_totals(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.funnel_totals(model.funnel_data(model.campaigns(spark, sf)))


REACHED = """r AS (SELECT client_id, campaign_name, round(SUM4(spend), 2) AS spend, round(SUM4(reach), 2) AS reach,
    AVG4(frequency) AS frequency, SUM4(conversions) AS conversions,
    CASE WHEN SUM4(reach) > 0 THEN SUM4(impressions) / SUM4(reach) END AS calc_frequency
  FROM campaigns WHERE platform = 'meta' AND reach IS NOT NULL GROUP BY ALL)"""


@query("reach_frequency", f"""
WITH {REACHED} SELECT client_id, campaign_name, spend, reach, round(frequency, 2) AS frequency, conversions,
  round(calc_frequency, 2) AS calc_frequency FROM r""")
def reach_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.reach_and_frequency(model.campaigns(spark, sf)).select(
        "client_id", "campaign_name", "spend", "reach", rnd("frequency", 2).alias("frequency"), "conversions",
        rnd("calc_frequency", 2).alias("calc_frequency"),
    )


@query("frequency_fatigue", f"""
WITH {REACHED}, f AS (SELECT *, coalesce(nullif(frequency, 0), nullif(calc_frequency, 0)) AS seen FROM r)
SELECT client_id, campaign_name, round(seen, 2) AS frequency,
  'Refresh creative or pause — audience has seen this ad ' || printf('%.1f', round(seen, 1)) || 'x on average.' AS action
FROM f WHERE coalesce(seen, 0) >= 3.0""")
def frequency_fatigue(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.frequency_fatigue(model.campaigns(spark, sf))


SPLIT = """u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id
      ORDER BY spend DESC, campaign_name, platform, upload_id) AS position FROM campaigns WHERE new_users IS NOT NULL)
  WHERE position <= 15)"""


@query("user_split", f"""
WITH {SPLIT} SELECT client_id, position, upload_id, campaign_name, platform, spend, new_users, returning_users,
  pct_new_users, cost_per_new_user FROM u""")
def user_split(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.user_split(model.campaigns(spark, sf))


@query("user_totals", """
SELECT client_id, SUM4(new_users) AS total_new_users, SUM4(returning_users) AS total_returning_users,
  round(SUM4(spend), 2) AS spend_with_user_data,
  CASE WHEN SUM4(new_users) + SUM4(returning_users) > 0
       THEN round(SUM4(new_users) / (SUM4(new_users) + SUM4(returning_users)) * 100, 1) END AS pct_new
FROM campaigns WHERE new_users IS NOT NULL GROUP BY client_id""")
def user_totals(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.user_totals(model.campaigns(spark, sf))


@query("misclassified_spend", f"""
SELECT client_id, upload_id, campaign_name, platform, coalesce(pct_new_users, 0) AS pct_new_users,
  'Mostly returning users (' || printf('%.0f', round(coalesce(pct_new_users, 0)))
    || '% new) — budget may be retargeting, not acquiring.' AS flag
FROM campaigns WHERE new_users IS NOT NULL AND coalesce(pct_new_users, 0) < 20
  AND NOT regexp_matches(lower(campaign_name), 'retarget|remarketing|cart|abandon|returning|existing')""")
def misclassified_spend(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.misclassified_spend(model.campaigns(spark, sf))


@query("upload_timeline", """
SELECT client_id, upload_id, period_label, period_start, period_end, uploaded_on,
  round(SUM4(spend), 2) AS total_spend, round(AVG4(roas), 2) AS avg_roas, round(SUM4(conversions)) AS total_conversions,
  round(AVG4(ctr), 2) AS avg_ctr, round(SUM4(wasted_spend), 2) AS total_wasted, count(DISTINCT campaign_name) AS campaign_count,
  CASE WHEN period_start IS NULL THEN coalesce(period_label, strftime(uploaded_on, '%Y-%m-%d'))
       WHEN strftime(period_start, '%Y-%m') <> strftime(period_end, '%Y-%m')
         THEN strftime(period_start, '%Y-%m') || ' - ' || strftime(period_end, '%Y-%m')
       ELSE strftime(period_start, '%Y-%m') END AS label
FROM campaigns GROUP BY client_id, upload_id, period_label, period_start, period_end, uploaded_on""")
def upload_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.upload_timeline(model.campaigns(spark, sf))


@query("campaign_timeline", """
SELECT client_id, campaign_name, platform, upload_id,
  coalesce(strftime(period_start, '%Y-%m'), strftime(uploaded_on, '%Y-%m-%d')) AS label, period_label,
  round(spend, 2) AS spend, roas, cac, ctr, conversions, severity FROM campaigns""")
def campaign_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.campaign_timeline(model.campaigns(spark, sf))


@query("trend_points", """
WITH p AS (SELECT client_id, upload_id, period_label, period_start, uploaded_on, round(SUM4(spend), 2) AS spend,
    round(coalesce(AVG4(nullif(roas, 0)), 0), 2) AS roas, round(SUM4(conversions)) AS conversions,
    round(coalesce(AVG4(nullif(ctr, 0)), 0), 2) AS ctr, round(coalesce(AVG4(nullif(cac, 0)), 0), 2) AS cac
  FROM campaigns GROUP BY ALL),
l AS (SELECT upload_id, round(AVG4(nullif(cost_per_lead, 0)), 2) AS cpl FROM funnel_data GROUP BY upload_id)
SELECT client_id, upload_id, coalesce(strftime(period_start, '%Y-%m'), period_label, strftime(uploaded_on, '%Y-%m-%d')) AS date,
  period_label, spend, roas, conversions, ctr, cac, cpl
FROM p LEFT JOIN l USING (upload_id)""")
def trend_points(spark: SparkSession, sf: str) -> DataFrame:
    facts = stored(model.campaigns(spark, sf))
    return dashboard.trend_points(facts, model.funnel_data(facts))


@query("top_spenders", """
SELECT client_id, position, campaign_name, round(spend, 2) AS spend FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY spend DESC, campaign_name) AS position
  FROM (SELECT client_id, campaign_name, SUM4(spend) AS spend FROM campaigns GROUP BY ALL)) WHERE position <= 8""")
def top_spenders(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.top_spenders(model.campaigns(spark, sf))


def _pivot_columns() -> str:
    return ", ".join(
        f"max({'severity' if m == 'severity' else f'round({m}, 2)'}) FILTER (WHERE back = {r}) AS p{r}_{m}"
        for r in range(4) for m in ("spend", "roas", "cac", "ctr", "conversions", "severity"))


@query("period_pivot", f"""
SELECT client_id, campaign_name, platform, {_pivot_columns()}
FROM (SELECT *, upload_count - upload_rank AS back FROM campaigns) WHERE back < 4
GROUP BY client_id, campaign_name, platform""")
def period_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return dashboard.period_pivot(history.ranked_campaigns(spark, sf), [0, 1, 2, 3])


@query("latest_upload_summary", """
SELECT client_id, upload_id, coalesce(period_label, CAST(period_start AS VARCHAR), 'recent') AS period,
  round(SUM4(spend), 2) AS total_spend, SUM4(conversions) AS total_conversions, round(SUM4(conversion_value), 2) AS total_revenue,
  round(CASE WHEN SUM4(spend) <> 0 THEN SUM4(conversion_value) / SUM4(spend) ELSE 0 END, 2) AS blended_roas,
  round(CASE WHEN SUM4(conversions) <> 0 THEN SUM4(spend) / SUM4(conversions) ELSE 0 END, 2) AS avg_cpa,
  round(AVG4(ctr), 2) AS avg_ctr, count(DISTINCT campaign_name) AS campaign_count
FROM campaigns WHERE upload_rank = upload_count GROUP BY client_id, upload_id, period_label, period_start""")
def latest_upload_summary(spark: SparkSession, sf: str) -> DataFrame:
    latest = history.latest_by(model.uploads(spark, sf), ["client_id"], ["uploaded_on", "upload_id"], ["upload_id"])
    facts = model.campaigns(spark, sf).join(latest, ["client_id", "upload_id"], "left_semi")
    period = F.coalesce("period_label", F.col("period_start").cast("string"), F.lit("recent"))
    return facts.groupBy("client_id", "upload_id", period.alias("period")).agg(
        rnd(total("spend"), 2).alias("total_spend"), total("conversions").alias("total_conversions"),
        rnd(total("conversion_value"), 2).alias("total_revenue"),
        rnd(ratio(total("conversion_value"), total("spend")), 2).alias("blended_roas"),
        rnd(ratio(total("spend"), total("conversions")), 2).alias("avg_cpa"),
        rnd(mean("ctr"), 2).alias("avg_ctr"), F.countDistinct("campaign_name").alias("campaign_count"),
    )


@query("recent_period_trend", """
SELECT client_id, upload_id, period_label, period_start, round(SUM4(spend), 2) AS spend,
  round(CASE WHEN SUM4(spend) <> 0 THEN SUM4(conversion_value) / SUM4(spend) ELSE 0 END, 2) AS roas,
  SUM4(conversions) AS conversions
FROM campaigns WHERE upload_rank > upload_count - 6 GROUP BY client_id, upload_id, period_label, period_start""")
def recent_period_trend(spark: SparkSession, sf: str) -> DataFrame:
    recent = history.campaign_history(model.campaigns(spark, sf), history.stored_uploads(spark, sf), 6)
    return recent.groupBy("client_id", "upload_id", "period_label", "period_start").agg(
        rnd(total("spend"), 2).alias("spend"),
        rnd(ratio(total("conversion_value"), total("spend")), 2).alias("roas"),
        total("conversions").alias("conversions"),
    )


@query("campaign_history", """
SELECT client_id, upload_id, platform, campaign_name, period_date, roas, cac, ctr, spend
FROM campaigns WHERE upload_rank > upload_count - 6""")
def campaign_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.campaign_history(model.campaigns(spark, sf), history.stored_uploads(spark, sf), 6).select(
        "client_id", "upload_id", "platform", "campaign_name", "period_date", "roas", "cac", "ctr", "spend"
    )


@query("export_campaigns", """
SELECT c.client_id, c.upload_id, platform, campaign_name AS campaign, round(spend, 2) AS spend,
  CAST(impressions AS BIGINT) AS impressions, CAST(clicks AS BIGINT) AS clicks, round(conversions, 1) AS conversions,
  round(conversion_value, 2) AS conversion_value, roas, cac, ctr, cpc, severity, round(wasted_spend, 2) AS wasted_spend,
  leads, mqls, sqls, customers, cost_per_lead, cost_per_mql, cost_per_customer
FROM campaigns c LEFT JOIN funnel_data f USING (upload_id, campaign_name)""")
def export_campaigns(spark: SparkSession, sf: str) -> DataFrame:
    facts = stored(model.campaigns(spark, sf))
    return sinks.export_rows(facts, model.funnel_data(facts))
