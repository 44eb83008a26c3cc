"""Forecast queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from spendlens.operators import forecast
from spendlens.plans.registry import query
from spendlens.session import stored
from spendlens.sources import model

AS_OF = date(2001, 7, 15)
WEIGHTS = "[1,1,2,2,3,3,4,4,5,5,6,7]"


def _wma(x: str) -> str:
    return f"SUM4(coalesce({x}, 0) * weight) / sum(weight)"


def _slope(x: str) -> str:
    return (f"CASE WHEN count(*) > 1 THEN (arg_min({x}, age) - arg_max({x}, age)) / (count(*) - 1) ELSE 0 END")


def _direction(slope: str, last: str) -> str:
    pct = f"{slope} / coalesce(nullif({last}, 0), 1) * 100"
    return f"CASE WHEN periods_used < 2 THEN 'flat' WHEN {pct} > 3 THEN 'up' WHEN {pct} < -3 THEN 'down' ELSE 'flat' END"


BASE = f"""
totals AS (SELECT *, CASE WHEN spend <> 0 THEN revenue / spend ELSE 0 END AS roas FROM (
  SELECT client_id, upload_id, period_label, period_start, period_end, period_date, SUM4(spend) AS spend,
    SUM4(conversions) AS conversions, SUM4(conversion_value) AS revenue FROM campaigns GROUP BY ALL)),
points AS (SELECT *, {WEIGHTS}[12 - age] AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY period_date DESC, upload_id DESC) - 1 AS age FROM totals)
  WHERE age < 12),
days AS (SELECT client_id, coalesce(
    CAST(sum(period_end - period_start) FILTER (WHERE period_end > period_start) AS DOUBLE)
      / nullif(count(*) FILTER (WHERE period_end > period_start), 0),
    CASE WHEN count(*) > 1 THEN nullif(CAST(max(period_date) - min(period_date) AS DOUBLE), 0) / (count(*) - 1) END, 30) AS avg_days
  FROM points GROUP BY client_id),
months AS (SELECT client_id, year(period_date) AS y, month(period_date) AS m, SUM4(spend) AS spend FROM campaigns GROUP BY ALL),
season AS (SELECT client_id, CASE WHEN n >= 6 AND same IS NOT NULL AND average IS NOT NULL
    THEN greatest(0.5::DOUBLE, least(2.0::DOUBLE, same / average)) ELSE 1 END AS factor FROM (
  SELECT client_id, count(*) AS n, arg_max(spend, y) FILTER (WHERE m = {AS_OF.month}) AS same,
    SUM4(CASE WHEN spend > 0 THEN spend END) / count(CASE WHEN spend > 0 THEN spend END) AS average FROM months GROUP BY client_id))
"""


@query("account_forecast", f"""
WITH {BASE}, s AS (SELECT client_id, {_wma('spend')} AS b_spend, {_wma('revenue')} AS b_revenue, {_wma('roas')} AS b_roas,
    {_wma('conversions')} AS b_conv, {_slope('spend')} AS d_spend, {_slope('revenue')} AS d_revenue, {_slope('roas')} AS d_roas,
    arg_min(spend, age) AS l_spend, arg_min(roas, age) AS l_roas, count(*) AS periods_used FROM points GROUP BY client_id),
p AS (SELECT *, greatest(0, (b_spend + d_spend) * (30::DOUBLE / avg_days) * factor) AS spend,
    greatest(0, (b_revenue + d_revenue) * (30::DOUBLE / avg_days) * factor) AS revenue,
    greatest(0, b_conv * (30::DOUBLE / avg_days) * factor) AS conv FROM s JOIN days USING (client_id) JOIN season USING (client_id))
SELECT client_id, CAST(30 AS BIGINT) AS horizon_days, round(spend) AS proj_spend, round(revenue) AS proj_revenue,
  round(CASE WHEN spend <> 0 THEN revenue / spend ELSE b_roas END, 2) AS proj_roas, round(conv) AS proj_conversions,
  {_direction('d_spend', 'l_spend')} AS spend_trend, {_direction('d_roas', 'l_roas')} AS roas_trend,
  round(factor, 2) AS season_factor, periods_used, round(avg_days) AS avg_period_days FROM p""")
def account_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.account_forecast(stored(model.campaigns(spark, sf)), AS_OF)


@query("campaign_forecast", f"""
WITH {BASE}, c AS (SELECT *, {WEIGHTS}[12 - age] AS weight FROM (
    SELECT *, row_number() OVER (PARTITION BY client_id, platform, campaign_name ORDER BY period_date DESC, upload_id DESC) - 1 AS age
    FROM campaigns) WHERE age < 12),
s AS (SELECT client_id, platform, campaign_name, {_wma('spend')} AS b_spend, {_wma('roas')} AS b_roas, {_wma('cac')} AS b_cac,
    {_slope('spend')} AS d_spend, arg_min(spend, age) AS l_spend, count(*) AS periods_used FROM c GROUP BY ALL)
SELECT client_id, platform, campaign_name,
  round(greatest(0, (b_spend + d_spend) * (30::DOUBLE / avg_days) * factor)) AS proj_spend, round(b_roas, 2) AS proj_roas,
  round(b_cac) AS proj_cpa, {_direction('d_spend', 'l_spend')} AS trend, periods_used
FROM s JOIN days USING (client_id) JOIN season USING (client_id)""")
def campaign_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.campaign_forecast(stored(model.campaigns(spark, sf)), AS_OF)


@query("forecast_history", f"""
WITH {BASE} SELECT client_id, upload_id, coalesce(period_label, CAST(period_start AS VARCHAR), '') AS label,
  round(spend) AS spend, round(revenue) AS revenue, round(roas, 2) AS roas FROM points""")
def forecast_history(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.history_chart(model.campaigns(spark, sf))


@query("season_factor", f"WITH {BASE} SELECT client_id, round(factor, 4) AS season_factor FROM season")
def season_factor(spark: SparkSession, sf: str) -> DataFrame:
    factors = forecast.season_factor(model.campaigns(spark, sf), AS_OF.month)
    return factors.withColumn("season_factor", forecast.rnd("season_factor", 4))
