"""Funnel, web-traffic, name-matching and granular queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.guards import ratio, rnd, total
from spendlens.operators import funnel, granular, matching, webtraffic
from spendlens.plans.registry import query
from spendlens.plans.signals import _whole
from spendlens.session import stored
from spendlens.sources import model


def _brands(spark: SparkSession, sf: str) -> DataFrame:
    return model.campaigns(spark, sf).groupBy("client_id", "campaign_name").agg(total("spend").alias("spend"))


BRANDS = "brands AS (SELECT client_id, campaign_name, SUM4(spend) AS spend FROM campaigns GROUP BY ALL)"
NESTED = "(contains(lower(campaign_name), lower(funnel_name)) OR contains(lower(funnel_name), lower(campaign_name)))"
MERGED = f"""{BRANDS},
pick AS (SELECT b.client_id, campaign_name, arg_min(lower(funnel_name), (CASE WHEN lower(funnel_name) = lower(campaign_name) THEN 0 ELSE 1 END,
    funnel_name)) AS funnel_key
  FROM brands b JOIN crm_funnel f ON f.client_id = b.client_id AND {NESTED} GROUP BY ALL),
merged AS (SELECT b.*, funnel_key, leads, mqls, sqls, customers FROM brands b LEFT JOIN pick USING (client_id, campaign_name)
  LEFT JOIN crm_funnel f ON f.client_id = b.client_id AND lower(f.funnel_name) = funnel_key)"""


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    campaigns = stored(_brands(spark, sf))
    rows = stored(model.crm_funnel(spark, sf))
    return funnel.merge_by_campaign(campaigns, rows, ["client_id"])


RATES = """round(spend / nullif(leads, 0), 2) AS cost_per_lead, round(spend / nullif(mqls, 0), 2) AS cost_per_mql,
  round(spend / nullif(sqls, 0), 2) AS cost_per_sql, round(spend / nullif(customers, 0), 2) AS cost_per_customer,
  round(coalesce(mqls, 0) / nullif(leads, 0) * 100, 1) AS mql_rate, round(coalesce(sqls, 0) / nullif(mqls, 0) * 100, 1) AS sql_rate,
  round(coalesce(customers, 0) / nullif(sqls, 0) * 100, 1) AS close_rate"""


@query("funnel_by_campaign", f"WITH {MERGED} SELECT *, {RATES} FROM merged")
def funnel_by_campaign(spark: SparkSession, sf: str) -> DataFrame:
    return funnel.with_funnel_metrics(_merged(spark, sf))


def _summary(source: str, stage: str = "SUM4({s})") -> str:
    sums = ", ".join(f"{stage.format(s=s)} AS total_{s}" for s in ("leads", "mqls", "sqls", "customers"))
    return f"""s AS (SELECT client_id, SUM4(spend) AS spend, {sums} FROM {source} GROUP BY client_id),
r AS (SELECT *, round(total_mqls / nullif(total_leads, 0) * 100, 1) AS r1, round(total_sqls / nullif(total_mqls, 0) * 100, 1) AS r2,
    round(total_customers / nullif(total_sqls, 0) * 100, 1) AS r3 FROM s),
w AS (SELECT *, list_min(list_filter([r1, r2, r3], lambda v: v < 100)) AS low FROM r)
SELECT client_id, round(spend, 2) AS total_spend, total_leads, total_mqls, total_sqls, total_customers,
  round(spend / nullif(total_leads, 0), 2) AS cost_per_lead, round(spend / nullif(total_mqls, 0), 2) AS cost_per_mql,
  round(spend / nullif(total_sqls, 0), 2) AS cost_per_sql, round(spend / nullif(total_customers, 0), 2) AS cost_per_customer,
  r1 AS lead_to_mql_rate, r2 AS mql_to_sql_rate, r3 AS sql_to_customer_rate,
  round(total_customers / nullif(total_leads, 0) * 100, 2) AS overall_conversion_rate,
  CASE WHEN r1 = low THEN 'lead_to_mql' WHEN r2 = low THEN 'mql_to_sql' WHEN r3 = low THEN 'sql_to_customer' END AS worst_funnel_stage,
  coalesce(low, 100) AS worst_funnel_rate FROM w"""


@query("funnel_summary", f"WITH {MERGED}, {_summary('merged')}")
def funnel_summary(spark: SparkSession, sf: str) -> DataFrame:
    return funnel.funnel_summary(_merged(spark, sf), ["client_id"])


ACCOUNT = """t AS (SELECT client_id, SUM4(leads) AS leads, SUM4(mqls) AS mqls, SUM4(sqls) AS sqls, SUM4(customers) AS customers
  FROM crm_funnel GROUP BY client_id)"""


@query("funnel_distributed", f"""
WITH {BRANDS}, {ACCOUNT}, k AS (SELECT client_id, SUM4(spend) AS key_spend FROM brands GROUP BY client_id)
SELECT client_id, campaign_name, b.spend, round(leads * (b.spend / key_spend)) AS leads, round(mqls * (b.spend / key_spend)) AS mqls,
  round(sqls * (b.spend / key_spend)) AS sqls, round(customers * (b.spend / key_spend)) AS customers
FROM brands b JOIN k USING (client_id) JOIN t USING (client_id)""")
def funnel_distributed(spark: SparkSession, sf: str) -> DataFrame:
    totals = funnel.funnel_totals(model.crm_funnel(spark, sf), ["client_id"])
    return funnel.distribute_by_spend(stored(_brands(spark, sf)), totals, ["client_id"])


@query("funnel_by_date_summary", f"""
WITH {BRANDS}, {ACCOUNT}, d AS (SELECT * FROM brands JOIN t USING (client_id)), {_summary('d', 'max({s})')}""")
def funnel_by_date_summary(spark: SparkSession, sf: str) -> DataFrame:
    totals = funnel.funnel_totals(model.crm_funnel(spark, sf), ["client_id"])
    attached = funnel.attach_totals(_brands(spark, sf), totals, ["client_id"])
    return funnel.funnel_summary(attached, ["client_id"], totals_once=True)


@query("event_funnel_metrics", f"""
SELECT client_id, platform, campaign_name, period, spend, leads, mqls, sqls, customers, {RATES} FROM event_facts""")
def event_funnel_metrics(spark: SparkSession, sf: str) -> DataFrame:
    facts = model.event_facts(spark, sf).select(
        "client_id", "platform", "campaign_name", "period", "spend", "leads", "mqls", "sqls", "customers"
    )
    return funnel.with_funnel_metrics(facts)


@query("funnel_reconciliation", f"""
WITH {BRANDS},
p AS (SELECT f.client_id, lower(funnel_name) AS funnel_name, min(lower(campaign_name)) AS campaign_name
  FROM crm_funnel f JOIN brands b ON f.client_id = b.client_id AND {NESTED} GROUP BY ALL)
SELECT client_id, 'matched' AS kind, funnel_name, campaign_name FROM p
UNION ALL SELECT client_id, 'unmatched_funnel', lower(funnel_name), NULL FROM crm_funnel
  WHERE (client_id, lower(funnel_name)) NOT IN (SELECT (client_id, funnel_name) FROM p)
UNION ALL SELECT client_id, 'unmatched_campaign', NULL, lower(campaign_name) FROM brands
  WHERE (client_id, lower(campaign_name)) NOT IN (SELECT (client_id, campaign_name) FROM p)""")
def funnel_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    campaigns, rows = stored(_brands(spark, sf)), stored(model.crm_funnel(spark, sf).select("client_id", "funnel_name"))
    return matching.reconciliation(campaigns, rows, ["client_id"], "campaign_name", "funnel_name")


TRAFFIC = """
tp AS (SELECT a.client_id, lower(a.campaign_name) AS name_key, arg_min(traffic_name,
    (CASE WHEN traffic_name = lower(a.campaign_name) THEN 0 ELSE 1 END, traffic_name)) AS traffic_key
  FROM (SELECT DISTINCT client_id, campaign_name FROM ad_sets) a JOIN web_traffic w ON w.client_id = a.client_id
   AND (traffic_name = lower(a.campaign_name) OR (least(length(traffic_name), length(a.campaign_name)) >= 10
    AND (contains(traffic_name, lower(a.campaign_name)) OR contains(lower(a.campaign_name), traffic_name)))) GROUP BY ALL),
tm AS (SELECT a.*, traffic_key, w.* EXCLUDE (client_id, traffic_name), users - new_users AS returning_users,
    round(new_users / nullif(users, 0) * 100, 1) AS pct_new_users, round(nullif(spend, 0) / nullif(sessions, 0), 2) AS cost_per_session,
    round(nullif(spend, 0) / nullif(new_users, 0), 2) AS cost_per_new_user
  FROM ad_sets a LEFT JOIN tp ON tp.client_id = a.client_id AND tp.name_key = lower(a.campaign_name)
  LEFT JOIN web_traffic w ON w.client_id = a.client_id AND w.traffic_name = traffic_key)"""


def _traffic(spark: SparkSession, sf: str) -> DataFrame:
    return webtraffic.merge_traffic(stored(model.ad_sets(spark, sf)), stored(model.web_traffic(spark, sf)), ["client_id"])


@query("traffic_by_campaign", f"WITH {TRAFFIC} SELECT * FROM tm")
def traffic_by_campaign(spark: SparkSession, sf: str) -> DataFrame:
    return _traffic(spark, sf)


@query("traffic_summary", f"""
WITH {TRAFFIC} SELECT client_id, CAST(sum(sessions) AS BIGINT) AS total_sessions,
  round(SUM4(bounce_rate * nullif(sessions, 0)) / sum(CASE WHEN bounce_rate IS NOT NULL THEN nullif(sessions, 0) END), 1) AS avg_bounce_rate,
  CAST(sum(nullif(ga_conversions, 0)) AS BIGINT) AS total_ga_conversions, round(AVG4(nullif(cost_per_session, 0)), 2) AS avg_cost_per_session,
  count(nullif(sessions, 0)) AS campaigns_matched FROM tm GROUP BY client_id HAVING count(nullif(sessions, 0)) > 0""")
def traffic_summary(spark: SparkSession, sf: str) -> DataFrame:
    return webtraffic.traffic_summary(_traffic(spark, sf), ["client_id"])


BAND = "CASE WHEN bounce_rate > 50 THEN 'high' WHEN bounce_rate > 35 THEN 'mid' ELSE 'low' END"


@query("traffic_table", f"""
WITH {TRAFFIC} SELECT client_id, platform, campaign_name, sessions, engaged_sessions, bounce_rate, avg_session_duration,
  cost_per_session, ga_conversions, {BAND} AS bounce_band FROM tm WHERE sessions > 0""")
def traffic_table(spark: SparkSession, sf: str) -> DataFrame:
    return webtraffic.traffic_table(_traffic(spark, sf)).select(
        "client_id", "platform", "campaign_name", "sessions", "engaged_sessions", "bounce_rate", "avg_session_duration",
        "cost_per_session", "ga_conversions", "bounce_band",
    )


@query("traffic_table_totals", f"""
WITH {TRAFFIC} SELECT client_id, CAST(sum(sessions) AS BIGINT) AS total_sessions, round(AVG4(bounce_rate), 1) AS mean_bounce_rate,
  round(AVG4(cost_per_session), 2) AS mean_cost_per_session, count(*) AS campaigns, count(*) FILTER (WHERE {BAND} = 'high') AS high_bounce,
  count(*) FILTER (WHERE {BAND} = 'mid') AS mid_bounce, count(*) FILTER (WHERE {BAND} = 'low') AS low_bounce
FROM tm WHERE sessions > 0 GROUP BY client_id""")
def traffic_table_totals(spark: SparkSession, sf: str) -> DataFrame:
    return webtraffic.traffic_table_totals(_traffic(spark, sf), ["client_id"])


BULK = """bulk AS (SELECT DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN lower(n_name) ELSE lower(n_name) || ' ' || lower(c_mktsegment) END AS bulk_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT r_name FROM region)"""


@query("resolved_clients", f"""
WITH {BULK},
m AS (SELECT bulk_name, arg_min(client_id, (CASE WHEN lower(client_name) = lower(bulk_name) THEN 0 ELSE 1 END, client_name)) AS known_id
  FROM bulk JOIN clients ON contains(lower(client_name), lower(bulk_name)) OR contains(lower(bulk_name), lower(client_name)) GROUP BY ALL)
SELECT bulk_name, CAST(coalesce(known_id, (SELECT max(client_id) FROM clients)
    + row_number() OVER (PARTITION BY known_id IS NULL ORDER BY lower(bulk_name))) AS BIGINT) AS client_id, known_id IS NULL AS is_new
FROM bulk LEFT JOIN m USING (bulk_name)""")
def resolved_clients(spark: SparkSession, sf: str) -> DataFrame:
    nation = F.lower("n_name")
    segment = F.col("c_mktsegment")
    nations = model.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    names = model.table(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct().join(nations, "c_nationkey").select(
        F.when(segment == "BUILDING", nation).otherwise(F.concat_ws(" ", nation, F.lower(segment))).alias("client_name")
    )
    regions = spark.read.schema("r_regionkey int, r_name string").parquet(f"{sf}/region.parquet").select(F.col("r_name").alias("client_name"))
    return matching.resolve_clients(names.unionByName(regions).distinct(), model.clients(spark, sf))


RAW = """raw AS (SELECT client_id, platform, campaign_name AS campaign, adgroup_name AS "ad group", keyword_name AS keyword, impressions,
    clicks, spend AS cost, conversions, conversion_value AS "conversion value", quality_score AS "quality score",
    round(CASE WHEN spend <> 0 THEN conversion_value / spend ELSE 0 END, 4) AS roas,
    round(CASE WHEN impressions <> 0 THEN clicks / impressions ELSE 0 END * 100, 4) AS ctr FROM granular)"""


def raw_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword rows under the headers of a search-ads export."""
    rows = model.granular_rows(spark, sf)
    return rows.select(
        "client_id", "platform", F.col("campaign_name").alias("campaign"), F.col("adgroup_name").alias("ad group"),
        F.col("keyword_name").alias("keyword"), "impressions", "clicks", F.col("spend").alias("cost"), "conversions",
        F.col("conversion_value").alias("conversion value"), F.col("quality_score").alias("quality score"),
        rnd(ratio("conversion_value", "spend"), 4).alias("roas"), rnd(ratio("clicks", "impressions") * 100, 4).alias("ctr"),
    )


def _rollup_sql(keys: str) -> str:
    return f"""SELECT client_id, platform, {keys}, SUM4(impressions) AS impressions, SUM4(clicks) AS clicks, SUM4(cost) AS cost,
  SUM4(conversions) AS conversions, SUM4("conversion value") AS conversion_value, max("quality score") AS quality_score,
  round(CASE WHEN sum(cost) <> 0 THEN sum(roas * cost) / sum(cost) ELSE avg(roas) END, 3) AS roas,
  round(CASE WHEN sum(cost) <> 0 THEN sum(ctr * cost) / sum(cost) ELSE avg(ctr) END, 3) AS ctr FROM raw GROUP BY ALL"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"roas": rnd("roas", 3), "ctr": rnd("ctr", 3)}).withColumnsRenamed(
        {"conversion value": "conversion_value", "quality score": "quality_score", "ad group": "ad_group"}
    )


@query("rollup_campaigns", f"WITH {RAW} {_rollup_sql('campaign')}")
def rollup_campaigns(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(granular.to_campaigns(raw_keywords(spark, sf), ["client_id", "platform"]))


@query("rollup_adgroups", f"""WITH {RAW} {_rollup_sql('campaign, "ad group" AS ad_group')}""")
def rollup_adgroups(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(granular.to_adgroups(raw_keywords(spark, sf), ["client_id", "platform"]))


@query("granularity_note", f"""
WITH {RAW} SELECT client_id, platform, count(*) AS rows, count(DISTINCT campaign) AS campaigns, 'keyword' AS level,
  'Keyword-level data detected (' || count(*) || ' keywords across ' || count(DISTINCT campaign) || ' campaigns, '
  || count(DISTINCT "ad group") || ' ad groups). Aggregated to campaign level for main audit.' AS note FROM raw GROUP BY client_id, platform""")
def granularity_note(spark: SparkSession, sf: str) -> DataFrame:
    return granular.level_note(raw_keywords(spark, sf), ["client_id", "platform"])


SEVERITY = "CASE WHEN {r} < 1 THEN 'critical' WHEN {r} < 2 THEN 'warning' ELSE 'ok' END"
KEYWORDS = f"""kw AS (SELECT *, round(CASE WHEN cost <> 0 THEN "conversion value" / cost ELSE 0 END, 2) AS r FROM raw)"""


@query("keyword_insights", f"""
WITH {RAW}, {KEYWORDS} SELECT client_id, platform, campaign, "ad group" AS adgroup, keyword, round(cost, 2) AS spend, r AS roas,
  round(cost / coalesce(nullif(clicks, 0), 1), 2) AS cpc, round(ctr, 2) AS ctr, CAST(floor(conversions) AS BIGINT) AS conversions,
  quality_score, {SEVERITY.format(r='r')} AS severity FROM (SELECT *, "quality score" AS quality_score FROM kw)""")
def keyword_insights(spark: SparkSession, sf: str) -> DataFrame:
    return granular.insights(raw_keywords(spark, sf), "keyword", ["client_id", "platform"])


@query("adgroup_insights", f"""
WITH {RAW}, a AS ({_rollup_sql('campaign, "ad group" AS adgroup')}),
b AS (SELECT *, CASE WHEN cost <> 0 THEN round(conversion_value / cost, 2) ELSE roas END AS r FROM a)
SELECT client_id, platform, campaign, adgroup, round(cost, 2) AS spend, r AS roas,
  round(CASE WHEN conversions <> 0 THEN cost / conversions ELSE 0 END, 2) AS cac, round(ctr, 2) AS ctr,
  CAST(floor(conversions) AS BIGINT) AS conversions, {SEVERITY.format(r='r')} AS severity FROM b""")
def adgroup_insights(spark: SparkSession, sf: str) -> DataFrame:
    rolled = granular.to_adgroups(raw_keywords(spark, sf), ["client_id", "platform"])
    rounded = rolled.withColumns({"roas": rnd("roas", 3), "ctr": rnd("ctr", 3)})
    return granular.insights(rounded, "ad group", ["client_id", "platform"])


@query("granular_best_worst", f"""
WITH {RAW}, g AS (SELECT client_id, platform, campaign || ' / ' || keyword AS name, SUM4(cost) AS spend,
    round(CASE WHEN SUM4(cost) <> 0 THEN SUM4("conversion value") / SUM4(cost) ELSE 0 END, 2) AS roas FROM raw GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, platform ORDER BY spend DESC, name) AS s FROM g) WHERE s <= 10),
b AS (SELECT *, 'worst' AS side, row_number() OVER (PARTITION BY client_id, platform ORDER BY roas, s) AS place FROM t
  UNION ALL SELECT *, 'best', row_number() OVER (PARTITION BY client_id, platform ORDER BY roas DESC, s) FROM t)
SELECT client_id, platform, side, place, name, name || ' (ROAS ' || printf('%.2f', roas) || 'x, spend ' || {_whole('spend')} || ')' AS text
FROM b WHERE place <= 3""")
def granular_best_worst(spark: SparkSession, sf: str) -> DataFrame:
    rows = raw_keywords(spark, sf).groupBy(
        "client_id", "platform", F.concat_ws(" / ", "campaign", "keyword").alias("name")
    ).agg(total("cost").alias("spend"), rnd(ratio(total("`conversion value`"), total("cost")), 2).alias("roas"))
    return granular.best_and_worst(stored(rows), ["client_id", "platform"], "name")
