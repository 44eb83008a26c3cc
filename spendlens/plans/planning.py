"""Budget, benchmark, outcome and cross-client report queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.guards import rnd
from spendlens.operators import budget, history, learning, reports
from spendlens.plans.registry import query
from spendlens.plans.signals import ANOMALIES, _whole, all_anomalies
from spendlens.session import stored
from spendlens.sources import model

AS_OF = date(2001, 7, 15)

BUDGET = f"""
bj0 AS (SELECT c.*, coalesce(tag, '') AS tag, lower(c.campaign_name) LIKE '%brand#1%' AS overridden,
    CASE WHEN lower(c.campaign_name) LIKE '%brand#1%' THEN 1.0::DOUBLE WHEN platform = 'google' THEN google_min_roas ELSE meta_min_roas END AS min_roas,
    CASE WHEN lower(c.campaign_name) LIKE '%brand#1%' THEN NULL WHEN platform = 'google' THEN google_min_cpl ELSE meta_min_cpl END AS min_cpl,
    max_shift_pct AS max_shift
  FROM campaigns c LEFT JOIN rules r ON r.client_id = c.client_id
  LEFT JOIN tags t ON t.client_id = c.client_id AND t.name = lower(c.campaign_name)),
bj1 AS (SELECT *, roas >= min_roas AS roas_ok, min_cpl IS NULL OR (cac > 0 AND cac <= min_cpl) AS cpl_ok FROM bj0
  WHERE tag NOT IN ('brand', 'test')),
judged AS (SELECT client_id, upload_id, platform, campaign_name, roas, cac, max_shift, NOT roas_ok OR NOT cpl_ok AS violates,
    CASE WHEN roas < 1 THEN 'pause' ELSE 'decrease' END AS action,
    least(max_shift, CASE WHEN roas < 1 THEN 50::DOUBLE ELSE 25::DOUBLE END) AS shift_pct,
    CAST(CASE WHEN roas < 1 THEN 90 ELSE 75 END AS BIGINT) AS confidence,
    concat_ws('; ', CASE WHEN NOT roas_ok THEN 'ROAS ' || printf('%.2f', roas) || 'x below min ' || min_roas || 'x' END,
      CASE WHEN NOT cpl_ok THEN 'CPL ' || {_whole('cac')} || ' above max ' || {_whole('min_cpl')} END) AS reason,
    roas_ok AND cpl_ok AND severity = 'ok' AND roas >= min_roas * 1.5 AS wins FROM bj1)
"""


def _inputs(spark: SparkSession, sf: str):
    return model.campaigns(spark, sf), model.clients(spark, sf), model.budget_rules(spark, sf)


@query("budget_actions", f"""
WITH {BUDGET} SELECT client_id, upload_id, platform, campaign_name, roas, cac, action, shift_pct, confidence, reason
FROM judged WHERE violates""")
def budget_actions(spark: SparkSession, sf: str) -> DataFrame:
    return budget.budget_actions(*_inputs(spark, sf))


@query("reallocation_targets", f"""
WITH {BUDGET}, pot AS (SELECT client_id, upload_id, sum(shift_pct) FILTER (WHERE violates) AS freed,
    count(*) FILTER (WHERE wins) AS winners FROM judged GROUP BY ALL)
SELECT client_id, upload_id, winner_order, platform, campaign_name,
  round(least(max_shift, CASE WHEN winners <> 0 THEN freed / winners ELSE 0 END), 1) AS increase_pct, round(freed, 1) AS total_freed_budget_pct
FROM (SELECT *, row_number() OVER (PARTITION BY client_id, upload_id ORDER BY CASE platform WHEN 'google' THEN 0 ELSE 1 END,
        roas, campaign_name) AS winner_order FROM judged WHERE wins)
JOIN pot USING (client_id, upload_id) WHERE winner_order <= 3 AND freed > 0""")
def reallocation_targets(spark: SparkSession, sf: str) -> DataFrame:
    return budget.reallocation_targets(*_inputs(spark, sf))


BENCH = """SELECT client_id, platform, median(roas) AS median_roas, median(cpc) AS median_cpc, median(cac) AS median_cac,
  median(ctr) AS median_ctr, median(spend) AS median_spend, count(DISTINCT upload_id) AS uploads_seen
FROM campaigns WHERE roas IS NOT NULL AND spend > 0 GROUP BY client_id, platform"""


@query("client_benchmarks", f"""SELECT client_id, platform, round(median_roas, 4) AS median_roas, round(median_cpc, 4) AS median_cpc,
  round(median_cac, 4) AS median_cac, round(median_ctr, 4) AS median_ctr, round(median_spend, 4) AS median_spend, uploads_seen
FROM ({BENCH})""")
def client_benchmarks(spark: SparkSession, sf: str) -> DataFrame:
    found = learning.client_benchmarks(stored(model.campaigns(spark, sf)))
    return found.select(
        "client_id", "platform", *[rnd(f"median_{m}", 4).alias(f"median_{m}") for m in learning.BENCHMARKED], "uploads_seen"
    )


@query("benchmark_lines", f"""
SELECT client_id, platform, concat_ws(', ', '  ' || upper(platform) || ' (' || uploads_seen || ' uploads):',
  'median ROAS ' || printf('%.2f', round(median_roas, 2)) || 'x', 'median CPC ' || printf('%.0f', round(median_cpc)),
  'median CAC ' || printf('%.0f', round(median_cac)), 'median CTR ' || printf('%.2f', round(median_ctr, 2)) || '%') AS line
FROM ({BENCH}) WHERE uploads_seen >= 2""")
def benchmark_lines(spark: SparkSession, sf: str) -> DataFrame:
    return reports.benchmark_lines(learning.client_benchmarks(stored(model.campaigns(spark, sf))))


DONE = """
done AS (SELECT client_id || ':' || upload_id || ':' || platform || ':' || campaign_name AS action_item_id, client_id,
    campaign_name AS campaign, CASE WHEN upload_id % 2 = 0 THEN platform END AS platform, roas AS snapshot_roas, cac AS snapshot_cac,
    ctr AS snapshot_ctr, spend AS snapshot_spend, upload_id AS snapshot_upload_id, uploaded_on AS done_on,
    campaign_name = 'Brand#7' AS is_tracked
  FROM campaigns WHERE severity = 'critical')"""


def done_items(facts: DataFrame) -> DataFrame:
    """Completed actions: one per critical campaign row, done on the day of its upload."""
    item = F.concat_ws(":", F.col("client_id").cast("string"), F.col("upload_id").cast("string"), "platform", "campaign_name")
    return facts.where(F.col("severity") == "critical").select(
        item.alias("action_item_id"), "client_id", F.col("campaign_name").alias("campaign"),
        F.when(F.col("upload_id") % 2 == 0, F.col("platform")).alias("platform"),
        *[F.col(m).alias(f"snapshot_{m}") for m in ("roas", "cac", "ctr", "spend")],
        F.col("upload_id").alias("snapshot_upload_id"), F.col("uploaded_on").alias("done_on"),
    )


@query("outcome_signals", f"""
WITH {DONE}, latest AS (SELECT * FROM campaigns WHERE upload_rank = upload_count),
m AS (SELECT d.*, c.platform AS now_platform, c.roas, c.cac, c.ctr, c.upload_id AS upload_id_after
  FROM done d JOIN latest c ON c.client_id = d.client_id AND c.campaign_name = d.campaign
   AND (d.platform IS NULL OR d.platform = c.platform) WHERE NOT is_tracked)
SELECT client_id, action_item_id, campaign, now_platform AS platform, metric, value_before, value_after, improved,
  snapshot_upload_id AS upload_id_before, upload_id_after FROM (
  SELECT *, 'roas' AS metric, snapshot_roas AS value_before, roas AS value_after, roas > snapshot_roas AS improved FROM m
  UNION ALL SELECT *, 'cac', snapshot_cac, cac, cac < snapshot_cac FROM m
  UNION ALL SELECT *, 'ctr', snapshot_ctr, ctr, ctr > snapshot_ctr FROM m)""")
def outcome_signals(spark: SparkSession, sf: str) -> DataFrame:
    facts = stored(model.campaigns(spark, sf))
    done = done_items(facts)
    newest = history.latest_by(facts, ["client_id"], ["uploaded_on", "upload_id"], ["upload_id"])
    latest = facts.join(newest, ["client_id", "upload_id"], "left_semi")
    tracked = done.where(F.col("campaign") == "Brand#7").select("action_item_id")
    return learning.outcome_signals(done, latest, tracked)


def _shift(metric: str) -> str:
    return (f"c.{metric} AS current_{metric}")


@query("action_impact", f"""
WITH {DONE},
byday AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY uploaded_on, upload_id) AS r,
    count(*) OVER (PARTITION BY client_id) AS total FROM uploads),
until AS (SELECT d.*, (SELECT count(*) FROM uploads u WHERE u.client_id = d.client_id AND u.uploaded_on <= d.done_on) AS k,
    (SELECT count(*) FROM uploads u WHERE u.client_id = d.client_id) AS total FROM done d),
placed AS (SELECT *, least(5, total - k) AS later FROM until WHERE total > k)
SELECT action_item_id, p.client_id, campaign, c.platform, c.upload_id AS upload_id_after,
  CAST(DATE '{AS_OF}' - done_on AS BIGINT) AS days_elapsed, CAST(later AS BIGINT) AS uploads_after,
  c.roas AS current_roas, c.cac AS current_cac, c.ctr AS current_ctr, c.spend AS current_spend,
  round((c.roas - nullif(snapshot_roas, 0)) / nullif(snapshot_roas, 0) * 100, 1) AS roas_delta,
  round((c.cac - nullif(snapshot_cac, 0)) / nullif(snapshot_cac, 0) * 100, 1) AS cac_delta,
  round((c.ctr - nullif(snapshot_ctr, 0)) / nullif(snapshot_ctr, 0) * 100, 1) AS ctr_delta
FROM placed p JOIN byday b ON b.client_id = p.client_id AND b.r = p.k + p.later
JOIN campaigns c ON c.upload_id = b.upload_id AND lower(c.campaign_name) = lower(p.campaign)
  AND (p.platform IS NULL OR p.platform = c.platform)""")
def action_impact(spark: SparkSession, sf: str) -> DataFrame:
    facts = stored(model.campaigns(spark, sf))
    return learning.action_impact(done_items(facts), history.stored_uploads(spark, sf), facts, AS_OF)


@query("bulk_report", f"""
WITH {ANOMALIES},
s AS (SELECT client_id, upload_id, coalesce(period_label, CAST(period_date AS VARCHAR)) AS period, SUM4(spend) AS spend,
    SUM4(conversion_value) AS revenue, count(DISTINCT campaign_name) AS campaign_count
  FROM campaigns WHERE upload_rank = upload_count GROUP BY ALL),
n AS (SELECT client_id, count(*) AS open_anomalies FROM anomalies GROUP BY client_id),
f AS (SELECT client_id, least(google_min_roas, meta_min_roas) AS floor FROM rules)
SELECT s.client_id, client_name, currency, upload_id, period, round(spend, 2) AS total_spend, round(revenue, 2) AS total_revenue,
  round(CASE WHEN spend <> 0 THEN revenue / spend ELSE 0 END, 2) AS blended_roas, campaign_count, coalesce(open_anomalies, 0) AS open_anomalies,
  CASE WHEN CASE WHEN spend <> 0 THEN revenue / spend ELSE 0 END >= floor * 1.2::DOUBLE THEN 'Good'
       WHEN CASE WHEN spend <> 0 THEN revenue / spend ELSE 0 END >= floor * 0.8::DOUBLE THEN 'Warning'
       ELSE 'Critical' END AS budget_health
FROM s JOIN clients USING (client_id) LEFT JOIN n USING (client_id) LEFT JOIN f USING (client_id)""")
def bulk_report(spark: SparkSession, sf: str) -> DataFrame:
    facts, uploads, clients = stored(history.ranked_campaigns(spark, sf)), model.uploads(spark, sf), model.clients(spark, sf)
    found = reports.anomaly_ops.detect_anomalies(facts, clients)
    return reports.bulk_report(facts, uploads, clients, model.budget_rules(spark, sf), found)


@query("client_overview", f"""
WITH {ANOMALIES},
s AS (SELECT client_id, period_label, AVG4(roas) AS roas, SUM4(spend) AS spend, count(DISTINCT campaign_name) AS campaign_count
  FROM campaigns WHERE upload_rank = upload_count GROUP BY ALL),
r AS (SELECT client_id, max(uploaded_on) AS last_audit FROM uploads WHERE upload_id % 3 = 0 GROUP BY client_id),
n AS (SELECT client_id, count(*) AS t, count(*) FILTER (WHERE severity = 'critical') AS c,
    count(*) FILTER (WHERE severity = 'warning') AS w FROM anomalies GROUP BY client_id)
SELECT client_id, client_name, currency, last_audit, period_label AS last_period, round(coalesce(roas, 0), 2) AS last_roas,
  round(coalesce(spend, 0)) AS total_spend, coalesce(campaign_count, 0) AS campaign_count, coalesce(c, 0) AS anomaly_critical,
  coalesce(w, 0) AS anomaly_warning, coalesce(t, 0) AS anomaly_total,
  CASE WHEN c > 0 THEN 'critical' WHEN w > 0 THEN 'warning' ELSE 'healthy' END AS status
FROM clients LEFT JOIN s USING (client_id) LEFT JOIN r USING (client_id) LEFT JOIN n USING (client_id)""")
def client_overview(spark: SparkSession, sf: str) -> DataFrame:
    facts, clients = stored(history.ranked_campaigns(spark, sf)), model.clients(spark, sf)
    audits = model.uploads(spark, sf).where(F.col("upload_id") % 3 == 0).select("client_id", F.col("uploaded_on").alias("created_on"))
    return reports.overview(facts, clients, audits, reports.anomaly_ops.detect_anomalies(facts, clients))


LATEST_ANOMALIES = f"""{ANOMALIES}, la AS (SELECT * FROM anomalies WHERE upload_rank = upload_count)"""
BRIEF_ORDER = """CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, abs(pct_change) DESC, campaign_name, platform, metric"""


def _latest_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return stored(all_anomalies(spark, sf).where(F.col("upload_rank") == F.col("upload_count")))


@query("morning_brief", f"""
WITH {LATEST_ANOMALIES}, c AS (SELECT client_id, count(*) FILTER (WHERE severity = 'critical') AS critical,
    count(*) FILTER (WHERE severity = 'warning') AS warning FROM la GROUP BY client_id)
SELECT client_id, position, critical, warning, CASE WHEN critical > 0 THEN 'critical' WHEN warning > 0 THEN 'warning' ELSE 'ok' END AS worst_severity,
  '[' || upper(severity) || '] ' || campaign_name || ' (' || platform || ') - ' || description AS line
FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY {BRIEF_ORDER}) AS position FROM la) JOIN c USING (client_id)
WHERE position <= 3""")
def morning_brief(spark: SparkSession, sf: str) -> DataFrame:
    return reports.morning_brief(_latest_anomalies(spark, sf))


@query("brief_text", f"""
WITH {LATEST_ANOMALIES}
SELECT client_id, concat_ws(' ', count(*) || CASE WHEN count(*) = 1 THEN ' anomaly detected.' ELSE ' anomalys detected.' END,
  string_agg(description || '.', ' ' ORDER BY position) FILTER (WHERE position <= 5),
  CASE WHEN count(*) > 5 THEN '...and ' || (count(*) - 5) || ' more.' END) AS brief
FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY {BRIEF_ORDER}) AS position FROM la) GROUP BY client_id""")
def brief_text(spark: SparkSession, sf: str) -> DataFrame:
    return reports.brief_text(_latest_anomalies(spark, sf))


@query("open_anomaly_context", f"""
WITH {ANOMALIES}
SELECT client_id, position, upload_id, campaign_name, platform, metric, severity, pct_change FROM (
  SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END,
    period_date DESC, upload_id DESC, campaign_name, platform, metric) AS position FROM anomalies) WHERE position <= 10""")
def open_anomaly_context(spark: SparkSession, sf: str) -> DataFrame:
    return reports.open_anomaly_context(all_anomalies(spark, sf))


@query("narrative_campaigns", """
SELECT client_id, upload_id, platform, role, position, campaign_name, roas, spend FROM (
  SELECT *, row_number() OVER (PARTITION BY upload_id, platform, role
      ORDER BY CASE role WHEN 'top' THEN -roas ELSE roas END, campaign_name) AS position
  FROM (SELECT *, CASE severity WHEN 'ok' THEN 'top' WHEN 'critical' THEN 'worst' END AS role FROM campaigns) WHERE role IS NOT NULL)
WHERE position <= 3""")
def narrative_campaigns(spark: SparkSession, sf: str) -> DataFrame:
    return reports.narrative_campaigns(model.campaigns(spark, sf))


@query("underperformers", """
SELECT client_id, upload_id, platform, campaign_name, severity, CASE severity WHEN 'critical' THEN 0 ELSE 1 END AS severity_order,
  roas, spend, wasted_spend FROM campaigns WHERE severity IN ('critical', 'warning')""")
def underperformers(spark: SparkSession, sf: str) -> DataFrame:
    return reports.underperformers(model.campaigns(spark, sf))
