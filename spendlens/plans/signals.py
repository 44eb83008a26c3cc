"""Alerts, anomalies and client context queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens import briefing_values as bv
from spendlens.operators import alerts, anomalies, context, history
from spendlens.plans.registry import query
from spendlens.sources import model


def _pct(current: str, base: str) -> str:
    return f"CASE WHEN coalesce({base}, 0) = 0 THEN 0 ELSE round(({current} - {base}) / abs({base}) * 100, 1) END"


def _whole(x: str) -> str:
    return f"format('{{:,}}', CAST(round({x}) AS BIGINT))"


def _alert(kind: str, where: str, threshold: str, actual: str, pct: str, high: str, message: str) -> str:
    return f"""SELECT client_id, upload_id, upload_rank, upload_count, campaign_name AS campaign, platform, '{kind}' AS alert_type,
      CAST({threshold} AS DOUBLE) AS threshold, CAST({actual} AS DOUBLE) AS actual_value, CAST({pct} AS DOUBLE) AS deviation_pct,
      CASE WHEN {high} THEN 'high' ELSE 'medium' END AS severity, {message} AS message FROM b WHERE {where}"""


def _prior_text(lead: str, pct: str, note: str, now: str, then: str) -> str:
    return f"'{lead}' || printf('%.0f', round(abs({pct}))) || '{note}' || {now} || ' vs ' || {then} || ')'"


ALERTS = f"""
tagged AS (
  SELECT c.*, tag, target_roas, target_cpa, target_cpl, r.* EXCLUDE (client_id)
  FROM campaigns c LEFT JOIN tags t ON t.client_id = c.client_id AND t.name = lower(c.campaign_name)
  LEFT JOIN targets g ON g.client_id = c.client_id AND g.name = lower(c.campaign_name)
  LEFT JOIN rules r ON r.client_id = c.client_id),
b0 AS (
  SELECT c.*, coalesce(tag IN ('brand', 'brand_awareness'), false) AS is_brand, p.upload_id IS NOT NULL AS known,
    coalesce(p.spend, 0) AS p_spend, coalesce(p.conversions, 0) AS p_conv, coalesce(p.cac, 0) AS p_cac, coalesce(p.ctr, 0) AS p_ctr,
    CASE WHEN c.clicks <> 0 THEN c.conversions / c.clicks ELSE 0 END * 100 AS cvr,
    CASE WHEN p.clicks <> 0 THEN p.conversions / p.clicks ELSE 0 END * 100 AS p_cvr,
    coalesce(nullif(target_roas, 0), nullif(CASE c.platform WHEN 'google' THEN google_min_roas ELSE meta_min_roas END, 0),
             nullif(google_min_roas, 0), 2.0) AS min_roas,
    coalesce(nullif(target_cpa, 0), nullif(target_cpl, 0),
             nullif(CASE c.platform WHEN 'google' THEN google_min_cpl ELSE meta_min_cpl END, 0)) AS ceiling
  FROM tagged c LEFT JOIN campaigns p ON p.client_id = c.client_id AND p.platform = c.platform
    AND p.campaign_name = c.campaign_name AND p.upload_rank = c.upload_rank - 1),
b AS (SELECT *, coalesce(NOT is_brand AND cac > 0 AND cac > ceiling * 1.3, false) AS over_ceiling,
    {_pct('cac', 'p_cac')} AS cac_pct, {_pct('ctr', 'p_ctr')} AS ctr_pct, {_pct('cvr', 'p_cvr')} AS cvr_pct,
    {_pct('spend', 'p_spend')} AS spend_pct, {_pct('roas', 'min_roas')} AS roas_pct, {_pct('cac', 'ceiling')} AS ceiling_pct FROM b0),
kpi_alerts AS (
{_alert('roas_below', 'NOT is_brand AND spend > 50 AND roas > 0 AND roas < min_roas', 'min_roas', 'roas', 'roas_pct',
        'roas_pct < -30', "'ROAS ' || printf('%.2f', roas) || 'x below target ' || CAST(min_roas AS VARCHAR) || 'x'")}
UNION ALL {_alert('zero_conversions', 'spend > 100 AND conversions = 0', '1', '0', '-100.0', 'true',
                  f"'Zero conversions with ' || {_whole('spend')} || ' spend'")}
UNION ALL {_alert('cpa_spike', 'over_ceiling', 'ceiling', 'round(cac, 2)', 'ceiling_pct', 'ceiling_pct > 50',
                  f"'CPA ' || {_whole('cac')} || ' exceeds ceiling ' || {_whole('ceiling')}")}
UNION ALL {_alert('cpa_spike', 'NOT over_ceiling AND NOT is_brand AND known AND cac > 0 AND p_conv > 0 AND p_cac > 0 AND cac_pct > 30',
                  'round(p_cac, 2)', 'round(cac, 2)', 'cac_pct', 'cac_pct > 50',
                  _prior_text('CPA up ', 'cac_pct', '% vs prior period (', _whole('cac'), _whole('p_cac')))}
UNION ALL {_alert('ctr_drop', 'known AND ctr > 0 AND p_ctr > 0 AND ctr_pct < -20', 'round(p_ctr, 2)', 'round(ctr, 2)', 'ctr_pct',
                  'ctr_pct < -40', _prior_text('CTR dropped ', 'ctr_pct', '% (', "printf('%.2f', ctr) || '%'", "printf('%.2f', p_ctr) || '%'"))}
UNION ALL {_alert('cvr_drop', 'known AND cvr > 0 AND p_cvr > 0 AND cvr_pct < -25', 'round(p_cvr, 2)', 'round(cvr, 2)', 'cvr_pct',
                  'cvr_pct < -40', _prior_text('CVR dropped ', 'cvr_pct', '% (', "printf('%.2f', round(cvr, 2)) || '%'",
                                               "printf('%.2f', round(p_cvr, 2)) || '%'"))}
UNION ALL {_alert('spend_overpace', 'known AND p_spend > 0 AND spend_pct > 40', 'round(p_spend, 2)', 'round(spend, 2)', 'spend_pct',
                  'spend_pct > 30', _prior_text('Spend up ', 'spend_pct', '% vs prior (', _whole('spend'), _whole('p_spend')))}
UNION ALL {_alert('spend_underpace', 'known AND p_spend > 0 AND spend > 0 AND spend_pct < -40', 'round(p_spend, 2)', 'round(spend, 2)',
                  'spend_pct', 'false', _prior_text('Spend down ', 'spend_pct', '% vs prior (', _whole('spend'), _whole('p_spend')))}
)"""


def all_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.kpi_alerts(history.ranked_campaigns(spark, sf), model.clients(spark, sf), model.budget_rules(spark, sf))


@query("kpi_alerts", f"WITH {ALERTS} SELECT * EXCLUDE (upload_rank, upload_count) FROM kpi_alerts")
def kpi_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return all_alerts(spark, sf).drop("upload_rank", "upload_count")


@query("alert_list", f"""
WITH {ALERTS}
SELECT client_id, upload_id, campaign, platform, alert_type, severity, deviation_pct, client_name, created_on
FROM (SELECT a.*, u.uploaded_on AS created_on FROM kpi_alerts a JOIN uploads u USING (upload_id)
      ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, u.uploaded_on DESC,
        a.client_id, upload_id, campaign, platform, alert_type LIMIT 100)
LEFT JOIN clients USING (client_id)""")
def alert_list(spark: SparkSession, sf: str) -> DataFrame:
    created = model.uploads(spark, sf).select("upload_id", F.col("uploaded_on").alias("created_on"))
    dated = all_alerts(spark, sf).join(created, "upload_id")
    return alerts.alert_list(dated, model.clients(spark, sf)).select(
        "client_id", "upload_id", "campaign", "platform", "alert_type", "severity", "deviation_pct", "client_name", "created_on"
    )


def _median(name: str) -> str:
    """Median of a list column, as the mean of its two middle elements."""
    ordered = f"list_sort({name})"
    return f"(({ordered}[(len({name}) + 1) // 2] + {ordered}[len({name}) // 2 + 1]) / 2)"


METRICS = ["cac", "roas", "ctr", "spend"]
_RECENT = ", ".join(f"list({m}) OVER near AS near_{m}, list({m}) OVER season AS season_{m}" for m in METRICS)
_BASE = ", ".join(f"CASE WHEN len(near_{m}) >= 3 THEN {_median(f'near_{m}')} END AS base_{m}, "
                  f"nullif({_median(f'season_{m}')}, 0) AS typical_{m}" for m in METRICS)
_CHANGE = ", ".join(f"coalesce(({m} - base_{m}) / nullif(base_{m}, 0), 0) AS change_{m}" for m in METRICS)


def _limit(low: float, medium: float, high: float) -> str:
    return f"CASE sensitivity WHEN 'low' THEN {low}::DOUBLE WHEN 'high' THEN {high}::DOUBLE ELSE {medium}::DOUBLE END"


def _anomaly(metric: str, where: str, current: str, base: str, change: str, direction: str, severity: str, text: str,
             seasonal: str = "false") -> str:
    return f"""SELECT client_id, upload_id, upload_rank, upload_count, period_date, campaign_name, platform, '{metric}' AS metric,
      round({current}, 4) AS current_value, round({base}, 4) AS baseline_value, round({change} * 100, 1) AS pct_change,
      {direction} AS direction, {severity} AS severity, {text} AS description, {seasonal} AS seasonal FROM a WHERE {where}"""


def _graded(metric: str, limit: str) -> str:
    size = f"abs(change_{metric}) / {limit}"
    return f"CASE WHEN {size} >= 2 THEN 'critical' WHEN {size} >= 1 THEN 'warning' ELSE 'info' END"


def _season(metric: str) -> str:
    return (f"coalesce(period_start IS NOT NULL AND abs(({metric} - typical_{metric}) / typical_{metric}) <= 0.25::DOUBLE, false)")


def _pct0(x: str) -> str:
    return f"printf('%.0f', round(abs({x}) * 100))"


def _two(x: str, unit: str) -> str:
    return f"printf('%.2f', round({x}, 2)) || '{unit}'"


ANOMALIES = f"""
h AS (SELECT *, month(period_date) AS period_month FROM campaigns),
w AS (SELECT h.*, tag, target_roas, target_cpa, target_cpl, coalesce(anomaly_sensitivity, 'medium') AS sensitivity, {_RECENT}
  FROM h JOIN clients k ON k.client_id = h.client_id
  LEFT JOIN tags t ON t.client_id = h.client_id AND t.name = lower(h.campaign_name)
  LEFT JOIN targets g ON g.client_id = h.client_id AND g.name = lower(h.campaign_name)
  WINDOW near AS (PARTITION BY h.client_id, platform, campaign_name ORDER BY upload_rank RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING),
    season AS (PARTITION BY h.client_id, platform, campaign_name, period_month ORDER BY upload_rank
               RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING)),
a0 AS (SELECT *, {_BASE}, near_ctr[-3:] AS last_ctr FROM w WHERE coalesce(tag NOT IN ('test', 'brand'), true)),
a1 AS (SELECT *, {_CHANGE}, {_limit(0.50, 0.30, 0.15)} AS limit_cpl, {_limit(0.35, 0.20, 0.10)} AS limit_roas,
    {_limit(0.40, 0.25, 0.12)} AS limit_ctr, {_limit(0.30, 0.15, 0.10)} AS limit_pacing,
    CASE WHEN len(last_ctr) = 3 THEN last_ctr[1] END AS c1, CASE WHEN len(last_ctr) = 3 THEN last_ctr[2] END AS c2,
    CASE WHEN len(last_ctr) = 3 THEN last_ctr[3] END AS c3 FROM a0),
a AS (SELECT *, (c3 - c1) / c1 AS fatigue FROM a1),
anomalies AS (
{_anomaly('roas_target', 'roas < nullif(target_roas, 0)', 'roas', 'target_roas', '(roas - target_roas) / target_roas', "'miss'",
          "CASE WHEN abs((roas - target_roas) / target_roas) >= 0.4::DOUBLE THEN 'critical' ELSE 'warning' END",
          f"'ROAS ' || {_two('roas', 'x')} || ' misses target ' || {_two('target_roas', 'x')} || ' (' || "
          f"{_pct0('(roas - target_roas) / target_roas')} || '% below goal)'")}
UNION ALL {_anomaly('cpl_target', 'cac > 0 AND cac > nullif(target_cpl, 0)', 'cac', 'target_cpl', '(cac - target_cpl) / target_cpl', "'miss'",
          "CASE WHEN (cac - target_cpl) / target_cpl >= 0.5 THEN 'critical' ELSE 'warning' END",
          f"'CPL ' || {_whole('cac')} || ' exceeds target ' || {_whole('target_cpl')} || ' (' || "
          f"{_pct0('(cac - target_cpl) / target_cpl')} || '% over goal)'")}
UNION ALL {_anomaly('cpa_target', 'cac > 0 AND cac > nullif(target_cpa, 0)', 'cac', 'target_cpa', '(cac - target_cpa) / target_cpa', "'miss'",
          "CASE WHEN (cac - target_cpa) / target_cpa >= 0.5 THEN 'critical' ELSE 'warning' END",
          f"'CPA ' || {_whole('cac')} || ' exceeds target ' || {_whole('target_cpa')} || ' (' || "
          f"{_pct0('(cac - target_cpa) / target_cpa')} || '% over goal)'")}
UNION ALL {_anomaly('cpl', 'cac > 0 AND base_cac IS NOT NULL AND change_cac > limit_cpl', 'cac', 'base_cac', 'change_cac', "'spike'",
          _graded('cac', 'limit_cpl'), f"'CPL spiked ' || {_pct0('change_cac')} || '% above recent avg (' || {_whole('cac')} || ' vs ' || "
          f"{_whole('base_cac')} || ')'", _season('cac'))}
UNION ALL {_anomaly('roas', 'base_roas IS NOT NULL AND change_roas < -limit_roas', 'roas', 'base_roas', 'change_roas', "'drop'",
          _graded('roas', 'limit_roas'), f"'ROAS dropped ' || {_pct0('change_roas')} || '% below recent avg (' || {_two('roas', 'x')} || ' vs ' || "
          f"{_two('base_roas', 'x')} || ')'", _season('roas'))}
UNION ALL {_anomaly('ctr', 'ctr > 0 AND base_ctr IS NOT NULL AND change_ctr < -limit_ctr', 'ctr', 'base_ctr', 'change_ctr', "'drop'",
          _graded('ctr', 'limit_ctr'), f"'CTR dropped ' || {_pct0('change_ctr')} || '% below recent avg (' || {_two('ctr', '%')} || ' vs ' || "
          f"{_two('base_ctr', '%')} || ')'", _season('ctr'))}
UNION ALL {_anomaly('spend_pacing', 'spend > 0 AND base_spend IS NOT NULL AND abs(change_spend) > limit_pacing', 'spend', 'base_spend',
          'change_spend', "CASE WHEN change_spend > 0 THEN 'spike' ELSE 'drop' END", _graded('spend', 'limit_pacing'),
          f"'Spend ' || CASE WHEN change_spend > 0 THEN 'spike' ELSE 'drop' END || ' ' || {_pct0('change_spend')} || '% vs recent avg (' || "
          f"{_whole('spend')} || ' vs ' || {_whole('base_spend')} || ')'", _season('spend'))}
UNION ALL {_anomaly('creative_fatigue', 'c1 > c2 AND c2 > c3 AND greatest(abs((c2 - c1) / c1), abs((c3 - c2) / c2)) < 0.25::DOUBLE '
                    'AND abs(fatigue) >= 0.10::DOUBLE', 'c3', 'c1', 'fatigue', "'drop'", "'warning'",
          f"'Creative fatigue: CTR declined ' || {_pct0('fatigue')} || '% over last 3 uploads (' || {_two('c1', '%')} || ' to ' || "
          f"{_two('c3', '%')} || ') - consider refreshing creative'")}
)"""


def all_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return anomalies.detect_anomalies(history.ranked_campaigns(spark, sf), model.clients(spark, sf))


@query("anomalies", f"WITH {ANOMALIES} SELECT * EXCLUDE (upload_rank, upload_count, period_date) FROM anomalies")
def detected_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return all_anomalies(spark, sf).drop("upload_rank", "upload_count", "period_date")


@query("anomaly_summary", f"""
WITH {ANOMALIES}
SELECT client_id, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'warning') AS warning,
  count(*) FILTER (WHERE severity = 'info') AS info, count(*) AS total FROM anomalies GROUP BY client_id""")
def anomaly_summary(spark: SparkSession, sf: str) -> DataFrame:
    return anomalies.anomaly_summary(all_anomalies(spark, sf), "client_id")


@query("client_context", """
SELECT client_id, business_type, anomaly_sensitivity,
  CASE WHEN context_broken THEN 'legacy note for ' || client_name END AS extra,
  CASE WHEN context_broken THEN 0 ELSE 2 END AS tag_count, CASE WHEN context_broken THEN 0 ELSE 2 END AS target_count FROM clients""")
def client_context(spark: SparkSession, sf: str) -> DataFrame:
    parsed = context.parse_context(model.clients(spark, sf))
    return parsed.select(
        "client_id", "ctx.business_type", "ctx.anomaly_sensitivity", "ctx.extra",
        F.coalesce(F.cardinality("ctx.campaign_tags"), F.lit(0)).alias("tag_count"),
        F.coalesce(F.cardinality("ctx.campaign_targets"), F.lit(0)).alias("target_count"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BENCHMARKS = bv.benchmark_texts()
_KINDS = ", ".join(
    f"('{k}', {_quoted(label)}, {_quoted(bv.BUSINESS_IMPLIED[k]) if bv.BUSINESS_IMPLIED[k] else 'NULL'}, "
    f"{_quoted(_BENCHMARKS[k]) if k in _BENCHMARKS else 'NULL'})" for k, label in bv.BUSINESS_LABELS.items())


@query("client_briefing", f"""
WITH kinds AS (SELECT * FROM (VALUES {_KINDS}) t(business_type, label, implied, benchmark))
SELECT client_id, concat_ws(chr(10), '=== CLIENT BRIEFING ===', 'Business type: ' || label, 'Implied context: ' || implied,
  CASE WHEN NOT context_broken THEN 'Primary goal: grow ' || lower(client_name) END,
  CASE WHEN NOT context_broken THEN 'Campaign type tags (respect these when evaluating performance):' || chr(10)
    || '  - Brand#2: [brand]' || chr(10) || '  - Brand#3: [test]' END,
  CASE WHEN NOT context_broken THEN 'Per-campaign performance targets (flag if missing these goals):' || chr(10)
    || '  - Brand#4: target ROAS 2.5x target CPA 50000' || chr(10) || '  - Brand#5: target CPL 40000' END,
  benchmark, CASE WHEN context_broken THEN 'Additional context: legacy note for ' || client_name END,
  '=== END BRIEFING ===') AS briefing
FROM clients JOIN kinds USING (business_type)""")
def client_briefing(spark: SparkSession, sf: str) -> DataFrame:
    return context.briefings(model.clients(spark, sf))
