"""The data model once more as SQL views, for comparing query results."""

VIEWS = r"""
client_orders AS (
  SELECT o_orderkey AS l_orderkey, CAST(c_nationkey AS BIGINT) AS client_id,
         CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start
  FROM orders JOIN customer ON o_custkey = c_custkey),
periods AS (
  SELECT *, client_id * 1000 + (year(quarter_start) - 1995) * 4 + quarter(quarter_start) AS upload_id
  FROM (SELECT DISTINCT client_id, quarter_start FROM client_orders)),
uploads AS (
  SELECT CAST(upload_id AS BIGINT) AS upload_id, client_id,
    CASE WHEN upload_id % 11 <> 0 THEN quarter_start END AS period_start,
    CASE WHEN upload_id % 11 <> 0 THEN CAST(quarter_start + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) END AS period_end,
    CASE WHEN upload_id % 5 <> 0 THEN 'Q' || quarter(quarter_start) || ' ' || year(quarter_start) END AS period_label,
    CAST(quarter_start + INTERVAL 3 DAY AS DATE) AS uploaded_on,
    CASE WHEN upload_id % 11 <> 0 THEN quarter_start ELSE CAST(quarter_start + INTERVAL 3 DAY AS DATE) END AS period_date
  FROM periods),
ranked_uploads AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY client_id ORDER BY period_date, upload_id) AS BIGINT) AS upload_rank,
         count(*) OVER (PARTITION BY client_id) AS upload_count
  FROM uploads),
clients AS (
  SELECT CAST(n_nationkey AS BIGINT) AS client_id, n_name AS client_name, 'INR' AS currency,
    n_nationkey % 8 = 7 AS context_broken,
    CASE WHEN n_nationkey % 8 = 7 THEN 'other'
         ELSE ['ecommerce','b2b_saas','lead_gen','app','local','other'][n_nationkey % 6 + 1] END AS business_type,
    CASE WHEN n_nationkey % 8 = 7 THEN NULL ELSE ['low','medium','high'][n_nationkey % 3 + 1] END AS anomaly_sensitivity
  FROM nation),
tags AS (
  SELECT client_id, name, tag FROM clients, (VALUES ('brand#2','brand'),('brand#3','test')) t(name, tag)
  WHERE NOT context_broken),
targets AS (
  SELECT client_id, name, target_roas, target_cpa, target_cpl
  FROM clients, (VALUES ('brand#4', 2.5::DOUBLE, 50000::DOUBLE, NULL::DOUBLE),
                        ('brand#5', NULL, NULL, 40000)) t(name, target_roas, target_cpa, target_cpl)
  WHERE NOT context_broken),
rules AS (
  SELECT client_id, 1.5::DOUBLE + (client_id % 3) * 0.5::DOUBLE AS google_min_roas,
    2.5::DOUBLE - (client_id % 3) * 0.5::DOUBLE AS meta_min_roas,
    CASE WHEN client_id % 2 = 1 THEN 60000::DOUBLE END AS google_min_cpl,
    CASE WHEN client_id % 2 = 1 THEN 60000::DOUBLE END AS meta_min_cpl,
    20::DOUBLE AS max_shift_pct
  FROM clients),
lines AS (
  SELECT client_id, quarter_start, CASE WHEN l_linestatus = 'O' THEN 'google' ELSE 'meta' END AS platform,
    p_brand AS campaign_name, p_type AS adgroup_name, p_name AS keyword_name, p_size,
    l_quantity, l_linenumber, l_returnflag, l_linestatus,
    CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(round(l_tax * 100) AS BIGINT) AS spend_units,
    CASE WHEN l_returnflag <> 'R'
         THEN CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))
         ELSE 0 END AS value_units,
    CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS converted,
    CAST(l_quantity AS BIGINT) AS clicks,
    CAST(l_quantity AS BIGINT) * (10 + l_partkey % 50) AS impressions,
    CASE WHEN l_linestatus <> 'O'
         THEN CAST(l_quantity AS BIGINT) * (10 + l_partkey % 50) * (60 // (1 + l_suppkey % 5)) END AS reach_units,
    CASE WHEN l_linestatus <> 'O' THEN 1 + l_suppkey % 5 END AS times_seen
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN client_orders USING (l_orderkey)),
raw_facts AS (
  SELECT client_id, quarter_start, platform, campaign_name,
    CAST(sum(spend_units) AS DOUBLE) / 1000 AS spend, CAST(sum(value_units) AS DOUBLE) / 10000 AS conversion_value,
    CAST(sum(converted) AS DOUBLE) AS conversions, CAST(sum(clicks) AS DOUBLE) AS clicks,
    CAST(sum(impressions) AS DOUBLE) AS impressions, CAST(sum(reach_units) AS DOUBLE) / 60 AS reach,
    round(avg(times_seen), 2) AS frequency,
    CAST(count(*) FILTER (WHERE l_linenumber <= 2) AS DOUBLE) AS new_users,
    CAST(count(*) FILTER (WHERE l_linenumber > 2) AS DOUBLE) AS returning_users
  FROM lines GROUP BY ALL),
rated_facts AS (
  SELECT *, CASE WHEN spend <> 0 THEN conversion_value / spend ELSE 0 END AS exact_roas FROM raw_facts),
campaigns AS (
  SELECT f.* EXCLUDE (exact_roas, quarter_start, client_id), u.*,
    CASE WHEN exact_roas < 1 THEN 'critical' WHEN exact_roas < 2 THEN 'warning' ELSE 'ok' END AS severity,
    round(exact_roas, 2) AS roas,
    round(CASE WHEN conversions <> 0 THEN spend / conversions ELSE 0 END, 2) AS cac,
    round(CASE WHEN impressions <> 0 THEN clicks / impressions ELSE 0 END * 100, 2) AS ctr,
    round(CASE WHEN clicks <> 0 THEN spend / clicks ELSE 0 END, 2) AS cpc,
    round(CASE WHEN spend <> 0 THEN conversions / spend ELSE 0 END * 1000, 3) AS efficiency,
    CASE WHEN exact_roas < 1 THEN spend WHEN exact_roas < 2 THEN spend * 0.5::DOUBLE ELSE 0::DOUBLE END AS wasted_spend,
    round(100::DOUBLE * (CASE WHEN new_users + returning_users <> 0 THEN new_users / (new_users + returning_users) END), 1) AS pct_new_users,
    round(CASE WHEN new_users <> 0 THEN spend / new_users END, 2) AS cost_per_new_user
  FROM rated_facts f JOIN ranked_uploads u
    ON u.upload_id = f.client_id * 1000 + (year(f.quarter_start) - 1995) * 4 + quarter(f.quarter_start)),
funnel_data AS (
  SELECT * EXCLUDE (spend), round(spend / nullif(leads, 0), 2) AS cost_per_lead,
    round(spend / nullif(mqls, 0), 2) AS cost_per_mql, round(spend / nullif(customers, 0), 2) AS cost_per_customer
  FROM (SELECT upload_id, client_id, period_start, period_end, period_label, uploaded_on, period_date, campaign_name,
          SUM4(new_users + returning_users) AS leads, SUM4(conversions) AS mqls,
          floor(SUM4(conversions) / 2) AS sqls, floor(SUM4(conversions) / 4) AS customers, SUM4(spend) AS spend
        FROM campaigns GROUP BY ALL)),
granular AS (
  SELECT client_id, platform, campaign_name, adgroup_name, keyword_name,
    CAST(sum(spend_units) AS DOUBLE) / 1000 AS spend, CAST(sum(value_units) AS DOUBLE) / 10000 AS conversion_value,
    CAST(sum(converted) AS DOUBLE) AS conversions, CAST(sum(clicks) AS DOUBLE) AS clicks,
    CAST(sum(impressions) AS DOUBLE) AS impressions, max(p_size) AS quality_score
  FROM lines GROUP BY ALL),
crm_funnel AS (
  SELECT client_id,
    CASE WHEN client_id % 2 = 0 AND adgroup_name = 'ECONOMY' THEN campaign_name
         ELSE lower(campaign_name) || ' ' || lower(adgroup_name) END AS funnel_name,
    CAST(count(*) AS DOUBLE) AS leads, CAST(sum(converted) AS DOUBLE) AS mqls,
    CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS DOUBLE) AS sqls,
    CAST(count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS DOUBLE) AS customers
  FROM lines GROUP BY ALL),
ad_sets AS (
  SELECT client_id, platform, campaign_name || ' ' || adgroup_name AS campaign_name,
    CAST(sum(spend_units) AS DOUBLE) / 1000 AS spend
  FROM lines GROUP BY ALL),
web_traffic AS (
  SELECT client_id,
    lower(campaign_name || ' ' || adgroup_name)
      || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' ' || split_part(keyword_name, ' ', 1) END AS traffic_name,
    count(*) AS sessions, count(*) FILTER (WHERE l_linenumber <= 4) AS users,
    count(*) FILTER (WHERE l_linenumber <= 2) AS new_users,
    count(*) FILTER (WHERE l_quantity > 25) AS engaged_sessions,
    round(100::DOUBLE * (count(*) - count(*) FILTER (WHERE l_quantity > 25)) / count(*), 1) AS bounce_rate,
    round(avg(CAST(l_quantity AS BIGINT)) * 10, 1) AS avg_session_duration,
    round(avg(l_linenumber), 2) AS pages_per_session,
    count(*) FILTER (WHERE l_returnflag = 'A') AS ga_conversions,
    round(CAST(sum(value_units) AS DOUBLE) / 10000, 2) AS ga_revenue
  FROM lines GROUP BY ALL),
user_events AS (
  SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, event_type,
    CAST(round(value * 100) AS BIGINT) AS cents,
    min(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3) OVER (PARTITION BY user_id) AS first_period
  FROM events),
event_facts AS (
  SELECT CAST((user_id // 20) % 25 AS BIGINT) AS client_id,
    CASE WHEN (user_id // 10) % 2 = 0 THEN 'google' ELSE 'meta' END AS platform,
    'c' || (user_id % 10) AS campaign_name, CAST(day // 3 AS BIGINT) AS period,
    CAST(count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) AS impressions,
    CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS clicks,
    CAST(count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) AS leads,
    CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS mqls,
    CAST(count(*) FILTER (WHERE event_type = 'signup') AS DOUBLE) AS sqls,
    CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS customers,
    CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS conversions,
    CAST(coalesce(sum(cents) FILTER (WHERE event_type IN ('click','view')), 0) * 4 AS DOUBLE) / 1000 AS spend,
    CAST(coalesce(sum(cents) FILTER (WHERE event_type = 'purchase'), 0) AS DOUBLE) / 100 AS conversion_value,
    count(DISTINCT (user_id, day)) AS sessions, count(DISTINCT user_id) AS users,
    count(DISTINCT user_id) FILTER (WHERE first_period = day // 3) AS new_users
  FROM user_events GROUP BY ALL)
"""


def expand_sums(sql: str) -> str:
    """``SUM4(x)`` and ``AVG4(x)``: sums and means in decimal, returned as doubles."""
    for name, text in (("SUM4", "{s}"), ("AVG4", "({s} / count({x}))")):
        while (start := sql.find(f"{name}(")) >= 0:
            depth, end = 1, start + 5
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            inner = sql[start + 5:end - 1]
            total = f"CAST(sum(CAST({inner} AS DECIMAL(38,6))) AS DOUBLE)"
            sql = sql[:start] + text.format(s=total, x=inner) + sql[end:]
    return sql


def with_views(sql: str) -> str:
    """Prefix a statement (optionally opening with further CTEs) with the model's views."""
    body = expand_sums(sql.strip())
    if body.upper().startswith("WITH "):
        return f"WITH {expand_sums(VIEWS.strip())},\n{body[5:]}"
    return f"WITH {expand_sums(VIEWS.strip())}\n{body}"
