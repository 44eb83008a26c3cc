"""Status logs, action items, duplicates, deletions and experiment bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.operators import state
from spendlens.plans.health import AUDIT, audit_checks_of
from spendlens.plans.planning import DONE, done_items
from spendlens.plans.registry import query
from spendlens.session import stored
from spendlens.sources import model

# one alert per user of the event stream; some event types change its status
STATUS_OF = {"click": "viewed", "purchase": "resolved", "error": "dismissed"}
STATUS = """
items AS (SELECT DISTINCT user_id AS item_id, CAST((user_id // 20) % 25 AS BIGINT) AS client_id FROM events),
log AS (SELECT user_id AS item_id, event_id, ts, CASE event_type WHEN 'click' THEN 'viewed' WHEN 'purchase' THEN 'resolved'
    WHEN 'error' THEN 'dismissed' END AS status FROM events WHERE event_type IN ('click', 'purchase', 'error')),
status AS (SELECT item_id, client_id, coalesce(s, 'new') AS status FROM items
  LEFT JOIN (SELECT item_id, arg_max(status, (ts, event_id)) AS s FROM log GROUP BY item_id) USING (item_id))"""


def item_status(spark: SparkSession, sf: str) -> DataFrame:
    events = model.table(spark, sf, "events")
    items = events.select(
        F.col("user_id").alias("item_id"), (F.floor(F.col("user_id") / 20) % 25).cast("long").alias("client_id")
    ).distinct()
    status = F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])[F.col("event_type")]
    log = events.where(F.col("event_type").isin(*STATUS_OF)).select(
        F.col("user_id").alias("item_id"), "event_id", F.col("ts").alias("at"), status.alias("status")
    )
    return state.current_status(items, log, "new")


@query("current_status", f"WITH {STATUS} SELECT * FROM status")
def current_status(spark: SparkSession, sf: str) -> DataFrame:
    return item_status(spark, sf)


@query("dismiss_all", f"WITH {STATUS} SELECT item_id, client_id, 'dismissed' AS status FROM status WHERE status = 'new'")
def dismiss_all(spark: SparkSession, sf: str) -> DataFrame:
    return state.dismiss_all(item_status(spark, sf))


@query("unread_alerts", f"WITH {STATUS} SELECT count(*) AS unread FROM status WHERE status = 'new'")
def unread_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return state.unread_count(item_status(spark, sf))


PROPOSED = f"""{AUDIT},
proposed AS (SELECT client_id, action AS text, priority, campaign, platform, upload_id,
    md5(client_id || ':' || action) AS text_hash,
    upload_id = max(upload_id) OVER (PARTITION BY client_id) AS is_latest, (upload_id, platform, check_order) AS arrival
  FROM checks WHERE status <> 'pass' AND action IS NOT NULL)"""


def _proposed(spark: SparkSession, sf: str) -> DataFrame:
    checks = audit_checks_of(spark, sf)
    return stored(checks.where((F.col("status") != "pass") & F.col("action").isNotNull()).select(
        "client_id", "upload_id", F.col("action").alias("text"), F.lit("structured_audit").alias("source"), "priority",
        "campaign", "platform", F.struct("upload_id", "platform", "check_order").alias("arrival"),
    ))


@query("new_action_items", f"""
WITH {PROPOSED}
SELECT client_id, text_hash, arg_min(text, arrival) AS text, 'structured_audit' AS source, arg_min(priority, arrival) AS priority,
  arg_min(coalesce(campaign, '-'), arrival) AS campaign, arg_min(platform, arrival) AS platform, 'todo' AS status
FROM proposed p WHERE is_latest
  AND (client_id, text_hash) NOT IN (SELECT (client_id, text_hash) FROM proposed WHERE NOT is_latest)
GROUP BY client_id, text_hash""")
def new_action_items(spark: SparkSession, sf: str) -> DataFrame:
    proposed = _proposed(spark, sf)
    newest = proposed.groupBy("client_id").agg(F.max("upload_id").alias("newest"))
    marked = proposed.join(newest, "client_id")
    existing = state.with_hash(marked.where("upload_id < newest")).select("client_id", "text_hash").distinct()
    found = state.new_action_items(marked.where("upload_id = newest"), existing)
    return found.withColumn("campaign", F.coalesce("campaign", F.lit("-")))


@query("action_list", f"""
WITH {PROPOSED}, firsts AS (SELECT client_id, text_hash, arg_min(text, arrival) AS text, arg_min(priority, arrival) AS priority,
    min(upload_id) AS created_on FROM proposed GROUP BY client_id, text_hash)
SELECT client_id, text_hash, text, priority, created_on,
  CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS priority_order FROM firsts""")
def action_list(spark: SparkSession, sf: str) -> DataFrame:
    first = state.with_hash(_proposed(spark, sf)).groupBy("client_id", "text_hash").agg(
        F.min_by("text", "arrival").alias("text"), F.min_by("priority", "arrival").alias("priority"),
        F.min("upload_id").alias("created_on"),
    )
    return state.action_list(first)


@query("without_deleted_uploads", """
SELECT client_id, upload_id, platform, campaign_name, spend FROM campaigns WHERE upload_id % 7 <> 0""")
def without_deleted_uploads(spark: SparkSession, sf: str) -> DataFrame:
    deleted = model.uploads(spark, sf).where(F.col("upload_id") % 7 == 0)
    kept = state.without_uploads(model.campaigns(spark, sf), deleted)
    return kept.select("client_id", "upload_id", "platform", "campaign_name", "spend")


@query("cleared_snapshots", f"""
WITH {DONE} SELECT action_item_id, client_id, campaign,
  CASE WHEN snapshot_upload_id % 7 <> 0 THEN snapshot_upload_id END AS snapshot_upload_id FROM done""")
def cleared_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    deleted = model.uploads(spark, sf).where(F.col("upload_id") % 7 == 0)
    cleared = state.without_snapshots(done_items(model.campaigns(spark, sf)), deleted)
    return cleared.select("action_item_id", "client_id", "campaign", "snapshot_upload_id")


@query("duplicate_uploads", """
SELECT upload_id + 500 AS upload_id, client_id, period_start, period_end, upload_id AS existing_upload_id
FROM uploads WHERE period_start IS NOT NULL""")
def duplicate_uploads(spark: SparkSession, sf: str) -> DataFrame:
    known = model.uploads(spark, sf)
    incoming = known.where(F.col("period_start").isNotNull()).select(
        (F.col("upload_id") + 500).alias("upload_id"), "client_id", "period_start", "period_end"
    )
    return state.duplicate_uploads(incoming, known)


@query("snapshots_when_done", f"""
WITH {DONE}
SELECT action_item_id AS item_id, d.client_id, campaign, arg_min(c.roas, c.platform) AS snapshot_roas,
  arg_min(c.cac, c.platform) AS snapshot_cac, arg_min(c.ctr, c.platform) AS snapshot_ctr,
  arg_min(c.spend, c.platform) AS snapshot_spend, arg_min(c.upload_id, c.platform) AS snapshot_upload_id
FROM done d JOIN campaigns c ON c.client_id = d.client_id AND lower(c.campaign_name) = lower(d.campaign)
  AND c.upload_rank = c.upload_count AND (d.platform IS NULL OR d.platform = c.platform) GROUP BY ALL""")
def snapshots_when_done(spark: SparkSession, sf: str) -> DataFrame:
    facts = stored(model.campaigns(spark, sf))
    done = done_items(facts).select(F.col("action_item_id").alias("item_id"), "client_id", "campaign", "platform")
    return state.snapshots_when_done(done, model.uploads(spark, sf), facts)


@query("setup_progress", """
SELECT CAST((user_id // 20) % 25 AS BIGINT) AS client_id, count(DISTINCT event_type) AS steps_completed,
  CAST(round(count(DISTINCT event_type) / 6 * 100) AS BIGINT) AS pct_complete, count(DISTINCT event_type) >= 6 AS is_complete
FROM events GROUP BY 1""")
def setup_progress(spark: SparkSession, sf: str) -> DataFrame:
    steps = model.table(spark, sf, "events").select(
        (F.floor(F.col("user_id") / 20) % 25).cast("long").alias("client_id"), F.col("event_type").alias("step")
    )
    return state.setup_progress(steps)


EXPERIMENTS = """
SELECT user_id AS experiment_id, count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS score,
  round(avg(CAST(round(value * 100) AS BIGINT)) / 100, 1) AS avg_time_s, user_id % 9 = 8 AS skipped FROM events GROUP BY user_id"""


@query("experiment_log", f"""
WITH e AS ({EXPERIMENTS}), r AS (SELECT *, CASE WHEN NOT skipped THEN {{'s': score, 't': -avg_time_s}} END AS k FROM e),
b AS (SELECT *, max(k) OVER (ORDER BY experiment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r)
SELECT experiment_id, score, avg_time_s, CASE WHEN skipped THEN 'skipped' WHEN best IS NULL THEN 'baseline'
  WHEN k > best THEN 'keep' ELSE 'discard' END AS status FROM b""")
def experiment_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's events stand for one experiment: successes as score, mean value as time."""
    cents = F.round(F.col("value") * 100).cast("long")
    experiments = model.table(spark, sf, "events").groupBy(F.col("user_id").alias("experiment_id")).agg(
        state.rnd(F.avg(cents) / 100, 1).alias("avg_time_s"),
        F.sum(F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0)).cast("long").alias("score"),
    ).withColumn("skipped", F.col("experiment_id") % 9 == 8)
    return state.keep_or_discard(experiments, chunk_size=64)
