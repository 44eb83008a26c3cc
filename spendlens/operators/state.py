"""Mutable state kept as append-only logs and anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions.guards import rnd
from spendlens.operators import alerts, history


def current_status(items: DataFrame, log: DataFrame, default: str) -> DataFrame:
    """Latest logged status per item; ``default`` for items never touched."""
    last = log.groupBy("item_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"))
    return items.join(last, "item_id", "left").withColumn("status", F.coalesce("status", F.lit(default)))


def dismiss_all(items: DataFrame, status_from: str = "new", status_to: str = "dismissed") -> DataFrame:
    """Log rows that move every item still in one status to another."""
    return items.where(F.col("status") == status_from).select("item_id", "client_id", F.lit(status_to).alias("status"))


def unread_count(items: DataFrame) -> DataFrame:
    return items.where(F.col("status") == "new").agg(F.count(F.lit(1)).alias("unread"))


def text_hash(client: Column, text: Column) -> Column:
    """Identity of an action item: client and its whole text."""
    return F.md5(F.concat(client.cast("string"), F.lit(":"), text))


def with_hash(actions: DataFrame) -> DataFrame:
    return actions.withColumn("text_hash", text_hash(F.col("client_id"), F.col("text")))


def new_action_items(actions: DataFrame, existing: DataFrame) -> DataFrame:
    """Actions not stored yet, one per (client, text hash), the first one by ``arrival``."""
    keys = ["client_id", "text_hash"]
    columns = ["text", "source", "priority", "campaign", "platform"]
    first = with_hash(actions).groupBy(*keys).agg(F.min_by(F.struct(*columns), "arrival").alias("item"))
    return first.join(existing.select(*keys), keys, "left_anti").select(*keys, "item.*", F.lit("todo").alias("status"))


def action_list(actions: DataFrame) -> DataFrame:
    """Action items per client by priority, oldest first (a distributed sort)."""
    placed = actions.withColumn("priority_order", alerts.severity_rank(F.col("priority")))
    return placed.orderBy("client_id", "priority_order", "created_on", "text_hash")


def without_uploads(rows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows of a table minus those of deleted uploads."""
    return rows.join(tombstones.select("upload_id"), "upload_id", "left_anti")


def without_snapshots(actions: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Action items with snapshots of deleted uploads cleared."""
    gone = tombstones.select(F.col("upload_id").alias("snapshot_upload_id"), F.lit(True).alias("gone"))
    cleared = F.when(F.col("gone").isNull(), F.col("snapshot_upload_id"))
    return actions.join(gone, "snapshot_upload_id", "left").withColumn("snapshot_upload_id", cleared).drop("gone")


def duplicate_uploads(incoming: DataFrame, stored_uploads: DataFrame) -> DataFrame:
    """Latest stored upload of the same client and period per incoming one; platforms do not count."""
    keys = ["client_id", "period_start", "period_end"]
    known = stored_uploads.where(F.col("period_start").isNotNull() & F.col("period_end").isNotNull())
    latest = known.groupBy(*keys).agg(F.max_by("upload_id", F.struct("uploaded_on", "upload_id")).alias("existing_upload_id"))
    return incoming.join(latest, keys)


def snapshots_when_done(done: DataFrame, uploads: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Metrics of each done item's campaign in the client's latest upload, names compared ignoring case."""
    latest = history.latest_by(uploads, ["client_id"], ["uploaded_on", "upload_id"], ["upload_id"])
    now = campaigns.join(latest, ["client_id", "upload_id"], "left_semi").select(
        "client_id", F.lower("campaign_name").alias("name_key"), F.col("platform").alias("now_platform"),
        *[F.col(m).alias(f"snapshot_{m}") for m in ("roas", "cac", "ctr", "spend")],
        F.col("upload_id").alias("snapshot_upload_id"),
    )
    matched = done.withColumn("name_key", F.lower("campaign")).join(now, ["client_id", "name_key"])
    chosen = matched.where(F.col("platform").isNull() | (F.col("platform") == F.col("now_platform")))
    measures = ["snapshot_roas", "snapshot_cac", "snapshot_ctr", "snapshot_spend", "snapshot_upload_id"]
    return chosen.groupBy("item_id", "client_id", "campaign").agg(
        F.min_by(F.struct(*measures), "now_platform").alias("snapshot")
    ).select("item_id", "client_id", "campaign", "snapshot.*")


def setup_progress(steps: DataFrame) -> DataFrame:
    """Share of setup steps a client has completed, from a log of completed steps."""
    done = F.countDistinct("step")
    return steps.groupBy("client_id").agg(
        done.alias("steps_completed"), rnd(done / fx.SETUP_STEPS * 100).cast("long").alias("pct_complete"),
        (done >= fx.SETUP_STEPS).alias("is_complete"),
    )


def keep_or_discard(experiments: DataFrame, chunk_size: int = 4096) -> DataFrame:
    """Mark each experiment that beats everything before it: higher score, or equal and faster.

    A running maximum over the experiment order, taken per chunk of ids and then over the
    chunk maxima, so no task sees all experiments. Skipped ones neither win nor count.
    """
    rank = F.struct(F.col("score").alias("score"), (-F.col("avg_time_s")).alias("speed"))
    runs = experiments.withColumn("chunk", F.floor(F.col("experiment_id") / chunk_size)).withColumn(
        "rank", F.when(~F.col("skipped"), rank)
    )
    earlier_chunks = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    best_before = runs.groupBy("chunk").agg(F.max("rank").alias("best")).select(
        "chunk", F.max("best").over(earlier_chunks).alias("best_before_chunk")
    )
    earlier = Window.partitionBy("chunk").orderBy("experiment_id").rowsBetween(Window.unboundedPreceding, -1)
    compared = runs.withColumn("best_in_chunk", F.max("rank").over(earlier)).join(best_before, "chunk")
    best = F.greatest("best_in_chunk", "best_before_chunk")
    wins = F.coalesce(F.col("rank") > best, F.lit(False))
    status = (
        F.when(F.col("skipped"), "skipped").when(best.isNull(), "baseline").when(wins, "keep").otherwise("discard")
    )
    return compared.select("experiment_id", "score", "avg_time_s", status.alias("status"))
