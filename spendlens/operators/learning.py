"""Benchmarks from a client's own history and outcomes of completed actions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.guards import rnd
from spendlens.functions.medians import exact_medians
from spendlens.operators import history

BENCHMARKED = ["roas", "cpc", "cac", "ctr", "spend"]


def client_benchmarks(campaigns: DataFrame) -> DataFrame:
    """Exact medians per client and platform over all uploads with spend."""
    rows = campaigns.where(F.col("roas").isNotNull() & (F.col("spend") > 0))
    keys = ["client_id", "platform"]
    seen = rows.groupBy(*keys).agg(F.countDistinct("upload_id").alias("uploads_seen"))
    return exact_medians(rows, keys, BENCHMARKED).join(seen, keys)


def client_benchmarks_approx(campaigns: DataFrame, accuracy: int = 10000) -> DataFrame:
    """Sketch-based variant for very large histories: one pass, bounded error."""
    rows = campaigns.where(F.col("roas").isNotNull() & (F.col("spend") > 0))
    return rows.groupBy("client_id", "platform").agg(
        *[F.percentile_approx(c, 0.5, accuracy).alias(f"median_{c}") for c in BENCHMARKED],
        F.countDistinct("upload_id").alias("uploads_seen"),
    )


def outcome_signals(done: DataFrame, campaigns: DataFrame, tracked: DataFrame) -> DataFrame:
    """Before/after per metric for done items whose campaign shows up in a new upload.

    ``done``: action_item_id, client_id, campaign, platform (may be null), snapshot_* and
    snapshot_upload_id; ``tracked``: action_item_id already evaluated.
    """
    fresh = done.where(F.col("snapshot_upload_id").isNotNull() & F.col("campaign").isNotNull()).join(
        tracked.select("action_item_id").distinct(), "action_item_id", "left_anti"
    )
    now = campaigns.select(
        "client_id", F.col("campaign_name").alias("campaign"), F.col("platform").alias("now_platform"),
        F.col("upload_id").alias("upload_id_after"), *[F.col(m).alias(f"now_{m}") for m in ("roas", "cac", "ctr")],
    )
    found = fresh.join(now, ["client_id", "campaign"]).where(
        F.col("platform").isNull() | (F.col("platform") == F.col("now_platform"))
    )

    def check(metric: str, better: Column) -> Column:
        before, after = F.col(f"snapshot_{metric}"), F.col(f"now_{metric}")
        return F.when(before.isNotNull() & after.isNotNull(), F.struct(
            F.lit(metric).alias("metric"), before.alias("value_before"), after.alias("value_after"), better.alias("improved")
        ))

    checks = [
        check("roas", F.col("now_roas") > F.col("snapshot_roas")),
        check("cac", F.col("now_cac") < F.col("snapshot_cac")),
        check("ctr", F.col("now_ctr") > F.col("snapshot_ctr")),
    ]
    return found.select(
        "client_id", "action_item_id", "campaign", F.col("now_platform").alias("platform"),
        F.explode(F.array_compact(F.array(*checks))).alias("check"),
        F.col("snapshot_upload_id").alias("upload_id_before"), "upload_id_after",
    ).select("client_id", "action_item_id", "campaign", "platform", "check.*", "upload_id_before", "upload_id_after")


def with_uploads_until(items: DataFrame, uploads: DataFrame, day: str) -> DataFrame:
    """Add how many of the client's uploads happened up to ``day`` of each item.

    An as-of count over distinct days: uploads per day are accumulated per client and year,
    yearly totals give the offset, and items look their day up. No item meets every upload of
    its client and no task holds more than the days of a year.
    """
    per_day = uploads.groupBy("client_id", F.col("uploaded_on").alias("on_day")).agg(F.count(F.lit(1)).alias("n"))
    asked = items.select("client_id", F.col(day).alias("on_day"), F.lit(0).cast("long").alias("n")).distinct()
    days = per_day.unionByName(asked).groupBy("client_id", "on_day").agg(F.sum("n").alias("n"))
    by_year = days.withColumn("on_year", F.year("on_day"))
    within = Window.partitionBy("client_id", "on_year").orderBy("on_day").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("client_id").orderBy("on_year").rowsBetween(Window.unboundedPreceding, -1)
    years = by_year.groupBy("client_id", "on_year").agg(F.sum("n").alias("in_year")).select(
        "client_id", "on_year", F.coalesce(F.sum("in_year").over(earlier), F.lit(0)).alias("before"),
        F.sum("in_year").over(Window.partitionBy("client_id")).alias("uploads_total"),
    )
    counted = by_year.withColumn("in_year", F.sum("n").over(within)).join(years, ["client_id", "on_year"]).select(
        "client_id", F.col("on_day").alias(day), (F.col("in_year") + F.col("before")).alias("uploads_until"), "uploads_total"
    )
    return items.join(counted, ["client_id", day])


def action_impact(items: DataFrame, uploads: DataFrame, campaigns: DataFrame, as_of: date, later_uploads: int = 5) -> DataFrame:
    """Metrics after an action was done against its snapshot, in the last of the first ``later_uploads``
    uploads after it (five uploads are about as long as an action's effect can be told from others)."""
    placed = with_uploads_until(items.where(F.col("done_on").isNotNull() & F.col("campaign").isNotNull()), uploads, "done_on")
    later = F.least(F.lit(later_uploads), F.col("uploads_total") - F.col("uploads_until"))
    placed = placed.withColumn("uploads_after", later).where(F.col("uploads_after") > 0).withColumn(
        "upload_rank", F.col("uploads_until") + F.col("uploads_after")
    )
    ranked = history.rank_uploads(uploads, "uploaded_on").select(
        "client_id", "upload_rank", F.col("upload_id").alias("upload_id_after")
    )
    now = campaigns.select(
        F.col("upload_id").alias("upload_id_after"), F.lower("campaign_name").alias("name_key"),
        F.col("platform").alias("now_platform"), *[F.col(m).alias(f"now_{m}") for m in ("roas", "cac", "ctr", "spend")],
    )
    found = (
        placed.join(ranked, ["client_id", "upload_rank"])
        .withColumn("name_key", F.lower("campaign"))
        .join(now, ["upload_id_after", "name_key"])
        .where(F.col("platform").isNull() | (F.col("platform") == F.col("now_platform")))
    )

    def change(metric: str) -> Column:
        base = F.nullif(F.col(f"snapshot_{metric}"), F.lit(0.0))
        return rnd((F.col(f"now_{metric}") - base) / base * 100, 1).alias(f"{metric}_delta")

    return found.select(
        "action_item_id", "client_id", "campaign", F.col("now_platform").alias("platform"), "upload_id_after",
        F.datediff(F.lit(as_of), "done_on").cast("long").alias("days_elapsed"), F.col("uploads_after").cast("long").alias("uploads_after"),
        *[F.col(f"now_{m}").alias(f"current_{m}") for m in ("roas", "cac", "ctr", "spend")],
        *[change(m) for m in ("roas", "cac", "ctr")],
    )
