"""Cross-client reports and the row selections behind written summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions import formatting as fmt
from spendlens.functions.guards import mean, present, ratio, rnd, total, zero_if_null
from spendlens.operators import anomalies as anomaly_ops
from spendlens.operators import history
from spendlens.operators.dashboard import ranked_within


def severity_place(severity: Column | str) -> Column:
    severity = F.col(severity) if isinstance(severity, str) else severity
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)


def budget_health(roas: Column, floor: Column) -> Column:
    return F.when(roas >= floor * 1.2, "Good").when(roas >= floor * 0.8, "Warning").otherwise("Critical")


def bulk_report(campaigns: DataFrame, uploads: DataFrame, clients: DataFrame, rules: DataFrame,
                open_anomalies: DataFrame) -> DataFrame:
    """One row per client with uploads: its latest period, open anomalies and budget health."""
    latest = history.latest_by(uploads, ["client_id"], ["period_date", "upload_id"], ["upload_id", "period_label"])
    sums = campaigns.join(latest.select("client_id", "upload_id"), ["client_id", "upload_id"], "left_semi").groupBy(
        "client_id", "upload_id", F.coalesce("period_label", F.col("period_date").cast("string")).alias("period")
    ).agg(
        total("spend").alias("spend"), total("conversion_value").alias("revenue"),
        F.countDistinct("campaign_name").alias("campaign_count"),
    )
    counts = open_anomalies.groupBy("client_id").agg(F.count(F.lit(1)).alias("open_anomalies"))
    floor = F.coalesce(F.least(present("google_min_roas"), present("meta_min_roas")), F.lit(fx.DEFAULT_MIN_ROAS))
    roas = ratio("revenue", "spend")
    return (
        sums.join(clients.select("client_id", "client_name", "currency"), "client_id")
        .join(rules, "client_id", "left")
        .join(counts, "client_id", "left")
        .select(
            "client_id", "client_name", "currency", "upload_id", "period",
            rnd("spend", 2).alias("total_spend"), rnd("revenue", 2).alias("total_revenue"),
            rnd(roas, 2).alias("blended_roas"), "campaign_count",
            F.coalesce("open_anomalies", F.lit(0)).alias("open_anomalies"),
            budget_health(roas, floor).alias("budget_health"),
        )
    )


def health_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("budget_health").agg(F.count(F.lit(1)).alias("clients"), rnd(total("total_spend"), 2).alias("spend"))


def overview(campaigns: DataFrame, clients: DataFrame, audits: DataFrame, open_anomalies: DataFrame) -> DataFrame:
    """Health row per client: latest upload, last audit day, open anomalies and status."""
    per_upload = campaigns.groupBy("client_id", "upload_id", "period_label", "uploaded_on").agg(
        mean("roas").alias("roas"), total("spend").alias("spend"), F.countDistinct("campaign_name").alias("campaign_count")
    )
    latest = history.latest_by(
        per_upload, ["client_id"], ["uploaded_on", "upload_id"], ["period_label", "roas", "spend", "campaign_count"]
    )
    audited = audits.groupBy("client_id").agg(F.max("created_on").alias("last_audit"))
    found = anomaly_ops.anomaly_summary(open_anomalies, "client_id")
    critical, warning = F.coalesce("critical", F.lit(0)), F.coalesce("warning", F.lit(0))
    return (
        clients.select("client_id", "client_name", "currency")
        .join(latest, "client_id", "left").join(audited, "client_id", "left").join(found, "client_id", "left")
        .select(
            "client_id", "client_name", "currency", "last_audit", F.col("period_label").alias("last_period"),
            rnd(zero_if_null("roas"), 2).alias("last_roas"), rnd(zero_if_null("spend")).alias("total_spend"),
            F.coalesce("campaign_count", F.lit(0)).alias("campaign_count"), critical.alias("anomaly_critical"),
            warning.alias("anomaly_warning"), F.coalesce("total", F.lit(0)).alias("anomaly_total"),
            F.when(critical > 0, "critical").when(warning > 0, "warning").otherwise("healthy").alias("status"),
        )
    )


def morning_brief(anomalies: DataFrame, per_client: int = 3) -> DataFrame:
    """The most severe anomalies per client with the client's counts, worst first."""
    order = [severity_place("severity"), F.desc(F.abs("pct_change")), F.asc("campaign_name"), F.asc("platform"), F.asc("metric")]
    picked = ranked_within(anomalies, ["client_id"], order, per_client)
    counts = anomaly_ops.anomaly_summary(anomalies, "client_id")
    worst = F.when(F.col("critical") > 0, "critical").when(F.col("warning") > 0, "warning").otherwise("ok")
    line = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("campaign_name"), F.lit(" ("), F.col("platform"),
                    F.lit(") - "), F.col("description"))
    return picked.join(counts, "client_id").select(
        "client_id", "position", "critical", "warning", worst.alias("worst_severity"), line.alias("line")
    )


def brief_text(anomalies: DataFrame, limit: int = 5) -> DataFrame:
    """One sentence list per client: count, top descriptions and how many more there are."""
    order = [severity_place("severity"), F.desc(F.abs("pct_change")), F.asc("campaign_name"), F.asc("platform"), F.asc("metric")]
    top = ranked_within(anomalies, ["client_id"], order, limit).groupBy("client_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "description"))).alias("top")
    )
    counts = anomalies.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    noun = F.when(n == 1, " anomaly detected.").otherwise(" anomalys detected.")
    more = F.when(n > limit, F.concat(F.lit("...and "), (n - limit).cast("string"), F.lit(" more.")))
    lines = F.array_join(F.transform("top", lambda t: F.concat(t["description"], F.lit("."))), " ")
    return counts.join(top, "client_id").select(
        "client_id", F.concat_ws(" ", F.concat(n.cast("string"), noun), lines, more).alias("brief")
    )


def narrative_campaigns(campaigns: DataFrame, limit: int = 3) -> DataFrame:
    """Per upload and platform: the best healthy and the worst critical campaigns."""
    role = F.when(F.col("severity") == "ok", "top").when(F.col("severity") == "critical", "worst")
    key = F.when(F.col("role") == "top", -F.col("roas")).otherwise(F.col("roas"))
    rows = campaigns.withColumn("role", role).where(F.col("role").isNotNull())
    return ranked_within(rows, ["upload_id", "platform", "role"], [key, F.asc("campaign_name")], limit).select(
        "client_id", "upload_id", "platform", "role", "position", "campaign_name", "roas", "spend"
    )


def underperformers(campaigns: DataFrame) -> DataFrame:
    """Critical and warning campaigns per upload; critical first, then by ROAS."""
    return campaigns.where(F.col("severity").isin("critical", "warning")).select(
        "client_id", "upload_id", "platform", "campaign_name", "severity",
        severity_place("severity").alias("severity_order"), "roas", "spend", "wasted_spend",
    )


def open_anomaly_context(anomalies: DataFrame, limit: int = 10) -> DataFrame:
    """Newest open anomalies per client, by rank of severity first."""
    order = [severity_place("severity"), F.desc("period_date"), F.desc("upload_id"), F.asc("campaign_name"),
             F.asc("platform"), F.asc("metric")]
    return ranked_within(anomalies, ["client_id"], order, limit).select(
        "client_id", "position", "upload_id", "campaign_name", "platform", "metric", "severity", "pct_change"
    )


def benchmark_lines(benchmarks: DataFrame) -> DataFrame:
    """One formatted line per platform with enough history."""
    parts = [
        F.concat(F.lit("  "), F.upper("platform"), F.lit(" ("), F.col("uploads_seen").cast("string"), F.lit(" uploads):")),
        F.concat(F.lit("median ROAS "), fmt.decimals("median_roas", 2), F.lit("x")),
        F.concat(F.lit("median CPC "), fmt.decimals("median_cpc", 0)),
        F.concat(F.lit("median CAC "), fmt.decimals("median_cac", 0)),
        F.concat(F.lit("median CTR "), fmt.decimals("median_ctr", 2), F.lit("%")),
    ]
    return benchmarks.where(F.col("uploads_seen") >= 2).select("client_id", "platform", F.concat_ws(", ", *parts).alias("line"))
