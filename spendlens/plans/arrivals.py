"""Streaming queries: rolling KPIs and exports arriving in a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.operators import history
from spendlens.plans.registry import query
from spendlens.plans.signals import ALERTS
from spendlens.session import shared_folder
from spendlens.sources import exports, model
from spendlens.streaming import arrivals, rolling, state


def _rolling_sql(days: int) -> str:
    return f"""
WITH e AS (SELECT CAST(ts AS DATE) AS d, event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events),
w AS (SELECT CAST(d - CAST(k AS INTEGER) AS DATE) AS window_start, event_type, c FROM e, range({days}) r(k)),
g AS (SELECT window_start, CAST(coalesce(sum(c) FILTER (WHERE event_type IN ('click', 'view')), 0) * 4 AS DOUBLE) / 1000 AS spend,
    count(*) FILTER (WHERE event_type = 'purchase') AS conversions,
    CAST(coalesce(sum(c) FILTER (WHERE event_type = 'purchase'), 0) AS DOUBLE) / 100 AS revenue FROM w GROUP BY window_start)
SELECT window_start, {days} AS days, spend, conversions, revenue, round(CASE WHEN spend <> 0 THEN revenue / spend ELSE 0 END, 2) AS roas FROM g"""


@query("rolling_kpis", _rolling_sql(7), views=False)
def rolling_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.rolling_kpis(model.table(spark, sf, "events"))


@query("rolling_kpis_30", _rolling_sql(30), views=False)
def rolling_kpis_30(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.rolling_kpis(model.table(spark, sf, "events"), 30)


@query("rolling_kpis_90", _rolling_sql(90), views=False)
def rolling_kpis_90(spark: SparkSession, sf: str) -> DataFrame:
    return rolling.rolling_kpis(model.table(spark, sf, "events"), 90)


@query("streamed_rolling_kpis", _rolling_sql(7), views=False)
def streamed_rolling_kpis(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows, kept up to date by a stream over the event files."""
    home = f"{shared_folder(spark)}/rolling/{uuid.uuid4().hex}"
    stream = spark.readStream.schema(model.SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf)
    rolling.write_daily(stream, f"{home}/daily", f"{home}/checkpoint")
    return rolling.roll(rolling.read_daily(spark, f"{home}/daily"))


@query("streamed_exports", """
SELECT client_id, upload_id, campaign_name, spend, conversion_value, conversions, roas, cac, ctr, cpc, severity, wasted_spend
FROM campaigns WHERE platform = 'google' AND spend > 0""")
def streamed_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Search-ads facts written as messy CSV exports, streamed back in and stored as facts."""
    home = f"{shared_folder(spark)}/arrivals/{uuid.uuid4().hex}"
    facts = model.campaigns(spark, sf).where("platform = 'google'")
    facts.select(
        "client_id", "upload_id", F.date_format("period_date", "dd/MM/yyyy").alias("period_start"), F.col("campaign_name").alias("Campaign"),
        F.format_number("impressions", 0).alias("Impr."), F.col("clicks").cast("string").alias("Clicks"),
        F.concat(F.lit("₹"), F.format_number("spend", 3)).alias("Cost (INR)"), F.col("conversions").cast("string").alias("Conv."),
        F.concat(F.lit("₹"), F.format_number("conversion_value", 4)).alias("Conv. value"),
    ).write.option("header", True).csv(f"{home}/inbox")
    stream = arrivals.export_stream(spark, f"{home}/inbox")
    arrivals.run_available(stream, arrivals.arrival_pipeline(f"{home}/tables"), f"{home}/checkpoint")
    return arrivals.current_facts(spark, f"{home}/tables").select(
        "client_id", "upload_id", "campaign_name", "spend", "conversion_value", "conversions", "roas", "cac", "ctr", "cpc",
        "severity", "wasted_spend",
    )


@query("streamed_replacement", """
SELECT client_id, period_date, campaign_name, spend * 2 AS spend FROM campaigns WHERE platform = 'google' AND spend > 0""")
def streamed_replacement(spark: SparkSession, sf: str) -> DataFrame:
    """Every period sent twice, the second time with doubled spend: only the second sending counts."""
    home = f"{shared_folder(spark)}/arrivals/{uuid.uuid4().hex}"
    facts = model.campaigns(spark, sf).where("platform = 'google'")
    for factor in (1, 2):
        facts.select(
            "client_id", "upload_id", F.date_format("period_date", "dd/MM/yyyy").alias("period_start"), F.col("campaign_name").alias("Campaign"),
            F.lit("1").alias("Impr."), F.lit("1").alias("Clicks"), F.format_number(F.col("spend") * factor, 3).alias("Cost (INR)"),
            F.lit("1").alias("Conv."), F.lit("1").alias("Conv. value"),
        ).write.mode("append").option("header", True).csv(f"{home}/inbox")
        stream = arrivals.export_stream(spark, f"{home}/inbox")
        arrivals.run_available(stream, arrivals.arrival_pipeline(f"{home}/tables"), f"{home}/checkpoint")
    return arrivals.current_facts(spark, f"{home}/tables").select("client_id", "period_date", "campaign_name", "spend")


@query("streamed_comparison", """
WITH f AS (SELECT client_id, platform, campaign_name, upload_id, period_date, roas, spend FROM campaigns WHERE period_date IS NOT NULL),
p AS (SELECT DISTINCT client_id, platform, campaign_name, period_date, arg_max(roas, upload_id) AS roas, arg_max(spend, upload_id) AS spend FROM f
      GROUP BY client_id, platform, campaign_name, period_date)
SELECT f.client_id, f.platform, f.campaign_name, f.upload_id, f.roas, p.roas AS prior_roas, f.spend, p.spend AS prior_spend
FROM f ASOF LEFT JOIN p ON f.client_id = p.client_id AND f.platform = p.platform AND f.campaign_name = p.campaign_name AND f.period_date > p.period_date""")
def streamed_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Each campaign next to its previous period, from facts that arrive as a stream."""
    home = f"{shared_folder(spark)}/comparison/{uuid.uuid4().hex}"
    facts = model.campaigns(spark, sf).select(*state.KEYS, "upload_id", "period_date", "roas", "spend")
    facts.write.parquet(f"{home}/facts")
    stream = state.compare_with_previous(spark.readStream.schema(facts.schema).parquet(f"{home}/facts"))
    running = stream.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{home}/out")


@query("streamed_checks", f"""
WITH {ALERTS} SELECT client_id, upload_id, campaign, platform, alert_type, severity, deviation_pct FROM kpi_alerts""")
def streamed_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts of every upload, raised as the uploads arrive: two streams of facts, each against what is stored by then."""
    home = f"{shared_folder(spark)}/checks/{uuid.uuid4().hex}"
    clients, rules = model.clients(spark, sf), model.budget_rules(spark, sf)
    facts = model.campaigns(spark, sf).withColumn("period_start", F.col("period_date"))
    facts.write.parquet(f"{home}/facts")
    arrived = spark.read.parquet(f"{home}/facts")
    middle = arrived.groupBy("client_id").agg(F.percentile_approx(F.unix_date("period_date"), 0.5).alias("middle"))
    halves = arrived.join(middle, "client_id").withColumn("later", F.coalesce(F.unix_date("period_date") > F.col("middle"), F.lit(False)))
    check = arrivals.checks_pipeline(f"{home}/tables", clients, rules, history.stored_uploads(spark, sf))

    def store_and_check(batch: DataFrame, batch_id: int) -> None:
        arrivals.write_batch(batch, f"{home}/tables", "campaigns", batch_id, by="client_id")
        check(batch, batch_id)

    for later in (False, True):
        halves.where(F.col("later") == later).drop("later", "middle").write.mode("append").parquet(f"{home}/inbox")
        stream = spark.readStream.schema(arrived.schema).parquet(f"{home}/inbox")
        arrivals.run_available(stream, store_and_check, f"{home}/checkpoint")
    return arrivals.stored_table(spark, f"{home}/tables", "kpi_alerts").select(
        "client_id", "upload_id", "campaign", "platform", "alert_type", "severity", "deviation_pct")


def _inbox(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/inbox/{uuid.uuid4().hex}"


MARKED = "CASE WHEN upload_id % 3 = 0 THEN '#' ELSE '' END || campaign_name"


@query("read_client_exports", f"""
SELECT {MARKED} AS campaign, CAST(CAST(clicks AS BIGINT) AS VARCHAR) AS clicks, CAST(CAST(impressions AS BIGINT) AS VARCHAR) AS impressions,
  CASE WHEN client_id % 2 = 0 THEN CAST(upload_id AS VARCHAR) END AS upload FROM campaigns""")
def read_client_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Exports whose files order their columns differently, some with names that start with ``#``."""
    home = _inbox(spark)
    name = F.concat(F.when(F.col("upload_id") % 3 == 0, "#").otherwise(""), "campaign_name")
    rows = model.campaigns(spark, sf).select("client_id", name.alias("campaign"), F.col("clicks").cast("long").alias("clicks"),
                                             F.col("impressions").cast("long").alias("impressions"), F.col("upload_id").alias("upload"))
    even = rows.where("client_id % 2 = 0").select("campaign", "impressions", "upload", "clicks")
    even.write.option("header", True).csv(f"{home}/even")
    rows.where("client_id % 2 <> 0").select("clicks", "campaign", "impressions").write.option("header", True).csv(f"{home}/odd")
    return exports.read_ads_csv(spark, home).select("campaign", "clicks", "impressions", "upload")


@query("read_web_export", f"""
SELECT {MARKED} AS campaign, CAST(CAST(clicks AS BIGINT) AS VARCHAR) AS sessions FROM campaigns""")
def read_web_export(spark: SparkSession, sf: str) -> DataFrame:
    """One file per client: comments, a header, rows that may start with ``#``, a closing total."""
    home = _inbox(spark)
    name = F.concat(F.when(F.col("upload_id") % 3 == 0, "#").otherwise(""), "campaign_name")
    rows = model.campaigns(spark, sf).select("client_id", F.lit(3).alias("at"), F.concat_ws(",", name, F.col("clicks").cast("long").cast("string")).alias("value"))
    extra = F.explode(F.array(*[F.struct(F.lit(at).alias("at"), F.lit(text).alias("value")) for at, text in (
        (0, "# Web analytics"), (1, "# all clients"), (2, "campaign,sessions"), (4, "Total,1"))])).alias("line")
    framed = rows.unionByName(rows.select("client_id").distinct().select("client_id", extra).select("client_id", "line.at", "line.value"))
    framed.repartition("client_id").sortWithinPartitions("client_id", "at").select("client_id", "value").write.partitionBy("client_id").text(home)
    return exports.read_web_csv(spark, home).select("campaign", "sessions")


@query("read_bulk_export", f"""
SELECT 'client ' || client_id AS client, {MARKED} AS campaign, CAST(CAST(clicks AS BIGINT) AS VARCHAR) AS clicks FROM campaigns WHERE upload_id % 5 <> 0""")
def read_bulk_export(spark: SparkSession, sf: str) -> DataFrame:
    """One export of many clients; rows without a client do not count."""
    home = _inbox(spark)
    name = F.concat(F.when(F.col("upload_id") % 3 == 0, "#").otherwise(""), "campaign_name")
    client = F.when(F.col("upload_id") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("client "), F.col("client_id")))
    model.campaigns(spark, sf).select(name.alias("campaign"), client.alias("Account Name"), F.col("clicks").cast("long").alias("clicks")).write.option(
        "header", True).csv(home)
    return exports.read_bulk(spark, home).select("client", "campaign", "clicks")


ENCODINGS = ("UTF-8", "ISO-8859-1", "UTF-16LE", "UTF-16BE")


@query("read_encoded_exports", f"""
SELECT client_id % 4 AS kind, CASE client_id % 4 WHEN 0 THEN 'અ é ' WHEN 1 THEN 'é ' ELSE 'ઊ é ' END || campaign_name AS campaign,
  CAST(CAST(clicks AS BIGINT) AS VARCHAR) AS clicks,
  CASE client_id % 4 {' '.join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENCODINGS))} END AS encoding FROM campaigns""")
def read_encoded_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Exports in four encodings in one folder; nothing but their bytes tells which file has which."""
    home = _inbox(spark)
    start = F.element_at(F.array(*[F.lit(t) for t in ("અ é ", "é ", "ઊ é ", "ઊ é ")]), F.col("kind") + 1)
    rows = model.campaigns(spark, sf).select((F.col("client_id") % 4).cast("int").alias("kind"), "campaign_name", F.col("clicks").cast("long").alias("clicks"))
    for kind, encoding in enumerate(ENCODINGS):
        rows.where(F.col("kind") == kind).select(F.concat(start, "campaign_name").alias("campaign"), "clicks", F.lit(kind).alias("kind")).write.option(
            "header", True).option("encoding", encoding).csv(f"{home}/{kind}")
    read = exports.read_ads_csv(spark, home)
    files = exports.file_encodings(spark, home)
    return read.join(files, exports.FILE).select(F.col("kind").cast("long").alias("kind"), "campaign", "clicks", "encoding")


CLIENT_COLUMNS = ("Account Name", "Advertiser", "Customer", "Team")


@query("read_bulk_by_file", f"""
SELECT CASE WHEN client_id % 4 <> 3 THEN 'client ' || client_id END AS client, CASE WHEN client_id % 4 = 3 THEN 'client ' || client_id END AS team,
  {MARKED} AS campaign, CAST(CAST(clicks AS BIGINT) AS VARCHAR) AS clicks FROM campaigns""")
def read_bulk_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """Bulk exports that name the client in different columns, and one kind that does not name it."""
    home = _inbox(spark)
    name = F.concat(F.when(F.col("upload_id") % 3 == 0, "#").otherwise(""), "campaign_name")
    rows = model.campaigns(spark, sf)
    for kind, column in enumerate(CLIENT_COLUMNS):
        cells = [F.concat(F.lit("client "), F.col("client_id")).alias(column), name.alias("campaign"), F.col("clicks").cast("long").alias("clicks")]
        rows.where(F.col("client_id") % 4 == kind).select(*cells[kind % 3:], *cells[:kind % 3]).write.option("header", True).csv(f"{home}/{kind}")
    return exports.read_bulk(spark, home).select("client", F.col("Team").alias("team"), "campaign", "clicks")
