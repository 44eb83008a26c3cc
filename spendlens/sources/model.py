"""The campaign data model, derived from the given star schema and event tables.

``campaigns`` holds one row per (client, reporting period, platform, campaign); an
``upload`` is one client's reporting period. Money is summed in whole cents so that
totals do not depend on the order in which partitions are combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.guards import count_where, ratio, rnd, total
from spendlens.operators.metrics import stored_metrics

FIRST_YEAR = 1995


# stated schemas spare a footer-reading job per table
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def _upload_id(client: Column, start: Column) -> Column:
    return (client * 1000 + (F.year(start) - FIRST_YEAR) * 4 + F.quarter(start)).cast("long")


def with_upload_columns(df: DataFrame) -> DataFrame:
    """Attach the columns of the upload that ``(client_id, quarter_start)`` stands for.

    Some uploads come without a label or without a period, as real ones do; the ordering
    date then falls back to the day of upload.
    """
    start, upload = F.col("quarter_start"), F.col("upload_id")
    has_period = upload % 11 != 0
    return (
        df.withColumn("upload_id", _upload_id(F.col("client_id"), start))
        .withColumn("period_start", F.when(has_period, start))
        .withColumn("period_end", F.when(has_period, F.date_sub(F.add_months(start, 3), 1)))
        .withColumn(
            "period_label",
            F.when(upload % 5 != 0, F.concat(F.lit("Q"), F.quarter(start), F.lit(" "), F.year(start))),
        )
        .withColumn("uploaded_on", F.date_add(start, 3))
        .withColumn("period_date", F.coalesce("period_start", "uploaded_on"))
    )


UPLOAD_COLUMNS = ["upload_id", "client_id", "period_start", "period_end", "period_label", "uploaded_on", "period_date"]


def client_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("client_id")
    )
    return orders.join(customers, "o_custkey").select(
        F.col("o_orderkey").alias("l_orderkey"),
        "client_id",
        F.trunc("o_orderdate", "quarter").alias("quarter_start"),
    )


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = client_orders(spark, sf_dir).select("client_id", "quarter_start").distinct()
    return with_upload_columns(periods).select(*UPLOAD_COLUMNS)


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One client per nation; the context is JSON text, malformed for a few of them."""
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    sensitivity = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (key % 3 + 1).cast("int"))
    business = F.element_at(
        F.array(*[F.lit(b) for b in ("ecommerce", "b2b_saas", "lead_gen", "app", "local", "other")]),
        (key % 6 + 1).cast("int"),
    )
    context = F.format_string(
        '{"business_type":"%s","anomaly_sensitivity":"%s","goal":"grow %s",'
        '"campaign_tags":{"Brand#2":"brand","Brand#3":"test"},'
        '"campaign_targets":[{"name":"Brand#4","target_roas":2.5,"target_cpa":50000},'
        '{"name":"Brand#5","target_cpl":40000}]}',
        business, sensitivity, F.lower("n_name"),
    )
    return nation.select(
        key.cast("long").alias("client_id"),
        F.col("n_name").alias("client_name"),
        F.lit("INR").alias("currency"),
        F.when(key % 8 == 7, F.concat(F.lit("legacy note for "), F.col("n_name"))).otherwise(context).alias("context"),
    )


def budget_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("client_id")
    cpl = F.when(key % 2 == 1, F.lit(60000.0))
    return clients(spark, sf_dir).select(
        "client_id",
        (1.5 + (key % 3) * 0.5).alias("google_min_roas"),
        (2.5 - (key % 3) * 0.5).alias("meta_min_roas"),
        cpl.alias("google_min_cpl"),
        cpl.alias("meta_min_cpl"),
        F.lit(20.0).alias("max_shift_pct"),
        F.lit('[{"type":"brand","keyword":"brand#1","min_roas":1.0,"min_cpl":null}]').alias("type_overrides"),
    )


def _hundredths(amount: Column) -> Column:
    """Whole hundredths of a non-negative amount with two decimals, in plain arithmetic."""
    return F.floor(amount * 100 + 0.5)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with client, period, platform and campaign/ad group/keyword names."""
    item = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_brand").alias("campaign_name"),
        F.col("p_type").alias("adgroup_name"),
        F.col("p_name").alias("keyword_name"),
        "p_size",
    )
    cents = _hundredths(F.col("l_extendedprice"))
    kept = F.col("l_returnflag") != "R"
    quantity = F.col("l_quantity").cast("long")
    views = quantity * (10 + F.col("l_partkey") % 50)
    times_seen = 1 + F.col("l_suppkey") % 5
    return (
        item.join(part, "l_partkey")
        .join(client_orders(spark, sf_dir), "l_orderkey")
        .select(
            "client_id",
            "quarter_start",
            F.when(F.col("l_linestatus") == "O", "google").otherwise("meta").alias("platform"),
            "campaign_name", "adgroup_name", "keyword_name", "p_size", "l_quantity", "l_linenumber", "l_returnflag",
            "l_linestatus",
            (cents * _hundredths(F.col("l_tax"))).alias("spend_units"),
            F.when(kept, cents * (100 - _hundredths(F.col("l_discount")))).otherwise(0).alias("value_units"),
            F.when(kept, 1).otherwise(0).alias("converted"),
            quantity.alias("clicks"),
            views.alias("impressions"),
            # 60 is divisible by every frequency 1..5, so reach stays a whole number of 1/60
            F.when(F.col("l_linestatus") != "O", views * (F.lit(60) / times_seen).cast("long")).alias("reach_units"),
            F.when(F.col("l_linestatus") != "O", times_seen).alias("times_seen"),
        )
    )


def _fact_measures() -> list[Column]:
    return [
        (F.sum("spend_units") / 1000).alias("spend"),
        (F.sum("value_units") / 10000).alias("conversion_value"),
        F.sum("converted").cast("double").alias("conversions"),
        F.sum("clicks").cast("double").alias("clicks"),
        F.sum("impressions").cast("double").alias("impressions"),
    ]


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The central fact table with its stored metrics and upload columns."""
    facts = lines(spark, sf_dir).groupBy("client_id", "quarter_start", "platform", "campaign_name").agg(
        *_fact_measures(),
        (F.sum("reach_units") / 60).alias("reach"),
        rnd(F.avg("times_seen"), 2).alias("frequency"),
        count_where(F.col("l_linenumber") <= 2).cast("double").alias("new_users"),
        count_where(F.col("l_linenumber") > 2).cast("double").alias("returning_users"),
    )
    return stored_metrics(with_upload_columns(facts).drop("quarter_start"))


def funnel_data(facts: DataFrame) -> DataFrame:
    """Stored funnel rows per upload and campaign name, with cost per stage."""
    visits = total(F.col("new_users") + F.col("returning_users"))
    converted = total("conversions")
    spend = total("spend")
    stages = {"leads": visits, "mqls": converted, "sqls": F.floor(converted / 2).cast("double"),
              "customers": F.floor(converted / 4).cast("double")}
    costs = {"cost_per_lead": "leads", "cost_per_mql": "mqls", "cost_per_customer": "customers"}
    return (
        facts.groupBy(*UPLOAD_COLUMNS, "campaign_name")
        .agg(*[value.alias(stage) for stage, value in stages.items()], spend.alias("spend"))
        .withColumns({name: rnd(ratio("spend", stage, None), 2) for name, stage in costs.items()})
        .drop("spend")
    )


def granular_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-level facts below the campaigns, in the raw export's column names."""
    return lines(spark, sf_dir).groupBy(
        "client_id", "platform", "campaign_name", "adgroup_name", "keyword_name"
    ).agg(*_fact_measures(), F.max("p_size").alias("quality_score"))


def crm_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales-funnel rows per client, named only loosely like the campaigns."""
    brand, kind = F.col("campaign_name"), F.col("adgroup_name")
    name = F.when((F.col("client_id") % 2 == 0) & (kind == "ECONOMY"), brand).otherwise(
        F.concat(F.lower(brand), F.lit(" "), F.lower(kind))
    )
    answered = F.col("l_returnflag") == "A"
    return (
        lines(spark, sf_dir)
        .select("client_id", name.alias("funnel_name"), "converted", "l_returnflag", "l_linestatus")
        .groupBy("client_id", "funnel_name")
        .agg(
            F.count(F.lit(1)).cast("double").alias("leads"),
            F.sum("converted").cast("double").alias("mqls"),
            count_where(answered).cast("double").alias("sqls"),
            count_where(answered & (F.col("l_linestatus") == "F")).cast("double").alias("customers"),
        )
    )


def ad_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns named ``brand type`` with total spend: the ad side of the web-traffic join."""
    return lines(spark, sf_dir).groupBy(
        "client_id", "platform", F.concat_ws(" ", "campaign_name", "adgroup_name").alias("campaign_name")
    ).agg((F.sum("spend_units") / 1000).alias("spend"))


def web_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web-analytics rows per client; every third carries just the campaign, others a suffix."""
    suffix = F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit(" "), F.split("keyword_name", " ").getItem(0))
    )
    name = F.concat(F.lower(F.concat_ws(" ", "campaign_name", "adgroup_name")), suffix)
    engaged = count_where(F.col("l_quantity") > 25)
    sessions = F.count(F.lit(1))
    return (
        lines(spark, sf_dir)
        .select("client_id", name.alias("traffic_name"), "l_quantity", "l_linenumber", "l_returnflag", "value_units")
        .groupBy("client_id", "traffic_name")
        .agg(
            sessions.cast("long").alias("sessions"),
            count_where(F.col("l_linenumber") <= 4).alias("users"),
            count_where(F.col("l_linenumber") <= 2).alias("new_users"),
            engaged.alias("engaged_sessions"),
            rnd(100.0 * (sessions - engaged) / sessions, 1).alias("bounce_rate"),
            rnd(F.avg(F.col("l_quantity").cast("long")) * 10, 1).alias("avg_session_duration"),
            rnd(F.avg("l_linenumber"), 2).alias("pages_per_session"),
            count_where(F.col("l_returnflag") == "A").alias("ga_conversions"),
            rnd(F.sum("value_units") / 10000, 2).alias("ga_revenue"),
        )
    )


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign facts over three-day periods from the event stream."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    kind, cents = F.col("event_type"), _hundredths(F.col("value"))

    def events_of(name: str) -> Column:
        return count_where(kind == name)

    daily = (
        table(spark, sf_dir, "events")
        .select("user_id", "event_type", "value", day.alias("day"))
        .groupBy("user_id", "day")
        .agg(
            events_of("view").alias("views"), events_of("click").alias("clicks"),
            events_of("signup").alias("signups"), events_of("purchase").alias("purchases"),
            F.sum(F.when(kind.isin("click", "view"), cents).otherwise(0)).alias("cost_cents"),
            F.sum(F.when(kind == "purchase", cents).otherwise(0)).alias("value_cents"),
        )
    )
    user = F.col("user_id")
    first_period = daily.groupBy("user_id").agg(F.floor(F.min("day") / 3).alias("first_period"))
    per_user = daily.withColumn("period", F.floor(F.col("day") / 3)).groupBy("user_id", "period").agg(
        F.count(F.lit(1)).alias("sessions"),
        *[F.sum(c).alias(c) for c in ("views", "clicks", "signups", "purchases", "cost_cents", "value_cents")],
    )
    return (
        per_user.join(first_period, "user_id")
        .groupBy(
            (F.floor(user / 20) % 25).cast("long").alias("client_id"),
            F.when(F.floor(user / 10) % 2 == 0, "google").otherwise("meta").alias("platform"),
            F.concat(F.lit("c"), (user % 10).cast("string")).alias("campaign_name"),
            F.col("period").cast("long").alias("period"),
        )
        .agg(
            F.sum("views").cast("double").alias("impressions"),
            F.sum("clicks").cast("double").alias("clicks"),
            F.sum("views").cast("double").alias("leads"),
            F.sum("clicks").cast("double").alias("mqls"),
            F.sum("signups").cast("double").alias("sqls"),
            F.sum("purchases").cast("double").alias("customers"),
            F.sum("purchases").cast("double").alias("conversions"),
            (F.sum("cost_cents") * 4 / 1000).alias("spend"),
            (F.sum("value_cents") / 100).alias("conversion_value"),
            F.sum("sessions").cast("long").alias("sessions"),
            F.count(F.lit(1)).cast("long").alias("users"),
            count_where(F.col("period") == F.col("first_period")).alias("new_users"),
        )
    )
