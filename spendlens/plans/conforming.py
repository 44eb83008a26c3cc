"""Cleaning, conforming and source-detection queries over exports rendered from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions import dates, numbers
from spendlens.functions.guards import rnd
from spendlens.operators import cleaning, funnel, metrics
from spendlens.operators import columns as headers
from spendlens.plans.enrichment import raw_keywords
from spendlens.plans.registry import query
from spendlens.sources import detect, exports, model, sinks


def _variant(key: Column, choices: list[Column]) -> Column:
    out = choices[-1]
    for i in reversed(range(len(choices) - 1)):
        out = F.when(key % len(choices) == i, choices[i]).otherwise(out)
    return out


MESSY = """m AS (SELECT l_orderkey AS k, l_extendedprice AS x, l_tax AS tax FROM lineitem)"""


@query("clean_numeric", f"""
WITH {MESSY} SELECT k, CASE k % 10 WHEN 0 THEN x WHEN 1 THEN x WHEN 2 THEN CAST(printf('%.5f', x / 1000) AS DOUBLE) * 1000
  WHEN 3 THEN 0 WHEN 4 THEN round(tax * 100) WHEN 5 THEN 0 WHEN 6 THEN CAST(printf('%.7f', x / 100000) AS DOUBLE) * 100000
  WHEN 7 THEN CAST(printf('%.9f', x / 10000000) AS DOUBLE) * 10000000 WHEN 8 THEN 5 ELSE 0 END AS value,
  k % 10 <> 1 AS changed FROM m""", views=False)
def clean_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Prices written as currency, plain, K, L, Cr, percent, null words and junk."""
    x, tax = F.col("l_extendedprice"), F.col("l_tax")
    cell = _variant(F.col("l_orderkey"), [
        F.concat(F.lit(" ₹"), F.format_number(x, 2)), F.format_string("%.2f", x),
        F.concat(F.format_string("%.5f", x / 1000), F.lit("K")), F.lit("--"),
        F.concat(F.format_string("%.0f", F.round(tax * 100)), F.lit("%")), F.lit("abc"),
        F.concat(F.format_string("%.7f", x / 100000), F.lit("L")), F.concat(F.format_string("%.9f", x / 10000000), F.lit(" Cr")),
        F.lit("5c"), F.lit("N/A"),
    ])
    rows = model.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), cell.alias("cell"))
    return rows.select("k", numbers.numeric_cell("cell").alias("cell")).select("k", "cell.value", "cell.changed")


DATE_FILES = "CASE l_returnflag WHEN 'R' THEN 'us.csv' ELSE l_returnflag || '.csv' END"


@query("normalize_dates", f"""
SELECT {DATE_FILES} AS source_file, l_orderkey AS k, CASE l_orderkey % 11 WHEN 10 THEN 'soon'
  WHEN 8 THEN CASE WHEN l_shipdate >= TIMESTAMP '2000-01-01' THEN strftime(l_shipdate, '%Y-%m-%d')
    ELSE CAST(date_diff('day', DATE '1899-12-30', CAST(l_shipdate AS DATE)) AS VARCHAR) END
  ELSE strftime(l_shipdate, '%Y-%m-%d') END AS day,
  l_orderkey % 11 NOT IN (0, 10) AND NOT (l_orderkey % 11 = 8 AND l_shipdate < TIMESTAMP '2000-01-01') AS changed
FROM lineitem""", views=False)
def normalize_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Ship dates in ten notations; the order of day and month differs between files."""
    d = F.col("l_shipdate")
    us = F.col("l_returnflag") == "R"

    def ordered(sep: str, year: str) -> Column:
        return F.when(us, F.date_format(d, f"MM{sep}dd{sep}{year}")).otherwise(F.date_format(d, f"dd{sep}MM{sep}{year}"))

    named = F.date_format(d, "MMM dd, yyyy")
    cell = _variant(F.col("l_orderkey"), [
        F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyyMMdd"), ordered("/", "yyyy"), ordered("-", "yy"),
        F.date_format(d, "d-MMM-yyyy"), named, F.date_format(d, "yyyy-MMM-dd"), F.concat(named, F.lit(" - "), named),
        F.datediff(d.cast("date"), F.lit(fx.EXCEL_EPOCH).cast("date")).cast("string"), ordered(" ", "yyyy"), F.lit("soon"),
    ])
    rows = model.table(spark, sf, "lineitem").select(
        F.when(us, "us.csv").otherwise(F.concat("l_returnflag", F.lit(".csv"))).alias(exports.FILE),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias(exports.ORDINAL), F.col("l_orderkey").alias("k"), cell.alias("day"),
    )
    cleaned = cleaning.normalize_dates(rows, exports.FILE, exports.ORDINAL)
    return cleaned.select(exports.FILE, "k", "day", F.col("changed day").alias("changed"))


@query("period_labels", """
WITH d AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT k, CASE k % 9 WHEN 0 THEN CAST(date_trunc('quarter', d) AS DATE) WHEN 1 THEN CAST(date_trunc('quarter', d) AS DATE)
  WHEN 2 THEN make_date(year(d), CASE WHEN month(d) <= 6 THEN 1 ELSE 7 END, 1) WHEN 3 THEN make_date(year(d), 4, 1)
  WHEN 4 THEN make_date(year(d), 4, 1) WHEN 5 THEN make_date(year(d), 4, 1) WHEN 6 THEN CAST(date_trunc('week', d) AS DATE)
  WHEN 7 THEN CAST(date_trunc('month', d) AS DATE) ELSE CAST(date_trunc('month', d) AS DATE) END AS period_start FROM d""", views=False)
def period_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    year, quarter = F.year(d), F.quarter(d)
    half = F.when(F.month(d) <= 6, 1).otherwise(2)
    label = _variant(F.col("o_orderkey"), [
        F.concat(F.lit("Q"), quarter, F.lit(" "), year), F.concat(year, F.lit("-q"), quarter), F.concat(F.lit("H"), half, F.lit("/"), year),
        F.concat(F.lit("FY"), year), F.concat(F.lit("FY "), F.right(year.cast("string"), F.lit(2))),
        F.concat(F.lit("FY"), year, F.lit("-"), F.right((year + 1).cast("string"), F.lit(2))),
        F.concat(F.lit("Week "), F.weekofyear(d), F.lit(" "), F.extract(F.lit("YEAROFWEEK"), d.cast("date"))),
        F.date_format(d, "MMM yyyy"), F.date_format(d, "yyyy-MMMM"),
    ])
    return model.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), dates.period_start(label).alias("period_start"))


ORDERED_RAW = """raw AS (SELECT l_returnflag || '.csv' AS source_file, l_orderkey, l_linenumber, p_brand, p_size, l_shipdate,
    CASE WHEN l_linenumber = 7 THEN 'summary row' WHEN p_size = 50 THEN 'blank name' WHEN l_tax = 0 THEN 'zero spend' END AS dropped,
    CAST(round(l_extendedprice * l_tax * 1000) AS BIGINT) AS milli, l_quantity, l_extendedprice, l_linestatus
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def raw_search_export(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as a search-ads export: foreign headers, decorated numbers, total and blank rows."""
    part = model.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    milli = F.round(F.col("l_extendedprice") * F.col("l_tax") * 1000).cast("long")
    name = F.when(F.col("l_linenumber") == 7, "Grand Total").when(F.col("p_size") == 50, "").otherwise(F.col("p_brand"))
    name = F.when(name == "", F.lit(None).cast("string")).otherwise(name)
    return model.table(spark, sf, "lineitem").join(part, "l_partkey").select(
        F.concat("l_returnflag", F.lit(".csv")).alias(exports.FILE),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias(exports.ORDINAL),
        name.alias(" Campaign Name"), F.format_number(F.col("l_quantity") * 40, 0).alias("Impr."), F.col("l_quantity").cast("string").alias("Link Clicks"),
        F.concat(F.lit("₹"), F.format_number(milli / 1000, 3)).alias("Cost (INR)"),
        F.when(F.col("l_linestatus") == "O", "--").otherwise("1").alias("Conv."), F.col("l_extendedprice").cast("string").alias("Revenue"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("Day"),
    )


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.flagged_export(raw_search_export(spark, sf), cleaning.GOOGLE, exports.FILE, exports.ORDINAL)


@query("clean_search_export", f"""
WITH {ORDERED_RAW} SELECT source_file, p_brand AS campaign, l_quantity * 40 AS impressions, l_quantity AS clicks, milli / 1000 AS cost,
  CASE WHEN l_linestatus = 'O' THEN 0::DOUBLE ELSE 1 END AS conversions, l_extendedprice AS conversion_value,
  strftime(l_shipdate, '%Y-%m-%d') AS day FROM raw WHERE dropped IS NULL""", views=False)
def clean_search_export(spark: SparkSession, sf: str) -> DataFrame:
    rows = headers.require_columns(cleaning.clean_rows(_flagged(spark, sf)), fx.REQUIRED_COLUMNS["google"], "search ads")
    return rows.drop(exports.ORDINAL).withColumnRenamed("conversion value", "conversion_value")


@query("search_export_metrics", f"""
WITH {ORDERED_RAW}, m AS (SELECT *, milli / 1000 AS cost, CASE WHEN l_linestatus = 'O' THEN 0::DOUBLE ELSE 1 END AS conv FROM raw WHERE dropped IS NULL)
SELECT 'google' AS platform, p_brand AS campaign_name, cost AS spend, l_extendedprice AS conversion_value, conv AS conversions,
  round(l_extendedprice / cost, 2) AS roas, round(CASE WHEN conv <> 0 THEN cost / conv ELSE 0 END, 2) AS cac,
  round(l_quantity / (l_quantity * 40) * 100, 2) AS ctr, round(cost / l_quantity, 2) AS cpc, round(conv / cost * 1000, 3) AS efficiency,
  l_quantity * 40 < 1000 AS learning_phase, CASE WHEN l_extendedprice / cost < 1 THEN 'critical' WHEN l_extendedprice / cost < 2 THEN 'warning' ELSE 'ok' END AS severity
FROM m""", views=False)
def search_export_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.canonical_google(cleaning.clean_rows(_flagged(spark, sf)))
    return rows.drop("impressions", "clicks", "wasted_spend", "reach", "frequency")


@query("cleaning_report", f"""
WITH {ORDERED_RAW}, c AS (SELECT source_file, count(*) AS a, count(*) FILTER (WHERE dropped IS NULL) AS b,
    count(*) FILTER (WHERE dropped = 'summary row') AS d1, count(*) FILTER (WHERE dropped = 'blank name') AS d2,
    count(*) FILTER (WHERE dropped = 'zero spend') AS d3,
    count(*) FILTER (WHERE dropped IS NULL AND l_quantity * 40 >= 1000) AS e1,
    count(*) FILTER (WHERE dropped IS NULL AND l_linestatus = 'O') AS e4 FROM raw GROUP BY source_file)
SELECT source_file, unnest(['rows loaded', 'rows kept', 'dropped summary row', 'dropped blank name', 'dropped zero spend', 'changed impressions',
    'changed clicks', 'changed cost', 'changed conversions', 'changed conversion value', 'changed day']) AS step,
  unnest([a, b, d1, d2, d3, e1, 0, b, e4, 0, b]) AS count FROM c""", views=False)
def cleaning_report(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.cleaning_report(_flagged(spark, sf), exports.FILE)


def raw_social_export(spark: SparkSession, sf: str) -> DataFrame:
    """Social-ads facts as an export with its own headers and number formats."""
    facts = model.campaigns(spark, sf).where("platform = 'meta'")
    return facts.select(
        F.lit("social.csv").alias(exports.FILE), F.struct("upload_id", "campaign_name").alias(exports.ORDINAL), "upload_id",
        F.when(F.col("conversions") == 0, "Total").otherwise(F.col("campaign_name")).alias("Campaign"),
        F.format_number("impressions", 0).alias("Impr."), F.col("clicks").cast("string").alias("Outbound Clicks"),
        F.concat(F.format_string("%.6f", F.col("spend") / 1000), F.lit("K")).alias("Total Amount Spent"),
        F.col("conversions").cast("string").alias("Purchases"), F.col("roas").cast("string").alias("ROAS"),
        F.concat(F.lit("$"), F.format_number("conversion_value", 4)).alias("Purchase Value"),
        F.format_number(F.floor("reach"), 0).alias("People Reached"), F.col("frequency").cast("string").alias("Avg. Frequency"),
    )


@query("social_export_metrics", """
WITH m AS (SELECT *, CAST(printf('%.6f', spend / 1000) AS DOUBLE) * 1000 AS cost FROM campaigns WHERE platform = 'meta' AND conversions <> 0)
SELECT upload_id, 'meta' AS platform, campaign_name, round(cost, 3) AS spend, conversion_value, conversions, roas,
  round(cost / conversions, 2) AS cac, round(clicks / impressions * 100, 2) AS ctr, round(cost / clicks, 2) AS cpc,
  CASE WHEN roas < 1 THEN 'critical' WHEN roas < 2 THEN 'warning' ELSE 'ok' END AS severity, floor(reach) AS reach,
  round(nullif(frequency, 0), 2) AS frequency FROM m WHERE cost <> 0""")
def social_export_metrics(spark: SparkSession, sf: str) -> DataFrame:
    flagged = cleaning.flagged_export(raw_social_export(spark, sf), cleaning.META, exports.FILE, exports.ORDINAL)
    rows = headers.require_columns(cleaning.clean_rows(flagged), fx.REQUIRED_COLUMNS["meta"], "social ads")
    return metrics.canonical_meta(rows).drop("impressions", "clicks", "wasted_spend", "efficiency", "learning_phase").withColumn(
        "spend", rnd("spend", 3)
    )


@query("clean_funnel_export", """
SELECT client_id, lower(funnel_name) AS funnel_key, leads, mqls, NULL::DOUBLE AS sqls, customers FROM crm_funnel""")
def clean_funnel_export(spark: SparkSession, sf: str) -> DataFrame:
    """Funnel rows exported without a qualified-sales column, each file led by a stale row per name and closed by a total."""
    rows = model.crm_funnel(spark, sf)
    shown = rows.select(
        "client_id", F.lit(2).alias("at"), F.col("funnel_name").alias("Source"), F.format_number("leads", 0).alias("Form Fills"),
        F.format_number("mqls", 0).alias("MQL"), F.format_number("customers", 0).alias("Closed Won"),
    )
    stale = shown.withColumn("at", F.lit(1)).withColumn("MQL", F.lit("n/a"))
    closing = shown.select("client_id", F.lit(3).alias("at"), F.lit("Grand Total").alias("Source"), "Form Fills", "MQL", "Closed Won")
    raw = stale.unionByName(shown).unionByName(closing).withColumn(exports.FILE, F.concat_ws("/", F.col("client_id").cast("string"), F.lit("crm.csv")))
    flagged = cleaning.flagged_export(raw, cleaning.FUNNEL, exports.FILE, "at")
    loaded = funnel.load_funnel(cleaning.clean_rows(flagged), ["client_id"], "at")
    return loaded.select("client_id", F.lower("funnel_name").alias("funnel_key"), "leads", "mqls", "sqls", "customers")


FUNNEL_SUMS = """
SELECT client_id, sum(round(leads)) AS leads, sum(round(mqls)) AS mqls, NULL::DOUBLE AS sqls, sum(round(customers)) AS customers
FROM crm_funnel GROUP BY client_id"""


def _shown_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """Funnel rows without names, as the text of an export."""
    return model.crm_funnel(spark, sf).select(
        "client_id", F.format_number("leads", 0).alias("Form Fills"), F.format_number("mqls", 0).alias("MQL"),
        F.format_number("customers", 0).alias("Closed Won"), F.col("funnel_name"))


@query("funnel_date_export", FUNNEL_SUMS)
def funnel_date_export(spark: SparkSession, sf: str) -> DataFrame:
    """Funnel exports with a date column instead of campaigns, closed by a total, as account totals."""
    shown = _shown_funnel(spark, sf)
    dated = shown.withColumn("Date", F.lit("15/01/2026")).drop("funnel_name")
    closing = shown.withColumn("Date", F.lit("Grand Total")).drop("funnel_name")
    return funnel.load_funnel_totals(dated.unionByName(closing), ["client_id"])


@query("funnel_totals_export", FUNNEL_SUMS)
def funnel_totals_export(spark: SparkSession, sf: str) -> DataFrame:
    """Funnel exports of one totals row each, with neither campaign nor date column."""
    rows = model.crm_funnel(spark, sf).groupBy("client_id").agg(*[F.sum(F.round(s)).alias(s) for s in ("leads", "mqls", "customers")])
    shown = rows.select("client_id", F.format_number("leads", 0).alias("Form Fills"), F.format_number("mqls", 0).alias("MQL"),
                        F.format_number("customers", 0).alias("Closed Won"))
    return funnel.load_funnel_totals(shown, ["client_id"])


@query("clean_web_export", """
SELECT client_id, traffic_name AS join_key, sessions::DOUBLE AS sessions, users::DOUBLE AS users, bounce_rate, ga_conversions::DOUBLE AS conversions,
  ga_revenue AS revenue FROM web_traffic""")
def clean_web_export(spark: SparkSession, sf: str) -> DataFrame:
    """Web-analytics rows as exported, each client's file closed by a total row."""
    rows = model.web_traffic(spark, sf)
    shown = rows.select(
        "client_id", F.col("traffic_name").alias("Session campaign name"), F.format_number("sessions", 0).alias("Sessions"),
        F.format_number("users", 0).alias("Total  users"), F.concat(F.col("bounce_rate").cast("string"), F.lit("%")).alias("Bounce rate"),
        F.col("ga_conversions").cast("string").alias("Key events"), F.concat(F.lit("₹"), F.format_number("ga_revenue", 2)).alias("Total revenue"),
        F.concat(F.lit("a"), "traffic_name").alias("at"),
    )
    closing = rows.groupBy("client_id").agg(F.sum("sessions").cast("string").alias("Sessions")).select(
        "client_id", F.lit("Grand total").alias("Session campaign name"), "Sessions", F.lit("z").alias("at")
    )
    raw = shown.unionByName(closing, allowMissingColumns=True).withColumn("file", F.col("client_id").cast("string"))
    kept = exports.drop_closing_total(raw, "file", "at").drop("file", "at")
    return cleaning.clean_web_rows(kept).select("client_id", "join_key", "sessions", "users", "bounce_rate", "conversions", "revenue")


@query("column_mapping", """
SELECT 'Campaign Name' AS raw_column, 'campaign' AS canonical, count(*) FILTER (WHERE p_size <> 50 OR l_linenumber = 7) AS filled
  FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT unnest(['Impr.', 'Link Clicks', 'Cost (INR)', 'Conv.', 'Revenue', 'Day']),
  unnest(['impressions', 'clicks', 'cost', 'conversions', 'conversion value', NULL]), count(*) FROM lineitem JOIN part ON l_partkey = p_partkey""",
       views=False)
def column_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Which canonical field each export column maps to, and how many of its cells are filled."""
    raw = raw_search_export(spark, sf).drop(exports.FILE, exports.ORDINAL)
    plan = headers.plan_renames(raw.columns, fx.GOOGLE_ALIASES)
    filled = raw.agg(*[F.count(F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))).alias(c) for c in raw.columns])
    pairs = [F.struct(F.lit(c.strip()).alias("raw_column"), F.lit(plan.get(c)).alias("canonical"), F.col(f"`{c}`").alias("filled"))
             for c in raw.columns]
    return filled.select(F.explode(F.array(*pairs)).alias("e")).select("e.*")


@query("clients_in_bulk", """
SELECT DISTINCT n_name || ' ' || c_mktsegment AS client_name FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_acctbal >= 0""", views=False)
def clients_in_bulk(spark: SparkSession, sf: str) -> DataFrame:
    nations = model.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    label = F.concat(F.lit(" "), F.concat_ws(" ", "n_name", "c_mktsegment"))
    bulk = model.table(spark, sf, "customer").join(nations, "c_nationkey").select(
        F.when(F.col("c_acctbal") >= 0, label).otherwise(F.lit("None")).alias("Account Name"), "c_acctbal"
    )
    return headers.clients_in_bulk(bulk, headers.split_strategy(bulk.columns))


@query("granular_table_rows", """
SELECT client_id, platform, 'keyword' AS row_level, campaign_name, adgroup_name, keyword_name, '' AS ad_name, '' AS placement_name,
  impressions, clicks, spend, conversions, conversion_value, round(CASE WHEN spend <> 0 THEN conversion_value / spend ELSE 0 END, 4) AS roas,
  round(CASE WHEN impressions <> 0 THEN clicks / impressions ELSE 0 END * 100, 4) AS ctr,
  round(CASE WHEN clicks <> 0 THEN spend / clicks ELSE 0 END, 4) AS cpc, quality_score, '' AS match_type, '' AS ad_type FROM granular""")
def granular_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.granular_table_rows(raw_keywords(spark, sf), "keyword")


HEADS = [
    "campaign,cost,conversions,conversion value,impressions,clicks\n", "campaign name,amount spent,results,purchase roas,reach,frequency\n",
    "# google analytics 4\n\nsession campaign name,sessions,bounce rate\n", "campaign,leads,mqls,sqls,customers\n", "name,spend\n",
]


def _score_sql(platform: str) -> str:
    return " + ".join(f"CASE WHEN contains(t, '{s}') THEN {w} ELSE 0 END" for s, w in fx.SOURCE_SIGNALS[platform])


def _hits_sql(platform: str) -> str:
    parts = ", ".join(f"CASE WHEN contains(t, '{s}') THEN '{s}' END" for s, _ in fx.SOURCE_SIGNALS[platform])
    return f"array_to_string(list_slice(list_filter([{parts}], lambda v: v IS NOT NULL), 1, 6), ', ')"


_HEAD_SQL = "[" + ", ".join("'" + h.replace("\n", "' || chr(10) || '") + "'" for h in HEADS) + "]"


@query("detected_sources", f"""
WITH f AS (SELECT doc_id, lower({_HEAD_SQL}[doc_id % 5 + 1] || text) AS t FROM documents),
s AS (SELECT *, {', '.join(f'{_score_sql(p)} AS score_{p}' for p in fx.SOURCE_SIGNALS)} FROM f),
o AS (SELECT *, greatest(score_google, score_meta, score_ga4, score_funnel) AS best,
    list_sort([score_google, score_meta, score_ga4, score_funnel], 'DESC')[2] AS second,
    CASE greatest(score_google, score_meta, score_ga4, score_funnel) WHEN score_google THEN 'google' WHEN score_meta THEN 'meta'
      WHEN score_ga4 THEN 'ga4' ELSE 'funnel' END AS leader,
    contains(t, 'purchase roas') OR contains(t, 'return on ad spend') AS m, contains(t, 'conversion value') OR contains(t, 'quality score') AS g FROM s),
c AS (SELECT *, CAST(CASE WHEN best = 0 THEN 0 ELSE greatest(10, least(100, floor(best / 60::DOUBLE * 60 + (best - second) / 40::DOUBLE * 40))) END AS BIGINT) AS confidence,
    CASE WHEN abs(score_google - score_meta) < 15 AND m AND NOT g THEN 'meta' WHEN abs(score_google - score_meta) < 15 AND g AND NOT m THEN 'google' ELSE leader END AS chosen FROM o)
SELECT doc_id, CASE WHEN confidence >= 20 THEN chosen ELSE 'unknown' END AS platform, confidence,
  CASE leader {' '.join(f"WHEN '{p}' THEN {_hits_sql(p)}" for p in fx.SOURCE_SIGNALS)} END AS matched,
  score_google, score_meta, score_ga4, score_funnel FROM c""", views=False)
def detected_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Documents headed like exports of four platforms, classified over their whole text."""
    head = _variant(F.col("doc_id"), [F.lit(h) for h in HEADS])
    docs = model.table(spark, sf, "documents").select("doc_id", F.concat(head, "text").alias("body"))
    return detect.detect(docs, "body").drop("body")
