import math

import pytest
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions import dates, formatting, numbers
from spendlens.functions.guards import total
from spendlens.operators import cleaning, columns, granular, metrics
from spendlens.sources import detect, exports

NUMBERS = [("₹1,200", 1200.0), ("1.2K", 1200.0), ("2.5L", 250000.0), ("1Cr", 1e7), ("3 m", 3e6), ("1b", 1e9), ("3.5%", 3.5), ("--", 0.0),
           ("n/a", 0.0), ("", 0.0), (None, 0.0), ("abc", 0.0), ("5c", 5.0), ("(100)", 0.0), ("1,5", 15.0), ("0,00", 0.0), ("-7.5", -7.5),
           ("1d", 0.0), ("  12 ", 12.0), ("$3,000.50", 3000.5), ("1e3", 1000.0), ("None", 0.0), ("7Lr", 7.0)]


def test_clean_numeric(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NUMBERS)], "i int, t string")
    got = dict(df.select("i", numbers.clean_numeric("t")).collect())
    for i, (raw, want) in enumerate(NUMBERS):
        assert math.isclose(got[i], want), (raw, got[i], want)


def test_clean_web_numeric(spark):
    df = spark.createDataFrame([("₹1,234.5",), ("45.2%",), ("abc",), (None,), ("1-2",), ("-3",)], "t string")
    assert [r[0] for r in df.select(numbers.clean_web_numeric("t")).collect()] == [1234.5, 45.2, 0.0, 0.0, 0.0, -3.0]


DATES = [("2026-01-15", "2026-01-15"), ("2026/1/5", "2026-01-05"), ("20260115", "2026-01-15"), ("15/01/2026", "2026-01-15"),
         ("15-Jan-26", "2026-01-15"), ("15 Jan 2026", "2026-01-15"), ("Jan 15, 2026", "2026-01-15"), ("January 15 2026", "2026-01-15"),
         ("2026-Jan-15", "2026-01-15"), ("15 01 2026", "2026-01-15"), ("Jan 15, 2026 - Jan 31, 2026", "2026-01-15"),
         ("15/1/2026 - 31/1/2026", "2026-01-15"), ("46037", "2026-01-15"), ("31/02/2026", "31/02/2026"), ("03/04/26", "2026-04-03"),
         ("01/02/70", "1970-02-01"), ("99999", "99999"), ("Foo 2026", "Foo 2026"), ("n/a", "n/a"), ("hello", "hello"), ("04/25/2026", "2026-04-25"),
         ("Q1 2026", "2026-01-01"), ("2026-Q3", "2026-07-01"), ("H2 2026", "2026-07-01"), ("FY2026", "2026-04-01"), ("FY26", "2026-04-01"),
         ("FY2025-26", "2025-04-01"), ("Week 3 2026", "2026-01-12"), ("W3/2026", "2026-01-12"), ("Wk 3 2026", "2026-01-12"), ("Week 3", "2026-01-12"),
         ("Jan 2026", "2026-01-01"), ("January-2026", "2026-01-01"), ("2026 Feb", "2026-02-01"), ("Sept 2026", "Sept 2026")]


def test_normalize_date(spark):
    df = spark.createDataFrame(DATES, "raw string, want string")
    for raw, want, got in df.select("raw", "want", dates.normalize_date("raw", as_of_year=2026)).collect():
        assert got == want, raw


def test_fiscal_year_month(spark):
    got = spark.range(1).select(dates.period_start(F.lit("FY2026"), fy_start_month=10).cast("string"), dates.period_start(F.lit("Week 3"))).first()
    assert tuple(got) == ("2026-10-01", None)


def test_day_order_is_decided_per_file(spark):
    rows = [("us", 1, "03/04/2026"), ("us", 2, "04/25/2026"), ("us", 3, "25/04/2026"), ("eu", 1, "03/04/2026"), ("eu", 2, "n/a")]
    df = spark.createDataFrame(rows, "file string, at int, `Report Day` string")
    got = {(r["file"], r["at"]): r["Report Day"] for r in cleaning.normalize_dates(df, "file", "at").collect()}
    assert got == {("us", 1): "2026-03-04", ("us", 2): "2026-04-25", ("us", 3): "2026-04-25", ("eu", 1): "2026-04-03", ("eu", 2): "n/a"}


def test_cells_that_are_no_dates_stay(spark):
    df = spark.createDataFrame([("a", 1, "15/01/2026", "Q1 2026"), ("a", 2, None, "x"), (None, 3, "16/01/2026", None)], "file string, at int, day string, week string")
    got = sorted(cleaning.normalize_dates(df, "file", "at").collect(), key=lambda r: r["at"])
    assert [(r["day"], r["week"], r["changed day"]) for r in got] == [
        ("2026-01-15", "2026-01-01", True), (None, "x", False), ("2026-01-16", None, True)]


def test_rows_meet_their_parsed_dates_without_a_shuffle(spark):
    day = F.date_format(F.date_add(F.lit("2018-01-01").cast("date"), (F.col("id") % 2500).cast("int")), "dd/MM/yyyy")
    df = spark.range(5000).select(F.lit("f").alias("file"), F.col("id").alias("at"), day.alias("day"))
    got = cleaning.normalize_dates(df, "file", "at")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert {(r["at"], r["day"]) for r in got.where("at < 2").collect()} == {(0, "2018-01-01"), (1, "2018-01-02")}
    assert got.where("`changed day`").count() == 5000


def test_exact_sums_keep_small_and_large_values(spark):
    df = spark.createDataFrame([(0.00004,)] * 5 + [(1.5e16,)], "x double")
    assert df.where("x < 1").agg(total("x")).first()[0] == 0.0002
    assert df.agg(total("x")).first()[0] == 1.5e16


def test_google_pipeline_and_report(spark):
    raw = spark.createDataFrame(
        [("f", 1, "Brand", "1,000", "10", "₹100", "2", "250"), ("f", 2, "Total", "9", "9", "9", "9", "9"), ("f", 3, "  ", "1", "1", "1", "1", "1"),
         ("f", 4, None, "1", "1", "1", "1", "1"), ("f", 5, "Idle", "5", "0", "--", "0", "0"), ("f", 6, "Grand TOTAL ", "9", "9", "9", "9", "9")],
        "file string, at int, `Campaign Name` string, `Impr.` string, Clicks string, `Cost (INR)` string, `Conv.` string, Revenue string")
    flagged = cleaning.flagged_export(raw, cleaning.GOOGLE, "file", "at")
    rows = cleaning.clean_rows(flagged).collect()
    assert [(r["campaign"], r["impressions"], r["cost"], r["conversion value"]) for r in rows] == [("Brand", 1000.0, 100.0, 250.0)]
    report = {r["step"]: r["count"] for r in cleaning.cleaning_report(flagged, "file").collect()}
    assert report["rows loaded"] == 6 and report["rows kept"] == 1
    assert report["dropped summary row"] == 3 and report["dropped blank name"] == 1 and report["dropped zero spend"] == 1
    assert report["changed cost"] == 1 and report["changed clicks"] == 0


def test_column_plans():
    plan = columns.plan_renames(["Ad Campaign", "impr.", "Spend", "my clicks col", "conv. value", "results"], fx.GOOGLE_ALIASES)
    assert plan == {"Ad Campaign": "campaign", "impr.": "impressions", "Spend": "cost", "my clicks col": "clicks",
                    "results": "conversions", "conv. value": "conversion value"}
    assert columns.granularity(["campaign", "ad group", "keyword"]) == "keyword"
    assert columns.granularity(["campaign", "ad set name", "ad name"]) == "ad"
    assert columns.granularity(["campaign", "ad name"]) == "campaign"
    assert columns.granularity(["campaign", "adset"]) == "ad_group"
    assert columns.granularity(["site"]) == "placement" and columns.granularity(["x"]) == "unknown"
    assert columns.funnel_join_level(["date", "leads"]) == "date" and columns.funnel_join_level(["leads"]) == "aggregate"
    assert columns.client_column(["x", " Advertiser "]) == " Advertiser "


def test_required_columns_and_mapping_report(spark):
    df = spark.createDataFrame([("a", "1")], "Campaign string, Spend string")
    with pytest.raises(ValueError, match="impressions"):
        columns.require_columns(columns.map_columns(df, fx.GOOGLE_ALIASES), fx.REQUIRED_COLUMNS["google"], "search ads")
    report = dict(columns.mapping_report(spark, df.columns, fx.GOOGLE_ALIASES).collect())
    assert report["campaign"] == "Campaign" and report["cost"] == "Spend" and report["clicks"] is None
    renamed = columns.map_columns(df, fx.GOOGLE_ALIASES, {"Campaign": "clicks"})
    assert set(renamed.columns) == {"clicks", "cost"}


def test_reading_files(spark, tmp_path):
    (tmp_path / "web.csv").write_text("# export of property 1\n#\n\nSession campaign name,Sessions,Bounce rate\nPMax,\"1,200\",45%\nnan,3,1%\nTotal,1203,\n")
    rows = cleaning.clean_web_rows(exports.read_web_csv(spark, str(tmp_path / "web.csv"))).collect()
    assert [(r["join_key"], r["sessions"], r["bounce_rate"]) for r in rows] == [("PMax", 1200.0, 45.0)]
    (tmp_path / "bulk.csv").write_text("Account Name,Campaign,Spend\nAcme,c1,5\n,c2,6\n Bolt ,c3,7\n")
    bulk = exports.read_bulk(spark, str(tmp_path / "bulk.csv"))
    assert sorted(r["client"] for r in bulk.collect()) == ["Acme", "Bolt"] and "Account Name" not in bulk.columns
    folder = tmp_path / "clients"
    folder.mkdir()
    (folder / "Acme Co.csv").write_text("Campaign,Spend\nc1,5\n")
    (folder / "Bolt.csv").write_text("Campaign,Spend\nc2,5\nc3,4\n")
    counts = dict(exports.read_client_files(spark, str(folder)).groupBy("client").count().collect())
    assert counts == {"Acme Co": 1, "Bolt": 2}
    assert exports.preview(exports.read_ads_csv(spark, str(tmp_path / "bulk.csv")), 2).collect()[1]["Account Name"] == ""


def test_detect_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text("Campaign,Cost,Conversions,Conversion value,Quality score\n" + "x" * 5000)
    (tmp_path / "f.csv").write_text("Campaign,Cost\n" + "x" * 5000 + "mqls sqls")
    (tmp_path / "m.csv").write_text("Campaign name,Amount spent,Purchase ROAS,Results\n")
    (tmp_path / "u.csv").write_text("a,b\n")
    got = {r["path"].split("/")[-1]: r["platform"] for r in detect.detect_files(spark, str(tmp_path)).collect()}
    assert got == {"g.csv": "google", "m.csv": "meta", "u.csv": "unknown", "f.csv": "funnel"}
    texts = spark.createDataFrame([(p.name, p.read_text()) for p in tmp_path.iterdir()], "name string, text string")
    assert got == {r["name"]: r["platform"] for r in detect.detect(texts, "text").collect()}


def test_metrics_and_severity(spark):
    rows = [("a", 1000.0, 10.0, 100.0, 2.0, 99.0), ("b", 0.0, 0.0, 100.0, 0.0, 100.0), ("c", 500.0, 5.0, 100.0, 20.0, 200.0)]
    df = spark.createDataFrame(rows, "campaign string, impressions double, clicks double, cost double, conversions double, `conversion value` double")
    got = {r["campaign_name"]: r for r in metrics.canonical_google(df).collect()}
    assert (got["a"]["severity"], got["a"]["wasted_spend"], got["a"]["roas"]) == ("critical", 100.0, 0.99)
    assert (got["b"]["severity"], got["b"]["wasted_spend"], got["b"]["ctr"], got["b"]["cac"]) == ("warning", 50.0, 0.0, 0.0)
    assert (got["c"]["severity"], got["c"]["wasted_spend"], got["c"]["learning_phase"]) == ("ok", 0.0, False)
    d = spark.range(1).select(metrics.delta(F.lit(5.0), F.lit(0.0)), metrics.delta(F.lit(9.0), F.lit(10.0))).first()
    assert tuple(d[0]) == (5.0, 0.0, "flat") and tuple(d[1]) == (-1.0, 10.0, "down")


def test_trend_against_a_prior_export(spark):
    now = spark.createDataFrame([("a", 2.2), ("b", 1.0), ("c", 1.02), ("d", 5.0), ("e", 1.0)], "campaign_name string, roas double")
    prior = spark.createDataFrame([("a", 9.0, 1), ("a", 2.0, 2), ("b", 2.0, 3), ("c", 1.0, 4), ("e", 0.0, 5)], "campaign_name string, roas double, at int")
    got = {r["campaign_name"]: r["trend"] for r in metrics.with_prior_roas(now, prior, [], "at").collect()}
    assert got == {"a": "improving", "b": "declining", "c": "stable", "d": "unknown", "e": "unknown"}


def test_summary_without_revenue_uses_mean_roas(spark):
    rows = [(1, "meta", 10.0, None, 1.0, 2.0, 1.0, 0.0, "ok"), (1, "meta", 30.0, None, 0.0, 4.0, 3.0, 0.0, "ok")]
    df = spark.createDataFrame(rows, "client_id int, platform string, spend double, conversion_value double, conversions double, roas double, "
                                     "ctr double, wasted_spend double, severity string")
    got = metrics.platform_summary(df, ["client_id"]).first()
    assert got["overall_roas"] == 3.0 and got["total_revenue"] is None and got["overall_cac"] == 40.0 and got["overall_ctr"] == 2.0


def test_rollup_without_spend_uses_plain_mean(spark):
    df = spark.createDataFrame([("c", "g1", 0.0, 2.0, 7), ("c", "g1", 0.0, 4.0, 3), ("d", "g1", 10.0, 1.0, 5), ("d", "g1", 30.0, 3.0, 4)],
                               "campaign string, `ad group` string, cost double, roas double, `quality score` int")
    got = {r["campaign"]: (r["roas"], r["quality score"]) for r in granular.to_adgroups(df, []).collect()}
    assert got == {"c": (3.0, 7), "d": (2.5, 5)}


def test_rupees(spark):
    values = [(123456.0, "Rs 1,23,456"), (0.0, "Rs 0"), (-1234.9, "-Rs 1,234"), (999.0, "Rs 999"), (12345678.0, "Rs 1,23,45,678"), (None, "N/A")]
    df = spark.createDataFrame(values, "v double, want string")
    for _, want, got in df.select("v", "want", formatting.rupees("v")).collect():
        assert got == want


def test_mojibake(spark):
    got = spark.range(1).select(formatting.repair_mojibake(F.lit("â‚¹5 â€“ itâ€™s cafÃ© â€¦"))).first()[0]
    assert got == "₹5 - it's café ..."


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("campaign,cost,clicks\nA,1,2\n#summer,3,4\n\n\"x, y\",5,\n")
    (tmp_path / "b.csv").write_text("# note\ncampaign,clicks,cost\nB,2,1\n#late,7,8\nTotal,9,9\n")
    got = exports.read_web_csv(spark, str(tmp_path)).select("campaign", "cost", "clicks").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [("A", "1", "2"), ("#summer", "3", "4"), ("x, y", "5", None), ("B", "1", "2"), ("#late", "8", "7")], key=str)


def test_whole_files_are_judged(spark, tmp_path):
    (tmp_path / "late.csv").write_text("x\n" * 3000 + "Session campaign,Engaged sessions\n")
    (tmp_path / "none.csv").write_text("nothing\n")
    got = {r["path"].rsplit("/", 1)[1]: r["platform"] for r in detect.detect_files(spark, str(tmp_path)).collect()}
    assert got == {"late.csv": "ga4", "none.csv": "unknown"}
