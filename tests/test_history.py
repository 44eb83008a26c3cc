from datetime import date, timedelta

from pyspark.sql import functions as F

from spendlens.operators import anomalies, forecast, history, learning, state
from spendlens.sources import sinks


def campaign_rows(spark, n, start=date(2020, 1, 1)):
    rows = [(1, "google", "c", i, i, n, start + timedelta(days=30 * i), start + timedelta(days=30 * i), float(i % 7 + 1), 100.0 - i, 2.0, 50.0)
            for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "client_id long, platform string, campaign_name string, upload_id long, upload_rank long, "
                                       "upload_count long, period_date date, period_start date, roas double, ctr double, cac double, spend double")


def test_blocks_do_not_change_windows(spark, monkeypatch):
    rows = campaign_rows(spark, 60)
    whole = anomalies.with_history(rows).select("upload_id", F.transform("past", lambda h: h["upload_rank"]).alias("p")).collect()
    prior = history.with_prior(rows, ["roas"]).select("upload_id", "prior_roas", "has_prior").collect()
    monkeypatch.setattr(history, "BLOCK", 16)
    cut = anomalies.with_history(rows).select("upload_id", F.transform("past", lambda h: h["upload_rank"]).alias("p")).collect()
    assert sorted(map(tuple, whole), key=lambda r: r[0]) == sorted(map(tuple, cut), key=lambda r: r[0])
    assert sorted(map(tuple, prior)) == sorted(map(tuple, history.with_prior(rows, ["roas"]).select("upload_id", "prior_roas", "has_prior").collect()))
    assert {r[0]: len(r[1]) for r in cut}[60] == 12


def test_creative_fatigue_needs_three_falling_values(spark):
    rows = campaign_rows(spark, 10)
    rows = rows.withColumn("ctr", F.expr("10 * pow(0.9, upload_rank)"))
    clients = spark.createDataFrame([(1, "x", "INR", None)], "client_id long, client_name string, currency string, context string")
    found = anomalies.detect_anomalies(rows, clients).where("metric = 'creative_fatigue'").collect()
    assert sorted(r["upload_id"] for r in found) == [4, 5, 6, 7, 8, 9, 10]
    assert all(r["severity"] == "warning" and r["pct_change"] == -19.0 for r in found)


def test_upload_ranks_follow_periods(spark):
    rows = [(1, 5, date(2020, 3, 1)), (1, 9, date(2019, 5, 1)), (1, 2, date(2021, 1, 1)), (1, 3, date(2020, 3, 1)), (2, 8, date(2020, 1, 1))]
    df = spark.createDataFrame(rows, "client_id long, upload_id long, period_date date")
    got = {r["upload_id"]: (r["upload_rank"], r["upload_count"]) for r in history.rank_uploads(df).collect()}
    assert got == {9: (1, 4), 3: (2, 4), 5: (3, 4), 2: (4, 4), 8: (1, 1)}


def test_weighted_forecast_uses_latest_twelve(spark):
    rows = campaign_rows(spark, 20).withColumn("spend", F.col("upload_rank").cast("double"))
    rows = rows.withColumns({"conversions": F.lit(1.0), "conversion_value": F.col("spend") * 2, "period_label": F.lit(None).cast("string"),
                             "period_end": F.lit(None).cast("date")})
    got = forecast.account_forecast(rows, date(2020, 1, 15), 30).first()
    weights = [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7]
    base = sum(w * v for w, v in zip(weights, range(9, 21))) / sum(weights)
    assert got["periods_used"] == 12 and got["avg_period_days"] == 30.0
    assert got["proj_roas"] == 2.0 and got["spend_trend"] == "up"
    season = got["season_factor"]
    assert abs(got["proj_spend"] - round((base + 1) * season)) <= 1


def test_keep_or_discard_in_chunks(spark):
    rows = [(0, 10, 5.0, False), (1, 9, 1.0, False), (2, 10, 4.0, False), (3, 10, 4.0, False), (4, 30, 9.0, True), (5, 11, 9.0, False), (6, 11, 8.0, False)]
    df = spark.createDataFrame(rows, "experiment_id long, score int, avg_time_s double, skipped boolean")
    want = ["baseline", "discard", "keep", "discard", "skipped", "keep", "keep"]
    for size in (2, 100):
        got = [r["status"] for r in state.keep_or_discard(df, size).orderBy("experiment_id").collect()]
        assert got == want


def test_asof_upload_counts(spark):
    uploads = spark.createDataFrame([(1, i, date(2019, 11, 1) + timedelta(days=40 * i)) for i in range(8)], "client_id long, upload_id long, uploaded_on date")
    items = spark.createDataFrame([("a", 1, date(2019, 10, 1)), ("b", 1, date(2019, 11, 1)), ("c", 1, date(2020, 3, 1)), ("d", 1, date(2031, 1, 1))],
                                  "item string, client_id long, done_on date")
    got = {r["item"]: (r["uploads_until"], r["uploads_total"]) for r in learning.with_uploads_until(items, uploads, "done_on").collect()}
    assert got == {"a": (0, 8), "b": (1, 8), "c": (4, 8), "d": (8, 8)}


def test_action_items_keep_existing(spark):
    actions = spark.createDataFrame([(1, "pause x", "audit", "high", None, "google", 1), (1, "pause x", "audit", "low", None, "meta", 2),
                                     (1, "fix y", "audit", "low", None, "meta", 1)],
                                    "client_id long, text string, source string, priority string, campaign string, platform string, arrival int")
    existing = state.with_hash(spark.createDataFrame([(1, "fix y")], "client_id long, text string"))
    got = state.new_action_items(actions, existing).collect()
    assert [(r["text"], r["priority"], r["status"]) for r in got] == [("pause x", "high", "todo")]


def test_sink_round_trip(spark, tmp_path):
    rows = campaign_rows(spark, 5)
    sinks.append_table(rows, str(tmp_path), "campaigns")
    sinks.append_table(rows.withColumn("client_id", F.lit(2).cast("long")), str(tmp_path), "campaigns")
    back = sinks.read_table(spark, str(tmp_path), "campaigns")
    assert back.count() == 10
    one = sinks.scan(back, client_id=2)
    assert one.count() == 5 and "PartitionFilters: [isnotnull(client_id" in one._jdf.queryExecution().toString()
    sinks.write_export(rows.select("campaign_name", "roas"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 5


def test_uploads_without_a_day_keep_a_rank(spark):
    rows = [(1, 5, None), (1, 6, "2026-01-01"), (1, 7, None), (2, 8, None)]
    df = spark.createDataFrame(rows, "client_id int, upload_id int, day string").withColumn("period_date", F.col("day").cast("date"))
    got = {r["upload_id"]: (r["upload_rank"], r["upload_count"]) for r in history.rank_uploads(df).collect()}
    assert got == {5: (1, 3), 7: (2, 3), 6: (3, 3), 8: (1, 1)}
