import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spendlens.sources import model
from spendlens.streaming import arrivals, rolling, state

SF = "/root/testdata/sf0.001"


def write_exports(folder, uploads):
    folder.mkdir(exist_ok=True)
    for upload, (start, roas) in uploads.items():
        lines = ["client_id,upload_id,period_start,Campaign,Impr.,Clicks,Cost (INR),Conv.,Conv. value"]
        lines += [f'1,{upload},{start},Alpha,"10,000",100,"₹1,000",10,{1000 * roas}', f"1,{upload},{start},Total,1,1,1,1,1"]
        (folder / f"u{upload}.csv").write_text("\n".join(lines) + "\n")


def test_arrivals_checks_and_replay(spark, tmp_path):
    inbox, tables = tmp_path / "inbox", str(tmp_path / "tables")
    write_exports(inbox, {i: (f"{(date(2026, 1, 1) + timedelta(days=31 * i)).isoformat()}", 3.0) for i in range(4)})
    stream = arrivals.export_stream(spark, str(inbox))
    arrivals.run_available(stream, arrivals.arrival_pipeline(tables), str(tmp_path / "c1"))
    write_exports(inbox, {4: ("2026-06-01", 0.5)})
    arrivals.run_available(arrivals.export_stream(spark, str(inbox)), arrivals.arrival_pipeline(tables), str(tmp_path / "c1"))
    facts = arrivals.stored_table(spark, tables, "campaigns")
    assert facts.count() == 5 and facts.where("campaign_name = 'Total'").count() == 0
    clients = spark.createDataFrame([(1, "x", "INR", "{}")], "client_id long, client_name string, currency string, context string")
    rules = spark.createDataFrame([(1, 2.0, 2.0, None, None, 20.0, "[]")], "client_id long, google_min_roas double, meta_min_roas double, "
                                  "google_min_cpl double, meta_min_cpl double, max_shift_pct double, type_overrides string")
    check = arrivals.checks_pipeline(tables, clients, rules)
    for _ in range(2):  # a repeated batch replaces itself
        check(facts.where("upload_id = 4"), 7)
    alerts = arrivals.stored_table(spark, tables, "kpi_alerts").collect()
    assert [a["alert_type"] for a in alerts] == ["roas_below"] and alerts[0]["upload_id"] == 4
    anomalies = arrivals.stored_table(spark, tables, "anomalies").collect()
    assert [a["metric"] for a in anomalies] == ["roas"] and anomalies[0]["severity"] == "critical"


def test_an_upload_without_facts_is_the_one_before(spark, tmp_path):
    """Upload 2 holds no campaigns: upload 3 has nothing to be compared with, unless upload 2 is not known of."""
    schema = ("client_id long, upload_id long, period_start date, period_date date, platform string, campaign_name string, spend double, "
              "conversions double, conversion_value double, roas double, cac double, ctr double, cpc double, clicks double, impressions double")
    days = {i: date(2026, i, 1) for i in (1, 2, 3)}
    rows = [(1, i, days[i], days[i], "google", "a", 10.0 * i**3, 1.0, 900.0, 90.0 / i, 10.0, 1.0, 1.0, 10.0, 1000.0) for i in (1, 3)]
    clients = spark.createDataFrame([(1, "x", "INR", "{}")], "client_id long, client_name string, currency string, context string")
    rules = spark.createDataFrame([(1, 2.0, 2.0, None, None, 20.0, "[]")], "client_id long, google_min_roas double, meta_min_roas double, "
                                  "google_min_cpl double, meta_min_cpl double, max_shift_pct double, type_overrides string")
    known = spark.createDataFrame([(1, i, d) for i, d in days.items()], "client_id long, upload_id long, period_date date")
    facts = spark.createDataFrame(rows, schema)
    for listed, want in ((None, ["spend_overpace"]), (known, [])):
        tables = str(tmp_path / str(len(want)))
        arrivals.write_batch(facts, tables, "campaigns", 0, by="client_id")
        arrivals.checks_pipeline(tables, clients, rules, listed)(facts.where("upload_id = 3"), 0)
        assert [a["alert_type"] for a in arrivals.stored_table(spark, tables, "kpi_alerts").collect()] == want


def test_replace_period(spark):
    stored = spark.createDataFrame([(1, date(2026, 1, 1), "old"), (1, date(2026, 2, 1), "keep")], "client_id int, period_start date, v string")
    incoming = spark.createDataFrame([(1, date(2026, 1, 1), "new")], "client_id int, period_start date, v string")
    assert sorted(r["v"] for r in arrivals.replace_period(incoming, stored).collect()) == ["keep", "new"]


def test_first_sends_drops_resends(spark, tmp_path):
    rows = [(1, date(2026, 1, 1), date(2026, 1, 31), datetime(2026, 2, 1, 0)), (1, date(2026, 1, 1), date(2026, 1, 31), datetime(2026, 2, 2, 0)),
            (1, date(2026, 2, 1), date(2026, 2, 28), datetime(2026, 3, 1, 0))]
    schema = "client_id int, period_start date, period_end date, at timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = arrivals.first_sends(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "at")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_watch_brief_writes(spark, tmp_path):
    write_exports(tmp_path / "inbox", {1: ("2026-01-01", 1.0)})
    rows = [(1, "c", "google", "roas", "critical", -50.0, "ROAS dropped")]
    read = lambda: spark.createDataFrame(rows, "client_id long, campaign_name string, platform string, metric string, severity string, pct_change double, description string")
    query = arrivals.watch_brief(arrivals.export_stream(spark, str(tmp_path / "inbox")), read, str(tmp_path / "t"), str(tmp_path / "c"), "1 second")
    query.processAllAvailable()
    query.stop()
    got = arrivals.stored_table(spark, str(tmp_path / "t"), "briefs").first()
    assert got["line"] == "[CRITICAL] c (google) - ROAS dropped" and got["worst_severity"] == "critical"


def test_stateful_comparison_matches_batch(spark, tmp_path):
    schema = "client_id long, platform string, campaign_name string, upload_id long, period_date date, roas double, spend double"
    out = {}
    for batch in range(3):
        rows = [(c, "google", "a", batch * 10 + c, date(2026, 1 + batch, 1), float(batch + c), 10.0 * batch) for c in (1, 2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.compare_with_previous(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r["client_id"], r["upload_id"]): (r["roas"], r["prior_roas"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 1): (1.0, None), (2, 2): (2.0, None), (1, 11): (2.0, 1.0), (2, 12): (3.0, 2.0), (1, 21): (3.0, 2.0), (2, 22): (4.0, 3.0)}


def test_streamed_windows_equal_batch(spark, tmp_path):
    stream = spark.readStream.schema(model.SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(SF)
    rolling.write_daily(stream, str(tmp_path / "k"), str(tmp_path / "c"))
    want = sorted(map(tuple, rolling.rolling_kpis(model.table(spark, SF, "events"), 30).collect()))
    assert sorted(map(tuple, rolling.roll(rolling.read_daily(spark, str(tmp_path / "k")), 30).collect())) == want


def test_late_period_finds_its_own_predecessor(spark, tmp_path):
    schema = "client_id long, platform string, campaign_name string, upload_id long, period_date date, roas double, spend double"
    for upload, month in ((1, 1), (5, 5), (3, 3), (9, 5)):  # March after May, then May once more
        rows = [(1, "google", "a", upload, date(2026, month, 1), float(month), 1.0)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.compare_with_previous(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r["upload_id"]: r["prior_roas"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: None, 5: 1.0, 3: 1.0, 9: 3.0}


def test_arrivals_keep_rejects_and_fall_back_to_the_day(spark, tmp_path):
    inbox, tables = tmp_path / "inbox", str(tmp_path / "tables")
    inbox.mkdir()
    head = "client_id,upload_id,period_start,Campaign,Impr.,Clicks,Cost (INR),Conv.,Conv. value\n"
    (inbox / "a.csv").write_text(head + "1,7,,Alpha,10,1,5,1,1\n,8,2026-01-01,Beta,10,1,5,1,1\n2,x,2026-01-01,Gamma,10,1,5,1,1\n")
    arrivals.run_available(arrivals.export_stream(spark, str(inbox)), arrivals.arrival_pipeline(tables), str(tmp_path / "c"))
    facts = arrivals.current_facts(spark, tables).collect()
    assert [(r["campaign_name"], r["period_date"] is not None) for r in facts] == [("Alpha", True)]
    assert {r["reason"] for r in arrivals.stored_table(spark, tables, "rejects").collect()} == {"no client", "no upload"}
    assert arrivals.stored_table(spark, tables, "benchmarks").count() == 1


HEAD = "client_id,upload_id,period_start,Campaign,Impr.,Clicks,Cost (INR),Conv.,Conv. value\n"


def arrive(spark, tmp_path, files, at_once):
    """Current (upload, campaign) pairs after files arrived in their order, at most ``at_once`` a batch."""
    inbox, tables = tmp_path / "inbox", str(tmp_path / "tables")
    inbox.mkdir()
    for i, (name, lines) in enumerate(files.items()):
        (inbox / name).write_text(HEAD + "".join(f"{line},10,1,5,1,1\n" for line in lines))
        os.utime(inbox / name, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = arrivals.export_stream(spark, str(inbox), files_per_trigger=at_once)
    arrivals.run_available(stream, arrivals.arrival_pipeline(tables), str(tmp_path / "c"))
    return sorted((r["upload_id"], r["campaign_name"]) for r in arrivals.current_facts(spark, tables).collect())


@pytest.mark.parametrize("at_once", [1, 1000])
def test_sendings_count_whole_and_once_in_any_batches(spark, tmp_path, at_once):
    files = {
        "part-00000-aa-c000.csv": ["1,7,2026-01-01,Old"], "part-00001-aa-c000.csv": ["1,7,2026-01-01,Older"],
        "part-00000-bb-c000.csv": ["1,7,2026-01-01,Alpha", "1,9,,Gamma"], "part-00001-bb-c000.csv": ["1,7,2026-01-01,Beta"],
        "x.csv": ["1,10,,Delta"],
    }
    assert arrive(spark, tmp_path, files, at_once) == [(7, "Alpha"), (7, "Beta"), (9, "Gamma"), (10, "Delta")]


def test_comparison_does_not_depend_on_chunks(spark, tmp_path):
    schema = "client_id long, platform string, campaign_name string, upload_id long, period_date date, roas double, spend double"
    rows = [(1, "google", "a", m, date(2026, m, 1), float(m), 1.0) for m in (5, 2, 6, 1, 4, 3)]
    rows += [(1, "google", "a", 0, date(2026, 3, 1), 99.0, 1.0), (1, "google", "a", 20, date(2026, 2, 1), 20.0, 1.0), (1, "google", "a", 19, date(2026, 2, 1), 19.0, 1.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        stream = state.compare_with_previous(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["upload_id"]: r["prior_roas"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: None, 2: 1.0, 20: 1.0, 19: 1.0, 3: 20.0, 0: 20.0, 4: 3.0, 5: 4.0, 6: 5.0}


def test_comparison_forgets_periods_beyond_its_horizon(spark, tmp_path):
    """State holds the periods of the horizon only, and a re-sent period overwrites its own entry."""
    schema = "client_id long, platform string, campaign_name string, upload_id long, period_date date, roas double, spend double"

    def send(*rows):
        spark.createDataFrame([(1, "google", "a", *r) for r in rows], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.compare_with_previous(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), horizon_days=100)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(
            availableNow=True).start().awaitTermination()

    send(*[(i, date(2026, 1, 1) + timedelta(days=30 * i), float(i), 1.0) for i in range(12)])
    send((20, date(2026, 1, 1) + timedelta(days=30 * 11), 50.0, 2.0), (21, date(2026, 1, 1) + timedelta(days=30 * 12), 60.0, 3.0))
    send((22, date(2026, 1, 2), 70.0, 4.0))  # long past the horizon: nothing before it is held
    held = spark.read.format("statestore").option("stateVarName", "periods").load(str(tmp_path / "c"))
    days = sorted(r[0] for r in held.select("user_map_key.period_date").collect())
    assert days == [date(2026, 1, 1) + timedelta(days=30 * i) for i in range(9, 13)]
    got = {r["upload_id"]: r["prior_roas"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[11] == 10.0 and got[20] == 10.0 and got[21] == 50.0 and got[22] is None and len(got) == 15


def test_batches_read_the_folders_of_their_clients(spark, tmp_path):
    facts = spark.createDataFrame([(c, 1, 1.0) for c in range(5)], "client_id long, upload_id long, spend double").withColumns(
        {arrivals.SENT_AS: F.lit("s"), arrivals.SENT_AT: F.lit(None).cast("timestamp")})
    arrivals.write_batch(facts, str(tmp_path), "campaigns", 0, by="client_id")
    some = arrivals.stored_facts(spark, str(tmp_path), arrivals.arrived_clients(facts.where("client_id > 2")))
    assert sorted(r["client_id"] for r in some.collect()) == [3, 4]
    assert "PartitionFilters: [cast(client_id" in (plan := some._jdf.queryExecution().executedPlan().toString()) or "client_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_sketches_of_batches_merge(spark, tmp_path):
    from spendlens.streaming import benchmarks

    facts = spark.range(20000).selectExpr("id % 2 AS client_id", "'google' AS platform", "CAST(id AS double) AS roas", "CAST(NULL AS double) AS cac",
                                          "CAST(id % 7 AS double) AS ctr")
    work = benchmarks.sketch_pipeline(str(tmp_path / "s"))
    for batch_id, part in enumerate([facts.where("id % 3 = 0"), facts.where("id % 3 = 1"), facts.where("id % 3 = 2"), facts.where("id % 3 = 2")]):
        work(part, min(batch_id, 2))  # the last batch comes twice
    found = benchmarks.against_exact(benchmarks.medians(spark, str(tmp_path / "s")), facts).collect()
    assert len(found) == 6 and all(r["within_bound"] for r in found)
    assert {(r["metric"], r["n"]) for r in found} == {("roas", 10000), ("cac", 0), ("ctr", 10000)}
    assert all(r["median"] is None for r in found if r["metric"] == "cac")
