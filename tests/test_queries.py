"""A sample of registered queries next to their SQL; tools/check_results.py runs them all."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_results import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SAMPLE = ["platform_summary", "dashboard_kpis", "roas_trend", "kpi_alerts", "anomalies", "account_forecast", "audit_checks",
          "reallocation_targets", "client_benchmarks", "action_impact", "funnel_reconciliation", "traffic_by_campaign",
          "rollup_adgroups", "report_sections", "detected_sources", "read_web_export", "read_encoded_exports", "read_bulk_by_file", "streamed_comparison", "streamed_checks",
          "resolved_clients"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    result = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())


def test_row_order_does_not_matter(spark, tmp_path):
    """Shuffled and differently partitioned input gives the same totals, which add up across splits."""
    from spendlens.operators import metrics
    from spendlens.sources import model

    facts = model.campaigns(spark, SF)
    shuffled = facts.orderBy("cpc", "spend").repartition(7)
    one, two = (sorted(map(tuple, metrics.platform_summary(f, ["client_id"]).collect())) for f in (facts, shuffled))
    assert one == two


def test_entry_has_stable_schema(spark):
    assert entry.entry(spark).columns[:2] == ["client_id", "platform"]
