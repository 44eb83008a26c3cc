"""Pages of ordered lists, and totals of all levels in one aggregation."""

from pyspark.sql import functions as F

from spendlens.operators import metrics, paging
from spendlens.sources import model

SF = "/root/testdata/sf0.001"


def test_pages_follow_the_order(spark, tmp_path):
    rows = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("k"), F.lit("hot").alias("name"))
    paging.write_pages(rows, ["name", F.desc("k")], str(tmp_path / "p"), chunk_rows=100)
    paged = spark.read.parquet(str(tmp_path / "p"))
    assert [r["k"] for r in paging.read_page(paged, 3, 30, 100).collect()] == list(range(909, 879, -1))
    assert [r["position"] for r in paging.read_page(paged, 33, 30, 100).collect()] == list(range(990, 1000))
    assert paging.read_page(paged, 34, 30, 100).collect() == []
    plan = paging.read_page(paged, 3, 30, 100)._jdf.queryExecution().executedPlan().toString()
    assert "chunk" in plan.split("PartitionFilters: [")[1].split("]")[0]
    paging.write_pages(rows.limit(0), ["k"], str(tmp_path / "none"))


def test_levels_add_up(spark):
    facts = model.campaigns(spark, SF)
    found = metrics.account_rollup(facts)
    by_client = {tuple(r) for r in found.where("level = 'platform'").drop("level", "campaign_name").collect()}
    assert by_client == {tuple(r) for r in metrics.platform_summary(facts, ["client_id"]).collect()}
    whole = found.where("level = 'all'").collect()
    assert len(whole) == 1 and whole[0]["campaign_count"] == facts.count()
