"""Stored tables under a commit log, pages of long lists, benchmarks by mergeable sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.guards import total
from spendlens.operators import paging
from spendlens.plans.registry import query
from spendlens.plans.state import PROPOSED, _proposed
from spendlens.session import shared_folder
from spendlens.sources import model
from spendlens.sources.committed import CommittedTable, delete_uploads
from spendlens.streaming import arrivals, benchmarks

KEYS = ["client_id", "upload_id", "platform", "campaign_name"]


def _history(spark: SparkSession, sf: str) -> CommittedTable:
    """Even uploads appended, every fourth sent again with the odd ones, every fifth deleted; each batch comes twice."""
    facts = model.campaigns(spark, sf).select(*KEYS, "spend")
    table = CommittedTable(spark, f"{shared_folder(spark)}/facts/{uuid.uuid4().hex}", facts.schema)
    again = facts.where("upload_id % 4 = 0 OR upload_id % 2 = 1").withColumn("spend", F.expr("CASE WHEN upload_id % 4 = 0 THEN spend * 2 ELSE spend END"))
    for _ in range(2):
        table.append(facts.where("upload_id % 2 = 0"), "uploads", 0)
    for _ in range(2):
        table.merge(again, KEYS, "uploads", 1)
    gone = facts.where("upload_id % 5 = 0").select("upload_id").distinct()
    for _ in range(2):
        delete_uploads([table], gone, 0)
    return table


SENT = "CASE WHEN upload_id % 4 = 0 THEN spend * 2 ELSE spend END"


@query("stored_table_rows", f"SELECT client_id, upload_id, platform, campaign_name, {SENT} AS spend FROM campaigns WHERE upload_id % 5 <> 0")
def stored_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table after appends, re-sends, repeated batches and deletions."""
    return _history(spark, sf).read()


@query("stored_table_versions", f"""
SELECT 0 AS version, client_id, count(*) AS n_rows, SUM4(spend) AS spend FROM campaigns WHERE upload_id % 2 = 0 GROUP BY client_id
UNION ALL SELECT 1, client_id, count(*), SUM4({SENT}) FROM campaigns GROUP BY client_id
UNION ALL SELECT 2, client_id, count(*), SUM4({SENT}) FROM campaigns WHERE upload_id % 5 <> 0 GROUP BY client_id""")
def stored_table_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Each version of the same table, read after all of them were made."""
    table = _history(spark, sf)
    versions = [table.read(v).groupBy("client_id").agg(F.count("*").alias("n_rows"), total("spend").alias("spend")).select(
        F.lit(v).alias("version"), "*") for v in range(3)]
    return versions[0].unionByName(versions[1]).unionByName(versions[2])


@query("action_pages", f"""
WITH {PROPOSED},
placed AS (SELECT client_id, text_hash, platform, upload_id, CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS priority_order,
    arrival FROM proposed)
SELECT client_id, text_hash, platform, upload_id, row_number() OVER (ORDER BY client_id, upload_id, platform, text_hash, arrival) - 1 AS position FROM placed""")
def action_pages(spark: SparkSession, sf: str) -> DataFrame:
    """All proposed actions with their position in one order, read back from the pages they are stored in."""
    from spendlens.operators.state import with_hash

    folder = f"{shared_folder(spark)}/pages/{uuid.uuid4().hex}"
    rows = with_hash(_proposed(spark, sf)).select("client_id", "text_hash", "platform", "upload_id", F.col("arrival.check_order").alias("check_order"))
    paging.write_pages(rows, ["client_id", "upload_id", "platform", "text_hash", "check_order"], folder, 5000)
    return spark.read.parquet(folder).select("client_id", "text_hash", "platform", "upload_id", "position")


@query("counted_sendings", """
SELECT DISTINCT client_id, upload_id, 1 AS sending FROM campaigns
UNION ALL SELECT DISTINCT client_id, upload_id, 3 FROM campaigns WHERE upload_id % 3 = 0""")
def counted_sendings(spark: SparkSession, sf: str) -> DataFrame:
    """Sendings of uploads that count, as a stream with a watermark of a week.

    Of four waves the first counts whole. The second comes three days later, within the week: it
    is dropped. A sending of client -1 moves time on. The third comes after forty days, when
    the first is forgotten: it counts. The fourth is dated before all others, behind the watermark:
    it is dropped.
    """
    home = f"{shared_folder(spark)}/sendings/{uuid.uuid4().hex}"
    uploads = model.campaigns(spark, sf).select("client_id", "upload_id").distinct()
    start = F.lit("2026-01-01 00:00:00").cast("timestamp")
    mark = spark.createDataFrame([(-1, -1)], uploads.schema)
    waves = [(uploads, 1, 0), (uploads.where("upload_id % 2 = 0"), 2, 3), (mark, 0, 30), (uploads.where("upload_id % 3 = 0"), 3, 40),
             (uploads.where("upload_id % 5 = 0"), 4, -30)]
    schema = "client_id long, upload_id long, period_start long, period_end long, sending int, sent_at timestamp"
    for rows, sending, days in waves:
        sent_at = F.timestamp_add("DAY", F.lit(days), start)
        rows.select("client_id", "upload_id", F.col("upload_id").alias("period_start"), F.col("upload_id").alias("period_end"),
                    F.lit(sending).alias("sending"), sent_at.alias("sent_at")).write.mode("append").parquet(f"{home}/inbox")
        stream = arrivals.first_sends(spark.readStream.schema(schema).parquet(f"{home}/inbox"), "sent_at")
        stream.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{home}/out").where("client_id >= 0").select("client_id", "upload_id", "sending")


@query("sketched_benchmarks", """
SELECT client_id, platform, metric, count(v) AS n, TRUE AS within_bound
FROM (SELECT client_id, platform, unnest(['roas', 'cac', 'ctr']) AS metric, unnest([roas, cac, ctr]) AS v FROM campaigns)
GROUP BY client_id, platform, metric""")
def sketched_benchmarks(spark: SparkSession, sf: str) -> DataFrame:
    """Medians per client, platform and metric from sketches that a stream merges batch by batch, held against the exact ranks."""
    home = f"{shared_folder(spark)}/sketches/{uuid.uuid4().hex}"
    facts = model.campaigns(spark, sf).select("client_id", "platform", *benchmarks.METRICS)
    facts.write.parquet(f"{home}/facts")
    stream = spark.readStream.schema(facts.schema).option("maxFilesPerTrigger", 2).parquet(f"{home}/facts")
    arrivals.run_available(stream, benchmarks.sketch_pipeline(f"{home}/sketches"), f"{home}/checkpoint")
    medians = benchmarks.medians(spark, f"{home}/sketches")
    return benchmarks.against_exact(medians, spark.read.parquet(f"{home}/facts")).select("client_id", "platform", "metric", "n", "within_bound")
