"""Rolling event KPIs over sliding windows, for streams and for tables alike.

Events are summed per day first; windows add up days, so their length does not multiply events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spendlens.functions.guards import count_where, ratio, rnd


def daily_sums(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Cost, value and conversions per day of event time; a stream forgets days once they are ``delay`` past."""
    kind, cents = F.col("event_type"), F.round(F.col("value") * 100).cast("long")
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", delay)
    return timed.groupBy(F.window("at", "1 day")).agg(
        F.sum(F.when(kind.isin("click", "view"), cents).otherwise(0)).alias("cost_cents"),
        F.sum(F.when(kind == "purchase", cents).otherwise(0)).alias("value_cents"),
        count_where(kind == "purchase").alias("conversions"),
    ).select(F.col("window.start").cast("date").alias("day"), "cost_cents", "value_cents", "conversions")


def roll(daily: DataFrame, days: int = 7) -> DataFrame:
    """Spend, conversions, revenue and ROAS of every window of ``days`` that holds one of the days."""
    back = F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("back")
    sums = daily.select("*", back).groupBy(F.date_sub("day", F.col("back")).alias("window_start")).agg(
        *[F.sum(c).alias(c) for c in ("cost_cents", "value_cents", "conversions")])
    spend, revenue = F.col("cost_cents") * 4 / 1000, F.col("value_cents") / 100
    return sums.select("window_start", F.lit(days).alias("days"), spend.alias("spend"), "conversions",
                       revenue.alias("revenue"), rnd(ratio(revenue, spend), 2).alias("roas"))


def rolling_kpis(events: DataFrame, days: int = 7) -> DataFrame:
    return roll(daily_sums(events), days)


def write_daily(events: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Store the days each micro-batch touches under the batch's own id, until all available input is read."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        daily_sums(events, delay).writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """The newest sums of every day."""
    newest = Window.partitionBy("day").orderBy(F.desc("batch_id"))
    return spark.read.parquet(path).withColumn("turn", F.row_number().over(newest)).where("turn = 1").drop("turn", "batch_id")
