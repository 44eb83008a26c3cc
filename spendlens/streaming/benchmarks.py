"""Benchmarks kept up to date by mergeable quantile sketches: a batch reads its own rows, never the history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ["roas", "cac", "ctr"]
KEYS = ["client_id", "platform", "metric"]
#: Size of a sketch: with 800 a rank is off by at most 0.01 of all values, with a probability of 0.99 and more.
SKETCH_K = 800
RANK_ERROR = 0.01


def unpivoted(facts: DataFrame) -> DataFrame:
    return facts.select("client_id", "platform", F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))


def sketches(facts: DataFrame) -> DataFrame:
    """One sketch per client, platform and metric, with the number of values in it; built map-side and merged."""
    return unpivoted(facts).groupBy(*KEYS).agg(F.kll_sketch_agg_double("value", SKETCH_K).alias("sketch"), F.count("value").alias("n"))


def sketch_pipeline(folder: str) -> Callable[[DataFrame, int], None]:
    """Work per micro-batch: store the batch's sketches under its id, so a repeated batch replaces itself."""

    def run(batch: DataFrame, batch_id: int) -> None:
        sketches(batch).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return run


def merged(spark: SparkSession, folder: str) -> DataFrame:
    """All batches' sketches as one per key: reads a bounded number of bytes per batch and key."""
    return spark.read.parquet(folder).groupBy(*KEYS).agg(F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"), F.sum("n").alias("n"))


def medians(spark: SparkSession, folder: str) -> DataFrame:
    """Approximate median per key; null without values."""
    return merged(spark, folder).select(*KEYS, "n", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.5))).alias("median"))


def against_exact(found: DataFrame, facts: DataFrame, error: float = RANK_ERROR) -> DataFrame:
    """Whether each median's exact rank among all values is the half, give or take ``error``."""
    values = unpivoted(facts).where("value IS NOT NULL").join(found.select(*KEYS, "median"), KEYS)
    ranks = values.groupBy(*KEYS).agg(F.avg((F.col("value") < F.col("median")).cast("double")).alias("below"),
                                      F.avg((F.col("value") <= F.col("median")).cast("double")).alias("up_to"))
    return found.join(ranks, KEYS, "left").withColumn(
        "within_bound", F.coalesce((F.col("below") <= 0.5 + error) & (F.col("up_to") >= 0.5 - error), F.col("n") == 0))
