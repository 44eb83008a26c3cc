"""Medians: of short arrays, and exact ones over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_OCTAVE = 4096


def array_median(values: Column) -> Column:
    """Median of a short array; null when it is empty."""
    ordered = F.array_sort(values)
    size = F.size(values)
    low = F.get(ordered, F.floor((size - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(size / 2).cast("int"))
    return F.when(size > 0, (low + high) / 2)


def _ordered_bin(value: Column) -> Column:
    """A monotone integer bin of a double, fine enough to spread any smooth distribution."""
    magnitude = F.floor(F.log2(F.abs(value)) * BINS_PER_OCTAVE).cast("long") + F.lit(1 << 40)
    return F.when(value > 0, magnitude).when(value < 0, -magnitude).otherwise(F.lit(0)).cast("long")


def exact_medians(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Exact median of each value column per key, without gathering a group in one task.

    Values are reduced to (key, metric, bin) counts with map-side combine; running totals
    over bins locate the one or two bins that hold the middle ranks; only the distinct
    values of those bins are ranked. A group holding most of the table is therefore
    handled like any other.
    """
    long_rows = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
        ).alias("item"),
    ).select(*keys, "item.metric", "item.value").where(F.col("value").isNotNull())
    group = [*keys, "metric"]
    counts = long_rows.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("copies"))
    counts = counts.withColumn("bin", _ordered_bin(F.col("value")))

    by_bin = counts.groupBy(*group, "bin").agg(F.sum("copies").alias("in_bin"))
    running = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    located = (
        by_bin.withColumn("before", F.coalesce(F.sum("in_bin").over(running), F.lit(0)))
        .withColumn("total", F.sum("in_bin").over(whole))
        .withColumn("low", F.floor((F.col("total") + 1) / 2))
        .withColumn("high", F.floor(F.col("total") / 2) + 1)
        .where(
            (F.col("before") < F.col("high")) & (F.col("before") + F.col("in_bin") >= F.col("low"))
        )
        .select(*group, "bin", "before", "low", "high")
    )
    inside = Window.partitionBy(*group, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        counts.join(located, [*group, "bin"])
        .withColumn("upto", F.col("before") + F.sum("copies").over(inside))
        .withColumn("from", F.col("upto") - F.col("copies") + 1)
    )

    def at(rank: str) -> Column:
        return F.max(F.when((F.col(rank) >= F.col("from")) & (F.col(rank) <= F.col("upto")), F.col("value")))

    medians = picked.groupBy(*group).agg(((at("low") + at("high")) / 2).alias("median"))
    return medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("metric") == v, F.col("median"))).alias(f"median_{v}") for v in values]
    )
