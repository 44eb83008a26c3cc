"""Pages of a long list by its order: numbered without one big sort task, stored so that a page is one pruned read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.session import stored

#: Rows that lie in one folder of a paged list.
CHUNK_ROWS = 100_000


def numbered(rows: DataFrame, order: list[str | Column], column: str = "position") -> DataFrame:
    """Rows with their number (from 0) in a total order.

    Rows are dealt to ranges of the order and sorted there; a row's number is the count of the ranges
    before plus its place in its own. Only the counts, a row per range, come together. Rows that
    tie in ``order`` stand in any order among themselves, so it ought to be total.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(ranges.withColumn("_range", F.spark_partition_id()).withColumn(
        "_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = placed.groupBy("_range").count().orderBy("_range").collect()
    offsets, before = {}, 0
    for r in counts:
        offsets[r["_range"]] = before
        before += r["count"]
    if not offsets:
        return placed.withColumn(column, F.lit(0).cast("long")).drop("_range", "_place")
    known = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    return placed.withColumn(column, known[F.col("_range")] + F.col("_place")).drop("_range", "_place")


def write_pages(rows: DataFrame, order: list[str | Column], folder: str, chunk_rows: int = CHUNK_ROWS) -> None:
    """Store a list for reading by page: sorted files, a folder for every ``chunk_rows`` rows."""
    chunk = F.floor(F.col("position") / F.lit(chunk_rows)).cast("long")
    numbered(rows, order).withColumn("chunk", chunk).repartition("chunk").sortWithinPartitions("position").write.partitionBy("chunk").parquet(folder)


def read_page(paged: DataFrame, page: int, page_rows: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Page ``page`` (from 0) of a stored list in order; only the folders that hold it are read."""
    first, last = page * page_rows, (page + 1) * page_rows - 1
    held = paged.where(F.col("chunk").between(first // chunk_rows, last // chunk_rows) & F.col("position").between(first, last))
    return held.drop("chunk").orderBy("position")
