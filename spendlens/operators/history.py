"""Period order of uploads and per-campaign history windows.

Uploads are ranked per client by period; campaign rows carry that rank, so "the last N
uploads" is a range over ranks even when a campaign is missing from some of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendlens.session import stored
from spendlens.sources import model

CAMPAIGN = ["client_id", "platform", "campaign_name"]
BLOCK = 512  # ranks per window block


def chunked_rank(df: DataFrame, keys: list[str], chunk: Column, order: list[str], name: str) -> DataFrame:
    """Row number per key in the given order, computed chunk by chunk.

    ``chunk`` has to rise with the order. Each chunk is numbered on its own and chunk totals
    give the offset, so a key that holds most rows is spread over its chunks. Adds
    ``<name>`` and ``<name>_total``.
    """
    marked = df.withColumn("chunk", chunk)
    sizes = marked.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("chunk_size"))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "chunk",
        F.coalesce(F.sum("chunk_size").over(earlier), F.lit(0)).alias("chunk_offset"),
        F.sum("chunk_size").over(Window.partitionBy(*keys)).alias(f"{name}_total"),
    )
    within = Window.partitionBy(*keys, "chunk").orderBy(*order)
    numbered = marked.withColumn("in_chunk", F.row_number().over(within)).join(offsets, [*keys, "chunk"])
    return numbered.withColumn(name, F.col("in_chunk") + F.col("chunk_offset")).drop("chunk", "in_chunk", "chunk_offset")


def rank_uploads(uploads: DataFrame, day: str = "period_date") -> DataFrame:
    """Number each client's uploads by (day, upload_id), oldest first, split by calendar year."""
    # uploads without a day come first and have a chunk of their own: chunks are joined by equality
    ranked = chunked_rank(uploads, ["client_id"], F.coalesce(F.year(day), F.lit(-1)), [F.asc_nulls_first(day), F.asc("upload_id")], "upload_rank")
    return ranked.withColumnRenamed("upload_rank_total", "upload_count")


def attach_ranks(campaigns: DataFrame, uploads: DataFrame) -> DataFrame:
    ranks = rank_uploads(uploads).select("upload_id", "upload_rank", "upload_count")
    return campaigns.join(ranks, "upload_id")


def ranked_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attach_ranks(model.campaigns(spark, sf_dir), stored_uploads(spark, sf_dir))


def stored_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uploads table, written once: ranking reads it twice and orders should be scanned once."""
    return stored(model.uploads(spark, sf_dir))


def in_blocks(df: DataFrame, lookback: int) -> DataFrame:
    """Cut each campaign's history into blocks, repeating the last ``lookback`` ranks in the next.

    Windows then partition by ``block`` too, so one endless history never becomes one task;
    rows with ``is_halo`` only serve as context and are dropped afterwards.
    """
    block = F.floor(F.col("upload_rank") / BLOCK)
    near_end = F.col("upload_rank") % BLOCK >= BLOCK - lookback
    copies = F.when(near_end, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        df.withColumn("halo", F.explode(copies))
        .withColumn("block", block + F.col("halo"))
        .withColumn("is_halo", F.col("halo") == 1)
        .drop("halo")
    )


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_halo")).drop("block", "is_halo")


def campaign_window(first: int, last: int) -> "Window":
    return Window.partitionBy(*CAMPAIGN, "block").orderBy("upload_rank").rangeBetween(first, last)


def with_prior(campaigns: DataFrame, columns: list[str]) -> DataFrame:
    """Values of the same campaign in the client's directly preceding upload, as ``prior_*``."""
    before = campaign_window(-1, -1)
    blocks = in_blocks(campaigns, 1)
    added: dict[str, Column] = {f"prior_{c}": F.first(c).over(before) for c in columns}
    added["has_prior"] = F.count(F.lit(1)).over(before) > 0
    return own_rows(blocks.withColumns(added))


def last_uploads(uploads: DataFrame, periods: int) -> DataFrame:
    """Each client's most recent uploads by period."""
    ranked = rank_uploads(uploads)
    return ranked.where(F.col("upload_rank") > F.col("upload_count") - periods)


def campaign_history(campaigns: DataFrame, uploads: DataFrame, periods: int) -> DataFrame:
    """Campaign rows in the client's last ``periods`` uploads."""
    return campaigns.join(last_uploads(uploads, periods).select("upload_id"), "upload_id", "left_semi")


def latest_by(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The latest row per key, found with map-side combine instead of a sort per key."""
    packed = F.max_by(F.struct(*columns), F.struct(*order)).alias("latest")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"latest.{c}").alias(c) for c in columns])
