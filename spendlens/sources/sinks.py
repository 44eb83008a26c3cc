"""Appending results to the stored tables, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.functions.guards import ratio, rnd, zero_if_null

PARTITION = "client_id"


def append_table(df: DataFrame, folder: str, name: str) -> None:
    """Append rows to a stored table, partitioned by client for pruning.

    The rebalance hint lets adaptive execution split a large client over many writers and
    put small clients together, so files come out at the advisory partition size.
    """
    df.hint("rebalance", PARTITION).write.mode("append").partitionBy(PARTITION).parquet(f"{folder.rstrip('/')}/{name}")


def read_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{folder.rstrip('/')}/{name}")


def scan(df: DataFrame, client_id: int | None = None, upload_id: int | None = None, row_level: str | None = None) -> DataFrame:
    """Filtered read of a stored table; the client filter prunes partitions."""
    for column, value in (("client_id", client_id), ("upload_id", upload_id), ("row_level", row_level)):
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def granular_table_rows(df: DataFrame, row_level: str) -> DataFrame:
    """Rows below campaign level in their stored shape, with rates recomputed at 4 decimals."""
    have = set(df.columns)

    def pick(*names: str) -> Column:
        found = [F.col(n).cast("string") for n in names if n in have]
        return F.coalesce(*found, F.lit("")) if found else F.lit("")

    def number(*names: str) -> Column:
        found = [n for n in names if n in have]
        return zero_if_null(F.col(found[0]).cast("double")) if found else F.lit(0.0)

    spend, clicks, views = number("cost", "amount spent", "spend"), number("clicks"), number("impressions")
    value = number("conversion value")
    keep = [c for c in ("client_id", "upload_id", "platform") if c in have]
    return df.select(
        *keep,
        F.lit(row_level).alias("row_level"),
        pick("campaign", "campaign name").alias("campaign_name"),
        pick("ad group", "ad set name", "adgroup").alias("adgroup_name"),
        pick("keyword", "keywords").alias("keyword_name"),
        pick("ad name", "ad").alias("ad_name"),
        pick("placement", "site").alias("placement_name"),
        views.alias("impressions"), clicks.alias("clicks"), spend.alias("spend"),
        number("conversions", "results").alias("conversions"), value.alias("conversion_value"),
        rnd(ratio(value, spend), 4).alias("roas"),
        rnd(ratio(clicks, views) * 100, 4).alias("ctr"),
        rnd(ratio(spend, clicks), 4).alias("cpc"),
        number("quality score").cast("int").alias("quality_score"),
        pick("match type").alias("match_type"),
        pick("ad type").alias("ad_type"),
    )


def export_rows(campaigns: DataFrame, funnel: DataFrame) -> DataFrame:
    """Campaign rows with funnel columns, rounded for a CSV export."""
    stages = ["leads", "mqls", "sqls", "customers", "cost_per_lead", "cost_per_mql", "cost_per_customer"]
    return campaigns.join(funnel.select("upload_id", "campaign_name", *stages), ["upload_id", "campaign_name"], "left").select(
        "client_id", "upload_id", "platform", F.col("campaign_name").alias("campaign"),
        rnd(zero_if_null("spend"), 2).alias("spend"),
        zero_if_null("impressions").cast("long").alias("impressions"),
        zero_if_null("clicks").cast("long").alias("clicks"),
        rnd(zero_if_null("conversions"), 1).alias("conversions"),
        rnd(zero_if_null("conversion_value"), 2).alias("conversion_value"),
        *[rnd(zero_if_null(c), 2).alias(c) for c in ("roas", "cac", "ctr", "cpc")],
        "severity",
        rnd(zero_if_null("wasted_spend"), 2).alias("wasted_spend"),
        *stages,
    )


def write_export(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
