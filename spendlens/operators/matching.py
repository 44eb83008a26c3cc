"""Matching names that contain one another, without comparing every pair.

A name contains a key exactly when one of its substrings equals that key. Substrings of
the lengths that occur on the other side are produced per name and joined on equality, so
the work grows with the number of names and hot names are handled by ordinary hash joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.operators.paging import numbered


def name_key(name: Column | str) -> Column:
    return F.lower(F.trim(F.col(name) if isinstance(name, str) else name))


def _substrings(df: DataFrame, keys: list[str], text: str, lengths: DataFrame) -> DataFrame:
    """All distinct substrings of ``text`` having one of the lengths known for its group."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - F.col("len") + 1, F.lit(1)))
    pieces = F.transform(starts, lambda s: F.substring(F.col(text), s, F.col("len")))
    return (
        df.join(lengths, keys)
        .withColumn("len", F.explode("lengths"))
        .where(F.col("len") <= F.length(text))
        .withColumn("piece", F.explode(F.array_distinct(pieces)))
        .drop("lengths", "len")
    )


def _lengths(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Distinct name lengths per group: never more than the longest name has characters."""
    return df.groupBy(*keys).agg(F.collect_set(F.length(text)).alias("lengths"))


def first_match(names: DataFrame, candidates: DataFrame, keys: list[str], name: str, candidate: str, order: str,
                min_length: int = 1, prefer_exact: bool = True) -> DataFrame:
    """For each distinct (keys, name) the first candidate that equals, contains or is contained in it.

    ``order`` ranks candidates within ``keys``; equal names win first when ``prefer_exact``.
    Containment counts only when the shorter name has ``min_length`` characters. Returns
    (keys, name, candidate) with both names lower-cased and trimmed.
    """
    left = names.select(*keys, name_key(name).alias(name)).where(F.col(name) != "").distinct()
    right = (
        candidates.select(*keys, name_key(candidate).alias(candidate), F.col(order).alias("place"))
        .where(F.col(candidate) != "")
        .groupBy(*keys, candidate).agg(F.min("place").alias("place"))
    )
    exact = left.join(right.withColumnRenamed(candidate, name), [*keys, name])
    found = exact.select(*keys, name, F.col(name).alias(candidate), "place", F.lit(0).alias("kind"))

    open_names = left.join(exact.select(*keys, name), [*keys, name], "left_anti") if prefer_exact else left
    long_left = open_names.where(F.length(name) >= min_length)
    short_right = right.where(F.length(candidate) >= min_length)
    # candidate inside name
    inside = _substrings(long_left, keys, name, _lengths(short_right, keys, candidate)).join(
        short_right.withColumn("piece", F.col(candidate)), [*keys, "piece"]
    )
    # name inside candidate: reduce to the first candidate per substring before the join
    around = (
        _substrings(short_right, keys, candidate, _lengths(long_left, keys, name))
        .groupBy(*keys, "piece")
        .agg(F.min_by(F.struct(candidate, "place"), F.struct("place", candidate)).alias("first"))
        .select(*keys, F.col("piece").alias(name), f"first.{candidate}", "first.place")
        .join(long_left, [*keys, name])
    )
    kind = F.lit(1 if prefer_exact else 0).alias("kind")
    columns = [*keys, name, candidate, "place"]
    everything = found.unionByName(inside.select(*columns, kind)).unionByName(around.select(*columns, kind))
    best = F.min_by(candidate, F.struct("kind", "place", candidate)).alias(candidate)
    return everything.groupBy(*keys, name).agg(best)


def reconciliation(campaigns: DataFrame, funnel: DataFrame, keys: list[str], campaign: str, funnel_name: str) -> DataFrame:
    """Which funnel rows find a campaign, and what is left over on either side."""
    pairs = first_match(funnel, campaigns.withColumn("order_name", name_key(campaign)), keys, funnel_name, campaign,
                        "order_name", prefer_exact=False)
    all_funnel = funnel.select(*keys, name_key(funnel_name).alias(funnel_name)).distinct()
    all_campaigns = campaigns.select(*keys, name_key(campaign).alias(campaign)).distinct()
    nothing = F.lit(None).cast("string")
    return (
        pairs.select(*keys, F.lit("matched").alias("kind"), funnel_name, campaign)
        .unionByName(
            all_funnel.join(pairs, [*keys, funnel_name], "left_anti")
            .select(*keys, F.lit("unmatched_funnel").alias("kind"), funnel_name, nothing.alias(campaign))
        )
        .unionByName(
            all_campaigns.join(pairs, [*keys, campaign], "left_anti")
            .select(*keys, F.lit("unmatched_campaign").alias("kind"), nothing.alias(funnel_name), campaign)
        )
    )


def resolve_clients(bulk_names: DataFrame, clients: DataFrame) -> DataFrame:
    """Client id per bulk name: known client by name (exact, then containment, first by client name), else a new id."""
    one = F.lit(0).alias("pool")
    wanted = bulk_names.select(one, F.trim("client_name").alias("bulk_name"), name_key("client_name").alias("bulk_key"))
    known = clients.select(one, "client_id", "client_name", name_key("client_name").alias("known_key"))
    matched = first_match(wanted, known, ["pool"], "bulk_key", "known_key", "client_name")
    ids = known.groupBy("known_key").agg(F.min("client_id").alias("client_id"))
    resolved = wanted.join(matched, ["pool", "bulk_key"], "left").join(ids, "known_key", "left")
    fresh = resolved.where(F.col("client_id").isNull()).select("pool", "bulk_key").distinct()
    # numbered by ranges of the names, so names that begin alike are spread too
    placed = numbered(fresh, ["bulk_key"], "new_number")
    top = clients.groupBy(one).agg(F.max("client_id").alias("top_id"))
    created = placed.join(top, "pool").select("bulk_key", (F.col("top_id") + F.col("new_number") + 1).alias("new_id"))
    return resolved.join(created, "bulk_key", "left").select(
        "bulk_name", F.coalesce("client_id", "new_id").alias("client_id"), F.col("new_id").isNotNull().alias("is_new")
    )
