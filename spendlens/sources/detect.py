"""Telling which platform an export comes from by weighted header fragments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions.guards import contains_any
from spendlens.sources.exports import read_signals

PLATFORMS = list(fx.SOURCE_SIGNALS)


def _score(text: Column, platform: str) -> Column:
    weights = [F.when(text.contains(s), w).otherwise(0) for s, w in fx.SOURCE_SIGNALS[platform]]
    return reduce(lambda a, b: a + b, weights)


def _matched(text: Column, platform: str) -> Column:
    hits = F.array_compact(F.array(*[F.when(text.contains(s), F.lit(s)) for s, _ in fx.SOURCE_SIGNALS[platform]]))
    return F.array_join(F.slice(hits, 1, 6), ", ")


def detect(df: DataFrame, text: str) -> DataFrame:
    """Add platform, confidence and the fragments that decided, as a projection over each text."""
    lowered = F.lower(F.col(text))
    scored = df.withColumn("peek", lowered).withColumns({f"score_{p}": _score(F.col("peek"), p) for p in PLATFORMS})
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"score_{p}")).alias("down"), F.lit(i).alias("place"), F.lit(p).alias("platform"))
                                    for i, p in enumerate(PLATFORMS)]))
    scored = scored.withColumn("ranked", ranked)
    best, second = -F.col("ranked")[0]["down"], -F.col("ranked")[1]["down"]
    leader = F.col("ranked")[0]["platform"]
    strength = F.floor(best / F.lit(60.0) * 60 + (best - second) / F.lit(40.0) * 40)
    confidence = F.when(best == 0, 0).otherwise(F.greatest(F.lit(10), F.least(F.lit(100), strength))).cast("long")
    meta_only, google_only = (contains_any(F.col("peek"), s) for s in (fx.META_ONLY_SIGNALS, fx.GOOGLE_ONLY_SIGNALS))
    close = F.abs(F.col("score_google") - F.col("score_meta")) < 15
    chosen = F.when(close & meta_only & ~google_only, "meta").when(close & google_only & ~meta_only, "google").otherwise(leader)
    matched = reduce(lambda chain, p: chain.when(leader == p, _matched(F.col("peek"), p)), PLATFORMS[1:],
                     F.when(leader == PLATFORMS[0], _matched(F.col("peek"), PLATFORMS[0])))
    return scored.withColumns(
        {"confidence": confidence, "platform": F.when(confidence >= 20, chosen).otherwise("unknown"), "matched": matched}
    ).drop("peek", "ranked")


def detect_files(spark: SparkSession, path: str) -> DataFrame:
    """Classify every file under ``path`` by its whole content."""
    signals = {s for weights in fx.SOURCE_SIGNALS.values() for s, _ in weights} | {*fx.META_ONLY_SIGNALS, *fx.GOOGLE_ONLY_SIGNALS}
    return detect(read_signals(spark, path, sorted(signals)), "text").drop("text")
