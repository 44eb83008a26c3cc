"""Rule-based budget moves: violations, winners and reallocation targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions import formatting as fmt
from spendlens.functions.guards import count_where, ratio, rnd, zero_if_null
from spendlens.operators import alerts, context
from spendlens.operators.dashboard import ranked_within
from spendlens.session import stored

SKIPPED_TAGS = ["brand", "test"]
UPLOAD = ["client_id", "upload_id"]
WINNERS_FUNDED = 3


def _override() -> Column:
    """First override whose keyword is part of the campaign name, as a map of its fields."""
    entries = F.from_json("type_overrides", "array<map<string,string>>")

    def applies(entry: Column) -> Column:
        keyword = F.lower(F.trim(entry["keyword"]))
        return F.coalesce((keyword != "") & F.lower("campaign_name").contains(keyword), F.lit(False))

    return F.get(F.filter(entries, applies), F.lit(0))


def with_thresholds(campaigns: DataFrame, rules: DataFrame) -> DataFrame:
    """Minimum ROAS and maximum cost per lead that apply to each campaign row.

    An override that names a cost limit wins even when it says null (no limit); its ROAS
    floor applies when it states one.
    """
    platform = F.lower("platform")
    base_roas = F.coalesce(alerts.platform_rule("min_roas", platform), F.lit(fx.DEFAULT_MIN_ROAS))
    base_cpl = alerts.platform_rule("min_cpl", platform)
    override = F.col("override")
    sets_cpl = F.coalesce(F.map_contains_key(override, "min_cpl"), F.lit(False))
    return (
        campaigns.join(rules, "client_id", "left")
        .withColumn("override", _override())
        .withColumns(
            {
                "min_roas": F.coalesce(override["min_roas"].try_cast("double"), base_roas),
                "min_cpl": F.when(sets_cpl, override["min_cpl"].try_cast("double")).otherwise(base_cpl),
                "max_shift": F.coalesce("max_shift_pct", F.lit(fx.DEFAULT_MAX_SHIFT_PCT)),
            }
        )
        .drop("override")
    )


def judged_campaigns(campaigns: DataFrame, clients: DataFrame, rules: DataFrame) -> DataFrame:
    """Campaign rows outside brand and test tags with action, shift and reason."""
    rows = with_thresholds(context.with_tags_and_targets(campaigns, clients), rules)
    rows = rows.where(~F.coalesce(F.col("tag").isin(SKIPPED_TAGS), F.lit(False)))
    roas, cac = zero_if_null("roas"), zero_if_null("cac")
    roas_ok = roas >= F.col("min_roas")
    cpl_ok = F.col("min_cpl").isNull() | ((cac > 0) & (cac <= F.col("min_cpl")))
    broken = ~roas_ok | ~cpl_ok
    pause = roas < fx.ROAS_CRITICAL_BELOW
    reasons = F.array_compact(F.array(
        F.when(~roas_ok, F.concat(F.lit("ROAS "), fmt.decimals(roas, 2), F.lit("x below min "),
                                  F.col("min_roas").cast("string"), F.lit("x"))),
        F.when(~cpl_ok, F.concat(F.lit("CPL "), fmt.grouped(cac), F.lit(" above max "), fmt.grouped("min_cpl"))),
    ))
    return rows.select(
        *UPLOAD, "platform", "campaign_name", "roas", "cac", "max_shift", broken.alias("violates"),
        F.when(broken, F.when(pause, "pause").otherwise("decrease")).alias("action"),
        F.when(broken, F.least("max_shift", F.when(pause, 50.0).otherwise(25.0))).alias("shift_pct"),
        F.when(broken, F.when(pause, 90).otherwise(75)).cast("long").alias("confidence"),
        F.when(broken, F.array_join(reasons, "; ")).alias("reason"),
        (~broken & (F.col("severity") == "ok") & (roas >= F.col("min_roas") * 1.5)).alias("wins"),
    )


def budget_actions(campaigns: DataFrame, clients: DataFrame, rules: DataFrame) -> DataFrame:
    judged = judged_campaigns(campaigns, clients, rules)
    return judged.where("violates").select(
        *UPLOAD, "platform", "campaign_name", "roas", "cac", "action", "shift_pct", "confidence", "reason"
    )


def reallocation_targets(campaigns: DataFrame, clients: DataFrame, rules: DataFrame) -> DataFrame:
    """The first three winners of each upload share what its violations freed.

    Winners are taken search ads before social ads, lowest ROAS first; the share divides by
    all winners, as many as there are.
    """
    judged = stored(judged_campaigns(campaigns, clients, rules))
    pot = judged.groupBy(*UPLOAD).agg(F.sum("shift_pct").alias("freed"), count_where(F.col("wins")).alias("winners"))
    order = [F.when(F.col("platform") == "google", 0).otherwise(1), F.asc("roas"), F.asc("campaign_name")]
    funded = ranked_within(judged.where("wins"), UPLOAD, order, WINNERS_FUNDED, "winner_order")
    share = F.least(F.col("max_shift"), ratio("freed", "winners"))
    return funded.join(pot.where("freed > 0"), UPLOAD).select(
        *UPLOAD, "winner_order", "platform", "campaign_name", rnd(share, 1).alias("increase_pct"),
        rnd("freed", 1).alias("total_freed_budget_pct"),
    )
