"""KPI alerts: campaign rows against goals, rules and the preceding upload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions import formatting as fmt
from spendlens.functions.guards import first_present, pct_change, present, ratio, rnd, zero_if_null
from spendlens.operators import context, history

BRAND_TAGS = ["brand", "brand_awareness"]
ALERT_ORDER = {"high": 0, "medium": 1}


def _alert(kind: str, fires: Column, threshold: Column, actual: Column, pct: Column, high: Column, message: Column) -> Column:
    row = F.struct(
        F.lit(kind).alias("alert_type"), threshold.cast("double").alias("threshold"),
        actual.cast("double").alias("actual_value"), pct.alias("deviation_pct"),
        F.when(high, "high").otherwise("medium").alias("severity"), message.alias("message"),
    )
    return F.when(fires, row)


def platform_rule(name: str, platform: Column) -> Column:
    """The rule column of the row's platform (``google_<name>`` or ``meta_<name>``)."""
    return F.when(platform == "google", F.col(f"google_{name}")).when(platform == "meta", F.col(f"meta_{name}"))


def kpi_alerts(campaigns: DataFrame, clients: DataFrame, rules: DataFrame) -> DataFrame:
    """All alerts of all uploads. ``campaigns`` carries upload ranks (see ``history``)."""
    measured = ["spend", "conversions", "cac", "ctr", "clicks"]
    rows = history.with_prior(campaigns, measured)
    rows = context.with_tags_and_targets(rows, clients).join(rules, "client_id", "left")

    platform = F.lower("platform")
    spend, conv, roas = (zero_if_null(c) for c in ("spend", "conversions", "roas"))
    cac, ctr = zero_if_null("cac"), zero_if_null("ctr")
    p_spend, p_conv, p_cac, p_ctr = (zero_if_null(f"prior_{c}") for c in ("spend", "conversions", "cac", "ctr"))
    cvr = ratio(conv, zero_if_null("clicks")) * 100
    p_cvr = ratio(p_conv, zero_if_null("prior_clicks")) * 100
    brand = F.coalesce(F.col("tag").isin(BRAND_TAGS), F.lit(False))
    known_before = F.col("has_prior")

    floor = F.coalesce(
        first_present("target_roas", platform_rule("min_roas", platform), "google_min_roas"), F.lit(fx.DEFAULT_MIN_ROAS)
    )
    ceiling = F.coalesce(first_present("target_cpa", "target_cpl"), present(platform_rule("min_cpl", platform)))
    over_ceiling = ~brand & ceiling.isNotNull() & (cac > 0) & (cac > ceiling * 1.3)
    cac_change, ctr_change = pct_change(cac, p_cac), pct_change(ctr, p_ctr)
    cvr_change, spend_change = pct_change(cvr, p_cvr), pct_change(spend, p_spend)
    rose = ~F.coalesce(over_ceiling, F.lit(False)) & ~brand & known_before & (cac > 0) & (p_conv > 0) & (p_cac > 0)

    def from_prior(lead: str, pct: Column, note: str, now: Column, then: Column) -> Column:
        return F.concat(F.lit(lead), fmt.decimals(F.abs(pct), 0), F.lit(note), now, F.lit(" vs "), then, F.lit(")"))

    def pct2(value: Column) -> Column:
        return F.concat(fmt.decimals(value, 2), F.lit("%"))

    # FIXED VALUES: alert types, limits and message wording
    found = [
        _alert("roas_below", ~brand & (spend > 50) & (roas > 0) & (roas < floor), floor, rnd(roas, 2),
               pct_change(roas, floor), pct_change(roas, floor) < -30,
               F.concat(F.lit("ROAS "), fmt.decimals(roas, 2), F.lit("x below target "), floor.cast("string"), F.lit("x"))),
        _alert("zero_conversions", (spend > 100) & (conv == 0), F.lit(1), F.lit(0), F.lit(-100.0), F.lit(True),
               F.concat(F.lit("Zero conversions with "), fmt.grouped(spend), F.lit(" spend"))),
        _alert("cpa_spike", over_ceiling, ceiling, rnd(cac, 2), pct_change(cac, ceiling), pct_change(cac, ceiling) > 50,
               F.concat(F.lit("CPA "), fmt.grouped(cac), F.lit(" exceeds ceiling "), fmt.grouped(ceiling))),
        _alert("cpa_spike", rose & (cac_change > 30), rnd(p_cac, 2), rnd(cac, 2), cac_change, cac_change > 50,
               from_prior("CPA up ", cac_change, "% vs prior period (", fmt.grouped(cac), fmt.grouped(p_cac))),
        _alert("ctr_drop", known_before & (ctr > 0) & (p_ctr > 0) & (ctr_change < -20), rnd(p_ctr, 2), rnd(ctr, 2),
               ctr_change, ctr_change < -40, from_prior("CTR dropped ", ctr_change, "% (", pct2(ctr), pct2(p_ctr))),
        _alert("cvr_drop", known_before & (cvr > 0) & (p_cvr > 0) & (cvr_change < -25), rnd(p_cvr, 2), rnd(cvr, 2),
               cvr_change, cvr_change < -40, from_prior("CVR dropped ", cvr_change, "% (", pct2(cvr), pct2(p_cvr))),
        _alert("spend_overpace", known_before & (p_spend > 0) & (spend_change > 40), rnd(p_spend, 2), rnd(spend, 2),
               spend_change, spend_change > 30,
               from_prior("Spend up ", spend_change, "% vs prior (", fmt.grouped(spend), fmt.grouped(p_spend))),
        _alert("spend_underpace", known_before & (p_spend > 0) & (spend > 0) & (spend_change < -40), rnd(p_spend, 2),
               rnd(spend, 2), spend_change, F.lit(False),
               from_prior("Spend down ", spend_change, "% vs prior (", fmt.grouped(spend), fmt.grouped(p_spend))),
    ]
    alert = F.explode(F.array_compact(F.array(*found))).alias("alert")
    return rows.select(
        "client_id", "upload_id", "upload_rank", "upload_count", F.col("campaign_name").alias("campaign"),
        platform.alias("platform"), alert,
    ).select("client_id", "upload_id", "upload_rank", "upload_count", "campaign", "platform", "alert.*")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def alert_list(alerts: DataFrame, clients: DataFrame, limit: int = 100, client_id: int | None = None,
               status: str | None = None) -> DataFrame:
    """The most severe and newest alerts with client names."""
    for column, value in (("client_id", client_id), ("status", status)):
        if value is not None:
            alerts = alerts.where(F.col(column) == value)
    order = [severity_rank(F.col("severity")), F.desc("created_on"), "client_id", "upload_id", "campaign", "platform", "alert_type"]
    first = alerts.orderBy(*order).limit(limit)
    return first.join(clients.select("client_id", "client_name"), "client_id", "left")
