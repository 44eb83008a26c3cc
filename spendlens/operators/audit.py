"""Account-health checks per upload and platform, scores and recommendations.

One aggregation computes every measure a check needs; the checks are expressions over
that single row, so twenty-one checks cost one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions import formatting as fmt
from spendlens.functions.guards import contains_any, count_where, first_present, mean, present, ratio, rnd, total, zero_if_null
from spendlens.operators import alerts, context
from spendlens.session import stored

KEYS = ["client_id", "upload_id", "upload_rank", "platform"]


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _count_text(value: Column) -> Column:
    return value.cast("string")


class _Check:
    """A check under construction: the first outcome whose condition holds applies."""

    def __init__(self, name: str, category: str):
        self.name, self.category, self.outcomes = name, category, []

    def when(self, condition: Column, status: str, reason: Column | str, action: Column | str | None = None,
             campaign: Column | None = None, priority: str = "medium") -> "_Check":
        def as_text(value) -> Column:
            if value is None:
                return F.lit(None).cast("string")
            return F.lit(value) if isinstance(value, str) else value

        self.outcomes.append((condition, F.struct(
            F.lit(status).alias("status"), as_text(reason).alias("reason"), as_text(action).alias("action"),
            as_text(campaign).alias("campaign"), F.lit(priority).alias("priority"),
        )))
        return self

    def otherwise(self, status: str, reason: Column | str) -> Column:
        self.when(F.lit(True), status, reason)
        first, *rest = self.outcomes
        outcome = reduce(lambda chain, o: chain.when(*o), rest, F.when(*first))
        return F.struct(F.lit(self.name).alias("check_name"), F.lit(self.category).alias("category"), outcome.alias("outcome"))


def _flags() -> dict[str, Column]:
    """Per-campaign conditions the checks count or name."""
    spend, conv = zero_if_null("spend"), zero_if_null("conversions")
    roas, cac = zero_if_null("roas"), zero_if_null("cac")
    views, clicks = zero_if_null("impressions"), zero_if_null("clicks")
    own = ~F.col("is_brand")
    cpa_goal, roas_goal = F.col("cpa_goal"), F.col("roas_goal")
    flags = {
        "zero_conv": (conv == 0) & (spend > 100),
        "learning": (views > 0) & (views < fx.LEARNING_IMPRESSIONS) & (spend > 0),
        "zero_spend": spend == 0,
        "ghost": (views > 1000) & (clicks == 0),
        "cpa_far": own & (conv > 0) & (cac > cpa_goal * 1.5),
        "cpa_over": own & (conv > 0) & (cac > cpa_goal),
        "roas_far": own & (spend > 100) & (roas < roas_goal * 0.7),
        "roas_under": own & (spend > 100) & (roas < roas_goal),
        "cpc_high": (spend > 50) & (F.col("cpc") > 0) & (F.col("cpc") > F.col("mean_cpc") * 2.5),
        "roas_odd": (spend > 0) & ((roas > F.col("mean_roas") * 3) | ((roas < F.col("mean_roas") * 0.3) & (roas > 0))),
    }
    return {name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()}


NAMED = {"zero_conv": 3, "learning": 3, "zero_spend": 3, "ghost": 2, "cpa_far": 3, "roas_far": 3, "cpc_high": 2}


def _with_group_means(rows: DataFrame) -> DataFrame:
    """Means an outlier test compares against, joined back from a small aggregate."""
    spend = zero_if_null("spend")
    means = rows.groupBy(*KEYS).agg(
        mean(F.when(spend > 0, zero_if_null("roas"))).alias("mean_roas"),
        mean(F.when((spend > 50) & (F.col("cpc") > 0), F.col("cpc"))).alias("mean_cpc"),
    )
    return rows.join(means, KEYS)


def _named_examples(rows: DataFrame) -> DataFrame:
    """Example names per check: ranked within (upload, platform, flag), only the first few kept."""
    flagged = rows.select(
        *KEYS, "campaign_name", "spend",
        F.explode(F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in NAMED]))).alias("flag"),
    )
    spec = Window.partitionBy(*KEYS, "flag").orderBy(F.desc("spend"), "campaign_name")
    first = flagged.withColumn("place", F.row_number().over(spec)).where(F.col("place") <= max(NAMED.values()))

    def names(flag: str, limit: int) -> Column:
        wanted = F.when((F.col("flag") == flag) & (F.col("place") <= limit), F.struct("place", "campaign_name"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(wanted)), lambda e: e["campaign_name"]), ", ")

    leading = F.max(F.when((F.col("flag") == "roas_far") & (F.col("place") == 1), F.col("campaign_name")))
    return first.groupBy(*KEYS).agg(*[names(f, n).alias(f"{f}_names") for f, n in NAMED.items()], leading.alias("roas_far_first"))


def _measures(rows: DataFrame) -> DataFrame:
    """All measures per (upload, platform) in one aggregation."""
    spend, conv, roas = zero_if_null("spend"), zero_if_null("conversions"), zero_if_null("roas")
    name = F.lower("campaign_name")
    own = ~F.col("is_brand")
    top = F.min_by(
        F.struct("campaign_name", "spend", "roas", "conversions", "ctr", "is_brand"),
        F.struct((-spend).alias("by_spend"), F.col("campaign_name").alias("by_name")),
    )
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        *[count_where(F.col(f)).alias(f"{f}_n") for f in _flags()],
        count_where(zero_if_null("conversion_value") > 0).alias("valued_n"),
        count_where(conv > 0).alias("converting_n"),
        count_where((spend > 0) & (F.col("roas").isNull() | (F.col("roas") < 0))).alias("bad_roas_n"),
        count_where(spend > 0).alias("spending_n"),
        count_where((spend > 50) & (F.col("cpc") > 0)).alias("priced_n"),
        count_where(own & (spend > 100)).alias("judged_n"),
        count_where(F.col("is_brand")).alias("brand_n"),
        F.max(F.coalesce(F.col("has_targets"), F.lit(False))).alias("has_targets"),
        F.max("rule_cpl").alias("rule_cpl"), F.max("rule_roas").alias("rule_roas"),
        total("spend").alias("spend"), total("conversion_value").alias("revenue"),
        total(F.when(own, F.col("wasted_spend"))).alias("own_waste"), total(F.when(own, F.col("spend"))).alias("own_spend"),
        mean(F.when(spend > 50, zero_if_null("ctr"))).alias("spending_ctr"),
        F.max("mean_cpc").alias("mean_cpc"),
        F.max(contains_any(F.col("campaign_name"), ["_", " - ", "|"])).alias("structured_names"),
        F.max(contains_any(name, fx.AWARENESS_WORDS)).alias("has_awareness"),
        F.max(contains_any(name, fx.CONVERSION_WORDS)).alias("has_conversion"),
        *[F.max(contains_any(name, words)).alias(f"format_{f}") for f, words in fx.FORMAT_WORDS.items()],
        top.alias("top"),
    )


def ctr_trend(campaigns: DataFrame) -> DataFrame:
    """Per client and platform: mean non-zero CTR per upload, and whether it only ever fell."""
    per_upload = campaigns.groupBy("client_id", "platform", "upload_rank").agg(mean(present("ctr")).alias("ctr"))
    known = per_upload.where(F.col("ctr").isNotNull())
    chain = Window.partitionBy("client_id", "platform").orderBy("upload_rank")
    steps = known.withColumn("fell", F.lag("ctr").over(chain) > F.col("ctr"))
    return steps.groupBy("client_id", "platform").agg(
        F.count(F.lit(1)).alias("ctr_periods"), F.coalesce(F.bool_and("fell"), F.lit(False)).alias("ctr_always_fell"),
        F.min_by("ctr", "upload_rank").alias("first_ctr"), F.max_by("ctr", "upload_rank").alias("last_ctr"),
    )


def _checks() -> list[Column]:
    """The twenty-one checks in report order.

    FIXED VALUES: check names, categories, limits and the wording of reasons and actions.
    """
    c = F.col
    platform = c("platform")

    def n(flag: str) -> Column:
        return _count_text(c(f"{flag}_n"))

    def pct0(value: Column) -> Column:
        return _text(fmt.decimals(value, 0), "%")

    tracking, structure, sets = "Tracking Foundation", "Campaign Architecture", "Ad Set Configuration"
    creative, cost, account = "Creative Performance", "Cost Diagnostics", "Account Health"
    coverage = c("valued_n") / c("n")
    top_share = ratio(zero_if_null("top.spend"), c("spend")) * 100
    inactive = c("zero_spend_n") / c("n") * 100
    benchmark = F.when(platform == "meta", fx.CTR_BENCHMARK["meta"]).otherwise(fx.CTR_BENCHMARK["google"])
    avg_ctr = c("spending_ctr")
    no_goal = present("rule_cpl").isNull() & ~c("has_targets")
    goal_text = F.coalesce(fmt.grouped(c("rule_cpl")), F.lit("per-campaign"))
    no_floor = present("rule_roas").isNull() & ~c("has_targets")
    floor_text = F.coalesce(c("rule_roas").cast("string"), F.lit("None"))
    waste_pct = ratio("own_waste", "own_spend") * 100
    excluded = F.when(c("brand_n") > 0, _text(" (", _count_text(c("brand_n")), " brand campaign(s) excluded from waste ratio)")).otherwise("")
    account_roas = ratio("revenue", "spend")
    formats = [F.when(c(f"format_{f}"), F.lit(f)) for f in fx.FORMAT_WORDS]
    found_formats = F.array_compact(F.array(*formats))
    top_name = c("top.campaign_name")
    issues = F.array_compact(F.array(
        F.when(~c("top.is_brand") & (zero_if_null("top.roas") < 1.5),
               _text("low ROAS (", fmt.decimals(zero_if_null("top.roas"), 2), "x)")),
        F.when(zero_if_null("top.conversions") == 0, F.lit("zero conversions")),
        F.when(zero_if_null("top.ctr") < 0.5, _text("very low CTR (", fmt.decimals(zero_if_null("top.ctr"), 2), "%)")),
    ))
    drop = ratio(c("first_ctr") - c("last_ctr"), "first_ctr") * 100

    return [
        _Check("Zero-Conversion Campaigns", tracking)
        .when(c("zero_conv_n") > 0, "fail", _text(n("zero_conv"), " campaigns spending with zero conversions: ", c("zero_conv_names")),
              _text("Audit conversion tracking on: ", c("zero_conv_names"), ". Check pixel/tag implementation."), priority="high")
        .otherwise("pass", _text("All spending ", platform, " campaigns have conversions.")),
        _Check("Conversion Value Tracking", tracking)
        .when(c("converting_n") == 0, "warning", "No conversions recorded - cannot assess value tracking.")
        .when(c("valued_n") == 0, "warning", "Conversions recorded but no conversion values - revenue attribution missing.",
              "Enable conversion value tracking to measure ROAS accurately.", priority="high")
        .when(coverage < 0.5, "warning", _text("Only ", pct0(coverage * 100), " of campaigns have conversion value data."),
              "Ensure all campaigns report conversion values for accurate ROAS.")
        .otherwise("pass", _text(pct0(coverage * 100), " of campaigns reporting conversion values.")),
        _Check("ROAS Data Quality", tracking)
        .when(c("bad_roas_n") > 0, "warning", _text(n("bad_roas"), " campaigns have invalid or missing ROAS values."),
              "Verify conversion tracking is correctly attributed to these campaigns.")
        .otherwise("pass", "ROAS data looks consistent across campaigns."),
        _Check("Budget Concentration", structure)
        .when(c("spend") == 0, "warning", "No spend data.")
        .when(c("n") == 1, "pass", "Single campaign - concentration N/A.")
        .when(top_share > 70, "fail", _text(top_name, " consumes ", pct0(top_share), " of ", platform, " budget - high concentration risk."),
              _text("Diversify budget away from ", top_name, " to reduce single-campaign dependency."), top_name, "high")
        .when(top_share > 50, "warning", _text("Top campaign takes ", pct0(top_share), " of ", platform, " budget."))
        .otherwise("pass", _text("Budget reasonably distributed - top campaign at ", pct0(top_share), ".")),
        _Check("Campaign Count", structure)
        .when(c("n") > 30, "warning", _text(_count_text(c("n")), " ", platform, " campaigns active - high complexity. Consider consolidation."),
              _text("Review ", platform, " campaign structure. Consolidate similar-objective campaigns."))
        .when(c("n") < 2, "warning", _text("Only ", _count_text(c("n")), " ", platform, " campaign - limited diversification."))
        .otherwise("pass", _text(_count_text(c("n")), " ", platform, " campaigns - reasonable structure.")),
        _Check("Naming Consistency", structure)
        .when(~c("structured_names"), "warning", "Campaign names lack structured separators. Hard to filter/segment.",
              "Adopt naming convention: Platform_Objective_Audience_Creative format.")
        .otherwise("pass", "Campaign names follow identifiable separator patterns."),
        _Check("Funnel Coverage", structure)
        .when(c("has_awareness") & c("has_conversion"), "pass", "Both awareness and conversion campaigns detected.")
        .when(~c("has_awareness") & ~c("has_conversion"), "warning",
              "Cannot determine funnel stages from campaign names. Add funnel-stage tags.",
              "Tag campaigns with funnel stage (TOF/MOF/BOF) in naming convention.")
        .when(c("has_conversion"), "warning", "Only conversion campaigns detected. No awareness/prospecting visible.",
              "Add prospecting campaigns to build top-of-funnel audience.")
        .otherwise("pass", "Funnel mix looks reasonable."),
        _Check("Learning Phase Flags", sets)
        .when(c("learning_n") > 0, "warning",
              _text(n("learning"), " campaigns with <1K impressions may be in learning phase: ", c("learning_names")),
              _text("Give these campaigns more budget or time before optimization: ", c("learning_names")))
        .otherwise("pass", "No campaigns stuck in early learning phase."),
        _Check("Bid Strategy Consistency", sets)
        .when(c("spending_n") < 2, "pass", "Too few campaigns to assess.")
        .when(c("roas_odd_n") > c("spending_n") * 0.3, "warning",
              "High ROAS variance across campaigns suggests mixed or inconsistent bid strategies.",
              "Audit bid strategies across campaigns. Align with account objectives.")
        .otherwise("pass", "ROAS distribution is relatively consistent across campaigns."),
        _Check("Spend Distribution", sets)
        .when((c("spending_n") > 0) & (inactive > 30), "warning",
              _text(pct0(inactive), " of campaigns have zero spend. Check budgets/scheduling."),
              "Review paused or budget-capped campaigns with zero spend.")
        .otherwise("pass", "Spend is active across campaigns."),
        _Check("CTR Health", creative)
        .when(avg_ctr.isNull(), "warning", "Insufficient spend to evaluate CTR.")
        .when(avg_ctr < benchmark * 0.5, "fail",
              _text("Average CTR ", fmt.decimals(avg_ctr, 2), "% is critically below ", fmt.decimals(benchmark, 1), "% benchmark."),
              _text("Creative refresh needed urgently. Test new hooks, visuals, and CTAs on ", platform, "."), priority="high")
        .when(avg_ctr < benchmark, "warning",
              _text("Average CTR ", fmt.decimals(avg_ctr, 2), "% below ", fmt.decimals(benchmark, 1), "% benchmark."),
              _text("A/B test new ad creatives on underperforming ", platform, " campaigns."))
        .otherwise("pass", _text("Average CTR ", fmt.decimals(avg_ctr, 2), "% is at or above benchmark.")),
        _Check("CTR Trend", creative)
        .when(F.coalesce(c("ctr_periods"), F.lit(0)) < 2, "pass", "Insufficient data points.")
        .when(c("ctr_always_fell"), "warning",
              _text("CTR declining consistently across ", _count_text(c("ctr_periods")), " periods (dropped ", fmt.decimals(drop, 0),
                    "%). Creative fatigue likely."), "Rotate ad creatives. Introduce new formats or hooks.")
        .otherwise("pass", "No consistent CTR decline detected."),
        _Check("Creative Diversity", creative)
        .when(F.size(found_formats) >= 2, "pass", _text("Multiple formats detected: ", F.array_join(found_formats, ", "), "."))
        .when(F.lit(True), "warning", "Limited format diversity detected from campaign names. Consider testing new ad formats.",
              "Test at least 2 ad formats (e.g. video + static, search + display).")
        .otherwise("warning", ""),
        _Check("CPA vs Target", cost)
        .when(no_goal, "pass", "No CPA target set. Configure in Budget Rules.")
        .when(c("cpa_far_n") > 0, "fail",
              _text(n("cpa_far"), " campaigns exceed CPA target (", goal_text, ") by >50%: ", c("cpa_far_names")),
              _text("Pause or restructure high-CPA campaigns: ", c("cpa_far_names")), priority="high")
        .when(c("cpa_over_n") > 0, "warning", _text(n("cpa_over"), " campaigns above CPA target (", goal_text, ")."))
        .otherwise("pass", _text("All campaigns within CPA target (", goal_text, ").")),
        _Check("ROAS vs Target", cost)
        .when(no_floor, "pass", "No ROAS target set. Configure in Budget Rules.")
        .when(c("judged_n") == 0, "warning", "Insufficient spend to evaluate ROAS.")
        .when(c("roas_far_n") > 0, "fail",
              _text(n("roas_far"), " campaigns >30% below ROAS target (", floor_text, "x): ", c("roas_far_names")),
              _text("Review and optimize or pause: ", c("roas_far_names")), c("roas_far_first"), "high")
        .when(c("roas_under_n") > 0, "warning", _text(n("roas_under"), " campaigns below ROAS target (", floor_text, "x)."))
        .otherwise("pass", _text("All campaigns meeting ROAS target (", floor_text, "x).")),
        _Check("CPC Outliers", cost)
        .when(c("priced_n") < 2, "pass", "Insufficient data.")
        .when(c("cpc_high_n") > 0, "warning", _text(n("cpc_high"), " campaigns with CPC >2.5x account average: ", c("cpc_high_names")),
              _text("Review bidding strategy and keyword/audience quality for: ", c("cpc_high_names")))
        .otherwise("pass", _text("CPC distribution looks normal (avg: ", fmt.decimals(c("mean_cpc"), 2), ").")),
        _Check("Wasted Spend", cost)
        .when(zero_if_null("own_spend") == 0, "pass", "No spend data.")
        .when(zero_if_null("own_waste") == 0, "pass", _text("No wasted spend flagged.", excluded))
        .when(waste_pct > 20, "fail",
              _text(pct0(waste_pct), " of ", platform, " budget is wasted spend (", fmt.grouped(c("own_waste")), ").", excluded),
              "Review negative keywords, exclusions, and audience targeting to cut waste.", priority="high")
        .when(waste_pct > 10, "warning", _text(pct0(waste_pct), " of budget flagged as wasted spend.", excluded))
        .otherwise("pass", _text("Wasted spend at acceptable level (", pct0(waste_pct), ").", excluded)),
        _Check("Zero-Spend Campaigns", account)
        .when(c("zero_spend_n") > 0, "warning", _text(n("zero_spend"), " campaigns with zero spend: ", c("zero_spend_names")),
              _text("Review budget and scheduling for zero-spend campaigns: ", c("zero_spend_names")))
        .otherwise("pass", "All campaigns have spend."),
        _Check("Impressions Without Clicks", account)
        .when(c("ghost_n") > 0, "warning", _text(n("ghost"), " campaigns with impressions but zero clicks: ", c("ghost_names")),
              _text("Review ad relevance and targeting for: ", c("ghost_names"), ". Consider pausing."))
        .otherwise("pass", "No ghost campaigns detected."),
        _Check("Spend Efficiency", account)
        .when(c("spend") == 0, "warning", "No spend data.")
        .when(account_roas == 0, "warning", _text("Zero revenue tracked on ", platform, ". Check conversion value setup."),
              "Verify conversion value reporting is enabled.")
        .when(account_roas < 1, "fail", _text(platform, " account ROAS of ", fmt.decimals(account_roas, 2), "x - spending more than earning."),
              _text("Urgent: ", platform, " is not profitable. Pause worst performers immediately."), priority="high")
        .when(account_roas < 2, "warning", _text(platform, " account ROAS of ", fmt.decimals(account_roas, 2), "x - below typical target."))
        .otherwise("pass", _text(platform, " account ROAS: ", fmt.decimals(account_roas, 2), "x - healthy.")),
        _Check("Top Campaign Health", account)
        .when(F.size(issues) > 0, "fail", _text("Top spend campaign '", top_name, "' has issues: ", F.array_join(issues, ", "), "."),
              _text("Prioritize fixing '", top_name, "' - it consumes the most budget."), top_name, "high")
        .otherwise("pass", _text("Top campaign '", top_name, "' looks healthy.",
                                 F.when(c("top.is_brand"), " (brand campaign - ROAS threshold skipped)").otherwise(""))),
    ]


def audit_checks(campaigns: DataFrame, clients: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per (upload, platform, check). ``campaigns`` carries upload ranks."""
    goals = context.campaign_targets(clients).groupBy("client_id").agg(F.lit(True).alias("has_targets"))
    rows = context.with_tags_and_targets(campaigns, clients).join(rules, "client_id", "left").join(goals, "client_id", "left")
    platform = F.lower("platform")
    rows = rows.withColumns(
        {
            "is_brand": F.coalesce(F.col("tag").isin(alerts.BRAND_TAGS), F.lit(False)),
            "rule_cpl": alerts.platform_rule("min_cpl", platform),
            "rule_roas": alerts.platform_rule("min_roas", platform),
        }
    ).withColumns(
        {
            "cpa_goal": first_present("target_cpa", "target_cpl", "rule_cpl"),
            "roas_goal": first_present("target_roas", "rule_roas"),
        }
    )
    # measures, examples, group means and CTR trend all read these rows
    rows = stored(rows)
    flagged = _with_group_means(rows).withColumns(_flags())
    judged = (
        _measures(flagged)
        .join(_named_examples(flagged), KEYS, "left")
        .join(ctr_trend(rows), ["client_id", "platform"], "left")
    )
    # one row per upload and platform from here on: storing it keeps the long check expressions
    # out of the adaptive re-planning of the aggregations above
    found = stored(judged).select(*KEYS, F.posexplode(F.array(*_checks())).alias("check_order", "found"))
    return found.select(*KEYS, "check_order", "found.check_name", "found.category", "found.outcome.*")


def audit_scores(checks: DataFrame) -> DataFrame:
    """Category scores and the weighted overall score per upload, one row per category."""
    points = F.col("status")
    value = F.when(points == "pass", 100).when(points == "warning", 50).otherwise(0)
    by_category = checks.groupBy("client_id", "upload_id", "category").agg(
        rnd(ratio(F.sum(value), F.count(F.lit(1)))).cast("long").alias("score"),
        *[count_where(points == s).alias(f"{s}_n") for s in fx.STATUS_POINTS],
    )
    # weights in hundredths keep the weighted mean exact
    weights = F.create_map(*[F.lit(x) for k, w in fx.CATEGORY_WEIGHTS.items() for x in (k, round(w * 100))])
    weighted = by_category.withColumn("weight", weights[F.col("category")])
    return weighted.groupBy("client_id", "upload_id").agg(
        rnd(F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).cast("long").alias("overall_score"),
        *[F.max(F.when(F.col("category") == k, F.col("score"))).alias(k.lower().replace(" ", "_")) for k in fx.CATEGORY_WEIGHTS],
        F.sum("fail_n").alias("fail_count"), F.sum("warning_n").alias("warning_count"), F.sum("pass_n").alias("pass_count"),
        F.sum(F.col("fail_n") + F.col("warning_n") + F.col("pass_n")).alias("total_checks"),
    )


def recommendations(checks: DataFrame) -> DataFrame:
    """Failed or warned checks that propose an action, most urgent first per upload."""
    open_checks = checks.where((F.col("status") != "pass") & F.col("action").isNotNull())
    categories = list(fx.CATEGORY_WEIGHTS)
    category_place = reduce(
        lambda chain, i: chain.when(F.col("category") == categories[i], i), range(1, len(categories)),
        F.when(F.col("category") == categories[0], 0),
    )
    urgency = alerts.severity_rank(F.col("priority"))
    spec = Window.partitionBy("client_id", "upload_id").orderBy(urgency, category_place, "platform", "check_order")
    return open_checks.withColumn("position", F.row_number().over(spec)).select(
        "client_id", "upload_id", "position", "category", "check_name", "status", "reason", "action", "platform", "campaign", "priority"
    )
