"""Client context JSON: parsing, side tables of tags and targets, briefing text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import briefing_values as bv
from spendlens.functions.guards import present

TEXT_FIELDS = [
    "account_maturity", "user_type", "monthly_budget_total", "monthly_budget_google", "monthly_budget_meta",
    "goal", "audience", "sales_cycle_weeks", "avg_order_value", "seasonal", "campaign_notes", "budget_notes",
    "attribution_model", "competitive_context", "extra",
]
SCHEMA = (
    "business_type string, anomaly_sensitivity string, "
    + ", ".join(f"{f} string" for f in TEXT_FIELDS)
    + ", campaign_tags map<string,string>"
    + ", campaign_targets array<struct<name:string,target_roas:string,target_cpl:string,target_cpa:string>>"
    + ", _corrupt_record string"
)


def parse_context(clients: DataFrame) -> DataFrame:
    """Add ``ctx``; text that is not JSON becomes free-form extra context of an "other" business."""
    parsed = F.from_json("context", SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    broken = F.col("ctx._corrupt_record").isNotNull()
    return (
        clients.withColumn("ctx", parsed)
        .withColumn("ctx", F.when(broken, F.col("ctx").withField("extra", F.col("context"))
                                  .withField("business_type", F.lit("other"))).otherwise(F.col("ctx")))
        .withColumn("ctx", F.col("ctx").dropFields("_corrupt_record"))
    )


def campaign_tags(clients: DataFrame) -> DataFrame:
    """One row per (client, lower-cased campaign name) with its tag."""
    rows = parse_context(clients).select("client_id", F.explode("ctx.campaign_tags").alias("name", "tag"))
    return rows.groupBy("client_id", F.lower(F.trim("name")).alias("name_key")).agg(F.max("tag").alias("tag"))


def campaign_targets(clients: DataFrame) -> DataFrame:
    """One row per (client, lower-cased campaign name) with its goals; the last entry wins."""
    rows = parse_context(clients).select("client_id", F.posexplode("ctx.campaign_targets").alias("place", "goal"))
    key = F.lower(F.trim("goal.name"))
    latest = rows.where(key != "").groupBy("client_id", key.alias("name_key")).agg(F.max_by("goal", "place").alias("goal"))
    return latest.select(
        "client_id", "name_key", *[present(F.col(f"goal.{c}").try_cast("double")).alias(c) for c in ("target_roas", "target_cpl", "target_cpa")]
    )


def sensitivity(clients: DataFrame) -> DataFrame:
    return parse_context(clients).select(
        "client_id", F.coalesce("ctx.anomaly_sensitivity", F.lit("medium")).alias("sensitivity")
    )


def with_tags_and_targets(campaigns: DataFrame, clients: DataFrame) -> DataFrame:
    """Attach tag and goals to campaign rows by client and lower-cased name."""
    keys = ["client_id", "name_key"]
    return (
        campaigns.withColumn("name_key", F.lower(F.trim("campaign_name")))
        .join(campaign_tags(clients), keys, "left")
        .join(campaign_targets(clients), keys, "left")
        .drop("name_key")
    )


def _said(field: str) -> Column:
    text = F.trim(F.col(f"ctx.{field}"))
    return F.when(text != "", text)


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)   # null value, null line: left out when joined


def _lookup(values: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.create_map(*pairs)[key] if pairs else F.lit(None).cast("string")


def _optional_list(text: Column) -> Column:
    return F.when(text != "", text)


def briefings(clients: DataFrame) -> DataFrame:
    """Client briefing text: labelled lines for every filled context field."""
    kind = F.coalesce("ctx.business_type", F.lit("other"))
    known = F.when(kind.isin(*bv.BUSINESS_LABELS), kind).otherwise("other")
    split = F.array_join(
        F.array(_line("Google ", _said("monthly_budget_google")), _line("Meta ", _said("monthly_budget_meta"))), ", "
    )
    budget = F.concat(
        F.lit("Monthly budget: "), _said("monthly_budget_total"),
        F.when(split != "", F.concat(F.lit(" ("), split, F.lit(")"))).otherwise(F.lit("")),
    )
    tags = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("ctx.campaign_tags")),
            lambda e: F.when(e["value"] != "", F.concat(F.lit("  - "), e["key"], F.lit(": ["), e["value"], F.lit("]"))),
        ), "\n",
    )

    def goal(entry: Column) -> Column:
        parts = [F.concat(F.lit("  - "), F.coalesce(entry["name"], F.lit("?")), F.lit(":"))]
        for field, before, after in (("target_roas", "target ROAS ", "x"), ("target_cpl", "target CPL ", ""),
                                     ("target_cpa", "target CPA ", "")):
            is_set = present(entry[field].try_cast("double")).isNotNull()
            parts.append(F.when(is_set, F.concat(F.lit(before), entry[field], F.lit(after))))
        return F.concat_ws(" ", *parts)

    targets = F.array_join(F.transform("ctx.campaign_targets", goal), "\n")
    model = F.when(_said("attribution_model") != "unknown", _said("attribution_model"))
    note = F.coalesce(F.concat(F.lit("\nAttribution note: "), _lookup(bv.ATTRIBUTION_NOTES, model)), F.lit(""))
    benchmark = _lookup(bv.benchmark_texts(), kind)
    # FIXED VALUES: line labels
    lines = [
        F.lit("=== CLIENT BRIEFING ==="),
        _line("Business type: ", _lookup(bv.BUSINESS_LABELS, known)),
        _line("Implied context: ", _optional_list(_lookup(bv.BUSINESS_IMPLIED, known))),
        _line("Account maturity: ", _lookup(bv.MATURITY_LABELS, _said("account_maturity"))),
        _line("Maturity guidance: ", _lookup(bv.MATURITY_GUIDANCE, _said("account_maturity"))),
        _line("Report recipient: ", _lookup(bv.USER_TYPE_LABELS, _said("user_type"))),
        _line("Tone guidance: ", _lookup(bv.USER_TYPE_GUIDANCE, _said("user_type"))),
        budget,
        _line("Primary goal: ", _said("goal")),
        _line("Target audience: ", _said("audience")),
        F.when(known.isin(*bv.WITH_SALES_CYCLE), F.concat(F.lit("Sales cycle: "), _said("sales_cycle_weeks"), F.lit(" weeks"))),
        _line("Average order value: ", _said("avg_order_value")),
        _line("Seasonal context: ", _said("seasonal")),
        _line("Campaign notes (critical - use these to interpret individual campaigns):\n", _said("campaign_notes")),
        _line("Budget constraints: ", _said("budget_notes")),
        _line("Campaign type tags (respect these when evaluating performance):\n", _optional_list(tags)),
        _line("Per-campaign performance targets (flag if missing these goals):\n", _optional_list(targets)),
        F.concat(F.lit("Attribution model: "), model, note),
        benchmark,
        _line("Competitive context: ", _said("competitive_context")),
        _line("Additional context: ", _said("extra")),
    ]
    filled = F.array_compact(F.array(*lines))
    text = F.when(
        F.size(filled) > 2, F.concat(F.array_join(filled, "\n"), F.lit("\n=== END BRIEFING ==="))
    ).otherwise(F.lit(""))
    return parse_context(clients).select("client_id", text.alias("briefing"))
