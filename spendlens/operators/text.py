"""Parsing report texts. Everything happens inside the row: no shuffle, no Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions.formatting import repair_mojibake
from spendlens.functions.guards import any_of, col, contains_any, count_where, ratio, rnd

# FIXED VALUES: patterns of report markup
LIST_ITEM = r"(?is)<li[^>]*>(.*?)</li>"
RECOMMENDATION_PART = r'(?is)(recommendation|action|priorit)[^<]*</[^>]+>(.*?)(</section|<h[123]|<div\s+class="section)'
BUDGET_ROW = (
    r"(?is)<tr[^>]*>\s*<td>(.*?)</td>\s*<td>(.*?)</td>\s*<td>.*?badge[^>]*>(.*?)</span>.*?</td>"
    r"\s*<td>[^<]*</td>\s*<td>[^<]*</td>\s*<td>(.*?)</td>"
)
HEADER = r"(?m)^#{1,3}[^\S\n](?=[^\n])"
NUMBERED = r"(?m)(?<!\A)(?=^\d+\.[^\S\n]+\S)"
LABELLED = r"^[-*]\s*\*?\*?([^:*\n]+?)\*?\*?:\s*(.+)$"


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def plain(html: Column) -> Column:
    """Text of an HTML fragment: tags removed, white space collapsed."""
    return F.regexp_replace(strip(F.regexp_replace(html, r"<[^>]+>", "")), r"\s+", " ")


def unbold(text: Column) -> Column:
    return F.regexp_replace(text, r"\*\*(.+?)\*\*", "$1")


def _items(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(LIST_ITEM), F.lit(1)), plain)


def action_priority(text: Column | str) -> Column:
    low = F.lower(col(text))
    return (
        F.when(contains_any(low, fx.HIGH_PRIORITY_WORDS), "high")
        .when(contains_any(low, fx.MEDIUM_PRIORITY_WORDS), "medium").otherwise("low")
    )


def report_actions(reports: DataFrame, keys: list[str], html: str) -> DataFrame:
    """All list items that are long enough, with their position and a priority; callers filter by position."""
    bullets = F.filter(_items(F.col(html)), lambda t: F.length(t) > 15)
    rows = reports.select(*keys, F.posexplode(bullets).alias("position", "text"))
    return rows.withColumn("priority", action_priority("text"))


def recommendation_bullets(reports: DataFrame, keys: list[str], html: str) -> DataFrame:
    """All bullets of the recommendation part, or of the whole report without one."""
    part = F.regexp_extract(html, RECOMMENDATION_PART, 2)
    searched = F.when(F.col(html).rlike(RECOMMENDATION_PART), part).otherwise(F.col(html))
    bullets = F.filter(_items(searched), lambda t: t != "")
    return reports.select(*keys, F.posexplode(bullets).alias("position", "text"))


def budget_rows(reports: DataFrame, keys: list[str], html: str) -> DataFrame:
    """Campaign, platform, action and reason of all rows of budget tables."""
    groups = [F.regexp_extract_all(html, F.lit(BUDGET_ROW), F.lit(i)) for i in (1, 2, 3, 4)]
    zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, "abcd")])

    def cell(value: Column) -> Column:
        return strip(F.regexp_replace(value, r"<[^>]+>", ""))

    rows = reports.select(*keys, F.posexplode(zipped).alias("position", "cells")).select(
        *keys, "position", cell(F.col("cells.a")).alias("campaign"), cell(F.col("cells.b")).alias("platform"),
        F.lower(cell(F.col("cells.c"))).alias("action"), cell(F.col("cells.d")).alias("reason"),
    )
    head = F.concat(F.initcap("action"), F.lit(" "), F.col("campaign"), F.lit(" ("), F.col("platform"), F.lit(")"))
    text = F.when(F.col("reason") != "", F.concat(head, F.lit(": "), F.col("reason"))).otherwise(head)
    priority = F.when(F.col("action") == "pause", "high").when(F.col("action") == "decrease", "medium").otherwise("low")
    return rows.where((F.col("campaign") != "") & (F.col("action") != "")).withColumns({"text": text, "priority": priority})


def section_key(heading: Column) -> Column:
    """Known section a heading belongs to: the first pattern it contains."""
    (first, key), *rest = fx.REPORT_SECTIONS
    return reduce(lambda chain, p: chain.when(heading.contains(p[0]), p[1]), rest, F.when(heading.contains(first), key))


def report_sections(reports: DataFrame, markdown: str) -> DataFrame:
    """Add one column per known section; the last section of a kind wins, missing ones are empty."""
    chunks = F.split(repair_mojibake(markdown), HEADER)
    # what precedes the first heading belongs to no section
    chunks = F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0)))
    parsed = F.transform(chunks, lambda c: F.struct(
        section_key(F.lower(strip(F.substring_index(c, "\n", 1)))).alias("key"),
        F.when(c.contains("\n"), F.regexp_replace(c, r"^[^\n]*\n", "")).alias("body"),
    ))
    kept = F.filter(parsed, lambda s: s["key"].isNotNull() & (F.length(s["body"]) > 0))
    rows = reports.withColumn("parsed", kept)
    keys = list(dict.fromkeys(key for _, key in fx.REPORT_SECTIONS))

    def last(key: str) -> Column:
        bodies = F.filter("parsed", lambda s: s["key"] == key)
        return F.coalesce(strip(F.try_element_at(bodies, F.lit(-1))["body"]), F.lit(""))

    return rows.withColumns({key: last(key) for key in keys}).drop("parsed")


def recommendations(reports: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """All numbered recommendations: title, labelled bullets and prose."""
    blocks = F.split(strip(raw), NUMBERED)

    def parse(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), strip), lambda t: t != "")
        title = strip(unbold(F.regexp_replace(F.get(lines, F.lit(0)), r"^\d+\.\s*", "")))
        rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
        labelled = F.filter(rest, lambda t: t.rlike(LABELLED))
        other = F.filter(rest, lambda t: ~t.rlike(LABELLED))
        bullets = F.transform(labelled, lambda t: F.concat(
            strip(unbold(F.regexp_extract(t, LABELLED, 1))), F.lit("="),
            F.regexp_replace(strip(unbold(F.regexp_extract(t, LABELLED, 2))), r"\*+$", ""),
        ))
        prose = F.filter(F.transform(other, lambda t: strip(F.regexp_replace(unbold(t), r"^[-*]\s+", ""))), lambda t: t != "")
        return F.struct(title.alias("title"), F.array_join(bullets, "; ").alias("bullets"), F.array_join(prose, " ").alias("prose"))

    filled = F.filter(blocks, lambda b: strip(b) != "")
    parsed = F.filter(F.transform(filled, parse), lambda r: F.coalesce(r["title"], F.lit("")) != "")
    return reports.select(*keys, F.posexplode(parsed).alias("position", "item")).select(*keys, "position", "item.*")


def _section(text: Column, heading: str) -> Column:
    return strip(F.regexp_extract(text, rf"(?sm)## {heading}(.*?)(?=^## |\z)", 1))


def style_scores(texts: DataFrame, text: str, names: list[str] = fx.KNOWN_CAMPAIGNS) -> DataFrame:
    """Five yes/no checks of a written report: entities among ``names``, concrete actions, confidence, filler, numbers."""
    body = F.col(text)
    plan, budget = _section(body, "Recommendations"), _section(body, "Budget Reallocation")
    low_plan = F.lower(F.col("plan"))
    hits = reduce(lambda a, b: a + b, [F.when(low_plan.contains(n), 1).otherwise(0) for n in names])
    vague = any_of([low_plan.rlike(p) for p in fx.VAGUE_PATTERNS])
    hedged = any_of([low_plan.rlike(p) for p in fx.HEDGE_PATTERNS])
    lines = F.filter(F.transform(F.split("plan", "\n"), strip), lambda t: t.rlike(r"^[-*1-9]"))
    verbs = "|".join(fx.IMPERATIVE_VERBS)
    opening = F.size(F.filter("plan_lines", lambda t: F.lower(t).rlike(rf"^[-* 0-9.]*({verbs})|\*\*({verbs})")))
    n = F.size("plan_lines")
    tags = F.size(F.regexp_extract_all(body, F.lit(r"(?i)\[Confidence:\s*(High|Medium|Low)\]"), F.lit(1)))
    figures = F.col("budget").rlike(r"\d+\s*%") | F.col("budget").rlike(r"(?i)(Rs|INR|₹)\s*[\d,]+|\d+\s*(lakh|k\b)")
    prepared = texts.withColumns({"plan": plan, "budget": budget}).withColumn("plan_lines", lines)
    scored = prepared.withColumns(
        {
            "specific_names": (hits >= 2) & ~vague,
            "concrete_actions": ~hedged & ((n == 0) | (opening / n >= 0.3)),
            "confidence_given": tags >= F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 3))).otherwise(1),
            "no_filler": ~contains_any(F.lower(body), fx.FILLER_PHRASES),
            "budget_numbers": (F.col("budget") != "") & figures,
        }
    )
    return _with_total(scored.drop("plan", "budget", "plan_lines"), STYLE_CHECKS)


STYLE_CHECKS = ["specific_names", "concrete_actions", "confidence_given", "no_filler", "budget_numbers"]
SIGNAL_CHECKS = ["trend_referenced", "learning_protected", "efficiency_used", "funnel_stage_named", "fatigue_flagged"]


def near_campaign_pattern(reach: int = 200) -> str:
    """A trend word with a known campaign name inside the ``reach`` characters around its start."""
    parts = []
    for name in fx.KNOWN_CAMPAIGNS:
        parts.append(rf"{name}.{{0,{reach - len(name)}}}\b(?:improving|declining|stable)\b")
        for words in ("improving|declining", "stable"):
            room = reach - len(words.split("|")[0]) - len(name)
            parts.append(rf"\b(?:{words})\b.{{0,{room}}}{name}")
    return "(?s)" + "|".join(parts)


def signal_scores(texts: DataFrame, text: str, learning: str, funnel: str, frequency: str) -> DataFrame:
    """Five checks whether a text uses given signals; checks without their data pass."""
    low = F.lower(F.col(text))
    pausing = low.rlike(r"\bpause\b.{0,40}learning.phase|\bstop\b.{0,40}learning.phase")
    tired = low.rlike(r"frequenc\w+\s+(?:of\s+)?(\d+\.?\d*)") | low.rlike(
        r"(frequenc\w+.{0,60}(fatigue|refresh|audience)|fatigue.{0,60}frequenc\w+)"
    )
    scored = texts.withColumns(
        {
            "trend_referenced": low.rlike(near_campaign_pattern()),
            "learning_protected": ~F.col(learning) | (low.rlike("learning.phase") & ~pausing),
            "efficiency_used": low.rlike(r"\befficiency\b"),
            "funnel_stage_named": ~F.col(funnel) | any_of([low.rlike(p) for p in fx.FUNNEL_STAGE_PATTERNS]),
            "fatigue_flagged": ~F.col(frequency) | (tired & low.rlike("frequenc")),
        }
    )
    return _with_total(scored, SIGNAL_CHECKS)


def _with_total(scored: DataFrame, checks: list[str]) -> DataFrame:
    return scored.withColumn("score", reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in checks]))


def eval_rollup(scored: DataFrame, experiment: str, checks: list[str], seconds: str) -> DataFrame:
    """Pass counts per experiment and check, with the experiment's totals and timing; weak checks marked."""
    pairs = F.array(*[F.struct(F.lit(c).alias("check_name"), F.col(c).alias("passed")) for c in checks])
    rows = scored.select(experiment, F.explode(pairs).alias("e")).select(experiment, "e.*")
    per_check = rows.groupBy(experiment, "check_name").agg(count_where(F.col("passed")).alias("passes"), F.count(F.lit(1)).alias("total"))
    timing = scored.groupBy(experiment).agg(
        F.sum("score").alias("score"), rnd(F.sum("score") / (F.count(F.lit(1)) * len(checks)) * 100, 1).alias("pass_rate"),
        rnd(F.avg(seconds), 1).alias("avg_time"), F.min(seconds).alias("min_time"), F.max(seconds).alias("max_time"),
    )
    pct = ratio("passes", "total") * 100
    return per_check.join(timing, experiment).withColumns(
        {"pct": rnd(pct, 1), "is_weak": pct < fx.WEAK_EVAL_BELOW_PCT}
    )
