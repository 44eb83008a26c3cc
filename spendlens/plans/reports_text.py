"""Report-text queries over pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions.formatting import repair_mojibake
from spendlens.operators import text
from spendlens.plans.registry import query
from spendlens.sources import model

PLAIN = "regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
HIGH, MEDIUM = "|".join(fx.HIGH_PRIORITY_WORDS), "|".join(fx.MEDIUM_PRIORITY_WORDS)


@query("report_actions", f"""
WITH i AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1),
    lambda x: {PLAIN.format(x='x')}), lambda t: length(t) > 15) AS items FROM pages),
u AS (SELECT page_id, unnest(items) AS text, generate_subscripts(items, 1) - 1 AS position FROM i)
SELECT page_id, CAST(position AS INTEGER) AS position, text, CASE WHEN regexp_matches(lower(text), '{HIGH}') THEN 'high'
  WHEN regexp_matches(lower(text), '{MEDIUM}') THEN 'medium' ELSE 'low' END AS priority FROM u""", views=False)
def report_actions(spark: SparkSession, sf: str) -> DataFrame:
    return text.report_actions(model.table(spark, sf, "pages"), ["page_id"], "html")


PART = r'''(?is)(recommendation|action|priorit)[^<]*</[^>]+>(.*?)(</section|<h[123]|<div\s+class="section)'''


@query("recommendation_bullets", f"""
WITH p AS (SELECT page_id, CASE WHEN regexp_matches(html, '{PART}') THEN regexp_extract(html, '{PART}', 2) ELSE html END AS part FROM pages),
i AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(part, '(?is)<li[^>]*>(.*?)</li>', 1),
    lambda x: {PLAIN.format(x='x')}), lambda t: t <> '') AS items FROM p)
SELECT page_id, unnest(items) AS text, CAST(generate_subscripts(items, 1) - 1 AS INTEGER) AS position FROM i""", views=False)
def recommendation_bullets(spark: SparkSession, sf: str) -> DataFrame:
    return text.recommendation_bullets(model.table(spark, sf, "pages"), ["page_id"], "html")


def _table_row(name: str, platform: str, action: str, reason: str) -> list:
    return [F.lit("<tr>\n <td>"), name, F.lit("</td>\n <td>"), platform, F.lit('</td> <td><span class="badge badge-x">'), action,
            F.lit("</span></td> <td>20%</td> <td>75%</td> <td>"), reason, F.lit("</td></tr>")]


@query("budget_table_rows", """
WITH r AS (SELECT doc_id, unnest([{'position': 0, 'campaign': source, 'platform': lang, 'action': 'pause', 'reason': 'chars ' || n_chars},
    {'position': 1, 'campaign': lang || ' ' || doc_id, 'platform': source, 'action': CASE WHEN doc_id % 2 = 0 THEN 'decrease' ELSE 'increase' END,
     'reason': ''}], recursive := true) FROM documents)
SELECT doc_id, position, campaign, platform, action, reason,
  upper(left(action, 1)) || substr(action, 2) || ' ' || campaign || ' (' || platform || ')' || CASE WHEN reason <> '' THEN ': ' || reason ELSE '' END AS text,
  CASE action WHEN 'pause' THEN 'high' WHEN 'decrease' THEN 'medium' ELSE 'low' END AS priority FROM r""", views=False)
def budget_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Budget tables rendered from document attributes, followed by the whole document, read back."""
    docs = model.table(spark, sf, "documents")
    first = _table_row(F.col("source"), F.col("lang"), F.lit("Pause"), F.concat(F.lit("chars "), F.col("n_chars")))
    move = F.when(F.col("doc_id") % 2 == 0, "Decrease").otherwise("Increase")
    second = _table_row(F.concat_ws(" ", "lang", F.col("doc_id").cast("string")), F.col("source"), move, F.lit(""))
    html = F.concat(F.lit("<table>"), *first, *second, F.lit("</table><p>"), F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit("</p>"))
    return text.budget_rows(docs.select("doc_id", html.alias("html")), ["doc_id"], "html")


REPORT_SQL = r"""
reports AS (SELECT doc_id, source, lang, n_chars, 'intro' || chr(10) || '# Executive Summary' || chr(10) || text || chr(10)
    || '## Wasted spend analysis' || chr(10) || 'first ' || lang || chr(10) || '### Details' || chr(10) || 'dropped' || chr(10)
    || '## Wasted Spend' || chr(10) || chr(10) || 'lost on ' || source || chr(10)
    || '## Budget Reallocation' || chr(10) || 'Move ' || (n_chars % 50) || CASE WHEN doc_id % 3 = 0 THEN '% to ' ELSE ' parts to ' END || source || chr(10)
    || '## Recommendations' || chr(10)
    || '1. **Pause ' || source || '** now' || chr(10) || '- Campaign: ' || lang || chr(10) || '- **Metric**: ' || n_chars || chr(10)
    || '- shift spend to retargeting and performance max' || chr(10) || 'because it pays' || chr(10)
    || '2. Review ' || lang || CASE WHEN doc_id % 4 = 0 THEN ' and consider more' ELSE ' weekly' END || chr(10)
    || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '[Confidence: High]' END || chr(10) AS report FROM documents)"""


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown reports around every whole document."""
    key, chars = F.col("doc_id"), F.col("n_chars")
    unit = F.when(key % 3 == 0, "% to ").otherwise(" parts to ")
    advice = F.when(key % 4 == 0, " and consider more").otherwise(" weekly")
    confidence = F.when(key % 5 == 0, "").otherwise("[Confidence: High]")
    lines = [
        "intro", "# Executive Summary", F.col("text"), "## Wasted spend analysis", F.concat(F.lit("first "), "lang"), "### Details",
        "dropped", "## Wasted Spend", "", F.concat(F.lit("lost on "), "source"), "## Budget Reallocation",
        F.concat(F.lit("Move "), chars % 50, unit, "source"), "## Recommendations", F.concat(F.lit("1. **Pause "), "source", F.lit("** now")),
        F.concat(F.lit("- Campaign: "), "lang"), F.concat(F.lit("- **Metric**: "), chars),
        "- shift spend to retargeting and performance max", "because it pays", F.concat(F.lit("2. Review "), "lang", advice), confidence, "",
    ]
    report = F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])
    return model.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars", report.alias("report"))


@query("report_sections", f"""
WITH {REPORT_SQL},
l AS (SELECT doc_id, unnest(string_split(report, chr(10))) AS line, generate_subscripts(string_split(report, chr(10)), 1) AS i FROM reports),
h AS (SELECT *, regexp_matches(line, '^#{{1,3}}\\s.') AS is_head,
    max(CASE WHEN regexp_matches(line, '^#{{1,3}}\\s.') THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS head FROM l),
k AS (SELECT doc_id, head, lower(trim(regexp_replace(max(line) FILTER (WHERE is_head), '^#+', ''))) AS heading,
    string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT is_head) AS body FROM h WHERE head IS NOT NULL GROUP BY ALL),
s AS (SELECT *, CASE WHEN heading LIKE '%executive summary%' THEN 'e' WHEN heading LIKE '%wasted spend%' THEN 'w'
    WHEN heading LIKE '%underperforming campaigns%' THEN 'u' WHEN heading LIKE '%budget reallocation%' THEN 'b'
    WHEN heading LIKE '%recommendations%' THEN 'r' END AS key FROM k WHERE body IS NOT NULL)
SELECT doc_id, {", ".join(f"coalesce(regexp_replace(arg_max(body, head) FILTER (WHERE key = '{k}'), '^{chr(92)}s+|{chr(92)}s+$', '', 'g'), '') AS {n}"
  for k, n in [('e', 'executive_summary'), ('w', 'wasted_spend'), ('u', 'underperformers_text'), ('b', 'reallocation'), ('r', 'recommendations_raw')])}
FROM s GROUP BY doc_id""".replace("\\\\s", "\\s"), views=False)
def report_sections(spark: SparkSession, sf: str) -> DataFrame:
    return text.report_sections(reports(spark, sf), "report").drop("report", "source", "lang", "n_chars")


@query("parsed_recommendations", f"""
WITH {REPORT_SQL}
SELECT doc_id, 0 AS position, 'Pause ' || source || ' now' AS title, 'Campaign=' || lang || '; Metric=' || n_chars AS bullets,
  'shift spend to retargeting and performance max because it pays' AS prose FROM reports
UNION ALL SELECT doc_id, 1, 'Review ' || lang || CASE WHEN doc_id % 4 = 0 THEN ' and consider more' ELSE ' weekly' END, '',
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE '[Confidence: High]' END FROM reports""", views=False)
def parsed_recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return text.recommendations(text.report_sections(reports(spark, sf), "report"), ["doc_id"], "recommendations_raw")


VERBS = "|".join(fx.IMPERATIVE_VERBS)
KNOWN_HITS = " + ".join(f"CAST(contains(lower(plan), '{n}') AS INTEGER)" for n in fx.KNOWN_CAMPAIGNS)
STYLE = rf"""{REPORT_SQL},
q AS (SELECT *, CASE WHEN contains(report, '## Recommendations') THEN split_part(substr(report, strpos(report, '## Recommendations') + 18), chr(10) || '## ', 1) ELSE '' END AS plan0,
    CASE WHEN contains(report, '## Budget Reallocation') THEN split_part(substr(report, strpos(report, '## Budget Reallocation') + 22), chr(10) || '## ', 1) ELSE '' END AS budget0 FROM reports),
q1 AS (SELECT *, regexp_replace(plan0, '^\s+|\s+$', '', 'g') AS plan, regexp_replace(budget0, '^\s+|\s+$', '', 'g') AS budget FROM q),
q2 AS (SELECT *, list_filter(list_transform(string_split(plan, chr(10)), lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')),
    lambda t: regexp_matches(t, '^[-*1-9]')) AS ls FROM q1),
style AS (SELECT doc_id, source, n_chars, ({KNOWN_HITS}) >= 2 AND NOT regexp_matches(lower(plan),
    '\bsome campaigns\b|\bcertain campaigns\b|\bthese campaigns\b|\bunderperforming campaigns\b($|[^ ]| ($|[^(]))') AS specific_names,
  NOT regexp_matches(lower(plan), '{"|".join(fx.HEDGE_PATTERNS)}') AND (len(ls) = 0 OR
    len(list_filter(ls, lambda t: regexp_matches(lower(t), '^[-* 0-9.]*({VERBS})|\*\*({VERBS})'))) / len(ls) >= 0.3::DOUBLE) AS concrete_actions,
  len(regexp_extract_all(report, '(?i)\[Confidence:\s*(High|Medium|Low)\]')) >= CASE WHEN len(ls) > 0 THEN greatest(1, len(ls) // 3) ELSE 1 END AS confidence_given,
  NOT regexp_matches(lower(report), '{"|".join(fx.FILLER_PHRASES)}') AS no_filler,
  budget <> '' AND (regexp_matches(budget, '\d+\s*%') OR regexp_matches(budget, '(?i)(Rs|INR|₹)\s*[\d,]+|\d+\s*(lakh|k\b)')) AS budget_numbers
  FROM q2),
scored AS (SELECT *, specific_names::INT + concrete_actions::INT + confidence_given::INT + no_filler::INT + budget_numbers::INT AS score FROM style)"""


@query("style_scores", f"WITH {STYLE} SELECT * FROM scored", views=False)
def style_scores(spark: SparkSession, sf: str) -> DataFrame:
    return text.style_scores(reports(spark, sf).drop("lang"), "report").drop("report")


@query("eval_rollup", f"""
WITH {STYLE}, t AS (SELECT source, sum(score) AS score, round(CAST(sum(score) AS DOUBLE) / (count(*) * 5) * 100, 1) AS pass_rate,
    round(avg(n_chars), 1) AS avg_time, min(n_chars) AS min_time, max(n_chars) AS max_time FROM scored GROUP BY source),
c AS (SELECT source, check_name, count(*) FILTER (WHERE passed) AS passes, count(*) AS total
  FROM (UNPIVOT scored ON {", ".join(text.STYLE_CHECKS)} INTO NAME check_name VALUE passed) GROUP BY ALL)
SELECT source, check_name, passes, total, CAST(score AS BIGINT) AS score, pass_rate, avg_time, min_time, max_time,
  round(passes / total * 100, 1) AS pct, passes / total * 100 < 60 AS is_weak FROM c JOIN t USING (source)""", views=False)
def eval_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Document sources stand for experiments; text length stands for run time."""
    scored = text.style_scores(reports(spark, sf).drop("lang"), "report").drop("report")
    return text.eval_rollup(scored, "source", text.STYLE_CHECKS, "n_chars")


NOTES_SQL = """notes AS (SELECT conv_id, turn, text || CASE turn % 6 WHEN 0 THEN ' Retargeting is improving.' WHEN 1 THEN ' Pause the learning phase now.'
    WHEN 2 THEN ' Efficiency fell in the learning phase.' WHEN 3 THEN ' Dropping off at lead to MQL.' WHEN 4 THEN ' Frequency of 4.2 shows fatigue.'
    ELSE '' END AS note, conv_id % 2 = 0 AS has_learning, conv_id % 3 = 0 AS has_funnel, conv_id % 5 = 0 AS has_frequency FROM conversations)"""


@query("signal_scores", rf"""
WITH {NOTES_SQL}, n AS (SELECT *, lower(note) AS low FROM notes),
s AS (SELECT conv_id, turn,
  regexp_matches(low, '{text.near_campaign_pattern()}') AS trend_referenced,
  NOT has_learning OR (regexp_matches(low, 'learning.phase') AND NOT regexp_matches(low, '\bpause\b.{{0,40}}learning.phase|\bstop\b.{{0,40}}learning.phase')) AS learning_protected,
  regexp_matches(low, '\befficiency\b') AS efficiency_used,
  NOT has_funnel OR regexp_matches(low, '{"|".join(fx.FUNNEL_STAGE_PATTERNS)}') AS funnel_stage_named,
  NOT has_frequency OR ((regexp_matches(low, 'frequenc\w+\s+(?:of\s+)?(\d+\.?\d*)')
    OR regexp_matches(low, '(frequenc\w+.{{0,60}}(fatigue|refresh|audience)|fatigue.{{0,60}}frequenc\w+)')) AND contains(low, 'frequenc')) AS fatigue_flagged FROM n)
SELECT *, trend_referenced::INT + learning_protected::INT + efficiency_used::INT + funnel_stage_named::INT + fatigue_flagged::INT AS score FROM s""", views=False)
def signal_scores(spark: SparkSession, sf: str) -> DataFrame:
    turn, conv = F.col("turn"), F.col("conv_id")
    tails = [" Retargeting is improving.", " Pause the learning phase now.", " Efficiency fell in the learning phase.",
             " Dropping off at lead to MQL.", " Frequency of 4.2 shows fatigue.", ""]
    tail = F.get(F.array(*[F.lit(t) for t in tails]), (turn % 6).cast("int"))
    notes = model.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat("text", tail).alias("note"), (conv % 2 == 0).alias("has_learning"),
        (conv % 3 == 0).alias("has_funnel"), (conv % 5 == 0).alias("has_frequency"),
    )
    scored = text.signal_scores(notes, "note", "has_learning", "has_funnel", "has_frequency")
    return scored.drop("note", "has_learning", "has_funnel", "has_frequency")


@query("repaired_texts", """
SELECT doc_id, md5(text) AS repaired, md5(replace(text, 'é', 'Ã©')) AS broken FROM documents""", views=False)
def repaired_texts(spark: SparkSession, sf: str) -> DataFrame:
    broken = F.replace("text", F.lit("é"), F.lit("Ã©"))
    return model.table(spark, sf, "documents").select(
        "doc_id", F.md5(repair_mojibake(broken)).alias("repaired"), F.md5(broken).alias("broken")
    )
