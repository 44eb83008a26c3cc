
from spendlens.operators import context, text


def test_sections_last_wins_and_unknown_headings_close(spark):
    md = "lead\n# Executive Summary\nfirst\n## Notes\nlost\n### Executive summary again\n\nsecond\n\n#### deep\n## 5 Recommendations\n1. Do\n"
    got = text.report_sections(spark.createDataFrame([(md,)], "md string"), "md").first()
    assert got["executive_summary"] == "second\n\n#### deep" and got["recommendations_raw"] == "1. Do" and got["wasted_spend"] == ""


def test_recommendations(spark):
    raw = "1. **Pause** A\n- Campaign: A\n- plain\nprose **b**\n2.  Second\n\n10. Third\n* Metric: 5*\n"
    rows = text.recommendations(spark.createDataFrame([(1, raw)], "i int, raw string"), ["i"], "raw").orderBy("position").collect()
    assert [(r["title"], r["bullets"], r["prose"]) for r in rows] == [
        ("Pause A", "Campaign=A", "plain prose b"), ("Second", "", ""), ("Third", "Metric=5", "")]


def test_report_actions_and_priority(spark):
    html = "<ul><li>short</li><li class=x>Pause the <b>worst</b>   campaigns now</li><li>Review bids on brand terms</li></ul>"
    rows = text.report_actions(spark.createDataFrame([(1, html)], "i int, h string"), ["i"], "h").collect()
    assert [(r["text"], r["priority"]) for r in rows] == [("Pause the worst campaigns now", "high"), ("Review bids on brand terms", "medium")]


def test_recommendation_bullets_prefer_their_section(spark):
    html = "<li>outside one</li><h2>Recommendations</h2><ul><li>inside</li></ul><h2>Else</h2><li>later</li>"
    rows = text.recommendation_bullets(spark.createDataFrame([(1, html)], "i int, h string"), ["i"], "h").collect()
    assert [r["text"] for r in rows] == ["inside"]


def test_signal_scores(spark):
    rows = [("Retargeting is improving. efficiency. pause the learning phase", True, False, False), ("improving " + "x" * 250 + " retargeting", False, True, True)]
    df = spark.createDataFrame(rows, "t string, l boolean, f boolean, q boolean")
    a, b = text.signal_scores(df, "t", "l", "f", "q").collect()
    assert a["trend_referenced"] and not a["learning_protected"] and a["efficiency_used"] and a["score"] == 4
    assert not b["trend_referenced"] and b["learning_protected"] and not b["funnel_stage_named"] and not b["fatigue_flagged"]


def test_context_fixture(spark):
    good = ('{"business_type":"ecommerce","anomaly_sensitivity":"high","campaign_tags":{"Brand Core":"brand","Pilot":"test"},'
            '"campaign_targets":[{"name":"PMax","target_roas":3.0,"target_cpa":500}],"monthly_budget_total":"9 L","monthly_budget_google":"5 L"}')
    df = spark.createDataFrame([(1, good), (2, "old notes"), (3, None)], "client_id long, context string")
    parsed = {r["client_id"]: r["ctx"] for r in context.parse_context(df).collect()}
    assert parsed[1]["business_type"] == "ecommerce" and parsed[2]["extra"] == "old notes" and parsed[2]["business_type"] == "other"
    assert {(r["name_key"], r["tag"]) for r in context.campaign_tags(df).collect()} == {("brand core", "brand"), ("pilot", "test")}
    target = context.campaign_targets(df).first()
    assert (target["name_key"], target["target_roas"], target["target_cpa"], target["target_cpl"]) == ("pmax", 3.0, 500.0, None)
    texts = {r["client_id"]: r["briefing"] for r in context.briefings(df).collect()}
    assert "Monthly budget: 9 L (Google 5 L)" in texts[1] and "target ROAS 3.0x target CPA 500" in texts[1]
    assert texts[2].splitlines()[2] == "Additional context: old notes" and texts[3] == ""


def test_no_item_is_left_out(spark):
    html = "<ul>" + "".join(f"<li>item number {i} with enough text</li>" for i in range(40)) + "</ul>"
    raw = "\n".join(f"{i}. Title {i}" for i in range(1, 13))
    df = spark.createDataFrame([(1, html, raw)], "k int, html string, raw string")
    assert text.report_actions(df, ["k"], "html").count() == 40 == text.recommendation_bullets(df, ["k"], "html").count()
    assert text.recommendations(df, ["k"], "raw").count() == 12
