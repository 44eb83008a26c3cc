"""FIXED VALUES: labels, guidance sentences and benchmark ranges that appear in client briefings."""

BUSINESS_LABELS = {
    "ecommerce": "E-commerce / D2C",
    "b2b_saas": "B2B SaaS",
    "lead_gen": "Lead Generation",
    "app": "Mobile App",
    "local": "Local / Brick-and-Mortar",
    "other": "Other",
}
BUSINESS_IMPLIED = {
    "ecommerce": "This is an e-commerce or D2C business. Purchases are typically impulse or short-consideration. "
                 "ROAS and revenue are primary metrics. Do not reference sales cycles. Focus on cart abandonment, "
                 "product-level ROAS, and retargeting efficiency.",
    "b2b_saas": "This is a B2B SaaS business with a long sales cycle (typically 1-6 months). Lead quality matters more "
                "than lead volume. MQL and SQL rates are critical. ROAS may not be directly measurable - focus on cost "
                "per MQL, cost per SQL, and pipeline value. Brand awareness campaigns support long-term pipeline.",
    "lead_gen": "This is a lead generation business. CPL and lead volume are primary metrics. Funnel conversion rates "
                "(lead to MQL to SQL) are important. Sales cycle is typically days to weeks.",
    "app": "This is a mobile app business. Cost per install (CPI) and in-app conversion rates are primary metrics. ROAS "
           "is measured via in-app purchases or subscriptions. Retargeting lapsed users is often as important as new "
           "user acquisition.",
    "local": "This is a local or brick-and-mortar business. Store visits, calls, and local awareness are primary goals. "
             "Geographic targeting is critical. Online ROAS may undercount in-store conversions.",
    "other": "",
}
WITH_SALES_CYCLE = ["b2b_saas", "lead_gen", "other"]
MATURITY_LABELS = {
    "new": "New account (0-6 months)",
    "growing": "Growing account (6-18 months)",
    "mature": "Mature account (18+ months)",
}
MATURITY_GUIDANCE = {
    "new": "This is a new account. Focus on foundational fixes and learning phase campaigns. Do not suggest advanced bid "
           "strategies or audience layering.",
    "growing": "This account is in a growth phase. Balance foundational health with optimisation. Flag structural issues "
               "alongside performance improvements.",
    "mature": "This is a mature account. Skip basic setup issues. Focus on marginal optimisation, budget efficiency, and "
              "strategic reallocation.",
}
USER_TYPE_LABELS = {"in_house": "In-house marketer", "agency": "Agency", "freelancer": "Freelancer"}
USER_TYPE_GUIDANCE = {
    "in_house": "The user is an in-house marketer. Explain the reasoning behind recommendations clearly — they may not "
                "have deep paid media expertise.",
    "agency": "The user is an agency. Write sharp, directive recommendations with no hand-holding. Skip theory, go "
              "straight to actions and numbers.",
    "freelancer": "The user is a freelancer. Prioritise the highest-impact recommendations tightly — they have limited "
                  "bandwidth.",
}
ATTRIBUTION_NOTES = {
    "last_click": "Last-click attribution - all credit goes to the final ad clicked before conversion. Brand/branded "
                  "campaigns will look stronger than they are. Top-of-funnel campaigns (awareness, prospecting) will be "
                  "undercounted.",
    "first_click": "First-click attribution - all credit goes to the first ad that introduced the user. Top-of-funnel "
                   "campaigns will look stronger. Retargeting and bottom-of-funnel campaigns will be undercounted.",
    "linear": "Linear attribution - credit split equally across all touchpoints. No single campaign is over- or "
              "under-credited, but the model may dilute the real impact of high-intent clicks.",
    "time_decay": "Time-decay attribution - recent touchpoints get more credit. Retargeting and remarketing campaigns "
                  "will appear stronger. Long sales cycle campaigns (brand, content) will be undercounted.",
    "data_driven": "Data-driven attribution (Google) - ML-based, distributes credit based on actual contribution to "
                   "conversion paths. Most accurate but requires sufficient conversion volume (50+ conversions/month).",
    "position_based": "Position-based (40/20/40) attribution - 40% credit to first and last touch, 20% split across "
                      "middle. Balanced between awareness and conversion credit.",
}
# business type -> {metric: (low, median, high)}
BENCHMARK_RANGES = {
    "ecommerce": {"google_roas": (2.0, 4.5, 8.0), "meta_roas": (1.5, 3.0, 6.0),
                  "ctr_google": (1.5, 3.5, 7.0), "ctr_meta": (0.5, 1.2, 2.5)},
    "b2b_saas": {"google_cpl": (800, 2500, 6000), "meta_cpl": (600, 1800, 4500),
                 "ctr_google": (2.0, 4.5, 9.0), "ctr_meta": (0.3, 0.8, 1.8)},
    "lead_gen": {"google_cpl": (300, 900, 2500), "meta_cpl": (200, 600, 1500),
                 "ctr_google": (2.5, 5.0, 10.0), "ctr_meta": (0.5, 1.2, 2.8)},
    "app": {"google_cpi": (20, 60, 150), "meta_cpi": (15, 45, 120),
            "ctr_google": (1.0, 2.5, 5.0), "ctr_meta": (0.4, 1.0, 2.2)},
    "local": {"google_cpl": (150, 400, 900), "meta_cpl": (100, 280, 650),
              "ctr_google": (3.0, 6.0, 12.0), "ctr_meta": (0.6, 1.5, 3.5)},
}
BENCHMARK_NOTES = {
    "ecommerce": "Benchmarks vary widely by category (fashion vs electronics vs FMCG). Use as rough orientation only.",
    "b2b_saas": "CPL varies heavily by ICP (SMB vs enterprise) and geography. High CPL is acceptable if SQL rate is strong.",
    "lead_gen": "Lead gen CPL benchmarks assume standard form fills. Highly qualified lead flows (demos, appointments) will "
                "naturally cost more.",
    "app": "CPI benchmarks are for app installs. In-app purchase ROAS targets depend on LTV model.",
    "local": "Local businesses often undercount conversions (store visits, calls). Reported ROAS understates true impact.",
}
BENCHMARK_HEADER = (
    "Industry benchmarks for {label} (target direction — compare against account history below):\n"
    "  Use these as the goal to close toward, not as a pass/fail threshold."
)


def benchmark_texts() -> dict[str, str]:
    """Benchmark paragraph per business type: one line per ROAS, CPL or CPI range."""
    texts = {}
    for kind, ranges in BENCHMARK_RANGES.items():
        lines = [BENCHMARK_HEADER.format(label=BUSINESS_LABELS[kind])]
        for metric in ("roas", "cpl", "cpi"):
            unit = "x" if metric == "roas" else ""
            for platform in ("google", "meta"):
                if f"{platform}_{metric}" in ranges:
                    low, median, high = ranges[f"{platform}_{metric}"]
                    lines.append(f"  {platform.title()} {metric.upper()} target range: "
                                 f"low {low}{unit} | median {median}{unit} | high {high}{unit}")
        lines.append(f"  Note: {BENCHMARK_NOTES[kind]}")
        texts[kind] = "\n".join(lines)
    return texts
