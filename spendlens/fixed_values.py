"""FIXED VALUES: thresholds, weights, word lists and aliases that results depend on.

Changing any entry changes results, so all of them live here, in natural order.
"""

# ---- severities, waste, learning phase -------------------------------------------------
ROAS_CRITICAL_BELOW = 1.0
ROAS_WARNING_BELOW = 2.0
WARNING_WASTE_SHARE = 0.5
LEARNING_IMPRESSIONS = 1000
LEARNING_CONVERSIONS = 10
TREND_BAND = 0.05

# ---- anomaly detection -----------------------------------------------------------------
# sensitivity -> relative change that counts as an anomaly
ANOMALY_THRESHOLDS = {
    "low": {"cpl": 0.50, "roas": 0.35, "ctr": 0.40, "pacing": 0.30},
    "medium": {"cpl": 0.30, "roas": 0.20, "ctr": 0.25, "pacing": 0.15},
    "high": {"cpl": 0.15, "roas": 0.10, "ctr": 0.12, "pacing": 0.10},
}
BASELINE_UPLOADS = 5       # earlier uploads behind a baseline
SEASON_UPLOADS = 12        # earlier uploads searched for the same calendar month
BASELINE_MIN_POINTS = 3
SEASON_TOLERANCE = 0.25
FATIGUE_MIN_DROP = 0.10

# ---- KPI alerts ------------------------------------------------------------------------
DEFAULT_MIN_ROAS = 2.0
DEFAULT_MAX_SHIFT_PCT = 20.0

# ---- forecast --------------------------------------------------------------------------
WMA_WEIGHTS = [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 7]  # oldest to newest, right-aligned
DEFAULT_PERIOD_DAYS = 30.0

# ---- audit -----------------------------------------------------------------------------
CATEGORY_WEIGHTS = {
    "Tracking Foundation": 0.25,
    "Campaign Architecture": 0.20,
    "Ad Set Configuration": 0.15,
    "Creative Performance": 0.15,
    "Cost Diagnostics": 0.15,
    "Account Health": 0.10,
}
STATUS_POINTS = {"pass": 100, "warning": 50, "fail": 0}
CTR_BENCHMARK = {"google": 3.0, "meta": 1.5}
AWARENESS_WORDS = ["awareness", "reach", "tof", "top", "brand", "prospecting"]
CONVERSION_WORDS = ["conversion", "purchase", "retarget", "bof", "bottom", "remarketing", "sale"]
FORMAT_WORDS = {
    "video": ["video", "reel", "story"],
    "image": ["image", "banner", "static", "carousel"],
    "search": ["search", "keyword", "dsa"],
    "shopping": ["shopping", "pmax", "performance max"],
}
RETARGETING_WORDS = ["retarget", "remarketing", "cart", "abandon", "returning", "existing"]

# ---- cleaning --------------------------------------------------------------------------
SHORTHAND_PATTERN = r"^([\d,]+\.?\d*)([kKmMlLcCbB]r?)$"
SHORTHAND_FACTORS = {"k": 1e3, "m": 1e6, "l": 1e5, "cr": 1e7, "b": 1e9}
SUMMARY_NAME_PATTERN = r"(?i)^(total|grand total|subtotal|all campaigns|summary|report total|aggregate|\s*)$"
DATE_WORDS = ["date", "day", "week", "month", "period"]
DATE_NULL_WORDS = ["", "nan", "none", "null", "n/a", "--", "-", "date"]
EXCEL_FIRST, EXCEL_LAST = 36526, 51911
EXCEL_EPOCH = "1899-12-30"
TWO_DIGIT_YEAR_PIVOT = 50
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
MOJIBAKE = {
    "â‚¹": "₹",
    "â€“": "-",
    "â€™": "'",
    "â€\u009c": '"',
    "â€\u009d": '"',
    "â€˜": "'",
    "â€¦": "...",
    "Ã©": "é",
    "Ã ": "à",
}

# ---- column aliases (canonical name -> accepted headers, first match wins) --------------
GOOGLE_ALIASES = {
    "campaign": ["campaign", "campaign name", "campaign_name", "ad campaign", "name", "campaign title"],
    "impressions": ["impressions", "impr.", "impr", "impression", "total impressions", "imps"],
    "clicks": ["clicks", "click", "total clicks", "link clicks"],
    "cost": ["cost", "spend", "cost (inr)", "amount spent", "total cost", "spend (inr)",
             "cost (rs)", "spend (rs)", "cost/currency", "total spend", "charges"],
    "conversions": ["conversions", "conversion", "conv.", "conv", "total conversions",
                    "all conv.", "all conversions", "results", "leads"],
    "conversion value": ["conversion value", "conv. value", "revenue", "total conversion value",
                         "conv. value (inr)", "value", "total value", "purchase value"],
}
META_ALIASES = {
    "campaign name": ["campaign name", "campaign", "campaign_name", "name", "ad campaign"],
    "impressions": ["impressions", "impr.", "impr", "reach", "total impressions"],
    "clicks": ["clicks", "link clicks", "total clicks", "click", "outbound clicks"],
    "amount spent": ["amount spent", "spend", "cost", "amount spent (inr)", "amount spent (rs)",
                     "total amount spent", "charges", "spend (inr)"],
    "results": ["results", "conversions", "leads", "purchases", "actions", "outcomes"],
    "purchase roas": ["purchase roas", "roas", "website purchase roas", "return on ad spend",
                      "purchase return on ad spend", "ad set roas"],
    "purchase value": ["purchase value", "conversion value", "conv. value", "revenue",
                       "total value", "website purchase value", "value"],
    "reach": ["reach", "unique reach", "estimated reach", "people reached"],
    "frequency": ["frequency", "avg. frequency", "average frequency", "ad frequency"],
}
FUNNEL_ALIASES = {
    "campaign": ["campaign", "campaign name", "campaign_name", "name", "source", "ad campaign"],
    "leads": ["leads", "lead", "total leads", "all leads", "form fills", "enquiries",
              "inquiries", "submissions", "form submissions"],
    "mqls": ["mql", "mqls", "marketing qualified leads", "marketing qualified",
             "qualified leads", "marketing ql"],
    "sqls": ["sql", "sqls", "sales qualified leads", "sales qualified",
             "opportunities", "sales ql", "sales accepted leads", "sal"],
    "customers": ["customers", "customer", "closed", "closed won", "new customers",
                  "sales", "deals won", "won", "purchases", "paying customers"],
}
WEB_HEADERS = {
    "session campaign name": "campaign", "session campaign": "campaign", "campaign": "campaign",
    "campaign name": "campaign", "utm campaign": "campaign", "utm_campaign": "campaign",
    "session source / medium": "source_medium", "session source/medium": "source_medium",
    "source / medium": "source_medium", "source/medium": "source_medium",
    "session default channel group": "channel_group", "default channel grouping": "channel_group",
    "channel grouping": "channel_group",
    "sessions": "sessions", "users": "users", "total users": "users", "new users": "new_users",
    "engaged sessions": "engaged_sessions", "engagement rate": "engagement_rate",
    "bounce rate": "bounce_rate", "average session duration": "avg_session_duration",
    "avg. session duration": "avg_session_duration", "pages / session": "pages_per_session",
    "pages per session": "pages_per_session", "screen page views per session": "pages_per_session",
    "conversions": "conversions", "key events": "conversions", "goal completions": "conversions",
    "transactions": "transactions", "purchases": "transactions",
    "purchase revenue": "revenue", "total revenue": "revenue", "revenue": "revenue",
    "ecommerce revenue": "revenue",
}
# what a column preview offers for web-analytics files (canonical field -> accepted headers)
WEB_PREVIEW_ALIASES = {
    "campaign": ["session campaign name", "session campaign", "campaign", "campaign name", "utm_campaign"],
    "sessions": ["sessions"],
    "engaged_sessions": ["engaged sessions"],
    "bounce_rate": ["bounce rate"],
    "conversions": ["conversions", "key events", "goal completions"],
    "revenue": ["purchase revenue", "total revenue", "revenue", "ecommerce revenue"],
}
WEB_JOIN_KEYS = ["campaign", "source_medium", "channel_group"]
WEB_NUMERIC = ["sessions", "users", "new_users", "engaged_sessions", "engagement_rate", "bounce_rate",
               "avg_session_duration", "pages_per_session", "conversions", "transactions", "revenue"]
WEB_MIN_CONTAINED = 10     # shortest name that may match by containment
CLIENT_HEADERS = [
    "client", "client name", "client_name", "account", "account name", "account_name",
    "advertiser", "advertiser name", "advertiser_name", "brand", "brand name", "brand_name",
    "mcc account", "mcc", "manager account", "company", "company name",
    "customer", "customer name", "organization", "org",
]
CAMPAIGN_HEADERS = ["campaign", "campaign name", "campaign_name"]
SPEND_HEADERS = ["cost", "amount spent", "spend"]
ADGROUP_HEADERS = ["ad group", "adgroup", "ad group name", "ad_group", "ad group id",
                   "ad set", "ad set name", "adset", "ad set id"]
KEYWORD_HEADERS = ["keyword", "keywords", "search term", "search query",
                   "keyword text", "query", "keyword (broad match type)"]
AD_HEADERS = ["ad", "ad name", "ad title", "ad id", "creative", "creative name",
              "ad description", "headline", "ad copy", "ad variant"]
PLACEMENT_HEADERS = ["placement", "site", "app", "display placement", "managed placement",
                     "where ads showed", "domain"]
ROLLUP_SUM = ["impressions", "clicks", "cost", "conversions", "conversion value",
              "amount spent", "results", "spend", "revenue", "wasted",
              "leads", "mqls", "sqls", "customers"]
ROLLUP_WEIGHTED = ["roas", "ctr", "cpc", "cac", "purchase roas"]
ROLLUP_MAX = ["quality score"]
ROLLUP_SUM_EXTRA = ["purchase value", "reach"]   # kept on roll-up so no measure is lost
FUNNEL_STAGES = ["leads", "mqls", "sqls", "customers"]
FUNNEL_STAGE_HEADERS = {
    "leads": ["leads", "lead", "total leads", "all leads", "form fills", "enquiries", "inquiries"],
    "mqls": ["mql", "mqls", "marketing qualified leads", "marketing qualified", "qualified leads"],
    "sqls": ["sql", "sqls", "sales qualified leads", "sales qualified", "opportunities"],
    "customers": ["customers", "customer", "closed", "closed won", "conversions", "new customers", "sales"],
}
FUNNEL_CAMPAIGN_HEADERS = ["campaign", "campaign name", "campaign_name", "ad campaign", "name"]
FUNNEL_DATE_HEADERS = ["date", "period", "month", "week", "date range"]
REQUIRED_COLUMNS = {
    "google": ["campaign", "impressions", "clicks", "cost", "conversions", "conversion value"],
    "meta": ["campaign name", "impressions", "clicks", "amount spent", "results", "purchase roas"],
}

# ---- export source detection (header fragment, weight) ----------------------------------
SOURCE_SIGNALS = {
    "google": [
        ("conversion value", 30), ("quality score", 25), ("search impression", 25), ("cost / conv", 20),
        ("all conv", 15), ("impression share", 20), ("search lost", 15), ("match type", 15),
        ("keyword", 10), ("ad group", 10), ("campaign", 5), ("cost", 5), ("conversions", 5),
        ("clicks", 3), ("impressions", 3),
    ],
    "meta": [
        ("purchase roas", 35), ("return on ad spend", 30), ("amount spent", 25), ("ad set name", 25),
        ("ad set id", 20), ("objective", 20), ("results", 15), ("reach", 10), ("frequency", 15),
        ("delivery", 10), ("campaign name", 8), ("clicks (all)", 15), ("link clicks", 10), ("impressions", 3),
    ],
    "ga4": [
        ("google analytics", 50), ("session campaign", 40), ("session source", 35),
        ("session default channel", 35), ("engaged sessions", 30), ("engagement rate", 25),
        ("bounce rate", 20), ("sessions", 15), ("avg. session", 20), ("key events", 25),
        ("total revenue", 10), ("new users", 10),
    ],
    "funnel": [
        ("mqls", 40), ("sqls", 40), ("marketing qualified", 40), ("sales qualified", 40),
        ("sql", 30), ("mql", 30), ("cost per lead", 25), ("leads", 20), ("opportunities", 20),
        ("customers", 15), ("close rate", 20), ("closed won", 25),
    ],
}
META_ONLY_SIGNALS = ["purchase roas", "return on ad spend"]
GOOGLE_ONLY_SIGNALS = ["conversion value", "quality score"]

# ---- text operators --------------------------------------------------------------------
HIGH_PRIORITY_WORDS = ["pause", "stop", "critical", "immediately", "urgent"]
MEDIUM_PRIORITY_WORDS = ["reduce", "decrease", "review", "monitor"]
REPORT_SECTIONS = [
    ("executive summary", "executive_summary"),
    ("wasted spend", "wasted_spend"),
    ("wasted spend analysis", "wasted_spend"),
    ("underperforming campaigns", "underperformers_text"),
    ("budget reallocation", "reallocation"),
    ("5 recommendations", "recommendations_raw"),
    ("recommendations", "recommendations_raw"),
]
KNOWN_CAMPAIGNS = [
    "brand awareness", "performance max", "retargeting", "competitor keywords",
    "search - product launch", "dynamic search", "shopping - electronics",
    "display - remarketing", "awareness - lookalike", "retargeting - website",
    "conversion - cold traffic", "lead gen - free trial", "video views", "catalog sales",
]
FILLER_PHRASES = [
    "it is important to", "it is worth noting", "leverage", "it is crucial",
    "it should be noted", "going forward", "in order to",
]
HEDGE_PATTERNS = [
    r"\bconsider\b", r"\byou might\b", r"\blook into\b", r"\bexplore\b",
    r"\bmay want to\b", r"\bmight want to\b",
]
VAGUE_PATTERNS = [r"\bsome campaigns\b", r"\bcertain campaigns\b",
                  r"\bunderperforming campaigns\b(?! \()", r"\bthese campaigns\b"]
IMPERATIVE_VERBS = [
    "pause", "increase", "decrease", "switch", "test", "add", "remove",
    "restructure", "reduce", "reallocate", "stop", "launch", "enable",
    "disable", "update", "fix", "move", "cut", "scale", "expand",
]
FUNNEL_STAGE_PATTERNS = [
    r"lead.to.mql", r"mql.to.sql", r"sql.to.customer", r"worst.funnel",
    r"funnel.bottleneck", r"dropping off at", r"lead.mql", r"mql.sql",
]
WEAK_EVAL_BELOW_PCT = 60
SETUP_STEPS = 6
