"""Header planning: which raw column means what. Works on column names only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens import fixed_values as fx


def plan_renames(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """Map raw to canonical names: exact alias in list order, else the first header containing the name."""
    by_key = {c.strip().lower(): c for c in columns}
    plan: dict[str, str] = {}
    for canonical in aliases:
        if canonical in by_key:
            continue
        candidates = [by_key[a] for a in map(str.lower, aliases[canonical]) if a in by_key]
        candidates = candidates[:1] or [raw for key, raw in by_key.items() if canonical in key and raw not in plan]
        if candidates:
            plan[candidates[0]] = canonical
    return plan


def map_columns(df: DataFrame, aliases: dict[str, list[str]], pre_rename: dict[str, str] | None = None) -> DataFrame:
    """Apply the caller's renames, lower-case headers, then map them to canonical names."""
    renamed = df.withColumnsRenamed(pre_rename or {})
    lowered = renamed.toDF(*[c.strip().lower() for c in renamed.columns])
    return lowered.withColumnsRenamed(plan_renames(lowered.columns, aliases))


def map_web_columns(df: DataFrame, pre_rename: dict[str, str] | None = None) -> DataFrame:
    """Web-analytics headers to canonical names; unknown headers stay."""
    renamed = df.withColumnsRenamed(pre_rename or {})
    known = {c: fx.WEB_HEADERS.get(" ".join(c.strip().lower().split())) for c in renamed.columns}
    return renamed.withColumnsRenamed({c: name for c, name in known.items() if name})


def mapping_report(spark: SparkSession, columns: list[str], aliases: dict[str, list[str]]) -> DataFrame:
    """One row per canonical field with the raw header it would come from, null when unmapped."""
    found = {canonical: raw for raw, canonical in plan_renames(columns, aliases).items()}
    found.update({c.strip().lower(): c for c in columns if c.strip().lower() in aliases})
    rows = [(canonical, found.get(canonical)) for canonical in aliases]
    return spark.createDataFrame(rows, "canonical string, raw_column string")


def require_columns(df: DataFrame, required: list[str], source: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{source} export lacks required columns {missing}; found {df.columns}")
    return df


def first_header(columns: list[str], candidates: list[str]) -> str | None:
    present = {c.strip().lower(): c for c in columns}
    return next((present[c] for c in candidates if c in present), None)


def client_column(columns: list[str]) -> str | None:
    return first_header(columns, fx.CLIENT_HEADERS)


def granularity(columns: list[str]) -> str:
    """Finest level an export holds, judged by its headers."""
    keyword, ad, adgroup, placement = (
        first_header(columns, h) for h in (fx.KEYWORD_HEADERS, fx.AD_HEADERS, fx.ADGROUP_HEADERS, fx.PLACEMENT_HEADERS)
    )
    levels = [("keyword", keyword), ("ad", ad and adgroup), ("ad_group", adgroup), ("placement", placement),
              ("campaign", first_header(columns, fx.CAMPAIGN_HEADERS[:2]))]
    return next((level for level, found in levels if found), "unknown")


def funnel_stages(columns: list[str]) -> dict[str, str | None]:
    return {stage: first_header(columns, headers) for stage, headers in fx.FUNNEL_STAGE_HEADERS.items()}


def funnel_join_level(columns: list[str]) -> str:
    if first_header(columns, fx.FUNNEL_CAMPAIGN_HEADERS):
        return "campaign"
    return "date" if first_header(columns, fx.FUNNEL_DATE_HEADERS) else "aggregate"


def web_join_key(columns: list[str]) -> str:
    key = next((c for c in fx.WEB_JOIN_KEYS if c in columns), None)
    if key is None:
        raise ValueError("web-analytics export needs a campaign, source/medium or channel group column")
    return key


def split_strategy(columns: list[str], client_override: str | None = None) -> str | None:
    """The column that names the client in a bulk export, if any."""
    if client_override and client_override in columns:
        return client_override
    return client_column(columns)


def clients_in_bulk(df: DataFrame, client_col: str) -> DataFrame:
    """Distinct client names of a bulk export without blanks and null words."""
    name = F.trim(F.col(client_col).cast("string"))
    return df.select(name.alias("client_name")).where(
        F.col("client_name").isNotNull() & ~F.lower("client_name").isin("nan", "none", "")
    ).distinct()
