"""Statistical anomalies against a campaign's own recent history.

The last twelve earlier uploads are collected per row as one short array; baselines,
season check and creative fatigue are all expressions over it, so one window serves all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens import fixed_values as fx
from spendlens.functions import formatting as fmt
from spendlens.functions.guards import any_of, count_where, present, rnd
from spendlens.functions.medians import array_median
from spendlens.operators import context, history

SKIPPED_TAGS = ["test", "brand"]
HISTORY_METRICS = ["cac", "roas", "ctr", "spend"]


def with_history(campaigns: DataFrame) -> DataFrame:
    """Add ``past``: rows of the same campaign in the client's previous uploads, oldest first."""
    entry = F.struct("upload_rank", F.month("period_date").alias("month"), *HISTORY_METRICS)
    window = history.campaign_window(-fx.SEASON_UPLOADS, -1)
    blocks = history.in_blocks(campaigns, fx.SEASON_UPLOADS)
    return history.own_rows(blocks.withColumn("past", F.collect_list(entry).over(window)))


def _values(metric: str, keep) -> Column:
    wanted = F.filter("past", lambda h: keep(h) & h[metric].isNotNull())
    return F.transform(wanted, lambda h: h[metric])


def recent_values(metric: str) -> Column:
    return _values(metric, lambda h: h["upload_rank"] >= F.col("upload_rank") - fx.BASELINE_UPLOADS)


def baseline(metric: str) -> Column:
    """Median of the recent values, null with too few of them."""
    recent = recent_values(metric)
    return F.when(F.size(recent) >= fx.BASELINE_MIN_POINTS, array_median(recent))


def is_seasonal(metric: str) -> Column:
    """True when the value is close to what the same calendar month looked like before."""
    typical = present(array_median(_values(metric, lambda h: h["month"] == F.month("period_start"))))
    near = F.abs((F.col(metric) - typical) / typical) <= fx.SEASON_TOLERANCE
    return F.coalesce(near, F.lit(False))


def _relative(current: Column, base: Column) -> Column:
    return F.coalesce((current - base) / F.nullif(base, F.lit(0.0)), F.lit(0.0))


def _threshold(kind: str) -> Column:
    level = F.col("sensitivity")
    limits = fx.ANOMALY_THRESHOLDS
    return (
        F.when(level == "low", limits["low"][kind])
        .when(level == "high", limits["high"][kind])
        .otherwise(limits["medium"][kind])
    )


def _row(fires: Column, metric: str, current: Column, base: Column, change: Column, direction: Column,
         severity: Column, description: Column, seasonal: Column | None = None) -> Column:
    return F.when(fires, F.struct(
        F.lit(metric).alias("metric"), rnd(current, 4).alias("current_value"), rnd(base, 4).alias("baseline_value"),
        rnd(change * 100, 1).alias("pct_change"), direction.alias("direction"), severity.alias("severity"),
        description.alias("description"), (seasonal if seasonal is not None else F.lit(False)).alias("seasonal"),
    ))


def _against_baseline() -> list[Column]:
    """Cost, ROAS, CTR and pacing against their medians.

    FIXED VALUES: metric names and the wording of descriptions, here and in the checks below.
    """

    def graded(change: Column, limit: Column) -> Column:
        size = F.abs(change) / limit
        return F.when(size >= 2, "critical").when(size >= 1, "warning").otherwise("info")

    def pct(change: Column) -> Column:
        return fmt.decimals(F.abs(change) * 100, 0)

    def compared(metric: str, text) -> Column:
        return F.concat(F.lit("("), text(F.col(metric)), F.lit(" vs "), text(F.col(f"base_{metric}")), F.lit(")"))

    def suffixed(digits: int, unit: str):
        return lambda value: F.concat(fmt.decimals(value, digits), F.lit(unit))

    checks = []
    for name, metric, kind, text in (
        ("cpl", "cac", "cpl", fmt.grouped), ("roas", "roas", "roas", suffixed(2, "x")),
        ("ctr", "ctr", "ctr", suffixed(2, "%")), ("spend_pacing", "spend", "pacing", fmt.grouped),
    ):
        current, base, limit = F.col(metric), F.col(f"base_{metric}"), _threshold(kind)
        change = _relative(current, base)
        valued = base.isNotNull() & (current.isNotNull() if metric == "roas" else current > 0)
        if name == "cpl":
            fires, direction = change > limit, F.lit("spike")
            lead, tail = F.lit("CPL spiked "), F.lit("% above recent avg ")
        elif name == "spend_pacing":
            fires, direction = F.abs(change) > limit, F.when(change > 0, "spike").otherwise("drop")
            lead, tail = F.concat(F.lit("Spend "), direction, F.lit(" ")), F.lit("% vs recent avg ")
        else:
            fires, direction = change < -limit, F.lit("drop")
            lead, tail = F.lit(f"{name.upper()} dropped "), F.lit("% below recent avg ")
        text_line = F.concat(lead, pct(change), tail, compared(metric, text))
        checks.append(_row(valued & fires, name, current, base, change, direction, graded(change, limit), text_line,
                           is_seasonal(metric)))
    return checks


def _against_targets() -> list[Column]:
    """Goals set for single campaigns: ROAS too low, cost per lead or action too high."""
    roas, cac = F.col("roas"), F.col("cac")
    goal = present("target_roas")
    short = _relative(roas, goal)
    rows = [_row(
        roas < goal, "roas_target", roas, goal, short, F.lit("miss"),
        F.when(F.abs(short) >= 0.4, "critical").otherwise("warning"),
        F.concat(F.lit("ROAS "), fmt.decimals(roas, 2), F.lit("x misses target "), fmt.decimals(goal, 2), F.lit("x ("),
                 fmt.decimals(F.abs(short) * 100, 0), F.lit("% below goal)")),
    )]
    for label in ("cpl", "cpa"):
        limit = present(f"target_{label}")
        over = _relative(cac, limit)
        rows.append(_row(
            (cac > 0) & (cac > limit), f"{label}_target", cac, limit, over, F.lit("miss"),
            F.when(over >= 0.5, "critical").otherwise("warning"),
            F.concat(F.lit(f"{label.upper()} "), fmt.grouped(cac), F.lit(" exceeds target "), fmt.grouped(limit),
                     F.lit(" ("), fmt.decimals(over * 100, 0), F.lit("% over goal)")),
        ))
    return rows


def _creative_fatigue() -> Column:
    """CTR of the last three earlier uploads falling each time without a single large drop."""
    limit = fx.ANOMALY_THRESHOLDS["medium"]["ctr"]
    last = F.col("last_ctr")
    first, second, third = last[0], last[1], last[2]
    drop = _relative(third, first)
    steps = F.greatest(F.abs(_relative(second, first)), F.abs(_relative(third, second)))
    fires = (F.size(last) == 3) & (first > second) & (second > third) & (steps < limit) & (F.abs(drop) >= fx.FATIGUE_MIN_DROP)
    return _row(
        fires, "creative_fatigue", third, first, drop, F.lit("drop"), F.lit("warning"),
        F.concat(F.lit("Creative fatigue: CTR declined "), fmt.decimals(F.abs(drop) * 100, 0),
                 F.lit("% over last 3 uploads ("), fmt.decimals(first, 2), F.lit("% to "), fmt.decimals(third, 2),
                 F.lit("%) - consider refreshing creative")),
    )


def detect_anomalies(campaigns: DataFrame, clients: DataFrame) -> DataFrame:
    """Anomalies of all uploads of all clients. ``campaigns`` carries upload ranks."""
    keep = [*history.CAMPAIGN, "upload_id", "upload_rank", "upload_count", "period_date", "period_start", *HISTORY_METRICS]
    rows = context.with_tags_and_targets(campaigns.select(*keep), clients)
    rows = rows.where(~F.coalesce(F.col("tag").isin(SKIPPED_TAGS), F.lit(False)))
    rows = rows.join(context.sensitivity(clients), "client_id", "left")
    recent_ctr = recent_values("ctr")
    prepared = with_history(rows).withColumns(
        {
            **{f"base_{m}": baseline(m) for m in HISTORY_METRICS},
            "last_ctr": F.slice(recent_ctr, F.greatest(F.size(recent_ctr) - 2, F.lit(1)), F.lit(3)),
        }
    )
    found = [*_against_targets(), *_against_baseline(), _creative_fatigue()]
    return prepared.select(
        "client_id", "upload_id", "upload_rank", "upload_count", "period_date", "campaign_name", "platform",
        F.explode(F.array_compact(F.array(*found))).alias("found"),
    ).select("client_id", "upload_id", "upload_rank", "upload_count", "period_date", "campaign_name", "platform", "found.*")


def anomaly_summary(anomalies: DataFrame, *keys: str) -> DataFrame:
    """Open anomalies per severity."""
    levels = ["critical", "warning", "info"]
    severity = F.col("severity")
    return anomalies.groupBy(*keys).agg(
        *[count_where(severity == level).alias(level) for level in levels],
        count_where(any_of([severity == level for level in levels])).alias("total"),
    )
