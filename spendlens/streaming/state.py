"""Previous-period comparison kept as keyed stream state."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

KEYS = ["client_id", "platform", "campaign_name"]
OUTPUT = ("client_id long, platform string, campaign_name string, upload_id long, roas double, prior_roas double, "
          "spend double, prior_spend double")
PERIOD = ["period_date", "upload_id", "roas", "spend"]
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Periods this long before a campaign's newest one leave its state.
HORIZON_DAYS = 3660


class PreviousPeriod(StatefulProcessor):
    """Emits each arriving period next to the latest one strictly before it.

    State is a map with an entry per period, that of its highest upload, so a late period finds its
    own predecessor instead of whatever arrived last, and an arrival writes the entries of its own
    periods only. Entries of periods beyond the horizon are removed as newer periods arrive. With
    ``idle_ms`` an entry also leaves once it has not been written for so long, which clears
    campaigns that have ended; a period that arrives later has no predecessor then.
    """

    def __init__(self, horizon_days: int, idle_ms: int | None) -> None:
        self.horizon = timedelta(days=horizon_days)
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.periods = handle.getMapState("periods", "period_date date", "upload_id long, roas double, spend double", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # rows of a key come in chunks of any order: all of them enter the state before the first is compared
        arrived = pd.concat([frame[PERIOD] for frame in rows], ignore_index=True)
        days = [_day(d) for d in arrived["period_date"]]
        held = {k[0]: tuple(v) for k, v in self.periods.iterator()}
        changed = set()
        for day, upload, roas, spend in zip(days, arrived["upload_id"], arrived["roas"], arrived["spend"], strict=True):
            upload = None if pd.isna(upload) else int(upload)
            known = held.get(day)
            if known is None or known[0] is None or (upload is not None and upload >= known[0]):
                held[day] = (upload, _number(roas), _number(spend))
                changed.add(day)
        oldest = max(held) - self.horizon
        order = sorted(held)
        before = dict(zip(order[1:], order))  # the predecessor of every period
        prior = [held.get(before.get(day), (None, None, None)) for day in days]
        for day in changed:
            if day >= oldest:
                self.periods.updateValue((day,), held[day])
        for day in held:
            if day < oldest and (day not in changed or self.periods.containsKey((day,))):
                self.periods.removeKey((day,))
        yield pd.DataFrame({
            **dict(zip(KEYS, key, strict=True)), "upload_id": arrived["upload_id"], "roas": arrived["roas"],
            "prior_roas": pd.array([p[1] for p in prior], dtype="Float64"), "spend": arrived["spend"],
            "prior_spend": pd.array([p[2] for p in prior], dtype="Float64")})

    def close(self) -> None:
        pass


def _day(value) -> date:
    return value if type(value) is date else pd.Timestamp(value).date()


def _number(value) -> float | None:
    return None if pd.isna(value) else float(value)


def compare_with_previous(stream: DataFrame, horizon_days: int = HORIZON_DAYS, idle_ms: int | None = None) -> DataFrame:
    """Stream of campaign facts next to the campaign's previous period held in state; rows without a period are left out.

    State lives in RocksDB (the session is switched to it) and is bounded by ``horizon_days`` per
    campaign, counted back from its newest period; see ``PreviousPeriod``.
    """
    stream.sparkSession.conf.set(PROVIDER, ROCKSDB)
    dated = stream.where("period_date is not null").select(*KEYS, *PERIOD)
    return dated.groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=PreviousPeriod(horizon_days, idle_ms), outputStructType=OUTPUT, outputMode="Append",
        timeMode="ProcessingTime" if idle_ms else "None")
