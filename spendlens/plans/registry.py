"""Collects the registered queries of all plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from spendlens.plans.views_sql import with_views

Job = Callable[[SparkSession, str], DataFrame]
MODULES = ["performance", "dashboards", "signals", "forecasts", "health", "planning", "state",
           "conforming", "enrichment", "reports_text", "arrivals", "tables"]


@dataclass(frozen=True)
class Query:
    run: Job
    sql: str | None


REGISTERED: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: bool = True) -> Callable[[Job], Job]:
    """Register a job under ``name``; ``sql`` states its expected result."""

    def keep(job: Job) -> Job:
        if name in REGISTERED:
            raise ValueError(f"query {name} registered twice")
        REGISTERED[name] = Query(job, with_views(sql) if sql and views else sql)
        return job

    return keep


def load() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"spendlens.plans.{module}")
    return REGISTERED
