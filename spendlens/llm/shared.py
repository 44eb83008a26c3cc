"""What the operators of this subpackage share: folders, files on shared storage, registration."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spendlens.session import shared_folder, stored

Job = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Job] = {}
SQL: dict[str, str] = {}

__all__ = ["QUERIES", "SQL", "in_parts", "named", "new_folder", "opened", "stored", "table"]


def named(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    """Register a query of this subpackage."""

    def keep(job: Job) -> Job:
        QUERIES[name] = job
        if sql:
            SQL[name] = sql
        return job

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most ``rows`` rows, so that few texts are Python strings at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own for one run below the shared folder of the cluster."""
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def opened(path: str):
    """File system and path within it, for files that tasks write and read on shared storage."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
