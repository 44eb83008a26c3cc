"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "spendlens", **extra: str) -> SparkSession:
    """A session with adaptive execution on; sizes stay adjustable through ``extra``."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # call-site capture per column expression costs more than building the plans themselves
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        # small stages stay spread over the local cores instead of shrinking to one task
        builder = builder.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This run's own folder below the one that every executor can reach, ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own. The folder is
    removed when the program ends.
    """
    context = spark.sparkContext
    if context.applicationId not in _RUNS:
        configured = spark.conf.get(CHECKPOINT_KEY, None)
        if not configured:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
            configured = tempfile.mkdtemp(prefix="spendlens-")
        _RUNS[context.applicationId] = f"{configured.rstrip('/')}/spendlens-{context.applicationId}"
        atexit.register(remove_run_folder, spark, context.applicationId)
    return _RUNS[context.applicationId]


_RUNS: dict[str, str] = {}


def remove_run_folder(spark: SparkSession, run: str) -> None:
    """Delete what a run stored, through Spark's file system while the session lives, else as a local folder."""
    folder = _RUNS.pop(run, None)
    if folder is None:
        return
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    elif "://" not in folder or folder.startswith("file://"):
        shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and read it back.

    For results that several branches of a query need: they are computed once, later stages
    do not depend on earlier executors, and every branch reads only the columns it uses.
    """
    path = f"{shared_folder(df.sparkSession)}/stored/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
