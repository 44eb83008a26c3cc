"""Exports that keep arriving: clean, measure, check and store them as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spendlens import fixed_values as fx
from spendlens.operators import alerts, anomalies, cleaning, history, learning, metrics, reports
from spendlens.session import stored
from spendlens.sources.exports import FILE, ORDINAL

#: What a row was sent with: the name its file shares with the other parts of one export, and when it was written.
SENT_AS, SENT_AT = "sent_as", "sent_at"
ARRIVAL_COLUMNS = ["client_id", "upload_id", "period_start", "Campaign", "Impr.", "Clicks", "Cost (INR)", "Conv.", "Conv. value"]


def export_stream(spark: SparkSession, folder: str, columns: list[str] | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of CSV exports dropped into a folder, all cells as text, with the sending they belong to.

    Files of one sending share their name but for the number of the part (``part-00001-...``, as
    Spark writes them, or ``january_part2.csv``); any other file is a sending of its own.
    """
    schema = ", ".join(f"`{c}` string" for c in columns or ARRIVAL_COLUMNS)
    reader = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_trigger)
    name = F.regexp_replace(F.regexp_replace("_metadata.file_name", r"(?i)(^|[-_. ])part[-_]?\d+", "$1"), r"-c\d+\.", ".")
    return reader.csv(folder).select("*", name.alias(SENT_AS), F.col("_metadata.file_modification_time").alias(SENT_AT))


def with_ids(batch: DataFrame) -> DataFrame:
    """A micro-batch with its ids as numbers and, where they are none, the ``reason`` it cannot be used."""
    numbers = batch.withColumns({c: F.col(c).try_cast("long") for c in ("client_id", "upload_id")})
    return numbers.withColumn("reason", F.when(F.col("client_id").isNull(), "no client").when(F.col("upload_id").isNull(), "no upload"))


def conform_batch(batch: DataFrame, arrived_on: Column | None = None) -> DataFrame:
    """One micro-batch of search-ads exports as fact rows.

    An upload without a readable period counts for the day it arrived. Rows without ids are left
    to ``rejected_rows``.
    """
    for column, kind in ((SENT_AS, "string"), (SENT_AT, "timestamp")):
        if column not in batch.columns:
            batch = batch.withColumn(column, F.lit(None).cast(kind))
    keyed = with_ids(batch).where("reason is null").drop("reason").withColumn(FILE, F.col("upload_id").cast("string")).withColumn(
        ORDINAL, F.monotonically_increasing_id())
    rows = cleaning.clean_rows(cleaning.flagged_export(keyed, cleaning.GOOGLE, FILE, ORDINAL))
    keys = ["client_id", "upload_id", SENT_AS]
    periods = rows.groupBy(*keys).agg(F.max(F.col("period_start").try_cast("date")).alias("period_start")).toDF(
        "of_client", "of_upload", "of_sending", "period_start")
    same = (F.col("client_id") == F.col("of_client")) & (F.col("upload_id") == F.col("of_upload")) & F.col(SENT_AS).eqNullSafe(F.col("of_sending"))
    facts = metrics.canonical_google(rows).join(periods, same).drop("of_client", "of_upload", "of_sending")
    return facts.withColumn("period_date", F.coalesce("period_start", F.current_date() if arrived_on is None else arrived_on))


def rejected_rows(batch: DataFrame) -> DataFrame:
    """Rows of a micro-batch without client or upload, as they came, with the reason."""
    whole = with_ids(batch).where("reason is not null")
    return whole.select("reason", F.to_json(F.struct(*[F.col(f"`{c}`") for c in batch.columns if c not in (SENT_AS, SENT_AT)])).alias("row"))


def write_batch(df: DataFrame, folder: str, table: str, batch_id: int, by: str | None = None) -> None:
    """Store a batch under its own id; a repeated batch replaces itself instead of doubling rows.

    ``by`` names a column whose values get folders of their own, which later reads can skip.
    """
    writer = df.hint("rebalance", by).write.partitionBy(by) if by else df.write
    writer.mode("overwrite").parquet(f"{folder}/{table}/batch_id={batch_id}")


def stored_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}")


def stored_facts(spark: SparkSession, folder: str, clients: list[int] | None = None) -> DataFrame:
    """Facts of all batches, or only the folders of some clients."""
    found = spark.read.parquet(f"{folder}/campaigns")
    if SENT_AS not in found.columns:  # a file from before sendings were stored
        found = spark.read.option("mergeSchema", True).parquet(f"{folder}/campaigns")
    facts = spark.read.schema(found.schema).parquet(f"{folder}/campaigns").withColumn("client_id", F.col("client_id").cast("long"))
    return facts if clients is None else facts.where(F.col("client_id").isin(*clients))


def arrived_clients(batch: DataFrame) -> list[int]:
    """The clients of a micro-batch, to tell which folders its checks have to read."""
    return [r[0] for r in batch.select(F.col("client_id").cast("long")).where("client_id is not null").distinct().collect()]


def current_facts(spark: SparkSession, folder: str, clients: list[int] | None = None) -> DataFrame:
    """Stored facts in which a period that was sent again counts as sent last, of all or of some clients.

    A sending is an upload and the files it came in, in whichever micro-batches those were read.
    Uploads without a period give way only to a later sending of the same upload.
    """
    facts = stored_facts(spark, folder, clients)
    for column, kind in ((SENT_AS, "string"), (SENT_AT, "timestamp")):
        if column not in facts.columns:
            facts = facts.withColumn(column, F.lit(None).cast(kind))
    # facts without a sending were stored before sendings were: their batch stands for it
    named = facts.withColumn(SENT_AS, F.coalesce(SENT_AS, F.concat(F.lit("batch "), F.col("batch_id").cast("string"))))
    sending = ["client_id", "upload_id", SENT_AS]
    # files of a sending that were read in another batch may have had its period
    dated = named.groupBy(*sending).agg(F.max("period_start").alias("sent_period"), F.min("period_date").alias("sent_day"))
    named = named.join(dated, sending).withColumn("period_start", F.coalesce("period_start", "sent_period")).withColumn(
        "period_date", F.coalesce("period_start", "sent_day")).drop("sent_period", "sent_day")
    apart = named.withColumn("slot", F.when(F.col("period_start").isNull(), F.concat(F.lit("upload "), F.col("upload_id").cast("string"))).otherwise(
        F.col("period_date").cast("string")))
    keys = ["client_id", "platform", "slot"]
    sent = apart.groupBy(*keys, "upload_id", SENT_AS).agg(F.max(SENT_AT).alias("at"), F.max("batch_id").alias("batch"))
    newest = sent.groupBy(*keys).agg(F.max_by(F.struct("upload_id", SENT_AS), F.struct("at", "batch", "upload_id", SENT_AS)).alias("last")).select(
        *keys, "last.*")
    return apart.join(newest, [*keys, "upload_id", SENT_AS], "left_semi").drop("batch_id", "slot", SENT_AS, SENT_AT).select(
        [c for c in facts.columns if c not in ("batch_id", SENT_AS, SENT_AT)])


def arrival_pipeline(folder: str) -> Callable[[DataFrame, int], None]:
    """The work per micro-batch: conform and store facts, rejects and the benchmarks they change."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_batch(rejected_rows(batch), folder, "rejects", batch_id)
        clients = arrived_clients(with_ids(batch).where("reason is null"))
        if clients:  # a batch of rejects alone has no facts to store
            write_batch(conform_batch(batch), folder, "campaigns", batch_id, by="client_id")
            write_batch(learning.client_benchmarks(current_facts(spark, folder, clients)), folder, "benchmarks", batch_id)

    return run


def run_available(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything that has arrived, then stop."""
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def checks_pipeline(folder: str, clients: DataFrame, rules: DataFrame, known: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """Alerts and anomalies of the uploads in a batch of fact rows, against all stored history.

    ``known`` (``client_id``, ``upload_id``, ``period_date``) lists uploads that count in the order of
    a client's uploads even if they hold no facts; what follows such an upload has no prior.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        of_clients = arrived_clients(batch)
        theirs = current_facts(spark, folder, of_clients)
        arrived = batch.select("client_id", "upload_id").distinct()
        columns = ["client_id", "upload_id", "period_date"]
        uploads = theirs.select(*columns).distinct()
        if known is not None:  # uploads whose period was sent again have facts and stay out
            listed = known.where(F.col("client_id").isin(*of_clients)).select(*columns)
            with_facts = stored_facts(spark, folder, of_clients).select("client_id", "upload_id")
            uploads = uploads.unionByName(listed.join(with_facts, ["client_id", "upload_id"], "left_anti"))
        ranks = stored(history.rank_uploads(uploads).select("client_id", "upload_id", "upload_rank", "upload_count"))
        # only the arrived uploads and the history their checks look back on
        span = ranks.join(arrived, ["client_id", "upload_id"]).groupBy("client_id").agg(
            F.min("upload_rank").alias("first_rank"), F.max("upload_rank").alias("last_rank")
        )
        needed = ranks.join(span, "client_id").where(
            F.col("upload_rank").between(F.col("first_rank") - fx.SEASON_UPLOADS, F.col("last_rank"))
        ).select("client_id", "upload_id", "upload_rank", "upload_count")
        ranked = stored(theirs.join(needed, ["client_id", "upload_id"]))
        for table, rows in (
            ("kpi_alerts", alerts.kpi_alerts(ranked, clients, rules)),
            ("anomalies", anomalies.detect_anomalies(ranked, clients)),
        ):
            write_batch(rows.join(arrived, ["client_id", "upload_id"], "left_semi"), folder, table, batch_id)

    return run


def replace_period(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Facts after an upload is sent again: rows of the same client and period give way."""
    keys = ["client_id", "period_start"]
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def first_sends(uploads: DataFrame, event_time: str, delay: str = "7 days") -> DataFrame:
    """A stream of uploads without re-sends of the same client and period within the delay."""
    return uploads.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["client_id", "period_start", "period_end"])


def watch_brief(stream: DataFrame, read_anomalies: Callable[[], DataFrame], folder: str, checkpoint: str,
                interval: str = "300 seconds") -> StreamingQuery:
    """Refresh the morning brief at an interval while exports arrive."""

    def refresh(_: DataFrame, batch_id: int) -> None:
        write_batch(reports.morning_brief(read_anomalies()), folder, "briefs", batch_id)

    return (
        stream.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval).start()
    )
