"""Streaming forms of the log, vote and index operators.

Every job runs with `availableNow`: it works off what has arrived and stops, so the same code serves
scheduled catch-up runs and, with another trigger, a continuous one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citadex.operators.analytics import day_rollup, to_query_log
from citadex.operators.reuse import merge_validated, merge_votes, partials_of, vote_counts
from citadex.sources.index_store import append_nodes


def follow(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, **options: str) -> DataFrame:
    """Rows of the parquet files under `path`, as they arrive."""
    reader = spark.readStream.schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_event_time(stream: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Event time as a zoned timestamp (watermarks refuse others), with the lateness allowed."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def deduplicated(stream: DataFrame, delay: str) -> DataFrame:
    """Questions that are sent again within the watermark are dropped."""
    return with_event_time(stream, delay).dropDuplicatesWithinWatermark(["query_id"])


def _metrics(grouped) -> DataFrame:
    return grouped.agg(
        F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"),
        F.avg("response_time_ms").alias("avg_response_time_ms"),
    ).select(F.col("window.start").alias("start"), "intent_type", "n", "avg_confidence", "avg_response_time_ms")


def daily_metrics(stream: DataFrame, delay: str) -> DataFrame:
    return _metrics(with_event_time(stream, delay).groupBy(F.window("ts", "1 day"), "intent_type"))


def sliding_metrics(stream: DataFrame, delay: str, days: int = 7) -> DataFrame:
    return _metrics(with_event_time(stream, delay).groupBy(F.window("ts", f"{days} days", "1 day"), "intent_type"))


def sessions(stream: DataFrame, delay: str, gap: str = "24 hours") -> DataFrame:
    """Runs of questions of a user without a pause of `gap`; complete once the watermark is past them."""
    timed = with_event_time(stream, delay)
    return timed.groupBy(F.session_window("ts", gap), "user").agg(F.count("*").alias("n_queries")).select(
        "user", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_queries"
    )


def append_to(stream: DataFrame, path: str, state: str, *partition_by: str) -> StreamingQuery:
    """Write finished rows to a parquet table."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
    return writer.partitionBy(*partition_by).trigger(availableNow=True).start(path)


def ingest_log(stream: DataFrame, path: str, state: str, delay: str) -> StreamingQuery:
    """Questions into the log table, by day and without duplicates."""
    return append_to(to_query_log(deduplicated(stream, delay)), path, state, "dt")


def collect_votes(votes: DataFrame, path: str, state: str) -> StreamingQuery:
    """Votes into the counts that `read_validated` merges.

    A batch is reduced to one row per question id before it is written under its own number, so a batch that is run
    again replaces itself. No batch reads the log: votes wait here until their question has arrived.
    """

    def write(batch: DataFrame, number: int) -> None:
        vote_counts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return votes.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def read_validated(spark: SparkSession, path: str, log: DataFrame) -> DataFrame:
    """Validated answers from all votes so far and the log as it is now."""
    return merge_validated(partials_of(log, merge_votes(spark.read.parquet(path).drop("batch"))))


def roll_up(log: DataFrame, path: str, state: str) -> StreamingQuery:
    """Questions into sums by day and intent; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        day_rollup(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Sums of all batches so far; several rows of a day and intent add up wherever they are used."""
    return spark.read.parquet(path).drop("batch")


def grow_index(nodes: DataFrame, path: str, state: str) -> StreamingQuery:
    """New nodes into a persisted index.

    A batch is a segment under its own number, so that one that is run again replaces itself. A node that another
    segment holds is skipped; the filters of the segments tell, so no batch reads what is stored.
    """

    def write(batch: DataFrame, number: int) -> None:
        append_nodes(batch, path, name=f"batch-{number}")

    return nodes.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
