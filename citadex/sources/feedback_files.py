"""Flat feedback files and the move into log and vote tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citadex.schemas import FLAT_FEEDBACK

EXPORT_COLUMNS = (
    "timestamp", "user", "query", "answer", "is_helpful", "confidence", "intent_type", "sources",
)


def read_feedback_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Arrays of objects need `multi_line`; large exports should be one object per line, which splits."""
    return spark.read.schema(FLAT_FEEDBACK).json(path, multiLine=multi_line)


def feedback_export_rows(df: DataFrame) -> DataFrame:
    """Fixed column order, sources joined, missing values as empty text."""
    sources = F.concat_ws(", ", "sources").alias("sources")
    return df.select(*[
        sources if c == "sources" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EXPORT_COLUMNS
    ])


def export_feedback(df: DataFrame, path: str) -> None:
    feedback_export_rows(df).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def _with_defaults(df: DataFrame, missing_timestamp: str | None) -> DataFrame:
    """Rows without a timestamp have no id of their own: they take the given one, or stay behind as errors."""
    if missing_timestamp is None:
        df = df.where("timestamp IS NOT NULL")
    else:
        df = df.withColumn("timestamp", F.coalesce("timestamp", F.lit(missing_timestamp)))
    user = F.coalesce("user", F.lit("Unknown"))
    return df.select(
        F.concat_ws("_", user, "timestamp").alias("query_id"), user.alias("user"),
        F.coalesce("query", F.lit("")).alias("query_text"), F.coalesce("answer", F.lit("")).alias("answer_text"),
        F.coalesce("is_helpful", F.lit(False)).alias("is_helpful"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("intent_type", F.lit("unknown")).alias("intent_type"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), "timestamp",
    )


def migrate_log(df: DataFrame, missing_timestamp: str | None = None) -> DataFrame:
    """Log rows out of flat feedback, with stand-ins for what the old format lacks."""
    return _with_defaults(df, missing_timestamp).select(
        "query_id", "user", "query_text", "answer_text", "intent_type", F.lit(0.8).alias("intent_confidence"), "sources",
        "confidence", F.lit(0).cast("long").alias("response_time_ms"), F.lit("migrated").alias("session_id"), "timestamp",
    )


def migration_errors(df: DataFrame) -> DataFrame:
    """Rows that cannot be moved without a timestamp to stand in."""
    return df.where("timestamp IS NULL")


def migrate_feedback(df: DataFrame, missing_timestamp: str | None = None) -> DataFrame:
    """Vote rows out of flat feedback."""
    return _with_defaults(df, missing_timestamp).select("query_id", "user", "is_helpful", F.lit("").alias("feedback_text"), "timestamp")


def migration_counts(df: DataFrame) -> DataFrame:
    """Rows that can be moved, and rows without the fields an id needs."""
    return df.agg(
        F.count_if(F.col("timestamp").isNotNull()).alias("migrated"), F.count_if(F.col("timestamp").isNull()).alias("errors")
    )
