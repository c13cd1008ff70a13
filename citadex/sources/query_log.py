"""Log and vote tables, stored by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citadex.operators.analytics import to_feedback, to_query_log


def append_query_log(df: DataFrame, path: str) -> None:
    """Append questions to the log; rows of a day go to that day's folder from every task."""
    to_query_log(df).write.mode("append").partitionBy("dt").parquet(path)


def append_feedback(df: DataFrame, path: str) -> None:
    to_feedback(df).write.mode("append").parquet(path)


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """Log with numbers as doubles; a filter on `dt` prunes folders."""
    raw = spark.read.parquet(path)
    return raw.withColumns({
        c: F.col(c).cast("double") for c in ("intent_confidence", "confidence") if c in raw.columns
    })
