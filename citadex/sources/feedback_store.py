"""Votes as a stored table that is merged in place: one row per question and answer, by the whole text of both.

Rows lie in partitions by a hash of their key. A merge reads and rewrites only the partitions that its batch touches, each
as a whole, so a merge that is run again changes nothing; the rows of a batch meet those that are stored in a shuffle of
these partitions alone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citadex.operators.analytics import upsert_feedback
from citadex.session import broadcast_within, staged


def _part(n_parts: int) -> Column:
    return F.pmod(F.xxhash64("query", F.sha2("answer", 256)), F.lit(n_parts)).cast("int").alias("part")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException:
        return None


def _rewrite(rows: DataFrame, path: str, touched: list[int]) -> None:
    """Put `rows` (with `part`) in place of the touched partitions; those that are left empty go."""
    rows = staged(rows, "merged")  # what is overwritten is read by these rows
    rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    left = {r["part"] for r in rows.select("part").distinct().collect()}
    spark = rows.sparkSession
    for part in set(touched) - left:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def merge_feedback(new: DataFrame, path: str, n_parts: int = 64) -> None:
    """Add votes to the table under `path`; of several on one answer the last one stays.

    `n_parts` is that of the first merge into a path.
    """
    new = staged(new, "votes")
    batch = new.select("*", _part(n_parts))
    touched = [r["part"] for r in batch.select("part").distinct().collect()]  # at most `n_parts`
    old = _stored(new.sparkSession, path)
    old = new.limit(0) if old is None else old.where(F.col("part").isin(touched)).select(*new.columns)
    _rewrite(upsert_feedback(old, new).select("*", _part(n_parts)), path, touched)


def remove_feedback(ids: DataFrame, path: str) -> None:
    """Take votes out by `id`; only the partitions that hold one are rewritten."""
    held = _stored(ids.sparkSession, path)
    if held is None:
        return
    gone = ids.select("id").distinct()
    gone = broadcast_within(gone, 96 * gone.count())
    touched = [r["part"] for r in held.join(gone, "id", "left_semi").select("part").distinct().collect()]
    if touched:
        _rewrite(held.where(F.col("part").isin(touched)).join(gone, "id", "left_anti").select(*held.columns), path, touched)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The votes as they are now; a missing table raises an error that names the path."""
    held = _stored(spark, path)
    if held is None:
        raise FileNotFoundError(f"no votes at {path}: merge some first")
    return held.drop("part")
