"""Quality figures of retrieval, intent rules and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadex.operators.response import check_citations


def precision_at_k(hits: DataFrame, judgements: DataFrame, k: int) -> DataFrame:
    """Share of the first `k` hits that are judged relevant, per question."""
    marked = hits.where(F.col("rank") <= k).join(
        judgements.select("query_id", "node_id", F.lit(1).alias("_ok")).distinct(), ["query_id", "node_id"], "left"
    )
    return marked.groupBy("query_id").agg(
        F.sum(F.coalesce("_ok", F.lit(0))).alias("n_relevant"),
        F.round(F.sum(F.coalesce("_ok", F.lit(0))) / F.lit(k), 6).alias("precision"),
    )


def intent_confusion(df: DataFrame) -> DataFrame:
    """Counts of expected against predicted intent, and the share of each expected intent."""
    cells = df.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    totals = df.groupBy("expected").agg(F.count("*").alias("_all"))
    return cells.join(totals, "expected").select(
        "expected", "predicted", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share")
    )


def intent_accuracy(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("expected") == F.col("predicted")).cast("int")), 6).alias("accuracy")
    )


def grounding_rate(answers: DataFrame) -> DataFrame:
    """Share of answers that cite at least once and cite nothing out of range."""
    checked = check_citations(answers)
    sound = (F.col("n_citations") > 0) & (F.col("n_citations") == F.col("n_valid"))
    return checked.agg(
        F.count("*").alias("n_answers"), F.round(F.avg(sound.cast("int")), 6).alias("grounded_share")
    )
