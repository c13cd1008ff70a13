"""Re-use of answers: caches and validated answers as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadex.functions import text as tx
from citadex.operators.dense import dense_search
from citadex.operators.vector_index import VectorIndex, vector_search
from citadex.settings import GLOSSARY_CONFIDENCE, GLOSSARY_REASONING, VALIDATED_CONFIDENCE, VALIDATED_REASONING


def with_cache_key(df: DataFrame, query: str = "query") -> DataFrame:
    return df.withColumn("key", tx.cache_key(F.col(query), F.col("top_k"), F.col("alpha")))


def exact_reuse(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached response for the same question and options; null when there is none.

    Keys are unique in the cache. A question asked by a third of all rows makes a skewed question
    side, which the adaptive skew join splits; a small cache is broadcast by the planner.
    """
    return with_cache_key(queries).join(cache.select("key", "response"), "key", "left")


def semantic_reuse(
    queries: DataFrame, cache: DataFrame | None, threshold: float = 0.90, exclude_self: bool = False, index: VectorIndex | None = None
) -> DataFrame:
    """The closest cached question, when its cosine reaches the threshold; the cache as a table or as a stored index."""
    if index is not None:
        found = vector_search(queries, index, 1, exclude_self=exclude_self, floor=threshold)
        return found.select("query_id", F.col("node_id").alias("entry_id"), "score")
    vectors = cache.select(F.col("entry_id").alias("node_id"), "embedding")
    best = dense_search(queries, vectors, 1, exclude_self=exclude_self)
    return best.where(F.col("score") >= threshold).select("query_id", F.col("node_id").alias("entry_id"), "score")


def retain(cache: DataFrame, n: int) -> DataFrame:
    """The newest `n` entries."""
    return cache.orderBy(F.col("inserted_at").desc(), F.col("key")).limit(n)


def invalidate(cache: DataFrame, bad: DataFrame, on: str = "key") -> DataFrame:
    return cache.join(bad.select(on).distinct(), on, "left_anti")


def vote_counts(feedback: DataFrame) -> DataFrame:
    """Votes of one batch per question id. Needs no log, so votes may come before the question they are for."""
    helpful = F.col("is_helpful")
    return feedback.groupBy("query_id").agg(
        F.count_if(helpful).alias("helpful"), F.count_if(~helpful).alias("unhelpful"),
        F.min(F.when(helpful, F.col("ts"))).alias("first_vote"), F.max(F.when(helpful, F.col("ts"))).alias("last_vote"),
    )


def merge_votes(counts: DataFrame) -> DataFrame:
    """Counts of any number of batches added up, in any order."""
    return counts.groupBy("query_id").agg(
        F.sum("helpful").alias("helpful"), F.sum("unhelpful").alias("unhelpful"), F.min("first_vote").alias("first_vote"),
        F.max("last_vote").alias("last_vote"),
    )


def validated_partials(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """Votes of one batch per question text, in a form that further batches can be added to."""
    return partials_of(log, vote_counts(feedback))


def partials_of(log: DataFrame, votes: DataFrame) -> DataFrame:
    """The same from counted votes: an answer with a third of all votes is one row before the join."""
    voted = log.select("query_id", "query_text", "answer_text", "sources").join(votes, "query_id")
    order = F.when(F.col("helpful") > 0, F.struct("first_vote", "query_id"))
    return voted.groupBy(tx.question_hash(F.col("query_text")).alias("query_hash")).agg(
        F.min_by(F.struct("query_text", "answer_text", "sources"), order).alias("first_answer"), F.min(order).alias("first_at"),
        F.sum("helpful").alias("helpful_count"), F.sum("unhelpful").alias("unhelpful_count"), F.max("last_vote").alias("last_used"),
    )


def merge_validated(partials: DataFrame) -> DataFrame:
    """Validated answers from the partials of any number of batches, in any order."""
    return (
        partials.groupBy("query_hash").agg(
            F.min_by("first_answer", "first_at").alias("_first"), F.sum("helpful_count").alias("helpful_count"),
            F.sum("unhelpful_count").alias("unhelpful_count"), F.min("first_at")["first_vote"].alias("first_validated"),
            F.max("last_used").alias("last_used"),
        )
        .where("helpful_count > 0")
        .select(
            "query_hash", "_first.*", "helpful_count", "unhelpful_count", "first_validated", "last_used", F.lit(True).alias("is_active")
        )
    )


def build_validated(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """Answers with helpful votes: the first voted answer stays, votes are counted."""
    return merge_validated(validated_partials(log, feedback))


def validated_reuse(queries: DataFrame, validated: DataFrame, min_votes: int = 2) -> DataFrame:
    """Validated answer with enough votes; null when there is none."""
    usable = validated.where(F.col("is_active") & (F.col("helpful_count") >= min_votes))
    numbered = F.transform(
        "sources",
        lambda s, i: F.struct(
            F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]")).alias("id"), s.alias("name"),
            F.lit("N/A").alias("pages"), F.lit("text").alias("content_type"),
        ),
    )
    served = usable.select(
        "query_hash", "answer_text", "helpful_count", numbered.alias("sources"),
        F.lit(VALIDATED_CONFIDENCE).alias("confidence"), F.lit(VALIDATED_REASONING).alias("reasoning"),
    )
    return queries.withColumn("query_hash", tx.question_hash(F.col("query"))).join(served, "query_hash", "left")


def definition_answers(queries: DataFrame, hits: DataFrame, k: int = 3, min_score: float = 0.0) -> DataFrame:
    """Definition questions answered with the texts of their best glossary entries."""
    line = F.concat_ws(": ", "term", "definition")
    texts = (
        hits.where((F.col("rank") <= k) & (F.col("score") >= min_score)).groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("t"))))["t"].alias("_t"))
    )
    return queries.where("intent_type = 'definition'").join(texts, "query_id").select(
        "query_id", F.array_join("_t", "\n").alias("answer"), F.lit("[G]").alias("source_id"),
        F.lit("Glossary").alias("source_name"), F.lit(GLOSSARY_CONFIDENCE).alias("confidence"),
        F.lit(GLOSSARY_REASONING).alias("reasoning"),
    )


def route(
    queries: DataFrame, exact: DataFrame, semantic: DataFrame, validated: DataFrame, defined: DataFrame
) -> DataFrame:
    """First source that can answer: exact, semantic, validated, glossary, else retrieve.

    Each argument after the first is a table of the query ids that source can answer.
    """
    out = queries
    for name, found in (("exact", exact), ("semantic", semantic), ("validated", validated), ("glossary", defined)):
        out = out.join(found.select("query_id").distinct().withColumn(f"_{name}", F.lit(True)), "query_id", "left")
    path = F.lit("retrieve")
    for name in ("glossary", "validated", "semantic", "exact"):
        path = F.when(F.col(f"_{name}"), F.lit(name)).otherwise(path)
    return out.withColumn("route", path).drop("_exact", "_semantic", "_validated", "_glossary")


def cache_stats(routed: DataFrame, cache: DataFrame) -> DataFrame:
    """Hits, misses and hit rate of a routed batch, and the size of the cache."""
    served = F.col("route").isin("exact", "semantic")
    size = cache.agg(F.count("*").alias("n")).scalar()
    return routed.agg(
        F.count_if(served).alias("hits"), F.count_if(~served).alias("misses"), F.count("*").alias("total")
    ).select(
        "hits", "misses", "total", F.coalesce(F.round(F.try_divide("hits", "total"), 6), F.lit(0.0)).alias("hit_rate"),
        size.alias("size"),
    )


def evaluation_keys(hits: DataFrame) -> DataFrame:
    """Key of a model's verdict on a (question, chunk)."""
    return hits.withColumn(
        "eval_key", F.concat_ws("_", F.md5("query"), F.md5("text"))
    )


def answer_keys(context: DataFrame, queries: DataFrame) -> DataFrame:
    """Key of a generated answer: the question and the whole texts of all its chunks, in order."""
    docs = context.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.md5("text").alias("h"))))["h"].alias("_h")
    )
    none = F.array().cast("array<string>")
    return queries.select("query_id", "query").join(docs, "query_id", "left").select(
        "query_id",
        F.concat(
            F.lit("answer_"), F.md5("query"), F.lit("_"), F.md5(F.array_join(F.coalesce("_h", none), ""))
        ).alias("answer_key"),
    )
