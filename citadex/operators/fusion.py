"""From ranked lists to one context window per question."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citadex.functions import hooks
from citadex.functions import scoring as sc
from citadex.session import broadcast_within, staged

KEY = ("query_id",)


def ranked(hits: DataFrame, keys: Sequence[str] = KEY, score: str = "score") -> DataFrame:
    """`rank` from 1 by falling score; equal scores go by node id."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col("node_id"))
    return hits.withColumn("rank", F.row_number().over(order))


def top_k(hits: DataFrame, k: int, keys: Sequence[str] = KEY, score: str = "score") -> DataFrame:
    return ranked(hits, keys, score).where(F.col("rank") <= k)


def normalise(hits: DataFrame, keys: Sequence[str] = KEY, into: str = "score") -> DataFrame:
    """Scores over the maximum of their question; 0 unless that maximum is positive."""
    best = F.max("score").over(Window.partitionBy(*keys))
    return hits.withColumn(into, F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0)))


def weighted(alpha: float | Column) -> Column:
    """Score of a fused row: `alpha` for the dense side, the rest for BM25."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(alpha)
    return sc.rounded(alpha * F.col("dense") + (1 - alpha) * F.col("bm25"))


def fuse(dense: DataFrame, bm25: DataFrame, alpha: float = 0.5, keys: Sequence[str] = KEY) -> DataFrame:
    """Weighted sum of both normalised lists over the union of their nodes; a missing side counts 0.

    Both lists are stacked and hashed by question once. Maxima, the pairing of nodes and any later
    ranking by question all work inside that partitioning, where a full outer join would need two
    more shuffles.
    """
    none = F.lit(None).cast("double")
    stacked = dense.select(*keys, "node_id", F.col("score").alias("dense"), none.alias("bm25")).unionByName(
        bm25.select(*keys, "node_id", none.alias("dense"), F.col("score").alias("bm25"))
    ).repartition(*keys)
    for side in ("dense", "bm25"):
        best = F.max(side).over(Window.partitionBy(*keys))
        stacked = stacked.withColumn(side, F.when(best > 0, F.col(side) / best))
    zero = F.lit(0.0)
    both = stacked.groupBy(*keys, "node_id").agg(
        F.coalesce(F.max("dense"), zero).alias("dense"), F.coalesce(F.max("bm25"), zero).alias("bm25")
    )
    return both.withColumn("score", weighted(alpha))


def filter_meta(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Rows that equal every given value; before retrieval it reaches the scan, after it the hits."""
    for name, value in filters.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def filter_content(df: DataFrame, types: Sequence[str] | None = None, always_text: bool = False) -> DataFrame:
    """Rows of the listed content types; with `always_text`, text passes as well."""
    if not types:
        return df
    kind = F.coalesce("content_type", F.lit("text"))
    return df.where(kind.isin(*types) | (kind == "text")) if always_text else df.where(kind.isin(*types))


def attach_nodes(hits: DataFrame, nodes: DataFrame, max_hits: int | None = None) -> DataFrame:
    """Node columns for the hits. With a bound on the number of hits, they are broadcast and the texts stay put."""
    return nodes.join(broadcast_within(hits, None if max_hits is None else max_hits * 96), "node_id")


def matching_hits(
    questions: DataFrame, search: Callable[[DataFrame, int], DataFrame], allowed: DataFrame, k: int, keys: Sequence[str] = KEY, start: int | None = None
) -> DataFrame:
    """The `k` best hits per question whose node is in `allowed`, from a search that knows no filter.

    `search(questions, depth)` gives ranked lists. A list is long enough once it holds `k` matching hits, or fewer than
    `depth` in all; only questions whose list is not go into the next round, with four times the depth. Questions left
    are told from counts, so nothing but the number of rounds reaches the driver.
    """
    keys, depth, left, found = list(keys), start or 4 * k, questions, None
    while True:
        hits = staged(search(left, depth).select(*keys, "node_id", "score"), "hits")
        match = staged(hits.join(allowed.select("node_id"), "node_id", "left_semi"), "matches")
        counts = hits.groupBy(*keys).agg(F.count("*").alias("_n")).join(match.groupBy(*keys).agg(F.count("*").alias("_fit")), keys, "left")
        short = staged(counts.where((F.col("_n") >= depth) & (F.coalesce("_fit", F.lit(0)) < k)).select(*keys), "short")
        whole = match.join(short, keys, "left_anti")
        found = whole if found is None else found.unionByName(whole)
        if short.isEmpty():
            return top_k(found, k, keys)
        left, depth = left.join(short, keys, "left_semi"), 4 * depth


def rerank(
    candidates: DataFrame,
    limit: int | None = None,
    scorer: hooks.PairScorer = hooks.term_coverage,
    keys: Sequence[str] = KEY,
) -> DataFrame:
    """Replace the score of (query, text) rows by the scorer's, when a question has several rows.

    The fused score stays in `fused`; `limit` keeps that many best rows by the fused score first.
    Pairs are scored where they are, and both texts are dropped before the rows are shuffled.
    """
    if limit is not None:
        candidates = candidates.where(F.col("rank") <= limit)
    several = F.count("*").over(Window.partitionBy(*keys)) > 1
    pair = sc.rounded(scorer(F.col("query"), F.col("text")).cast("double"))
    fresh = candidates.withColumn("_pair", pair).drop("query", "text")
    return ranked(
        fresh.withColumnRenamed("score", "fused")
        .withColumn("score", F.when(several, F.col("_pair")).otherwise(F.col("fused")))
        .drop("_pair", "rank"),
        keys,
    )


def blend_scores(
    hits: DataFrame, evaluations: DataFrame, min_confidence: float = 0.7, max_evaluated: int = 3, keys: Sequence[str] = KEY
) -> DataFrame:
    """Mix in a model's relevance for the first few hits it is confident about; other rows keep theirs."""
    judged = evaluations.select(*keys, "node_id", "relevance_score", "confidence")
    use = (F.col("rank") <= max_evaluated) & (F.col("confidence") > min_confidence)
    mixed = sc.rounded(0.8 * F.col("score") + 0.2 * F.col("relevance_score"))
    out = hits.join(judged, [*keys, "node_id"], "left").withColumn(
        "score", F.when(use, mixed).otherwise(F.col("score"))
    )
    return ranked(out.drop("relevance_score", "confidence", "rank"), keys)


def dedupe_hits(hits: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per node over all wordings: the best score, and the first wording that found it."""
    best = hits.groupBy(*keys, "node_id").agg(
        F.max("score").alias("score"), F.min("variant_ix").alias("variant_ix")
    )
    return ranked(best, keys)


def dynamic_window(hits: DataFrame, k: int | Column, keys: Sequence[str] = KEY) -> DataFrame:
    """Hits not half a deviation below the mean, at least `k` and at most `2k`, per question."""
    all_rows = Window.partitionBy(*keys)
    floor = sc.rounded(F.avg("score").over(all_rows) - 0.5 * F.stddev_pop("score").over(all_rows))
    out = ranked(hits.drop("rank"), keys).withColumn("_floor", floor)
    return out.where(((F.col("score") >= F.col("_floor")) | (F.col("rank") <= k)) & (F.col("rank") <= 2 * k)).drop("_floor")
