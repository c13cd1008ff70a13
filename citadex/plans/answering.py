"""A batch of questions, from text to cited answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadex.functions import hooks
from citadex.operators import fusion as fu
from citadex.operators import reuse as ru
from citadex.operators import understanding as un
from citadex.operators.dense import dense_search
from citadex.operators.lexical import LexicalIndex, bm25_search
from citadex.operators.response import respond
from citadex.session import broadcast_within, measured_bytes, staged
from citadex.settings import AnswerOptions


def understand(queries: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Intent columns, and with a glossary the augmented question and the definition to lead with."""
    out = un.classify_intent(queries)
    if glossary is None:
        return out.withColumn("augmented_query", F.col("query"))
    return un.augment_queries(out, un.glossary_hits(queries, glossary))


def retrieve(
    questions: DataFrame,
    nodes: DataFrame,
    index: LexicalIndex,
    vectors: DataFrame,
    options: AnswerOptions = AnswerOptions(),
    encoder: hooks.Encoder | None = None,
    scorer: hooks.PairScorer | None = hooks.term_coverage,
    evaluations: DataFrame | None = None,
    exclude_self: bool = False,
) -> DataFrame:
    """Context window per question: query_id, rank, score, variant_ix and the node's columns.

    All wordings of all questions are searched in one job. Without an encoder the questions carry
    their own `embedding`, which then serves every wording and is searched once per question; one that is null leaves
    the question to BM25. Filters apply before the search, or (`filter_mode`) to ever longer lists after it. Lists
    of `4 * top_k` are fetched, `2 * top_k` survive the re-ranking and `top_k` per wording go on.
    Columns `top_k` and `alpha` of the questions, where they are set, win over the options.
    """
    keys = ("query_id", "variant_ix")
    per_question = [c for c in ("top_k", "alpha") if c in questions.columns]
    most = options.top_k
    if "top_k" in per_question:
        most = max(most, questions.agg(F.max("top_k")).first()[0] or 0)
    n_rows = questions.count() * options.max_variations  # bounds what may be broadcast below
    own = questions.select(
        "query_id", *[F.coalesce(F.col(c), F.lit(getattr(options, c))).alias(f"_{c}") for c in per_question]
    )
    k = F.col("_top_k") if "top_k" in per_question else F.lit(options.top_k)
    alpha = F.col("_alpha") if "alpha" in per_question else F.lit(options.alpha)

    def with_options(rows: DataFrame) -> DataFrame:
        return rows.join(broadcast_within(own, n_rows * 32), "query_id") if per_question else rows

    worded = un.rewrite_queries(questions, options.max_variations, "augmented_query")
    after = fu.filter_meta(nodes, options.metadata_filters).select("node_id") if options.metadata_filters and options.filter_mode != "pre" else None
    if options.metadata_filters and options.filter_mode == "pre":
        allowed = fu.filter_meta(nodes, options.metadata_filters).select("node_id")
        vectors = vectors.join(allowed, "node_id", "left_semi")
        index = index.restricted(allowed)
    n_bytes = measured_bytes(worded, *keys, "variant")

    def listed(asked: DataFrame, search: Callable[[DataFrame, int], DataFrame], of: tuple[str, ...]) -> DataFrame:
        """The best `4 * most` hits; with a filter after the search, of those that match."""
        return search(asked, 4 * most) if after is None else fu.matching_hits(asked, search, after, 4 * most, of)

    sparse = listed(worded, lambda q, n: bm25_search(q, index, n, keys, text="variant", n_bytes=n_bytes), keys)
    sparse = with_options(sparse).where(F.col("rank") <= 4 * k)
    if encoder is None:
        near = listed(questions, lambda q, n: dense_search(q, vectors, n, exclude_self=exclude_self), ("query_id",))
        dense = worded.select(*keys).join(near, "query_id")
    else:
        encoded = worded.withColumn("embedding", encoder(F.col("variant")))
        dense = listed(encoded, lambda q, n: dense_search(q, vectors, n, keys), keys)
    dense = with_options(dense).where(F.col("rank") <= 4 * k)
    hits = with_options(fu.fuse(dense, sparse, keys=keys))
    hits = hits.withColumn("score", fu.weighted(alpha))
    narrow = nodes.select("node_id", *options.metadata_filters)
    rows = fu.filter_meta(fu.attach_nodes(hits, narrow, 8 * most * n_rows), options.metadata_filters)
    rows = fu.ranked(rows, keys).where(F.col("rank") <= 4 * k)
    if scorer is not None:
        asked = broadcast_within(worded.select(*keys, F.col("variant").alias("query")), n_bytes)
        pairs = fu.attach_nodes(rows, nodes.select("node_id", "text"), 4 * most * n_rows).join(asked, list(keys))
        rows = fu.rerank(pairs, None, scorer, keys)
    rows = rows.where(F.col("rank") <= 2 * k)
    if evaluations is not None:
        rows = fu.blend_scores(
            rows, evaluations, options.min_evaluation_confidence, options.max_evaluated, keys
        )
    found = with_options(fu.dedupe_hits(rows.where(F.col("rank") <= k)))
    kept = fu.dynamic_window(found, k) if options.dynamic_windowing else found.where(F.col("rank") <= k)
    return fu.attach_nodes(kept.drop("_top_k", "_alpha"), nodes, 2 * most * n_rows)


def answer_queries(
    queries: DataFrame,
    nodes: DataFrame,
    index: LexicalIndex,
    vectors: DataFrame,
    options: AnswerOptions = AnswerOptions(),
    glossary: DataFrame | None = None,
    **hooks_and_tables,
) -> DataFrame:
    """One structured response per question."""
    questions = staged(understand(queries, glossary), "questions")
    context = staged(retrieve(questions, nodes, index, vectors, options, **hooks_and_tables), "context")
    out = respond(context, questions.select("query_id", "query", "intent_type", "intent_confidence", "keywords"))
    if glossary is None:
        return out
    lead = questions.where("glossary_definition IS NOT NULL").select("query_id", "glossary_definition")
    return out.join(lead, "query_id", "left").withColumn(
        "answer",
        F.concat(F.coalesce(F.concat(F.lit("Definition: "), "glossary_definition", F.lit("\n\n")), F.lit("")), "answer"),
    ).drop("glossary_definition")


def route_queries(
    queries: DataFrame, cache: DataFrame, validated: DataFrame, glossary: DataFrame | None = None, threshold: float = 0.90
) -> DataFrame:
    """`route` per question; only the rows marked `retrieve` need `answer_queries`."""
    typed = un.classify_intent(queries)
    exact = ru.exact_reuse(queries, cache).where("response IS NOT NULL")
    semantic = ru.semantic_reuse(queries, cache.where("response IS NOT NULL"), threshold)  # what has an answer
    known = ru.validated_reuse(queries, validated).where("answer_text IS NOT NULL")
    if glossary is None:
        defined = queries.limit(0)
    else:
        defined = ru.definition_answers(typed, un.glossary_hits(queries, glossary, 3))
    return ru.route(typed, exact, semantic, known, defined)


SERVED = {
    "answer": "string", "reasoning": "string", "confidence": "double",
    "sources": "array<struct<id:string,name:string,pages:string,content_type:string>>",
}


def served(
    routed: DataFrame, exact: DataFrame, semantic: DataFrame, validated: DataFrame, defined: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """One response per routed question: query_id, route, answer, reasoning, confidence, sources.

    Each table after the first holds the answers of one route by query_id (columns it lacks are null in the response).
    Only the questions that no table can answer go through `answer`, for example `answer_queries` with its options.
    Routes are decided once and stored, so nothing is searched again for a question that is answered already.
    """
    decided = staged(routed, "routes")
    left = decided.where("route = 'retrieve'").drop("route")
    out = None
    for name, found in (("exact", exact), ("semantic", semantic), ("validated", validated), ("glossary", defined), ("retrieve", answer(left))):
        ids = decided.where(F.col("route") == name).select("query_id", "route")
        own = found.select("query_id", *[(F.col(c) if c in found.columns else F.lit(None)).cast(kind).alias(c) for c, kind in SERVED.items()])
        part = ids.join(own, "query_id", "left")
        out = part if out is None else out.unionByName(part)
    return out
