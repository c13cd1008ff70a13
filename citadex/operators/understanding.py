"""Question understanding: projections over a table of questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citadex.functions import text as tx
from citadex.operators.lexical import search_once
from citadex.schemas import INTENT_JSON
from citadex.session import broadcast_within
from citadex.settings import (
    ACRONYMS, DEFAULT_GUIDANCE, DEFAULT_INTENT, INTENT_GUIDANCE, INTENT_RULES, INTENT_TYPES,
    PARSED_INTENT_CONFIDENCE, TYPOS,
)

Rules = Sequence[tuple[Sequence[str], str, float]]


def classify_intent(df: DataFrame, rules: Rules = INTENT_RULES, query: str = "query") -> DataFrame:
    """Rules in order, first match wins; adds the intent columns."""
    lowered = F.lower(query)
    intent, confidence = F.lit(DEFAULT_INTENT[0]), F.lit(DEFAULT_INTENT[1])
    for needles, name, score in reversed(rules):
        hit = tx.contains_any(lowered, needles)
        intent = F.when(hit, F.lit(name)).otherwise(intent)
        confidence = F.when(hit, F.lit(score)).otherwise(confidence)
    return (
        df.withColumns({
            "intent_type": intent,
            "intent_confidence": confidence,
            "keywords": tx.keywords(F.col(query)),
        })
        .withColumn(
            "requires_subqueries",
            F.col("intent_type").isin("comparison", "reasoning") | (F.size("keywords") > 5),
        )
        .withColumn("temporal_context", F.lit(None).cast("string"))
    )


def variations(
    query: Column, intent: Column, typos: Mapping[str, str] = TYPOS, acronyms: Mapping[str, str] = ACRONYMS
) -> Column:
    """Distinct wordings of a question in a fixed order: as asked, cleaned, then by intent."""
    said = lambda before, after="": F.concat(F.lit(before), query, F.lit(after))
    trouble, define, compare = (intent == k for k in ("troubleshooting", "definition", "comparison"))
    return F.array_distinct(F.array_compact(F.array(
        query,
        tx.expand_acronyms(tx.clean(query, typos), acronyms),
        F.when(trouble, said("error ")), F.when(trouble, said("fix ")), F.when(trouble, said("solve ")),
        F.when(define, said("what is ")), F.when(define, said("", " definition")),
        F.when(compare, said("", " differences")), F.when(compare, said("compare ")),
    )))


def rewrite_queries(df: DataFrame, limit: int = 3, query: str = "query", intent: str = "intent_type") -> DataFrame:
    """One row per wording: `variant_ix` from 0 and `variant`."""
    kept = F.slice(variations(F.col(query), F.col(intent)), 1, limit)
    return df.select("*", F.posexplode(kept).alias("variant_ix", "variant"))


def _option(parts: Column, prefix: str, pattern: str) -> tuple[Column, Column]:
    """Position (from 1, 0 if absent) and text of the first token `prefix<number>`."""
    value = lambda t: F.get(F.split(t, ":"), F.lit(1))
    usable = F.transform(parts, lambda t: t.startswith(prefix) & F.coalesce(value(t).rlike(pattern), F.lit(False)))
    at = F.array_position(usable, F.lit(True))
    return at, F.when(at > 0, value(F.element_at(parts, F.greatest(at, F.lit(1)).cast("int"))))


def parse_options(df: DataFrame, query: str = "query", alpha: float = 0.5, k: int = 10) -> DataFrame:
    """Take `alpha:x` and `top:n` out of the question; values are clamped, bad ones stay as words."""
    real = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

    def take(df: DataFrame, prefix: str, pattern: str, target: str) -> DataFrame:
        parts = tx.words(F.col("query_text"))
        at, raw = _option(F.col("_parts"), prefix, pattern)
        rest = F.filter(F.col("_parts"), lambda _, i: i + 1 != F.col("_at"))
        return (
            df.withColumn("_parts", parts)
            .withColumns({"_at": at, "_raw": raw})
            .withColumn("query_text", F.when(
                F.contains("query_text", F.lit(prefix)), F.array_join(rest, " ")
            ).otherwise(F.col("query_text")))
            .withColumnRenamed("_raw", target)
            .drop("_parts", "_at")
        )

    out = take(df.withColumn("query_text", F.col(query)), "alpha:", real, "_alpha")
    out = take(out, "top:", r"^[+-]?[0-9]+$", "_top")
    number = tx.clamp(F.col("_alpha").cast("double"), 0.0, 1.0)
    count = F.greatest(F.lit(1), F.least(F.lit(50), F.col("_top").try_cast("decimal(38,0)"))).cast("int")
    return out.withColumns({
        "alpha": F.when(F.col("_alpha").isNull(), F.lit(alpha)).otherwise(number),
        "top_k": F.when(F.col("_top").isNull(), F.lit(k)).otherwise(count),
    }).drop("_alpha", "_top")


def parse_intent_json(df: DataFrame, reply: str = "reply", query: str = "query") -> DataFrame:
    """Intent columns from a logged model reply; an unreadable reply falls back to the rules."""
    trimmed = tx.strip(F.col(reply))
    fenced = F.regexp_replace(F.get(F.split(trimmed, "```"), F.lit(1)), "^json", "")
    body = F.when(trimmed.startswith("```"), tx.strip(fenced)).otherwise(trimmed)
    rules = classify_intent(df, query=query)
    out = rules.withColumn("_json", F.from_json(body, INTENT_JSON))
    read = F.col("_json.intent_type").isNotNull()
    pick = lambda parsed, ruled: F.when(read, parsed).otherwise(F.col(ruled))
    known = F.when(F.col("_json.intent_type").isin(*INTENT_TYPES), F.col("_json.intent_type")).otherwise("lookup")
    none = F.array().cast("array<string>")
    return out.select(
        *df.columns,
        pick(known, "intent_type").alias("intent_type"),
        pick(F.coalesce("_json.confidence", F.lit(PARSED_INTENT_CONFIDENCE)), "intent_confidence").alias("intent_confidence"),
        pick(F.coalesce("_json.keywords", none), "keywords").alias("keywords"),
        pick(F.coalesce("_json.requires_subqueries", F.lit(False)), "requires_subqueries").alias("requires_subqueries"),
        pick(F.col("_json.temporal_context"), "temporal_context").alias("temporal_context"),
    )


def glossary_hits(queries: DataFrame, glossary: DataFrame, k: int = 5, query: str = "query") -> DataFrame:
    """The `k` best glossary entries of each question, by the same ranking as for documents."""
    nodes = glossary.select(
        F.col("entry_id").alias("node_id"), F.concat_ws(" ", "term", "definition").alias("text")
    )  # no colon: tokens keep their punctuation, and `term:` would not match `term`
    hits = search_once(queries, nodes, k, text=query)
    hits = hits.withColumnRenamed("node_id", "entry_id")
    return broadcast_within(hits, 96 * k * queries.count()).join(glossary, "entry_id")


def augment_queries(queries: DataFrame, hits: DataFrame, query: str = "query") -> DataFrame:
    """Append the aliases of the first three glossary hits; the best entry becomes the preface."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "aliases", "term", "definition")))
    found = (
        hits.where("rank <= 3").groupBy("query_id").agg(ordered.alias("_hits"))
        .select(
            "query_id",
            F.array_distinct(F.filter(F.flatten("_hits.aliases"), lambda a: a != "")).alias("aliases"),
            F.concat_ws(": ", F.element_at("_hits", 1)["term"], F.element_at("_hits", 1)["definition"]).alias("glossary_definition"),
        )
    )
    extra = F.when(
        F.size("aliases") > 0, F.concat(F.col(query), F.lit(" ("), F.array_join("aliases", " | "), F.lit(")"))
    )
    return queries.join(found, "query_id", "left").withColumn(
        "augmented_query", F.coalesce(extra, F.col(query))
    )


def acronyms_from_glossary(glossary: DataFrame) -> DataFrame:
    """Short alphanumeric aliases and their term; of several terms the last entry wins."""
    return (
        glossary.select("entry_id", "term", F.explode("aliases").alias("alias"))
        .withColumn("acronym", F.lower("alias"))
        .where(F.col("acronym").rlike(r"^[\p{L}\p{N}]{2,10}$"))
        .groupBy("acronym").agg(F.max_by("term", "entry_id").alias("term"))
    )


def expand_with_table(df: DataFrame, acronyms: DataFrame, key: str = "query_id", query: str = "query") -> DataFrame:
    """Acronym expansion where the acronyms are a table of any size: a join per word."""
    spread = df.select(key, F.posexplode(tx.words(F.col(query))).alias("_at", "_word")).withColumn(
        "acronym", F.regexp_replace(F.lower("_word"), "^[.,!?;:]+|[.,!?;:]+$", "")
    )
    said = F.when(F.col("term").isNotNull(), F.concat("_word", F.lit(" ("), "term", F.lit(")"))).otherwise(F.col("_word"))
    return (
        spread.join(acronyms, "acronym", "left")
        .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", said.alias("w")))).alias("_words"))
        .select(key, F.array_join("_words.w", " ").alias("expanded"))
    )


def build_prompts(context: DataFrame, queries: DataFrame, n: int = 5, chars: int = 800) -> DataFrame:
    """Numbered blocks of the best chunks, cut at `chars`, with the guidance for the intent."""
    block = F.concat_ws(
        "\n",
        F.concat(
            F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("file_name", F.concat(F.lit("Document "), F.col("rank").cast("string"))),
            F.lit(" (Page "), F.coalesce("page_label", F.lit("N/A")), F.lit("):"),
        ),
        F.substring("text", 1, chars),
        F.lit(""),
    )
    blocks = (
        context.where(F.col("rank") <= n).groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("_b"))
        .select("query_id", F.array_join("_b.block", "\n").alias("documents"))
    )
    guide = F.create_map(*[F.lit(x) for pair in INTENT_GUIDANCE.items() for x in pair])
    return queries.join(blocks, "query_id", "left").select(
        "query_id", "query",
        F.concat(
            F.initcap("intent_type"), F.lit(" - "),
            F.coalesce(F.try_element_at(guide, F.col("intent_type")), F.lit(DEFAULT_GUIDANCE)),
        ).alias("guidance"),
        F.coalesce("documents", F.lit("")).alias("documents"),
    )


def evaluation_inputs(context: DataFrame, queries: DataFrame, n: int = 3, chars: int = 1500) -> DataFrame:
    """Question and opening of each of the first `n` chunks, as an evaluator model is given them."""
    best = context.where(F.col("rank") <= n)
    return best.join(queries.select("query_id", "query"), "query_id").select(
        "query_id", "node_id", "query", F.substring("text", 1, chars).alias("document")
    )

