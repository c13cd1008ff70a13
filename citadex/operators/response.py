"""From a context window per question to a cited answer.

`context` holds query_id, node_id, rank, score, file_name, page_label, content_type and text, at most
twice `top_k` rows per question, so every group below is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citadex.functions import text as tx
from citadex.schemas import EVALUATION_JSON
from citadex.session import staged
from citadex.settings import (
    DEFAULT_LABEL, INTENT_LABELS, NO_CITATION_NOTE, NO_CONTEXT_ANSWER, NO_CONTEXT_REASONING,
    NO_CONTEXT_SHORT_ANSWER, SOURCES_PER_ROW,
)


def _named() -> Column:
    return F.coalesce(F.col("file_name"), F.lit("Unknown"))


def _cited(number: Column) -> Column:
    return F.concat(F.lit("["), number.cast("string"), F.lit("]"))


def _gathered(value: Column, by: str) -> Column:
    """Values of a group in the order of `by`."""
    return F.array_sort(F.collect_list(F.struct(F.col(by), value.alias("v"))))["v"]


def number_sources(context: DataFrame) -> DataFrame:
    """`source_no` per file, from 1 in the order of first appearance."""
    first = F.min("rank").over(Window.partitionBy("query_id", "file_name"))
    order = Window.partitionBy("query_id").orderBy("_first")
    return (
        context.withColumn("file_name", _named()).withColumn("_first", first)
        .withColumn("source_no", F.dense_rank().over(order)).drop("_first")
    )


def metadata_priority(context: DataFrame) -> DataFrame:
    """1.0, and 1.2 for tables."""
    is_table = F.coalesce("content_type", F.lit("text")) == "table"
    return context.withColumn("priority", F.when(is_table, F.lit(1.2)).otherwise(F.lit(1.0)))


def extractive_answer(context: DataFrame, queries: DataFrame, per_file: int | None = None) -> DataFrame:
    """Per file its chunks (or only the best `per_file`) under a citation; a fixed text for questions without context."""
    numbered = number_sources(context)
    if per_file is not None:
        within = Window.partitionBy("query_id", "file_name").orderBy("rank")
        numbered = numbered.withColumn("_nth", F.row_number().over(within)).where(F.col("_nth") <= per_file)
    sections = (
        numbered.groupBy("query_id", "file_name", "source_no")
        .agg(F.array_join(_gathered(tx.strip(F.col("text")), "rank"), " ").alias("_body"))
        .select("query_id", "source_no", F.concat(
            F.lit("According to "), "file_name", F.lit(" "), _cited(F.col("source_no")), F.lit(":\n"), "_body"
        ).alias("_section"))
        .groupBy("query_id").agg(F.array_join(_gathered(F.col("_section"), "source_no"), "\n\n").alias("answer"))
    )
    return queries.select("query_id").join(sections, "query_id", "left").withColumn(
        "answer", F.coalesce("answer", F.lit(NO_CONTEXT_ANSWER))
    )


def short_answer(context: DataFrame, queries: DataFrame, n: int = 3, chars: int = 500) -> DataFrame:
    """The opening of the best chunks, each under its own number."""
    number = F.col("rank").cast("string")
    name = F.coalesce(F.col("file_name"), F.concat(F.lit("Document "), number))
    part = F.concat(
        F.lit("According to "), name, F.lit(" "), _cited(F.col("rank")), F.lit(":\n"),
        F.substring("text", 1, chars), F.lit("..."),
    )
    parts = context.where(F.col("rank") <= n).groupBy("query_id").agg(
        F.array_join(_gathered(part, "rank"), "\n\n").alias("answer")
    )
    return queries.select("query_id").join(parts, "query_id", "left").withColumn(
        "answer", F.coalesce("answer", F.lit(NO_CONTEXT_SHORT_ANSWER))
    )


def compile_sources(context: DataFrame) -> DataFrame:
    """Per file: citation, distinct pages in numeric order, content type of its best chunk."""
    page = F.coalesce("page_label", F.lit("N/A"))
    number = F.when(page.rlike("^[0-9]+$"), page.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    pages = F.array_sort(F.collect_set(F.when(page != "N/A", F.struct(number.alias("n"), page.alias("p")))))["p"]
    return (
        number_sources(context).groupBy("query_id", "file_name", "source_no")
        .agg(
            pages.alias("_pages"),
            F.min_by(F.coalesce("content_type", F.lit("text")), "rank").alias("content_type"),
        )
        .select(
            "query_id", "source_no", _cited(F.col("source_no")).alias("id"), F.col("file_name").alias("name"),
            F.when(F.size("_pages") > 0, F.array_join("_pages", ", ")).otherwise("N/A").alias("pages"), "content_type",
        )
    )


def confidence(context: DataFrame, queries: DataFrame) -> DataFrame:
    """Half relevance, three tenths intent, two tenths number of files (three are enough)."""
    seen = context.groupBy("query_id").agg(
        F.avg("score").alias("_relevance"), F.count_distinct(F.coalesce("file_name", F.lit(""))).alias("_files")
    )
    value = 0.5 * F.col("_relevance") + 0.3 * F.col("intent_confidence") + 0.2 * F.least(F.col("_files") / 3, F.lit(1.0))
    return queries.select("query_id", "intent_confidence").join(seen, "query_id", "left").select(
        "query_id",
        # `least` skips nulls, so the question without context is told apart first
        F.when(F.col("_files").isNull(), 0.0).otherwise(F.round(F.least(value, F.lit(1.0)), 6)).alias("confidence"),
    )


def reasoning(context: DataFrame, queries: DataFrame) -> DataFrame:
    """How many chunks, which intent, how many of high priority, how relevant on average."""
    seen = metadata_priority(context).groupBy("query_id").agg(
        F.count("*").alias("_n"), F.count_if(F.col("priority") > 0.8).alias("_high"), F.avg("score").alias("_avg")
    )
    said = F.concat_ws(
        " ",
        F.format_string(
            "Retrieved %d relevant document chunks using hybrid search (dense embeddings + BM25).", "_n"
        ),
        F.format_string(
            "Query intent classified as: %s (confidence: %.2f%%).", "intent_type", F.col("intent_confidence") * 100
        ),
        F.when(F.col("_high") > 0, F.format_string(
            "Prioritized %d sources based on reliability and recency.", "_high"
        )),
        F.format_string("Average relevance score: %.3f", "_avg"),
    )
    return queries.select("query_id", "intent_type", "intent_confidence").join(seen, "query_id", "left").select(
        "query_id", F.when(F.col("_n").isNull(), F.lit(NO_CONTEXT_REASONING)).otherwise(said).alias("reasoning")
    )


def respond(context: DataFrame, queries: DataFrame) -> DataFrame:
    """One structured response per question."""
    listed = compile_sources(context).groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("source_no", "id", "name", "pages", "content_type"))),
            lambda s: F.struct(s["id"].alias("id"), s["name"].alias("name"), s["pages"].alias("pages"), s["content_type"].alias("content_type")),
        ).alias("sources")
    )
    none = F.array().cast("array<struct<id:string,name:string,pages:string,content_type:string>>")
    return (
        queries.join(extractive_answer(context, queries), "query_id")
        .join(reasoning(context, queries), "query_id")
        .join(confidence(context, queries), "query_id")
        .join(listed, "query_id", "left")
        .withColumn("sources", F.coalesce("sources", none))
    )


def intent_label(intent: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in INTENT_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, intent), F.lit(DEFAULT_LABEL))


def split_answer(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Cited segments of an answer: header, content and citation number."""
    keep = [c for c in df.columns if c != answer]
    pattern = r"According to [^\[]+\[[0-9]+\]:"
    headers = F.regexp_extract_all(F.col(answer), F.lit(pattern), F.lit(0))
    bodies = F.slice(F.split(F.col(answer), pattern), 2, 1 << 30)
    return (
        df.select(*keep, F.posexplode_outer(F.arrays_zip(headers.alias("header"), bodies.alias("content"))).alias("segment_ix", "_s"))
        .select(
            *keep, "segment_ix", tx.strip(F.col("_s.header")).alias("header"), tx.strip(F.col("_s.content")).alias("content"),
            F.regexp_extract("_s.header", r"\[([0-9]+)\]", 1).alias("citation_no"),
        )
        .where((F.col("content") != "") & (F.col("header") != ""))
    )


def check_citations(df: DataFrame, answer: str = "answer", documents: str = "n_documents") -> DataFrame:
    """Count citations and valid ones (1..documents); a note is added when none is valid."""
    found = F.regexp_extract_all(F.col(answer), F.lit(r"\[([0-9]+)\]"), F.lit(1))
    valid = F.filter(
        F.col("_found"),
        lambda c: c.try_cast("decimal(38,0)").between(F.lit(1), F.col(documents)) & c.try_cast("decimal(38,0)").isNotNull(),
    )
    return (
        df.withColumn("_found", found).withColumn("_valid", F.size(valid))
        .withColumns({
            "n_citations": F.size("_found"),
            "n_valid": F.col("_valid"),
            "checked_answer": F.when(F.col("_valid") > 0, F.col(answer)).otherwise(F.concat(answer, F.lit(NO_CITATION_NOTE))),
        })
        .drop("_found", "_valid")
    )


def clean_answer(text: Column) -> Column:
    """Answer without white space around it and without a leading `Answer:` or `Response:`."""
    return tx.strip(F.regexp_replace(tx.strip(text), "^(Answer|Response):", ""))


def parse_evaluations(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Relevance and confidence from a model's reply: JSON, else a `score:` in prose, else defaults."""
    span = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    loose = F.regexp_extract(reply, r"(?i)score[:\s]*([0-9.]+)", 1)
    parsed = df.withColumns({"_span": span, "_loose": loose}).withColumn(
        "_json", F.from_json("_span", EVALUATION_JSON)
    )
    has_json = F.col("_span") != ""
    readable = F.coalesce(
        *[F.col(f"_json.{f}").isNotNull() for f in ("relevance_score",)], F.lit(False)
    ) | F.col("_json.reasoning").isNotNull() | F.col("_json.confidence").isNotNull()
    score = F.when(has_json, F.coalesce(F.col("_json.relevance_score"), F.lit("0.5"))).when(
        F.col("_loose") != "", F.col("_loose")
    ).otherwise("0.5").try_cast("double")
    trust = F.when(has_json, F.col("_json.confidence").try_cast("double")).otherwise(F.lit(0.3))
    ok = (~has_json | readable) & score.isNotNull() & trust.isNotNull()
    none = F.array().cast("array<string>")
    return parsed.select(
        *df.columns,
        F.when(ok, tx.clamp(score, 0.0, 1.0)).otherwise(0.5).alias("relevance_score"),
        F.when(ok, tx.clamp(trust, 0.0, 1.0)).otherwise(0.0).alias("confidence"),
        F.when(~ok, "Parse error").when(has_json, F.coalesce("_json.reasoning", F.lit("Unknown")))
        .otherwise("Fallback parsing used").alias("reasoning"),
        F.when(ok & has_json, F.coalesce("_json.key_facts", none)).otherwise(none).alias("key_facts"),
    )


def validate_facts(df: DataFrame, document: str = "document") -> DataFrame:
    """Claimed facts that the document holds; confidence shrinks when fewer than half do."""
    lowered = F.lower(document)
    held = tx.let(lowered, lambda d: F.filter("key_facts", lambda f: F.contains(d, F.lower(f))))
    ratio = F.when(F.size("key_facts") > 0, F.size("validated_facts") / F.size("key_facts")).otherwise(1.0)
    return (
        df.withColumn("validated_facts", held).withColumn("fact_validation_score", F.round(ratio, 6))
        .withColumn("confidence", F.when(ratio < 0.5, F.round(F.col("confidence") * 0.7, 6)).otherwise(F.col("confidence")))
    )


def attach_artefacts(sources: DataFrame, artefacts: DataFrame, n_sources: int | None = None, preview: int = 3) -> DataFrame:
    """Tables or images for the sources of each question (or its first `n_sources`), each artefact shown once.

    sources: query_id, source_no, name, page. artefacts: artefact_id, kind, source_path, page_number
    and `body`, the rows. Per source and kind all artefacts of the same file and page are taken
    (tier 1); if there is none, all of that page (tier 2). A name prefix on the same page (the last
    resort of a lookup by file pattern) can only match what tier 2 has found already. `preview` rows
    of each body are shown, the number of the others is told.

    Whether a source has artefacts of its own file is found on the sources. The sources of a page meet an artefact as one
    row (in parts, if they are many), so its rows move once and not once per source.
    """
    wanted = sources if n_sources is None else sources.where(F.col("source_no") <= n_sources)
    wanted = wanted.select(
        "query_id", "source_no", F.col("page").cast("int").alias("page_number"),
        tx.file_stem(F.col("name")).alias("stem"),
    )
    shown = artefacts.withColumn("of", tx.file_stem(F.col("source_path"))).select(
        "kind", "of", "page_number", "artefact_id", F.slice("body", 1, preview).alias("preview"),
        F.greatest(F.size("body") - preview, F.lit(0)).alias("more_rows"),
    )
    wanted = staged(wanted, "sources")
    own = shown.where(F.col("of").isNotNull()).groupBy("page_number", F.col("of").alias("stem")).agg(F.collect_set(F.struct("kind")).alias("_own"))
    of_source = Window.partitionBy("query_id", "source_no")
    part = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-wanted.count() // SOURCES_PER_ROW)))).alias("part")
    asked = (
        wanted.join(own, ["page_number", "stem"], "left")
        .withColumn("_own", F.flatten(F.collect_list("_own").over(of_source)))
        .groupBy("page_number", part).agg(F.collect_list(F.struct("query_id", "source_no", "stem", "_own")).alias("_asked"))
    )
    tier = lambda s: F.when(F.col("of") == s["stem"], 1).otherwise(2)
    best = lambda s: F.when(F.exists(s["_own"], lambda o: o["kind"].eqNullSafe(F.col("kind"))), 1).otherwise(2)
    fitting = F.transform(
        F.filter("_asked", lambda s: tier(s) == best(s)),
        lambda s: F.struct(s["query_id"].alias("query_id"), s["source_no"].alias("source_no"), tier(s).alias("tier")),
    )
    once = Window.partitionBy("part", "query_id", "kind", "artefact_id").orderBy("source_no")
    return (
        shown.join(asked, "page_number").select("part", "kind", "artefact_id", "preview", "more_rows", fitting.alias("_for"))
        .repartition("part", "kind", "artefact_id")
        .select("part", "kind", "artefact_id", "preview", "more_rows", F.inline("_for"))
        .withColumn("_nth", F.row_number().over(once)).where("_nth = 1")
        .select("query_id", "source_no", "kind", "tier", "artefact_id", "preview", "more_rows")
    )
