"""One query per operator, over the given tables in the roles of `roles.py`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citadex.functions import text as tx
from citadex.operators import analytics as an
from citadex.operators import corpus as co
from citadex.operators import evaluation as ev
from citadex.operators import fusion as fu
from citadex.operators import response as rs
from citadex.operators import reuse as ru
from citadex.operators import understanding as un
from citadex.operators.dense import dense_search, probed_search
from citadex.operators.lexical import bm25_search, search_once
from citadex.operators.vector_index import VectorIndex, build_vector_index, read_vector_index, vector_search
from citadex.plans import answering
from citadex.plans.roles import Roles
from citadex.session import scratch_path, staged
from citadex.settings import AnswerOptions
from citadex.sources import feedback_files as ff
from citadex.sources import feedback_store as fs
from citadex.sources import glossary as gl
from citadex.sources import index_store, reports
from citadex.sources.documents import read_documents
from citadex.streaming import log_streams as st

ASOF = "2024-01-31"
K = 10

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Roles], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = lambda spark, folder: fn(Roles(spark, folder))
    return fn


def flat(name: str, sep: str = "|") -> Column:
    return F.array_join(name, sep).alias(name)


def text_of(name: str) -> Column:
    """A time as text, so that it compares equal in any session time zone."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


# --- shared steps -------------------------------------------------------------------------------


def bm25_hits(r: Roles, k: int = K) -> DataFrame:
    return search_once(r.queries(), r.nodes(), k)


def dense_hits(r: Roles, k: int = K) -> DataFrame:
    return dense_search(r.query_vectors(), r.vectors(), k, exclude_self=True)


def fused(r: Roles) -> DataFrame:
    return fu.fuse(dense_hits(r, 2 * K), bm25_hits(r, 2 * K), 0.5)


def context(r: Roles) -> DataFrame:
    """The ten best chunks per question by BM25, with their texts."""
    return fu.attach_nodes(bm25_hits(r), r.nodes(), K * r.queries().count())


def questions(r: Roles) -> DataFrame:
    return un.classify_intent(r.queries())


def responses(r: Roles) -> DataFrame:
    asked = questions(r).select("query_id", "query", "intent_type", "intent_confidence", "keywords")
    return staged(rs.respond(staged(context(r), "context"), asked), "responses")


# --- sources and sinks --------------------------------------------------------------------------


@query
def scan_documents(r):
    path = scratch_path(r.spark, "documents")
    r.nodes().withColumnRenamed("node_id", "doc_id").write.json(path)
    return read_documents(r.spark, path, "json")


@query
def glossary_csv(r):
    path = scratch_path(r.spark, "glossary") + ".csv"
    r.glossary_raw().drop("entry_id").write.csv(path, header=True, quoteAll=True, escape='"')
    return gl.read_glossary(r.spark, path).select("term", "definition", flat("aliases"))


@query
def glossary_lines(r):
    return gl.glossary_from_lines(r.glossary_pages()).drop("aliases")


@query
def index_roundtrip(r):
    path = scratch_path(r.spark, "index")
    index_store.write_index(r.nodes(), path)
    return bm25_search(r.queries(), index_store.read_index(r.spark, path).lexical, K)


@query
def index_append(r):
    path = scratch_path(r.spark, "index")
    english = F.col("content_type") == "text"
    index_store.write_index(r.nodes().where(english), path)
    index_store.append_nodes(r.nodes().where(~english), path)
    return index_store.read_index(r.spark, path).lexical.weighted_terms().select("term", "df", F.round("idf", 6).alias("idf"))


def _terms(r: Roles, path: str) -> DataFrame:
    return index_store.read_index(r.spark, path).lexical.weighted_terms().select("term", "df", F.round("idf", 6).alias("idf"))


@query
def index_overwrite(r):
    """An index of other texts, and the corpus written over it."""
    path = scratch_path(r.spark, "index")
    index_store.write_index(r.nodes().withColumn("text", F.concat_ws(" ", "file_name", "page_label")), path)
    index_store.write_index(r.nodes(), path)
    index_store.drop_replaced(r.spark, path)
    return _terms(r, path)


@query
def index_replace(r):
    """Drafts of three content types, in segments of their own, give way to the texts of the corpus."""
    path = scratch_path(r.spark, "index")
    draft = r.nodes().withColumn("text", F.concat(F.lit("draft of "), F.substring("text", 1, 200)))
    english = F.col("content_type") == "text"
    index_store.write_index(r.nodes().where(english), path)
    index_store.append_nodes(draft.where("content_type = 'table'"), path)
    index_store.append_nodes(draft.where("content_type IN ('image', 'figure_caption')"), path)
    index_store.replace_nodes(r.nodes().where(~english), path)
    return bm25_search(r.queries(), index_store.read_index(r.spark, path).lexical, K)


@query
def index_compact(r):
    """Segments per content type, some nodes taken out and put back, then merged."""
    path = scratch_path(r.spark, "index")
    for kind in ("text", "table", "image", "figure_caption"):
        index_store.append_nodes(r.nodes().where(F.col("content_type") == kind), path)
    odd = r.nodes().where("content_type <> 'text'")
    index_store.remove_nodes(odd.select("node_id"), path)
    index_store.append_nodes(odd, path)
    index_store.compact_index(r.spark, path, 2)
    index_store.drop_replaced(r.spark, path)
    return _terms(r, path)


@query
def feedback_json(r):
    path = scratch_path(r.spark, "feedback")
    r.flat_feedback().write.json(path)
    return ff.read_feedback_json(r.spark, path, multi_line=False).select("*", flat("sources").alias("source_list")).drop("sources")


@query
def feedback_export(r):
    return ff.feedback_export_rows(r.flat_feedback())


@query
def report_text(r):
    return reports.display_text(reports.report_text(responses(r))).select("query_id", "report", "display")


@query
def report_tables(r):
    out = responses(r)
    sources = reports.sources_table(out).select("query_id", F.lit("source").alias("part"), F.concat_ws("|", "id", "name", "pages", "content_type").alias("value"))
    words = reports.keywords_table(out).select("query_id", F.lit("keyword").alias("part"), F.concat_ws("|", F.col("position").cast("string"), "keyword").alias("value"))
    summary = reports.summary_table(out).select("query_id", F.lit("summary").alias("part"), F.concat_ws("|", "confidence", "intent_type").alias("value"))
    return an.union_all(sources, words, summary)


@query
def log_project(r):
    out = an.to_query_log(r.log())
    return out.select(
        "query_id", "user", "query_text", "answer_text", "intent_type", F.col("intent_confidence").cast("double").alias("intent_confidence"),
        flat("sources"), F.col("confidence").cast("double").alias("confidence"), "response_time_ms", "session_id", F.date_format("dt", "yyyy-MM-dd").alias("dt"),
    )


@query
def feedback_project(r):
    return an.to_feedback(r.feedback()).select("query_id", "user", "is_helpful", "feedback_text", text_of("ts"))


@query
def migrate_log(r):
    return ff.migrate_log(r.flat_feedback()).select("*", flat("sources").alias("source_list")).drop("sources")


def _partly_dated(r: Roles) -> DataFrame:
    """Flat feedback in which unhelpful votes of anonymous users have lost their time."""
    lost = F.col("user").isNull() & ~F.col("is_helpful")
    return r.flat_feedback().withColumn("timestamp", F.when(~lost, F.col("timestamp")))


@query
def migration_errors(r):
    return ff.migration_errors(_partly_dated(r)).select("id", "query", "is_helpful")


@query
def migration_counts(r):
    """Rows moved with and without a stand-in for the time, and those left behind."""
    moved = ff.migrate_log(_partly_dated(r), "1970-01-01T00:00:00").agg(F.count("*").alias("with_stand_in"))
    return ff.migration_counts(_partly_dated(r)).select("*", moved.scalar().alias("with_stand_in"))


@query
def migrate_feedback(r):
    return ff.migrate_feedback(r.flat_feedback())


# --- corpus preparation -------------------------------------------------------------------------


@query
def table_normalise(r):
    return co.normalise_tables(r.raw_tables()).select(
        "table_index", "source_path", "page_number", flat("header"), "row_count", "column_count", "table_json", "table_markdown"
    )


@query
def captions(r):
    return co.find_captions(r.raw_captions(), ("license",))


@query
def artefact_nodes(r):
    found = co.find_captions(r.raw_captions(), ("license",))
    nodes = co.artefact_nodes(co.normalise_tables(r.raw_tables()), found, r.raw_images())
    return nodes.select("content_type", "file_name", "page_label", "text", "table_index", "row_count", "line_number", "image_index", "width")


@query
def chunk_window(r):
    return co.chunk_window(r.table("documents").select("doc_id", "source", "text"))


@query
def chunk_sentences(r):
    return co.chunk_sentences(r.table("documents").select("doc_id", "source", "text"))


@query
def ingest_summary(r):
    return co.ingest_summary(r.nodes())


@query
def page_blocks(r):
    return co.page_blocks(r.table("pages").select("page_id", "html"))


# --- question understanding ---------------------------------------------------------------------


def _odd(r: Roles) -> DataFrame:
    """User questions with a typo and an acronym in front."""
    return r.user_questions().withColumn("query", F.concat(F.lit("pritner  PPU, "), "query"))


@query
def query_clean(r):
    return _odd(r).select("query_id", tx.clean(F.col("query")).alias("cleaned"))


@query
def query_acronyms(r):
    return _odd(r).select("query_id", tx.expand_acronyms(F.col("query")).alias("expanded"))


@query
def query_keywords(r):
    return r.user_questions().select("query_id", F.array_join(tx.keywords(F.col("query")), "|").alias("keywords"))


@query
def query_variations(r):
    return un.rewrite_queries(un.classify_intent(_odd(r))).select("query_id", "variant_ix", "variant")


@query
def query_intent(r):
    out = un.classify_intent(r.user_questions())
    return out.select("query_id", "intent_type", "intent_confidence", flat("keywords"), "requires_subqueries")


@query
def query_options(r):
    n = F.pmod("conv_id", F.lit(3))
    lead = F.when(n == 0, "alpha:0.3 top:15 ").when(n == 1, "top:99 alpha:x alpha:7 ").otherwise("")
    asked = r.user_questions().withColumn("query", F.concat(lead, "query"))
    return un.parse_options(asked).select("query_id", "query_text", "alpha", "top_k")


@query
def search_mode(r):
    log = r.log()
    return log.select("query_id", "confidence", tx.search_mode(F.col("confidence")).alias("mode"))


def _glossary(r: Roles) -> DataFrame:
    return gl.glossary_rows(r.glossary_raw())


@query
def glossary_hits(r):
    return un.glossary_hits(r.queries(), _glossary(r)).select("query_id", "entry_id", "rank", "score", "term")


@query
def query_augment(r):
    hits = un.glossary_hits(r.queries(), _glossary(r))
    return un.augment_queries(r.queries(), hits).select("query_id", "augmented_query", "glossary_definition")


@query
def acronym_map(r):
    return un.acronyms_from_glossary(_glossary(r))


def _replies(r: Roles) -> DataFrame:
    """Questions with a logged reply: fenced JSON, plain JSON of an unknown type, JSON without optional fields, prose."""
    n = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4))
    body = F.to_json(F.struct(
        F.when(n == 1, "other").otherwise("reasoning").alias("intent_type"),
        F.when(n != 2, (F.pmod("turn", F.lit(10)) / 10)).alias("confidence"),
        F.when(n != 2, F.array(F.lit("a"), F.col("query_id"))).alias("keywords"),
    ))
    reply = F.when(n == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n == 3, F.lit("I cannot tell.")).otherwise(body)
    return r.user_questions().select("query_id", "query", reply.alias("reply"))


@query
def intent_json(r):
    return un.parse_intent_json(_replies(r)).select("query_id", "intent_type", "intent_confidence", flat("keywords"), "requires_subqueries")


@query
def prompt_context(r):
    return un.build_prompts(context(r), questions(r)).select("query_id", "guidance", "documents")


# --- retrieval ----------------------------------------------------------------------------------


@query
def bm25_terms(r):
    return r.index().weighted_terms().select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_postings(r):
    return r.index().postings


@query
def bm25_topk(r):
    return bm25_hits(r)


@query
def dense_topk(r):
    return dense_hits(r)


@query
def dense_lsh(r):
    return probed_search(r.query_vectors(), r.vectors(), K, exclude_self=True)


def _vector_index(r: Roles) -> VectorIndex:
    path = scratch_path(r.spark, "vectors")
    build_vector_index(r.vectors(), path)
    return read_vector_index(r.spark, path)


@query
def dense_index(r):
    """Every question over a stored index of quantised vectors, with exact answers."""
    return vector_search(r.query_vectors(), _vector_index(r), K, exclude_self=True)


@query
def score_norm(r):
    return fu.normalise(bm25_hits(r), into="norm").select("query_id", "node_id", "rank", F.round("norm", 6).alias("norm"))


@query
def hybrid_fuse(r):
    out = fu.top_k(fused(r), K)
    return out.select("query_id", "node_id", F.round("dense", 6).alias("dense"), F.round("bm25", 6).alias("bm25"), "score", "rank")


def _wanted(r: Roles) -> DataFrame:
    return fu.filter_meta(r.nodes(), {"content_type": "text"}).select("node_id")


@query
def hybrid_filtered(r):
    """Filtered after the search: both lists deepen until enough of their nodes match."""
    allowed, index, asked = _wanted(r), r.index(), r.query_vectors()
    dense = fu.matching_hits(asked, lambda q, n: dense_search(q, r.vectors(), n, exclude_self=True), allowed, 2 * K)
    sparse = fu.matching_hits(asked, lambda q, n: bm25_search(q, index, n), allowed, 2 * K)
    return fu.top_k(fu.fuse(dense, sparse), K).select("query_id", "node_id", "score", "rank")


@query
def hybrid_prefiltered(r):
    """Filtered before the search."""
    allowed = _wanted(r)
    sparse = search_once(r.queries(), r.nodes(), 2 * K, allowed=allowed)
    dense = dense_search(r.query_vectors(), r.vectors().join(allowed, "node_id", "left_semi"), 2 * K, exclude_self=True)
    return fu.top_k(fu.fuse(dense, sparse), K).select("query_id", "node_id", "score", "rank")


@query
def content_filter(r):
    return fu.filter_content(r.nodes(), ("table", "image"), always_text=True).select("node_id", "content_type")


@query
def rerank_overlap(r):
    rows = context(r).join(r.queries(), "query_id")
    return fu.rerank(rows).select("query_id", "node_id", "fused", "score", "rank")


def _verdicts(hits: DataFrame) -> DataFrame:
    """A stand-in verdict for every hit, computed from its node id."""
    n = F.pmod("node_id", F.lit(100))
    return hits.select("query_id", "node_id", (n / 100).alias("relevance_score"), (F.pmod(n * 7, F.lit(100)) / 100).alias("confidence"))


@query
def llm_blend(r):
    hits = fu.top_k(fused(r), K).select("query_id", "node_id", "score", "rank")
    return fu.blend_scores(hits, _verdicts(hits))


def _variant_hits(r: Roles) -> DataFrame:
    worded = un.rewrite_queries(questions(r))
    return search_once(worded, r.nodes(), 2 * K, ("query_id", "variant_ix"), "variant")


@query
def hits_dedupe(r):
    return fu.dedupe_hits(_variant_hits(r))


@query
def dynamic_window(r):
    return fu.dynamic_window(fused(r), 5).select("query_id", "node_id", "score", "rank")


@query
def fixed_topk(r):
    return fu.top_k(fused(r), 5).select("query_id", "node_id", "score", "rank")


@query
def answer_context(r):
    asked = answering.understand(r.query_vectors())
    out = answering.retrieve(asked, r.nodes(), r.index(), r.vectors(), AnswerOptions(top_k=5), exclude_self=True)
    return out.select("query_id", "node_id", "score", "rank", "variant_ix", "file_name")


def _answered(r: Roles, asked: DataFrame) -> DataFrame:
    return answering.answer_queries(asked, r.nodes(), r.index(), r.vectors(), AnswerOptions(top_k=5), exclude_self=True)


@query
def answer_full(r):
    """The whole path of a batch: wordings, both searches, fusion, re-ranking, window, cited answer."""
    out = _answered(r, r.query_vectors())
    named = F.transform("sources", lambda s: F.concat_ws(":", s["id"], s["name"], s["pages"], s["content_type"]))
    return out.select("query_id", "query", "answer", "reasoning", "confidence", F.array_join(named, "|").alias("sources"))


# --- context and response -----------------------------------------------------------------------


@query
def source_ids(r):
    return rs.number_sources(context(r)).select("query_id", "node_id", "rank", "file_name", "source_no")


@query
def meta_priority(r):
    return rs.metadata_priority(r.nodes()).select("node_id", "content_type", "priority")


@query
def answer_extract(r):
    return rs.extractive_answer(context(r), r.queries())


@query
def answer_short(r):
    return rs.short_answer(context(r), r.queries())


@query
def source_summary(r):
    return rs.compile_sources(context(r)).drop("source_no")


@query
def confidence(r):
    return rs.confidence(context(r), questions(r))


@query
def reasoning(r):
    return rs.reasoning(context(r), questions(r))


@query
def confidence_band(r):
    log = un.classify_intent(r.user_questions())
    bands = log.select("query_id", "intent_confidence", tx.confidence_band(F.col("intent_confidence")).alias("band"), rs.intent_label(F.col("intent_type")).alias("label"))
    return bands


def _cited(r: Roles) -> DataFrame:
    """Two cited parts per document, the second number sometimes out of range."""
    n = (F.pmod("doc_id", F.lit(7)) + 1).cast("string")
    part = lambda number: F.concat(F.lit("According to "), F.col("source"), F.lit(" ["), number, F.lit("]:\n"), F.col("text"))
    cited = F.concat(part(F.lit("1")), F.lit("\n\n"), part(n))
    far = F.concat(F.lit("Answer: "), F.col("text"), F.lit(" [9]"))
    return r.table("documents").select(
        "doc_id", F.when(F.pmod("doc_id", F.lit(5)) == 0, far).otherwise(cited).alias("answer"), F.lit(3).alias("n_documents")
    )


@query
def answer_segments(r):
    return rs.split_answer(_cited(r).select("doc_id", "answer"))


@query
def citation_check(r):
    return rs.check_citations(_cited(r)).select("doc_id", "n_citations", "n_valid", F.md5("checked_answer").alias("answer_md5"))


@query
def answer_clean(r):
    return _cited(r).select("doc_id", F.md5(rs.clean_answer(F.col("answer"))).alias("answer_md5"))


def _evaluated(r: Roles) -> DataFrame:
    """Documents with a stand-in verdict: JSON inside prose, JSON without score, prose with a score, nothing usable."""
    n = F.pmod("doc_id", F.lit(4))
    first = F.regexp_extract("text", r"\S+", 0)
    facts = F.array(first, F.lit("certainly not in there"), F.lit("nor this"))
    full = F.to_json(F.struct(
        (F.pmod("doc_id", F.lit(130)) / 100).alias("relevance_score"), F.lit(0.9).alias("confidence"), F.lit("direct").alias("reasoning"), facts.alias("key_facts")
    ))
    part = F.to_json(F.struct(F.lit(0.8).alias("confidence"), F.array(first).alias("key_facts")))
    reply = (
        F.when(n == 0, F.concat(F.lit("Sure:\n"), full, F.lit("\nDone.")))
        .when(n == 1, part).when(n == 2, F.lit("The Score: 0.7, I think")).otherwise("{broken")
    )
    return r.table("documents").select("doc_id", F.col("text").alias("document"), reply.alias("reply"))


@query
def eval_parse(r):
    return rs.parse_evaluations(_evaluated(r)).select("doc_id", "relevance_score", "confidence", "reasoning", flat("key_facts"))


@query
def fact_validation(r):
    out = rs.validate_facts(rs.parse_evaluations(_evaluated(r)))
    return out.select("doc_id", "confidence", "fact_validation_score", flat("validated_facts"))


@query
def attach_artefacts(r):
    found = rs.number_sources(context(r))
    first = found.groupBy("query_id", "source_no").agg(F.min_by(F.struct("file_name", "page_label"), "rank").alias("s"))
    sources = first.select("query_id", "source_no", F.concat("s.file_name", F.lit(".pdf")).alias("name"), F.col("s.page_label").alias("page"))
    tables = co.normalise_tables(r.raw_tables()).select(
        F.col("table_index").alias("artefact_id"), F.lit("table").alias("kind"), "source_path", "page_number",
        F.transform("body", lambda row: F.array_join(row, ",")).alias("body"),
    )
    images = r.raw_images().select(
        F.col("image_index").alias("artefact_id"), F.lit("image").alias("kind"), "source_path", "page_number", F.array("caption").alias("body")
    )
    return rs.attach_artefacts(sources, tables.unionByName(images)).select(
        "query_id", "source_no", "kind", "tier", "artefact_id", flat("preview"), "more_rows"
    )


@query
def snippets(r):
    text = F.col("text")
    return r.table("documents").select("doc_id", tx.snippet(text, 200).alias("s200"), tx.snippet(text, 50).alias("s50"), tx.snippet(text, 40).alias("s40"))


# --- re-use of answers --------------------------------------------------------------------------


@query
def cache_key(r):
    return ru.with_cache_key(r.asked_again()).select("query_id", "top_k", "alpha", "key")


@query
def exact_reuse(r):
    return ru.exact_reuse(r.asked_again(), r.cache()).select("query_id", "key", "response")


def _cache_vectors(r: Roles) -> DataFrame:
    return r.vectors().withColumnRenamed("node_id", "entry_id")


@query
def semantic_reuse(r):
    return ru.semantic_reuse(r.query_vectors(), None, 0.4, exclude_self=True, index=_vector_index(r))


@query
def cache_retain(r):
    return ru.retain(r.cache(), 100)


@query
def cache_invalidate(r):
    bad = r.table("labels").where("quality = 0").select(F.col("doc_id").alias("entry_id"))
    return ru.invalidate(r.cache(), bad, "entry_id")


@query
def validated_build(r):
    return ru.build_validated(r.log(), r.feedback()).select(
        "query_hash", "query_text", "answer_text", flat("sources"), "helpful_count", "unhelpful_count", text_of("first_validated"), text_of("last_used"), "is_active"
    )


def _validated(r: Roles) -> DataFrame:
    return ru.build_validated(r.document_log(), r.document_votes())


@query
def validated_reuse(r):
    out = ru.validated_reuse(r.asked_again(), _validated(r), min_votes=1)
    named = F.transform("sources", lambda s: F.concat_ws(":", s["id"], s["name"], s["pages"], s["content_type"]))
    return out.select("query_id", "query_hash", "answer_text", "helpful_count", "confidence", F.array_join(named, "|").alias("sources"))


@query
def definition_path(r):
    hits = un.glossary_hits(r.queries(), _glossary(r), 3)
    return ru.definition_answers(questions(r), hits)


def _similar(r: Roles) -> DataFrame:
    """The closest question with an answer in the cache, and that answer."""
    held = _cache_vectors(r).join(r.cache().select("entry_id", F.col("response").alias("answer")), "entry_id")
    near = ru.semantic_reuse(r.query_vectors(), held, 0.4, exclude_self=True)
    return near.join(held.select("entry_id", "answer"), "entry_id")


def _routed(r: Roles) -> DataFrame:
    asked = r.asked_again()
    exact = ru.exact_reuse(asked, r.cache()).where("response IS NOT NULL")
    semantic = _similar(r)
    known = ru.validated_reuse(asked, _validated(r), min_votes=1).where("answer_text IS NOT NULL")
    defined = questions(r).where("intent_type = 'definition'")
    return ru.route(asked, exact, semantic, known, defined)


@query
def route(r):
    return _routed(r).select("query_id", "route")


@query
def served_batch(r):
    """Routes, answers of every route, and retrieval for the rest, in one table."""
    asked = r.asked_again()
    exact = ru.exact_reuse(asked, r.cache()).where("response IS NOT NULL").select("query_id", F.col("response").alias("answer"))
    near = _similar(r)
    known = ru.validated_reuse(asked, _validated(r), min_votes=1).where("answer_text IS NOT NULL").withColumn("answer", F.col("answer_text"))
    defined = ru.definition_answers(questions(r), un.glossary_hits(r.queries(), _glossary(r), 3))

    def retrieved(rest):
        return _answered(r, r.query_vectors().join(rest.select("query_id"), "query_id", "left_semi"))

    out = answering.served(ru.route(asked, exact, near, known, defined), exact, near, known, defined, retrieved)
    return out.select("query_id", "route", "answer", "confidence")


@query
def cache_stats(r):
    return ru.cache_stats(_routed(r), r.cache())


@query
def answer_keys(r):
    rows = context(r)
    verdict = ru.evaluation_keys(rows.join(r.queries(), "query_id")).select("query_id", "rank", F.col("eval_key").alias("key"))
    answer = ru.answer_keys(rows, r.queries()).select("query_id", F.lit(0).alias("rank"), F.col("answer_key").alias("key"))
    return verdict.unionByName(answer)


# --- log and votes ------------------------------------------------------------------------------


@query
def user_history(r):
    return an.user_history(r.log(), n=20).select("query_id", "user", text_of("ts"), "nth")


@query
def query_by_id(r):
    """Log rows of every question that was voted unhelpful."""
    ids = r.feedback().where("NOT is_helpful").select("query_id")
    return an.query_by_id(r.log(), ids).select("query_id", "user", "query_text", "intent_type")


@query
def feedback_for(r):
    ids = r.log().where("confidence >= 0.5").select("query_id")
    return an.feedback_for(r.feedback(), ids).select("query_id", "user", "is_helpful", text_of("ts"))


@query
def feedback_stats(r):
    return an.feedback_stats(r.feedback())


@query
def date_range(r):
    return an.queries_between(r.log(), "2024-01-10", "2024-01-12").select("query_id", "user", text_of("ts"))


@query
def intent_dist(r):
    return an.intent_distribution(r.log(), 30, ASOF)


@query
def avg_metrics(r):
    return an.average_metrics(r.log(), 7, ASOF)


@query
def metrics_by_range(r):
    return an.metrics_by_range(r.log(), ASOF)


@query
def health(r):
    return an.health(r.log(), r.feedback(), 30, ASOF).withColumn("recommendations", flat("recommendations"))


@query
def stream_health(r):
    """Sums by day and intent, fed by a stream of the log, and the health of the last 30 days from them."""
    arrivals, out = scratch_path(r.spark, "arrivals"), scratch_path(r.spark, "rollup")
    r.log().write.partitionBy("intent_type").parquet(arrivals)
    stream = st.follow(r.spark, arrivals, r.log().schema, 4)
    st.roll_up(stream, out, scratch_path(r.spark, "state")).awaitTermination()
    last = an.rollup_between(st.read_rollup(r.spark, out), 30, ASOF)
    return an.health_of(last, r.feedback()).withColumn("recommendations", flat("recommendations"))


@query
def feedback_insights(r):
    return an.feedback_insights(r.flat_feedback())


@query
def helpful_rows(r):
    return an.rated(r.flat_feedback(), True).orderBy(F.col("timestamp").desc(), "id").select("id", "timestamp", "query")


@query
def feedback_upsert(r):
    return an.upsert_feedback(r.flat_feedback(), r.corrections()).select("id", "timestamp", "query", F.md5("answer").alias("answer_md5"), "is_helpful")


@query
def feedback_merge(r):
    """The same in a stored table: votes are merged into the partitions that they touch, and read back."""
    path = scratch_path(r.spark, "votes")
    fs.merge_feedback(r.flat_feedback(), path)
    fs.merge_feedback(r.corrections(), path)
    return fs.read_feedback(r.spark, path).select("id", "timestamp", "query", F.md5("answer").alias("answer_md5"), "is_helpful")


@query
def rating_lookup(r):
    pairs = r.flat_feedback().select(F.col("id").alias("pair_id"), "query", "answer")
    votes = r.flat_feedback().unionByName(r.corrections())
    return an.rating_of(pairs, votes).select("pair_id", "rating")


@query
def feedback_delete(r):
    ids = r.table("labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    return an.delete_feedback(r.flat_feedback(), ids).select("id", "query", "is_helpful")


@query
def session_stats(r):
    out = an.session_stats(r.log(), f"{ASOF} 00:00:00")
    return out.select("session_id", "user", "n_queries", text_of("started"), text_of("ended"), "duration_s", "expired")


@query
def session_gaps(r):
    return an.gap_sessions(r.log(), 24)


@query
def recent_history(r):
    return an.recent_history(r.log(), 50).select("user", "query_id", "query_text", "nth")


@query
def latest_ratings(r):
    ratings = r.log().select(F.element_at("sources", 1).alias("source"), F.col("intent_type").alias("segment"), (F.col("confidence") >= 0.5).alias("rating"), "ts")
    return an.latest_ratings(ratings, "source", "segment").select("source", "segment", "rating", text_of("ts"))


@query
def decimal_cast(r):
    stored = r.log().select("query_id", tx.to_stored(F.col("response_time_ms") / 4).alias("stored"))
    return stored.select("query_id", F.col("stored").cast("string").alias("stored"), tx.from_stored(F.col("stored")).alias("plain"))


# --- quality ------------------------------------------------------------------------------------


@query
def precision_at_k(r):
    """Dense hits are relevant when they carry the label of the question's vector."""
    hits = dense_hits(r)
    labels = r.table("embeddings").select(F.col("vec_id").alias("node_id"), "label")
    mine = labels.select(F.col("node_id").alias("query_id"), F.col("label").alias("_own"))
    judged = hits.join(labels, "node_id").join(mine, "query_id").where("label = _own")
    return ev.precision_at_k(hits, judged, K)


def _judged_intents(r: Roles) -> DataFrame:
    n = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    names = ("definition", "reasoning", "troubleshooting", "comparison", "lookup", "lookup")
    expected = F.get(F.array(*map(F.lit, names)), n.cast("int"))
    return un.classify_intent(r.user_questions().withColumn("expected", expected)).withColumnRenamed("intent_type", "predicted")


@query
def intent_accuracy(r):
    return ev.intent_confusion(_judged_intents(r))


@query
def grounding_rate(r):
    return ev.grounding_rate(_cited(r))


# --- streams ------------------------------------------------------------------------------------

LATE = "40 days"


def _replayed(r: Roles, rows: DataFrame, closing: bool = True) -> DataFrame:
    """The rows as a stream of a few files; a last row far ahead lets the watermark pass all others."""
    path = scratch_path(r.spark, "arrivals")
    rows.repartition(3, "query_id").write.parquet(path)
    if closing:
        last = rows.orderBy(F.col("ts").desc()).limit(1)
        ahead = last.withColumns({"ts": F.col("ts") + F.expr("INTERVAL 400 DAYS"), "user": F.lit("closing"), "query_id": F.lit("closing")})
        ahead.write.mode("append").parquet(path)
    return st.follow(r.spark, path, rows.schema, 2)


def _run(r: Roles, stream: DataFrame) -> DataFrame:
    out = scratch_path(r.spark, "stream")
    st.append_to(stream, out, scratch_path(r.spark, "state")).awaitTermination()
    return r.spark.read.schema(stream.schema).parquet(out)


@query
def stream_log(r):
    """Purchases arrive twice."""
    twice = r.log().unionByName(r.log().where("intent_type = 'purchase'"))
    out = scratch_path(r.spark, "log")
    arrivals = _replayed(r, twice, closing=False)
    st.append_to(st.deduplicated(arrivals, LATE), out, scratch_path(r.spark, "state"), "dt").awaitTermination()
    return r.spark.read.parquet(out).select("query_id", "user", "intent_type", "response_time_ms", F.date_format("dt", "yyyy-MM-dd").alias("dt"))


def _measured(df: DataFrame) -> DataFrame:
    return df.where("start < '2025-01-01'").select(
        text_of("start"), "intent_type", "n", F.round("avg_confidence", 10).alias("avg_confidence"), F.round("avg_response_time_ms", 10).alias("avg_response_time_ms")
    )


@query
def stream_daily(r):
    return _measured(_run(r, st.daily_metrics(_replayed(r, r.log()), LATE)))


@query
def stream_sliding(r):
    return _measured(_run(r, st.sliding_metrics(_replayed(r, r.log()), LATE)))


@query
def stream_sessions(r):
    out = _run(r, st.sessions(_replayed(r, r.log()), LATE)).where("user != 'closing'")
    return out.select("user", text_of("start"), text_of("end"), "n_queries")


@query
def stream_validated(r):
    out = scratch_path(r.spark, "validated")
    votes = _replayed(r, r.feedback(), closing=False)
    st.collect_votes(votes, out, scratch_path(r.spark, "state")).awaitTermination()
    return st.read_validated(r.spark, out, r.log()).select(
        "query_hash", "query_text", "answer_text", flat("sources"), "helpful_count", "unhelpful_count", text_of("first_validated"), text_of("last_used"), "is_active"
    )


@query
def stream_index(r):
    arrivals, out = scratch_path(r.spark, "arrivals"), scratch_path(r.spark, "index")
    r.nodes().write.partitionBy("content_type").parquet(arrivals)
    stream = st.follow(r.spark, arrivals, r.nodes().schema, 8)
    st.grow_index(stream, out, scratch_path(r.spark, "state")).awaitTermination()
    index = index_store.read_index(r.spark, out).lexical
    return index.weighted_terms().select("term", "df", F.round("idf", 6).alias("idf"))
