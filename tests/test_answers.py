"""Responses, re-use of answers, and the whole batch."""

import random

import pytest
from pyspark.sql import functions as F

from citadex.functions import text as tx
from citadex.functions.hooks import hashed_encoder
from citadex.operators import evaluation as ev
from citadex.operators import response as rs
from citadex.operators import reuse as ru
from citadex.operators.lexical import build_lexical_index
from citadex.plans.answering import answer_queries, retrieve, route_queries, understand
from citadex.settings import NO_CITATION_NOTE, NO_CONTEXT_ANSWER, NO_CONTEXT_REASONING, NO_CONTEXT_SHORT_ANSWER, AnswerOptions
from citadex.sources import reports

CONTEXT = "query_id long, node_id long, rank int, score double, file_name string, page_label string, content_type string, text string"


@pytest.fixture(scope="module")
def context(spark):
    return spark.createDataFrame([
        (1, 10, 1, 0.9, "b.pdf", "10", "table", " first "), (1, 11, 2, 0.6, "a.pdf", "N/A", "text", "second"),
        (1, 12, 3, 0.3, "b.pdf", "9", "text", "third"), (1, 13, 4, 0.2, "b.pdf", "9", "text", "fourth"),
        (1, 14, 5, 0.2, "b.pdf", "1", "text", "fifth"),
    ], CONTEXT)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(
        [(1, "how", "reasoning", 0.85, ["how"]), (2, "what", "lookup", 0.6, [])],
        "query_id long, query string, intent_type string, intent_confidence double, keywords array<string>",
    )


def by_query(df, *columns):
    return {r.query_id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_answers(context, queries):
    assert by_query(rs.extractive_answer(context, queries), "answer") == {
        1: "According to b.pdf [1]:\nfirst third fourth fifth\n\nAccording to a.pdf [2]:\nsecond", 2: NO_CONTEXT_ANSWER,
    }
    assert by_query(rs.extractive_answer(context, queries, per_file=3), "answer")[1].startswith("According to b.pdf [1]:\nfirst third fourth\n\n")
    short = by_query(rs.short_answer(context, queries, n=2, chars=4), "answer")
    assert short == {1: "According to b.pdf [1]:\n fir...\n\nAccording to a.pdf [2]:\nseco...", 2: NO_CONTEXT_SHORT_ANSWER}


def test_sources_confidence_reasoning(context, queries):
    got = {(r.id, r.name, r.pages, r.content_type) for r in rs.compile_sources(context).collect()}
    assert got == {("[1]", "b.pdf", "1, 9, 10", "table"), ("[2]", "a.pdf", "N/A", "text")}
    assert by_query(rs.confidence(context, queries), "confidence") == {1: round(0.5 * 0.44 + 0.3 * 0.85 + 0.2 * 2 / 3, 6), 2: 0.0}
    said = by_query(rs.reasoning(context, queries), "reasoning")
    assert said[2] == NO_CONTEXT_REASONING
    assert said[1] == (
        "Retrieved 5 relevant document chunks using hybrid search (dense embeddings + BM25). Query intent classified as: reasoning "
        "(confidence: 85.00%). Prioritized 5 sources based on reliability and recency. Average relevance score: 0.440"
    )


def test_reports(context, queries):
    row = reports.display_text(reports.report_text(rs.respond(context, queries), "TITLE", "now")).where("query_id = 1").first()
    lines = row.display.split("\n")
    assert lines[1] == "ANSWER:" and "[1] b.pdf (pages: 1, 9, 10) [table]" in lines and "[2] a.pdf" in lines
    assert lines[-2] == f"Confidence: {100 * row.confidence:.2f}% | Intent: reasoning"
    assert "Keywords: how" in row.report and "[2] a.pdf (Pages: N/A)" in row.report and row.report.startswith("=" * 80 + "\nTITLE\n")


def test_segments_and_citations(spark):
    rows = [
        (1, "Intro. According to A b.pdf [1]:\n one [2]\n\nAccording to C [12]:\n two", 2), (2, "no marks", 3), (3, "bad [0] [7]", 3), (4, "ok [3]", 3),
        (5, "huge [99999999999999999999999999]", 3),
    ]
    df = spark.createDataFrame(rows, "i int, answer string, n_documents int")
    got = [(r.i, r.header, r.content, r.citation_no) for r in rs.split_answer(df.drop("n_documents")).orderBy("i", "segment_ix").collect()]
    assert got == [(1, "According to A b.pdf [1]:", "one [2]", "1"), (1, "According to C [12]:", "two", "12")]
    checked = {r.i: (r.n_citations, r.n_valid, r.checked_answer.endswith(NO_CITATION_NOTE)) for r in rs.check_citations(df).collect()}
    assert checked == {1: (3, 2, False), 2: (0, 0, True), 3: (2, 0, True), 4: (1, 1, False), 5: (1, 0, True)}
    assert tuple(ev.grounding_rate(df).first()) == (5, 0.2)


def test_evaluations_and_facts(spark):
    replies = [
        'x {"relevance_score": 1.4, "confidence": 0.8, "reasoning": "r", "key_facts": ["Alpha", "gone", "lost"]} y',
        '{"relevance_score": 0.5, "reasoning": "no confidence"}', "Score: 0.7 of 1", "score 1.2.3", "nothing", "{broken",
    ]
    df = spark.createDataFrame([(i, "has ALPHA", r) for i, r in enumerate(replies)], "i int, document string, reply string")
    parsed = rs.parse_evaluations(df)
    got = [(r.relevance_score, r.confidence, r.reasoning, len(r.key_facts)) for r in parsed.orderBy("i").collect()]
    assert got == [
        (1.0, 0.8, "r", 3), (0.5, 0.0, "Parse error", 0), (0.7, 0.3, "Fallback parsing used", 0), (0.5, 0.0, "Parse error", 0),
        (0.5, 0.3, "Fallback parsing used", 0), (0.5, 0.3, "Fallback parsing used", 0),
    ]
    facts = [(r.validated_facts, r.fact_validation_score, r.confidence) for r in rs.validate_facts(parsed).orderBy("i").limit(2).collect()]
    assert facts == [(["Alpha"], 0.333333, 0.56), ([], 1.0, 0.0)]


def test_answer_prefix(spark):
    df = spark.createDataFrame([(" Answer:  Response: x ",), ("Response:\ny",), ("An answer: z",)], "a string")
    assert [r[0] for r in df.select(rs.clean_answer(F.col("a"))).collect()] == ["Response: x", "y", "An answer: z"]


def test_artefacts(spark):
    sources = spark.createDataFrame([(1, 1, "m.pdf", "3"), (1, 2, "n.pdf", "3"), (1, 3, "o.pdf", "9"), (1, 6, "m.pdf", "4")], "query_id long, source_no int, name string, page string")
    artefacts = spark.createDataFrame(
        [(1, "table", "/x/m.pdf", 3, list("abcde")), (2, "table", "/x/m.pdf", 3, ["z"]), (3, "image", "/x/q.pdf", 3, ["i"]), (4, "table", "/x/m.pdf", 4, ["late"])],
        "artefact_id long, kind string, source_path string, page_number int, body array<string>",
    )
    got = {(r.source_no, r.kind, r.tier, r.artefact_id, tuple(r.preview), r.more_rows) for r in rs.attach_artefacts(sources, artefacts).collect()}
    assert got == {
        (1, "table", 1, 1, ("a", "b", "c"), 2), (1, "table", 1, 2, ("z",), 0), (1, "image", 2, 3, ("i",), 0), (6, "table", 1, 4, ("late",), 0),
    }
    assert {r.source_no for r in rs.attach_artefacts(sources, artefacts, n_sources=5).collect()} == {1}


def test_keys_cover_whole_texts(spark):
    long_ = "x" * 600
    context = spark.createDataFrame([(q, rank, long_ + end) for q in (1, 2) for rank, end in enumerate("abcd" if q == 1 else "abce", 1)], "query_id long, rank int, text string")
    asked = spark.createDataFrame([(1, "same"), (2, "same")], "query_id long, query string")
    assert len({r.answer_key for r in ru.answer_keys(context, asked).collect()}) == 2
    assert len({r.eval_key for r in ru.evaluation_keys(context.join(asked, "query_id")).collect()}) == 5


def votes(spark, rows):
    return spark.createDataFrame(rows, "query_id string, is_helpful boolean, at long").withColumn("ts", F.timestamp_seconds("at")).drop("at")


def test_validated_answers_do_not_depend_on_order_or_batches(spark):
    log = spark.createDataFrame([("u_1", "What?", "A1", ["s"]), ("u_2", " what? ", "A2", ["t"]), ("v_3", "other", "B", [])], "query_id string, query_text string, answer_text string, sources array<string>")
    rows = [("u_2", True, 5), ("u_1", True, 9), ("u_1", False, 1), ("u_2", True, 7), ("v_3", False, 3)]
    want = None
    for seed in range(3):
        shuffled = random.Random(seed).sample(rows, len(rows))
        parts = [ru.validated_partials(log, votes(spark, shuffled[:2])), ru.validated_partials(log, votes(spark, shuffled[2:]))]
        for table in (ru.build_validated(log, votes(spark, shuffled)), ru.merge_validated(parts[0].unionByName(parts[1]))):
            got = [(r.answer_text, r.helpful_count, r.unhelpful_count, r.first_validated.second, r.last_used.second) for r in table.collect()]
            want = want or got
            assert got == want == [("A2", 3, 1, 5, 9)]
    asked = spark.createDataFrame([(1, "WHAT? "), (2, "other")], "query_id long, query string")
    served = {r.query_id: (r.answer_text, r.confidence) for r in ru.validated_reuse(asked, ru.build_validated(log, votes(spark, rows))).collect()}
    assert served == {1: ("A2", 0.95), 2: (None, None)}


def test_retention_and_invalidation(spark):
    cache = spark.createDataFrame([(f"k{i}", i) for i in range(6)], "key string, inserted_at long")
    kept = ru.retain(cache, 3)
    assert sorted(r.key for r in kept.collect()) == ["k3", "k4", "k5"]
    bad = spark.createDataFrame([("k4",), ("k4",), ("zz",)], "key string")
    assert sorted(r.key for r in ru.invalidate(kept, bad).collect()) == ["k3", "k5"]


@pytest.fixture(scope="module")
def library(spark):
    texts = ["the pump moves ink", "the ink tank holds ink", "replace the filter", "pump error codes", "voltage of the head"]
    encode = hashed_encoder(64)
    nodes = spark.createDataFrame([(i, f"m{i % 2}.pdf", str(i), "text" if i % 2 else "table", t) for i, t in enumerate(texts)], "node_id long, file_name string, page_label string, content_type string, text string")
    return nodes, build_lexical_index(nodes), nodes.select("node_id", encode(F.col("text")).alias("embedding")), encode


def test_batch(spark, library):
    nodes, index, vectors, encode = library
    asked = spark.createDataFrame([(1, "pump error"), (2, "ink"), (3, "zzz")], "query_id long, query string").withColumn("embedding", encode(F.col("query")))
    out = {r.query_id: r for r in answer_queries(asked, nodes, index, vectors, AnswerOptions(top_k=2)).collect()}
    assert set(out) == {1, 2, 3}
    assert out[1].answer.startswith("According to m1.pdf [1]:\npump error codes") and out[1].intent_type == "troubleshooting"
    assert 0 < out[1].confidence <= 1 and out[1].sources[0].name == "m1.pdf"
    for encoder in (None, encode):
        rows = retrieve(understand(asked), nodes, index, vectors, AnswerOptions(top_k=2, metadata_filters={"content_type": "table"}), encoder=encoder)
        assert {r.content_type for r in rows.collect()} == {"table"}


def test_batch_options_per_question(spark, library):
    nodes, index, vectors, encode = library
    rows = [(1, "ink pump", 1, 0.0), (2, "ink pump", 3, 1.0), (3, "ink pump", None, None)]
    asked = spark.createDataFrame(rows, "query_id long, query string, top_k int, alpha double").withColumn("embedding", encode(F.col("query")))
    options = AnswerOptions(top_k=2, dynamic_windowing=False)
    got = {}
    for r in retrieve(understand(asked), nodes, index, vectors, options, scorer=None).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.node_id, r.score))
    for query_id, k, alpha in ((1, 1, 0.0), (2, 3, 1.0), (3, 2, 0.5)):
        alone = retrieve(
            understand(asked.where(F.col("query_id") == query_id).drop("top_k", "alpha")), nodes, index, vectors,
            AnswerOptions(top_k=k, alpha=alpha, dynamic_windowing=False), scorer=None,
        )
        assert sorted(got[query_id]) == sorted((r["rank"], r.node_id, r.score) for r in alone.collect())
        assert len(got[query_id]) == k


def test_glossary_definition_leads_the_answer(spark, library):
    nodes, index, vectors, encode = library
    glossary = spark.createDataFrame([(1, "ink", "coloured fluid", ["dye"]), (2, "head", "print head", []), (3, "belt", "moves paper", [])], "entry_id long, term string, definition string, aliases array<string>")
    asked = spark.createDataFrame([(1, "ink"), (2, "zzz")], "query_id long, query string").withColumn("embedding", encode(F.col("query")))
    out = {r.query_id: r.answer for r in answer_queries(asked, nodes, index, vectors, AnswerOptions(top_k=2), glossary).collect()}
    assert out[1].startswith("Definition: ink: coloured fluid\n\nAccording to ") and not out[2].startswith("Definition")


def test_routes(spark, library):
    *_, encode = library
    asked = spark.createDataFrame(
        [(1, "cached question"), (2, "cached question please"), (3, "approved"), (4, "what is ink"), (5, "other words")], "query_id long, query string"
    ).select("*", F.lit(10).alias("top_k"), F.lit(0.5).alias("alpha"), encode(F.col("query")).alias("embedding"))
    cache = spark.createDataFrame([(100, " Cached QUESTION", "R")], "entry_id long, query string, response string").select(
        "entry_id", "response", tx.cache_key(F.col("query"), F.lit(10), F.lit(0.5)).alias("key"), encode(F.col("query")).alias("embedding")
    )
    log = spark.createDataFrame([("u_1", "approved", "A", ["s"])], "query_id string, query_text string, answer_text string, sources array<string>")
    validated = ru.build_validated(log, votes(spark, [("u_1", True, 1), ("u_1", True, 2)]))
    glossary = spark.createDataFrame([(1, "ink", "coloured fluid", ["dye"]), (2, "head", "x", []), (3, "belt", "y", [])], "entry_id long, term string, definition string, aliases array<string>")
    routed = route_queries(asked, cache, validated, glossary, threshold=0.8)
    assert {r.query_id: r.route for r in routed.collect()} == {1: "exact", 2: "semantic", 3: "validated", 4: "glossary", 5: "retrieve"}
    stats = ru.cache_stats(routed, cache).first()
    assert (stats.hits, stats.misses, stats.total, stats.hit_rate, stats["size"]) == (2, 3, 5, 0.4, 1)


def test_artefacts_move_once_and_not_once_per_source(spark, monkeypatch):
    """The same rows as by two windows over all pairs, parts included; only whole artefacts and sources are shuffled."""
    rng = random.Random(4)
    sources = [(q, n, f"{rng.choice('abc')}.pdf", rng.choice(["1", "2", "3", None])) for q in range(40) for n in range(1, rng.randint(2, 5))]
    sources += [(7, 1, "c.pdf", "1"), (8, 9, None, "2")]
    artefacts = [(i % 25, rng.choice(["table", "image"]), rng.choice(["x/a.pdf", "x/b.pdf", None]), rng.choice([1, 2, 3, None]), [f"r{i % 25}"] * 4) for i in range(60)]
    want = set()
    for q, kind, a in {(s[0], x[1], x[0]) for s in sources for x in artefacts}:
        found = []
        for _, n, name, page in (s for s in sources if s[0] == q):
            hits = [(1 if x[2] and name and x[2][2] == name[0] else 2, x[0]) for x in artefacts if x[1] == kind and page and x[3] == int(page)]
            found += [(n, tier, i) for tier, i in hits]
        best = {n: min(t for m, t, _ in found if m == n) for n in {m for m, _, _ in found}}
        mine = [(n, t) for n, t, i in found if i == a and t == best[n]]
        want |= {(q, min(mine)[0], kind, min(mine)[1], a)} if mine else set()
    frames = spark.createDataFrame(sources, "query_id long, source_no int, name string, page string"), spark.createDataFrame(artefacts, "artefact_id long, kind string, source_path string, page_number int, body array<string>")
    for size in (4096, 7):
        monkeypatch.setattr(rs, "SOURCES_PER_ROW", size)
        out = rs.attach_artefacts(*frames)
        rows = [(r.query_id, r.source_no, r.kind, r.tier, r.artefact_id) for r in out.collect()]
        assert set(rows) == want and len(rows) == len(want) > 100
    plan = [line for line in out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines() if "Exchange hashpartitioning" in line]
    assert not [line for line in plan if "hashpartitioning(query_id" in line and "artefact_id" in line] and any("hashpartitioning(part" in line for line in plan), plan
