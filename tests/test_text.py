"""Question understanding on worked examples."""

import pytest
from pyspark.sql import functions as F

from citadex.functions import text as tx
from citadex.operators import understanding as un
from citadex.settings import INTENT_RULES


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, query string")
    return [r.out for r in df.select("i", expression(F.col("query")).alias("out")).orderBy("i").collect()]


def test_clean(spark):
    got = column(spark, ["  the pritner\t is\n hot ", "printeer temprature seperator", "", "nb sp x"], tx.clean)
    assert got == ["the printer is hot", "printer temperature separator", "", "nb sp x"]


def test_acronyms(spark):
    got = column(spark, ["What is PPU?", "usb, cli and the rest", ""], tx.expand_acronyms)
    assert got == ["What is PPU? (printhead power unit)", "usb, (universal serial bus) cli (command line interface) and the rest", ""]


def test_acronyms_from_a_table(spark):
    df = spark.createDataFrame([(1, "What is PPU?"), (2, "plain")], "query_id int, query string")
    table = spark.createDataFrame([("ppu", "printhead power unit")], "acronym string, term string")
    got = {r.query_id: r.expanded for r in un.expand_with_table(df, table).collect()}
    assert got == {1: "What is PPU? (printhead power unit)", 2: "plain"}


def test_keywords_keep_order_and_repeats(spark):
    got = column(spark, ["How to fix the Überhitzung, fix it_now 42 100!", "what is the", ""], tx.keywords)
    assert got == [["fix", "überhitzung", "fix", "it_now", "100"], [], []]


@pytest.mark.parametrize("rule", INTENT_RULES, ids=lambda r: r[1])
def test_every_intent_word(spark, rule):
    needles, intent, confidence = rule
    df = spark.createDataFrame([(n, f"zzz {n.upper()} zzz") for n in needles], "n string, query string")
    for row in un.classify_intent(df).collect():
        if row.n != "versus":  # `vs` is not in `versus`, but the intent is the same
            assert (row.intent_type, row.intent_confidence) == (intent, confidence), row.n


def test_intent_order_default_and_subqueries(spark):
    rows = ["define the error", "prefix", "plain words", "aaa bbb ccc ddd eee fff", "compare a", "how to x", ""]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, query string")
    got = [(r.intent_type, r.intent_confidence, r.requires_subqueries) for r in un.classify_intent(df).orderBy("i").collect()]
    assert got == [
        ("definition", 0.9, False), ("troubleshooting", 0.85, False), ("lookup", 0.6, False), ("lookup", 0.6, True),
        ("comparison", 0.8, True), ("reasoning", 0.85, True), ("lookup", 0.6, False),
    ]


def test_user_rules_replace_the_default_ones(spark):
    df = spark.createDataFrame([("blue",), ("red",)], "query string")
    got = {r["query"]: r.intent_type for r in un.classify_intent(df, ((("blue",), "colour", 1.0),)).collect()}
    assert got == {"blue": "colour", "red": "lookup"}


def test_variations(spark):
    df = spark.createDataFrame(
        [(1, "fix error", "troubleshooting"), (2, "USB", "definition"), (3, "a", "comparison"), (4, "b", "lookup")],
        "query_id int, query string, intent_type string",
    )
    got = {}
    for r in un.rewrite_queries(df).orderBy("query_id", "variant_ix").collect():
        got.setdefault(r.query_id, []).append(r.variant)
    assert got == {
        1: ["fix error", "error fix error", "fix fix error"], 2: ["USB", "USB (universal serial bus)", "what is USB"],
        3: ["a", "a differences", "compare a"], 4: ["b"],
    }


@pytest.mark.parametrize("given,text,alpha,k", [
    ("plain  text", "plain  text", 0.5, 10),
    ("alpha:0.3 top:15 how  so", "how so", 0.3, 15),
    ("alpha:7 top:0 x", "x", 1.0, 1),
    ("alpha:x alpha:.25 top:y top:99 x", "alpha:x top:y x", 0.25, 50),
    ("top:-3 alpha:1e-1 x", "x", 0.1, 1),
    ("the alpha: is here", "the alpha: is here", 0.5, 10),
])
def test_inline_options(spark, given, text, alpha, k):
    row = un.parse_options(spark.createDataFrame([(given,)], "query string")).first()
    assert (row.query_text, row.alpha, row.top_k) == (text, alpha, k)


def test_glossary_augmentation(spark):
    glossary = spark.createDataFrame(
        [(1, "PPU", "printhead power unit", ["power unit", "PPU"]), (2, "DPI", "dots per inch", ["PPU", "resolution"]), (3, "RPM", "turns", [])],
        "entry_id long, term string, definition string, aliases array<string>",
    )
    queries = spark.createDataFrame([(1, "printhead power dots"), (2, "nothing here")], "query_id long, query string")
    hits = un.glossary_hits(queries, glossary)
    got = {r.query_id: (r.augmented_query, r.glossary_definition) for r in un.augment_queries(queries, hits).collect()}
    assert got == {
        1: ("printhead power dots (power unit | PPU | resolution)", "PPU: printhead power unit"), 2: ("nothing here", None),
    }


def test_acronyms_from_glossary(spark):
    glossary = spark.createDataFrame(
        [(1, "One", ["AB", "x", "with space", "abcdefghijk"]), (2, "Two", ["ab", "42"]), (3, "Three", [])],
        "entry_id long, term string, aliases array<string>",
    )
    assert {r.acronym: r.term for r in un.acronyms_from_glossary(glossary).collect()} == {"ab": "Two", "42": "Two"}


def test_intent_replies(spark):
    replies = [
        '```json\n{"intent_type": "reasoning", "confidence": 0.7, "keywords": ["a"], "requires_subqueries": true, "temporal_context": "recent"}\n```',
        '{"intent_type": "strange"}', "no json", '{"confidence": 0.4}',
    ]
    df = spark.createDataFrame([(i, "compare these", r) for i, r in enumerate(replies)], "i int, query string, reply string")
    got = [(r.intent_type, r.intent_confidence, r.keywords, r.requires_subqueries, r.temporal_context) for r in un.parse_intent_json(df).orderBy("i").collect()]
    ruled = ("comparison", 0.8, ["compare", "these"], True, None)
    assert got == [("reasoning", 0.7, ["a"], True, "recent"), ("lookup", 0.85, [], False, None), ruled, ruled]


def test_small_text_functions(spark):
    assert column(spark, ["x" * 41, "y" * 40], lambda c: tx.snippet(c, 40)) == ["x" * 40 + "...", "y" * 40]
    assert column(spark, ["/a/b.c/d.e.pdf", ".pdf", "plain"], tx.file_stem) == ["d.e", ".pdf", "plain"]
    modes = lambda c: tx.search_mode(c.cast("double"))
    assert column(spark, ["0.29", "0.3", "0.7", "0.71"], modes) == ["keyword", "balanced", "balanced", "semantic"]
    bands = lambda c: tx.confidence_band(c.cast("double"))
    assert column(spark, ["0.8", "0.5", "0.49"], bands) == ["high", "medium", "low"]
    key = lambda c: tx.cache_key(c, F.lit(10), F.lit(1.0))
    assert len(set(column(spark, [" What? ", "what?"], key))) == 1
    stored = lambda c: tx.from_stored(tx.to_stored(c.cast("double")))
    assert column(spark, ["3", "0.25", "-2.0"], stored) == ["3", "0.25", "-2"]
