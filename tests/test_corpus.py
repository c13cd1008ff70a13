"""Corpus preparation, sources and the stored index."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from citadex.functions.hooks import hashed_encoder, model_encoder, model_pair_scorer
from citadex.operators import corpus as co
from citadex.operators.lexical import bm25_search, build_lexical_index
from citadex.sources import feedback_files as ff
from citadex.sources import glossary as gl
from citadex.sources.documents import read_documents
from citadex.sources.index_store import append_nodes, read_index, write_index
from citadex.sources.query_log import append_query_log, read_query_log


def test_tables(spark):
    rows = [
        (1, [["a", "b", "a", "a"], ["1", None, "3", "4"], ["5"]]), (2, [["only header"]]),
        (3, [["x", "x", "x_2"], ["1", "2", "3"]]), (4, [["h"], ["1", "2"]]),
    ]
    df = spark.createDataFrame(rows, "id int, rows array<array<string>>")
    got = {r.id: r for r in co.normalise_tables(df).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1].header == ["a", "b", "a_2", "a_3"] and (got[1].row_count, got[1].column_count) == (2, 4)
    assert json.loads(got[1].table_json) == [{"a": "1", "b": None, "a_2": "3", "a_3": "4"}, {"a": "5", "b": None, "a_2": None, "a_3": None}]
    assert got[1].table_markdown.split("\n")[:3] == ["| a | b | a_2 | a_3 |", "|---|---|---|---|", "| 1 |  | 3 | 4 |"]
    assert got[3].header == ["x", "x_1", "x_2"]
    assert got[4].header == ["h", "column_1"]


def test_captions(spark):
    text = "Intro\n  Figure 1: the pump \nfig. 2\nA long Diagram line\nnothing to see"
    df = spark.createDataFrame([("m.pdf", 3, text)], "source_path string, page_number int, text string")
    got = [(r.line_number, r.caption_text) for r in co.find_captions(df).orderBy("line_number").collect()]
    assert got == [(2, "Figure 1: the pump"), (4, "A long Diagram line")]


def test_artefact_nodes_share_one_key_set(spark):
    tables = co.normalise_tables(spark.createDataFrame([("/d/m.pdf", 2, 0, [["a"], ["1"]])], "source_path string, page_number int, table_index int, rows array<array<string>>"))
    images = spark.createDataFrame([("/d/m.pdf", 4, 1, 10, 20, "a pump", None)], "source_path string, page_number int, image_index int, width int, height int, caption string, bbox string")
    got = {r.content_type: (r.file_name, r.page_label, r.text) for r in co.artefact_nodes(tables, None, images).collect()}
    assert got == {
        "table": ("m.pdf", "2", "Table from m.pdf, page 2:\n| a |\n|---|\n| 1 |"), "image": ("m.pdf", "4", "Image from m.pdf, page 4: a pump"),
    }


@pytest.mark.parametrize("n", [1, 9, 10, 11, 16, 17, 200])
def test_windows_rebuild_the_text(spark, n):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(7, " ".join(words))], "doc_id long, text string")
    rows = co.chunk_window(df, size=10, overlap=4).orderBy("chunk_ix").collect()
    chunks = [r.text.split(" ") for r in rows]
    assert sum((c if i == 0 else c[4:] for i, c in enumerate(chunks)), []) == words
    assert all(len(c) <= 10 for c in chunks) and rows[0].node_id == "7-0"


def test_empty_texts_give_no_chunk(spark):
    df = spark.createDataFrame([(1, ""), (2, " \n "), (3, None)], "doc_id long, text string")
    assert co.chunk_window(df).count() == 0 and co.chunk_sentences(df.dropna()).count() == 0


def test_sentences_are_kept_whole(spark):
    text = "One two three. Four five six! Seven eight nine? " + " ".join(f"x{i}" for i in range(25)) + "."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r.text for r in co.chunk_sentences(df, size=8, overlap=3).orderBy("chunk_ix").collect()]
    assert got[:2] == ["One two three. Four five six!", "Four five six! Seven eight nine?"]
    assert all(len(c.split()) <= 8 for c in got)
    assert set(" ".join(got).split()) == set(text.split())


def packed_by_hand(text, size, overlap):
    pieces = []
    for sentence in re.split(r"(?<=[.!?])(?=[ \t\n\v\f\r])|\n", text):
        words = sentence.split()
        pieces += [words[i : i + size] for i in range(0, len(words), size)]
    chunks, current = [], []
    for piece in pieces:
        if current and sum(map(len, current)) + len(piece) > size:
            chunks.append(current)
            tail = []
            for old in reversed(current):
                used = sum(map(len, tail)) + len(old)
                if used > overlap or used + len(piece) > size:
                    break
                tail.insert(0, old)
            current = tail
        current = [*current, piece]
    return [" ".join(w for p in c for w in p) for c in chunks + ([current] if current else [])]


def test_sentence_chunks_equal_a_plain_fold(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "bb", "c.", "d!", "e?", "f...", ".", "g\n", "h.\ni"]) for _ in range(rng.randint(0, 300))) for _ in range(40)] + ["one two. " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((8, 3), (20, 0), (5, 5), (350, 88), (1, 0)):
        out = co.chunk_sentences(df, size, overlap)
        assert "Python" not in out._jdf.queryExecution().toString()
        got = {}
        for r in out.orderBy("doc_id", "chunk_ix").collect():
            got.setdefault(r.doc_id, []).append(r.text)
        assert got == {i: want for i, t in enumerate(texts) if (want := packed_by_hand(t, size, overlap))}


def test_page_blocks(spark):
    html = '<h1>Top &amp; title</h1><p class="x">One <b>bold</b></p><pre>no</pre><ul><li><a href="/u">link</a></li></ul><img src="i" alt="a pump"><figcaption>Fig</figcaption>'
    html += """<a class=x href='/single'>s</a><a href=/bare>b</a><img alt='one "two"' src=i><!-- <p>comment</p> --><script>var p = "<p>script</p>";</script>"""
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = {(r.kind, r.content_type, r.text) for r in co.page_blocks(df).collect()}
    assert got == {
        ("heading", "text", "Top &amp; title"), ("paragraph", "text", "One bold"), ("list_item", "text", "link"), ("link", "text", "/u"),
        ("link", "text", "/single"), ("link", "text", "/bare"), ("image", "image", 'one "two"'), ("image", "image", "a pump"), ("caption", "figure_caption", "Fig"),
    }


def test_glossary_csv(spark, tmp_path):
    path = tmp_path / "glossary.csv"
    path.write_text('term,definition,aliases\nPPU, printhead power unit ,PPU | power unit||\nempty,,x\n"Q","quoted, with comma",\n')
    got = [(r.term, r.definition, r.aliases, r.file_name) for r in gl.read_glossary(spark, str(path)).orderBy("term").collect()]
    assert got == [("PPU", "printhead power unit", ["PPU", "power unit"], "glossary.csv"), ("Q", "quoted, with comma", [], "glossary.csv")]
    assert gl.read_glossary(spark, "nothing.xyz").count() == 0


def test_glossary_lines(spark):
    text = "Alpha: first - one\nBeta - second\nno separator\nX: too short\nGamma:  g\n: none\nDelta : two: parts"
    df = spark.createDataFrame([(1, text)], "page int, text string")
    got = [(r.term, r.definition) for r in gl.glossary_from_lines(df).orderBy("line_ix").collect()]
    assert got == [("Alpha", "first - one"), ("Beta", "second"), ("Delta", "two: parts")]


def test_text_documents(spark, tmp_path):
    (tmp_path / "one.txt").write_text("first\nfile")
    (tmp_path / "two.txt").write_text("second")
    got = {(r.file_name, r.page_label, r.content_type, r.text) for r in read_documents(spark, str(tmp_path), "text").collect()}
    assert got == {("one.txt", "N/A", "text", "first\nfile"), ("two.txt", "N/A", "text", "second")}


def test_index_round_trip_append_and_missing(spark, tmp_path):
    nodes = spark.createDataFrame([(i, f"alpha w{i % 7} w{i % 3}") for i in range(60)], "node_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "alpha w6")], "query_id long, query string")
    want = sorted(map(tuple, bm25_search(asked, build_lexical_index(nodes), 5).collect()))
    path = str(tmp_path / "index")
    write_index(nodes, path)
    assert sorted(map(tuple, bm25_search(asked, read_index(spark, path).lexical, 5).collect())) == want
    write_index(nodes.where("node_id < 20"), path)
    append_nodes(nodes.where("node_id BETWEEN 20 AND 39"), path)
    for _ in range(2):  # an append that is run again changes nothing
        append_nodes(nodes.where("node_id >= 35").union(nodes.where("node_id = 50")), path)
    opened = read_index(spark, path)
    assert sorted(map(tuple, bm25_search(asked, opened.lexical, 5).collect())) == want and opened.nodes.count() == 60
    with pytest.raises(FileNotFoundError, match="no index at"):
        read_index(spark, str(tmp_path / "none"))


def test_feedback_array_file_and_migration(spark, tmp_path):
    path = tmp_path / "feedback.json"
    path.write_text(json.dumps([
        {"id": "1", "timestamp": "2024-01-01T00:00:00", "user": "u_1", "query": "q", "answer": "a", "is_helpful": True, "sources": ["s", "t"]},
        {"id": "2", "query": "q2"},
    ]))
    df = ff.read_feedback_json(spark, str(path))
    rows = ff.feedback_export_rows(df).orderBy("query").collect()
    assert rows[0].sources == "s, t" and rows[1].user == "" and rows[1].sources == "" and rows[0].is_helpful == "true"
    log = {r.query_text: r for r in ff.migrate_log(df).collect()}
    assert log["q"].query_id == "u_1_2024-01-01T00:00:00" and log["q"].intent_confidence == 0.8 and log["q"].session_id == "migrated"
    assert set(log) == {"q"} and [r.query for r in ff.migration_errors(df).collect()] == ["q2"]
    log = {r.query_text: r for r in ff.migrate_log(df, "2024-02-01T00:00:00").collect()}
    assert log["q2"].query_id == "Unknown_2024-02-01T00:00:00" and log["q2"].answer_text == "" and log["q2"].intent_type == "unknown"
    assert {r.query_id for r in ff.migrate_feedback(df, "2024-02-01T00:00:00").collect()} == {r.query_id for r in log.values()}
    assert tuple(ff.migration_counts(df).first()) == (1, 1)


def test_query_log_is_partitioned_by_day(spark, tmp_path):
    rows = spark.sql(
        "SELECT 'u' AS user, 'q' AS query_text, 'a' AS answer_text, 'lookup' AS intent_type, 0.6D AS intent_confidence, array('s') AS sources, "
        "0.25D AS confidence, 10L AS response_time_ms, CAST(NULL AS STRING) AS session_id, timestamp'2024-01-02 03:04:05.678901' + make_interval(0,0,0,CAST(id AS INT)) AS ts FROM range(3)"
    )
    path = str(tmp_path / "log")
    append_query_log(rows, path)
    log = read_query_log(spark, path)
    first = log.where("dt = DATE'2024-01-02'")
    row = first.collect()
    assert [(r.query_id, r.session_id, r.confidence) for r in row] == [("u_2024-01-02T03:04:05.678901", "unknown", 0.25)]
    assert "PartitionFilters: [isnotnull(dt" in first._jdf.queryExecution().executedPlan().toString()


def test_hooks(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, ""), (3, "b a b")], "i int, text string")
    got = {r.i: r.v for r in df.select("i", hashed_encoder(16)(F.col("text")).alias("v")).collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and sum(got[2]) == 0 and got[1] == got[3]
    length = model_encoder(lambda: lambda texts: [[float(len(t))] for t in texts])
    pair = model_pair_scorer(lambda: lambda qs, ts: [float(len(q) + len(t)) for q, t in zip(qs, ts, strict=True)])
    row = df.where("i = 1").select(length(F.col("text")).alias("v"), pair(F.col("text"), F.col("text")).alias("p")).first()
    assert row.v == [5.0] and row.p == 10.0
