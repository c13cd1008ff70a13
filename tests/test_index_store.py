"""Segments and shards of a stored index: search, replacement, removal, merging, what is read and what is shuffled."""

import random

import numpy as np
import pyarrow as pa
import pytest

from citadex.operators import sharded
from citadex.operators.lexical import bm25_search, build_lexical_index
from citadex.sources import index_store as ix


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(90)]
    return {i: "the " + " ".join(rng.choices(words, weights=range(90, 0, -1), k=rng.randint(2, 30))) for i in range(160)} | {200: "  ", 201: "the"}


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(5)
    rows = [(q, "the the " + " ".join(f"w{rng.randrange(95)}" for _ in range(rng.randint(1, 6)))) for q in range(20)] + [(20, "the"), (21, "unseen"), (22, "")]
    return spark.createDataFrame(rows, "query_id long, query string")


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "node_id long, text string")


def hits(asked, lexical, k=5):
    return sorted((r.query_id, r.node_id, round(r.score, 5), r["rank"]) for r in bm25_search(asked, lexical, k).collect())


def same(spark, path, texts, asked):
    opened, want = ix.read_index(spark, path), build_lexical_index(frame(spark, texts))
    assert hits(asked, opened.lexical) == hits(asked, want)
    assert sorted(map(tuple, opened.nodes.select("node_id", "text").collect())) == sorted(texts.items())
    columns = ["node_id", "dl", "term", "tf"]
    assert sorted(map(tuple, opened.lexical.postings.select(columns).collect())) == sorted(map(tuple, want.postings.select(columns).collect()))
    terms = [{r.term: (r.df, round(r.idf, 9)) for r in x.weighted_terms().collect()} for x in (opened.lexical, want)]
    assert terms[0] == terms[1]


def test_segments_equal_one_fresh_index(spark, tmp_path, texts, asked, monkeypatch):
    monkeypatch.setattr(sharded, "NODES_PER_SHARD", 30)
    path = str(tmp_path / "index")
    old = {i: f"old {t}" for i, t in texts.items() if i % 3 == 0}
    ix.write_index(frame(spark, {i: t for i, t in texts.items() if i < 60} | {i: t for i, t in old.items() if i < 60}), path)
    ix.append_nodes(frame(spark, {i: t for i, t in texts.items() if 60 <= i < 130}), path)
    ix.append_nodes(frame(spark, {i: "no" for i in range(50, 70)} | {i: t for i, t in texts.items() if i >= 130} | {999: "the w1 gone"}), path)
    ix.replace_nodes(frame(spark, {i: texts[i] for i in old}), path)
    ix.remove_nodes(frame(spark, {999: "", 12345: ""}).select("node_id"), path)
    same(spark, path, texts, asked)
    live = ix.segments(spark, path)
    assert len(live) == 5
    assert ix.compact_index(spark, path, 3) and len(ix.segments(spark, path)) == 3
    same(spark, path, texts, asked)
    assert ix.drop_replaced(spark, path) >= 3
    assert ix.compact_index(spark, path, 1) and len(ix.segments(spark, path)) == 1
    same(spark, path, texts, asked)
    assert not ix.compact_index(spark, path, 1)
    ix.write_index(frame(spark, {1: "new"}), path)
    assert [r.node_id for r in ix.read_index(spark, path).nodes.collect()] == [1]


def test_an_append_reads_ids_of_likely_segments_only(spark, tmp_path, texts, monkeypatch):
    path = str(tmp_path / "index")
    for part in range(4):
        ix.append_nodes(frame(spark, {i: t for i, t in texts.items() if i // 40 == part and i < 160}), path)
    live, read = ix.segments(spark, path), []
    real = ix._tagged
    monkeypatch.setattr(ix, "_tagged", lambda s, parts, table: read.append((table, [p.name for p in parts])) or real(s, parts, table))
    found = ix.held(spark, live, frame(spark, {45: "", 50: "", 5000: ""}).select("node_id"))
    assert sorted((r.node_id, r.target) for r in found.collect()) == [(45, live[1].name), (50, live[1].name)]
    assert [names for table, names in read if table == "nodes"] == [[live[1].name]]
    assert ix.held(spark, live, frame(spark, {7000: ""}).select("node_id")).count() == 0


def test_no_posting_is_shuffled_and_none_is_read_to_open(spark, tmp_path, texts, asked):
    path = str(tmp_path / "index")
    ix.write_index(frame(spark, texts), path)
    lexical = ix.read_index(spark, path).lexical
    for df in (lexical.stats, lexical.terms):
        assert "/blocks" not in "".join(df.inputFiles())
    plan = bm25_search(asked, lexical, 5)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("== Initial Plan ==")[-1].splitlines()
    at = next(i for i, line in enumerate(lines) if "FlatMapCoGroupsInArrow" in line)
    scan = next(i for i, line in enumerate(lines[at:], at) if "FileScan" in line and "blocks_" in line)
    above = [line for line in lines[at:scan] if "Exchange" in line and "Broadcast" not in line]
    assert not above, plan


def test_string_ids_and_vectors(spark, tmp_path):
    path = str(tmp_path / "index")
    nodes = spark.createDataFrame([("a", "red fish"), ("b", "blue fish"), ("c", None), ("d", "red red")], "node_id string, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "node_id string, embedding array<double>")
    ix.write_index(nodes.where("node_id <> 'd'"), path, vectors)
    ix.append_nodes(nodes, path, vectors)
    ix.remove_nodes(nodes.where("node_id = 'b'").select("node_id"), path)
    opened = ix.read_index(spark, path, with_vectors=True)
    asked = spark.createDataFrame([(1, "red fish")], "query_id long, query string")
    want = build_lexical_index(nodes.where("node_id <> 'b'"))
    assert hits(asked, opened.lexical) == hits(asked, want)
    assert [r.node_id for r in opened.vectors.collect()] == ["a"]


def test_cells_below_the_floor_are_skipped():
    rng = np.random.default_rng(1)
    lists = {"rare": rng.choice(4000, 12, replace=False), "often": np.arange(4000)}
    rows = []
    for term, nodes in lists.items():
        tf = np.where(np.isin(nodes, lists["rare"]), 3, 1)
        cells = nodes * 7919 % sharded.CELLS
        order = np.argsort(cells, kind="stable")
        nodes, tf, cells = nodes[order], tf[order], cells[order]
        each = [cells == c for c in np.unique(cells)]
        rows.append({"term": term, "cells": np.unique(cells), "sizes": [int(e.sum()) for e in each], "max_tfs": [int(tf[e].max()) for e in each], "min_dls": [9] * len(each), "nodes": nodes, "tfs": tf, "dls": np.full(len(nodes), 9)})
    table = pa.Table.from_pylist([{k: v.tolist() if hasattr(v, "tolist") else v for k, v in r.items()} for r in rows])
    dead = lists["rare"][:2]
    shard = sharded.Shard(table, dead, 9.0)
    ids, scores = shard.best(["rare", "often", "unseen"], [5.0, 0.01, 1.0], 8)
    want = sorted((-round(sum(w * sharded._term_weight(np.float64(3), 9.0, 9.0) for w in (5.0, 0.01)), 6), int(i)) for i in lists["rare"][2:])[:8]
    assert [(-s, int(i)) for i, s in zip(ids, scores, strict=True)] == [(pytest.approx(s), i) for s, i in want]
    assert shard.looked_at < 2000
    assert len(shard.best(["unseen"], [1.0], 8)[0]) == 0
