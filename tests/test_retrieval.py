"""Retrieval and fusion against brute force on small corpora."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from citadex.operators import fusion as fu
from citadex.operators.dense import dense_search, probed_search
from citadex.operators.lexical import bm25_search, build_lexical_index

K = 5


@pytest.fixture(scope="module")
def corpus():
    """A third of all nodes are copies, and one word is in every node and every question."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(120)]
    texts = {i: "the " + " ".join(rng.choices(vocabulary, k=rng.randint(3, 40))) for i in range(200)}
    texts.update({i: texts[0] for i in range(200, 300)})
    texts[300] = "   "
    questions = {q: "the the " + " ".join(rng.choices(vocabulary, k=rng.randint(1, 8))) for q in range(25)}
    questions[25], questions[26] = "the", "unseen"
    return texts, questions


def brute_bm25(texts, questions, k):
    docs = {i: t.lower().split() for i, t in texts.items() if t.split()}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for d in docs.values() for t in set(d))
    raw = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    out = set()
    for q, text in questions.items():
        scores = {}
        for i, d in docs.items():
            tf = Counter(d)
            s = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for t in text.split() if t in tf)
            if round(s, 6) > 0:
                scores[i] = round(s, 6)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(q, i, s, r) for r, (i, s) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("prune", [True, False])
def test_bm25_equals_brute_force(spark, corpus, broadcast, prune):
    texts, questions = corpus
    nodes = spark.createDataFrame(list(texts.items()), "node_id long, text string")
    asked = spark.createDataFrame(list(questions.items()), "query_id long, query string")
    hits = bm25_search(asked, build_lexical_index(nodes), K, broadcast=broadcast, prune=prune)
    got = {(r.query_id, r.node_id, r.score, r.rank) for r in hits.collect()}
    assert got == brute_bm25(texts, questions, K)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    matrix = rng.standard_normal((400, 16)).astype(np.float32)
    matrix[250:] = matrix[0]  # a third are copies
    return matrix


def brute_dense(matrix, asked, k):
    unit = matrix.astype(float) / np.linalg.norm(matrix.astype(float), axis=1, keepdims=True)
    out = set()
    for q in asked:
        scores = np.round(unit @ unit[q], 6)
        best = sorted((i for i in range(len(unit)) if i != q), key=lambda i: (-scores[i], i))[:k]
        out |= {(q, i, r) for r, i in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_dense_equals_brute_force(spark, vectors, broadcast, monkeypatch):
    monkeypatch.setattr("citadex.operators.dense.BLOCK_ROWS", 60)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    nodes = spark.createDataFrame(rows, "node_id long, embedding array<float>")
    asked = spark.createDataFrame(rows[:70], "query_id long, embedding array<float>")
    monkeypatch.setattr("citadex.operators.dense.QUESTION_ROWS", 16)
    hits = dense_search(asked, nodes, K, exclude_self=True, broadcast=broadcast)
    assert {(r.query_id, r.node_id, r["rank"]) for r in hits.collect()} == brute_dense(vectors, range(70), K)


def test_probed_search_finds_most_of_the_exact_result(spark, vectors):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors[:250])]
    nodes = spark.createDataFrame(rows, "node_id long, embedding array<float>")
    asked = spark.createDataFrame(rows[:40], "query_id long, embedding array<float>")
    exact = {(r.query_id, r.node_id) for r in dense_search(asked, nodes, K).collect()}
    near = {(r.query_id, r.node_id) for r in probed_search(asked, nodes, K, bits=4, radius=2).collect()}
    every = {(r.query_id, r.node_id) for r in probed_search(asked, nodes, K, bits=3, radius=3).collect()}
    assert every == exact
    assert len(near & exact) / len(exact) > 0.7


def loop_window(scores, k):
    floor = round(float(np.mean(scores) - 0.5 * np.std(scores)), 6)
    kept = []
    for s in scores:
        if s >= floor or len(kept) < k:
            kept.append(s)
        if len(kept) >= 2 * k:
            break
    return len(kept)


def test_dynamic_window_equals_the_walk(spark):
    rng = random.Random(1)
    lists = {q: sorted((round(rng.random() ** rng.choice([1, 4]), 6) for _ in range(rng.randint(1, 30))), reverse=True) for q in range(200)}
    lists[200], lists[201] = [0.3] * 12, [0.1]
    rows = [(q, i, s) for q, scores in lists.items() for i, s in enumerate(scores)]
    hits = spark.createDataFrame(rows, "query_id long, node_id long, score double")
    got = {r.query_id: r["count"] for r in fu.dynamic_window(hits, 4).groupBy("query_id").count().collect()}
    assert got == {q: loop_window(scores, 4) for q, scores in lists.items()}


@pytest.fixture(scope="module")
def two_lists(spark):
    dense = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.6), (2, 10, -0.2)], "query_id long, node_id long, score double")
    sparse = spark.createDataFrame([(1, 11, 8.0), (1, 12, 4.0)], "query_id long, node_id long, score double")
    return dense, sparse


def test_fuse(two_lists):
    dense, sparse = two_lists
    got = {(r.query_id, r.node_id): r.score for r in fu.fuse(dense, sparse, 0.5).collect()}
    assert got == {(1, 10): 0.5, (1, 11): 0.833333, (1, 12): 0.25, (2, 10): 0.0}
    only_dense = {(r.query_id, r.node_id): r.score for r in fu.fuse(dense, sparse, 1.0).collect()}
    assert only_dense[1, 10] == 1.0 and only_dense[1, 12] == 0.0
    only_sparse = {(r.query_id, r.node_id): r.score for r in fu.fuse(dense, sparse, 0.0).collect()}
    assert only_sparse[1, 11] == 1.0 and only_sparse[1, 10] == 0.0


def test_dedupe_is_idempotent(spark):
    hits = spark.createDataFrame([(1, 0, 5, 0.2), (1, 1, 5, 0.7), (1, 2, 6, 0.7)], "query_id long, variant_ix int, node_id long, score double")
    once = fu.dedupe_hits(hits)
    assert [tuple(r) for r in once.orderBy("rank").collect()] == [(1, 5, 0.7, 0, 1), (1, 6, 0.7, 2, 2)]
    assert sorted(map(tuple, fu.dedupe_hits(once.drop("rank")).collect())) == sorted(map(tuple, once.collect()))


def test_rerank_leaves_a_single_row(spark):
    rows = [(1, 5, 0.4, 1, "alpha beta", "beta"), (2, 5, 0.4, 1, "alpha beta", "beta"), (2, 6, 0.3, 2, "alpha beta", "alpha beta")]
    hits = spark.createDataFrame(rows, "query_id long, node_id long, score double, rank int, query string, text string")
    got = {(r.query_id, r["rank"]): (r.node_id, r.score, r.fused) for r in fu.rerank(hits).collect()}
    assert got == {(1, 1): (5, 0.4, 0.4), (2, 1): (6, 1.0, 0.3), (2, 2): (5, 0.5, 0.4)}


def test_blend_keeps_rows_without_verdict(spark):
    hits = spark.createDataFrame([(1, n, 1.0 - n / 10, n + 1) for n in range(5)], "query_id long, node_id long, score double, rank int")
    verdicts = spark.createDataFrame([(1, 0, 0.0, 0.9), (1, 1, 1.0, 0.5), (1, 4, 1.0, 0.9)], "query_id long, node_id long, relevance_score double, confidence double")
    got = {r.node_id: r.score for r in fu.blend_scores(hits, verdicts).collect()}
    assert got == {0: 0.8, 1: 0.9, 2: 0.8, 3: 0.7, 4: 0.6}


def test_content_filter(spark):
    df = spark.createDataFrame([(1, "text"), (2, "table"), (3, "image"), (4, None)], "node_id long, content_type string")
    ids = lambda d: sorted(r.node_id for r in d.collect())
    assert ids(fu.filter_content(df, ["table"])) == [2]
    assert ids(fu.filter_content(df, ["table"], always_text=True)) == [1, 2, 4]
    assert ids(fu.filter_content(df)) == [1, 2, 3, 4]
