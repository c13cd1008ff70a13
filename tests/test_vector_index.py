"""The stored vector index against a full search, with ties, copies, empty and odd vectors."""

import numpy as np
import pytest

from citadex.operators.dense import dense_search
from citadex.operators.reuse import semantic_reuse
from citadex.operators.vector_index import build_vector_index, candidates, read_vector_index, vector_search

SCHEMA = "node_id long, embedding array<double>"


@pytest.fixture(scope="module")
def rows():
    """Clusters, copies of one vector, null, empty and zero ones."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 17))
    out = [(i, (centres[i % 12] + 0.3 * rng.normal(size=17)).tolist()) for i in range(600)]
    out += [(i, out[5][1]) for i in range(600, 700)]
    return [*out, (700, None), (701, []), (702, [0.0] * 17)]


@pytest.mark.parametrize("width", [1, 2, 3])
@pytest.mark.parametrize("k", [1, 7])
def test_equals_a_full_search(spark, tmp_path, rows, width, k):
    nodes = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([(i, x) for i, x in rows if i % 40 == 0 or i > 697], "query_id long, embedding array<double>")
    build_vector_index(nodes, str(tmp_path / "v"), sample=300, width=width)
    index = read_vector_index(spark, str(tmp_path / "v"))
    for exclude in (False, True):
        got = vector_search(asked, index, k, exclude_self=exclude).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, dense_search(asked, nodes, k, exclude_self=exclude).collect()))


def test_few_pairs_are_scored(spark, tmp_path, rows):
    nodes = spark.createDataFrame([r for r in rows if r[0] < 600], SCHEMA)
    asked = nodes.where("node_id % 20 = 0").withColumnRenamed("node_id", "query_id")
    build_vector_index(nodes, str(tmp_path / "v"))
    index = read_vector_index(spark, str(tmp_path / "v"))
    assert candidates(asked, index, 10).count() < 0.05 * 30 * 600
    plan = index.codes.groupBy("list", "block").cogroup(index.codes.groupBy("list", "block")).applyInPandas(lambda a, b: a, index.codes.schema)
    assert "Exchange" not in plan._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_a_floor_and_an_empty_index(spark, tmp_path, rows):
    nodes = spark.createDataFrame(rows, SCHEMA)
    asked = nodes.where("node_id % 50 = 1").withColumnRenamed("node_id", "query_id")
    build_vector_index(nodes, str(tmp_path / "v"))
    want = semantic_reuse(asked, nodes.withColumnRenamed("node_id", "entry_id"), 0.9, exclude_self=True)
    got = semantic_reuse(asked, None, 0.9, exclude_self=True, index=read_vector_index(spark, str(tmp_path / "v")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    build_vector_index(nodes.limit(0), str(tmp_path / "none"))
    assert vector_search(asked, read_vector_index(spark, str(tmp_path / "none")), 3).count() == 0
