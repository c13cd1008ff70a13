"""Votes merged in place, sums by day, hits that deepen until enough match, questions without a vector."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from citadex.operators import analytics as an
from citadex.operators import fusion as fu
from citadex.operators.dense import dense_search
from citadex.operators.lexical import build_lexical_index
from citadex.plans.answering import answer_queries, retrieve, understand
from citadex.settings import AnswerOptions
from citadex.sources import feedback_store as fs
from citadex.streaming import log_streams as st

VOTE = "id string, timestamp string, query string, answer string, is_helpful boolean"


def vote(i, key, day, helpful=True):
    return (f"v{i}", f"2024-01-{day:02d}T00:00:00", f"q{key}", f"a{key}", helpful)


def test_a_merge_rewrites_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "votes")
    first = spark.createDataFrame([vote(i, i, 1) for i in range(60)] + [vote(90, 5, 2, False)], VOTE)
    fs.merge_feedback(first, path, 16)
    files = {f for f in spark.read.parquet(path).inputFiles()}
    second = spark.createDataFrame([vote(100, 3, 3, False), vote(101, 3, 2), vote(102, 77, 1)], VOTE)
    for _ in range(2):  # again changes nothing
        fs.merge_feedback(second, path, 16)
        got = sorted(map(tuple, fs.read_feedback(spark, path).select(*first.columns).collect()))
        assert got == sorted(map(tuple, an.upsert_feedback(first, second).collect()))
    kept = files & {f for f in spark.read.parquet(path).inputFiles()}
    assert len(kept) >= len(files) - 2  # the partitions of two keys
    fs.remove_feedback(spark.createDataFrame([("v102",), ("nobody",)], "id string"), path)
    assert fs.read_feedback(spark, path).where("id = 'v102'").count() == 0 and fs.read_feedback(spark, path).count() == 60


def test_partitions_that_are_emptied_go(spark, tmp_path):
    path = str(tmp_path / "votes")
    fs.merge_feedback(spark.createDataFrame([vote(1, 1, 1), vote(2, 2, 1)], VOTE), path, 64)
    fs.remove_feedback(spark.createDataFrame([("v1",)], "id string"), path)
    assert [r.id for r in fs.read_feedback(spark, path).collect()] == ["v2"]
    with pytest.raises(FileNotFoundError):
        fs.read_feedback(spark, str(tmp_path / "none"))
    fs.remove_feedback(spark.createDataFrame([("v1",)], "id string"), str(tmp_path / "none"))


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(8)
    day = datetime(2024, 1, 1)
    rows = []
    for _ in range(400):
        ts = day + timedelta(days=rng.randrange(40), hours=rng.choice([0, 0, 5, 23]))
        rows.append((ts, ts.date(), rng.choice(["a", "b", None]), rng.choice([None, 0.25, 0.5]), rng.randrange(3000), 0.5))
    return spark.createDataFrame(rows, "ts timestamp_ntz, dt date, intent_type string, confidence double, response_time_ms long, intent_confidence double")


def test_sums_by_day_give_what_the_log_gives(spark, tmp_path, log):
    votes = spark.createDataFrame([(i % 3 > 0,) for i in range(9)], "is_helpful boolean")
    path, out = str(tmp_path / "in"), str(tmp_path / "rollup")
    for part in log.randomSplit([0.5, 0.5], 1):
        part.coalesce(1).write.mode("append").parquet(path)
    for state in ("one", "two"):  # batches that are run again replace themselves
        st.roll_up(st.follow(spark, path, log.schema, 1), out, str(tmp_path / state)).awaitTermination()
    rollup = st.read_rollup(spark, out)
    for days in (1, 7, 30):
        last = an.rollup_between(rollup, days, "2024-01-31")
        assert sorted(map(str, an.intents_of(last).collect())) == sorted(map(str, an.intent_distribution(log, days, "2024-01-31").collect()))
        assert an.health_of(last, votes).collect() == an.health(log, votes, days, "2024-01-31").collect()
        rows = [r for r in log.collect() if datetime(2024, 1, 31) - timedelta(days=days) <= r.ts <= datetime(2024, 1, 31)]
        assert an.average_metrics(log, days, "2024-01-31").first()["total_queries"] == len(rows)
    with pytest.raises(ValueError, match="date"):
        an.rollup_between(rollup, 7, "2024-01-31 12:00:00")
    assert an.health_of(rollup.limit(0), votes).first()["recommendations"] == ["not enough data"]


def test_health_scans_the_log_once(spark, tmp_path, log):
    log.write.parquet(str(tmp_path / "log"))
    votes = spark.createDataFrame([(True,)], "is_helpful boolean")
    out = an.health(spark.read.parquet(str(tmp_path / "log")), votes, 30, "2024-01-31")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_hits_deepen_until_enough_match(spark):
    hits = spark.createDataFrame([(q, n, float(1000 - n)) for q in range(3) for n in range(200 if q else 30)], "query_id long, node_id long, score double")
    asked = spark.createDataFrame([(q,) for q in range(4)], "query_id long")
    depths = []

    def search(questions, depth):
        depths.append(depth)
        return fu.top_k(hits.join(questions, "query_id", "left_semi"), depth)

    allowed = spark.range(0, 400).where("id % 20 = 19").withColumnRenamed("id", "node_id")
    got = {}
    for r in fu.matching_hits(asked, search, allowed, 4, start=8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.node_id)
    assert got == {0: [19], 1: [19, 39, 59, 79], 2: [19, 39, 59, 79]} and depths == [8, 32, 128]


def test_filters_before_and_after_the_search_agree(spark):
    rng = random.Random(6)
    nodes = spark.createDataFrame(
        [(i, f"f{i % 5}", "1", "table" if i % 9 == 0 else "text", " ".join(rng.choices(["red", "fish", "green", "cat", *(f"w{n}" for n in range(20))], k=6))) for i in range(150)],
        "node_id long, file_name string, page_label string, content_type string, text string",
    )
    vectors = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(150)], "node_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, "red fish", [1.0, 0.0, 0.5, 0.2]), (2, "green cat", None)], "query_id long, query string, embedding array<double>")
    index = build_lexical_index(nodes)
    found = []
    for mode in ("pre", "post"):
        options = AnswerOptions(top_k=3, metadata_filters={"content_type": "table"}, filter_mode=mode)
        rows = retrieve(understand(asked), nodes, index, vectors, options).collect()
        assert {r.content_type for r in rows} == {"table"} and {r.query_id for r in rows} == {1, 2}
        found.append(sorted((r.query_id, r.node_id, r["rank"]) for r in rows))
    assert found[0] == found[1]
    answers = {r.query_id: r.answer for r in answer_queries(asked, nodes, index, vectors, AnswerOptions(top_k=3)).collect()}
    assert answers[2].startswith("According to")
    assert dense_search(asked, vectors, 3).where("query_id = 2").count() == 0
    assert dense_search(asked, vectors, 3).select(F.max("rank")).first()[0] == 3
