"""Streams give what the batch operators give, drop late rows, and survive a batch that is run again."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from citadex.operators.lexical import build_lexical_index
from citadex.operators.reuse import build_validated
from citadex.sources.index_store import append_nodes, read_index
from citadex.streaming import log_streams as st

LOG = (
    "query_id string, user string, query_text string, answer_text string, intent_type string, intent_confidence double, sources array<string>, "
    "confidence double, response_time_ms long, session_id string, ts timestamp_ntz"
)


def entry(n, ts, intent="lookup", user="u"):
    return (f"{user}_{n}", user, f"q{n % 3}", f"a{n}", intent, 0.5, ["s"], 0.5, 100, None, ts)


def arrive(spark, path, *batches):
    """One file per batch, in order of arrival."""
    for rows in batches:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)
    return st.follow(spark, path, spark.createDataFrame([], LOG).schema, 1)


DAY = datetime(2024, 1, 1)


def test_daily_metrics_drop_late_rows(spark, tmp_path):
    first = [entry(i, DAY + timedelta(hours=i)) for i in range(5)]
    ahead = [entry(10, DAY + timedelta(days=3))]
    on = [entry(14, DAY + timedelta(days=3, hours=2))]  # late rows are judged by the watermark of the batch before
    late = [entry(11, DAY + timedelta(hours=1)), entry(12, DAY + timedelta(days=3, hours=1))]
    closing = [entry(13, DAY + timedelta(days=90))]
    stream = arrive(spark, str(tmp_path / "in"), first, ahead, on, late, closing)
    st.append_to(st.daily_metrics(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(str(r.start.date()), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01", 5), ("2024-01-04", 3)}


def test_sessions(spark, tmp_path):
    rows = [entry(i, DAY + timedelta(hours=h)) for i, h in enumerate([0, 5, 28, 60, 61])]
    stream = arrive(spark, str(tmp_path / "in"), rows[3:], rows[:3], [entry(9, DAY + timedelta(days=90), user="closing")])
    st.append_to(st.sessions(stream, "10 days"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = sorted(r.n_queries for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [2, 3]


def test_log_ingest_keeps_one_of_each(spark, tmp_path):
    rows = [entry(i, DAY + timedelta(hours=i * 10)) for i in range(6)]
    stream = arrive(spark, str(tmp_path / "in"), rows, rows[2:4], rows[5:])
    st.ingest_log(stream, str(tmp_path / "log"), str(tmp_path / "state"), "30 days").awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 6 and log.select("dt").distinct().count() == 3
    assert {r.session_id for r in log.collect()} == {"unknown"}


def test_votes_in_batches_and_again(spark, tmp_path):
    log = spark.createDataFrame([entry(i, DAY) for i in range(9)], LOG)
    schema = "query_id string, is_helpful boolean, ts timestamp"
    votes = [(f"u_{i % 9}", i % 4 != 0, DAY + timedelta(minutes=i * 7 % 50)) for i in range(40)]
    path = str(tmp_path / "in")
    for part in (votes[20:], votes[:20]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    out = str(tmp_path / "out")
    stream = st.follow(spark, path, spark.createDataFrame([], schema).schema, 1)
    st.collect_votes(stream, out, str(tmp_path / "state")).awaitTermination()
    assert st.read_validated(spark, out, log.where("false")).count() == 0  # the votes came first
    want = sorted(map(str, build_validated(log, spark.createDataFrame(votes, schema)).collect()))
    assert sorted(map(str, st.read_validated(spark, out, log).collect())) == want
    # the same arrivals under a fresh state, as after a lost one: batches replace themselves
    st.collect_votes(stream, out, str(tmp_path / "state2")).awaitTermination()
    assert sorted(map(str, st.read_validated(spark, out, log).collect())) == want


def test_index_grows(spark, tmp_path):
    nodes = spark.createDataFrame([(i, f"alpha w{i % 5}") for i in range(20)], "node_id long, text string")
    path, out = str(tmp_path / "in"), str(tmp_path / "index")
    for low in (0, 10):
        nodes.where(F.col("node_id").between(low, low + 9)).coalesce(1).write.mode("append").parquet(path)
    st.grow_index(st.follow(spark, path, nodes.schema, 1), out, str(tmp_path / "state")).awaitTermination()
    nodes.where("node_id < 3").coalesce(1).write.mode("append").parquet(path)  # nodes that come again
    st.grow_index(st.follow(spark, path, nodes.schema, 1), out, str(tmp_path / "state")).awaitTermination()
    append_nodes(nodes.where("node_id >= 10"), out, name="batch-1")  # a batch run again
    got = read_index(spark, out).lexical.weighted_terms()
    want = build_lexical_index(nodes).weighted_terms()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
