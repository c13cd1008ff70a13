"""Log analytics against brute force, with a user that holds a third of all rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from citadex.operators import analytics as an

SCHEMA = (
    "query_id string, user string, query_text string, intent_type string, confidence double, intent_confidence double, "
    "response_time_ms long, session_id string, ts timestamp_ntz, dt date"
)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = []
    for i in range(900):
        user = "hot_user" if i % 3 == 0 else f"u{rng.randint(0, 8)}"
        ts = datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 30 * 86400))
        out.append((f"{user}_{i}", user, f"q{rng.randint(0, 2)}", rng.choice("abc"), rng.randint(0, 100) / 100, 0.5, rng.randint(1, 3000), f"{user}-{ts.day}", ts, ts.date()))
    return out


@pytest.fixture(scope="module")
def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def per_user(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[8], r[0])):
        out[r[1]].append(r)
    return out


@pytest.mark.parametrize("slot", ["hour", "day"])
def test_recent_history(log, rows, slot):
    want = set()
    for user, mine in per_user(rows).items():
        fresh = [r for i, r in enumerate(mine) if i == 0 or mine[i - 1][2] != r[2]]
        want |= {(user, r[0], n) for n, r in enumerate(reversed(fresh), 1) if n <= 7}
    assert {(r.user, r.query_id, r.nth) for r in an.recent_history(log, 7, slot).collect()} == want


@pytest.mark.parametrize("hours", [1, 24])
def test_gap_sessions(log, rows, hours):
    want = set()
    for user, mine in per_user(rows).items():
        runs = [[mine[0]]]
        for a, b in zip(mine, mine[1:], strict=False):
            (runs.append([b]) if b[8] - a[8] >= timedelta(hours=hours) else runs[-1].append(b))
        want |= {(user, n, len(run), int((run[-1][8] - run[0][8]).total_seconds())) for n, run in enumerate(runs, 1)}
    got = {(r.user, r.session_no, r.n_queries, r.duration_s) for r in an.gap_sessions(log, hours).collect()}
    assert got == want


def test_user_history(log, rows):
    want = [r[0] for r in reversed(per_user(rows)["hot_user"])][:5]
    assert [r.query_id for r in an.user_history(log, "hot_user", n=5).collect()] == want
    batch = [r.query_id for r in an.user_history(log, n=5).where("user = 'hot_user'").orderBy("nth").collect()]
    assert batch == want
    assert an.user_history(log, "hot_user", "2024-02-15").count() == 0


def test_lookup_by_id_with_underscores(spark, log, rows):
    ids = spark.createDataFrame([(rows[0][0],), (rows[0][0],), ("nobody_1",)], "query_id string")
    assert [(r.query_id, r.user) for r in an.query_by_id(log, ids).collect()] == [(rows[0][0], "hot_user")]


def test_metrics(log, rows):
    for days, noon in ((7, 0), (30, 0), (7, 12)):  # the last questions come after the date, and do not count
        now, asof = datetime(2024, 1, 25, noon), f"2024-01-25 {noon:02d}:00:00"
        mine = [r for r in rows if now - timedelta(days=days) <= r[8] <= now]
        assert mine and len(mine) < sum(r[8] >= now - timedelta(days=days) for r in rows)
        m = an.average_metrics(log, days, asof).first()
        assert m.total_queries == len(mine)
        assert m.avg_confidence == pytest.approx(sum(r[4] for r in mine) / len(mine))
        dist = {r.intent_type: (r.n, r.is_top) for r in an.intent_distribution(log, days, asof).collect()}
        counts = {i: sum(r[3] == i for r in mine) for i in "abc"}
        assert {i: n for i, (n, _) in dist.items()} == counts
        assert dist[max(counts, key=lambda i: (counts[i], i))][1] and sum(t for _, t in dist.values()) == 1
        ranges = {r.intent_type: r.total_queries for r in an.metrics_by_range(log, asof).where(f"days = {days}").collect()}
        assert ranges == counts


def test_empty_log_and_votes(spark, log):
    none = spark.createDataFrame([], "query_id string, is_helpful boolean")
    assert tuple(an.feedback_stats(none).first()) == (0, 0, 0, 0.0)
    m = an.average_metrics(log.where("false"), 7, "2024-01-31").first()
    assert tuple(m) == (0.0, 0.0, 0.0, 0)
    h = an.health(log.where("false"), none, 7, "2024-01-31").first()
    assert (h.speed, h.quality, h.recommendations) == ("excellent", "low", ["not enough data"])


def test_health(spark, log):
    votes = spark.createDataFrame([("x", True)] * 9 + [("x", False)], "query_id string, is_helpful boolean")
    h = an.health(log, votes, 30, "2024-01-31").first()
    assert h.helpful_rate == 0.9 and h.speed == "good" and "high helpful rate" in h.recommendations and "low confidence scores" in h.recommendations


def test_sessions(log, rows):
    s = an.session_stats(log, "2024-01-20 00:00:00").where("session_id = 'hot_user-3'").first()
    mine = [r for r in rows if r[7] == "hot_user-3"]
    assert (s.n_queries, s.user, s.expired) == (len(mine), "hot_user", True)


VOTES = "id string, timestamp string, query string, answer string, is_helpful boolean"


def test_upsert_lookup_delete(spark):
    long = "x" * 100
    old = spark.createDataFrame([("1", "2024-01-01", "q", long + "A", True), ("2", "2024-01-02", "q", "other", False)], VOTES)
    new = spark.createDataFrame([("3", "2024-01-03", "q", long + "B", False), ("4", "2023-01-01", "q", "other", True), ("5", "2024-01-04", "q", long + "A", False)], VOTES)
    merged = an.upsert_feedback(old, new)
    assert sorted((r.id, r.is_helpful) for r in merged.collect()) == [("2", False), ("3", False), ("5", False)]  # A and B share 100 characters
    assert sorted(r.id for r in an.upsert_feedback(merged, new.limit(0)).collect()) == ["2", "3", "5"]
    pairs = spark.createDataFrame([("q", long + "B"), ("q", long + "C"), ("q", "none")], "query string, answer string")
    assert {r.answer[-1]: r.rating for r in an.rating_of(pairs, merged).collect()} == {"B": False, "C": None, "e": None}
    ids = spark.createDataFrame([("2",)], "id string")
    assert sorted(r.id for r in an.delete_feedback(merged, ids).collect()) == ["3", "5"]


def test_latest_rating_of_a_source(spark):
    df = spark.createDataFrame([("a", True, datetime(2024, 1, 2)), ("a", False, datetime(2024, 1, 3)), ("a", True, datetime(2024, 1, 1))], "source string, rating boolean, ts timestamp")
    assert [(r.source, r.rating) for r in an.latest_ratings(df, "source").collect()] == [("a", False)]
