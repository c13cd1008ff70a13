"""Analytics over the question log and the votes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citadex.settings import METRIC_RANGES, RATIO_DIGITS


def user_history(log: DataFrame, user: str | None = None, start: str | None = None, n: int = 20) -> DataFrame:
    """Newest `n` questions of a user, or of every user when none is named."""
    if start is not None:
        log = log.where(F.col("ts") >= F.lit(start))
    if user is not None:
        return log.where(F.col("user") == user).orderBy(F.col("ts").desc(), F.col("query_id")).limit(n)
    newest = Window.partitionBy("user").orderBy(F.col("ts").desc(), F.col("query_id"))
    return log.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= n)


def query_by_id(log: DataFrame, ids: DataFrame) -> DataFrame:
    """Log rows for question ids `user_time`, split at the last underscore."""
    parts = ids.select(
        F.regexp_extract("query_id", r"(?s)^(.*)_([^_]*)$", 1).alias("user"),
        F.regexp_extract("query_id", r"(?s)^(.*)_([^_]*)$", 2).alias("_suffix"), "query_id",
    ).distinct()
    return log.join(parts.drop("_suffix"), ["user", "query_id"])


def feedback_for(feedback: DataFrame, ids: DataFrame) -> DataFrame:
    return feedback.join(ids.select("query_id").distinct(), "query_id", "left_semi")


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Totals of votes; the share is 0 when there are none."""
    counted = feedback.agg(F.count("*").alias("total"), F.count_if("is_helpful").alias("helpful"))
    share = F.coalesce(F.try_divide("helpful", "total") * 100, F.lit(0.0))
    return counted.select(
        "total", "helpful", (F.col("total") - F.col("helpful")).alias("unhelpful"),
        F.round(share, RATIO_DIGITS).alias("helpful_percentage"),
    )


def queries_between(log: DataFrame, first: str, last: str) -> DataFrame:
    """Questions of the days from `first` to `last`; `dt` is the partition column of the log."""
    return log.where(F.col("dt").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def _since(log: DataFrame, days: int, asof: str) -> DataFrame:
    """Questions of the `days` up to `asof`. The partition filter prunes days, the time filter cuts both ends exactly."""
    end = F.expr(f"TIMESTAMP_NTZ '{asof}'")
    start = F.expr(f"TIMESTAMP_NTZ '{asof}' - INTERVAL '{int(days)}' DAY")
    return log.where(
        F.col("dt").between(start.cast("date"), end.cast("date")) & F.col("ts").cast("timestamp_ntz").between(start, end)
    )


MEASURES = ("confidence", "response_time_ms", "intent_confidence")


def day_rollup(log: DataFrame) -> DataFrame:
    """Sums per day and intent, which add up: of several batches, days or shards.

    A range of days counts both ends, so what was asked exactly at midnight has rows of its own (`at_midnight`).
    """
    midnight = F.col("ts").cast("timestamp_ntz") == F.col("dt").cast("timestamp_ntz")
    sums = [x for m in MEASURES for x in (F.sum(m).alias(m), F.count(m).alias(f"n_{m}"))]
    return log.groupBy("dt", midnight.alias("at_midnight"), F.coalesce("intent_type", F.lit("unknown")).alias("intent_type")).agg(F.count("*").alias("n"), *sums)


def _added(rollup: DataFrame) -> DataFrame:
    """Sums per intent."""
    return rollup.groupBy("intent_type").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for m in MEASURES for c in (m, f"n_{m}")])


def rollup_between(rollup: DataFrame, days: int, asof: str) -> DataFrame:
    """Rows of the `days` up to midnight of `asof`, which is a date."""
    end = F.lit(asof).cast("date")
    if len(asof) != 10:
        raise ValueError("a rollup by day ends at a date")
    return rollup.where((F.col("dt").between(F.date_sub(end, int(days)), F.date_sub(end, 1))) | ((F.col("dt") == end) & F.col("at_midnight")))


def intents_of(rollup: DataFrame) -> DataFrame:
    """Questions per intent with shares and the leading intent marked; one row per intent is gathered, counted once."""
    counts = _added(rollup).agg(
        F.collect_list(F.struct("intent_type", "n")).alias("all"), F.sum("n").alias("total"), F.max_by("intent_type", F.struct("n", "intent_type")).alias("top")
    ).select(F.inline("all"), "total", "top")
    share = F.col("n") / F.col("total")
    return counts.select("intent_type", "n", F.round(share, RATIO_DIGITS).alias("share"), (F.col("intent_type") == F.col("top")).alias("is_top"), (share > 0.5).alias("dominant"))


def _averages() -> list[Column]:
    mean = lambda m: F.round(F.coalesce(F.try_divide(F.sum(m), F.sum(f"n_{m}")), F.lit(0.0)), RATIO_DIGITS).alias(f"avg_{m}")
    return [*map(mean, MEASURES), F.coalesce(F.sum("n"), F.lit(0)).alias("total_queries")]


def intent_distribution(log: DataFrame, days: int, asof: str) -> DataFrame:
    """Questions per intent over the last days, with shares and the leading intent marked."""
    return intents_of(day_rollup(_since(log, days, asof)))


def average_metrics(log: DataFrame, days: int, asof: str) -> DataFrame:
    """Mean confidence, response time and intent confidence; zeros without questions."""
    mean = lambda name: F.round(F.coalesce(F.avg(name), F.lit(0.0)), RATIO_DIGITS).alias(f"avg_{name}")
    return _since(log, days, asof).agg(*map(mean, MEASURES), F.count("*").alias("total_queries"))


def metrics_by_range(log: DataFrame, asof: str, ranges: Sequence[int] = METRIC_RANGES) -> DataFrame:
    """Averages per intent for several ranges from one scan: days are summed first, then shared out.

    Ranges are whole days of 24 hours, back from `asof`, as in `average_metrics`.
    """
    longest = _since(log, max(ranges), asof)
    micros = lambda at: F.unix_micros(at.cast("timestamp_ntz").cast("timestamp"))
    age = F.ceil((micros(F.lit(asof)) - micros(F.col("ts"))) / 86_400_000_000)
    daily = longest.groupBy(age.alias("age"), "intent_type").agg(
        F.count("*").alias("n"), *[F.sum(m).alias(m) for m in MEASURES]
    )
    spread = daily.withColumn("days", F.explode(F.filter(F.array(*map(F.lit, ranges)), lambda d: F.col("age") <= d)))
    return spread.groupBy("days", "intent_type").agg(
        F.sum("n").alias("total_queries"),
        *[F.round(F.sum(m) / F.sum("n"), RATIO_DIGITS).alias(f"avg_{m}") for m in MEASURES],
    )


def health(log: DataFrame, feedback: DataFrame, days: int, asof: str) -> DataFrame:
    """One row: ratings of speed and quality, and the recommendations that apply. The log is scanned once."""
    return health_of(day_rollup(_since(log, days, asof)), feedback)


def health_of(rollup: DataFrame, feedback: DataFrame) -> DataFrame:
    """The same from sums by day and intent (see `rollup_between`)."""
    top = F.max_by(F.struct("intent_type", "n"), F.struct("n", "intent_type"))
    whole = _added(rollup).agg(*_averages(), top.alias("i"))
    whole = whole.select(F.struct(*[c for c in whole.columns if c != "i"]).alias("m"), F.struct("i.intent_type", (F.col("i.n") / F.col("total_queries")).alias("share")).alias("i"))
    t = whole.select(F.struct("m", "i").alias("t")).scalar()
    base = feedback_stats(feedback).select("*", t.alias("t")).select("*", "t.m", "t.i")
    rate, time, conf = F.col("helpful_percentage") / 100, F.col("m.avg_response_time_ms"), F.col("m.avg_confidence")
    queries = F.col("m.total_queries")
    advice = F.array_compact(F.array(
        F.when((F.col("total") >= 5) & (rate < 0.5), F.lit("low helpful rate")),
        F.when((F.col("total") >= 5) & (rate > 0.8), F.lit("high helpful rate")),
        F.when(time > 2000, F.lit("slow response times")),
        F.when((conf < 0.7) & (queries >= 10), F.lit("low confidence scores")),
        F.when(F.col("i.share") > 0.5, F.concat(F.lit("most queries are "), F.col("i.intent_type"))),
    ))
    quiet = F.when(queries < 5, F.lit("not enough data")).otherwise(F.lit("no issues"))
    return base.select(
        "total", F.round(rate, RATIO_DIGITS).alias("helpful_rate"), queries.alias("total_queries"),
        F.when(time < 1000, "excellent").when(time < 2000, "good").otherwise("slow").alias("speed"),
        F.when(conf > 0.8, "high").when(conf > 0.6, "good").otherwise("low").alias("quality"),
        F.when(F.size(advice) > 0, advice).otherwise(F.array(quiet)).alias("recommendations"),
    )


def feedback_insights(feedback: DataFrame) -> DataFrame:
    """Votes per intent, and the mean confidence of the helpful ones."""
    return feedback.groupBy("intent_type").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.when(F.col("is_helpful"), F.col("confidence"))), RATIO_DIGITS).alias("avg_helpful_confidence"),
    )


def rated(feedback: DataFrame, helpful: bool) -> DataFrame:
    return feedback.where(F.col("is_helpful") == F.lit(helpful))


def _pair() -> list[Column]:
    return [F.col("query").alias("query"), F.sha2("answer", 256).alias("answer_key")]


def upsert_feedback(old: DataFrame, new: DataFrame) -> DataFrame:
    """One vote per question and answer, by the whole text of both: the last write wins.

    `max_by` keeps one row per key in each task before the shuffle, whatever the number of writes.
    """
    both = old.unionByName(new)
    latest = F.max_by(F.struct(*both.columns), F.struct("timestamp", "id"))
    return both.groupBy(*_pair()).agg(latest.alias("_r")).select("_r.*")


def rating_of(pairs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Rating of each (question, answer); null if never rated."""
    last = feedback.groupBy(*_pair()).agg(F.max_by("is_helpful", F.struct("timestamp", "id")).alias("rating"))
    keyed = pairs.withColumn("answer_key", F.sha2("answer", 256))
    return keyed.join(last, ["query", "answer_key"], "left").drop("answer_key")


def delete_feedback(feedback: DataFrame, ids: DataFrame) -> DataFrame:
    return feedback.join(ids.select("id").distinct(), "id", "left_anti")


def session_stats(log: DataFrame, asof: str | None = None, valid_hours: int = 24) -> DataFrame:
    """Questions, user and length per session id; with `asof`, whether it is still valid."""
    out = log.groupBy("session_id").agg(
        F.min("user").alias("user"), F.count("*").alias("n_queries"), F.min("ts").alias("started"), F.max("ts").alias("ended"),
    ).withColumn("duration_s", F.floor(_seconds("ended") - _seconds("started")))
    if asof is not None:
        now = F.unix_micros(F.lit(asof).cast("timestamp")) / 1e6
        out = out.withColumn("expired", now - _seconds("started") > valid_hours * 3600)
    return out


def _seconds(name: str) -> Column:
    return F.unix_micros(F.col(name).cast("timestamp")) / 1e6


def gap_sessions(log: DataFrame, gap_hours: int = 24) -> DataFrame:
    """Sessions of a user without a session id: a pause of at least `gap_hours` starts a new one.

    Rows that fall into the same slot of `gap_hours` are always one session, so the log is first
    reduced to one row per user and slot (before the shuffle), and only those are put in order:
    a user with a third of all rows has as many rows there as slots.
    """
    gap = gap_hours * 3600 * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    slots = log.groupBy("user", F.floor(at / gap).alias("slot")).agg(
        F.count("*").alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")
    )
    by_time = Window.partitionBy("user").orderBy("slot")
    fresh = F.when(F.col("lo") - F.lag("hi").over(by_time) < gap, 0).otherwise(1)
    numbered = slots.withColumn("_new", fresh).withColumn("session_no", F.sum("_new").over(by_time))
    return numbered.groupBy("user", "session_no").agg(
        F.sum("n").alias("n_queries"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi")
    ).select(
        "user", "session_no", "n_queries", F.floor((F.col("_hi") - F.col("_lo")) / 1_000_000).alias("duration_s")
    )


def recent_history(log: DataFrame, keep: int = 50, slot: str = "hour") -> DataFrame:
    """Newest questions per user without immediate repeats.

    Repeats are found inside (user, slot) groups; the first row of a group is compared with the
    last row of the user's slot before it, taken from one summary row per group. No task has to
    order all rows of a user, and the final cut to `keep` is made in each task before the shuffle.
    """
    at = F.struct("ts", "query_id")
    log = log.withColumn("_slot", F.date_trunc(slot, F.col("ts")))
    inside = Window.partitionBy("user", "_slot").orderBy("ts", "query_id")
    edges = log.groupBy("user", "_slot").agg(F.max_by("query_text", at).alias("_last"))
    before = edges.select(
        "user", "_slot", F.lag("_last").over(Window.partitionBy("user").orderBy("_slot")).alias("_carried")
    )
    marked = log.withColumns({"_prev": F.lag("query_text").over(inside), "_nth": F.row_number().over(inside)})
    joined = marked.join(before, ["user", "_slot"])
    previous = F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_prev"))
    fresh = joined.where(previous.isNull() | (previous != F.col("query_text")))
    newest = Window.partitionBy("user").orderBy(F.col("ts").desc(), F.col("query_id").desc())
    return (
        fresh.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= keep)
        .drop("_slot", "_last", "_carried", "_prev", "_nth")
    )


def latest_ratings(ratings: DataFrame, *keys: str) -> DataFrame:
    """The last rating of every source or answer segment."""
    return ratings.groupBy(*keys).agg(F.max_by("rating", F.struct("ts", "rating")).alias("rating"), F.max("ts").alias("ts"))


def to_query_log(df: DataFrame) -> DataFrame:
    """Log rows from raw questions: derived day, id from user and time, decimals, default session."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.select(
        F.concat_ws("_", "user", stamp).alias("query_id"), "user", "query_text", "answer_text", "intent_type",
        F.col("intent_confidence").cast("decimal(10,6)").alias("intent_confidence"), "sources",
        F.col("confidence").cast("decimal(10,6)").alias("confidence"), "response_time_ms",
        F.coalesce("session_id", F.lit("unknown")).alias("session_id"), "ts", F.to_date("ts").alias("dt"),
    )


def to_feedback(df: DataFrame) -> DataFrame:
    return df.select("query_id", "user", "is_helpful", F.coalesce("feedback_text", F.lit("")).alias("feedback_text"), "ts")


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
