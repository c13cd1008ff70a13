"""An index built for one job: the same shards as a stored one, so no posting is shuffled, and no task grows with the corpus."""

import os
import random
import time
from collections import Counter

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from citadex.functions import text as tx
from citadex.operators import lexical, sharded
from citadex.operators.lexical import bm25_search, build_lexical_index
from citadex.operators.understanding import glossary_hits
from citadex.session import FREE_SHUFFLES, staged_alone
from citadex.settings import BYTES_PER_SHARD
from citadex.sources import index_store as ix


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [(i, "The " + " ".join(rng.choices([f"w{j}" for j in range(60)], k=rng.randint(1, 25)))) for i in range(120)]
    return [*texts, (200, None), (201, " \t "), (202, "the"), (5, texts[5][1]), (6, "other words of node six")]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "the w1 w2"), (2, "w3 w3 w4 unseen"), (3, ""), (4, "six")], "query_id long, query string")


def test_postings_terms_and_counts(spark, rows, monkeypatch):
    monkeypatch.setattr(sharded, "NODES_PER_SHARD", 20)
    index = build_lexical_index(spark.createDataFrame(rows, "node_id long, text string"))
    assert index.shards[0].n_shards == 7
    want, opened = Counter(), set()
    for node, text in rows:
        tokens = (text or "").lower().split()
        want.update((node, len(tokens), t) for t in tokens)
        opened |= {(node, len(tokens), tokens[0])} if tokens else set()
    got = {(r.node_id, r.dl, r.term): r.tf for r in index.postings.collect()}
    assert got == dict(want)  # rows of one id and length are one document
    df = Counter(t for _, _, t in want)
    assert {r.term: r.df for r in index.terms.collect()} == dict(df)
    stats = index.stats.first()
    assert (stats.n, stats.avgdl) == (len(opened), pytest.approx(sum(dl for _, dl, _ in opened) / len(opened)))


def test_a_search_shuffles_no_posting(spark, rows, asked):
    index = build_lexical_index(spark.createDataFrame(rows, "node_id long, text string"))
    plan = bm25_search(asked, index, 5)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("== Initial Plan ==")[-1].splitlines()
    at = next(i for i, line in enumerate(lines) if "FlatMapCoGroupsInArrow" in line)
    scan = next(i for i, line in enumerate(lines[at:], at) if "FileScan" in line and "blocks_" in line)
    assert not [line for line in lines[at:scan] if "Exchange" in line and "Broadcast" not in line], plan


def test_only_allowed_nodes_are_found(spark, rows, asked):
    index = build_lexical_index(spark.createDataFrame(rows, "node_id long, text string"))
    allowed = spark.range(0, 300, 3).withColumnRenamed("id", "node_id")
    every = [r for r in bm25_search(asked, index, 1000).orderBy("query_id", "rank").collect() if r.node_id % 3 == 0]
    want = [(q, r.node_id, r.score) for q in (1, 2, 3, 4) for r in [x for x in every if x.query_id == q][:5]]
    cut = index.restricted(allowed)
    got = bm25_search(asked, cut, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.node_id, r.score) for r in got] == want and len(want) > 8
    assert {r.node_id % 3 for r in cut.postings.collect()} == {0}
    twice = cut.restricted(spark.range(0, 300, 2).withColumnRenamed("id", "node_id"))
    assert {r.node_id % 6 for r in bm25_search(asked, twice, 5).collect()} == {0}


def test_shards_are_bounded_by_text(spark):
    assert sharded.shard_count(10, 100 * BYTES_PER_SHARD) == 100
    assert sharded.shard_count(0, 0) == 1
    nodes = spark.createDataFrame([(1, "äb"), (2, None)], "node_id long, text string")
    assert sharded.text_size(nodes) == (2, 3)
    assert sharded.text_size(nodes.limit(0)) == (0, 0)


def test_a_corpus_without_tokens(spark, asked):
    index = build_lexical_index(spark.createDataFrame([(1, None), (2, "  ")], "node_id long, text string"))
    assert index.postings.count() == 0 and index.stats.first()["n"] == 0 and bm25_search(asked, index, 5).count() == 0


def test_removed_nodes_are_counted_in_their_shards(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(sharded, "NODES_PER_SHARD", 20)
    nodes = spark.createDataFrame(rows, "node_id long, text string")
    shards = build_lexical_index(nodes).shards[0]
    gone = spark.createDataFrame([(i,) for i in (3, 5, 6, 77, 200, 201, 999)], "node_id long")
    lost = shards.counts_of(gone)
    plan = lost._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert sum("Exchange" in line for line in plan.splitlines()) == 1, plan  # only the ids move
    own = {(n, tuple((t or "").lower().split())) for n, t in rows if n in (3, 5, 6, 77)}
    got = Counter()
    for r in lost.where("term IS NOT NULL").collect():
        got[r.term] += r.n
    assert got == Counter(t for _, ts in own for t in set(ts))
    total = lost.where("term IS NULL").groupBy().sum("n", "dl").first()
    assert tuple(total) == (len(own), sum(len(ts) for _, ts in own))


def test_ids_are_looked_at_before_texts_are_moved(spark, rows):
    unique = spark.createDataFrame(rows[:100], "node_id long, text string")
    assert "Exchange" not in ix._once(unique)._jdf.queryExecution().executedPlan().toString()
    assert ix._once(spark.createDataFrame(rows, "node_id long, text string")).count() == len(rows) - 2


def test_filters_are_broadcast_and_miss_no_id(spark, tmp_path):
    path = str(tmp_path / "index")
    for low in (0, 3000):
        ix.append_nodes(spark.range(low, low + 3000).selectExpr("id AS node_id", "concat('t', id) AS text"), path)
    live = ix.segments(spark, path)
    found = ix._may_hold(spark, live, spark.range(0, 40_000).withColumnRenamed("id", "node_id"))
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.name, r.node_id) for r in found.collect()}
    right = {(s.name, i) for s, low in zip(live, (0, 3000), strict=True) for i in range(low, low + 3000)}
    assert right <= got and len(got - right) < 40


def test_texts_are_shuffled_as_packs(spark):
    """One row per batch and shard crosses the exchange; what postings tell already is not stored beside them."""
    odd = ["", None, " \u2003\n ", "A\u2003b\nc\x1cd", "\u0130 \u03a3\u03a3 z\u00e9", "x" * 5000, "a b a"]
    nodes = spark.createDataFrame([(i if i != 9 else None, odd[i % 7]) for i in range(200)], "node_id long, text string").coalesce(2)
    blocks = sharded.blocks_of(nodes, 3)
    plan = blocks._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = next(i for i, line in enumerate(plan) if "Exchange hashpartitioning(shard" in line)
    assert "MapInArrow" in plan[moved + 1], plan
    assert not {"max_tfs", "min_dls"} & set(blocks.columns)
    rows = lambda: {(p.node_id, p.dl, p.term, p.tf) for p in sharded.Shards(sharded.blocks_of(nodes, 3), 3).postings().collect()}
    whole = rows()
    tokens = {r.node_id: [t.lower() for t in r.tokens] for r in nodes.select("node_id", F.coalesce(tx.tokens(F.col("text")), F.array()).alias("tokens")).collect()}
    assert whole == {(i, len(ts), t, ts.count(t)) for i, ts in tokens.items() for t in ts} and len(whole) > 200
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_glossary_is_not_shuffled_for_its_hits(spark, rows, asked):
    glossary = spark.createDataFrame([(i, f"t{i}", text or "", []) for i, text in enumerate(t for _, t in rows)], "entry_id long, term string, definition string, aliases array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = glossary_hits(asked, glossary)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan


def shuffled_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    each = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in each if f.getName().startswith("shuffle_")}


def test_a_build_frees_what_it_shuffled(spark):
    """Texts and sums of terms are not on disk any more once the tables made of them are (a count of rows may be); the setting is as before."""
    rng = random.Random(3)
    nodes = spark.createDataFrame([(i, rng.randbytes(3000).hex(" ", 4)) for i in range(200)], "node_id long, text string").coalesce(2)
    before, setting = set(shuffled_files(spark)), spark.conf.get(FREE_SHUFFLES)
    index = build_lexical_index(nodes)
    end = time.monotonic() + 20
    while (left := sum(n for f, n in shuffled_files(spark).items() if f not in before)) > 50_000 and time.monotonic() < end:
        time.sleep(0.2)
    assert left <= 50_000 and spark.conf.get(FREE_SHUFFLES) == setting
    assert index.terms.count() > 140_000


def test_an_index_for_one_search_goes_with_it(spark, rows, asked):
    nodes, made = spark.createDataFrame(rows, "node_id long, text string"), []

    def search():
        made.append(build_lexical_index(nodes))
        return bm25_search(asked, made[0], 5)

    hits = staged_alone(spark, "hits", search)
    paths = [f.removeprefix("file:").removeprefix("//") for df in (made[0].shards[0].blocks, made[0].terms) for f in df.inputFiles()]
    assert len(paths) > 1 and not any(os.path.exists(p) for p in paths)
    assert sorted(hits.collect()) == sorted(bm25_search(asked, build_lexical_index(nodes), 5).collect())


def test_terms_are_shuffled_as_packs(spark, rows):
    nodes = spark.createDataFrame(rows, "node_id long, text string")
    shards = build_lexical_index(nodes).shards[0]
    terms = sharded.terms_of(shards.blocks, 200)
    plan = terms._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()
    moved = next(i for i, line in enumerate(plan) if "Exchange hashpartitioning(part" in line)
    assert "MapInArrow" in plan[moved + 1] and sum("Exchange" in line for line in plan) == 1, plan
    each = [(p.term, p.tf, p.dl) for p in shards.postings().collect()]
    want = {t: (sum(x[0] == t for x in each), max(x[1] for x in each if x[0] == t), min(x[2] for x in each if x[0] == t)) for t, _, _ in each}
    assert {r.term: (r.df, r.max_tf, r.min_dl) for r in terms.collect()} == want
    assert sharded.terms_of(shards.blocks.limit(0), 1).count() == 0


def test_sums_of_terms_are_taken_in_bounded_steps(monkeypatch):
    monkeypatch.setattr(sharded, "TERMS_PER_SUM", 40)
    rng, want, batches = random.Random(5), {}, []
    for _ in range(20):
        rows = [(rng.choice(["", "\u00e9", "a", "x\x00y"]) + str(rng.randrange(30)), rng.choice([1, 2, 2**40]), rng.randrange(1, 9), rng.randrange(1, 2**33)) for _ in range(rng.randrange(30))]
        for term, *counts in rows:
            df, tf, dl = want.get(term, (0, 0, 2**60))
            want[term] = (df + counts[0], max(tf, counts[1]), min(dl, counts[2]))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        part = pa.array([len(t) % 3 for t in columns[0]], pa.int32())
        batches.append(pa.record_batch([part, pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["part", "term", "df", "max_tf", "min_dl"]))
    packs = pa.Table.from_batches(list(sharded.pack_terms(iter(batches))))
    assert packs["n_terms"].to_numpy().max() <= 70 and packs.num_rows > 6
    got = {}
    for part in range(3):
        own = sharded.sum_terms(packs.filter(pa.compute.equal(packs["part"], part))).to_pylist()
        assert not {r["term"] for r in own} & set(got)
        got |= {r["term"]: (r["df"], r["max_tf"], r["min_dl"]) for r in own}
    assert got == want


def test_an_index_is_made_in_turns(spark, rows, asked, monkeypatch):
    """No turn moves more than its part of the texts, and the index is the same as after one turn."""
    monkeypatch.setattr(sharded, "NODES_PER_SHARD", 10)
    nodes, moved, blocks_of = spark.createDataFrame([*rows, (None, "no id")], "node_id long, text string"), [], sharded.blocks_of
    once = build_lexical_index(nodes)
    monkeypatch.setattr(sharded, "SHARDS_IN_ONE_TURN", 2)
    monkeypatch.setattr(sharded, "blocks_of", lambda own, n: moved.append(own.count()) or blocks_of(own, n))
    index = build_lexical_index(nodes)
    assert sum(moved) == len(rows) + 1 and max(moved) < sum(moved) / 2, moved
    assert tuple(index.stats.first()) == pytest.approx(tuple(once.stats.first()))
    for what in (lambda x: x.postings, lambda x: x.terms, lambda x: bm25_search(asked, x, 5)):
        assert Counter(what(index).collect()) == Counter(what(once).collect())


@pytest.mark.parametrize("only", [False, True])
def test_an_index_for_one_search_has_postings_of_its_terms_alone(spark, rows, asked, monkeypatch, only):
    monkeypatch.setattr(sharded, "NODES_PER_SHARD", 20)
    nodes, seen, build = spark.createDataFrame(rows, "node_id long, text string"), [], lexical.build_lexical_index
    whole = build(nodes)

    def made(*args):
        index = build(*args)
        seen.append([index.postings.collect(), index.terms.collect(), index.stats.collect()])
        return index

    monkeypatch.setattr(lexical, "build_lexical_index", made)
    allowed = spark.range(0, 300, 3).withColumnRenamed("id", "node_id") if only else None
    got = lexical.search_once(asked, nodes, 5, allowed=allowed).collect()
    want = bm25_search(asked, whole.restricted(allowed) if only else whole, 5).collect()
    assert sorted(got) == sorted(want) and len(got) > 8
    postings, terms, stats = seen[0]
    words = {"the", "w1", "w2", "w3", "w4", "unseen", "six"}
    assert Counter(postings) == Counter(whole.postings.where(F.col("term").isin(*words)).collect())
    assert Counter(terms) == Counter(whole.terms.collect()) and tuple(stats[0]) == pytest.approx(tuple(whole.stats.first()))
    monkeypatch.setattr(lexical, "small_enough", lambda n: False)
    large = lexical.search_once(asked, nodes, 5, allowed=allowed).collect()
    assert sorted(large) == sorted(want) and len(seen[1][0]) == whole.postings.count()


def test_a_filtered_search_leaves_no_index(spark):
    import __spark_entry__ as entry

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    indexes = lambda: {name for name in os.listdir(shared) if name.startswith("blocks-")}
    before = indexes()
    assert entry.queries()["hybrid_prefiltered"](spark, "/root/testdata/sf0.001").count() > 0
    assert indexes() == before
