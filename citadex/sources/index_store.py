"""The persisted index: immutable segments with a manifest.

    segments/<name>/nodes      the nodes as they were given
    segments/<name>/blocks     their postings, bucketed by shard (`operators/sharded.py`)
    segments/<name>/terms      term, df, max_tf, min_dl, target: counts of this segment, and negative ones for nodes removed
    segments/<name>/removed    node_id, target: nodes of the segment `target` that no longer count
    segments/<name>/filter     which ids may be in the segment (a Bloom filter in buckets of 32,768 bits, one bucket per id)
    segments/<name>/vectors    node_id, embedding
    segments/<name>/entry      one row, written last: a segment without it is not there

Whatever is said about another segment names it, so any segments can be merged into a new one that lists them as replaced.
Counts of nodes and their lengths stand in the entries: opening an index reads entries and term counts, never postings.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citadex.functions import scoring as sc
from citadex.operators.lexical import LexicalIndex
from citadex.operators.sharded import Shards, block_table, shard_count, terms_of, text_size, write_blocks
from citadex.session import broadcast_within, staged
from citadex.settings import MAX_SEGMENTS

ENTRY = "name string, seq long, replaces array<string>, n_shards int, n_nodes long, has_vectors boolean, counts array<struct<target: string, n: long, dl: long>>"
#: Bits and hashes per id: about one id in 30,000 that is not there looks as if it were.
FILTER_BITS, FILTER_HASHES, BUCKET = 24, 8, 32_768


@dataclass(frozen=True)
class StoredIndex:
    nodes: DataFrame
    lexical: LexicalIndex
    vectors: DataFrame | None = None


# --- segments -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Segment:
    """A live segment, as its entry describes it."""

    path: str
    name: str
    seq: int
    n_shards: int
    n_nodes: int
    has_vectors: bool

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/segments/{self.name}/{table}")

    def blocks(self, spark: SparkSession) -> DataFrame:
        """The block table with its buckets. Buckets are known to tables only, so one is declared over the files."""
        where = f"{self.path}/segments/{self.name}/blocks"
        table = block_table(where)
        if not spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.read(spark, "blocks").schema)
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (shard) INTO {self.n_shards} BUCKETS LOCATION '{where}'")
        return spark.table(table)


def _entries(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(ENTRY).parquet(f"{path}/segments/*/entry")
    except AnalysisException:
        return None


def segments(spark: SparkSession, path: str) -> list[Segment]:
    """Live segments, oldest first. One row per segment reaches the driver."""
    entries = _entries(spark, path)
    rows = [] if entries is None else entries.select("name", "seq", "replaces", "n_shards", "n_nodes", "has_vectors").collect()
    replaced = {name for r in rows for name in r["replaces"]}
    live = [Segment(path, r["name"], r["seq"], r["n_shards"], r["n_nodes"], r["has_vectors"]) for r in rows if r["name"] not in replaced]
    return sorted(live, key=lambda s: (s.seq, s.name))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _tagged(spark: SparkSession, live: Sequence[Segment], table: str) -> DataFrame:
    """A table of all live segments with `name`, by one scan."""
    rows = spark.read.parquet(*[f"{s.path}/segments/{s.name}/{table}" for s in live])
    return rows.withColumn("name", F.regexp_extract(F.col("_metadata.file_path"), "/segments/([^/]+)/", 1))


def _removed(spark: SparkSession, live: Sequence[Segment]) -> DataFrame:
    return _tagged(spark, live, "removed").select("node_id", "target").where(F.col("target").isin([s.name for s in live]))


# --- the id filter ------------------------------------------------------------------------------


def _n_buckets(n: int) -> int:
    return max(1, -(-n * FILTER_BITS // BUCKET))


def _bucket(n_buckets: Column) -> Column:
    return F.pmod(F.xxhash64("node_id"), n_buckets)


def _spot(i: Column) -> Column:
    """One of the bits of an id, all of which are in one bucket."""
    return F.pmod(F.xxhash64(i, "node_id"), F.lit(BUCKET))


def _hashes() -> Column:
    return F.sequence(F.lit(1), F.lit(FILTER_HASHES))


def _filter_of(ids: DataFrame, n: int) -> DataFrame:
    """bucket, bits."""
    spots = ids.select(_bucket(F.lit(_n_buckets(n)).cast("long")).alias("bucket"), F.explode(F.transform(_hashes(), _spot)).alias("spot"))
    return spots.groupBy("bucket").agg(F.bitmap_construct_agg("spot").alias("bits"))


def _may_hold(spark: SparkSession, live: Sequence[Segment], ids: DataFrame) -> DataFrame:
    """name, node_id: the segments whose filter has all bits of an id. Ids are not shuffled while the filters fit a broadcast."""
    shapes = F.array(*[F.struct(F.lit(s.name).alias("name"), F.lit(_n_buckets(s.n_nodes)).cast("long").alias("n")) for s in live])
    asked = ids.select("node_id", F.explode(shapes).alias("s")).select("s.name", "node_id", _bucket(F.col("s.n")).alias("bucket"))
    n_bytes = sum(_n_buckets(s.n_nodes) for s in live) * (BUCKET // 8 + 128)
    met = asked.join(broadcast_within(_tagged(spark, live, "filter"), n_bytes), ["name", "bucket"])

    def is_set(i: Column) -> Column:
        byte = F.conv(F.hex(F.substring("bits", (F.floor(_spot(i) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, (_spot(i) % 8).cast("int")).bitwiseAND(F.lit(1)) == 1

    return met.where(F.forall(_hashes(), is_set)).select("name", "node_id")


def held(spark: SparkSession, live: Sequence[Segment], ids: DataFrame) -> DataFrame:
    """node_id, target: where the given ids (distinct) are stored and count. Reads ids of those segments only whose filter
    lets one of them pass."""
    if not live:
        return ids.select("node_id", F.lit("").alias("target")).limit(0)
    likely = staged(_may_hold(spark, live, ids), "likely")
    hit = {r["name"] for r in likely.select("name").distinct().collect()}
    some = [s for s in live if s.name in hit]
    if not some:
        return likely.select("node_id", F.col("name").alias("target")).limit(0)
    stored = _tagged(spark, some, "nodes").select("name", "node_id")
    found = likely.join(stored, ["name", "node_id"], "left_semi").select("node_id", F.col("name").alias("target"))
    return staged(found.join(_removed(spark, live), ["node_id", "target"], "left_anti"), "held")


# --- writing ------------------------------------------------------------------------------------


def _lost_counts(spark: SparkSession, live: Sequence[Segment], gone: DataFrame) -> DataFrame:
    """term, n, dl, target: what the removed nodes take from each segment, counted where its blocks lie; see `Shards.counts_of`."""
    hit = {r["target"] for r in gone.select("target").distinct().collect()}
    return _union([
        Shards(s.blocks(spark), s.n_shards).counts_of(gone.where(F.col("target") == s.name)).withColumn("target", F.lit(s.name)) for s in live if s.name in hit
    ])


def _write_segment(
    nodes: DataFrame, path: str, name: str, seq: int, live: Sequence[Segment], gone: DataFrame | None = None, vectors: DataFrame | None = None,
    replaces: Sequence[Segment] = (),
) -> None:
    """Write one segment. Texts are written once and read back for whatever derives from them.

    `gone` holds node_id and target of nodes of other live segments that this one removes.
    """
    spark, at = nodes.sparkSession, f"{path}/segments/{name}"
    nodes.write.mode("overwrite").parquet(f"{at}/nodes")
    own = spark.read.schema(nodes.schema).parquet(f"{at}/nodes")
    n_nodes, n_bytes = text_size(own)
    n_shards = shard_count(n_nodes, n_bytes)
    blocks = write_blocks(own, n_shards, f"{at}/blocks")
    terms = terms_of(blocks, n_shards).withColumn("target", F.lit(name))
    counts = blocks.agg(F.lit(name).alias("target"), F.coalesce(F.sum("n_opens"), F.lit(0)).alias("n"), F.coalesce(F.sum("opens_dl"), F.lit(0)).alias("dl"))
    if gone is None:
        gone = own.select("node_id", F.lit("").alias("target")).limit(0)
    gone = gone.select("node_id", "target")
    gone.write.mode("overwrite").parquet(f"{at}/removed")
    others = [s for s in live if s.name not in {r.name for r in replaces} and s.name != name]
    stored_gone = spark.read.schema(gone.schema).parquet(f"{at}/removed")
    if others and not stored_gone.isEmpty():
        lost = staged(_lost_counts(spark, others, stored_gone), "lost")
        none = F.lit(None).cast("long")
        terms = terms.unionByName(lost.where("term IS NOT NULL").groupBy("term", "target").agg((-F.sum("n")).alias("df")).select("term", "df", none.alias("max_tf"), none.alias("min_dl"), "target"))
        counts = counts.unionByName(lost.where("term IS NULL").groupBy("target").agg((-F.sum("n")).alias("n"), (-F.sum("dl")).alias("dl")))
    terms.write.mode("overwrite").parquet(f"{at}/terms")
    _filter_of(own.select("node_id"), n_nodes).write.mode("overwrite").parquet(f"{at}/filter")
    if vectors is not None:
        vectors.select("node_id", "embedding").write.mode("overwrite").parquet(f"{at}/vectors")
    counts.agg(F.collect_list(F.struct("target", "n", "dl")).alias("counts")).select(
        F.lit(name).alias("name"), F.lit(seq).cast("long").alias("seq"), F.array(*[F.lit(s.name) for s in replaces]).cast("array<string>").alias("replaces"),
        F.lit(n_shards).alias("n_shards"), F.lit(n_nodes).cast("long").alias("n_nodes"), F.lit(vectors is not None).alias("has_vectors"), "counts",
    ).coalesce(1).write.mode("overwrite").parquet(f"{at}/entry")


def write_index(nodes: DataFrame, path: str, vectors: DataFrame | None = None) -> None:
    """Build and write an index, in place of whatever was there: the old segments count no more once the new one is whole."""
    live = segments(nodes.sparkSession, path)
    _write_segment(nodes, path, uuid.uuid4().hex, _next(live), live, vectors=vectors, replaces=live)


def _next(live: Sequence[Segment]) -> int:
    return max((s.seq for s in live), default=-1) + 1


def _once(df: DataFrame | None) -> DataFrame | None:
    """One row per id. Ids are looked at first: where none comes twice, texts are not shuffled for it."""
    if df is None:
        return None
    rows, ids = df.agg(F.count("*"), F.countDistinct("node_id")).first()
    return df if rows == ids else df.dropDuplicates(["node_id"])


def append_nodes(nodes: DataFrame, path: str, vectors: DataFrame | None = None, name: str | None = None) -> None:
    """Add new nodes as a segment.

    A node whose id is stored already, or that comes twice in the batch, is added once, so an append that is run again
    changes nothing. A `name` makes the segment replace an earlier attempt under that name (batches of a stream). The
    batch may be given by ids that the filters of the segments tell apart, so texts of the index are not read.
    """
    spark = nodes.sparkSession
    live = [s for s in segments(spark, path) if s.name != name]
    known = held(spark, live, nodes.select("node_id").distinct())
    new = _once(nodes.join(_near(known.select("node_id")), "node_id", "left_anti"))
    fresh = None if vectors is None else vectors.join(_near(known.select("node_id")), "node_id", "left_anti")
    _write_segment(new, path, name or uuid.uuid4().hex, _next(live), live, vectors=fresh)


def _near(ids: DataFrame) -> DataFrame:
    return broadcast_within(ids, 64 * ids.count())


def replace_nodes(nodes: DataFrame, path: str, vectors: DataFrame | None = None) -> None:
    """Add nodes; those whose id is stored already take the place of what is there. Of repeated ids one row is kept."""
    spark = nodes.sparkSession
    live = segments(spark, path)
    gone = held(spark, live, nodes.select("node_id").distinct())
    _write_segment(_once(nodes), path, uuid.uuid4().hex, _next(live), live, gone, _once(vectors))


def remove_nodes(ids: DataFrame, path: str) -> None:
    """Take nodes (`node_id`) out; ids that are not stored do nothing."""
    spark = ids.sparkSession
    live = segments(spark, path)
    gone = held(spark, live, ids.select("node_id").distinct())
    _write_segment(_live_nodes(spark, live).limit(0), path, uuid.uuid4().hex, _next(live), live, gone)


def compact_index(spark: SparkSession, path: str, most: int = MAX_SEGMENTS) -> bool:
    """Merge the smallest segments until at most `most` are left, and all that hold many removed nodes; False if none need it.

    The merged segment holds the living nodes of the old ones and what they removed from others. Old files stay until
    `drop_replaced`, so readers that opened the index before are not disturbed.
    """
    live = segments(spark, path)
    dead = {r["target"]: r["n"] for r in _removed(spark, live).groupBy("target").agg(F.count("*").alias("n")).collect()} if live else {}
    by_size = sorted(live, key=lambda s: s.n_nodes - dead.get(s.name, 0))
    merged = set(by_size[: len(live) - most + 1] if len(live) > most else ()) | {s for s in live if 2 * dead.get(s.name, 0) > s.n_nodes}
    if not merged:
        return False
    old = [s for s in live if s in merged]
    names = [s.name for s in old]
    left = [s.name for s in live if s not in merged]
    own_gone = _tagged(spark, old, "removed").where(F.col("target").isin(left)).select("node_id", "target")
    vectors = _live_vectors(spark, live).where(F.col("name").isin(names)).drop("name") if any(s.has_vectors for s in old) else None
    nodes = _live_nodes(spark, live, keep=names)
    _write_segment(nodes, path, uuid.uuid4().hex, max(s.seq for s in old), live, staged(own_gone, "gone"), vectors, old)
    return True


def drop_replaced(spark: SparkSession, path: str) -> int:
    """Delete the files of segments that others have replaced; nobody may be reading them. Returns how many."""
    entries = _entries(spark, path)
    rows = [] if entries is None else entries.select("name", "replaces").collect()
    there, live = {r["name"] for r in rows}, {s.name for s in segments(spark, path)}
    for name in there - live:
        spark.sql(f"DROP TABLE IF EXISTS {block_table(f'{path}/segments/{name}/blocks')}")
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/segments/{name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(there - live)


# --- reading ------------------------------------------------------------------------------------


def _living(spark: SparkSession, live: Sequence[Segment], table: str, among: Sequence[Segment]) -> DataFrame:
    """Rows of the segments `among` that no live segment has removed; segments that lost nothing are only read."""
    gone = _removed(spark, live).withColumnRenamed("target", "name")
    hit = {r["name"] for r in gone.select("name").distinct().collect()}
    parts = [[s for s in among if s.name not in hit], [s for s in among if s.name in hit]]
    whole, cut = (_tagged(spark, part, table) if part else None for part in parts)
    if cut is not None:
        cut = cut.join(_near(gone), ["name", "node_id"], "left_anti")
    return _union([rows for rows in (whole, cut) if rows is not None])


def _live_nodes(spark: SparkSession, live: Sequence[Segment], keep: Sequence[str] | None = None) -> DataFrame:
    return _living(spark, live, "nodes", [s for s in live if keep is None or s.name in keep]).drop("name")


def _live_vectors(spark: SparkSession, live: Sequence[Segment]) -> DataFrame:
    return _living(spark, live, "vectors", [s for s in live if s.has_vectors])


def read_index(spark: SparkSession, path: str, with_vectors: bool = False) -> StoredIndex:
    """Open a persisted index; a missing one raises an error that names the path."""
    live = segments(spark, path)
    if not live or (with_vectors and not any(s.has_vectors for s in live)):
        raise FileNotFoundError(f"no index at {path}: write one with write_index first")
    names = [s.name for s in live]
    terms = _tagged(spark, live, "terms").where(F.col("target").isin(names)).groupBy("term").agg(
        F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl")
    ).where("df > 0")
    rows = _entries(spark, path).where(F.col("name").isin(names)).select(F.explode("counts").alias("c")).where(F.col("c.target").isin(names))
    corpus = rows.agg(F.sum("c.n").alias("n"), (F.sum("c.dl") / F.sum("c.n")).alias("avgdl"))
    mean = terms.agg(F.avg(sc.bm25_idf(corpus.select("n").scalar(), F.col("df"))).alias("mean_idf"))
    stats = staged(corpus.select("n", "avgdl", mean.scalar().alias("mean_idf")), "stats")
    removed = _removed(spark, live)
    touched = {r["target"] for r in removed.select("target").distinct().collect()}
    shards = tuple(
        Shards(s.blocks(spark), s.n_shards, removed.where(F.col("target") == s.name).select("node_id") if s.name in touched else None) for s in live
    )
    postings = _union([s.postings() for s in shards])
    vectors = _live_vectors(spark, live).drop("name") if with_vectors else None
    return StoredIndex(_live_nodes(spark, live), LexicalIndex(postings, terms, stats, shards), vectors)
