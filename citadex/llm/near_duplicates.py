"""Near-duplicates by BagMinHash: weighted Jaccard similarity of bags of five-word shingles.

Documents with equal bags form one class at once. The signatures of the classes are banded; in every band bucket the
best connected member is the hub, and all others are verified against it by exact overlap. Where a bucket still holds
more than one component, everything outside the hub's component is verified against all members of other components,
in blocks, so that no link inside a bucket that would join two classes is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadex.llm.common import free_name
from citadex.llm.components import connected
from citadex.llm.shingles import bag, bands, overlap, signature
from citadex.session import broadcast_within, scratch_path, scratch_scope, staged


def signed(docs: DataFrame, text: str, doc_id: str, words: int, m: int, rows: int) -> DataFrame:
    """doc_id, key (of the bag; null without words), weight, bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                keys, weights, band = [], [], []
                for body in batch.column(1)[at : at + 2048]:
                    shingles, counts = bag(body.as_py(), words)
                    if len(shingles):
                        keys.append(hashlib.blake2b(shingles.tobytes() + counts.tobytes(), digest_size=16).digest())
                        band.append(bands(signature(shingles, counts, m), rows))
                    else:
                        keys.append(None)
                        band.append(None)
                    weights.append(int(counts.sum()))
                columns = [batch.column(0)[at : at + 2048], pa.array(keys, pa.binary()), pa.array(weights, pa.int64()), pa.array(band, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "weight", "bands"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(sign, "doc_id long, key binary, weight long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold. `b` may be shared by many pairs."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, (np.empty(0, np.uint64), np.empty(0, np.int64))
        for batch in batches:
            good = []
            for b, left, right in zip(batch["b"].to_pylist(), batch["text_a"], batch["text_b"], strict=True):
                if b != last:
                    last, known = b, bag(right.as_py(), words)
                good.append(overlap(bag(left.as_py(), words), known) >= threshold)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(verify, "a long, b long")


def _links_of(outside: pa.Table, members: pa.Table, words: int, threshold: float) -> pa.Table:
    """Links from documents outside the hub's component to members of other components: one per document and component."""
    bags = [bag(t.as_py(), words) for t in members["text"]]
    ids, labels = members["rep"].to_pylist(), members["label"].to_numpy()
    sizes = np.array([int(c.sum()) for _, c in bags], np.int64)
    shingles = np.concatenate([s for s, _ in bags] or [np.empty(0, np.uint64)])
    counts = np.concatenate([c for _, c in bags] or [np.empty(0, np.int64)])
    owner = np.repeat(np.arange(len(bags)), [len(s) for s, _ in bags])
    order = np.argsort(shingles, kind="stable")
    shingles, counts, owner = shingles[order], counts[order], owner[order]
    a, b = [], []
    for rep, label, body in zip(outside["rep"].to_pylist(), outside["label"].to_pylist(), outside["text"], strict=True):
        own, own_counts = bag(body.as_py(), words)
        low, high = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
        n = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        both = np.bincount(owner[at], np.minimum(counts[at], np.repeat(own_counts, n)), minlength=len(bags))
        good = (labels != label) & (both >= threshold * (sizes + int(own_counts.sum()) - both) - 1e-9) & (both > 0)
        for there in np.unique(labels[good]):
            a.append(rep)
            b.append(ids[int(np.flatnonzero(good & (labels == there))[0])])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, threshold: float = 0.8, m: int = 100, rows: int = 5, block: int = 512,
) -> DataFrame:
    """doc_id, class_id: one row per row of `docs`; the class id is the smallest doc_id of the class.

    Two documents are linked if the weighted Jaccard similarity of their shingles reaches `threshold`; classes are the
    connected components. `m` registers in bands of `rows` find a pair at 0.8 with probability 0.9997. Null and empty
    texts and texts without words are classes of their own; a null doc_id has a null class. Repeated rows get equal
    rows; an empty table gives none. Only counts reach the driver.
    """
    sketches = staged(signed(docs, text, doc_id, words, m, rows), "sketches")
    some = sketches.where("key IS NOT NULL AND doc_id IS NOT NULL")
    first = some.groupBy("key").agg(F.min(F.struct("doc_id", "weight", "bands")).alias("first"))
    reps = staged(first.select("key", F.col("first.doc_id").alias("rep"), "first.weight", "first.bands"), "classes")
    cells = reps.select("rep", "weight", F.explode("bands").alias("band"))
    sizes = staged(cells.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    shared = staged(cells.join(sizes, "band"), "shared")
    degree = shared.groupBy("rep").agg(F.sum("size").alias("degree"))
    ranked = staged(shared.join(degree, "rep"), "ranked")
    hub = F.max(F.struct("degree", (-F.col("rep")).alias("minus"), "weight"))
    hubs = staged(ranked.groupBy("band").agg(hub.alias("hub")).select("band", (-F.col("hub.minus")).alias("b"), F.col("hub.weight").alias("weight_b")), "hubs")
    alike = F.least("weight", "weight_b") >= threshold * F.greatest("weight", "weight_b") - 1e-9
    pairs = ranked.join(hubs, "band").where(F.col("rep") != F.col("b")).where(alike).select(F.col("rep").alias("a"), "b").distinct()
    pairs = staged(pairs, "pairs")

    ids = shared.select("rep").distinct()
    bodies = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text"))
    texts = staged(bodies.join(broadcast_within(ids, 64 * ids.count()), "rep", "left_semi"), "texts")
    links = staged(_verified(pairs, texts, words, threshold), "links")
    labels = connected(links)

    # buckets in which a link between components may be left
    def labelled(df: DataFrame, node: str, name: str) -> DataFrame:
        found = labels.select(F.col("node").alias(node), F.col("label").alias(name))
        return df.join(found, node, "left").withColumn(name, F.coalesce(name, node))

    main = staged(labelled(hubs.join(sizes.where("size > 2"), "band").select("band", "b", "size"), "b", "main"), "main")
    members = staged(labelled(shared.select("band", "rep"), "rep", "label"), "members").join(main, "band").select("band", "rep", "label", "main", "size")
    members = staged(members, "members")
    outside = members.where("label <> main").groupBy("band").agg(F.count("*").alias("n_out"))
    open_ = staged(members.join(outside, "band"), "open")
    if not open_.isEmpty():
        parts = F.ceil(F.col("size") / block).cast("int")
        turns = F.ceil(F.col("n_out") / block).cast("int")
        wide = open_.join(texts, "rep")
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = wide.where("label <> main").select("band", every(parts).alias("part"), F.pmod(F.xxhash64("rep"), turns).cast("int").alias("turn"), "rep", "label", "text")
        right = wide.select("band", F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"), every(turns).alias("turn"), "rep", "label", "text")
        keys = ["band", "part", "turn"]
        right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own, not those of `left`
        more = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda x, y: _links_of(x, y, words, threshold), "a long, b long")
        more = staged(more.distinct(), "more")
        if not more.isEmpty():
            labels = connected(links.union(more))
    classes = labels.select(F.col("node").alias("rep"), F.col("label"))
    owner = staged(reps.select("key", "rep").join(classes, "rep", "left").select("key", F.coalesce("label", "rep").alias("class_id")), "owner")
    found = sketches.select("doc_id", "key").join(owner, "key", "left")
    return found.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that are the smallest doc_id of their class, once each, with their own columns only.

    Rows with a null doc_id stay as they are.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "gone")
    with scratch_scope(spark):
        classes = near_duplicates(docs, text, doc_id, **options)
        classes.where("class_id <> doc_id").select("doc_id").distinct().write.parquet(path)
    gone = spark.read.schema("doc_id long").parquet(path)
    left = docs.join(broadcast_within(gone.withColumnRenamed("doc_id", doc_id), 64 * gone.count()), doc_id, "left_anti")
    repeated = staged(docs.groupBy(doc_id).count().where(F.col("count") > 1).where(F.col(doc_id).isNotNull()).select(doc_id), "repeated")
    if repeated.isEmpty():
        return left
    name = free_name(docs, "is_repeated")
    marked = left.join(broadcast_within(repeated.withColumn(name, F.lit(True)), 64 * repeated.count()), doc_id, "left")
    once = marked.where(F.col(name)).dropDuplicates([doc_id])
    return marked.where(F.col(name).isNull()).union(once).drop(name)
