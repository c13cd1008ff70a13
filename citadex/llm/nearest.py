"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample, and every row is filed under one of its leaves. A query takes leaves from a
priority queue, nearest centre first. How many leaves it visits is calibrated: for a bounded set of queries the exact
neighbours are found by one pass over all rows, and visits widen until the wanted share of them lies in visited leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citadex.session import staged


@dataclass(frozen=True)
class SearchOptions:
    """Bounds of what the driver holds (sample, leaves, calibration) and of what one task compares at once."""

    sample_rows: int = 16_000
    sample_bytes: int = 64 << 20
    branching: int = 8
    max_leaves: int = 2_048
    leaf_rows: int = 128
    calibration_queries: int = 64
    recall: float = 0.96
    shelves: int = 64
    group_rows: int = 256
    max_group_rows: int = 65_536
    group_queries: int = 4_096


class Tree:
    """Centres of all nodes; `children[i]` is empty for a leaf, and `leaf[i]` numbers the leaves."""

    def __init__(self, rows: np.ndarray, leaves: int, branching: int, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        rng = np.random.default_rng(seed)
        small = max(1, len(rows) // max(1, leaves))
        self._grow(rows, small, branching, rng)
        self.leaf = np.cumsum([not c for c in self.children]) - 1
        self.n_leaves = int(sum(not c for c in self.children))

    def _grow(self, rows: np.ndarray, small: int, branching: int, rng: np.random.Generator) -> int:
        node = len(self.centres)
        self.centres.append(rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1]))
        self.children.append([])
        if len(rows) > max(small, 1):
            k = min(branching, -(-len(rows) // small))
            label = _kmeans(rows, k, rng)
            groups = [g for g in (rows[label == i] for i in range(k)) if len(g)]
            if len(groups) > 1:
                self.children[node] = [self._grow(g, small, branching, rng) for g in groups]
        return node

    def file(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every level."""
        out, todo = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if not self.children[node]:
                out[at] = self.leaf[node]
                continue
            near = _nearest(rows[at], np.stack([self.centres[c] for c in self.children[node]]))
            todo += [(child, at[near == i]) for i, child in enumerate(self.children[node]) if (near == i).any()]
        return out

    def leaves(self, query: np.ndarray) -> Iterator[int]:
        """Leaves best bin first."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if not self.children[node]:
                yield int(self.leaf[node])
            for child in self.children[node]:
                heapq.heappush(heap, (float(((query - self.centres[child]) ** 2).sum()), child))


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)


def _kmeans(rows: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(steps):
        label = _nearest(rows, centres)
        counts = np.bincount(label, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return _nearest(rows, centres)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null, no NaN or infinity inside, not all zero, not empty."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(wide, lambda x: x != 0)


def _distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the `k` nearest ids, each at its nearest row; ties to the smaller id."""
    some, taken = np.arange(len(ids)), k
    while taken < len(ids):
        near = np.flatnonzero(scores <= np.partition(scores, taken - 1)[taken - 1])
        if len(np.unique(ids[near])) >= k:
            some = near
            break
        taken *= 4  # repeated ids: look further
    some = some[np.lexsort((ids[some], scores[some]))]
    return some[np.sort(np.unique(ids[some], return_index=True)[1])[:k]]


def _calibrate(filed: DataFrame, sample: DataFrame, tree: Tree, dim: int, k: int, recall: float) -> int:
    """Leaves to visit so that `recall` of the exact neighbours of the sampled queries lie in them."""
    found = sample.toArrow()
    if not found.num_rows:
        return 1
    queries, own = matrix(found["vector"], dim), found["id"].to_numpy()

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] | None = None
        for batch in batches:
            ids, leaves, rows = batch["id"].to_numpy(), batch["leaf"].to_numpy(), matrix(batch["vector"], dim)
            now = []
            for q in range(len(own)):
                scores = np.where(ids == own[q], np.inf, _distances(rows, queries[q]))
                a = [ids, leaves, scores]
                if kept:
                    a = [np.concatenate(p) for p in zip(kept[q], a, strict=True)]
                at = _best(a[0], a[2], k)
                now.append([x[at] for x in a])
            kept = now
        for q, (ids, leaves, scores) in enumerate(kept or []):
            good = np.isfinite(scores)
            n = int(good.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, q)), pa.array(ids[good]), pa.array(leaves[good]), pa.array(scores[good])], names=["q", "id", "leaf", "score"])

    order = Window.partitionBy("q").orderBy("score", "id")
    found_ = filed.select("id", "leaf", "vector").mapInArrow(exact, "q long, id long, leaf long, score double")
    truth = found_.groupBy("q", "id").agg(F.min(F.struct("score", "leaf")).alias("near")).select("q", "id", "near.*")
    rows = truth.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("q", "leaf").collect()
    place = [{leaf: i for i, leaf in enumerate(tree.leaves(q))} for q in queries]
    needed = np.sort([place[r["q"]][r["leaf"]] + 1 for r in rows] or [1])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", options: SearchOptions | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest rows found for each query, smallest Euclidean distance first.

    `queries` holds rows of `vectors` (same two columns); a row is no neighbour of itself. Ties go to the smaller id.
    Vectors that are null, zero, or hold nulls or non-finite values take no part, nor do those of a length other than
    the most frequent one. With at most `k` candidates all are returned; an empty table gives no rows. The rows of one id
    are one candidate, at the distance of the nearest, and one query. Queries with equal vectors are searched once.
    """
    opt = options or SearchOptions()
    spark = vectors.sparkSession

    def picked(df: DataFrame) -> DataFrame:
        return df.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))

    empty = "query_id long, rank int, vec_id long, score double"
    rows = picked(vectors)
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], empty)
    dim, n = sizes["dim"], sizes["count"]
    rows = rows.where(F.size("vector") == dim)
    limit = min(opt.sample_rows, max(256, opt.sample_bytes // (8 * dim)))
    sample = matrix(rows.orderBy(F.xxhash64("id"), "id").limit(limit).select("vector").toArrow()["vector"], dim)
    tree = Tree(sample, min(opt.max_leaves, max(1, n // opt.leaf_rows)), opt.branching)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.file(matrix(batch["vector"], dim))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["vector"], pa.array(leaf, pa.int64())], names=["id", "vector", "leaf"])

    filed = staged(rows.mapInArrow(file, "id long, vector array<double>, leaf long"), "filed")
    held, different = np.zeros(tree.n_leaves, np.int64), np.zeros(tree.n_leaves, np.int64)  # rows and ids of each leaf
    per_id = filed.groupBy("leaf", "id").agg(F.count(F.lit(1)).alias("n"))
    for r in per_id.groupBy("leaf").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids")).collect():
        held[r["leaf"]], different[r["leaf"]] = r["n"], r["ids"]
    asked = picked(queries).where(F.size("vector") == dim)
    alike = asked.groupBy("vector").agg(F.min("id").alias("rep"))
    members = asked.join(alike, "vector").select("id", "rep").distinct()
    calibration = alike.select(F.col("rep").alias("id"), "vector").orderBy(F.xxhash64("id"), "id").limit(opt.calibration_queries)
    visits = _calibrate(filed, calibration, tree, dim, k, opt.recall)

    # neighbouring leaves share a shelf of bounded size; a larger leaf has a shelf of its own, dealt over several groups
    shelf_rows = max(opt.group_rows, min(opt.max_group_rows, n // opt.shelves))
    shelf, filled, number = np.zeros(tree.n_leaves, np.int64), 0, 0
    for leaf, count in enumerate(held.tolist()):
        if filled and filled + count > shelf_rows:
            number, filled = number + 1, 0
        shelf[leaf], filled = number, filled + count
    on_shelf = np.bincount(shelf, held, minlength=number + 1).astype(np.int64)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, vectors_, shelves, leaves = [], [], [], []
            for i, q in enumerate(matrix(batch["vector"], dim)):
                taken: dict[int, list[int]] = {}
                visited = seen = 0
                for leaf in tree.leaves(q):
                    if visited >= visits and seen > k:
                        break
                    visited, seen = visited + 1, seen + int(different[leaf])
                    if held[leaf]:
                        taken.setdefault(int(shelf[leaf]), []).append(leaf)
                shelves += taken
                leaves += taken.values()
                reps += [batch["rep"][i].as_py()] * len(taken)
                vectors_ += [i] * len(taken)
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps, pa.int64()), batch["vector"].take(pa.array(vectors_, pa.int64())), pa.array(shelves, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))],
                names=["rep", "vector", "shelf", "leaves"],
            )

    routed = staged(alike.select("rep", "vector").mapInArrow(visit, "rep long, vector array<double>, shelf long, leaves array<long>"), "routed")
    wanted = np.zeros(number + 1, np.int64)
    for r in routed.groupBy("shelf").count().collect():
        wanted[r["shelf"]] = r["count"]
    # the many queries of one shelf are dealt over several groups as well
    parts = F.lit(np.maximum(1, -(-on_shelf // shelf_rows)).tolist())
    turns = F.lit(np.maximum(1, -(-wanted // opt.group_queries)).tolist())
    at = (F.col("shelf") + 1).cast("int")
    base = filed.withColumn("shelf", F.element_at(F.lit(shelf.tolist()), (F.col("leaf") + 1).cast("int")).cast("long"))
    base = base.where(F.element_at(F.lit((wanted > 0).tolist()), at)).select(
        "shelf", F.pmod(F.xxhash64("id"), F.element_at(parts, at)).alias("part"),
        F.explode(F.sequence(F.lit(0), F.element_at(turns, at).cast("int") - 1)).alias("turn"), "id", "leaf", "vector",
    )
    sent = routed.select(
        "shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.element_at(parts, at).cast("long") - 1)).alias("part"),
        F.pmod(F.xxhash64("rep"), F.element_at(turns, at)).cast("int").alias("turn"), "rep", "vector", "leaves",
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        reps, found, scores = [], [], []
        if left.num_rows and right.num_rows:
            order = np.argsort(left["leaf"].to_numpy(), kind="stable")
            leaf, ids, body = left["leaf"].to_numpy()[order], left["id"].to_numpy()[order], matrix(left["vector"], dim)[order]
            for rep, q, wanted_ in zip(right["rep"].to_pylist(), matrix(right["vector"], dim), right["leaves"].to_pylist(), strict=True):
                low, high = np.searchsorted(leaf, wanted_, "left"), np.searchsorted(leaf, wanted_, "right")
                some = np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)])
                if not len(some):
                    continue
                d = _distances(body[some], q)
                best = _best(ids[some], d, k + 1)
                reps.append(np.full(len(best), rep))
                found.append(ids[some][best])
                scores.append(d[best])
        return pa.table({
            "rep": pa.array(np.concatenate(reps) if reps else [], pa.int64()), "vec_id": pa.array(np.concatenate(found) if found else [], pa.int64()),
            "score": pa.array(np.concatenate(scores) if scores else [], pa.float64()),
        })

    keys = ["shelf", "part", "turn"]
    near = base.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(compare, "rep long, vec_id long, score double")
    first = Window.partitionBy("rep").orderBy("score", "vec_id")
    near = near.repartition("rep").groupBy("rep", "vec_id").agg(F.min("score").alias("score"))
    best = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    others = members.join(best, "rep").where("id <> vec_id").repartition("id").groupBy("id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("score", "vec_id"))
    return others.select(F.col("id").alias("query_id"), rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
