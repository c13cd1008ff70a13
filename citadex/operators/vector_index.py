"""A stored index of vectors that answers exactly and scores few pairs.

Vectors are dealt to lists (the nearest of some centroids), and what is left of each after its centroid is written as
product-quantised codes with the length of its error. For a question, a list and then a code bound every cosine from
above and below; lists and vectors whose upper bound lies under the k-th lower bound are out, and only the rest is scored
on the original vectors. So the answer is that of a full search, whatever the structure of the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citadex.functions import scoring as sc
from citadex.operators.dense import _unit
from citadex.operators.fusion import ranked, top_k
from citadex.session import broadcast_within, staged

#: Vectors of a block: a list of any size is cut into blocks.
BLOCK = 8_192
#: Floats of rounding that a bound is widened by.
SLACK = 1e-6


@dataclass(frozen=True)
class Model:
    """Centroids of the lists, 256 codewords per group of dimensions, and of each list its radius and number of blocks."""

    centroids: np.ndarray
    codewords: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, length of the error, distance to the centroid."""
        where = np.argmax(unit @ self.centroids.T - 0.5 * (self.centroids**2).sum(axis=1), axis=1)
        rest = unit - self.centroids[where]
        parts = _parts(rest, self.codewords.shape[2])
        codes = np.empty(parts.shape[:2], np.uint8)
        for i, words in enumerate(self.codewords):
            codes[:, i] = np.argmax(parts[:, i] @ words.T - 0.5 * (words**2).sum(axis=1), axis=1)
        decoded = self.codewords[np.arange(codes.shape[1])[None], codes]
        return where, codes, np.linalg.norm(parts - decoded, axis=(1, 2)), np.linalg.norm(rest, axis=1)


def _parts(vectors: np.ndarray, width: int) -> np.ndarray:
    """Groups of `width` dimensions, the last one filled up with zeros."""
    return np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % width))).reshape(len(vectors), -1, width)


def _means(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Plain k-means; an empty centroid stays where it is."""
    out = points[rng.choice(len(points), k, replace=len(points) < k)].copy()
    for _ in range(rounds):
        near = np.argmax(points @ out.T - 0.5 * (out**2).sum(axis=1), axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, points[:, j], minlength=k) for j in range(points.shape[1])], axis=1)
        out[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return out


def fit(sample: np.ndarray, n_lists: int, width: int = 1, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    unit = _unit(sample)
    centroids = _means(unit, n_lists, 8, rng)
    near = np.argmax(unit @ centroids.T - 0.5 * (centroids**2).sum(axis=1), axis=1)
    rest = unit - centroids[near]
    parts = _parts(rest, width)
    words = np.stack([_means(np.ascontiguousarray(parts[:, i]), 256, 6, rng) for i in range(parts.shape[1])])
    return Model(centroids, words, np.zeros(n_lists), np.ones(n_lists, np.int64))


@dataclass(frozen=True)
class VectorIndex:
    codes: DataFrame
    vectors: DataFrame
    model: Model


def _buckets(n: int) -> int:
    return max(1, min(1024, -(-n // BLOCK)))


def build_vector_index(vectors: DataFrame, path: str, sample: int = 8_192, width: int = 1) -> None:
    """Write the index of `vectors` (node_id, embedding) to a new path. Null and empty vectors are not in it.

    Centroids and codewords are fitted on at most `sample` vectors, those with the smallest hash of their id; all vectors
    are filed. Their number of lists is the root of their number, 1,024 at most. A code takes one byte per `width`
    dimensions: wider groups make smaller codes and looser bounds, so that more pairs are scored.
    """
    held = vectors.select("node_id", "embedding").where(F.size("embedding") > 0)
    held.write.parquet(f"{path}/vectors")
    held = vectors.sparkSession.read.schema(held.schema).parquet(f"{path}/vectors")
    n = held.count()
    rows = held.orderBy(F.xxhash64("node_id")).limit(sample).select("embedding").collect()
    first = fit(np.array([r[0] for r in rows], np.float64), max(1, min(1024, int(n**0.5))), width) if rows else fit(np.zeros((1, 2)), 1)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                where, codes, error, far = first.encode(_unit(part["embedding"]))
                yield pd.DataFrame({"list": where, "node_id": part["node_id"].to_numpy(), "code": [c.tobytes() for c in codes], "error": error, "far": far})

    kind = held.schema["node_id"].dataType.simpleString()
    coded = staged(held.mapInPandas(encode, f"list int, node_id {kind}, code binary, error double, far double"), "codes")
    sizes = {r["list"]: (r["n"], r["far"]) for r in coded.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # 1,024 at most
    blocks = [max(1, -(-sizes.get(i, (0, 0.0))[0] // BLOCK)) for i in range(len(first.centroids))]
    cut = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("list") + 1)
    placed = coded.withColumn("block", F.pmod(F.xxhash64("node_id"), cut).cast("int")).select("list", "block", "node_id", "code", "error")
    table = f"codes_{hashlib.md5(path.encode()).hexdigest()}"
    placed.repartition(_buckets(n), "list", "block").write.option("path", f"{path}/codes").bucketBy(_buckets(n), "list", "block").sortBy("list", "block").saveAsTable(table)
    radius = [sizes.get(i, (0, 0.0))[1] for i in range(len(first.centroids))]
    row = (n, first.centroids.tolist(), first.codewords.tolist(), radius, blocks)
    schema = "n long, centroids array<array<double>>, codewords array<array<array<double>>>, radius array<double>, blocks array<long>"
    held.sparkSession.createDataFrame([row], schema).coalesce(1).write.parquet(f"{path}/model")


def read_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    row = spark.read.parquet(f"{path}/model").first()
    model = Model(*(np.array(row[c]) for c in ("centroids", "codewords", "radius", "blocks")))
    table = f"codes_{hashlib.md5(path.encode()).hexdigest()}"
    if not spark.catalog.tableExists(table):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/codes").schema)
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (list, block) INTO {_buckets(row['n'])} BUCKETS LOCATION '{path}/codes'")
    return VectorIndex(spark.table(table), spark.read.parquet(f"{path}/vectors"), model)


def _asked(questions: DataFrame, model: Model, keys: list[str], probes: int, first: bool) -> DataFrame:
    """keys, list, block, unit, floor for the `probes` likeliest lists of a question (or for the others that may matter)."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = _unit(batch["embedding"])
            if unit.shape[1] != model.centroids.shape[1]:  # as in an empty index
                continue
            dots = unit @ model.centroids.T
            order = np.argsort(-dots, axis=1, kind="stable")
            row, lists = [], []
            for i in range(len(batch)):
                rest = order[i, probes:]
                mine = order[i, :probes] if first else rest[dots[i, rest] + model.radius[rest] >= batch["floor"].iloc[i] - SLACK]
                n = model.blocks[mine]
                row.append(np.full(int(n.sum()), i))
                lists.append(np.stack((np.repeat(mine, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)), axis=1))
            if not row:
                continue
            row, lists = np.concatenate(row), np.concatenate(lists)
            if not len(row):
                continue
            out = batch[[*keys, "floor"]].iloc[row].reset_index(drop=True)
            yield out.assign(list=lists[:, 0], block=lists[:, 1], unit=[unit[i].tolist() for i in row])

    fields = [questions.schema[c] for c in keys]
    kinds = [("floor", T.DoubleType()), ("list", T.IntegerType()), ("block", T.IntegerType()), ("unit", T.ArrayType(T.DoubleType()))]
    return questions.select(*keys, "embedding", "floor").mapInPandas(deal, T.StructType([*fields, *(T.StructField(*k) for k in kinds)]))


def _bounded(codes: DataFrame, asked: DataFrame, model: Model, keys: list[str], k: int) -> DataFrame:
    """keys, node_id, low, high: what can be among the `k` best of a question, by the bounds of its code."""

    def bound(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if own.empty or rows.empty:
            return pd.DataFrame({**{c: rows[c].iloc[:0] for c in keys}, "node_id": own["node_id"].iloc[:0], "low": [], "high": []})
        codes_ = np.frombuffer(b"".join(own["code"]), np.uint8).reshape(len(own), -1)
        error, ids = own["error"].to_numpy(), own["node_id"].to_numpy()
        at, nodes, low, high = [], [], [], []
        for i, (unit, floor, where) in enumerate(zip(rows["unit"], rows["floor"], rows["list"], strict=True)):
            unit = np.asarray(unit)
            parts = _parts(unit[None], model.codewords.shape[2])[0]
            table = np.einsum("ikd,id->ik", model.codewords, parts)
            score = unit @ model.centroids[where] + table[np.arange(codes_.shape[1])[None], codes_].sum(axis=1)
            least = floor if len(score) < k else max(floor, np.partition(score - error, -k)[-k])
            good = np.flatnonzero(score + error >= least - SLACK)
            at.append(np.full(len(good), i))
            nodes.append(ids[good])
            low.append((score - error)[good])
            high.append((score + error)[good])
        out = rows[keys].iloc[np.concatenate(at)].reset_index(drop=True)
        return out.assign(node_id=np.concatenate(nodes), low=np.concatenate(low), high=np.concatenate(high))

    fields = [asked.schema[c] for c in keys]
    ends = [T.StructField("node_id", codes.schema["node_id"].dataType), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]
    return codes.groupBy("list", "block").cogroup(asked.groupBy("list", "block")).applyInPandas(bound, T.StructType([*fields, *ends]))


def candidates(
    questions: DataFrame, index: VectorIndex, k: int, keys: Sequence[str] = ("query_id",), floor: float = -1.0, probes: int = 4
) -> DataFrame:
    """keys, node_id of all pairs that bounds cannot rule out of the `k` best with a cosine of at least `floor`.

    The likeliest lists of a question give it a floor, its k-th lower bound; other lists are looked at only if they can
    pass that. Codes stay in their buckets, questions move.
    """
    keys = list(keys)
    asked = questions.select(*keys, "embedding").where(F.size("embedding") > 0).withColumn("floor", F.lit(float(floor)))
    near = staged(_bounded(index.codes, _asked(asked, index.model, keys, probes, True), index.model, keys, k), "near")
    kth = top_k(near.withColumn("score", F.col("low")), k, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.min("low").alias("low"))
    floors = staged(kth.where(F.col("n") == k).select(*keys, "low"), "floors")
    again = asked.join(floors, keys, "left").select(*keys, "embedding", F.greatest("floor", F.coalesce("low", F.lit(-1.0))).alias("floor"))
    rest = staged(_bounded(index.codes, _asked(staged(again, "asked"), index.model, keys, probes, False), index.model, keys, k), "rest")
    both = near.unionByName(rest)
    kth = top_k(both.withColumn("score", F.col("low")), k, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.min("low").alias("kth"))
    least = F.when(F.col("n") == k, F.greatest(F.col("kth"), F.lit(float(floor)))).otherwise(F.lit(float(floor)))
    return both.join(kth, keys).where(F.col("high") >= least - 2 * SLACK).select(*keys, "node_id")


def vector_search(
    questions: DataFrame, index: VectorIndex, k: int, keys: Sequence[str] = ("query_id",), exclude_self: bool = False, floor: float = -1.0
) -> DataFrame:
    """The exact `k` nearest by cosine, as `dense_search` gives them, of those that reach `floor`."""
    keys = list(keys)
    pairs = staged(candidates(questions, index, k + int(exclude_self), keys, floor), "candidates")
    if exclude_self:
        pairs = pairs.where(F.col("node_id") != F.col(keys[0]))
    n = pairs.count()
    held = index.vectors.join(broadcast_within(pairs, 96 * n), "node_id")
    own = questions.select(*keys, F.col("embedding").alias("_asked"))
    scored = held.join(own, keys).select(*keys, "node_id", sc.rounded(sc.cosine(F.col("embedding"), F.col("_asked"))).alias("score"))
    return ranked(scored.where(F.col("score") >= floor), keys).where(F.col("rank") <= k)
