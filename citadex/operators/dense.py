"""Cosine search over tables of vectors, scored in numpy blocks inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citadex.functions import scoring as sc
from citadex.operators.fusion import ranked
from citadex.session import measured_bytes, small_enough
from citadex.settings import BLOCK_ROWS, SCORE_DIGITS

#: Questions scored at once against one block of vectors.
QUESTION_ROWS = 2_048


def _unit(vectors: Sequence) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _block_hits(keys: pd.DataFrame, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The `k` best rows of one block for each question; ties go to the smaller id.

    Questions are scored in tiles, so the score matrix is bounded whatever their number. `_row` numbers the question.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    n = len(ids)
    rows, columns, kept = [], [], []
    for start in range(0, len(queries), QUESTION_ROWS):
        scores = queries[start:start + QUESTION_ROWS] @ vectors.T
        if n > k:  # one number per cell that orders by rounded score, then by smaller id
            place = np.rint(scores * 10**SCORE_DIGITS).astype(np.int64) * n + np.arange(n - 1, -1, -1)
            best = np.argpartition(place, n - k, axis=1)[:, n - k:]
        else:
            best = np.tile(np.arange(n), (len(scores), 1))
        rows.append(np.repeat(np.arange(start, start + len(scores)), best.shape[1]))
        columns.append(best.ravel())
        kept.append(np.take_along_axis(scores, best, axis=1).ravel())
    row, column = np.concatenate(rows), np.concatenate(columns)
    out = keys.iloc[row].reset_index(drop=True)
    return out.assign(node_id=ids[column], score=np.concatenate(kept), _row=row)


def _cut(hits: pd.DataFrame, k: int) -> pd.DataFrame:
    """The `k` best hits of each question among those of several blocks."""
    ordered = hits.assign(_shown=-hits["score"].round(SCORE_DIGITS)).sort_values(["_row", "_shown", "node_id"], kind="stable")
    return ordered.groupby("_row").head(k).drop(columns="_shown")


def _result_schema(queries: DataFrame, vectors: DataFrame, keys: Sequence[str]) -> T.StructType:
    fields = [queries.schema[c] for c in keys]
    return T.StructType([*fields, T.StructField("node_id", vectors.schema["node_id"].dataType), T.StructField("score", T.DoubleType())])


def _top(scored: DataFrame, keys: Sequence[str], k: int, exclude_self: bool) -> DataFrame:
    if exclude_self:
        scored = scored.where(F.col("node_id") != F.col(keys[0]))
    return ranked(scored.withColumn("score", sc.rounded(F.col("score"))), keys).where(F.col("rank") <= k)


def dense_search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    keys: Sequence[str] = ("query_id",),
    exclude_self: bool = False,
    broadcast: bool | None = None,
) -> DataFrame:
    """The exact `k` nearest nodes by cosine; both sides hold `embedding`.

    A question side of measured small size goes to every task, and the vectors are not shuffled at
    all; a task keeps the best rows over all its blocks and gives back at most `k` per question. Beyond the limit both sides meet in bounded blocks, see `probed_search`.
    """
    if broadcast is None:
        broadcast = small_enough(measured_bytes(queries, *keys, "embedding"))
    if not broadcast:
        return probed_search(queries, vectors, k, keys, bits=0, radius=0, exclude_self=exclude_self)
    keys, fetch = list(keys), k + int(exclude_self)
    asked = queries.select(*keys, "embedding").where(F.size("embedding") > 0).toPandas()
    schema = _result_schema(queries, vectors, keys)
    if asked.empty:
        return _top(queries.sparkSession.createDataFrame([], schema), keys, k, exclude_self)
    shared = queries.sparkSession.sparkContext.broadcast((asked[keys], _unit(asked["embedding"])))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, matrix = shared.value
        held: pd.DataFrame | None = None
        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[start:start + BLOCK_ROWS]
                new = _block_hits(names, matrix, part["node_id"].to_numpy(), _unit(part["embedding"]), fetch)
                held = new if held is None else pd.concat([held, new], ignore_index=True)
                if len(held) > 4 * fetch * len(names):
                    held = _cut(held, fetch)
        if held is not None:
            yield _cut(held, fetch).drop(columns="_row")

    held = vectors.select("node_id", "embedding").where(F.size("embedding") > 0)
    return _top(held.mapInPandas(score, schema), keys, k, exclude_self)


def _cell(embedding: Column, bits: int, dim: int, seed: int) -> Column:
    """Which side of `bits` fixed random planes a vector lies on, as a number."""
    planes = np.random.default_rng(seed).standard_normal((bits, dim))
    cell = F.lit(0).cast("long")
    for bit, plane in enumerate(planes):
        side = sc.dot(embedding, F.array(*[F.lit(float(x)) for x in plane])) > 0
        cell = cell + F.when(side, F.lit(1 << bit)).otherwise(F.lit(0))
    return cell


def probed_search(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    keys: Sequence[str] = ("query_id",),
    bits: int = 6,
    radius: int = 2,
    seed: int = 7,
    exclude_self: bool = False,
) -> DataFrame:
    """Nearest nodes among the cells within `radius` plane flips of the question's own cell.

    With `bits=0` there is one cell, so the result is exact. Cells are counted first, and a cell of
    any size is split into blocks of about `BLOCK_ROWS` rows; the questions are split in the same
    way. A task holds one block of each and gives back at most `k` rows per question.
    """
    keys, fetch = list(keys), k + int(exclude_self)
    schema = _result_schema(queries, vectors, keys)
    held = vectors.select("node_id", "embedding").where(F.size("embedding") > 0)
    asked = queries.select(*keys, "embedding").where(F.size("embedding") > 0)
    first = held.select(F.size("embedding")).first()
    dim = first[0] if first else 0
    n_cells, parts = 1 << bits, max(1, -(-asked.count() // BLOCK_ROWS))

    located = held.withColumn("cell", _cell(F.col("embedding"), bits, dim, seed))
    counts = located.groupBy("cell").agg(F.count("*").alias("n"))  # at most 2**bits rows
    blocks = F.broadcast(counts.select("cell", F.ceil(F.col("n") / BLOCK_ROWS).alias("blocks")))
    left = (
        located.join(blocks, "cell")
        .withColumn("block", F.pmod(F.xxhash64("node_id"), F.col("blocks")))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        .select("cell", "block", "part", "node_id", "embedding")
    )
    near = [c for c in range(n_cells) if c.bit_count() <= radius]
    right = (
        asked.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        .withColumn("_own", _cell(F.col("embedding"), bits, dim, seed))
        .withColumn("_flip", F.explode(F.array(*[F.lit(c).cast("long") for c in near])))
        .withColumn("cell", F.col("_own").bitwiseXOR(F.col("_flip")))
        .join(blocks, "cell")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("cell", "block", "part", *keys, "embedding")
    )

    def score(nodes: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        if nodes.empty or questions.empty:
            return pd.DataFrame(columns=[*keys, "node_id", "score"])
        return _block_hits(
            questions[keys], _unit(questions["embedding"]),
            nodes["node_id"].to_numpy(), _unit(nodes["embedding"]), fetch,
        ).drop(columns="_row")

    place = ["cell", "block", "part"]
    scored = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInPandas(score, schema)
    return _top(scored, keys, k, exclude_self)
