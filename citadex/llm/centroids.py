"""Exact Lloyd rounds whose nearest-centroid search runs over Walsh-Hadamard coefficients, coarse to fine.

The transform H is integer and H(v - c) = Hv - Hc with |Hv - Hc|^2 = n |v - c|^2, so a sum over the first coefficients is
a lower bound of n times the squared distance, and the sum over all of them is exactly that. Coefficients are taken in
order of sign changes, in levels of 1, 1, 2, 4, ... of them. After a level the centroid that leads is finished; whatever
is already strictly worse than it goes, all others pay for the next level. Vectors are transformed and stored once; sums
per centroid are kept in transformed form and turned back at the end of a round (HH = n), so nothing is rounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadex.llm.common import free_name
from citadex.session import staged

#: Integer components beyond this would let n times a squared distance leave 64 bits.
MAX_COMPONENT = 1 << 24
#: Vectors searched together inside a task.
TILE = 2048


def walsh(x: np.ndarray) -> np.ndarray:
    """The integer transform of the last axis (its length a power of two), coefficients by number of sign changes."""
    n = x.shape[-1]
    out = x.astype(np.int64)
    half = 1
    while half < n:
        pairs = out.reshape(*x.shape[:-1], n // (2 * half), 2, half)
        out = np.concatenate((pairs[..., :1, :] + pairs[..., 1:, :], pairs[..., :1, :] - pairs[..., 1:, :]), axis=-2).reshape(x.shape)
        half *= 2
    return out[..., coarse_first(n)]


def coarse_first(n: int) -> np.ndarray:
    """Rows of the Hadamard matrix of order `n`, fewest sign changes first."""
    signs = reduce(lambda m, _: np.block([[m, m], [m, -m]]), range(n.bit_length() - 1), np.ones((1, 1), np.int8))
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def unwalsh(x: np.ndarray) -> np.ndarray:
    """The vectors (or sums of vectors) that have these coefficients."""
    n = x.shape[-1]
    plain = np.empty_like(x)
    plain[..., coarse_first(n)] = x
    back = walsh(plain)
    plain[..., coarse_first(n)] = back
    return plain // n


def levels(n: int) -> list[tuple[int, int]]:
    edges = [0, *(1 << i for i in range(n.bit_length()))]
    return list(zip(edges, edges[1:], strict=False))


def _leaders(who: np.ndarray, partial: np.ndarray) -> np.ndarray:
    """Where the smallest sum of every vector stands, the first of equal ones."""
    new = np.append(True, who[1:] != who[:-1])[: len(who)]
    if not len(who):
        return np.empty(0, np.int64)
    lead = np.minimum.reduceat(partial, np.flatnonzero(new))
    at = np.flatnonzero(partial == lead[np.cumsum(new) - 1])
    return at[np.append(True, who[at][1:] != who[at][:-1])]


def nearest_centroid(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (ties: the smaller), squared distance, coefficient differences paid for.

    Both sides are transformed vectors.
    """
    rows, k, n = len(vectors), len(centroids), vectors.shape[1]
    who, what = np.repeat(np.arange(rows), k), np.tile(np.arange(k), rows)
    partial = np.zeros(rows * k, np.int64)
    best = np.full(rows, np.iinfo(np.int64).max)
    paid = 0
    for low, high in levels(n):
        gap = vectors[who, low:high] - centroids[what, low:high]
        partial += np.einsum("ij,ij->i", gap, gap)
        paid += gap.size
        if high < n:
            # the leader of every vector is finished; its distance bounds what may stay
            at = _leaders(who, partial)
            rest = vectors[who[at], high:] - centroids[what[at], high:]
            paid += rest.size
            best = np.minimum(best, partial[at] + np.einsum("ij,ij->i", rest, rest))
            stay = partial <= best[who]
            who, what, partial = who[stay], what[stay], partial[stay]
    at = _leaders(who, partial)
    return what[at], partial[at] // n, paid


def integer_vectors(vectors: DataFrame, embedding: str, vec_id: str, size: int, scale: int) -> DataFrame:
    """vec_id, coefficients (binary): rows with exactly `size` components, none null or non-finite."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            values = np.asarray(column.flatten(), np.float64).reshape(-1, size)
            whole = np.floor(scale * values)
            if (np.abs(whole) > MAX_COMPONENT).any():
                raise OverflowError(f"a component beyond {MAX_COMPONENT / scale} has distances beyond 64 bits")
            done = walsh(whole.astype(np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array([v.tobytes() for v in done.astype("<i4")], pa.binary())], names=["vec_id", "v"])

    x = F.col(embedding).cast("array<double>")
    good = F.coalesce(
        (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False)
    )
    picked = vectors.where(good).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))
    return picked.mapInArrow(convert, "vec_id long, v binary")


def _stack(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, size).astype(np.int64)


def _assigned(stored: DataFrame, centroids: np.ndarray, size: int) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                cluster, distance, _ = nearest_centroid(_stack(part.column(1), size), centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return stored.mapInArrow(assign, "vec_id long, cluster int, distance long")


def _moved(stored: DataFrame, centroids: np.ndarray, size: int) -> np.ndarray:
    """Centroids after one round: one row per task and centroid is shuffled, one row per centroid reaches the driver."""
    names = [f"s{i}" for i in range(size)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                v = _stack(batch.column(1).slice(at, TILE), size)
                cluster, _, _ = nearest_centroid(v, centroids)
                np.add.at(total, cluster, v)
                count += np.bincount(cluster, minlength=len(centroids))
        used = np.flatnonzero(count)
        columns = [pa.array(used, pa.int32()), pa.array(count[used]), *(pa.array(np.ascontiguousarray(c)) for c in total[used].T)]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", *names])

    schema = "cluster int, n long, " + ", ".join(f"{s} long" for s in names)
    # sums over many tasks leave 64 bits only as decimals
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *names)]
    out = centroids.copy()
    for row in stored.mapInArrow(sums, schema).groupBy("cluster").agg(*wide).collect():
        coefficients = np.array([int(row[s]) for s in names], object)
        plain = _unwalsh_exact(coefficients, size)
        out[row["cluster"]] = walsh(np.array([s // int(row["n"]) for s in plain], np.int64))
    return out


def _unwalsh_exact(coefficients: np.ndarray, size: int) -> list[int]:
    """`unwalsh` in unbounded integers: sums of a whole corpus need not fit 64 bits."""
    x = [0] * size
    for place, value in zip(coarse_first(size).tolist(), coefficients.tolist(), strict=True):
        x[place] = int(value)
    half = 1
    while half < size:
        for i in range(0, size, 2 * half):
            for j in range(i, i + half):
                x[j], x[j + half] = x[j] + x[j + half], x[j] - x[j + half]
        half *= 2
    return [v // size for v in x]


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, size: int = 64, scale: int = 256, embedding: str = "embedding", vec_id: str = "vec_id",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per vector that takes part.

    A component x counts as floor(scale * x). Centroids 0, 1, ... start as the `k` vectors with the smallest
    sha256 of `seed:vec_id`; `rounds` times every vector goes to its nearest centroid (ties: the smaller number) and
    every centroid with vectors moves to floor(sum / count); then vectors are assigned once more. With fewer vectors
    there are as many centroids. Vectors that are null, of another size, or with a null or non-finite component take no
    part; a null vec_id takes part but starts no centroid unless others are too few; repeated rows count each for
    itself; an empty table gives no rows. Other columns are not looked at. `size` is a power of two. A component beyond
    65,536 raises, as its distances need more than 64 bits. Only `k` rows a round reach the driver.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    stored = staged(integer_vectors(vectors, embedding, vec_id, size, scale), "coefficients")
    rank = free_name(stored, "rank")
    chosen = stored.withColumn(rank, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    start = chosen.orderBy(F.col(rank).asc_nulls_last(), "v").limit(k).collect()
    if not start:
        return _assigned(stored, np.zeros((1, size), np.int64), size).selectExpr(
            "vec_id", "cluster", "distance", "distance AS cluster_inertia", "distance AS inertia", "cast(cluster AS string) AS centroid_sha256"
        )
    centroids = np.array([np.frombuffer(r["v"], "<i4") for r in start], np.int64).reshape(-1, size)
    for _ in range(rounds):
        centroids = _moved(stored, centroids, size)
    found = staged(_assigned(stored, centroids, size), "assigned")
    per = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in unwalsh(centroids).tolist()]
    rows = [(i, total, digests[i]) for i, total in per.items()]
    about = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(about), "cluster")  # at most k rows
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(per.values())).cast("long").alias("inertia"), "centroid_sha256")
