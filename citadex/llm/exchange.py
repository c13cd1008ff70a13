"""Questions that every part of a corpus asks of all others, without one row per question.

A corpus is stored once in chunks (bucketed by chunk, so that later passes need no shuffle of texts). Every chunk sends
one packed row of sorted keys per key range; one task per range answers all chunks; answers come back in the order of
the questions. Chunks follow the input splits and are cut to a bounded size, ranges are as many as chunks, so both fit
one task at any input size. Rows are sent once per chunk however often a key occurs in it.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citadex.session import scratch_path

ASKED = "part int, chunk int, payload binary"
#: Stored bytes of one chunk at most, by the size of input splits; texts are two to four times as large.
CHUNK_BYTES = 8 << 20


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: differences of sorted unsigned ones, byte planes apart."""
    out = [struct.pack("<H", len(arrays))]
    for a in arrays:
        rising = a.dtype.kind == "u" and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        body = np.concatenate((a[:1], np.diff(a))) if rising else a
        planes = np.ascontiguousarray(body.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()
        data = pa.compress(planes, codec="zstd", asbytes=True)
        out += [struct.pack("<4s?QQ", a.dtype.str[1:].encode(), rising, len(a), len(data)), data]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    n, at, out = struct.unpack_from("<H", data)[0], 2, []
    head = struct.Struct("<4s?QQ")
    for _ in range(n):
        kind, rising, length, size = head.unpack_from(data, at)
        dtype = np.dtype("<" + kind.rstrip(b"\0").decode())
        at += head.size
        planes = pa.decompress(data[at : at + size], decompressed_size=length * dtype.itemsize, codec="zstd", asbytes=True)
        a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype) if length else np.empty(0, dtype)
        out.append(np.cumsum(a, dtype=dtype) if rising else a)
        at += size
    return out


def slices(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of `parts` equal key ranges begins in sorted 64-bit keys; one more entry than parts."""
    edges = np.array([-(-(p << 64) // parts) for p in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


@dataclass
class Chunks:
    """A stored corpus: `rows` has the given columns and `chunk`."""

    rows: DataFrame
    parts: int
    name: str

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def ask(self, fn, n_rows: int = 0) -> DataFrame:
        """`fn(table) -> table` of (part, chunk, payload) for every chunk."""
        return self.rows.groupBy("chunk").applyInArrow(fn, ASKED)

    def hear(self, answers: DataFrame, fn, schema: str) -> DataFrame:
        """`fn(rows, answers) -> table` for every chunk; chunks without answers are called with none."""
        return self.rows.groupBy("chunk").cogroup(answers.where("chunk >= 0").groupBy("chunk")).applyInArrow(fn, schema)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def split_bytes(spark: SparkSession) -> int:
    text = spark.conf.get("spark.sql.files.maxPartitionBytes").lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(text[-1], 0)
    return int(text[:-1] if unit else text) << unit


def chunked(docs: DataFrame) -> Chunks:
    """Store a frame in chunks. Rows stay in the task that reads them; splits beyond `CHUNK_BYTES` are cut by row hash."""
    spark = docs.sparkSession
    cuts = max(1, -(-split_bytes(spark) // CHUNK_BYTES))
    parts = docs.rdd.getNumPartitions() * cuts
    chunk = F.spark_partition_id() * cuts + F.pmod(F.xxhash64(*docs.columns), F.lit(cuts)).cast("int")
    name = f"chunks_{uuid.uuid4().hex}"
    stored = docs.withColumn("chunk", chunk)
    stored.write.option("compression", "zstd").option("path", scratch_path(spark, name)).bucketBy(max(1, parts), "chunk").saveAsTable(name)
    return Chunks(spark.table(name), max(1, parts), name)
