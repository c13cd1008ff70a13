"""What the operators of this folder share: tables, fixed folds, word tables, batches of Arrow rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that belong to a word: digits, letters and everything outside ASCII. Upper case counts after folding.
WORD_BYTES = bytes(b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: A byte of a text -> the byte of its folded form; all that is no word is a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in WORD_BYTES else 0x20 for b in range(256))
#: Only A-Z is folded.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold_of(doc_id: Column, n: int) -> Column:
    """The remainder that assigns a document to a fold; a null id is in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(-1))


def words_of(text: str | None) -> list[bytes]:
    """Folded words of a text as UTF-8 bytes."""
    return [] if text is None else text.encode().translate(FOLD).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words with full avalanche (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem
