"""Language identification by rank-order profiles.

A profile holds the most frequent character n-grams (one to three, inside words that are padded by blanks), ordered by
frequency. A text belongs to the language whose profile its own ranks are least out of place with.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from citadex.llm.common import fold_of, free_name

UNKNOWN = "und"
PROFILE_SIZE = 300
GUESS = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])
_GUESS = pa.struct([("lang", pa.string()), ("score", pa.float64())])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, repeats included: three code points of 21 bits, leading ones 0 in short grams."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters()[points]
    if not inside.any():
        return np.empty(0, np.int64)
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # the first blank after a word stays
    line = np.where(inside, points, 0x20)[kept].astype(np.int64)
    line = np.concatenate(([0x20], line, [] if line[-1] == 0x20 else [0x20])).astype(np.int64)
    pairs = (line[:-1] << 21) | line[1:]
    triples = ((pairs[:-1] << 21) | line[2:])[line[1:-1] != 0x20]
    return np.concatenate((line[line != 0x20], pairs, triples))


def ranked(codes: np.ndarray, size: int = PROFILE_SIZE) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    found, counts = np.unique(codes, return_counts=True)
    return found[np.lexsort((found, -counts))[:size]]


class Profiles:
    """Ranks of all profiles in one table, so that a text is looked up once."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE_SIZE):
        self.names, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([np.array(profiles[n], np.int64) for n in self.names] or [np.empty(0, np.int64)]))
        self.ranks = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.codes, np.array(profiles[name], np.int64))] = np.arange(len(profiles[name]))

    def guess(self, text: str | None) -> tuple[str, float]:
        codes = grams(text) if text else np.empty(0, np.int64)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(codes, self.size)
        at = np.searchsorted(self.codes, own)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != own] = len(self.codes)
        theirs = self.ranks[:, at]
        out = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(np.argmin(out))
        return self.names[best], float(1 - out[best] / (self.size * len(own)))


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, gram, n over all rows; added up inside each task before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[np.ndarray]] = {}
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held = 0

        def settle() -> None:
            for name, parts in waiting.items():
                found, counts = np.unique(np.concatenate(parts), return_counts=True)
                if name in sums:
                    both, where = np.unique(np.concatenate((sums[name][0], found)), return_inverse=True)
                    counts = np.bincount(where, np.concatenate((sums[name][1], counts))).astype(np.int64)
                    found = both
                sums[name] = found, counts
            waiting.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for name, (found, counts) in sums.items():
                names = pa.array([name], pa.string()).take(pa.array(np.zeros(len(found), np.int64)))
                yield pa.RecordBatch.from_arrays([names, pa.array(found, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = grams(body.as_py())
                if len(codes):
                    waiting.setdefault(name, []).append(codes)
                    held += len(codes)
                if held > 4_000_000:
                    settle()
                    held = 0
                    if sum(len(s[0]) for s in sums.values()) > 4_000_000:
                        yield from flush()
        settle()
        yield from flush()

    picked = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE, max_langs: int = 10_000) -> dict[str, list[int]]:
    """The profile of each language over all given rows. At most `size` rows per language reach the driver.

    Rows without text or language teach nothing; an empty table gives no profile; ties go by code.
    """
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = count_grams(docs, text, lang).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    found = top.limit(max_langs * size + 1).collect()
    if len(found) > max_langs * size:
        raise ValueError(f"more than {max_langs} languages")
    out: dict[str, list[int]] = {}
    for row in sorted(found, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(row["lang"], []).append(row["gram"])
    return out


def guess_language(text: Column, profiles: dict[str, list[int]], size: int = PROFILE_SIZE) -> Column:
    """struct(lang, score) of a whole text; `und` and 0 if it is null, has no letter, or no profile was learned.

    The score is 1 less the share of the largest possible out-of-place distance; ties go to the smaller name.
    """

    @F.arrow_udf(GUESS)
    def guess(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Profiles(profiles, size)
        for batch in texts:
            found = [known.guess(x.as_py()) for x in batch]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], fields=list(_GUESS))

    return guess(text)


def training_rows(docs: DataFrame, folds: int, held_out: int, doc_id: str = "doc_id") -> DataFrame:
    return docs.where(fold_of(F.col(doc_id), folds) != held_out)


def keep_known(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", langs: tuple[str, ...] = (), min_score: float = 0.0) -> DataFrame:
    """The documents whose language is known (and one of `langs`, if given), with their own columns only."""
    name = free_name(docs, "guess")
    guess = F.col(name)
    wanted = (guess["lang"] != UNKNOWN) & (guess["score"] >= min_score)
    return docs.withColumn(name, guess_language(F.col(text), profiles)).where(wanted & guess["lang"].isin(*langs) if langs else wanted).drop(name)
