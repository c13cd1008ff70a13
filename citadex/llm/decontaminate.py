"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items, texts scanned once.

Texts are folded to words (A-Z lower-cased, digits, letters, everything outside ASCII). Every run of `width` words of an
item is a pattern; an item of fewer words is one pattern. Matches are mapped back to words and to characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from citadex.llm.common import FOLD, free_name, words_of
from citadex.session import staged

SPAN = StructType([StructField(n, LongType()) for n in ("first_word", "last_word", "start", "stop")])
FOUND = StructType([StructField("n_words", LongType()), StructField("spans", ArrayType(SPAN)), StructField("items", ArrayType(StringType()))])
_SPAN = pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "start", "stop")])
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string()))])


def windows(items: list[tuple[str, str | None]], width: int) -> dict[bytes, tuple[int, frozenset[str]]]:
    """Pattern -> number of words, ids of the items that hold it."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        n = min(width, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            found.setdefault(b" ".join((b"", *words[i : i + n], b"")), (n, set()))[1].add(item)
    return {k: (n, frozenset(ids)) for k, (n, ids) in found.items()}


class Scanner:
    """The automaton. Bytes stand for characters one to one, so that offsets are byte offsets."""

    def __init__(self, patterns: dict[bytes, tuple[int, frozenset[str]]]):
        self.automaton = ahocorasick.Automaton() if patterns else None
        for key, value in patterns.items():
            self.automaton.add_word(key.decode("latin-1"), value)
        if patterns:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> dict:
        raw = (text or "").encode()
        folded = raw.translate(FOLD)
        words = folded.split()
        found = {"n_words": len(words), "spans": [], "items": []}
        if not words or self.automaton is None:
            return found
        line = b" ".join((b"", *words, b""))
        hits = list(self.automaton.iter(line.decode("latin-1")))
        if hits:
            gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
            last = np.searchsorted(gaps, [end for end, _ in hits]) - 1
            runs = joined((int(j) - n + 1, int(j)) for j, (_, (n, _)) in zip(last, hits, strict=True))
            found["spans"] = offsets(raw, folded, runs)
            found["items"] = sorted(set().union(*(ids for _, (_, ids) in hits)))
        return found


def joined(runs) -> list[tuple[int, int]]:
    """Inclusive runs of words, overlapping and adjacent ones made one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def offsets(raw: bytes, folded: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words with the characters of the original text that they cover."""
    inside = np.concatenate(([False], np.frombuffer(folded, np.uint8) != 0x20, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [{"first_word": a, "last_word": b, "start": int(chars[starts[a]]), "stop": int(chars[stops[b]])} for a, b in runs]


def _scanned(text: Column, items: list[tuple[str, str | None]], width: int) -> Column:
    @F.arrow_udf(FOUND)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(windows(items, width))
        for batch in texts:
            yield pa.array([scanner.scan(x.as_py()) for x in batch], _FOUND)

    return scan(text)


def find_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 10,
    out: str = "found", part_bytes: int = 64 << 20,
) -> DataFrame:
    """All columns of `docs` and `out`: n_words, disjoint hit spans (words and characters), ids of the items found.

    The items reach the tasks in one automaton as long as their texts stay within `part_bytes`, which is measured; a
    larger list is cut into parts by id, with one pass over the texts per part. Null and empty texts have no words; an
    item without words is never found; items that share a pattern are all found; repeated rows count each for itself.
    """
    picked = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    size = picked.select(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = 1 + int(size) // part_bytes
    for part in range(parts):
        some = [tuple(r) for r in picked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()]
        if parts == 1:
            return docs.withColumn(out, _scanned(F.col(text), some, width))
        now = free_name(docs, "found_now")
        docs = docs.withColumn(now, _scanned(F.col(text), some, width))
        if part:
            both = F.struct(
                F.col(now)["n_words"].alias("n_words"), F.array_sort(F.concat(F.col(out)["spans"], F.col(now)["spans"])).alias("spans"),
                F.array_sort(F.array_union(F.col(out)["items"], F.col(now)["items"])).alias("items"),
            )
            docs = staged(docs.withColumn(out, both).drop(now), "found")
        else:
            docs = staged(docs.withColumnRenamed(now, out), "found")
    return docs


def hit_words(spans: Column) -> Column:
    """How many words the spans cover; spans are sorted by their first word and may overlap."""
    start = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans, start,
        lambda a, s: F.struct(
            F.greatest(a["last"], s["last_word"]).alias("last"),
            (a["n"] + F.greatest(s["last_word"] - F.greatest(s["first_word"] - 1, a["last"]), F.lit(0))).alias("n"),
        ),
        lambda a: a["n"],
    )


def contamination(found: DataFrame, out: str = "found") -> DataFrame:
    """Counts and digest of `find_items` in place of its column."""
    hit = hit_words(F.col(out)["spans"])
    return found.withColumns({
        "n_words": F.col(out)["n_words"], "n_hit": hit, "n_items": F.size(F.col(out)["items"]).cast("long"),
        "items_sha256": F.sha2(F.array_join(F.col(out)["items"], ","), 256), "contaminated": hit > 0,
    }).drop(out)


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents in which no item is found, with their own columns only."""
    out = free_name(docs, "found")
    return find_items(docs, items, text=text, out=out, **options).where(F.size(F.col(out)["items"]) == 0).drop(out)
