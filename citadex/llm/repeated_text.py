"""Suffix-array dedup: removal of byte strings that also start in a document with a smaller id.

Every string of `least` bytes holds the smallest hash of its 16-byte grams, its mark; equal strings have equal marks.
First all marks are counted over the corpus, so that only passages whose mark is met in two documents move at all. Those
passages are sent to the task of their mark, which builds an enhanced suffix array over the different passages, scans
its common prefixes with a stack, and takes all occurrences of every maximal repeat. Marks with very many documents are
dealt by the strings themselves instead, where one row per chunk and string is left. Exact copies are found first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from citadex.llm.common import mix
from citadex.llm.exchange import ASKED, chunked, packed, slices, unpacked
from citadex.llm.shingles import _BYTE, POWERS
from citadex.llm.suffix_array import shown_earlier
from citadex.session import scratch_path, scratch_scope, staged

GRAM = 16
#: A mark met in more documents than this is dealt by whole strings.
HOT_DOCUMENTS = 4_096
#: Strings per passage; longer runs under one mark are cut, so that periodic text falls into equal passages.
RUN = 256
#: Bytes of passages that share one suffix array; a single group may exceed it.
BATCH_BYTES = 1 << 19
#: A null id counts as larger than any other.
NO_ID = np.iinfo(np.int64).max
COPIES = -1
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>"


def marks(raw: bytes, least: int) -> np.ndarray:
    """The mark of the string of `least` bytes that starts at each byte."""
    n = len(raw) - least + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    body = np.frombuffer(raw, np.uint8)
    up, down = POWERS.to(len(body) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[body] * up[:-1], dtype=np.uint64)))
    low = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(body) - GRAM + 1])
    width, have = least - GRAM + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return mix(low[:n])


class Chunk:
    """Documents of one chunk in the order of their ids, and the runs of strings with one mark."""

    def __init__(self, rows: pa.Table, found: pa.Table, least: int):
        self.least = least
        self.ids = np.array([NO_ID if x is None else x for x in rows["doc_id"].to_pylist()], np.int64)
        self.texts = [b"" if (t := x.as_py()) is None else t.encode() for x in rows["text"]]
        part = found["part"].to_numpy()
        copies = {pair for k in np.flatnonzero(part == COPIES) for pair in zip(*(x.tolist() for x in unpacked(found["payload"][int(k)].as_py())), strict=True)}
        ids = {i for i, _ in copies}
        self.copy = np.array([i in ids and (i, _digest(hashlib.sha256(t).hexdigest())) in copies for i, t in zip(self.ids.tolist(), self.texts, strict=True)], bool)
        order = np.argsort(self.ids, kind="stable")
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.kept = [int(i) for i in order if not self.copy[i] and sizes[i] >= least]
        row, start, count, mark = [], [], [], []
        at = 0
        while at < len(self.kept):
            size, to = 0, at
            while to < len(self.kept) and (size == 0 or size + sizes[self.kept[to]] < 1 << 18):
                size += sizes[self.kept[to]]
                to += 1
            some = np.array(self.kept[at:to], np.int64)
            ends = np.cumsum(sizes[some])
            all_ = marks(b"".join(self.texts[i] for i in some), least)
            place = np.arange(len(all_))
            doc = np.searchsorted(ends, place, "right")
            inside = place + least <= ends[doc]
            place, doc, all_ = place[inside], doc[inside], all_[inside]
            new = np.concatenate(([True], (all_[1:] != all_[:-1]) | (doc[1:] != doc[:-1])))
            first = np.flatnonzero(new)
            row.append(some[doc[first]])
            start.append(place[first] - (ends - sizes[some])[doc[first]])
            count.append(np.diff(np.append(first, len(place))))
            mark.append(all_[first])
            at = to
        join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        self.row, self.start, self.count = join(row, np.int64), join(start, np.int64), join(count, np.int64)
        self.keys, self.key = np.unique(join(mark, np.uint64) & ~np.uint64(0xFFFF), return_inverse=True)

    def asked(self, chunk: int, parts: int) -> pa.Table:
        """Each mark with the number of documents here that hold it."""
        order = np.lexsort((self.row, self.key))
        key, row = self.key[order], self.row[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])))[: len(key)]
        docs = np.bincount(key[new], minlength=len(self.keys)).astype(np.uint32)
        at = slices(self.keys, parts)
        return _rows(chunk, [packed(self.keys[at[p] : at[p + 1]] >> np.uint64(16), docs[at[p] : at[p + 1]]) for p in range(parts)])

    def passages(self, flags: np.ndarray) -> None:
        """Different passages under marks that more than one document holds, and where they occur.

        Documents come in the order of their ids, so the first to show a passage has the smallest id.
        """
        known: dict[bytes, int] = {}
        self.passage: list[bytes] = []
        first, route, occurs = [], [], []
        flag = flags[self.key] if len(self.key) else np.empty(0, np.uint8)
        for i in np.flatnonzero(flag).tolist():
            row, start, count, hot = int(self.row[i]), int(self.start[i]), int(self.count[i]), flag[i] == 2
            text, step = self.texts[row], 1 if hot else RUN
            for p in range(start, start + count, step):
                n = min(step, start + count - p)
                body = text[p : p + n + self.least - 1]
                number = known.get(body)
                if number is None:
                    number = known[body] = len(self.passage)
                    self.passage.append(body)
                    first.append(row)
                    route.append(xxhash.xxh3_64_intdigest(body) if hot else int(self.keys[self.key[i]]))
                occurs.append((row, p, number))
        self.first = np.array(first, np.int64)
        self.occurs = np.array(occurs, np.int64).reshape(-1, 3)
        route = np.array(route, np.uint64)
        self.order = np.argsort(route, kind="stable")
        self.route = route[self.order]

    def sent(self, chunk: int, parts: int) -> pa.Table:
        at = slices(self.route, parts)
        out = []
        for p in range(parts):
            some = self.order[at[p] : at[p + 1]]
            bodies = [self.passage[k] for k in some]
            sizes = np.array([len(b) for b in bodies], np.uint32)
            group = (self.route[at[p] : at[p + 1]] >> np.uint64(16)).astype(np.uint32)
            out.append(packed(np.frombuffer(b"".join(bodies), np.uint8), sizes, self.ids[self.first[some]], group))
        return _rows(chunk, out)

    def spans(self, found: pa.Table) -> list[list[tuple[int, int]]]:
        """Removed runs of each row, merged."""
        out: list[list[tuple[int, int]]] = [[] for _ in self.texts]
        whole = np.zeros(len(self.passage), bool)
        inner: dict[int, list[tuple[int, int]]] = {}
        at = 0
        for all_hit, entry, start, stop in _answers(found):
            whole[self.order[at : at + len(all_hit)]] = all_hit.astype(bool)
            for e, a, b in zip(entry.tolist(), start.tolist(), stop.tolist(), strict=True):
                inner.setdefault(int(self.order[at + e]), []).append((a, b))
            at += len(all_hit)
        if len(self.occurs):
            row, place, number = self.occurs.T
            later = self.ids[row] > self.ids[self.first[number]]
            sizes = np.array([len(b) for b in self.passage], np.int64)[number]
            for r, p, n, size, full in zip(row.tolist(), place.tolist(), number.tolist(), sizes.tolist(), (later | whole[number]).tolist(), strict=True):
                if full:
                    out[r].append((p, p + size))
                else:
                    out[r] += [(p + a, p + b) for a, b in inner.get(n, ())]
        for r in range(len(out)):
            if self.copy[r] and len(self.texts[r]) >= self.least:
                out[r] = [(0, len(self.texts[r]))]
            elif out[r]:
                out[r] = merged(out[r])
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _rows(chunk: int, payloads: list[bytes]) -> pa.Table:
    n = len(payloads)
    return pa.table({"part": pa.array(range(n), pa.int32()), "chunk": pa.array([chunk] * n, pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _answers(found: pa.Table) -> list[list[np.ndarray]]:
    """Unpacked answers in the order of their key ranges."""
    part = found["part"].to_numpy()
    order = np.argsort(part, kind="stable")
    return [unpacked(found["payload"][int(k)].as_py()) for k in order if part[k] >= 0]


def _flags(asked: pa.Table) -> pa.Table:
    """0: one document holds the mark, 1: several, 2: very many."""
    found = [unpacked(p.as_py()) for p in asked["payload"]]
    _, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    docs = np.bincount(where, np.concatenate([f[1] for f in found])) if len(where) else np.empty(0)
    flag = ((docs > 1).astype(np.uint8) + (docs > HOT_DOCUMENTS).astype(np.uint8))[where]
    back = np.split(flag, np.cumsum([len(f[0]) for f in found])[:-1])
    return pa.table({"part": asked["part"], "chunk": asked["chunk"], "payload": pa.array([packed(x.astype(np.uint8)) for x in back], pa.binary())})


def _hits(sent: pa.Table, least: int) -> pa.Table:
    """For each passage: whether a smaller id shows all of it, else the runs of it that smaller ids show.

    Strings can only be equal under one mark, so each group of passages is looked at alone. A group of one passage
    needs no suffix array; the others are taken together up to `BATCH_BYTES`.
    """
    number: dict[bytes, int] = {}
    entries, docs, under = [], [], []
    for payload in sent["payload"]:
        body, sizes, ids, group = unpacked(payload.as_py())
        raw, at, found = body.tobytes(), 0, []
        for size, mark in zip(sizes.tolist(), group.tolist(), strict=True):
            text = raw[at : at + size]
            at += size
            found.append(k := number.setdefault(text, len(number)))
            if k == len(under):
                under.append(mark)
        entries.append(np.array(found, np.int64))
        docs.append(ids)
    strings = list(number)
    del number
    first = np.full(len(strings), NO_ID, np.int64)
    for e, d in zip(entries, docs, strict=True):
        np.minimum.at(first, e, d)
    joined: dict[int, list[tuple[int, int]]] = {}
    for some in _batches(strings, np.array(under, np.int64)):
        spans: dict[int, list[tuple[int, int]]] = {}
        for o, a, b in zip(*(x.tolist() for x in shown_earlier([strings[k] for k in some], first[some], least)), strict=True):
            spans.setdefault(int(some[o]), []).append((a, b))
        joined |= {o: merged(x) for o, x in spans.items()}
    out = []
    for e, d in zip(entries, docs, strict=True):
        whole = d > first[e]
        runs = [(k, a, b) for k, o in enumerate(e.tolist()) if o in joined and not whole[k] for a, b in joined[o]]
        table = np.array(runs, np.uint32).reshape(-1, 3)
        out.append(packed(whole.astype(np.uint8), *(np.ascontiguousarray(table[:, i]) for i in range(3))))
    return pa.table({"part": sent["part"], "chunk": sent["chunk"], "payload": pa.array(out, pa.binary())})


def _batches(strings: list[bytes], under: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the strings that share their group with another, whole groups together."""
    order = np.argsort(under, kind="stable")
    begins = np.flatnonzero(np.diff(under[order], prepend=-1))
    batch: list[np.ndarray] = []
    size = 0
    for group in np.split(order, begins[1:]):
        if len(group) < 2:
            continue
        batch.append(group)
        size += sum(len(strings[k]) for k in group)
        if size > BATCH_BYTES:
            yield np.concatenate(batch)
            batch, size = [], 0
    if batch:
        yield np.concatenate(batch)


def _digest(text: str) -> int:
    return int(text[:16], 16)


def _packed_copies(rows: pa.Table) -> pa.Table:
    """Copies of one chunk by id and text: rows of one id may have different texts."""
    pairs = sorted(set(zip(rows["doc_id"].to_pylist(), map(_digest, rows["digest"].to_pylist()), strict=True)))
    body = packed(np.array([i for i, _ in pairs], np.int64), np.array([d for _, d in pairs], np.uint64))
    return pa.table({"part": pa.array([COPIES], pa.int32()), "chunk": rows["chunk"].slice(0, 1), "payload": pa.array([body], pa.binary())})


def _pass_over(docs: DataFrame, least: int, finish: Callable[[Chunk, list, pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """Run all passes; `docs` has doc_id and text, `finish` gets the removed runs of each row of a chunk."""
    if least < GRAM:
        raise ValueError(f"strings of fewer than {GRAM} bytes are not supported")
    spark = docs.sparkSession
    path = scratch_path(spark, "removed")
    with scratch_scope(spark):
        chunks = chunked(docs)
        try:
            parts = 2 * chunks.parts
            known = chunks.rows.where("doc_id IS NOT NULL").select("chunk", "doc_id", F.sha2("text", 256).alias("digest")).where("digest IS NOT NULL")
            firsts = staged(known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"), "firsts")
            copies = known.join(firsts, "digest").where("doc_id > first").select("chunk", "doc_id", "digest")
            copies = staged(copies.groupBy("chunk").applyInArrow(_packed_copies, ASKED), "copies")
            asked = chunks.hear(copies, lambda rows, found: Chunk(rows, found, least).asked(rows["chunk"][0].as_py(), parts) if rows.num_rows else _rows(0, []), ASKED)
            flags = staged(asked.groupBy("part").applyInArrow(_flags, ASKED), "flags")

            def prepared(rows: pa.Table, found: pa.Table) -> Chunk:
                chunk = Chunk(rows, found, least)
                answers = [f for f in _answers(found) if len(f) == 1]
                chunk.passages(np.concatenate([f[0] for f in answers] or [np.empty(0, np.uint8)]))
                return chunk

            def send(rows: pa.Table, found: pa.Table) -> pa.Table:
                return prepared(rows, found).sent(rows["chunk"][0].as_py(), parts) if rows.num_rows else _rows(0, [])

            sent = chunks.hear(copies.union(flags), send, ASKED)
            hits = staged(sent.groupBy("part").applyInArrow(lambda table: _hits(table, least), ASKED), "hits")

            def end(rows: pa.Table, found: pa.Table) -> pa.Table:
                chunk = prepared(rows, found)
                part = found["part"].to_numpy()
                mine = found.take(pa.array(np.flatnonzero(part >= parts)))
                return finish(chunk, chunk.spans(mine), rows)

            # answers of the last pass are told from flags by their key range
            later = hits.select((F.col("part") + parts).alias("part"), "chunk", "payload")
            chunks.hear(copies.union(flags).union(later), end, schema).write.parquet(path)
        finally:
            chunks.close()
    return spark.read.schema(schema).parquet(path)


def repeated_spans(docs: DataFrame, least: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of every row.

    A byte is removed if it lies in a string of `least` bytes that also starts in a document with a smaller id. Strings
    are judged on the input; texts are UTF-8 bytes and null ones empty; matches never cross documents. Texts shorter
    than `least` stay whole; a text that equals one with a smaller id goes; rows with one id do not touch each other; a
    null id counts as the largest. An empty table gives no rows.
    """

    def digest(chunk: Chunk, spans: list, rows: pa.Table) -> pa.Table:
        return pa.table({
            "doc_id": rows["doc_id"], "n_bytes": pa.array([len(t) for t in chunk.texts], pa.int64()),
            "n_removed": pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), "n_spans": pa.array([len(s) for s in spans], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(kept_bytes(t, s)).hexdigest() for t, s in zip(chunk.texts, spans, strict=True)], pa.string()),
            "spans": pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        })

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _pass_over(picked, least, digest, DIGEST)


def without_repeats(docs: DataFrame, least: int = 50, text: str = "text", doc_id: str = "doc_id", length: str | None = "n_chars") -> DataFrame:
    """The rows of `docs` with removed bytes cut out of their texts; all other columns stay.

    What is left of a character that was cut in two is dropped. The column `length`, if there is one, is the new number
    of characters. A null text stays null.
    """
    columns = docs.columns
    inner = docs.select(F.struct(*(F.col(c) for c in columns if c != text)).alias("rest"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([StructField("rest", inner.schema["rest"].dataType), StructField("text", StringType())])

    def cut(chunk: Chunk, spans: list, rows: pa.Table) -> pa.Table:
        new = [
            None if was is None else kept_bytes(raw, s).decode(errors="ignore") if s else was
            for was, raw, s in zip(rows["text"].to_pylist(), chunk.texts, spans, strict=True)
        ]
        return pa.table({"rest": rows["rest"], "text": pa.array(new, pa.string())})

    out = _pass_over(inner, least, cut, schema)
    size = F.length("text").cast(docs.schema[length].dataType) if length in columns else None
    return out.select(*(F.col("text").alias(c) if c == text else size.alias(c) if c == length else F.col(f"rest.`{c}`").alias(c) for c in columns))
