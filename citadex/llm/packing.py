"""Mixture-controlled packing: deficit round-robin over one token queue per source.

Each round gives every queue a share of `round_tokens` by its weight. What a queue may have taken after `r` rounds is
the floor of its exact share, so the fraction that is left over (its deficit) is carried to the next round, and since
that has a closed form, every task places its documents without looking at any other. Rounds follow each other without
gap and are cut into sequences, so only the very last sequence may be short. Queues that run dry leave their share to
the others. Tokens are computed once, stored, and placed in a second pass.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citadex.session import broadcast_within, scratch_path, staged

TOKENS = "queue string, block int, doc_id long, block_start long, n_tokens long, ids binary"
PIECES = T.StructType([
    T.StructField(n, k) for n, k in (
        ("doc_id", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()),
        ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("queue", T.StringType()), ("round", T.LongType()),
    )
])


def byte_level_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and special tokens of a byte-level BPE file, for a library that merges by rank alone.

    That gives the same ids only if ids follow the order of the merges, which is checked.
    """
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    vocab = data["model"]["vocab"]
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in data["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"{path}: ids do not follow the merges")
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}, special


class TextIds:
    """Ids of a text as little-endian words; strings of special tokens in it are those tokens."""

    def __init__(self, path: str, width: int):
        ranks, special = byte_level_ranks(path)
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.kind = f"<u{width}"

    def ids(self, text: str | None) -> bytes:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype(self.kind).tobytes() if text else b""


def _width(path: str) -> int:
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, queue: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Ids of every document, with its place in the stream of its queue inside its block (one block per task)."""
    width = _width(tokenizer)
    end = np.array([end_id], f"<u{width}").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, filled = TextIds(tokenizer, width), {}
        for batch in batches:
            names, blocks, doc_ids, texts = (batch.column(i) for i in range(4))
            for at in range(0, batch.num_rows, 1024):
                out: list[list] = [[], []]
                some = slice(at, at + 1024)
                for name, body in zip(names[some].to_pylist(), texts[some], strict=True):
                    ids = encoder.ids(body.as_py()) + end
                    out[0].append(filled.get(name, 0))
                    out[1].append(ids)
                    filled[name] = out[0][-1] + len(ids) // width
                sizes = [len(x) // width for x in out[1]]
                yield pa.RecordBatch.from_arrays(
                    [names[some], blocks[some], doc_ids[some], pa.array(out[0], pa.int64()), pa.array(sizes, pa.int64()), pa.array(out[1], pa.binary())],
                    names=["queue", "block", "doc_id", "block_start", "n_tokens", "ids"],
                )

    picked = docs.select(F.coalesce(F.col(queue).cast("string"), F.lit("")).alias("q"), F.spark_partition_id().alias("b"), F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    return picked.mapInArrow(encode, TOKENS)


class Layout:
    """Where the tokens of each queue go. Exact integers throughout; size is bounded by the number of queues squared."""

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None, round_tokens: int):
        self.names = sorted(totals)
        self.totals, self.round = [totals[n] for n in self.names], round_tokens
        left, at, taken = list(self.totals), 0, [0] * len(self.names)
        given = [round((weights or {}).get(n, 0) * 10**6) for n in self.names] if weights else list(self.totals)
        #: (first round, tokens taken before it, weights while it lasts)
        self.phases: list[tuple[int, list[int], list[int]]] = []
        while any(left):
            w = [g if rest else 0 for g, rest in zip(given, left, strict=True)]
            w = w if any(w) else list(left)
            total = sum(w)
            self.phases.append((at, taken, w))
            rounds = min(-(-rest * total // (round_tokens * g)) for rest, g in zip(left, w, strict=True) if g)
            at += rounds
            taken = [min(t, b + rounds * round_tokens * g // total) for t, b, g in zip(self.totals, taken, w, strict=True)]
            left = [t - x for t, x in zip(self.totals, taken, strict=True)]
        self.starts = np.array([p[0] for p in self.phases], np.int64)
        self.bases = np.array([p[1] for p in self.phases], np.int64).reshape(len(self.phases), len(self.names))
        self.weights = np.array([p[2] for p in self.phases], np.int64).reshape(len(self.phases), len(self.names))
        #: the last phase up to each in which a queue gives anything
        gives = np.where(self.weights > 0, np.arange(len(self.phases))[:, None], 0)
        self.giving = np.maximum.accumulate(gives, axis=0) if len(gives) else gives

    def taken(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue (second axis) has given before each round."""
        phase = np.maximum(np.searchsorted(self.starts, rounds, "right") - 1, 0)
        w = self.weights[phase]
        share = _share((rounds - self.starts[phase])[:, None] * self.round, w, self.weights.sum(axis=1)[phase][:, None])
        return np.minimum(np.array(self.totals, np.int64), self.bases[phase] + share)

    def round_of(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The rounds that take some tokens of some queues."""
        phase = np.empty(len(queue), np.int64)
        for q in np.unique(queue):
            own = queue == q
            phase[own] = self.giving[np.searchsorted(self.bases[:, q], token[own], "right") - 1, q]
        ahead = token - self.bases[phase, queue] + 1
        return self.starts[phase] + _share(ahead, self.weights.sum(axis=1)[phase], self.round * self.weights[phase, queue], less=1)

    def _bounds(self, rounds: np.ndarray, queue: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token and end of some queues in some rounds, and the place of that part in the whole stream."""
        some, at = np.unique(rounds, return_inverse=True)
        out = np.empty((3, len(rounds)), np.int64)
        order = np.argsort(at, kind="stable")
        step = max(1, (1 << 20) // len(self.names))  # all queues count in every round
        for low in range(0, len(some), step):
            mine = order[slice(*np.searchsorted(at[order], (low, low + step)))]
            a, b = self.taken(some[low : low + step]), self.taken(some[low : low + step] + 1)
            places = a.sum(axis=1, keepdims=True) + np.cumsum(b - a, axis=1) - (b - a)
            for row, values in zip(out, (a, b, places), strict=True):
                row[mine] = values[at[mine] - low, queue[mine]]
        return out[0], out[1], out[2]

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """Number of the document, start in it, tokens, sequence, offset and round of every piece of some documents.

        A document has `n` tokens and starts at `start` in its queue; pieces come in its order.
        """
        doc = np.flatnonzero(n > 0)
        first, last = self.round_of(queue[doc], start[doc]), self.round_of(queue[doc], start[doc] + n[doc] - 1)
        doc, r = _spread(doc, first, last)
        begins, ends, places = self._bounds(r, queue[doc])
        low, high = np.maximum(start[doc], begins), np.minimum(start[doc] + n[doc], ends)
        place = places + low - begins
        full = high > low
        doc, r, low, high, place = (x[full] for x in (doc, r, low, high, place))
        piece, sequence = _spread(np.arange(len(doc)), place // length, (place + high - low - 1) // length)
        begin = np.maximum(place[piece], sequence * length)
        size = np.minimum((place + high - low)[piece], (sequence + 1) * length) - begin
        doc = doc[piece]
        return doc, (low - place)[piece] + begin - start[doc], size, sequence, begin - sequence * length, r[piece]


def _share(x: np.ndarray, w: np.ndarray, total: np.ndarray, less: int = 0) -> np.ndarray:
    """(x * w - less) // total, in unbounded integers where 64 bits might not do."""
    if int(x.max(initial=0)) * int(w.max(initial=0)) >= 1 << 62:
        x, w, total = (v.astype(object) for v in (x, w, total))
    return ((x * w - less) // total).astype(np.int64)


def _spread(rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row once for every number from its first to its last."""
    n = last - first + 1
    return np.repeat(rows, n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, queue: str = "source", text: str = "text", doc_id: str = "doc_id",
    weights: dict[str, float] | None = None, round_sequences: int = 1, max_queues: int = 100_000,
) -> DataFrame:
    """Pieces of documents in sequences of `length` tokens, gapless from offset 0; every token is in exactly one piece.

    A round is one sequence (or `round_sequences`), so each sequence holds the queues in their proportions within a token.
    Without `weights` those are the proportions of the whole corpus, so all run dry together.
    Queues without a weight follow when the weighted ones are dry; nothing is dropped. A null or empty text is its end
    token alone; null and empty sources share one queue; repeated rows are packed each for itself; an empty table gives
    no pieces. One row per queue (at most `max_queues`) reaches the driver. Columns: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, queue, round.
    """
    spark, width = docs.sparkSession, _width(tokenizer)
    path = scratch_path(spark, "tokens")
    tokenise(docs, tokenizer, end_id, queue, text, doc_id).write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(TOKENS).parquet(path)
    blocks = staged(stored.groupBy("queue", "block").agg(F.sum("n_tokens").alias("n")), "blocks")
    before = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("queue", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = {r["queue"]: r["n"] for r in blocks.groupBy("queue").agg(F.sum("n").alias("n")).limit(max_queues + 1).collect()}
    if len(totals) > max_queues:
        raise ValueError(f"more than {max_queues} queues: pack by a coarser column")
    layout = Layout(totals, weights, length * round_sequences)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {n: i for i, n in enumerate(layout.names)}
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            names, docs_, starts, sizes, ids = (batch.column(i) for i in range(5))
            queues = np.array([number[n] for n in names.to_pylist()], np.int64)
            doc, first, size, sequence, offset, r = layout.pieces(queues, starts.to_numpy(), sizes.to_numpy(), length)
            crc: list[int] = []
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
            low, high = (4 * first).tolist(), (4 * (first + size)).tolist()
            for k, body in enumerate(ids):
                wide = np.frombuffer(body.as_buffer(), f"<u{width}").astype("<u4").tobytes()
                crc += [zlib.crc32(wide[low[i] : high[i]]) for i in range(bounds[k], bounds[k + 1])]
            at = pa.array(doc)
            numbers = (first, size, np.array(crc, np.int64), sequence, offset, r)
            start_, size_, crc_, sequence_, offset_, round_ = (pa.array(x, pa.int64()) for x in numbers)
            columns = [docs_.take(at), start_, size_, crc_, sizes.take(at), sequence_, offset_, names.take(at), round_]
            yield pa.RecordBatch.from_arrays(columns, names=PIECES.names)

    # one row per queue and task of the first pass; beyond the measured bound both sides are shuffled
    near = broadcast_within(bases, int(blocks.select(F.sum(F.octet_length("queue") + 64)).first()[0] or 0))
    placed = stored.join(near, ["queue", "block"]).select("queue", "doc_id", (F.col("base") + F.col("block_start")).alias("start"), "n_tokens", "ids")
    return placed.mapInArrow(place, PIECES)
