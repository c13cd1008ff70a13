"""Language-model scores by deleted interpolation.

Bigram, unigram and uniform estimates are mixed by weights that depend on how often the context occurs. The weights are
learned by expectation-maximisation on held-out counts: every training token is held out in turn, that is, its own
occurrence is deleted from the counts that predict it. Counts cover all training texts; they are added up per key range,
and every chunk of the corpus hears the totals of the keys that it holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadex.llm.common import LOWER, fold_of, mix
from citadex.llm.exchange import ASKED, Chunks, chunked, packed, slices, unpacked
from citadex.llm.shingles import _BYTE, BASE, POWERS
from citadex.session import staged

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
END = np.uint64(0x0123456789ABCDEF)
SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)
_SCORES = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
])
HISTOGRAM = "context int, bin2 int, bin1 int, n long, sum2 double, sum1 double"
N_CONTEXTS = 65


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, an end after each, and the number of tokens of each text."""
    hashes, counts = [], []
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (size == 0 or size + len(texts[to]) < 1 << 18):
            size += len(texts[to]) + 1
            to += 1
        line = np.frombuffer(b" ".join([*texts[at:to], b""]).translate(LOWER), np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[line], [True]))))
        first, last = edges[::2], edges[1::2]
        up, down = POWERS.to(len(line) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[line] * up[:-1], dtype=np.uint64)))
        words = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(BASE))
        ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
        n = np.diff(np.concatenate(([0], np.searchsorted(first, ends))))
        hashes.append(np.insert(words, np.cumsum(n), END))
        counts.append(n + 1)
        at = to
    return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


class Chunk:
    """Tokens and bigrams of one chunk, as places in its sorted distinct keys. Bigram keys keep 48 bits of their hash."""

    def __init__(self, rows: pa.Table):
        texts = [(x.as_py() or "").encode() for x in rows["text"]]
        flat, self.sizes = tokens(texts)
        self.train = np.repeat(~rows["held_out"].to_numpy(), self.sizes)
        self.words, self.word = np.unique(flat, return_inverse=True)
        before = np.concatenate(([END], flat[:-1])) if len(flat) else flat
        self.context = np.concatenate(([np.searchsorted(self.words, END)], self.word[:-1])) if len(flat) else self.word
        self.pairs, self.pair = np.unique(mix(before * np.uint64(BASE) + flat) & ~np.uint64(0xFFFF), return_inverse=True)

    def asked(self, chunk: int, parts: int) -> pa.Table:
        words = np.bincount(self.word, self.train, minlength=len(self.words)).astype(np.int64)
        pairs = np.bincount(self.pair, self.train, minlength=len(self.pairs)).astype(np.int64)
        i, j = slices(self.words, parts), slices(self.pairs, parts)
        body = [
            packed(self.words[i[p] : i[p + 1]], words[i[p] : i[p + 1]], self.pairs[j[p] : j[p + 1]] >> np.uint64(16), pairs[j[p] : j[p + 1]])
            for p in range(parts)
        ]
        return pa.table({"part": pa.array(range(parts), pa.int32()), "chunk": pa.array([chunk] * parts, pa.int32()), "payload": pa.array(body, pa.binary())})

    def counts(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training counts of every token, of its context and of both together."""
        order = np.argsort(answers["part"].to_numpy())
        found = [unpacked(answers["payload"][int(k)].as_py()) for k in order]
        words = np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)])
        pairs = np.concatenate([f[1] for f in found] or [np.empty(0, np.int64)])
        return words[self.word], words[self.context], pairs[self.pair]


def _totals(asked: pa.Table) -> pa.Table:
    """One key range: counts of all chunks added up, sent back to each; chunk -1 holds tokens and distinct tokens."""
    found = [unpacked(p.as_py()) for p in asked["payload"]]
    out: list[list[np.ndarray]] = []
    n = v = 0
    for keys, counts in ((0, 1), (2, 3)):
        _, where = np.unique(np.concatenate([f[keys] for f in found]), return_inverse=True)
        total = np.bincount(where, np.concatenate([f[counts] for f in found])).astype(np.int64) if len(where) else np.empty(0, np.int64)
        if keys == 0:
            n, v = int(total.sum()), int((total > 0).sum())
        out.append(np.split(total[where], np.cumsum([len(f[keys]) for f in found])[:-1]))
    small = [packed(w.astype(np.int64), p.astype(np.int64)) for w, p in zip(*out, strict=True)]
    part = asked["part"].to_pylist()
    return pa.table({
        "part": pa.array([*part, part[0]], pa.int32()), "chunk": pa.array([*asked["chunk"].to_pylist(), -1], pa.int32()),
        "payload": pa.array([*small, packed(np.array([n, v], np.int64))], pa.binary()),
    })


def _histogram(words: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, n: int) -> pa.Table:
    """Held-out estimates of training tokens, gathered in bins a quarter of a power of two wide."""
    f2 = np.where(contexts > 1, (pairs - 1) / np.maximum(contexts - 1, 1), 0.0)
    f1 = (words - 1) / max(n - 1, 1)
    context = np.frexp(np.maximum(contexts - 1, 0).astype(np.float64))[1]
    bins = [np.where(f > 0, np.floor(4 * np.log2(np.where(f > 0, f, 1.0))), -1000).astype(np.int64) for f in (f2, f1)]
    key = (context.astype(np.int64) << 24) + ((bins[0] + 1000) << 12) + (bins[1] + 1000)
    keys, where = np.unique(key, return_inverse=True)
    return pa.table({
        "context": pa.array(keys >> 24, pa.int32()), "bin2": pa.array((keys >> 12) & 4095, pa.int32()), "bin1": pa.array(keys & 4095, pa.int32()),
        "n": pa.array(np.bincount(where, minlength=len(keys)), pa.int64()),
        "sum2": pa.array(np.bincount(where, f2, minlength=len(keys)), pa.float64()), "sum1": pa.array(np.bincount(where, f1, minlength=len(keys)), pa.float64()),
    })


def learn_weights(histogram: list[tuple[int, int, float, float]], v: int, steps: int = 100) -> np.ndarray:
    """Weights (bigram, unigram, uniform) per context bucket by expectation-maximisation; rows are (context, n, mean f2, mean f1).

    A bucket without events takes the weights of the next lower one that has some; without any event all is uniform.
    """
    out = np.tile([0.0, 0.0, 1.0], (N_CONTEXTS, 1))
    seen = set()
    for context in sorted({h[0] for h in histogram}):
        some = np.array([h[1:] for h in histogram if h[0] == context], float)
        f = np.column_stack((some[:, 1], some[:, 2], np.full(len(some), 1 / (v + 1))))
        weights = np.full(3, 1 / 3)
        for _ in range(steps):
            share = weights * f
            weights = (some[:, :1] * share / share.sum(axis=1, keepdims=True)).sum(axis=0)
            weights /= weights.sum()
        out[context] = weights
        seen.add(context)
    for context in range(1, N_CONTEXTS):
        if context not in seen:
            out[context] = out[context - 1]
    if 0 not in seen and seen:
        out[0] = [0.0, 0.5, 0.5]
    return out


def score_texts(docs: DataFrame, folds: int = 7, held_out: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learned from the other folds.

    A null or empty text is its end token. Repeated rows count, and are scored, each for itself. Without training rows
    every token has probability 1 / (0 + 1). Two numbers and a histogram of bounded size reach the driver. Tokens are
    told apart by 64 bits of a hash.
    """
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold_of(F.col(doc_id), folds) == held_out).alias("held_out"), F.col(text).alias("text"))
    chunks: Chunks = chunked(picked)
    parts = chunks.parts
    asked = chunks.ask(lambda rows: Chunk(rows).asked(rows["chunk"][0].as_py(), parts))
    answers = staged(asked.groupBy("part").applyInArrow(_totals, ASKED), "answers")
    totals = [unpacked(r["payload"])[0] for r in answers.where("chunk = -1").select("payload").toLocalIterator()]
    n, v = (int(x) for x in np.sum(totals, axis=0)) if totals else (0, 0)

    def held(rows: pa.Table, found: pa.Table) -> pa.Table:
        chunk = Chunk(rows)
        return _histogram(*(x[chunk.train] for x in chunk.counts(found)), n)

    bins = chunks.hear(answers, held, HISTOGRAM).groupBy("context", "bin2", "bin1").agg(F.sum("n").alias("n"), F.sum("sum2").alias("s2"), F.sum("sum1").alias("s1"))
    weights = learn_weights([(r["context"], r["n"], r["s2"] / r["n"], r["s1"] / r["n"]) for r in bins.orderBy("context", "bin2", "bin1").collect()], v)

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        chunk = Chunk(rows)
        words, contexts, pairs = chunk.counts(found)
        mine = weights[np.frexp(contexts.astype(np.float64))[1]]
        p = mine[:, 0] * np.where(contexts > 0, pairs / np.maximum(contexts, 1), 0.0) + mine[:, 1] * words / max(n, 1) + mine[:, 2] / (v + 1)
        starts = np.concatenate(([0], np.cumsum(chunk.sizes)[:-1]))
        add = lambda x: np.add.reduceat(x, starts) if len(x) else x
        columns = [
            rows["doc_id"], rows["held_out"], pa.array(chunk.sizes.astype(np.int64)), pa.array(add((words > 0).astype(np.int64)), pa.int64()),
            pa.array(np.full(len(starts), n, np.int64)) if rows.num_rows else pa.array([], pa.int64()),
            pa.array(add(np.log10((words + 1) / (n + v + 1))), pa.float64()), pa.array(add(np.log10(np.maximum(p, 1e-300))), pa.float64()),
        ]
        return pa.Table.from_arrays(columns, schema=_SCORES)

    out = staged(chunks.hear(answers, score, SCORES), "scores")
    chunks.close()
    return out
