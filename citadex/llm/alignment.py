"""Alignment of two tokenizers over the same bytes, and how often their ids are linked in the whole corpus.

Both id sequences spell the same bytes, so each is an increasing array of end offsets. Where tokens are one to one the
two arrays are equal at a constant shift of their indices: slices of doubling length are compared at the current shift,
halved after a miss, and the whole stretch is taken at once. Where they are not, both sides advance by the smaller end
until the ends meet; that group is closed and the shift updated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citadex.llm.packing import byte_level_ranks
from citadex.session import staged

#: A single space between two characters that are no white space, and what else spaces may meet.
BETWEEN, ODD_SPACE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s | \s")
#: Texts with longer words are encoded whole, so that what is kept of words is bounded.
LONG_WORD = 40
#: Rows of (document, distinct pair) in one chunk; a document with more is a chunk of its own.
CHUNK_PAIRS = 4_000_000
ALIGNED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_pairs long, pairs binary"
TOTALS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into both of strictly increasing end offsets at which a group closes; the last ends are equal."""
    ends_a, ends_b = a.tolist(), b.tolist()
    # slices of bytes compare at once; what follows the ends differs, so a stretch never runs past them
    bytes_a, bytes_b = a.astype("<i8").tobytes() + b"a" * 8, b.astype("<i8").tobytes() + b"b" * 8
    i = j = 0
    from_a: list[int] = []
    from_b: list[int] = []
    lengths: list[int] = []
    while i < len(ends_a):
        x, y = ends_a[i], ends_b[j]
        if x == y:
            p, q, width = 8 * i + 8, 8 * j + 8, 32
            while bytes_a[p : p + width] == bytes_b[q : q + width]:
                p, q, width = p + width, q + width, 2 * width
            while width > 8:
                width >>= 1
                if bytes_a[p : p + width] == bytes_b[q : q + width]:
                    p, q = p + width, q + width
            run = (p >> 3) - i
        else:
            while x != y:
                if x < y:
                    i += 1
                    x = ends_a[i]
                else:
                    j += 1
                    y = ends_b[j]
            run = 1
        from_a.append(i)
        from_b.append(j)
        lengths.append(run)
        i += run
        j += run
    n = np.array(lengths, np.int64)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.array(from_a, np.int64), n) + within, np.repeat(np.array(from_b, np.int64), n) + within


class Words:
    """Ids of words that were met before, so that a word is encoded once and not wherever it stands.

    A cuts its words before a single space between two other characters, and no piece of B holds a space behind anything
    else (which is checked), so neither merges across such a space. All ids of a side lie in one array.
    """

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = [np.empty(0, np.int32), np.empty(0, np.int32)]
        self.end = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def add(self, words: list[str], *sides: tuple[np.ndarray, np.ndarray]) -> None:
        """Ids of the words one after the other, and where each word ends, for A and B."""
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        for i, (ids, ends) in enumerate(sides):
            self.end[i] = np.concatenate((self.end[i], self.end[i][-1] + ends))
            self.flat[i] = np.concatenate((self.flat[i], ids.astype(np.int32)))

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text of these words, None if one is unknown."""
        try:
            at = np.array([self.at[w] for w in words], np.int64)
        except KeyError:
            return None
        out = []
        for flat, end in zip(self.flat, self.end, strict=True):
            begin, n = end[at], end[at + 1] - end[at]
            out.append(flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].astype(np.int64))
        return out[0], out[1]


class TokenizerPair:
    """Ids and bytes of a byte-level BPE file (A) and of a piece model (B) for the same text with a space before it."""

    def __init__(self, byte_bpe: str, pieces: str, limit: int = 500_000):
        ranks, special = byte_level_ranks(byte_bpe)
        self.a = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        size_a = max([*ranks.values(), *special.values()]) + 1
        tokens_a = [b""] * size_a
        for token, i in ranks.items():
            tokens_a[i] = token
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.width = np.dtype("<u2" if max(size_a, len(self.bytes_b)) <= 1 << 16 else "<u4")
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x], np.int64) for x in (tokens_a, self.bytes_b))
        self.by_word = not any(re.search(b"[^ ] ", t) for t in self.bytes_b)
        self.known, self.limit = Words(), limit
        # an id as text, with what follows it inside a group and at its end
        self.inner_a, self.last_a = self._texts(size_a, ","), self._texts(size_a, "|")
        self.inner_b, self.last_b = self._texts(len(self.bytes_b), ","), self._texts(len(self.bytes_b), ";")

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    @staticmethod
    def _texts(n: int, end: str) -> np.ndarray:
        return np.array([f"{i}{end}" for i in range(n)], object)

    def _words(self, text: str) -> list[str] | None:
        """What a text may be cut into, see `Words`; None if it has to be encoded whole."""
        if not self.by_word or "▁" in text or text[0].isspace() or text[-1].isspace():
            return None
        words = BETWEEN.split(text) if ODD_SPACE.search(text) else text.split(" ")
        return words if max(map(len, words)) <= LONG_WORD else None

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both for every text; None without tokens or where the tokens spell other bytes."""
        split = [self._words(t) if t else None for t in texts]
        if len(self.known.at) > self.limit:
            self.known = Words()
        new = sorted(set().union(*(w for w in split if w)) - self.known.at.keys())
        if new:
            self._learn(new)
        for text, words in zip(texts, split, strict=True):
            yield (self.known.ids(words) if words else None) or (self._whole(text) if text else None)

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        a, b, data = self.a.encode_ordinary(f" {text}"), self.b.encode(text), f" {text}".encode()
        same = self.a.decode_bytes(a) == data == b"".join(map(self.bytes_b.__getitem__, b))
        return (np.array(a, np.int64), np.array(b, np.int64)) if same else None

    def _learn(self, words: list[str]) -> None:
        """All new words in one text, cut again where the words end."""
        text = " ".join(words)
        found = self._whole(text)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        if found is None:  # some word is spelled otherwise: it stays unknown to B, and its texts are encoded whole
            return
        self.known.add(words, *((ids, np.searchsorted(np.cumsum(sizes[ids]), ends) + 1) for ids, sizes in zip(found, (self.sizes_a, self.sizes_b), strict=True)))

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the last token of every group."""
        return aligned_ends(np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b]))

    def spelled(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> str:
        """`a1,a2|b1;a3|b2,b3`: groups in order."""
        group_a = np.repeat(np.arange(len(at_a)), np.diff(at_a, prepend=-1))
        group_b = np.repeat(np.arange(len(at_b)), np.diff(at_b, prepend=-1))
        # tokens of A stand behind those of B of all earlier groups, tokens of B behind those of A of their own as well
        place_a = np.arange(len(a)) + np.concatenate(([0], at_b + 1))[group_a]
        place_b = np.arange(len(b)) + (at_a + 1)[group_b]
        out = np.empty(len(a) + len(b), object)
        out[place_a], out[place_b] = self.inner_a[a], self.inner_b[b]
        out[place_a[at_a]], out[place_b[at_b]] = self.last_a[a[at_a]], self.last_b[b[at_b]]
        return "".join(out.tolist())[:-1]


def align_texts(docs: DataFrame, byte_bpe: str, pieces: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """chunk, doc_id, n_a, n_b, n_groups, groups_sha256, n_pairs, pairs (distinct linked ids of A, of B, counts; compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, turn, filled = TokenizerPair(byte_bpe, pieces), 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                out: list[list] = [[] for _ in range(7)]
                for task, found in zip(part.column(0).to_pylist(), pair.encode(part.column(2).to_pylist()), strict=True):
                    row = 0, 0, 0, "", 0, b""
                    if found:
                        a, b = found
                        at_a, at_b = pair.align(a, b)
                        keys, n = np.unique(a[at_a] << 32 | b[at_b], return_counts=True)
                        if filled and filled + len(keys) > CHUNK_PAIRS:
                            turn, filled = turn + 1, 0
                        filled += len(keys)
                        digest = hashlib.sha256(pair.spelled(a, b, at_a, at_b).encode()).hexdigest()
                        row = len(a), len(b), len(at_a), digest, len(keys), _packed(keys, n, pair.width)
                    for column, value in zip(out, ((task << 24) + turn, *row), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                chunk, *rest = (pa.array(c, k) for c, k in zip(out, kinds, strict=True))
                yield pa.RecordBatch.from_arrays([chunk, part.column(1), *rest], names=["chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_pairs", "pairs"])

    picked = docs.select(F.spark_partition_id().cast("long").alias("task"), F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    return picked.mapInArrow(run, ALIGNED)


def _packed(keys: np.ndarray, n: np.ndarray, width: np.dtype) -> bytes:
    ids = np.concatenate((keys >> 32, keys & 0xFFFFFFFF)).astype(width)
    return pa.compress(ids.tobytes() + n.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(pairs: bytes, n: int, width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """One number per distinct pair (id of A, id of B), and how many links hold it."""
    data = pa.decompress(pairs, decompressed_size=n * (2 * width.itemsize + 4), codec="zstd", asbytes=True)
    ids = np.frombuffer(data, width, 2 * n).astype(np.int64)
    return ids[:n] << 32 | ids[n:], np.frombuffer(data, "<u4", n, 2 * n * width.itemsize).astype(np.int64)


def _chunk_pairs(aligned: DataFrame, width: np.dtype) -> DataFrame:
    """chunk, pair, n: distinct pairs of a chunk (of the part of it that a task reads) and their links."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in held])).astype(np.int64)  # exact below 2^53
            for start in range(0, len(keys), 1 << 16):
                some = slice(start, start + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys[some]), chunk), pa.int64()), pa.array(keys[some]), pa.array(n[some])], names=["chunk", "pair", "n"]
                )

        for batch in batches:
            for own, n, pairs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (own != chunk or size > CHUNK_PAIRS):
                    yield from flush()
                    held, size = [], 0
                chunk = own
                held.append(_unpacked(pairs, n, width))
                size += n
        if held:
            yield from flush()

    return aligned.where("n_pairs > 0").select("chunk", "n_pairs", "pairs").mapInArrow(count, "chunk long, pair long, n long")


def cross_tokenizer(docs: DataFrame, byte_bpe: str, pieces: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of `docs`.

    A encodes a space and the text by the byte-level file, B the text by the piece model, which adds the space; strings
    of special tokens are plain text. Offsets at which tokens of both end cut the tokens into groups; the two tokens that
    end there are a link. The count of a pair of ids is the number of its links in the corpus; `n_best` counts links
    whose pair has the highest count of its B id (ties included), `count_sum` adds the counts of all links.

    Null and empty texts, and texts whose tokens spell other bytes, have zeros and an empty digest. Repeated rows (and
    rows of one id) count each for itself, a null id stays null; an empty table gives no rows; other columns are not
    looked at. Texts are encoded once; distinct pairs of every document are stored in chunks of a bounded number of rows,
    a chunk asks for each of its pairs once, and nothing is collected or broadcast.
    """
    width = TokenizerPair(byte_bpe, pieces).width
    aligned = staged(align_texts(docs, byte_bpe, pieces, text, doc_id), "aligned")
    asked = staged(_chunk_pairs(aligned, width), "pairs")
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    counts = staged(counts, "pair-counts")
    of_b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("top"))
    judged = counts.withColumn("b", of_b).join(top, "b").select("pair", F.when(F.col("count") == F.col("top"), F.col("count")).otherwise(-F.col("count")).alias("count"))
    told = asked.select("chunk", "pair").join(judged, "pair")  # twice where two tasks read a chunk, which does no harm

    def total(rows: pa.Table, answers: pa.Table) -> pa.Table:
        pairs, value = answers["pair"].to_numpy(), answers["count"].to_numpy()
        order = np.argsort(pairs, kind="stable")
        pairs, value = pairs[order], value[order]
        best, added = [], []
        for n, body in zip(rows["n_pairs"].to_pylist(), rows["pairs"].to_pylist(), strict=True):
            keys, links = _unpacked(body, n, width) if n else (pairs[:0], value[:0])
            own = value[np.searchsorted(pairs, keys)]
            best.append(int(links[own > 0].sum()))
            added.append(int((links * np.abs(own)).sum()))
        groups = rows["n_groups"]
        columns = [rows["doc_id"], rows["n_a"], rows["n_b"], groups, groups, pa.array(best, pa.int64()), pa.array(added, pa.int64()), rows["groups_sha256"]]
        return pa.table(columns, names=[f.split()[0] for f in TOTALS.split(", ")])

    return aligned.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(total, TOTALS)
