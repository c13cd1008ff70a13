"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Pre-tokens that share a prefix share the nodes of the trie, and the forward score of a node (the best score of any
segmentation of its prefix) is computed once. A terminal node keeps its token count, so a pre-token that was met before
costs one look-up. The vocabulary is that of a public tokenizer; the model gives a piece of rank r the probability of
Zipf's law, 1 / (r + 2.7), normalised.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

COUNT = StructType([StructField("n_tokens", LongType()), StructField("n_pretokens", LongType()), StructField("score", DoubleType())])
_COUNT = pa.struct([("n_tokens", pa.int64()), ("n_pretokens", pa.int64()), ("score", pa.float64())])
ZIPF_SHIFT = 2.7


def unigram_model(path: str) -> dict[bytes, float]:
    """Piece -> log probability, from a file of lines `base64 rank`. Every single byte must be a piece."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: not every byte is a piece")
    total = math.log(math.fsum(1 / (r + ZIPF_SHIFT) for r in ranks.values()))
    return {piece: -math.log(rank + ZIPF_SHIFT) - total for piece, rank in ranks.items()}


class Trie:
    """Nodes of all pre-tokens seen so far. Node 0 is the empty prefix; beyond `limit` nodes the trie starts anew."""

    def __init__(self, model: dict[bytes, float], limit: int = 600_000):
        self.model, self.limit = model, limit
        self.longest = max(map(len, model))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.count = [0.0], [0]
        self.terminal: dict[str, tuple[int, float]] = {}

    def insert(self, piece: str) -> tuple[int, float]:
        """Token count and score of a pre-token. Among equal scores the segmentation with fewer tokens wins."""
        if len(self.score) > self.limit:
            self.clear()
        data, child, score, count, model = piece.encode(), self.child, self.score, self.count, self.model
        path, node, known = [0], 0, True
        for i, byte in enumerate(data, 1):
            key = node << 8 | byte
            found = child.get(key) if known else None
            if found is None:
                known = False
                best, fewest = -math.inf, 0
                for start in range(max(0, i - self.longest), i):
                    own = model.get(data[start:i])
                    if own is not None:
                        before = path[start]
                        total = score[before] + own
                        if total > best or (total == best and count[before] + 1 < fewest):
                            best, fewest = total, count[before] + 1
                found = child[key] = len(score)
                score.append(best)
                count.append(fewest)
            path.append(node := found)
        self.terminal[piece] = out = count[node], score[node]
        return out

    def totals(self, pieces: list[str]) -> tuple[int, int, float]:
        found = [self.terminal.get(piece) or self.insert(piece) for piece in pieces]
        return sum(f[0] for f in found), len(found), math.fsum(f[1] for f in found)


def count_tokens(text: Column, vocabulary: str, limit: int = 600_000) -> Column:
    """struct(n_tokens, n_pretokens, score) of a whole text. Null and empty texts have no token and score 0.

    Nothing is shuffled; a task holds one trie of at most `limit` nodes and one pre-token more. Repeated rows count
    each for itself.
    """

    @F.arrow_udf(COUNT)
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        trie, split = Trie(unigram_model(vocabulary), limit), regex.compile(PATTERN).findall
        for batch in texts:
            found = [trie.totals(split(t)) if (t := x.as_py()) else (0, 0, 0.0) for x in batch]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.StructArray.from_arrays([pa.array([f[i] for f in found], kinds[i]) for i in range(3)], fields=list(_COUNT))

    return count(text)
