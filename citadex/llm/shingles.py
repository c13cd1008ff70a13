"""Bags of word shingles and their BagMinHash signatures."""

from __future__ import annotations

import numpy as np

from citadex.llm.common import FOLD, mix

BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
_STEP, _REGISTER, _CELL = (np.uint64(c) for c in (0xD1342543DE82EF95, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class _Powers:
    """Powers of the base and of its inverse, as far as texts have needed them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(BASE, k, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(BASE, -k, 1 << 64))))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def word_hashes(text: str, fold: bytes = FOLD) -> np.ndarray:
    """A 64-bit hash of each word, all words at once; `fold` turns what separates words into spaces."""
    folded = np.frombuffer(text.encode().translate(fold), np.uint8)
    inside = np.concatenate(([False], folded != 0x20, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    up, down = POWERS.to(len(folded) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[folded] * up[:-1], dtype=np.uint64)))
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(BASE))


def bag(text: str | None, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of `size` words (sorted hashes) and how often each occurs; a shorter text is one shingle."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(BASE) + words[i : i + len(out)])
    return np.unique(out, return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 0 if one is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def _unit(x: np.ndarray) -> np.ndarray:
    """A number in (0, 1] from 64 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signature(shingles: np.ndarray, counts: np.ndarray, m: int = 100) -> np.ndarray:
    """`m` registers; two bags agree in a register with the probability of their weighted Jaccard similarity.

    Each shingle has a Poisson process over time and weight. The weight axis is cut at 0, 1, 2, 4, 8, ...; a cell of
    that grid has a process of its own, whose points are placed by halving the cell bit by bit down to unit weights, and
    only points below the shingle's weight count, so that bags with other weights see the same points. A point falls
    into one register, a register keeps the earliest. Points are made up to a time by which all registers are expected
    to be filled; if one is not, the time is doubled.
    """
    seeds, starts, weights = [], [], []
    level, start = 0, 0
    while (some := counts > start).any():
        seeds.append(mix(shingles[some] ^ mix(np.full(1, level + 1, np.uint64) * np.uint64(BASE))))
        starts.append(np.full(int(some.sum()), start, np.int64))
        weights.append(counts[some])
        level, start = level + 1, max(1, start * 2)
    seed, low, weight = np.concatenate(seeds), np.concatenate(starts), np.concatenate(weights)
    width = np.maximum(low, 1)
    until = m * (np.log(m) + 3) / float(counts.sum())
    while True:
        out = np.full(m, np.inf)
        live, at, k = np.arange(len(seed)), np.zeros(len(seed)), 0
        step = 1
        while len(live):
            own = seed[live][:, None] + (np.arange(k + 1, k + step + 1, dtype=np.uint64) * _STEP)[None, :]
            draw = mix(own)
            times = at[live][:, None] + np.cumsum(-np.log(_unit(draw)) / width[live][:, None], axis=1)
            cell = low[live][:, None] + (mix(draw ^ _CELL) & (width[live] - 1).astype(np.uint64)[:, None]).astype(np.int64)
            good = (times <= until) & (cell < weight[live][:, None])
            np.minimum.at(out, (mix(draw[good] ^ _REGISTER) % np.uint64(m)).astype(np.int64), times[good])
            at[live] = times[:, -1]
            live = live[times[:, -1] <= until]
            k += step
            step = min(64, max(1, int(until * (width[live].max() if len(live) else 0)) + 1))
        if np.isfinite(out).all():
            return out.view(np.uint64)
        until *= 2


def bands(registers: np.ndarray, rows: int) -> np.ndarray:
    """One key per run of `rows` registers."""
    out = np.arange(1, len(registers) // rows + 1, dtype=np.uint64) * np.uint64(BASE)
    for i in range(rows):
        out = mix(out * np.uint64(BASE) + registers[i::rows][: len(out)])
    return out.view(np.int64)
