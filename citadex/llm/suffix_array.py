"""Enhanced suffix array of a set of byte strings and its common-prefix intervals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WORD = 7  # symbols of nine bits (byte + 1, or 0 beyond the end) that fit one 63-bit key


@dataclass
class SuffixArray:
    """Suffixes of at least `least` bytes in order; `lcp[i]` is shared by suffixes `i - 1` and `i`.

    `owner`, `offset`: the string and the place of each suffix; `before`: the byte to its left, -1 at the start of a string.
    """

    owner: np.ndarray
    offset: np.ndarray
    before: np.ndarray
    lcp: np.ndarray


def suffix_array(strings: list[bytes], least: int) -> SuffixArray:
    """By prefix doubling of what is not unique yet; ranks of all levels are kept for the common prefixes."""
    sizes = np.array([len(s) for s in strings], np.int64)
    body = np.frombuffer(b"".join(strings), np.uint8)
    n = len(body)
    ends = np.repeat(np.cumsum(sizes), sizes)
    place = np.arange(n)
    left = ends - place  # bytes to the end of the string
    symbols = np.concatenate((body.astype(np.int64) + 1, np.zeros(WORD, np.int64)))
    key = np.zeros(n, np.int64)
    for t in range(WORD):
        key = (key << 9) | np.where(t < left, symbols[t : t + n], 0)
    levels: list[tuple[int, np.ndarray]] = []
    length, longest = WORD, int(sizes.max(initial=0))
    # the rank of a suffix is the number of smaller ones; only suffixes that share theirs are sorted again
    open_ = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int32)
    group, follow = np.zeros(n, np.int64), key[open_]
    while n:
        new = np.append(True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1]))
        at = np.arange(len(open_))
        begin = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), at, 0))
        rank[open_] = group + np.maximum.accumulate(np.where(new, at, 0)) - begin
        levels.append((length, rank.copy()))
        open_ = open_[~(new & np.append(new[1:], True))]
        if length >= longest or not len(open_):
            break
        follow = np.zeros(len(open_), np.int64)
        inside = left[open_] > length
        follow[inside] = rank[open_[inside] + length].astype(np.int64) + 1
        group = rank[open_].astype(np.int64)
        order = np.argsort(group * (n + 2) + follow, kind="stable")
        open_, group, follow = open_[order], group[order], follow[order]
        length *= 2
    starts = np.flatnonzero(left >= least)
    order = starts[np.argsort(levels[-1][1][starts], kind="stable")] if n else starts
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        i, j = order[:-1], order[1:]
        most = np.minimum(left[i], left[j])
        at = np.zeros(len(i), np.int64)
        for length, rank in reversed(levels):
            on = at < most
            same = np.zeros(len(i), bool)
            same[on] = rank[i[on] + at[on]] == rank[j[on] + at[on]]
            at += np.where(same, length, 0)
        for _ in range(WORD - 1):
            on = at < most
            same = np.zeros(len(i), bool)
            same[on] = body[i[on] + at[on]] == body[j[on] + at[on]]
            live = same & on
            if not live.any():
                break
            at += live
        lcp[1:] = np.minimum(at, most)
    first = ends - np.repeat(sizes, sizes)
    owner = np.repeat(np.arange(len(strings)), sizes)
    before = np.where(place > first, body[np.maximum(place - 1, 0)].astype(np.int64), -1) if n else place
    return SuffixArray(owner[order], (place - first)[order], before[order], lcp)


@dataclass
class IntervalTree:
    """Nodes with a common prefix of at least the wanted length: first and last suffix, length of the prefix, parent or -1."""

    first: np.ndarray
    last: np.ndarray
    length: np.ndarray
    parent: np.ndarray

    def least_of(self, values: np.ndarray) -> np.ndarray:
        """The smallest of `values` (one per suffix) in each node."""
        if not len(self.first):
            return np.empty(0, values.dtype)
        bounds = np.column_stack((self.first, self.last + 1)).ravel()
        return np.minimum.reduceat(np.append(values, values[-1:]), bounds)[::2]

    def diverse(self, before: np.ndarray) -> np.ndarray:
        """Whether the bytes to the left of a node's suffixes differ; the start of a string differs from everything."""
        low, high = self.least_of(before), -self.least_of(-before)
        return (low < 0) | (low != high)


def interval_tree(lcp: np.ndarray, least: int) -> IntervalTree:
    """One scan over the common prefixes with a stack of open intervals."""
    first: list[int] = []
    last: list[int] = []
    length: list[int] = []
    parent: list[int] = []
    stack: list[int] = []
    near = np.flatnonzero(lcp >= least)
    # after each run of shared prefixes a 0 closes what is open
    closing = near[np.flatnonzero(np.diff(near, append=len(lcp) + 2) > 1)] + 1
    at = np.concatenate((near, closing))
    order = np.argsort(at, kind="stable")
    values = np.concatenate((lcp[near], np.zeros(len(closing), np.int64)))[order]
    for i, value in zip(at[order].tolist(), values.tolist(), strict=True):
        begin, child = i - 1, -1
        while stack and length[stack[-1]] > value:
            child = stack.pop()
            last[child], begin = i - 1, first[child]
            if stack and length[stack[-1]] >= value:
                parent[child] = stack[-1]
        if value and (not stack or length[stack[-1]] < value):
            if child >= 0:
                parent[child] = len(first)
            parent.append(stack[-1] if stack else -1)
            stack.append(len(first))
            first.append(begin)
            last.append(-1)
            length.append(value)
    return IntervalTree(*(np.array(x, np.int64) for x in (first, last, length, parent)))


@dataclass
class Repeats:
    """Maximal repeat groups: `group` and `suffix` list every occurrence of every group, `length` is by group."""

    array: SuffixArray
    group: np.ndarray
    suffix: np.ndarray
    length: np.ndarray


def maximal_repeats(strings: list[bytes], least: int) -> Repeats:
    """Groups of equal substrings of `least` bytes or more that can be extended neither to the right nor to the left.

    An interval cannot be extended to the right by its nature; it is kept if its left extensions are diverse. All
    occurrences are listed, those of nested groups again and again: use it on strings of bounded size.
    """
    array = suffix_array(strings, least)
    tree = interval_tree(array.lcp, least)
    kept = tree.diverse(array.before)
    first, size = tree.first[kept], (tree.last - tree.first + 1)[kept]
    group = np.repeat(np.arange(len(first)), size)
    return Repeats(array, group, np.arange(len(group)) - np.repeat(np.cumsum(size) - size - first, size), tree.length[kept])


def shown_earlier(strings: list[bytes], ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (string, start, stop) that occur in a string with a smaller id, from all occurrences of all maximal repeats.

    Of the nested repeats at a suffix the longest with a smaller id counts. One that extends to the left by a single
    byte adds nothing to the repeat one byte to the left, and is left out. Memory grows with the strings alone.
    """
    array = suffix_array(strings, least)
    tree = interval_tree(array.lcp, least)
    mine = ids[array.owner]
    low, diverse = tree.least_of(mine), tree.diverse(array.before)
    inner = np.full(len(array.owner), -1, np.int64)
    above = np.full(len(tree.first), -1, np.int64)  # the nearest node around with a smaller id
    for k in np.argsort(tree.length, kind="stable").tolist():
        inner[tree.first[k] : tree.last[k] + 1] = k
        p = tree.parent[k]
        if p >= 0:
            above[k] = p if low[p] < low[k] else above[p]
    at = np.flatnonzero(inner >= 0)
    node = inner[at]
    node = np.where(low[node] < mine[at], node, above[node])
    good = (node >= 0) & diverse[node] if len(node) else node >= 0
    at, node = at[good], node[good]
    return array.owner[at], array.offset[at], array.offset[at] + tree.length[node]
