"""Substring dedup over words with a compressed FM-index per shard.

A shard's texts (see windows.py) become one sequence with an end mark after
each; its Burrows-Wheeler transform is kept in a wavelet matrix of packed bits
with rank counts. Occurrence counts weigh each text by how often it stands in
the corpus. Texts are streamed against the index, all of a shard in step: one
backward search from a text's end gives the matching statistic there; where it
breaks off, the windows before are searched on their own. Windows that occur
twice or more are reported.

Edge cases: null and empty texts have no words; texts shorter than a window keep
all; repeated rows lose all words that a window covers; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .windows import Kind, remove_repeats


class Wavelet:
    """Rank over a sequence of symbols below 2^levels, one packed bit row a level."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels, self.bits, self.sums, self.zeros = levels, [], [], []
        n = len(seq)
        for level in range(levels - 1, -1, -1):
            b = (seq >> level & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, bool)
            padded[:n] = b
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.sums.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))[:-1].astype(np.int32))
            self.zeros.append(n - int(b.sum()))
            seq = np.concatenate([seq[~b], seq[b]])
        self.first = np.zeros(1 << levels, np.int64)  # where a symbol's block begins in the last order
        change = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1]))) if n else np.zeros(0, np.int64)
        self.first[seq[change]] = change

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before place at."""
        i = at
        for k in range(self.levels):
            word = i >> 6
            ones = self.sums[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))
            i = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i - self.first[symbol]


def suffix_order(rank: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes sorted; end marks have ranks of their own, so `longest` symbols decide."""
    n, d = len(rank), 1
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while d < longest + 1:
        later = np.zeros(n, np.int64)
        later[: n - d] = rank[d:] + 1
        key = rank * (n + 1) + later
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        d *= 2
    return order


class FMIndex:
    def __init__(self, texts: list[np.ndarray], weights: np.ndarray, symbols: int):
        """Texts of symbols 1 to symbols; 0 is the end mark."""
        sizes = np.array([len(t) for t in texts])
        seq = np.zeros(int(sizes.sum()) + len(texts), np.int64)
        ends = np.cumsum(sizes + 1) - 1
        solid = np.ones(len(seq), bool)
        solid[ends] = False
        seq[solid] = np.concatenate(texts) if len(texts) else []
        _, rank = np.unique(seq, return_inverse=True)
        rank = rank + len(texts)
        rank[ends] = np.arange(len(texts))
        order = suffix_order(rank, int(sizes.max(initial=0)))
        bwt = seq[order - 1]
        self.wavelet = Wavelet(bwt, max(1, int(symbols).bit_length()))
        counts = np.bincount(seq, minlength=symbols + 1)
        self.before = np.concatenate(([0], np.cumsum(counts)[:-1]))
        owner = np.repeat(np.arange(len(texts)), sizes + 1)
        self.weight = np.concatenate(([0], np.cumsum(weights[owner[order]])))
        self.size = len(seq)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return self.before[symbol] + both[: len(lo)], self.before[symbol] + both[len(lo) :]

    def count(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.weight[hi] - self.weight[lo]

    def match_back(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray, least: int = 2) -> np.ndarray:
        """For each [start, end) of flat, how far back from its end it occurs `least` times."""
        at = end.copy()
        live = np.flatnonzero(at > start)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.size)
        while len(live):
            lo, hi = self.step(flat[at[live] - 1], lo, hi)
            ok = self.count(lo, hi) >= least
            live, lo, hi = live[ok], lo[ok], hi[ok]
            at[live] -= 1
            on = at[live] > start[live]
            live, lo, hi = live[on], lo[on], hi[on]
        return at


def solve(contents: list[bytes], counts: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    ids: dict[bytes, int] = {}
    texts = [np.fromiter((ids.setdefault(w, len(ids) + 1) for w in c.split(b" ")), np.int64) for c in contents]
    index = FMIndex(texts, counts, len(ids))
    flat = np.concatenate(texts)
    sizes = np.array([len(t) for t in texts])
    end = np.cumsum(sizes)
    start = end - sizes
    reached = index.match_back(flat, start, end)
    last = sizes - length
    good = np.flatnonzero(end - reached >= length)
    yield from zip(good.tolist(), (reached - start)[good].tolist(), last[good].tolist())
    # windows that begin before the place where the search broke off
    rest = np.minimum(reached - start, last + 1)
    text = np.repeat(np.arange(len(texts)), rest)
    s = np.arange(len(text)) - np.repeat(np.cumsum(rest) - rest, rest)
    a = start[text] + s
    hit = index.match_back(flat, a, a + length) == a
    text, s = text[hit], s[hit]
    if len(s):
        new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (s[1:] != s[:-1] + 1))))
        stop = np.concatenate((new[1:], [len(s)])) - 1
        yield from zip(text[new].tolist(), s[new].tolist(), s[stop].tolist())


def drop_repeated_words(docs: DataFrame, words: int = 35, gram: int = 10, **kw) -> DataFrame:
    """Documents without words that a window of `words` words covers which occurs elsewhere too."""
    return remove_repeats(docs, Kind("word", words, min(gram, words), solve), **kw)
