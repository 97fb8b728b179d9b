"""Suffix-array dedup over bytes by bucket-pointer refinement.

A shard's regions (see windows.py) are one byte sequence. Suffixes start in
buckets by their first q bytes. A round sorts the members of every bucket that
still has company by the bucket of the suffix d bytes later, which sorts to
depth 2d; the new bucket pointers are what the next round reads, so each round
doubles the depth, and suffixes alone in their bucket take no further part. The
last round looks just as far as the window's length, so that its buckets hold
equal windows exactly. Buckets whose regions occur twice or more in the corpus
are repeats.

Edge cases: null and empty texts have no bytes; texts shorter than a window keep
all; repeated rows lose all bytes that a window covers; an empty table gives an
empty table. Kept bytes may be cut inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .windows import Kind, remove_repeats

Q = 8


def _buckets(members: np.ndarray, key: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """Sort members by key inside their buckets, move pointers to the new buckets' first places, return who has company."""
    order = np.argsort(key)
    members, key = members[order], key[order]
    old = pointer[members]
    place = np.arange(len(key))
    differs = lambda x: np.concatenate(([True], x[1:] != x[:-1]))
    first = differs(key)
    pointer[members] = old + np.maximum.accumulate(np.where(first, place, 0)) - np.maximum.accumulate(np.where(differs(old), place, 0))
    return members[~(first & np.concatenate((first[1:], [True])))]


def refine(seq: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Window starts (places marked in starts) whose window of `length` bytes also starts elsewhere."""
    n, q = len(seq), min(Q, length)
    if n < length:
        return np.zeros(0, np.int64)
    padded = np.concatenate([seq, np.zeros(q, np.uint8)]).astype(np.uint64)
    grams = np.zeros(n, np.uint64)
    for i in range(q):
        grams = grams << np.uint64(8) | padded[i : i + n]
    pointer = np.zeros(n + length, np.int64)  # all in one bucket
    live = _buckets(np.arange(n), grams, pointer)
    del grams, padded
    depth = q
    while depth < length and len(live):
        step = min(depth, length - depth)
        if depth + step == length:
            live = live[starts[live]]
        live = _buckets(live, pointer[live] * (n + 1) + pointer[live + step], pointer)
        depth += step
    return live[starts[live]]


def solve(contents: list[bytes], counts: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    sizes = np.array([len(c) for c in contents])
    seq = np.frombuffer(b"".join(contents), np.uint8)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(contents)), sizes)
    starts = np.arange(len(seq)) + length <= (begin + sizes)[owner]
    repeated = np.zeros(len(seq), bool)
    repeated[refine(seq, starts, length)] = True  # in company: two places at least
    repeated |= starts & (counts > 1)[owner]  # one bucket, its region's weight over one
    at = np.flatnonzero(repeated)
    if len(at):
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))))
        stop = np.concatenate((new[1:], [len(at)])) - 1
        o = owner[at[new]]
        yield from zip(o.tolist(), (at[new] - begin[o]).tolist(), (at[stop] - begin[o]).tolist())


def drop_repeated_bytes(docs: DataFrame, length: int = 200, gram: int = 64, **kw) -> DataFrame:
    """Documents without bytes that a string of `length` bytes covers which starts elsewhere too."""
    return remove_repeats(docs, Kind("byte", length, min(gram, length), solve), **kw)
