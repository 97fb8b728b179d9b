"""Repeated windows of a fixed length, brought together without all-pairs work.

For exact substring dedup, a window is `length` units (words or bytes) of one
document. Every window belongs to the k-gram with the smallest hash inside it
(winnowing), so equal windows belong to equal k-grams. Runs of windows that
belong to equal k-grams are a region. Regions whose k-gram occurs once
cannot hold a repeated window and are dropped; the others are dealt by k-gram to
shards, equal regions once with their number of occurrences, and an index per
shard decides exactly. A k-gram with over `hot` occurrences, or with over 40 times
as many windows (as in periodic text), would fill a shard of its own without bound;
it is not given to one index: its distinct regions are judged window by window, by a
128-bit hash that is counted with partial aggregation. Windows of one k-gram cannot
be dealt further by what lies inside them, since those that matter share nearly all.

Rows are told apart by a 64-bit hash of id and text; repeated rows are separate
places, so all their windows repeat.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_NEXT_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_SPACES = bytes(32 if b else i for i, b in enumerate(_BLANK))
BLOCK = 1 << 20
#: A region is packed as (first window start * RUN + windows) * 2 + whether its k-gram recurs in it; a block holds fewer windows than that.
RUN = 1 << 22
_P, _PINV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK + 4096, 1 << int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _P), np.full(size, _PINV)
        up[0] = down[0] = 1
        _POWERS[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    up, down = _POWERS[size]
    return up[:n], down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _spans_hash(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of units[start:end] by prefix sums modulo 2^64."""
    up, down = _powers(len(units) + 1)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * up[: len(units)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts])


def words_of(data: bytes) -> list[bytes]:
    return [w for w in data.translate(_SPACES).split(b" ") if w]


def _word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = np.zeros(len(buf) + 2, bool)
    solid[1:-1] = ~_BLANK[buf]
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[::2], edge[1::2]


def word_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many each text has; blocks end at blanks."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (size == 0 or size + len(texts[to]) < BLOCK):
            size += len(texts[to]) + 1
            to += 1
        joined, pos = b"\n".join(texts[at:to]), 0
        limits = np.cumsum([len(t) + 1 for t in texts[at:to]])
        while pos < len(joined):
            stop = _NEXT_BLANK.search(joined, pos + 2 * BLOCK) if len(joined) - pos > 2 * BLOCK else None
            end = stop.start() if stop else len(joined)
            buf = np.frombuffer(joined, np.uint8, end - pos, pos)
            a, z = _word_bounds(buf)
            hashes.append(_spans_hash(buf.astype(np.uint64) + np.uint64(1), a, z))
            np.add.at(counts, at + np.searchsorted(limits, pos + a, side="right"), 1)
            pos = end
        at = to
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def byte_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)


def _slide_min(x: np.ndarray, width: int) -> np.ndarray:
    cover = 1
    while 2 * cover <= width:
        x = np.minimum(x[:-cover], x[cover:])
        cover *= 2
    return np.minimum(x[: len(x) - (width - cover)], x[width - cover :]) if cover < width else x


def owned_runs(units: np.ndarray, counts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(hash of the k-gram, document's place, first window start, windows, whether the k-gram occurs in it again) of each region."""
    n = len(units)
    begin = np.concatenate(([0], np.cumsum(counts)))
    out = []
    for at in range(0, n, BLOCK):
        part = units[at : at + BLOCK + length - 1]
        if len(part) < length:
            break
        grams = np.arange(len(part) - k + 1)
        h = _spans_hash(part.astype(np.uint64) + np.uint64(1), grams, grams + k)
        low = np.uint64((1 << 24) - 1)
        least = (_slide_min((h & ~low) | grams.astype(np.uint64), length - k + 1) & low).astype(np.int64)
        s = at + np.arange(len(least))
        doc = np.searchsorted(begin, s, side="right") - 1
        ok = np.flatnonzero(s + length <= begin[doc + 1])
        if not len(ok):
            continue
        place, s, doc = least[ok], s[ok], doc[ok]
        own = h[place]
        new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (s[1:] != s[:-1] + 1) | (doc[1:] != doc[:-1]))))
        sizes = np.diff(np.concatenate((new, [len(s)])))
        moved = np.concatenate(([0], place[1:] != place[:-1])).astype(np.int64)
        again = np.add.reduceat(moved, new) > moved[new]
        out.append((own[new], doc[new], s[new] - begin[doc[new]], sizes, again))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*out))


@dataclass(frozen=True)
class Kind:
    """What a unit is, and how long windows and k-grams are. solve gets (contents, counts) of a shard
    and yields (place, first window start, last window start) of repeated windows."""

    name: str  # "word" or "byte"
    length: int
    k: int
    solve: Callable[[list[bytes], np.ndarray, int], Iterator[tuple[int, int, int]]]

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return word_units(texts) if self.name == "word" else byte_units(texts)

    def split(self, data: bytes):
        return words_of(data) if self.name == "word" else data

    def join(self, units) -> bytes:
        return b" ".join(units) if self.name == "word" else units


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _groups(values: list, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Slices of a batch of at most so many bytes, one text at least."""
    at = size = 0
    for i, v in enumerate(values):
        if i > at and size + len(v) > most:
            yield at, i
            at, size = i, 0
        size += len(v)
    if at < len(values):
        yield at, len(values)


def remove_repeats(
    docs: DataFrame, kind: Kind, shard_mb: float = 4, hot: int = 50_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, spans (of removed units), kept (bytes)."""
    length, k = kind.length, kind.k
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("key", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "t"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0).to_numpy(), [_bytes(t) for t in b.column(1).to_pylist()]
            for a, z in _groups(texts):
                h, doc, start, size, again = owned_runs(*kind.units(texts[a:z]), length, k)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[a:z][doc]), pa.array((start * RUN + size) * 2 + again)], ["h", "key", "at"])

    grams = rows.select("key", "t").mapInArrow(scan, "h long, key long, at long")
    windows = F.pmod(F.floor(F.col("at") / 2), F.lit(RUN))
    often = grams.groupBy("h").agg(F.sum(1 + F.col("at") % 2).alias("n"), F.sum(windows).alias("w")).where("n > 1")
    mine = grams.join(often, "h").select("key", F.struct("h", "at", ((F.col("n") > hot) | (F.col("w") > 40 * hot)).alias("hot")).alias("r"))
    mine = mine.groupBy("key").agg(F.collect_set("r").alias("regions"))  # bounded by the document's own length

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = [z.compress(_bytes(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["doc_id", "key", "z"])

    small = rows.select("doc_id", "key", "t").mapInArrow(squeeze, "doc_id long, key long, z binary")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, seen = zstandard.ZstdDecompressor(), set()
        for b in batches:
            out: list[tuple] = []
            for key, data, regions in zip(*(b.column(i) for i in range(3))):
                units = kind.split(z.decompress(data.as_py()))
                key = key.as_py()
                for r in regions.as_py():
                    a, size = divmod(r["at"] // 2, RUN)
                    if a + size + length - 1 > len(units):
                        continue  # another row's region under the same 64-bit key
                    content = kind.join(units[a : a + size + length - 1])
                    rid = xxhash.xxh3_128_digest(content)
                    if len(seen) > 500_000:
                        seen.clear()
                    out.append((r["h"], rid, key, a, None if rid in seen else content, r["hot"]))
                    seen.add(rid)
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    joined = small.join(mine, "key").select("key", "z", "regions")
    found = cut(joined.mapInArrow(extract, "h long, rid binary, key long, a long, content binary, hot boolean"))
    regions = found.groupBy("h", "rid").agg(F.count(F.lit(1)).alias("n"), F.first("content", ignorenulls=True).alias("content"), F.first("hot").alias("hot"))
    total = found.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)), F.coalesce(F.max(F.col("hot").cast("int")), F.lit(0))).first()
    shards = max(1, int(-(-total[0] // int(shard_mb * 1e6))))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rids = pdf["rid"].tolist()
        got = np.array(list(kind.solve(pdf["content"].tolist(), pdf["n"].to_numpy(), length)), np.int64).reshape(-1, 3)
        return pd.DataFrame({"rid": [rids[i] for i in got[:, 0]], "s0": got[:, 1], "s1": got[:, 2]})

    dealt = regions.where(~F.col("hot")).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    repeats = dealt.select("shard", "rid", "n", "content").groupBy("shard").applyInPandas(solve, "rid binary, s0 long, s1 long")
    if total[1]:
        repeats = repeats.unionByName(_one_by_one(regions.where("hot"), kind))

    # one row a region, with all its runs: each place of a region is joined with one row; bounded by the region's own length
    runs = repeats.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("s0", "s1"))).alias("runs"))
    back = found.select("rid", "key", "a").join(runs, "rid")
    moved = F.transform("runs", lambda r: F.struct((F.col("a") + r["s0"]).alias("s0"), (F.col("a") + r["s1"] + length).alias("s1")))
    spans = back.groupBy("key").agg(F.flatten(F.collect_set(moved)).alias("cuts"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for doc, data, cuts in zip(*(b.column(i) for i in range(3))):
                units = kind.split(z.decompress(data.as_py()))
                runs = merged([(c["s0"], c["s1"]) for c in cuts.as_py() or []])
                kept, at = [], 0
                for s, e in runs:
                    kept.append(units[at:s])
                    at = e
                kept.append(units[at:])
                joined = b"".join(kept) if kind.name == "byte" else b" ".join(w for p in kept for w in p)
                out.append((doc.as_py(), len(units), sum(e - s for s, e in runs), len(runs), [{"start": s, "end": e} for s, e in runs], joined))
            cols = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _OUT.types)], names=_OUT.names)

    left = small.join(spans, "key", "left").select("doc_id", "z", "cuts")
    return left.mapInArrow(finish, "doc_id long, n_units long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
)
_FOUND = pa.schema([("h", pa.int64()), ("rid", pa.binary()), ("key", pa.int64()), ("a", pa.int64()), ("content", pa.binary()), ("hot", pa.bool_())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _FOUND.types)], names=_FOUND.names)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _one_by_one(regions: DataFrame, kind: Kind) -> DataFrame:
    """The exact way for k-grams too frequent for one index: each window's 128-bit hash is counted."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rid, n, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                units = kind.split(content)
                m = len(units) - kind.length + 1
                hashes = [xxhash.xxh3_128_digest(kind.join(units[s : s + kind.length])) for s in range(m)]
                yield pa.RecordBatch.from_arrays([pa.array([rid] * m, pa.binary()), pa.array([n] * m, pa.int64()), pa.array(hashes, pa.binary()), pa.array(range(m), pa.int64())], ["rid", "n", "w", "s"])

    w = regions.select("rid", "n", "content").mapInArrow(windows, "rid binary, n long, w binary, s long")
    often = w.groupBy("w").agg(F.sum("n").alias("m")).where("m > 1").select("w")
    again = w.join(often, "w").select("rid", "s")
    island = F.col("s") - F.row_number().over(Window.partitionBy("rid").orderBy("s"))  # the same for windows in a row
    return again.withColumn("i", island).groupBy("rid", "i").agg(F.min("s").alias("s0"), F.max("s").alias("s1")).drop("i")
