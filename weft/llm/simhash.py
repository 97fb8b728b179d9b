"""SimHash near-dedup with deletion-variant signatures.

A fingerprint has a bit set where over half of the document's shingle hashes
have it. With at most k differing bits, cutting the 64 bits into k // 2 + 1
segments leaves one segment that differs by at most one bit. Each segment is
indexed once as it is and once per bit position with that bit left out; an
equality join on (segment, wildcard, remaining bits) finds every linked pair,
and each candidate is verified on all 64 bits.

Documents are first reduced to distinct fingerprints, so copies cost nothing
after that. Inside a bucket only a spanning forest of the verified links is
emitted, never all pairs. A bucket over `bucket_rows` is split: the bits that its
members need not share are cut into max_bits + 1 slices, of which every linked
pair shares one, and the bucket is dealt by each slice. What is still too large
is dealt again by the bits left over, until no group is over the bound; since
fingerprints are distinct, that takes few rounds. Components follow by rounds of
alternating min-label stars with a table written to the shared folder in between;
their number grows with the logarithm of the longest chain, and a run that has not
settled after `max_rounds` ends with an error, never with wrong components.

Edge cases: null and empty texts have fingerprint zero and link to one another;
texts with fewer words than a shingle are one shingle; repeated rows keep one
row each; an empty table gives an empty table; a null id takes part, and comes
last in the choice of a component's smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_counted

SEED = 42
#: A-Z to a-z; and the six blanks to a space, so that words can be split fast.
_FOLD = {i: i + 32 for i in range(65, 91)} | {i: 32 for i in range(9, 14)}
_FOLD_BYTES = bytes(_FOLD.get(i, i) for i in range(256))


def fingerprint(text: str | None, words: int) -> int:
    """Over all shingles of `words` words, repeats included, XXH64 of each in UTF-8."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD_BYTES).split(b" ")
    parts = [p for p in parts if p]
    if not parts:
        return 0
    joined, n = b" ".join(parts), len(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, n)
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:z], SEED) for a, z in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, n - k + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t, words) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "id long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments, max_bits // 2 + 1 of them."""
    n = max_bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, z - a) for a, z in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(max_bits: int) -> F.Column:
    """array<struct<seg, rest>>: each segment whole, and with each bit left out."""
    out = []
    for s, (at, width) in enumerate(segments(max_bits)):
        part = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else F.col("fp")
        out.append(F.struct(F.lit(s * 65).alias("seg"), part.alias("rest"), F.lit(0).alias("bit")))
        for j in range(width):
            mask = _signed(~(1 << j) & ((1 << 64) - 1))
            bit = F.shiftrightunsigned("fp", at + j).bitwiseAND(F.lit(1)).cast("int")
            out.append(F.struct(F.lit(s * 65 + 1 + j).alias("seg"), part.bitwiseAND(F.lit(mask)).alias("rest"), bit.alias("bit")))
    return F.array(*out)


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges that join what links among distinct uint64 fingerprints: breadth first, one row against the rest."""
    left, edges = fps.copy(), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                found = left[near]
                edges += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return edges


def _deal(groups: DataFrame, max_bits: int) -> DataFrame:
    """groups(g, used, fp), used being the bits that a group's members share or ignore: dealt by each slice of the other bits."""
    slices: dict[int, list[int]] = {}

    def masks(used: int) -> list[int]:
        if used not in slices:
            free = [1 << i for i in range(64) if not used >> i & 1]
            edges = [len(free) * i // (max_bits + 1) for i in range(max_bits + 2)]
            slices[used] = [sum(free[a:z]) for a, z in zip(edges, edges[1:])]
        return slices[used]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, used, fp = (b.column(i).to_numpy() for i in range(3))
            for u in np.unique(used):
                mine = used == u
                for i, mask in enumerate(masks(int(u) & ((1 << 64) - 1))):
                    m = np.uint64(mask)
                    part = (fp[mine].view(np.uint64) & m).view(np.int64)
                    taken = np.full(len(part), (u.view(np.uint64) | m).view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(g[mine]), pa.array(np.full(len(part), i, np.int32)), pa.array(part), pa.array(taken), pa.array(fp[mine])], ["g", "i", "part", "used", "fp"])

    dealt = groups.select("g", "used", "fp").mapInArrow(run, "g long, i int, part long, used long, fp long")
    return dealt.select(F.xxhash64("g", "i", "part").alias("g"), "used", "fp")


def bounded_groups(groups: DataFrame, max_bits: int, bucket_rows: int) -> list[DataFrame]:
    """groups(g, used, fp) of distinct fingerprints as tables (g, fp) in which no group is over bucket_rows, no linked pair being parted.

    Only groups with at most max_bits free bits, which are at most 2 ** (max_bits + 1) fingerprints, are not dealt again."""
    out = []
    free = F.lit(64) - F.bit_count("used")
    while True:
        large = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows).select("g")
        left, n = cut_counted(groups.join(large, "g", "left_semi").where(free > max_bits).select("g", "used", "fp"))
        if not n:
            return [*out, groups.select("g", "fp")]
        out.append(groups.join(left.select("g").distinct(), "g", "left_anti").select("g", "fp"))
        groups = cut(_deal(left, max_bits))


def links(fps: DataFrame, max_bits: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """A spanning set (a, b) of all links between distinct fingerprints `fp`."""
    keys = fps.select("fp", F.explode(_variants(max_bits)).alias("v")).select("v.seg", "v.rest", "v.bit", "fp")
    sizes = keys.groupBy("seg", "rest").agg(F.count(F.lit(1)).alias("n"), F.min("bit").alias("lo"), F.max("bit").alias("hi"))
    # a wildcard bucket with one value of the left-out bit only repeats its whole segment's bucket
    sizes = sizes.where((F.col("n") > 1) & ((F.col("seg") % 65 == 0) | (F.col("lo") < F.col("hi"))))
    own = F.array(*[F.lit(_signed(((1 << width) - 1) << at)) for at, width in segments(max_bits)])
    used = F.element_at(own, (F.floor(F.col("seg") / 65) + 1).cast("int"))
    # Spark sizes both sides as if a fingerprint were one key, not over sixty, so it must not choose to broadcast one
    buckets = cut(keys.join(sizes.select("seg", "rest").hint("merge"), ["seg", "rest"]).select(F.xxhash64("seg", "rest").alias("g"), used.alias("used"), "fp"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        e = forest(np.unique(pdf["fp"].to_numpy().view(np.uint64)), max_bits)
        return pd.DataFrame(np.array(e, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    found = [x.groupBy("g").applyInPandas(solve, "a long, b long") for x in bounded_groups(buckets, max_bits, bucket_rows)]
    return reduce(DataFrame.unionByName, found).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: every node of (a, b) but the roots, with the smallest node reachable.

    Alternating large and small stars; each round's table is written to the shared folder."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        new = cut(small.where("u != v").distinct())
        same = [x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (e, new)]
        e = new
        if same[0] == same[1]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components did not settle")


def near_duplicates(
    docs: DataFrame, words: int = 5, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, fp, component (smallest id of all that is linked, directly or not)."""
    fps = cut(fingerprints(docs, words, id_col, text_col))
    distinct = fps.groupBy("fp").agg(F.min("id").alias("least"))
    # dealt in turn: small partitions by fingerprint would be joined to few before each row becomes many signatures
    distinct = distinct.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    roots = components(links(distinct.select("fp"), max_bits))
    # files of ids and fingerprints can be much smaller than their rows: nothing with a row a document is broadcast by its file's size
    linked = distinct.join(roots.hint("merge"), distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = linked.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = linked.join(heads, "root").select("fp", "component")
    return fps.join(by_fp.hint("merge"), "fp").select("id", "fp", "component")


def hex16(fp: F.Column) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
