"""Prefix trie of conversations by an LCP-aware external mergesort.

A turn is a 24-byte unit: 16 bytes of the SHA-256 of role and text, and the text's code
points; a conversation is the string of its units, its path. Tasks sort the paths they read
into runs of at most `run_rows`, equal paths folded to a count and the smallest id, and store with each
path how many units it shares with the one before (its LCP). Runs are cut at splitters
into shards, one range of paths each. A shard merges its pieces with a loser tree that
compares LCPs first and units only beyond them, so turns already known to be shared are
not compared again. The merged stream goes through a stack of open nodes: when a path
leaves a node, the node is finished and goes out.

Splitters are shortest prefixes that tell neighbours of a sample apart, so the only nodes that several
shards share are the proper prefixes of splitters. Shards send partial sums of these; at most
`max_shards` splitters of `split_turns` units, whatever the corpus, so they are added up on the driver. The
sample decides only where shards begin, never a result. A path that a third of all conversations share is one
entry of each run. A conversation's units (24 bytes a turn) are one row, and a shard's distinct paths one task.

The ids that end at a node are hashed apart: sorted by range, joined in chunks, and the chunks of a node
streamed through one SHA-256.

Edge cases: null role and text are empty; null turns come first; rows of one turn are ordered by their unit, repeated
rows are turns of their own; rows without a conversation id take no part; conversations without turns end at
the root; an empty table gives no nodes; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_counted

UNIT = 24
_CHUNK = 4096  # ids of a chunk

NODE = "t long, depth long, conv_id long, parent_conv_id long, t_parent long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, end binary"
_NODE = [c.split()[0] for c in NODE.split(", ")]
_RUN = "shard long, run long, units binary, sizes binary, lcps binary, counts binary, firsts binary"


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to one row per conversation: conv_id, path."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    unit = F.concat(F.substring(said, 1, 32), F.lpad(F.hex(F.char_length(text).cast("long")), 16, "0"))
    turn = F.col("turn").cast("long")
    r = rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(turn.isNotNull().alias("some"), F.coalesce(turn, F.lit(0)).alias("turn"), unit.alias("unit")).alias("u"))
    return r.groupBy("conv_id").agg(F.unhex(F.array_join(F.array_sort(F.collect_list("u"))["unit"], "")).alias("path"))


def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """How many units a and b share, given that they share the first `at`."""
    n, i = min(len(a), len(b)), at * UNIT
    while i < n and a[i : i + UNIT] == b[i : i + UNIT]:
        i += UNIT
    return i // UNIT


@dataclass
class Run:
    """Sorted distinct paths, each with its LCP with the one before, its conversations and the smallest of their ids."""

    paths: list[bytes]
    lcps: list[int]
    counts: list[int]
    firsts: list[int]


def sorted_run(rows: list[tuple[bytes, int]]) -> Run:
    run = Run([], [], [], [])
    for path, conv in sorted(rows):
        if run.paths and run.paths[-1] == path:
            run.counts[-1] += 1
            continue
        run.lcps.append(shared(run.paths[-1], path) if run.paths else 0)
        run.paths.append(path)
        run.counts.append(1)
        run.firsts.append(conv)
    return run


def merged(runs: list[Run], compare=shared) -> Iterator[tuple[bytes, int, int, int]]:
    """(path, LCP with the path before, conversations, smallest id) of all runs in order, equal paths of different runs one after another."""
    runs = [r for r in runs if r.paths]
    k = len(runs)
    if not k:
        return
    at, lcp = [0] * k, [0] * k  # each run's head, and what it shares with the last path that went out
    heads: list[bytes | None] = [r.paths[0] for r in runs]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); what the loser shares with the winner is noted."""
        p, q = heads[a], heads[b]
        if p is None or q is None:
            return (b, a) if p is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        n = compare(p, q, lcp[a])
        a_first = (p[n * UNIT : (n + 1) * UNIT], a) < (q[n * UNIT : (n + 1) * UNIT], b)
        lcp[b if a_first else a] = n
        return (a, b) if a_first else (b, a)

    losers = [-1] * k
    winners = [*([-1] * k), *range(k)]
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while heads[top] is not None:
        r, i = runs[top], at[top]
        yield r.paths[i], lcp[top], r.counts[i], r.firsts[i]
        at[top] = i = i + 1
        if i < len(r.paths):
            heads[top], lcp[top] = r.paths[i], r.lcps[i]
        else:
            heads[top] = None
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


@dataclass
class Splitters:
    """Where shards begin, and the trie of the splitters' proper prefixes: nodes that several shards may share."""

    keys: list[bytes]
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    step: dict[tuple[int, bytes], int] = field(default_factory=dict)

    def __post_init__(self):
        for key in self.keys:
            t = 0
            for i in range(0, len(key) - UNIT, UNIT):
                unit = key[i : i + UNIT]
                if (t, unit) not in self.step:
                    self.step[t, unit] = len(self.parents)
                    self.parents.append(t)
                    self.depths.append(self.depths[t] + 1)
                t = self.step[t, unit]


class _Open:
    __slots__ = ("t", "chars", "n", "first", "children", "leaves", "saved", "end", "kids")

    def __init__(self, t: int, chars: int):
        self.t, self.chars, self.n, self.first = t, chars, 0, None
        self.children = self.leaves = self.saved = 0
        self.end, self.kids = None, []


def finished(stream: Iterable[tuple[bytes, int, int, int]], split: Splitters) -> list[list]:
    """Rows (NODE) of the nodes that the sorted stream passes. t: number among the shared nodes, whose rows are partial sums, else -1."""
    out: list[list] = []
    stack: list[_Open] = []

    def close() -> None:
        f = stack.pop()
        up = stack[-1] if stack else None
        if f.t >= 0:
            out.append([f.t, len(stack), f.first, None, -1, f.n, f.children, f.leaves, f.saved, f.chars, f.end])
        else:
            leaves, saved = f.leaves if f.children else 1, f.saved + (f.n - 1) * f.chars
            for i in f.kids:
                out[i][3] = f.first
            if up.t < 0:
                up.kids.append(len(out))
            out.append([-1, len(stack), f.first, None, max(up.t, -1), f.n, f.children, leaves, saved, f.chars, f.end])
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
        if up:
            up.n, up.first = up.n + f.n, f.first if up.first is None else min(up.first, f.first)

    for path, lcp, n, first in stream:
        while len(stack) > lcp + 1:
            close()
        if not stack:
            stack.append(_Open(0, 0))
        for i in range((len(stack) - 1) * UNIT, len(path), UNIT):
            unit, t = path[i : i + UNIT], stack[-1].t
            stack.append(_Open(split.step.get((t, unit), -1) if t >= 0 else -1, int.from_bytes(unit[16:], "big")))
        leaf = stack[-1]
        leaf.n, leaf.first = leaf.n + n, first if leaf.first is None else min(leaf.first, first)
        leaf.end = leaf.end or hashlib.sha256(path).digest()[:16]
    while stack:
        close()
    return out


def choose_splitters(convs: DataFrame, n: int, shard_rows: int, max_shards: int, split_turns: int) -> Splitters:
    """From about 32 paths a shard, chosen by a hash of the id, each read to split_turns units."""
    shards = min(max_shards, -(-n // shard_rows))
    if shards <= 1:
        return Splitters([])
    share = min(1.0, 32 * shards / n)
    some = convs.where(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 40)) < int(share * (1 << 40))).select(F.substring("path", 1, UNIT * split_turns).alias("p"))
    sample = sorted(bytes(r["p"]) for r in some.collect())
    keys = set()
    for k in range(1, shards):
        i = k * len(sample) // shards
        before = bisect.bisect_left(sample, sample[i]) - 1 if sample else -1
        if before >= 0:
            keys.add(sample[i][: UNIT * (shared(sample[before], sample[i]) + 1)])
    return Splitters(sorted(keys))


def _pack(values: list[int]) -> bytes:
    return np.array(values, np.int64).tobytes()


def _unpack(block) -> Run:
    sizes, lcps, counts, firsts = (np.frombuffer(getattr(block, c), np.int64).tolist() for c in ("sizes", "lcps", "counts", "firsts"))
    ends = np.cumsum([0, *sizes]).tolist()
    return Run([block.units[a:z] for a, z in zip(ends, ends[1:])], lcps, counts, firsts)


def trie(convs: DataFrame, shard_rows: int = 50_000, run_rows: int = 50_000, max_shards: int = 16_384, split_turns: int = 64) -> DataFrame:
    """Nodes of the trie of (conv_id, path), ids unique: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = convs.sparkSession
    convs, n = cut_counted(convs.select("conv_id", "path"))
    split = choose_splitters(convs, n, shard_rows, max_shards, split_turns)
    sent = spark.sparkContext.broadcast(split)  # bounded by max_shards x split_turns

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = sent.value.keys
        held, size, nth = [], 0, 0

        def emit() -> pa.RecordBatch:
            run = sorted_run(held)
            cuts = [0, *(bisect.bisect_left(run.paths, k) for k in keys), len(run.paths)]
            rows = []
            for shard, (a, z) in enumerate(zip(cuts, cuts[1:])):
                if a < z:
                    part = run.paths[a:z]
                    rows.append((shard, nth, b"".join(part), _pack([len(p) for p in part]), _pack([0, *run.lcps[a + 1 : z]]), _pack(run.counts[a:z]), _pack(run.firsts[a:z])))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 2 + [pa.binary()] * 5)], [c.split()[0] for c in _RUN.split(", ")])

        for b in batches:
            for conv, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((path, conv))
                size += len(path)
                if len(held) >= run_rows or size >= 32 << 20:
                    yield emit()
                    held, size, nth = [], 0, nth + 1
        if held:
            yield emit()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = finished(merged([_unpack(b) for b in pdf.itertuples()]), sent.value)
        return pd.DataFrame(rows, columns=_NODE).astype({c: "Int64" for c in _NODE if c != "end"})

    found = cut(convs.mapInArrow(runs, _RUN).groupBy("shard").applyInPandas(merge, NODE))
    top = _shared_nodes(found, split)
    whole = found.where("t < 0").join(F.broadcast(top.select(F.col("t").alias("t_parent"), F.col("conv_id").alias("up"))), "t_parent", "left")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end"]
    nodes = whole.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")).select(*columns).unionByName(top.select(*columns))
    ends = _ends(convs)
    return nodes.join(ends, "end", "left").select(*columns[:-1], F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def _shared_nodes(found: DataFrame, split: Splitters) -> DataFrame:
    """Whole rows of the nodes that shards share, from their partial sums: as many as the splitters have prefixes."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = found.where("t >= 0").groupBy("t").agg(*sums, F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.max("end").alias("end")).collect()
    rows = {r["t"]: r.asDict() for r in parts}
    for t in sorted(rows, key=lambda t: -split.depths[t]):
        r, up = rows[t], rows.get(split.parents[t])
        if not r["n_children"]:
            r["n_leaves"] = 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["chars"]
        if up:
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
    whole = [(t, split.depths[t], r["conv_id"], rows[split.parents[t]]["conv_id"] if t else None, None, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], None, r["end"]) for t, r in rows.items()]
    return found.sparkSession.createDataFrame(whole, NODE)


def _ends(convs: DataFrame) -> DataFrame:
    """end, ends_sha256: the ids of the conversations that end at a node, in ascending order and joined by commas, hashed."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        for b in batches:
            rows = []
            for end, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (end != now or len(ids) >= _CHUNK):
                    rows.append((now, ids[0], ",".join(map(str, ids))))
                    ids = []
                now = end
                ids.append(conv)
            yield _texts(rows)
        if ids:
            yield _texts([(now, ids[0], ",".join(map(str, ids)))])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = sha = None
        for b in batches:
            rows = []
            for end, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if end == now:
                    sha.update(b"," + text.encode())
                    continue
                if now is not None:
                    rows.append((now, sha.hexdigest()))
                now, sha = end, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["end", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], ["end", "ends_sha256"])

    keyed = convs.select(F.substring(F.unhex(F.sha2("path", 256)), 1, 16).alias("end"), "conv_id")
    joined = keyed.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(chunks, "end binary, first long, text string")
    return joined.repartition("end").sortWithinPartitions("end", "first").mapInArrow(digests, "end binary, ends_sha256 string")


def _texts(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.string()))], ["end", "first", "text"])
