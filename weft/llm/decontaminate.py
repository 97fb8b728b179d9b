"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised: lower case, everything but letters and digits is
one space. An item of m characters has an error budget of e = error_rate * m, and
is cut into e + 1 pieces: wherever a text holds the item with at most e edits,
one piece is there unchanged. One automaton finds all pieces; each hit gives a
window, and Myers' bit-parallel distance verifies it.

The benchmark is read in passes of about `pass_mb` of text, each in blocks of about
`block_mb`. A pass is collected and sent to the tasks, so what is broadcast at a time
is bounded; a task normalises texts once a pass, gathers up to `batch_mb` of them and
matches them against one block's automaton after another. A benchmark of one pass,
which nearly all are, costs one reading of the corpus.

Edge cases: null, empty and blank texts match nothing, nor do items without a
letter or digit; items under 1 / error_rate characters must stand exactly, between
word ends; repeated items each match; repeated rows each yield rows; null ids are
kept; a text longer than a batch is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Fold(dict):
    def __missing__(self, c: int) -> str:
        ch = chr(c)
        self[c] = out = ch if ch.isalnum() else " "
        return out


_FOLD = _Fold()


def normalise(text: str | None) -> str:
    """Words joined by one space, with one at both ends; empty if there are none."""
    words = (text or "").lower().translate(_FOLD).split()
    return f" {' '.join(words)} " if words else ""


def budget(m: int, error_rate: float) -> int:
    """Errors allowed in an item of m characters, the two blanks at its ends included; at most one less than it has."""
    return max(0, min(int(error_rate * m), m - 1))


def cut_pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces."""
    edges = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:z]) for a, z in zip(edges, edges[1:])]


def myers(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of item to any substring of text, and where the first such ends."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere: no carry into the first row
        mh = mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


class Matcher:
    """One block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = items
        self.budgets = [budget(len(t), error_rate) for _, t in items]
        hits: dict[str, list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(items):
            for at, p in cut_pieces(t, self.budgets[i]):
                hits.setdefault(p, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for p, where in hits.items():
            self.automaton.add_word(p, (len(p), where))
        if hits:
            self.automaton.make_automaton()
        self.any = bool(hits)

    def match(self, text: str) -> list[tuple[int, int, int]]:
        """(item's place, distance, end in the normalised text), the best of each item found."""
        if not text or not self.any:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (n, where) in self.automaton.iter(text):
            for i, off in where:
                first = end + 1 - n - off
                e, m = self.budgets[i], len(self.items[i][1])
                a, z = max(0, first - e), min(len(text), first + m + e)
                mine = windows.setdefault(i, [])
                if mine and a <= mine[-1][1] and a >= mine[-1][0]:
                    mine[-1][1] = max(z, mine[-1][1])
                else:
                    mine.append([a, z])
        out = []
        for i, spans in windows.items():
            item, best = self.items[i][1], None
            for a, z in spans:
                at = text.find(item, a, z)
                d, end = (0, at - a + len(item)) if at >= 0 else myers(item, text[a:z]) if self.budgets[i] else (1, 0)
                if d <= self.budgets[i] and (best is None or d < best[0]):
                    best = (d, a + end)
            if best:
                out.append((i, *best))
        return out


SCHEMA = "doc_id long, item_id long, distance int, errors_allowed int, end long"


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int, str]]]:
    """(id, normalised text) of the batches, most characters at a time or one text."""
    rows, size = [], 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = normalise(text)
            if text:
                rows.append((doc, text))
                size += len(text)
            if size > most:
                yield rows
                rows, size = [], 0
    yield rows


def contaminated(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.06, block_mb: float = 4, pass_mb: float = 64, batch_mb: float = 32,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """A row for each document and benchmark item it holds: SCHEMA."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    passes = max(1, int(-(-total // int(pass_mb * 1e6))))
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    out = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).collect()
        known = sorted(((r[0], normalise(r[1])) for r in part if normalise(r[1])), key=lambda x: (x[0] is None, x))
        blocks, size = [[]], 0
        for item in known:
            size += len(item[1])
            if size > block_mb * 1e6 and blocks[-1]:
                blocks.append([])
                size = len(item[1])
            blocks[-1].append(item)
        sent = spark.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            one = Matcher(sent.value[0], error_rate) if len(sent.value) == 1 else None
            for texts in _gathered(batches, int(batch_mb * 1e6)):
                for block in sent.value:
                    m = one or Matcher(block, error_rate)
                    found = [(doc, m.items[i][0], d, m.budgets[i], end) for doc, text in texts for i, d, end in m.match(text)]
                    cols = list(zip(*found)) if found else [[]] * 5
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "distance", "errors_allowed", "end"])

        found = rows.mapInArrow(run, SCHEMA)
        out = found if out is None else out.union(found)
    return out
