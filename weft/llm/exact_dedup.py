"""Exact dedup: sorted digest runs are merged along a tree.

A row's identity is the SHA-256 of its normalised text, verified by the text's length
and an independent 64-bit hash: entries are merged only where all three agree. Each
task sorts the entries of its rows into runs of at most `slot_rows`, equal ones folded
to the smallest identifier and a count. Runs are dealt to slots; then, in as many
rounds as the number of slots has digits in base FAN, the FAN slots that differ in one
digit exchange pieces of their runs, cut by a digit of the digest, and every slot merges
the FAN pieces it receives, folding again. After the last round a slot holds
one range of digests whole, so no task ever holds more than its share, and a text that a
third of all rows repeat is one entry of each run after the first sort. What moves between
rounds are blocks of sorted entries, about 70 bytes a distinct text and task. The folded
groups of more than one row are written, and joined back to the rows by digest; Spark
broadcasts them where they are small, and splits a hot digest's partition otherwise.

Edge cases: a null text is empty; runs of blanks become one space, and are not stripped at the
ends; a null id comes after all others; of rows that share id and text one stays; an empty
table gives an empty table; columns whose names begin with two underscores are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_counted
from .common import plain

FAN = 8
_WIDTH = 48  # bytes of an identity: SHA-256, length, second hash
_LAST = np.iinfo(np.int64).max
_ENTRY = "slot long, ids binary, nulls binary, docs binary, rows binary, counts binary"
_NAMES = [c.split()[0] for c in _ENTRY.split(", ")]


def normalised(text: str | Column = "text") -> Column:
    """The text with every run of the six blanks replaced by one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _least(starts: np.ndarray, sizes: np.ndarray, *keys: np.ndarray) -> list[np.ndarray]:
    """Of each group the smallest row by the keys, the first key first."""
    alive, out = np.ones(len(keys[0]), bool), []
    for k in keys:
        least = np.minimum.reduceat(np.where(alive, k, _LAST), starts)
        alive &= k == np.repeat(least, sizes)
        out.append(least)
    return out


def fold(ids: np.ndarray, nulls: np.ndarray, docs: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by identity, equal identities folded. A stable sort by merging: runs that come sorted are only merged."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    sizes = np.diff(np.append(starts, len(ids)))
    least = _least(starts, sizes, nulls[order], docs[order], rows[order])
    return ids[starts], *least, np.add.reduceat(counts[order], starts)


def _digits(ids: np.ndarray) -> np.ndarray:
    """The first eight bytes of each digest as a number."""
    return np.ascontiguousarray(ids).view(np.uint8).reshape(-1, _WIDTH)[:, :8].copy().view(">u8").ravel().astype(np.uint64)


def _pieces(entries: tuple[np.ndarray, ...], slot: int, level: int, levels: int) -> Iterator[tuple]:
    """The run's pieces for the slots of the next round: digit `level` of the slot becomes that of the digest.

    Digits are read from the top, so the pieces of a round's run follow one another in it."""
    digit = _digits(entries[0]) >> np.uint64(64 - 3 * (level + 1)) & np.uint64(FAN - 1)
    place = FAN ** (levels - 1 - level)
    for d in np.unique(digit).tolist():
        at = np.flatnonzero(digit == d)
        to = slot - slot // place % FAN * place + d * place
        yield (to, *(np.ascontiguousarray(x[at]).tobytes() for x in entries))


def _arrays(block) -> tuple[np.ndarray, ...]:
    return (np.frombuffer(block.ids, f"S{_WIDTH}"), *(np.frombuffer(getattr(block, n), np.int64) for n in _NAMES[2:]))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES)


def merged_runs(marks: DataFrame, n_rows: int, slot_rows: int = 200_000) -> DataFrame:
    """sha, size, check, keep_null, keep_id, keep_row, n of each distinct text. marks: sha, check, size, doc_id, row."""
    levels = 0
    while FAN**levels * slot_rows < n_rows:
        levels += 1
    slots = FAN**levels

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, nth = [], 0, 0

        def emit() -> pa.RecordBatch:
            entries = fold(*(np.concatenate(x) for x in zip(*held)))
            slot = (int(entries[3].min() >> 33) + nth) % slots  # partitions take turns, and so do the runs of one
            out = list(_pieces(entries, slot, 0, levels)) if levels else [(0, *(x.tobytes() for x in entries))]
            return pa.RecordBatch.from_pandas(_frame(out), schema=schema, preserve_index=False)

        for b in batches:
            for at in range(0, b.num_rows, slot_rows):
                part = b.slice(at, slot_rows)
                sha, doc = part.column(0), part.column(3)
                ids = np.empty((part.num_rows, _WIDTH), np.uint8)
                ids[:, :32] = np.frombuffer(b"".join(sha.to_pylist()), np.uint8).reshape(-1, 32)
                for k in (1, 2):
                    ids[:, 24 + 8 * k : 32 + 8 * k] = part.column(k).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
                nulls = doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                held.append((ids.reshape(-1).view(f"S{_WIDTH}"), nulls, doc.fill_null(0).to_numpy().astype(np.int64), part.column(4).to_numpy(), np.ones(part.num_rows, np.int64)))
                n += part.num_rows
                if n >= slot_rows:
                    yield emit()
                    held, n, nth = [], 0, nth + 1
        if n:
            yield emit()

    schema = pa.schema([("slot", pa.int64()), *((n, pa.binary()) for n in _NAMES[1:])])
    blocks = marks.select("sha", "size", "check", "doc_id", "row").mapInArrow(runs, _ENTRY)

    def merge(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            entries = fold(*(np.concatenate(x) for x in zip(*map(_arrays, pdf.itertuples()))))
            slot = int(pdf["slot"].iloc[0])
            return _frame(list(_pieces(entries, slot, level, levels)) if level < levels else [(slot, *(x.tobytes() for x in entries))])

        return run

    for level in range(1, max(levels, 1) + 1):
        blocks = blocks.groupBy("slot").applyInPandas(merge(level), _ENTRY)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.to_pandas().itertuples():
                ids, *rest = _arrays(block)
                raw = ids.view(np.uint8).reshape(-1, _WIDTH)
                number = lambda k: pa.array(raw[:, k : k + 8].copy().view(">i8").ravel().astype(np.int64))  # noqa: B023, E731
                sha = pa.Array.from_buffers(pa.binary(32), len(ids), [None, pa.py_buffer(raw[:, :32].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([sha, number(32), number(40), *map(pa.array, rest)], ["sha", "size", "check", "keep_null", "keep_id", "keep_row", "n"])

    return blocks.mapInArrow(unpack, "sha binary, size long, check long, keep_null long, keep_id long, keep_row long, n long")


def exact_groups(docs: DataFrame, slot_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without text, with __sha (binary), __keep_id, __group_size and __kept: of equal texts the row with the smallest id stays."""
    d = docs.select(*plain(docs)).withColumn("__text", normalised(text_col))
    others = [c for c in plain(docs) if c != text_col]
    sha = F.unhex(F.sha2("__text", 256)).alias("__sha")
    d = d.select(*others, sha, F.octet_length("__text").cast("long").alias("__size"), F.xxhash64("__text").alias("__check"), F.monotonically_increasing_id().alias("__row"))
    d, n = cut_counted(d)  # the rows' numbers hold from here on
    identity = ["__sha", "__size", "__check"]
    marks = d.select(*(F.col(c).alias(c[2:]) for c in identity), F.col(id_col).cast("long").alias("doc_id"), F.col("__row").alias("row"))
    groups = merged_runs(marks, n, slot_rows).where("n > 1")
    kept = F.when(F.col("keep_null") == 0, F.col("keep_id")).alias("__keep")
    groups, _ = cut_counted(groups.select(*(F.col(c[2:]).alias(c) for c in identity), kept, F.col("keep_row").alias("__keep_row"), F.col("n").alias("__n")))
    found = d.join(groups, identity, "left")
    return found.select(
        *others, "__sha", F.when(F.col("__n").isNull(), F.col(id_col).cast("long")).otherwise(F.col("__keep")).alias("__keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("__group_size"), F.coalesce(F.col("__keep_row") == F.col("__row"), F.lit(True)).alias("__kept"),
    )
