"""Alignment of two tokenizers by a cogroup of postings.

Both tokenizers' tokens of a text cover the same bytes; offsets where tokens of both end cut
them into groups, and every A token of a group is linked with every B token of it. A task
reads texts in blocks of a few MB, and turns a block into postings (A id, B id, document,
links), sorted, packed in columns and dealt to `buckets` by A id. How many documents link a
pair is counted from the packed pairs, summed in each task before they are shuffled; the highest
count of an A id is a window over that id's pairs, which the vocabularies bound. Then the two
streams meet: pairs with their counts and blocks of postings are shuffled by
(bucket, salt) and sorted, counts first, so a task holds the counts of a bucket and one block at a
time, and sends out what the block's documents gain. Salts follow the number of postings, so a
bucket with a frequent A id is spread like any other; counts are repeated for each salt.
Gains are summed by document.

A runs by tiktoken with the vocabulary of the given file, whose merges are checked to be in the order of their ids; texts with
very long runs of blanks, on which it fails, by the file's own tokenizer.

Edge cases: texts null or empty, and texts whose tokens do not spell space + text for both, have no tokens: zeros,
and an empty groups_sha256; repeated rows are documents of their own; a text with very many links is worked through by
slices of its A ids; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: How byte-level BPE files of this family split texts; the pattern is a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_BLANKS = re.compile(r"\s{10000}")
_DOC_BITS = 20
#: Links that are written out one by one at most, in one go.
_LINKS = 8_000_000


def byte_level() -> dict[str, int]:
    """Byte-level alphabets write printable bytes as themselves and the others as the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class SideA:
    """Byte-level BPE from a tokenizers file."""

    def __init__(self, data: bytes):
        import tiktoken

        self.data, spec = data, json.loads(data)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if order != sorted(order) or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("not a byte-level BPE whose merges are in the order of their ids")
        special = {t["id"] for t in spec["added_tokens"]}
        alphabet = byte_level()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            self.pieces[i] = token

    @functools.cached_property
    def exact(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(self.data.decode())
        t.encode_special_tokens = True
        return t

    def encode(self, texts: list[str]) -> list[list[int]]:
        one = lambda t: self.exact.encode(t, add_special_tokens=False).ids if _LONG_BLANKS.search(t) else self.fast.encode_ordinary(t)
        return [one(" " + t) for t in texts]


class SideB:
    """Pieces from a sentencepiece file."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=data)
        self.pieces = []
        for i in range(self.model.get_piece_size()):
            p = self.model.id_to_piece(i)
            self.pieces.append(bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=1)
def sides(a: bytes, b: bytes) -> Aligner:
    return Aligner(SideA(a), SideB(b))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of keys, sorted, and how often each occurs."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[starts], np.diff(np.append(starts, len(keys)))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every row, sizes[i] of them."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Block:
    """Tokens of several texts laid end to end, and their groups. doc: the text of each group."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    doc: np.ndarray


class Aligner:
    def __init__(self, a: SideA, b: SideB):
        self.a, self.b = a, b
        self.sizes = [np.array([len(p) for p in s.pieces], np.int64) for s in (a, b)]
        self.bits = [int(len(s.pieces) - 1).bit_length() for s in (a, b)]
        ends = {",", "|", ";", ""}
        self.written = [{e: np.array([f"{i}{e}" for i in range(len(s.pieces))], object) for e in ends} for s in (a, b)]

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Ids of both sides by text (none where they do not spell it), and the bytes spelled."""
        texts = [t or "" for t in texts]
        ids_a, ids_b = self.a.encode(texts), self.b.encode(texts)
        size = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            want = b" " + t.encode()
            ok = t and b"".join(map(self.a.pieces.__getitem__, ids_a[i])) == want and b"".join(map(self.b.pieces.__getitem__, ids_b[i])) == want
            if ok:
                size[i] = len(want)
            else:
                ids_a[i], ids_b[i] = [], []
        return [np.array(x, np.int64) for x in ids_a], [np.array(x, np.int64) for x in ids_b], size

    def block(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], size: np.ndarray) -> Block:
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        doc = np.searchsorted(np.cumsum(size), common)
        return Block(a, b, group_a, np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common)), doc)

    def digests(self, k: Block, n: int) -> list[str]:
        """SHA-256 of the written groups of each text."""
        last = lambda counts: np.concatenate((np.diff(np.repeat(np.arange(len(counts)), counts)), [1]))[: counts.sum()] > 0
        last_a, last_b = last(k.n_a), last(k.n_b)
        final = np.concatenate((np.diff(k.doc), [1]))[: len(k.doc)] > 0  # the last group of a text
        before_a, before_b = np.cumsum(k.n_a) - k.n_a, np.cumsum(k.n_b) - k.n_b
        out = np.empty(len(k.a) + len(k.b), object)
        group_b = np.repeat(np.arange(len(k.n_b)), k.n_b)
        place_a = np.arange(len(k.a)) + before_b[k.group_a]
        place_b = np.arange(len(k.b)) + (before_a + k.n_a)[group_b]
        wa, wb = self.written
        out[place_a] = np.where(last_a, wa["|"][k.a], wa[","][k.a])
        out[place_b] = np.where(last_b, np.where(final[group_b], wb[""][k.b], wb[";"][k.b]), wb[","][k.b])
        ends = np.cumsum(np.bincount(k.doc, k.n_a + k.n_b, minlength=n).astype(np.int64)).tolist()
        return [hashlib.sha256("".join(out[a:z].tolist()).encode()).hexdigest() if z > a else "" for a, z in zip([0, *ends], ends)]

    def postings(self, k: Block, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(bucket, A id, B id, text) as one number each, and the links of each; a pair of a text comes once."""
        before_b = np.cumsum(k.n_b) - k.n_b
        links = np.bincount(k.doc, k.n_a * k.n_b) if len(k.doc) else np.zeros(0)
        large = links > _LINKS // 4
        few = ~large[k.doc][k.group_a]
        at, done = np.flatnonzero(few), 0
        per = np.cumsum(k.n_b[k.group_a[at]])
        while done < len(at):  # slices of whole texts
            to = int(np.searchsorted(per, (per[done - 1] if done else 0) + _LINKS, side="right"))
            if to < len(at):
                to = max(int(np.searchsorted(k.doc[k.group_a[at]], k.doc[k.group_a[at[to]]])), done + 1)
            part = at[done:to]
            n = k.n_b[k.group_a[part]]
            other = k.b[_spread(before_b[k.group_a[part]], n)]
            yield _runs(self._key(np.repeat(k.a[part], n), other, np.repeat(k.doc[k.group_a[part]], n), buckets))
            done = to
        for doc in np.flatnonzero(large).tolist():
            yield from self._large(k, doc, buckets)

    def _large(self, k: Block, doc: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Postings of a text with very many links: distinct ids of each group, by slices of A ids."""
        groups = np.flatnonzero(k.doc == doc)
        low, high = groups[0], groups[-1] + 1
        group_b = np.repeat(np.arange(len(k.n_b)), k.n_b)
        mine_a, mine_b = (k.group_a >= low) & (k.group_a < high), (group_b >= low) & (group_b < high)
        shift = self.bits[1]
        kb, cb = _runs((group_b[mine_b] - low) << shift | k.b[mine_b])
        gb, idb = kb >> shift, kb & ((1 << shift) - 1)
        n_b = np.bincount(gb, minlength=high - low)
        before = np.cumsum(n_b) - n_b
        shift = self.bits[0]
        ka, ca = _runs((k.group_a[mine_a] - low) << shift | k.a[mine_a])
        ga, ida = ka >> shift, ka & ((1 << shift) - 1)
        order = np.argsort(ida, kind="stable")
        ga, ida, ca = ga[order], ida[order], ca[order]
        total, done = np.cumsum(n_b[ga]), 0
        while done < len(ida):  # slices of whole A ids
            to = int(np.searchsorted(total, (total[done - 1] if done else 0) + _LINKS, side="right"))
            if to < len(ida):
                to = max(int(np.searchsorted(ida, ida[to])), int(np.searchsorted(ida, ida[done], side="right")))
            n = n_b[ga[done:to]]
            other = _spread(before[ga[done:to]], n)
            keys = self._key(np.repeat(ida[done:to], n), idb[other], np.full(len(other), doc), buckets)
            weights = np.repeat(ca[done:to], n) * cb[other]
            order = np.argsort(keys, kind="stable")
            keys, weights = keys[order], weights[order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            yield keys[starts], np.add.reduceat(weights, starts)
            done = to

    def _key(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, buckets: int) -> np.ndarray:
        pair = a << self.bits[1] | b
        return ((a % buckets) << sum(self.bits) | pair) << _DOC_BITS | doc


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 on in the fewest bytes each, their bytes by place, compressed."""
    top = int(x.max()) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    planes = np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


MADE = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket int, block long, n long, rows binary, pairs binary, dfs binary, docs binary, links binary"
_MADE = pa.schema(
    [(c, t) for c, t in zip((x.split()[0] for x in MADE.split(", ")), [pa.int64()] * 6 + [pa.string(), pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 5)]
)
_GAIN = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])


def _records(columns: dict[str, list], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in _MADE], schema=_MADE)


def _text_groups(texts: list, most: int) -> Iterator[tuple[int, int]]:
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t or "") > most:
            yield at, i
            at, size = i, 0
        size += len(t or "")
    if at < len(texts):
        yield at, len(texts)


def _block_rows(aligner: Aligner, docs: list, rows: list, texts: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block's documents, then its postings by bucket."""
    ids_a, ids_b, size = aligner.tokens(texts)
    k, n = aligner.block(ids_a, ids_b, size), len(texts)
    total = lambda x: np.bincount(k.doc, x, minlength=n).astype(np.int64)
    yield _records(
        {
            "doc_id": docs, "row": rows, "n_a": [len(x) for x in ids_a], "n_b": [len(x) for x in ids_b], "n_groups": total(np.ones(len(k.doc))),
            "n_links": total(k.n_a * k.n_b), "groups_sha256": aligner.digests(k, n),
        }, n,
    )
    packed_rows = pack(np.diff(np.array(rows, np.int64), prepend=rows[0])), rows[0]
    for keys, links in aligner.postings(k, buckets):
        bounds = np.searchsorted(keys >> (sum(aligner.bits) + _DOC_BITS), np.arange(buckets + 1))
        out: dict[str, list] = {c: [] for c in ("bucket", "block", "n", "rows", "pairs", "dfs", "docs", "links")}
        for bucket, (a, z) in enumerate(zip(bounds, bounds[1:])):
            if a == z:
                continue
            pair = keys[a:z] >> _DOC_BITS & ((1 << sum(aligner.bits)) - 1)
            starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            values = (bucket, packed_rows[1], z - a, packed_rows[0], pack(np.diff(pair[starts], prepend=0)), pack(np.diff(np.append(starts, z - a))), pack(keys[a:z] & ((1 << _DOC_BITS) - 1)), pack(links[a:z]))
            for c, v in zip(out, values):
                out[c].append(v)
        yield _records(out, len(out["n"]))


def align(docs: DataFrame, path_a: str, path_b: str, buckets: int = 16, block_chars: int = 4_000_000, salt_postings: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs."""
    spark = docs.sparkSession
    # the vocabularies' files are read on the driver and sent to the tasks: a few MB whatever the corpus
    data_a, data_b = Path(path_a).read_bytes(), Path(path_b).read_bytes()
    sent = spark.sparkContext.broadcast((data_a, data_b))
    aligner = Aligner(SideA(data_a), SideB(data_b))
    bits_a, bits_b = aligner.bits
    if buckets > 1 << (63 - _DOC_BITS - bits_a - bits_b):
        raise ValueError("the vocabularies are too large for so many buckets")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, texts = (b.column(i).to_pylist() for i in range(3))
            for a, z in _text_groups(texts, block_chars):
                yield from _block_rows(sides(*sent.value), ids[a:z], rows[a:z], texts[a:z], buckets)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("t"))
    made = cut(texts.mapInArrow(make, MADE))
    blocks = made.where("bucket IS NOT NULL")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def folded() -> tuple[np.ndarray, np.ndarray]:
            pairs, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(pairs, kind="stable")  # merges sorted runs
            pairs = pairs[order]
            starts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
            return pairs[starts], np.add.reduceat(n[order], starts)

        def rows(x: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(x[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[0][at : at + 100_000]), pa.array(x[1][at : at + 100_000])], ["pair", "n"])

        size = 0
        for b in batches:
            for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((np.cumsum(unpack(p)), unpack(n)))
                size += len(held[-1][0])
                if size > 4_000_000:
                    held = [folded()]
                    size = len(held[0][0])
                    if size > 2_000_000:
                        yield from rows(held[0])
                        held, size = [], 0
        if held:
            yield from rows(folded())

    counts = blocks.select("pairs", "dfs").mapInArrow(tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    a_id = F.shiftright("pair", bits_b)
    top = F.max("n").over(Window.partitionBy(a_id))  # at most as many pairs as B has pieces
    counts = counts.select((a_id % buckets).cast("int").alias("bucket"), "pair", "n", (F.col("n") == top).alias("best"))
    postings = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    salts = max(1, -(-postings // (buckets * salt_postings)))
    none = [F.lit(None).cast("binary").alias(c) for c in ("rows", "pairs", "dfs", "docs", "links")]
    left = counts.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("side"), "pair", "n", "best", F.lit(None).cast("long").alias("block"), *none)
    right = blocks.select("bucket", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("side"), F.lit(-1).cast("long").alias("pair"), "n", F.lit(False).alias("best"), "block", "rows", "pairs", "dfs", "docs", "links")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, table = None, [], None
        for b in batches:
            place = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if (here := tuple(place[lo])) != now:
                    now, parts, table = here, [], None
                some = b.slice(lo, hi - lo)
                n_counts = int((some.column(2).to_numpy() == 0).sum())
                if n_counts:
                    some_counts = some.slice(0, n_counts)
                    parts.append((some_counts.column(3).to_numpy(), some_counts.column(4).to_numpy(), some_counts.column(5).to_numpy(zero_copy_only=False)))
                for r in some.slice(n_counts).to_pylist():
                    table = table or tuple(np.concatenate(x) for x in zip(*parts))
                    pairs, dfs = np.cumsum(unpack(r["pairs"])), unpack(r["dfs"])
                    at = np.repeat(np.searchsorted(table[0], pairs), dfs)
                    docs_, links = unpack(r["docs"]), unpack(r["links"])
                    rows = np.cumsum(unpack(r["rows"])) + r["block"]
                    sums = np.zeros((2, len(rows)), np.int64)
                    np.add.at(sums[0], docs_, links * table[2][at])
                    np.add.at(sums[1], docs_, links * table[1][at])
                    hit = np.flatnonzero(sums[1])
                    yield pa.RecordBatch.from_arrays([pa.array(rows[hit]), pa.array(sums[0][hit]), pa.array(sums[1][hit])], schema=_GAIN)

    met = left.unionByName(right).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "side", "pair")
    gains = met.mapInArrow(meet, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    columns = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links"]
    return made.where("bucket IS NULL").join(gains, "row", "left").select(
        *columns, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"
    )
