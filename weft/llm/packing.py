"""Sum-of-squares packing of tokenised documents into fixed-length sequences.

Texts are tokenised in Arrow batches, one end id is added, and only documents
longer than a sequence are cut. The pieces, a few numbers each, are dealt by a
hash into groups of about `group_pieces`, whatever the size of the corpus; each
group packs its pieces, longest first, always where the sum over all fills of
(open bins with that fill) squared becomes smallest, ties to the fullest bin; a
new bin is opened only where no open one has room. A group loses at most its few bins that stay open.

Edge cases: null and empty texts are the end id alone; repeated rows are packed
as documents of their own; a null id is kept; an empty table gives an empty
table.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import threading
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..session import cut
from .alignment import byte_level
from .common import trim

#: How this tokenizer's file prepares and splits texts; other vocabularies are encoded chunk by chunk.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SUFFIX = "</w>"
#: Texts of letters whose lower case and composed form leave no doubt, and how SPLIT splits them in lower case.
_PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+").findall


def _merged(symbols: list[str], rank: dict[tuple[str, str], int]) -> list[str]:
    while len(symbols) > 1:
        best, i = min((rank.get(pair, len(rank)), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
        if best == len(rank):
            break
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return symbols


def word_ranks(vocabulary: bytes) -> dict[bytes, int] | None:
    """Tokens as bytes, a blank for the end of a word, with their ids; none if the file does not prepare texts as
    above or if merging by least id could differ from its merges.

    It cannot differ where ids follow the merges and each token's own merges lead to it: then whenever two tokens
    meet that make up a third, they are that token's merge. No word holds a blank, so the end has a byte of its own."""
    spec = json.loads(vocabulary)
    model, pre = spec["model"], spec["pre_tokenizer"]
    norm = (spec["normalizer"] or {}).get("normalizers")
    splits = [(p.get("pattern"), p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in (pre or {}).get("pretokenizers", [])]
    if norm != NORMALIZERS or splits != [({"Regex": SPLIT}, "Removed", True, None, None), (None, None, None, False, False)]:
        return None
    plain = not (model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"])
    if model["type"] != "BPE" or model["end_of_word_suffix"] != SUFFIX or not plain or not all(t["content"].startswith("<|") for t in spec["added_tokens"]):
        return None
    vocab, alphabet = model["vocab"], byte_level()
    pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    single = [c + e for e in ("", SUFFIX) for c in alphabet]
    made = [a + b for a, b in pairs]
    if any(t not in vocab for t in single + made) or len({*single, *made}) != len(single) + len(made) or len(vocab) != len(single) + len(made):
        return None
    order = [vocab[t] for t in made]
    rank = {p: i for i, p in enumerate(pairs)}
    if order != sorted(order) or order and order[0] <= max(vocab[t] for t in single):
        return None
    out = {}
    for token, i in vocab.items():
        ends = token.endswith(SUFFIX) and token != SUFFIX
        letters = list(token[: -len(SUFFIX)] if ends else token)
        out[bytes(alphabet[c] for c in letters) + b" " * ends] = i
        if len(_merged(letters[:-1] + [letters[-1] + SUFFIX * ends], rank)) > 1:
            return None
    return out if len(out) == len(vocab) else None


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, equal to the tokenizer's own.

    Plain texts are split here and merged by tiktoken with the ids of the file. The vocabulary's pieces never cross
    a blank, so of other texts the chunks between spaces and line ends that are not plain go through the tokenizer
    itself. Short ones are kept in two generations: when the young one is full it becomes the old one, and what is
    met again moves back, so memory is bounded; nothing is kept of plain texts."""

    def __init__(self, vocabulary: bytes, entries: int = 50_000):
        self.vocabulary, self.entries = vocabulary, entries
        self.odd: dict[str, bytes] = {}
        self.old_odd: dict[str, bytes] = {}
        ranks, self.fast = word_ranks(vocabulary), None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.vocabulary.decode())

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _is_plain(self, text: str) -> bool:
        return self.fast is not None and _PLAIN(text) is not None and "<|" not in text

    def _plain(self, text: str) -> bytes:
        return np.array(self.fast(" ".join(_PARTS(text.lower())) + " "), "<u4").tobytes()

    def _odd(self, chunk: str) -> bytes:
        ids = self.odd.get(chunk)
        if ids is None:
            ids = self.old_odd[chunk] if chunk in self.old_odd else self._encode(chunk)
            if len(chunk) <= 64:
                if len(self.odd) >= self.entries:
                    self.odd, self.old_odd = {}, self.odd
                self.odd[chunk] = ids
        return ids

    def _mixed(self, text: str) -> bytes:
        out, run = [], []
        for chunk in text.replace("\n", " ").split(" "):
            if self._is_plain(chunk):
                run.append(chunk)
            else:
                if run:
                    out.append(self._plain(" ".join(run)))
                    run = []
                out.append(self._odd(chunk))
        return b"".join([*out, self._plain(" ".join(run))] if run else out)

    def encode_all(self, texts: list[str | None], size: int = 1 << 20) -> Iterator[bytes]:
        """Ids of each text; long ones in blocks that end at a blank."""
        for t in texts:
            blocks = _blocks(t, size) if t and len(t) > 2 * size else [t or ""]
            yield b"".join([self._plain(x) if self._is_plain(x) else self._mixed(x) for x in blocks])

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


def _blocks(text: str, size: int) -> Iterator[str]:
    """text in blocks of about size that each end before a space; a chunk longer than that stays whole."""
    at = 0
    while at < len(text):
        to = text.find(" ", at + size)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to + 1


#: The encoder of a worker process: what it has learned serves the tasks that follow, until none has come for IDLE_SECONDS.
_ENCODERS: dict[bytes, Encoder] = {}
_EXPIRY: list[threading.Timer] = []
IDLE_SECONDS = 5


def encoder(vocabulary: bytes) -> Encoder:
    while _EXPIRY:
        _EXPIRY.pop().cancel()
    key = hashlib.sha256(vocabulary).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary)
    return _ENCODERS[key]


def _idle() -> None:
    """Gives the encoder's memory back to the process, in which other stages may run, if no task comes soon."""
    timer = threading.Timer(IDLE_SECONDS, _ENCODERS.clear)
    timer.daemon = True
    timer.start()
    _EXPIRY.append(timer)


def pieces(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, piece, start, length, ids_crc32 and, if asked for, ids (bytes).

    row_key tells rows of one id apart only by their text; equal rows have equal pieces. The vocabulary's file is read
    on the driver and sent to the tasks, a few MB whatever the corpus."""
    schema = StructType([StructField(n, LongType()) for n in ("doc_id", "row_key", "piece", "start", "length", "ids_crc32")])
    if with_ids:
        schema = schema.add("ids", BinaryType())
    end = np.array([end_id], "<u4").tobytes()
    sent = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()  # what stages before have left
        encode_all = encoder(sent.value).encode_all
        for b in batches:
            rows = []
            for doc, key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encode_all(b.column(2).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc, key, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            cols = list(zip(*rows)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if f.name == "ids" else pa.int64()) for c, f in zip(cols, schema)], schema.names)
        _idle()

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("row_key"), F.col(text_col).alias("t"))
    return d.mapInArrow(run, schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, taken in the order given. Sizes are 1 to capacity."""
    n = np.zeros(2 * capacity + 1, np.int64)  # open bins by fill; what is full counts as none
    open_at: list[list[int]] = [[] for _ in range(capacity)]
    fill: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        top, best = capacity - s, 0
        usable = n[1 : top + 1] > 0
        if usable.any():
            cost = 2 * (n[s + 1 : capacity + 1] - n[1 : top + 1]) + 2  # fills 1 to top; the last becomes full
            cost[-1] -= 1
            cost[~usable] = np.iinfo(np.int64).max
            best = int(top - cost[::-1].argmin())
        if best:
            b = open_at[best].pop()
            n[best] -= 1
        else:
            b = len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if fill[b] < capacity:
            open_at[fill[b]].append(b)
            n[fill[b]] += 1
    return bins, offsets


def pack(parts: DataFrame, length: int = 2048, group_pieces: int = 100_000) -> DataFrame:
    """parts with sequence_id and offset. parts is read twice: hand in a table, not a plan."""
    groups = max(1, -(-parts.count() // group_pieces))
    schema = StructType([*parts.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row_key", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), length)
        group = int(pdf["__g"].iloc[0])
        return pdf.drop(columns="__g").assign(sequence_id=(group << 40) + bins, offset=offsets)

    spread = F.pmod(F.xxhash64("doc_id", "row_key", "piece"), F.lit(groups)).cast("long")
    return parts.withColumn("__g", spread).groupBy("__g").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, **kw) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer_path, length, **kw)), length)
