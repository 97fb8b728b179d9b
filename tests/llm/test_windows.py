"""Exact substring dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from weft.llm import windows
from weft.llm.fm_index import drop_repeated_words
from weft.llm.suffix_buckets import drop_repeated_bytes

SCHEMA = "doc_id long, text string, lang string, h long, key string"


def brute(texts, length, words):
    units = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) if words else (t or "").encode() for t in texts]
    glue = (lambda u: tuple(u)) if words else bytes
    seen = Counter(glue(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if seen[glue(u[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = [x for x, g in zip(u, gone) if not g]
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        joined = b" ".join(kept) if words else bytes(kept)
        out.append((len(u), sum(gone), spans, hashlib.sha256(joined).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "bé", "cat", "do", "el", "fi", "gö", "hut"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [make(rng.randint(5, 40)) for _ in range(6)]
    texts = [None, "", " ", "x", "a " * 200, "ab" * 300, "only here " * 40, "xyz" * 90]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else make(rng.randint(0, 30)))
        texts.append(rng.choice([" ", "\n", "\t\x0b "]).join(parts))
    texts += texts[10:14]
    return texts


@pytest.mark.parametrize("words", [True, False])
@pytest.mark.parametrize("hot", [50_000, 3])
def test_matches_brute_force(spark, words, hot, monkeypatch):
    texts = corpus(int(words))
    rows = [(None if i == 7 else i // 2 if i > 60 else i, t, "en", 1, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    length = 9 if words else 40
    run = drop_repeated_words(docs, words=9, gram=4, hot=hot) if words else drop_repeated_bytes(docs, length=40, gram=16, hot=hot)
    got = sorted((str(r["doc_id"]), r["n_units"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in run.collect())
    want = sorted((str(r[0]), *b) for r, b in zip(rows, brute(texts, length, words)))
    assert got == want


def test_repeated_rows_lose_their_windows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", 1, ""), (1, "a b c d e f", "en", 1, "")], SCHEMA)
    assert [r["n_removed"] for r in drop_repeated_words(docs, words=3, gram=2).collect()] == [6, 6]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert drop_repeated_words(docs).count() == 0
    assert drop_repeated_bytes(docs).count() == 0


def test_long_texts_cross_blocks(monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", 64)
    data = [b"one two  three\n" * 40, b"", b"x" * 500 + b" y"]
    hashes, counts = windows.word_units(data)
    monkeypatch.setattr(windows, "BLOCK", 1 << 20)
    same, counts2 = windows.word_units(data)
    assert counts.tolist() == counts2.tolist() == [120, 0, 2]
    assert len(set(hashes.tolist())) == 5 and (hashes == same).all()


def test_hot_regions_give_runs_not_windows(spark):
    """A place of a region is joined with one row for all its windows, however many repeat."""
    text = bytes(range(32, 127)) + bytes(range(32, 127))[::-1]
    kind = windows.Kind("byte", 40, 16, None)
    regions = spark.createDataFrame([(b"r1", 2, bytearray(text)), (b"r2", 1, bytearray(b"?" + text[:60] + b"!" + text[100:145] + b"~"))], "rid binary, n long, content binary")
    got = sorted((bytes(r["rid"]), r["s0"], r["s1"]) for r in windows._one_by_one(regions, kind).collect())
    assert got == [(b"r1", 0, len(text) - 40), (b"r2", 1, 21), (b"r2", 62, 67)]
