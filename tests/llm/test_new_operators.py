"""Exact dedup, the conversation trie and tokenizer alignment against brute force, on rows with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import alignment, conversation_trie, exact_dedup, queries

EXTRA = "slot long, n int, ids string, row long, h string, __x int"
ODD = (1, 2, "i", None, "h", 3)


def test_exact_dedup(spark):
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "\x0b"), (None, "a  b"), (None, None), (5, "a b"), (6, "a\tb"), (5, "a b"), (7, " a b"), (8, "A b"), (9, "a b"), (10, "x y " * 60_000), (11, "x  y\n" * 60_000)]
    rows += [(-i, f"w{rng.randrange(60)}  v") for i in range(300)] + [(100 + i, "hot  text") for i in range(400)] + [(2**63 - 1, "z"), (None, "z")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, *ODD) for i, t in rows], f"doc_id long, text string, {EXTRA}").repartition(5)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    order = lambda i: (i is None, i or 0)
    for slot_rows in (200_000, 150, 7):  # no round, one round, three rounds
        out = exact_dedup.exact_groups(docs, slot_rows).collect()
        assert len(out) == len(rows)
        kept = defaultdict(list)
        seen = defaultdict(list)
        for r in out:
            seen[bytes(r["__sha"])].append(r)
            if r["__kept"]:
                kept[bytes(r["__sha"])].append(r["doc_id"])
        assert len(seen) == len(groups)
        for t, ids in groups.items():
            sha = hashlib.sha256(t.encode()).digest()
            first = min(ids, key=order)
            assert sorted(map(order, (r["doc_id"] for r in seen[sha]))) == sorted(map(order, ids))
            assert {(r["__keep_id"], r["__group_size"]) for r in seen[sha]} == {(first, len(ids))} and kept[sha] == [first]
            assert all(r["slot"] == 1 and r["h"] == "h" for r in seen[sha])
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_exact_dedup_keeps_colliding_digests_apart():
    ids = np.array([b"a" * 47 + b"1", b"a" * 47 + b"2", b"a" * 47 + b"1"], "S48")
    n = np.array([0, 0, 0])
    got = exact_dedup.fold(ids, n, np.array([5, 4, 3]), np.array([1, 2, 3]), np.ones(3, np.int64))
    assert got[0].tolist() == sorted(set(ids.tolist())) and got[2].tolist() == [3, 4] and got[4].tolist() == [2, 1]


def brute_trie(rows):
    """Nodes by the contract's words, from (conv, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, said, len(text), role, text))
    own = {c: [x[4:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), sum(not children[q] for q in below), saved, sha))
    return sorted(out, key=lambda r: (r[1], r[0]))


def test_conversation_trie(spark):
    rng = random.Random(8)
    rows = [(0, 0, "user", None), (0, None, None, "é"), (0, 0, "user", None), (3, 1, "a", "only"), (204, 1, "a", "x"), (None, 0, "user", "lost"), (301, 5, "user", "a:b"), (301, 5, "user:a", "b")]
    for c in [*range(100, 160), *range(400, 420), 7, 12]:
        for t in range(rng.randrange(1, 8)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "no", "sure thing"]) if t % 2 else "hello"))
    rows += [(500, t, "user", f"turn {t}") for t in range(300)] + [(c, t, "user", "same") for c in range(600, 640) for t in range(7)]
    rng.shuffle(rows)
    want = brute_trie(rows)
    assert any(not p[1] and p[3] for p in want) and max(p[1] for p in want) == 300
    table = spark.createDataFrame([(*r, *ODD) for r in rows], f"conv_id long, turn long, role string, text string, {EXTRA}").repartition(4)
    for kw in ({}, {"shard_rows": 9, "run_rows": 10}, {"shard_rows": 2, "run_rows": 3, "split_turns": 4}):
        got = conversation_trie.trie(queries.shared_openings(conversation_trie.paths(table)), **kw).collect()
        assert sorted((tuple(r) for r in got), key=lambda r: (r[1], r[0])) == want, kw
    assert conversation_trie.trie(conversation_trie.paths(table.limit(0))).count() == 0


@given(st.lists(st.lists(st.sampled_from([b"a" * 24, b"b" * 24, b"c" * 24]), max_size=6), max_size=40), st.integers(1, 7))
@settings(max_examples=150, deadline=None)
def test_loser_tree_merges_with_lcps(convs, k):
    rows = [(b"".join(c), i) for i, c in enumerate(convs)]
    runs = [conversation_trie.sorted_run(rows[i::k]) for i in range(k)]
    got = list(conversation_trie.merged(runs))
    assert [p for p, *_ in got] == sorted(p for r in runs for p in r.paths) and sum(n for *_, n, _ in got) == len(rows)
    for (a, *_), (b, lcp, *_) in zip([(b"",)] + got, got):
        assert lcp == conversation_trie.shared(a, b)


def test_loser_tree_compares_shared_turns_once():
    deep = b"x" * 24 * 1000
    runs = [conversation_trie.sorted_run([(deep + bytes([j, i]) * 12, i) for i in range(20)]) for j in range(8)]
    looked = []
    compare = lambda a, b, at: looked.append((n := conversation_trie.shared(a, b, at)) - at + 1) or n
    assert len(list(conversation_trie.merged(runs, compare))) == 160
    assert sum(looked) < 8 * 1001 + 3000  # a plain merge looks at 160 x 3 x 1000 units


def brute_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    level = alignment.byte_level()
    docs, df = [], Counter()
    for t in texts:
        t = t or ""
        ia, ib = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        ba = [bytes(level[c] for c in a.id_to_token(i)) for i in ia]
        pb = [b.id_to_piece(i) for i in ib]
        bb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("\u2581", " ").encode() for p in pb]
        if not t or b"".join(ba) != b" " + t.encode() or b"".join(bb) != b" " + t.encode():
            docs.append(([], [], [], Counter()))
            continue
        groups, ga, gb, i, j, x, y = [], [], [], 0, 0, 0, 0
        while i < len(ia) or j < len(ib):
            if x <= y:
                x += len(ba[i])
                ga.append(ia[i])
                i += 1
            else:
                y += len(bb[j])
                gb.append(ib[j])
                j += 1
            if x == y:
                groups.append((ga, gb))
                ga, gb = [], []
        links = Counter(p for ga, gb in groups for p in ((p, q) for p in ga for q in gb))
        df.update(links.keys())
        docs.append((ia, ib, groups, links))
    top = defaultdict(int)
    for (p, _), n in df.items():
        top[p] = max(top[p], n)
    out = []
    for ia, ib, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        out.append((len(ia), len(ib), len(groups), sum(links.values()), sum(m for p, m in links.items() if df[p] == top[p[0]]), sum(m * df[p] for p, m in links.items()), sha))
    return out


def test_alignment(spark, monkeypatch):
    rng = random.Random(2)
    words = "alpha Beta épée ßtraße 日本語 <|endoftext|> <s> it's 12345 x \u2581 naïve\u00a0x \n\n \t don't 😀👍 zzzzqqqq".split(" ")
    texts = [None, "", " ", "\x00a", "\u2581", "a" * 5000, " " * 12_000 + "x", "é" * 3000, "日本" * 2000, "x y" * 2000, "plain text", "plain text"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    want = [(i, *r) for i, r in enumerate(brute_alignment(texts))]
    assert any(r[1] == 0 and texts[r[0]] for r in want)
    docs = spark.createDataFrame([(i, t, *ODD) for i, t in enumerate(texts)], f"doc_id long, text string, {EXTRA}").repartition(3)
    paths = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    for kw in ({}, {"buckets": 3, "block_chars": 3000, "salt_postings": 200}):
        got = sorted(tuple(r) for r in alignment.align(docs, *paths, **kw).drop("row").collect())
        assert got == want, kw
    assert alignment.align(docs.limit(0), *paths).count() == 0


def test_alignment_of_texts_with_very_many_links(monkeypatch):
    paths = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
    aligner = alignment.Aligner(alignment.SideA(open(paths[0], "rb").read()), alignment.SideB(open(paths[1], "rb").read()))
    texts = ["日本語" * 40 + " plain words here", "abcabc" * 50, "short", "é" * 99]
    k = aligner.block(*aligner.tokens(texts))

    def all_of():
        keys, links = (np.concatenate(x) for x in zip(*aligner.postings(k, 4)))
        assert len(set(keys.tolist())) == len(keys)
        return dict(zip(keys.tolist(), links.tolist()))

    want = all_of()
    for most in (5, 40, 400):
        monkeypatch.setattr(alignment, "_LINKS", most)
        assert all_of() == want
    assert sum(want.values()) == int((k.n_a * k.n_b).sum())
