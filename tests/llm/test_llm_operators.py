"""The training-data operators against brute force, on rows with every odd case."""

import hashlib
import json
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.llm import ann, chat, decontaminate, line_dedup, packing, pii, queries, simhash, toxicity
from weft.llm.queries import tokenizer_path

#: Extra columns that bear names which operators might use inside.
SCHEMA = "doc_id long, text string, lang string, id long, fp long, h string, key string, t string, n int, score double, kind string, component long"
EXTRA = ("en", 1, 2, "h", None, "t", 3, None, "k", 4)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def docs_of(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, *EXTRA) for i, t in rows], SCHEMA).repartition(parts)


def odd_rows():
    rng = random.Random(5)
    words = "alpha Beta gamma delta épée ßtraße 日本 x".split()
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = "\n".join(make(9) for _ in range(3000))
    rows = [(0, None), (1, ""), (2, " \n\t\n"), (3, "one"), (4, "two words"), (5, long), (6, long), (7, long.replace("alpha", "ALPHA", 1)), (None, "no id"), (None, None), (8, "\x0b\x0c\r")]
    base = make(60)
    for i in range(20):
        w = base.split()
        w[rng.randrange(60)] = "edit"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, base) for i in range(5)] + [(200, base), (200, "another text of one id")]
    rows += [(300 + i, f"Line A \n{make(4)}\n\tline a\r\n\n{i}") for i in range(12)]
    return rows


def test_line_dedup(spark):
    rows = odd_rows()
    keys = defaultdict(set)
    blanks = " \t\n\x0b\x0c\r"
    norm = lambda line: line.strip(blanks).translate(FOLD)
    for i, t in rows:
        for line in (t or "").split("\n"):
            keys[norm(line)].add(i)
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(norm(x)) >= 1 and len(keys[norm(x)]) >= 10)]
        want.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    out = line_dedup.drop_frequent_lines(docs_of(spark, rows), min_docs=10, min_chars=1)
    assert out.columns[: len(SCHEMA.split(", "))] == [c.split()[0] for c in SCHEMA.split(", ")]
    got = sorted((str(r["doc_id"]), r["__n_lines"], r["__n_dropped"], r["text"]) for r in out.collect())
    assert got == sorted(want)
    assert sum(x[2] for x in got) > 20


def brute_fp(text, k):
    w = WORD.findall((text or "").translate(FOLD))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket_rows", [4096, 16])
def test_simhash(spark, bucket_rows, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (3, bucket_rows))
    rows = odd_rows()
    out = simhash.near_duplicates(docs_of(spark, rows), words=3)
    fps = [brute_fp(t, 3) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)].append(i)
    want = sorted((str(i), f"{fps[a]:016x}", str(min(least[find(a)], default=None))) for a, (i, _) in enumerate(rows))
    got = sorted((str(r[0]), r[1], str(r[2])) for r in out.select("id", simhash.hex16(F.col("fp")), "component").collect())
    assert got == want


def test_links_find_all_near_pairs(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for _ in range(20):
            x = b
            for j in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << j
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for bucket in (4096, 16):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 3, bucket)).collect()}
        for a, x in zip(fps, signed):
            for b, y in zip(fps, signed):
                if a < b and (a ^ b).bit_count() <= 3:
                    assert roots.get(x, x) == roots.get(y, y)


def test_hot_buckets_are_split_below_the_bound(spark):
    rng = np.random.default_rng(5)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 11, 1500) << 32, rng.integers(0, 1 << 31, 7500) << 32]).astype(np.uint64) | np.uint64(0x1234567))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    buckets = df.select(F.lit(7).cast("long").alias("g"), F.lit((1 << 32) - 1).alias("used"), "fp")
    for g in simhash.bounded_groups(buckets, 3, 500):
        assert g.groupBy("g").count().where("count > 500").count() == 0
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 3, 500)).collect()}
    root = {int(x): int(x) for x in fps}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in simhash.forest(fps, 3):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if find(x) != x}


def test_empty_tables(spark):
    empty = docs_of(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert line_dedup.drop_frequent_lines(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0
    assert pii.sanitise(empty).count() == 0
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).count() == 0
    events = spark.createDataFrame([], "conv long, seq long, msg string, kind string, role string, text string")
    assert chat.read_back(chat.render(chat.fold_events(events))).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_decontamination(spark):
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefghij klmno") for _ in range(n))
    item = decontaminate.normalise(make(220)).strip()
    edited = list(item)
    for p in (20, 77, 130, 200):
        edited[p] = "z"
    edited = "".join(edited)
    broken = "".join("z" if i % 9 == 0 else c for i, c in enumerate(item))
    rows = [(1, f"{make(300)} {item.upper()} {make(50)}"), (2, f"{make(40)}\n{edited.replace(' ', ',  ')}! {make(10)}"), (3, f"{make(80)} {broken}"), (4, None), (5, ""), (6, make(4000)), (7, item[: len(item) // 2]), (None, item), (8, "the short item"), (9, "the short items"), (1, f"{item}")]
    bench = spark.createDataFrame([(10, item, 0), (11, None, 0), (12, " .. ", 0), (13, "Short item", 0), (14, item, 0)], "item_id long, text string, doc_id long")
    for sizes in ({}, {"block_mb": 0.0001}, {"block_mb": 0.0001, "pass_mb": 0.0003, "batch_mb": 0.001}):
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(docs_of(spark, rows), bench, **sizes).collect()}
        assert set(got) == {(1, 10), (1, 14), (2, 10), (2, 14), (None, 10), (None, 14), (8, 13)}
        assert got[1, 10] == 0 and 1 <= got[2, 10] <= 4


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("abcde f") for _ in range(n))
    items = [(i, make(rng.choice((6, 15, 17, 20, 34, 40, 60, 120)))) for i in range(14)]
    docs = []
    for i in range(60):
        t = list(items[rng.randrange(14)][1])
        for _ in range(rng.choice((0, 0, 1, 2, 3, 6))):
            t[rng.randrange(len(t))] = rng.choice(("", "x", "bb"))
        docs.append((i, make(rng.randint(0, 60)) + " " + "".join(t) + " " + make(rng.randint(0, 60))))
    docs += [(60, f"{make(60_000)} {items[7][1]} {make(60_000)}"), (61, None)]
    want = set()
    for d, t in docs:
        t = decontaminate.normalise(t)
        for i, item in items:
            item = decontaminate.normalise(item)
            e, row = int(0.06 * len(item)), np.arange(len(item) + 1)
            if len(t) > 1000:
                if item in t:
                    want.add((d, i, 0))
                continue
            best = len(item)
            for c in t:  # a match may start anywhere: cost 0 before the first character
                step = np.minimum(np.concatenate(([0], row[:-1] + (np.array(list(item)) != c))), row + 1)
                step[0] = 0
                row = np.minimum.accumulate(step - np.arange(len(step))) + np.arange(len(step))
                best = min(best, int(row[-1]))
            if t and item and best <= e:
                want.add((d, i, best))
    got = decontaminate.contaminated(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_mb=0.0002)
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()}
    assert {x for x in got if x[0] != 60} == {x for x in want if x[0] != 60} and {x for x in want if x[0] == 60} <= got
    assert len({d for _, _, d in want}) > 1


@given(st.text("abc", min_size=1, max_size=70), st.text("abc", max_size=60))
@settings(max_examples=60, deadline=None)
def test_myers(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        cur = [i]
        for j, d in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    assert decontaminate.myers(item, text)[0] == min(prev)


def test_toxicity_learns_and_takes_odd_rows(spark):
    rng = random.Random(3)
    bad = ["vilword", "nastyish", "grimterm"]
    texts, labels = [], []
    for i in range(600):
        w = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 80))]
        y = int(i % 4 == 0)
        for _ in range(2 * y):
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append(y)
    rows = [(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, "vilword " * 30000), (None, "x"), (3, texts[3])]
    docs = docs_of(spark, rows)
    marks = spark.createDataFrame([(i, 0, y) for i, y in enumerate(labels)] + [(5, 0, None), (None, 0, 1), (7, 1, labels[7])], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, marks)).select("doc_id", toxicity.is_held_out().alias("out"), "__score").collect()
    assert len(out) == len(rows) and all(0 <= r["__score"] <= 1 for r in out)
    held = [r for r in out if r["out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    right = sum((r["__score"] >= toxicity.THRESHOLD) == bool(labels[r["doc_id"]]) for r in held)
    assert right / len(held) >= 0.93
    assert [r["__score"] for r in out if r["doc_id"] == 9002][0] >= 0.3


def test_toxicity_thresholds_cover_rows_outside_the_sample(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(800):
        w = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(30)] + ["vilword", "nastyish"] * (i % 4 == 0)
        rows.append((i, " ".join(w), "de" if i % 8 < 2 or i % 8 == 4 else "en"))
        marks.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows + [(9, rows[9][1], None)], "doc_id long, text string, lang string").repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), sample_rows=200)
    assert set(model.thresholds) == {"de"}  # English has no positives; the sample's fifth holds some 10 of German
    out = toxicity.score(docs, model).select("doc_id", "__toxic").collect()
    assert sum(r["__toxic"] == (r["doc_id"] % 4 == 0) for r in out) / len(out) >= 0.9


def same_model(a, b):
    parts = lambda m: [m.embed, *m.filters, m.bias, m.out]
    return all(np.array_equal(x, y) for x, y in zip(parts(a), parts(b))) and a.out_bias == b.out_bias and a.thresholds == b.thresholds


def test_toxicity_sample_is_bounded_and_determined(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, "vilword " * (i % 4 == 0) + " ".join("".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(20)), "en") for i in range(300)]
    rows += [(i, f"another text of {i}", "en") for i in range(0, 300, 7)] + [(4, rows[4][1], "en"), (8, "x" * 50_000, "en")]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(4, 0), (8, None)], "doc_id long, toxic int")
    seen = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append(list(zip(texts, y.tolist()))) or train(texts, y, epochs=1))
    schema = "doc_id long, text string, lang string"
    one = toxicity.fit(spark.createDataFrame(rows, schema).repartition(1), marks, sample_rows=120, sample_mb=0.01)
    two = toxicity.fit(spark.createDataFrame(rows[::-1], schema).repartition(5, "text"), marks.repartition(3), sample_rows=120, sample_mb=0.01)
    assert seen[0] == seen[1] and same_model(one, two)
    size = sum(len(t.encode()) for t, _ in seen[0])
    assert 5_000 < size <= 10_000 and len(seen[0]) < 120  # the bytes bind
    toxicity.fit(spark.createDataFrame(rows, schema), marks, sample_rows=40)
    assert len(seen[2]) == 40  # the rows bind; of repeated ids one text is learned


def test_scorer_equals_direct_convolution():
    model = toxicity.train(["a bad word here", "fine text", "bad", "good"] * 10, np.array([1, 0, 1, 0] * 10), epochs=2)
    for text in ("a bad word", "", "x", "one two three four " * 40):
        words = toxicity.words_of(text)
        ids = [toxicity.features(w, len(model.embed)) for w in words]
        vec = np.array([np.zeros(16)] * toxicity.PAD + [model.embed[i].sum(0) for i in ids] + [np.zeros(16)] * toxicity.PAD)
        pooled = []
        for f in model.filters:
            pooled.append(np.max([sum(vec[p + j] @ f[j] for j in range(len(f))) for p in range(len(vec) - len(f) + 1)], axis=0))
        z = np.maximum(np.concatenate(pooled) + model.bias, 0) @ model.out + model.out_bias
        assert toxicity.Scorer(model).score([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_scorer_holds_little_for_each_distinct_word():
    model = toxicity.train(["a bad word here", "fine text", "bad", "good"] * 10, np.array([1, 0, 1, 0] * 10), epochs=1)
    texts = [" ".join(f"w{i}" for i in range(at, at + 1000)) for at in range(0, 160_000, 1000)]
    first = toxicity.Scorer(model).score(texts[-1:])
    tracemalloc.start()
    scores = toxicity.Scorer(model).score(texts)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert scores[-1] == first[0]  # whatever came before
    assert peak < 90  # MB; 216 where products with all filters were kept


def test_scored_batches_are_few_rows_at_a_time(spark):
    n = 2 * toxicity.ROWS + 7
    whole = pa.RecordBatch.from_pydict({"t": [f"text {i}" if i % 3 else None for i in range(n)]})
    parts = list(toxicity.few(iter([whole, whole.slice(0, 0), whole])))
    assert [p.num_rows for p in parts] == [toxicity.ROWS, toxicity.ROWS, 7] * 2
    assert pa.Table.from_batches(parts[:3]).to_pylist() == whole.to_pylist()
    model = toxicity.train(["a bad word here", "fine text", "bad", "good"] * 10, np.array([1, 0, 1, 0] * 10), epochs=1)
    docs = spark.createDataFrame([(i, f"text {i} bad" if i % 3 else None, [f"{i}", None]) for i in range(n)], "doc_id long, text string, more array<string>")
    out = toxicity.score(docs.coalesce(1), model).collect()
    want = toxicity.Scorer(model).score([f"text {i} bad" if i % 3 else None for i in range(n)])
    assert sorted((r["doc_id"], r["more"], r["__score"]) for r in out) == [(i, [f"{i}", None], s) for i, s in enumerate(want)]


@pytest.mark.parametrize("kind", ["string", "timestamp", "decimal(9,2)", "binary"])
def test_toxicity_samples_ids_of_any_type(spark, monkeypatch, kind):
    seen, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append(list(zip(texts, y.tolist()))) or train(texts, y, epochs=1))
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        ids = spark.range(200).select("id", F.expr({"timestamp": "timestamp_seconds(id * 1000)", "binary": "CAST(CAST(id AS STRING) AS BINARY)"}.get(kind, f"CAST(id AS {kind})")).alias("doc_id"))
        docs = ids.select("doc_id", F.concat(F.lit("text "), F.col("id").cast("string"), F.when(F.col("id") % 3 == 0, " bad").otherwise("")).alias("text"))
        toxicity.fit(docs, ids.select("doc_id", (F.col("id") % 3 == 0).cast("int").alias("toxic")), sample_rows=40)
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
    assert len(seen[0]) == 40 and all(y == t.endswith("bad") for t, y in seen[0])


ODD_TEXTS = ["", " ", "a <|endoftext|> b", "x<|startoftext|>y", "Σας ΟΔΟΣ", "é é ́ a", "foo\x1cbar\x85baz q", "don't  we'll 'S", "İSTANBUL ǅ ß", "½ ² x²", "日本語 テキスト", "a" * 5000, "１２ ab12cd"]


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(Path(tokenizer_path()).read_bytes(), entries=50)
    for t in ODD_TEXTS + [x or "" for _, x in odd_rows()]:
        assert e.encode(t) == e._encode(t), t


def test_encoder_equals_the_tokenizer_in_groups_and_blocks():
    rng = random.Random(4)
    letters = "abAB é É ü ß 1² '’-_.,;!?&#$<|>\n\t\r\x0b\x1c\x85\xa0\u3000日本İǅΣςe\u0301ﬁ０"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 5, 40, 400)))) for _ in range(1500)]
    texts += [" ".join(rng.choice(("don't", "we'll", "café", "naïve", "<|endoftext|>", "x1y2", "")) for _ in range(9)) for _ in range(300)]
    for entries, group in ((40, 300), (100_000, 1 << 20)):  # small tables change generations all the time, small groups cut texts
        e = packing.Encoder(Path(tokenizer_path()).read_bytes(), entries=entries)
        assert list(e.encode_all(texts, group)) == [e._encode(t) for t in texts]


def test_encoder_keeps_nothing_of_plain_texts():
    e = packing.Encoder(Path(tokenizer_path()).read_bytes())
    e.encode("warm up")
    tracemalloc.start()
    for first in range(0, 60_000, 2000):
        e.encode(" ".join("w" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(first, first + 2000)))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept < 1 << 20  # a table of 60 000 words takes over 10 MB


def test_encoder_without_the_known_form_of_vocabulary():
    spec = json.loads(Path(tokenizer_path()).read_bytes())
    vocab = spec["model"]["vocab"]
    vocab["th"], vocab["in"] = vocab["in"], vocab["th"]  # ids no longer follow the merges
    other = json.dumps(spec).encode()
    assert packing.word_ranks(other) is None
    e = packing.Encoder(other)
    for t in ("the inn, thin in", "", "a <|endoftext|> b", "it's 12"):
        assert e.encode(t) == e._encode(t)


def test_packing(spark):
    rows = odd_rows() + [(500 + i, t) for i, t in enumerate(ODD_TEXTS)]
    got = packing.pack_documents(docs_of(spark, rows), tokenizer_path(), length=64, with_ids=True).toPandas()
    e = packing.Encoder(Path(tokenizer_path()).read_bytes())
    want = Counter()
    for i, t in rows:
        ids = e._encode(t or "") + bytes(4)
        for k, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want[str(i), k, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    have = Counter((str(None if r.doc_id != r.doc_id else int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert have == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 64 and list(g["offset"]) == [0, *np.cumsum(g["length"])[:-1]]
    least = -(-got["length"].sum() // 64)
    assert got["sequence_id"].nunique() <= 1.05 * least + 2


def test_ann_later_lists_write_what_reaches_the_bound(spark):
    x = np.random.default_rng(5).normal(size=(1200, 8)).astype(np.float32)
    wide, ids = x.astype(float), np.arange(len(x))
    every = ann.top(wide[:20], wide, ids, 6)
    least = np.full(20, -2.0)
    least[:10] = every[2].reshape(20, 6)[:10, -1]
    assert all((a == b).all() for a, b in zip(every, ann.top(wide[:20], wide, ids, 6, least)))
    assert len(ann.top(wide[:20], wide, ids, 6, np.where(least > -2, 1.5, least))[0]) == 60
    assert [ann.rounds_of(n, 2).tolist() for n in (1, 2, 5)] == [[0], [0, 0], [0, 0, 0, 1, 1]] and (ann.rounds_of(400, 2) == 0).sum() == 20
    # with all lists visited, answers are exact
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.search(df, F.col("vec_id") % 50 == 0, k=5, rows_per_list=12, ratio=1e9).collect()}
    y = ann.unit(wide)
    for i in range(0, 1200, 50):
        near = [j for j in np.lexsort((ids, -(y @ y[i]))) if j != i][:5]
        assert [got[i, r + 1] for r in range(5)] == near


def test_ann(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16))
    x[100:400] = x[100]  # a third are copies
    x[401] = 2 * x[402]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    bad = [(1000, None, 0), (1050, [], 0), (1100, [0.0] * 16, 0), (1150, [float("nan")] + [1.0] * 15, 0), (1200, [None] + [1.0] * 15, 0), (1250, [1.0], 0), (1300, [float("inf")] + [1.0] * 15, 0), (None, [1.0] * 16, 0), (50, rows[50][1], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank int").repartition(5)
    for block in (2048, 40):
        got = defaultdict(list)
        for r in ann.search(df, F.col("vec_id") % 50 == 0, k=5, rows_per_list=40, replicas=4, boundary=1.25, ratio=1.2, block=block).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        hit = 0
        assert set(got) == set(range(0, 900, 50))
        for q in got:
            s = u @ u[q]
            best = sorted((i for i in range(900) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
            assert [g[0] for g in got[q]] == [1, 2, 3, 4, 5]
            assert all(abs(s[v] - sc) < 1e-12 for _, v, sc in got[q])
            hit += len(set(best) & {v for _, v, _ in got[q]})
        assert hit / (5 * len(got)) >= 0.9
        assert [v for _, v, _ in got[100]] == [101, 102, 103, 104, 105] and [v for _, v, _ in got[150]] == [100, 101, 102, 103, 104]


def test_ann_lengths_and_sizes_of_components(spark):
    rows = [(0, [1e200, 2e200]), (1, [1e-200, 2e-200]), (2, [-1.0, 3.0]), (50, [1.0, 0.0, 0.0]), (51, [2.0, 0.1, 0.0]), (52, [5e-324, 0.0, 0.0]), (100, [7.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    assert by == {0: [(1, 1.0), (2, round(5 / 50**0.5, 9))], 50: [(52, 1.0), (51, round(2 / 4.01**0.5, 9))]}


def test_ann_reads_few_rows_where_vectors_have_clusters():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 32))
    x = ann.unit(centres[rng.integers(0, 300, 20_000)] + 0.35 * rng.normal(size=(20_000, 32)))
    ix = ann.fit(x[rng.permutation(20_000)[:8000]], len(x) // 120)
    row, lists = ann.postings(ix.centroids, x, 2, 1.03)
    members = defaultdict(set)
    for r, c in zip(row.tolist(), lists.tolist()):
        members[c].add(r)
    read = hit = 0
    for q in range(0, 20_000, 200):
        seen = [members[c] for c in ix.lists(x[q], 1.28).tolist()]
        best = np.argsort(-(x @ x[q]), kind="stable")[1:6]
        read += sum(map(len, seen))
        hit += len(set(best.tolist()) & set().union(*seen))
    assert hit / 500 >= 0.9 and read / (100 * 20_000) <= 0.1


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_pii(spark):
    rng = random.Random(2)
    pieces = ["a.b@c.de", "x@y", "_x@d.e.f", "a@b.c_x@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.02.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 567-8901", "++49 30 123456 7", "ü😀", "token", "12 34 56", "@", ".", "+", "\n"]
    rows = [(i, rng.choice(["", " ", "-"]).join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for i in range(80)]
    rows += [(90, None), (91, "a" * 50000 + "@"), (92, "7" * 30000), (None, "q@r.st"), (0, rows[0][1]), (0, "z@z.zz")]
    rows += [(200 + i, f"filler {i} words Quixotic zephyr s{i % 4}@ex.org and more") for i in range(12)] + [(300 + i, f"filler words {i} and more") for i in range(40)]
    out = pii.sanitise(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for i, t in rows:
        by[i].append(brute_pii(t))
    for r in out:
        base = [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["__spans"] if s["kind"] != "term"]
        assert base in by[r["doc_id"]]
    hidden = [r for r in out if r["doc_id"] is not None and 200 <= r["doc_id"] < 300]
    assert all("Quixotic" not in r["text"] and "zephyr" not in r["text"] and "@" not in r["text"] for r in hidden)
    assert all("and more" in r["text"] for r in out if r["doc_id"] is not None and 300 <= r["doc_id"])


def test_pii_terms_of_the_whole_document(spark):
    far = "common words of all " * 30
    rows = [(i, f"Quixotic s@ex.org 77 Quixotic {far} zephyr, 12 34 Quixotic {i} ü quixotic") for i in range(4)] + [(100 + i, f"{far} {i}") for i in range(60)]
    rows += [(200, "4111 1111 1111 1111, 12 34 gnome"), (201, "4111 1111 1111 1111, 12 34 gnome x")]
    for r in pii.sanitise(docs_of(spark, rows)).collect():
        left = r["text"].lower()
        assert "quixotic" not in left and "zephyr" not in left and "gnome" not in left
        assert r["doc_id"] >= 200 or "common words of all" in left
        for s in r["__spans"]:
            text = dict(rows)[r["doc_id"]][s["start"] : s["end"]]
            assert s["kind"] != "term" or text.lower() in ("quixotic", "zephyr", "gnome"), text


def test_pii_disclosure_equals_brute_force(spark):
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma-ray", "o'neil", "ab", "éta", "theta9", "iota", "kappa", "Iota"]
    mails = ["p@x.org", "q.r@y.net", "P@x.org"]
    texts = [" ".join(rng.choice(words[: 3 + i % 8]) if rng.random() < 0.85 else rng.choice(mails) if rng.random() < 0.7 else "+49 30 1234567" for _ in range(rng.randint(0, 12))) for i in range(60)]
    texts = [t + "".join(f" mark{j} Sign{j}" for j, m in enumerate(mails) if m in t and rng.random() < 0.8) for t in texts]
    texts += [f"{rng.choice(words)} word {i}" for i in range(60)]
    rows = list(enumerate(texts + texts[:9] + ["beta alphaville p@x.org"]))
    at = {t: [] for t in set(t for _, t in rows)}
    terms, held = {}, {}
    for t in at:
        spans = brute_pii(t)
        mail = [(a, z) for a, _, z, k in spans if k == "email"]
        blank = "".join(" " if any(a <= i < z for a, z in mail) else c for i, c in enumerate(t))
        at[t] = [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(pii.TERM, blank)]
        terms[t] = {x[2] for x in at[t]}
        held[t] = {(k, t[a:z]) for a, _, z, k in spans}
    n = len(at)
    want = {t: set() for t in at}
    for e in set().union(*held.values()):
        have = [t for t in at if e in held[t]]
        for w in set().union(*terms.values()):
            both = sum(w in terms[t] for t in have)
            if both >= 2 and len(have) < n:
                share = np.log(n * both / (len(have) * sum(w in terms[t] for t in at))) / np.log(n / len(have))
                if share >= 0.6:
                    for t in have:
                        want[t] |= {(a, z, w) for a, z, x in at[t] if x == w}
    assert any(want.values())
    out = pii.sanitise(docs_of(spark, rows)).select("doc_id", "__spans").collect()
    assert len(out) == len(rows)
    for r in out:
        t = rows[r["doc_id"]][1]
        assert {(s["start"], s["end"], t[s["start"] : s["end"]].lower()) for s in r["__spans"] if s["kind"] == "term"} == want[t], t


@given(st.text(st.sampled_from("<|\\>ims_endstar\n x"), max_size=40), st.text(st.sampled_from("<|\\\nan"), max_size=12))
@settings(max_examples=200, deadline=None)
def test_chat_escape_is_reversible(text, role):
    esc = lambda s: re.sub(r"<(\\*)\|", r"<\1\\|", s)
    shown = f"{chat.START}{esc(role).replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n')}\n{esc(text)}{chat.END}\n"
    assert "<|" not in esc(text) and chat.parse_turn(shown) == (role, text)


def test_chat_fold_and_digest(spark):
    e = [
        (1, 1, "a", "delta", "user", "hel"), (1, 2, "a", "delta", "user", "lo"), (1, 3, "b", "delta", "assistant", "wrong"), (1, 5, "c", "delta", "user", None),
        (1, 4, "b", "regenerate", "assistant", None), (1, 6, "b", "delta", "assistant", "ri<|im_end|>"), (1, 7, "b", "delta", "assistant", "ght <\\|"), (1, 8, "a", "edit", "user", "hi"),
        (None, 1, "a", "delta", None, "x\ny"), (2, 1, "a", "delta", "assistant\\\n<|", "z"), (3, 1, "a", "delta", "assistant", "dup"), (3, 1, "a2", "delta", "assistant", "dup"),
    ]
    events = spark.createDataFrame(e, "conv long, seq long, msg string, kind string, role string, text string").repartition(4)
    want = {1: [("user", "hi"), ("assistant", "ri<|im_end|>ght <\\|"), ("user", "")], None: [("", "x\ny")], 2: [("assistant\\\n<|", "z")], 3: [("assistant", "dup")] * 2}
    rendered = chat.render(chat.fold_events(events))
    for r in chat.read_back(rendered).collect():
        turns = want.pop(r["conv_id"])
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not want
    unknown = spark.createDataFrame([(1, 1, "a", "wink", "user", "x")], "conv long, seq long, msg string, kind string, role string, text string")
    with pytest.raises(Exception, match="unknown event"):
        chat.fold_events(unknown).collect()


def test_op10_keeps_equal_rows(spark, tmp_path):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "ok"), (1, 1, "assistant", "ok"), (1, 1, None, ""), (1, 1, "", None), (None, 0, "assistant", "a"), (None, 0, "assistant", "a")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op10_chat_formatting(spark, str(tmp_path)).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (5, 4, hashlib.sha256(b"okok").hexdigest())
    assert (got[None]["n_turns"], got[None]["turns_sha256"]) == (2, hashlib.sha256(b"assistant\na\n" * 2).hexdigest())


def test_simhash_broadcasts_no_table_of_signatures(spark, monkeypatch):
    """Spark sizes the signatures as if each fingerprint had one."""
    planned = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    plans = []
    monkeypatch.setattr(simhash, "cut", lambda df, cut=simhash.cut: plans.append(planned(df)) or cut(df))
    out = simhash.near_duplicates(docs_of(spark, [(i, f"a b c d{i} e{i} f{i}") for i in range(40)]), words=3)
    keyed = [p for p in plans if "Generate explode" in p and "SortMergeJoin" in p]
    assert len(keyed) == 1 and "BroadcastHashJoin" not in keyed[0] and "BroadcastHashJoin" not in planned(out).split("Scan parquet")[0]
    assert {r["component"] for r in out.collect()} <= set(range(40)) and out.count() == 40
