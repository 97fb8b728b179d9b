"""The pipeline on small tables made here, stage by stage against plain Python."""

import random
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weft.llm import decontaminate, packing, toxicity
from weft.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8)))
    item = " ".join(word() for _ in range(40))
    docs, labels = [], []
    for i in range(240):
        w = [word() for _ in range(rng.randint(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vilword", "nastyish"])
        body = " ".join(w)
        if i % 12 == 1:
            body += f"\nAll rights reserved, line of many\n{word()}"
        if i % 40 == 2:
            body += f" {item}"
        docs.append((i, body))
        labels.append((i, 0, int(toxic)))
    docs += [(1000 + k, docs[3][1]) for k in range(4)] + [(2000, None), (2001, ""), (2002, "")]
    rows = [(i, t, "en", "s", len(t or ""), "extra") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, item


def test_stages(spark, tables):
    d, docs, item = tables
    before = spark.read.parquet(f"{d}/documents.parquet")
    names = before.columns
    model = toxicity.fit(before, spark.read.parquet(f"{d}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, d)
        after = after.cache()
        rows = {r["doc_id"]: r for r in before.collect()}
        if name == "toxicity":
            scorer = toxicity.Scorer(model)
            keep = {i for i, r in rows.items() if scorer.score([r["text"]])[0] < model.thresholds.get(r["lang"], toxicity.THRESHOLD)}
            assert {r["doc_id"] for r in after.collect()} == keep
            assert len(rows) - len(keep) >= 40
        elif name == "line dedup":
            seen = defaultdict(set)
            for i, r in rows.items():
                for line in (r["text"] or "").split("\n"):
                    seen[line.strip().lower()].add(i)
            for r in after.collect():
                kept = [x for x in (rows[r["doc_id"]]["text"] or "").split("\n") if not (x.strip() and len(seen[x.strip().lower()]) >= 10)]
                assert r["text"] == "\n".join(kept) and r["n_chars"] == len(r["text"])
        elif name == "simhash near-dedup":
            left = [r["doc_id"] for r in after.collect()]
            assert len(left) == len(set(left)) and 3 in left and not {1000, 1001, 1002, 1003} & set(left)
            assert len(rows) - len(left) <= 8
        elif name == "benchmark decontamination":
            want = {i for i, r in rows.items() if decontaminate.normalise(item) not in decontaminate.normalise(r["text"])}
            assert {r["doc_id"] for r in after.collect()} == want and len(want) < len(rows)
        else:
            e = packing.Encoder(Path(tokenizer_path()).read_bytes())
            ids = {i: e.encode(r["text"]) + bytes(4) for i, r in rows.items()}
            assert {(r["doc_id"], r["length"], r["ids_crc32"]) for r in after.collect()} == {(i, len(x) // 4, zlib.crc32(x)) for i, x in ids.items()}
            break
        assert after.columns == names
        before = after
    assert corpus_pipeline.run(spark, d).where(F.col("doc_id") == 3).count() == 1


def test_stages_take_null_and_repeated_ids(spark, tables):
    d, _, item = tables
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("bcdfgkmuv") for _ in range(6)) for _ in range(50))
    same, clean, other, lone = text(), text(), text(), text()
    rows = [(None, same), (7, same), (None, same), (8, other), (8, other), (8, clean), (None, f"{lone} {item}"), (9, f"{text()} {item}"), (9, lone)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lambda df: sorted(((r[0], r[1]) for r in df.collect()), key=str)
    left = corpus_pipeline.drop_near_duplicates(spark, docs.where("text not like '%" + item + "'"), d)
    assert got(left) == sorted([(7, same), (8, other), (8, clean), (9, lone)], key=str)
    nulls = spark.createDataFrame([(None, same), (None, same), (None, other)], "doc_id long, text string")
    assert got(corpus_pipeline.drop_near_duplicates(spark, nulls, d)) == sorted([(None, same), (None, other)], key=str)
    left = corpus_pipeline.drop_contaminated(spark, docs, d)
    assert got(left) == sorted([r for r in rows if item not in r[1]], key=str)


def test_stages_take_empty_tables_and_long_texts(spark, tables, tmp_path):
    d, docs, item = tables
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string, id long"
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, d)
        assert out.count() == 0 and (name == "best-fit packing" or out.columns == empty.columns)
    for t, s in (("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], s).write.parquet(f"{tmp_path}/{t}.parquet")
    rng = random.Random(6)
    long = " ".join("".join(rng.choice("bcdfg") for _ in range(6)) for _ in range(60_000))
    rows = spark.createDataFrame([(1, long, "en", "s", len(long), "x", 1), (2, f"{long} {item}", None, "s", None, None, None), (None, None, None, None, None, None, None), (3, "", "en", "s", 0, "", 0)], schema)
    for name, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, rows, str(tmp_path)).count() == 4, name  # no labels, no frequent lines
    assert sorted(str(r[0]) for r in corpus_pipeline.drop_near_duplicates(spark, rows, d).select("doc_id").collect()) == ["1", "3"]
    assert corpus_pipeline.drop_contaminated(spark, rows, str(tmp_path)).count() == 4
    assert sorted(str(r[0]) for r in corpus_pipeline.drop_contaminated(spark, rows, d).select("doc_id").collect()) == ["1", "3", "None"]


def test_near_dedup_stage_broadcasts_no_table_of_signatures(spark, monkeypatch):
    """Spark sizes the signatures as if each fingerprint had one, so at some sizes it would collect them."""
    from weft.llm import simhash

    plans = []
    planned = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(simhash, "cut", lambda df, cut=simhash.cut: plans.append(planned(df)) or cut(df))
    docs = spark.createDataFrame([(i, f"a b c d e{i} f{i} g{i}") for i in range(30)] + [(99, "a b c d e1 f1 g1")], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    keyed = [p for p in plans if "Generate explode" in p and "Join" in p]
    assert len(keyed) == 1 and "BroadcastHashJoin" not in keyed[0]
    assert 99 not in {r["doc_id"] for r in kept.collect()}
