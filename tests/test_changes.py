"""Incremental linking against linking anew; stores that are damaged on purpose; registries."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weft.operators import link, relink
from weft.sources.registry import Registry
from weft.sources.versions import Versions

CALL, END = "call_id long, unit string, method string, path string", "endpoint_id long, unit string, method string, path string"


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def _table(rng, n, paths, schema, spark):
    return {i: (i, f"u{rng.randrange(3)}", rng.choice(["GET", "POST"]), rng.choice(paths)) for i in range(n)}


def _change(rng, now, paths):
    out = dict(now)
    for i in rng.sample(sorted(now), 4):
        if rng.random() < 0.4:
            del out[i]
        else:
            out[i] = (i, *now[i][1:3], rng.choice(paths))
    new = max(now) + 1
    out[new] = (new, "u1", "GET", rng.choice(paths))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_relink_equals_linking_anew(spark, seed):
    rng = random.Random(seed)
    call_paths, end_paths = ["/a/1", "/a/2", "/b", "/b/c/d", "/${x}/1"], ["/a/{id}", "/a/1", "/b", "/b/*", "/:p/1"]
    c0, e0 = _table(rng, 20, call_paths, CALL, spark), _table(rng, 12, end_paths, END, spark)
    c1, e1 = _change(rng, c0, call_paths), _change(rng, e0, end_paths)
    calls0, calls1 = (spark.createDataFrame(list(c.values()), CALL) for c in (c0, c1))
    ends0, ends1 = (spark.createDataFrame(list(e.values()), END) for e in (e0, e1))
    hits = link.http_candidates(calls0, ends0)
    r = relink.relink_http(hits, link.only_candidates(hits), calls1, ends1, relink.changed_keys(calls0, calls1, "call_id"), relink.changed_keys(ends0, ends1, "endpoint_id"))
    assert rows(r.candidates) == rows(link.http_candidates(calls1, ends1))
    assert rows(r.links) == rows(link.http_links(calls1, ends1))
    assert r.touched.count() < len(c1)
    assert relink.unsound(r.links, calls1, ends1).isEmpty()


def test_a_new_endpoint_makes_a_call_ambiguous(spark):
    calls = spark.createDataFrame([(1, "web", "GET", "/a/1"), (2, "web", "GET", "/b")], CALL)
    one = spark.createDataFrame([(10, "api", "GET", "/a/{id}"), (11, "api", "GET", "/b")], END)
    two = one.unionByName(spark.createDataFrame([(12, "other", "ANY", "/a/*")], END))
    hits = link.http_candidates(calls, one)
    none = calls.select("call_id").limit(0)
    r = relink.relink_http(hits, link.only_candidates(hits), calls, two, none, relink.changed_keys(one, two, "endpoint_id"))
    assert [x.call_id for x in r.links.collect()] == [2]
    assert {x.what: x.n for x in r.report().collect()} == {"judged": 1, "removed": 1, "added": 0}
    stale = relink.unsound(link.only_candidates(hits), calls.where("call_id = 2"), one.where("endpoint_id = 10"))
    assert rows(stale) == [(1, 10, "missing-call"), (2, 11, "missing-endpoint")]


def test_changed_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (5, "r"), (5, "r"), (None, "z")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, ""), (4, "y"), (5, "r"), (None, "w")], "k long, v string")
    assert sorted(r.k for r in relink.changed_keys(a, b, "k").collect()) == [2, 3, 4, 5]


def test_relink_packages(spark):
    s = "unit string, name string"
    own0 = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "q"), ("d", "r")], s)
    own1 = spark.createDataFrame([("a", "p"), ("b", "q"), ("c", "t"), ("d", "r")], s)
    said0 = spark.createDataFrame([("a", "q"), ("d", "p"), ("c", "r"), ("b", "r")], s)
    said1 = spark.createDataFrame([("a", "q"), ("d", "p"), ("c", "p"), ("b", "r")], s)
    none = said0.limit(0)
    r = relink.relink_packages(link.package_links(own0, said0, none), (own0, own1), said1, none, spark.createDataFrame([("c",)], "unit string"))
    assert rows(r.links) == rows(link.package_links(own1, said1, none))
    assert {(x.source_unit, x.name) for x in r.added.collect()} == {("a", "q"), ("c", "p")}
    assert {(x.source_unit, x.name) for x in r.removed.collect()} == {("c", "r")}


def _store(spark, path):
    s = Versions(spark, str(path), {"t": ["k"]})
    rows_ = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    s.commit({"t": rows_((1, "a"), (2, "b"), (3, None))})
    s.commit({"t": rows_((2, "B"), (4, "d"))}, {"t": rows_((1, ""))})
    return s, rows_


def _files_of(base, version):
    import duckdb

    (folder,) = {f for (f,) in duckdb.sql(f"SELECT folder FROM read_parquet('{base}/manifests/{version:010d}/*.parquet')").fetchall()}
    return sorted(p for p in Path(base, "data", folder).rglob("*.parquet") if p.stat().st_size)


def test_versions_put_drop_compact(spark, tmp_path):
    s, rows_ = _store(spark, tmp_path / "s")
    want = [(2, "B"), (3, None), (4, "d")]
    assert rows(s.read("t")) == want and s.head() == 2
    assert s.compact() == 3 and rows(s.read("t")) == want
    s.commit({"t": rows_((4, "D"))}, {"t": rows_((4, ""), (3, ""), (99, ""))})
    assert rows(s.read("t")) == [(2, "B"), (4, "D")] and s.damage().isEmpty()
    with pytest.raises(KeyError):
        s.commit({"u": rows_((1, "x"))})


@pytest.mark.parametrize("how", ["cut", "flip", "gone"])
def test_a_damaged_version_goes_to_quarantine_and_the_one_before_serves(spark, tmp_path, how):
    s, rows_ = _store(spark, tmp_path / "s")
    s.commit({"t": rows_((5, "e"))})
    file = _files_of(tmp_path / "s", 2)[0]
    whole = file.read_bytes()
    if how == "gone":
        os.remove(file)
    else:
        file.write_bytes(whole[: len(whole) // 2] if how == "cut" else whole[:8] + bytes([whole[8] ^ 1]) + whole[9:])
        crc = file.with_name(f".{file.name}.crc")
        if crc.exists():
            os.remove(crc)
    assert s.head(deep=True) == 1
    notes = s.quarantine().collect()
    assert [(n.version, n.reason) for n in notes] == [(2, {"cut": "length", "flip": "checksum", "gone": "missing"}[how])]
    assert len(s.quarantine().collect()) == 1  # noted once
    assert s.head() == 1 and rows(s.read("t")) == [(1, "a"), (2, "b"), (3, None)]
    assert s.compact() == 4  # what serves becomes the base of what follows
    s.commit({"t": rows_((6, "f"))})
    assert rows(s.read("t")) == [(1, "a"), (2, "b"), (3, None), (6, "f")]


def test_a_damaged_compaction_hides_nothing(spark, tmp_path):
    s, rows_ = _store(spark, tmp_path / "s")
    s.compact()
    s.commit({"t": rows_((7, "g"))})
    os.remove(_files_of(tmp_path / "s", 3)[0])
    assert s.head() == 4 and rows(s.read("t")) == [(2, "B"), (3, None), (4, "d"), (7, "g")]


def test_a_version_without_a_whole_manifest_does_not_exist(spark, tmp_path):
    s, rows_ = _store(spark, tmp_path / "s")
    (manifest,) = (tmp_path / "s" / "manifests" / "0000000002").glob("*.parquet")
    manifest.write_bytes(manifest.read_bytes()[:40])
    os.remove(manifest.with_name(f".{manifest.name}.crc"))
    assert s.head() == 1 and rows(s.read("t")) == [(1, "a"), (2, "b"), (3, None)]
    with pytest.raises(LookupError):
        Versions(spark, str(tmp_path / "none"), {"t": ["k"]}).read("t")


def test_registry(spark, tmp_path):
    r = Registry(Versions(spark, str(tmp_path / "r"), {"repos": ["id"]}), "repos")
    of = lambda *x: spark.createDataFrame(list(x), "id string, path string")
    refused = r.create(of(("a", "/a"), ("b", "/b"), ("..", "/x"), ("d", "1"), ("d", "2"), (None, "n")))
    assert {(x.id, x.code) for x in refused.collect()} == {(None, "invalid-id"), ("..", "invalid-id"), ("d", "repeated-id")}
    assert rows(r.rows()) == [("a", "/a"), ("b", "/b")]
    assert rows(r.create(of(("a", "/z"), ("c", "/c")))) == [("already-exists", "a")]
    assert rows(r.update(of(("a", "/A"), ("q", "/q")))) == [("not-found", "q")]
    assert rows(r.remove(of(("b", ""), ("q", "")))) == [("not-found", "q")]
    assert rows(r.rows()) == [("a", "/A"), ("c", "/c")]
