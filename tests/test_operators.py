"""Operators on hand-made graphs and tables."""

import random

import pytest
from fixtures import PROJECTS
from pyspark.sql import functions as F

from weft.functions import hashing, http
from weft.operators import capsule, graph, link, merge, scoring, text
from weft.plans.engine import Engine, Registry, http_edges
from weft.sources import files as src
from weft.sources import records
from weft.streaming import rescan


def edges_of(spark, *pairs):
    return spark.createDataFrame([(a, b, "calls") for a, b in pairs], "source string, target string, kind string")


def starts_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def nodes(df):
    return {r["node"] for r in df.collect()}


def test_cycle(spark):
    e = edges_of(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))
    v = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    row = graph.integrity(v, e).first()
    assert row["passed"] and not row["is_clean"] and row["in_cycles"] == 3
    assert [tuple(r) for r in graph.cycles(e, 3).collect()] == [("a", "b", "c")]
    assert {tuple(r) for r in graph.strongly_connected(e).collect()} == {("a", "c"), ("b", "c"), ("c", "c")}


def test_slice_and_impact(spark):
    e = edges_of(spark, ("controller", "service"), ("service", "repository"), ("controller", "service"))
    n, inner = graph.dependency_slice(e, starts_of(spark, "controller"))
    assert nodes(n) == {"controller", "service", "repository"} and inner.count() == 3
    n, into = graph.impact_slice(e, starts_of(spark, "repository"))
    assert nodes(n) == {"controller", "service", "repository"} and into.count() == 2
    assert nodes(graph.closure(e, starts_of(spark, "unknown"))) == {"unknown"}
    v = spark.createDataFrame([("controller",), ("service",), ("repository",)], "id string")
    assert not graph.integrity(v, e.unionByName(edges_of(spark, ("missing", "repository")))).first()["passed"]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(40)}
    e = edges_of(spark, *pairs).repartition(3)
    reach = {}
    for s in {x for p in pairs for x in p}:
        seen, todo = {s}, [s]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[s] = seen
    start = sorted(reach)[0]
    assert nodes(graph.closure(e, starts_of(spark, start))) == reach[start]
    want = {x: max(y for y in reach if y in reach[x] and x in reach[y]) for x in reach if any(y != x and y in reach[x] and x in reach[y] for y in reach)}
    assert {r["node"]: r["scc"] for r in graph.strongly_connected(e).collect()} == want


def calls_of(spark, *rows):
    return spark.createDataFrame(list(rows), "call_id string, unit string, method string, path string, origin string")


def ends_of(spark, *rows):
    return spark.createDataFrame(list(rows), "endpoint_id string, unit string, method string, path string")


def test_http_links(spark):
    ends = ends_of(spark, ("e", "backend", "GET", "/api/users/{id}"), ("all", "files", "ANY", "/files/{path*}"))
    got = {r["call_id"]: (r["endpoint_id"], r["confidence"]) for r in link.http_links(calls_of(
        spark, ("a", "web", "get", "/api/users/42?full=true", None), ("b", "web", "GET", "/api/users/${id}", "dynamic://unresolved"), ("c", "web", "GET", "/api/users/1", "http://backend:8080"),
        ("d", "web", "GET", "/api/users/1", "https://third.example.com"), ("e", "backend", "GET", "/api/users/1", None), ("f", "web", "POST", "/files/a/b", "http://localhost:1"), ("g", "web", "GET", "/files", None),
    ), ends).collect()}
    assert got == {"a": ("e", 90), "b": ("e", 70), "c": ("e", 80), "f": ("all", 85), "g": ("all", 90)}
    twice = ends_of(spark, ("x", "u1", "GET", "/health"), ("y", "u2", "GET", "/health"))
    assert link.http_links(calls_of(spark, ("a", "web", "GET", "/health", None)), twice).count() == 0


def test_paths(spark):
    rows = [("/api/users/123?full=true",), ("/api/users/:id",), ("/api/users/{id}",), ("https://x.y/API/users/${id}#a",), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(http.normalize_path(F.col("p"))).collect()]
    assert got == ["/api/users/123", "/api/users/{}", "/api/users/{}", "/api/users/{}", "/"]


def test_packages(spark):
    names = spark.createDataFrame([("lib", "@a/lib"), ("x", "dup"), ("y", "dup")], "unit string, name string")
    said = spark.createDataFrame([("app", "@a/lib"), ("lib", "@a/lib"), ("app", "dup")], "unit string, name string")
    used = spark.createDataFrame([("app", "@a/lib")], "unit string, name string")
    assert [(r["source_unit"], r["target_unit"], r["confidence"]) for r in link.package_links(names, said, used).collect()] == [("app", "lib", 100)]


def fnv(s):
    h = 14695981039346656037
    for b in s.encode():
        h = (h ^ b) * 1099511628211 % 2**64
    return f"{h:016x}"


def test_hashes(spark):
    texts = ["", "a", "src/é.ts", "Ünï 日本", "x" * 300]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in [*texts, "a\\b", None]], "t string").select(hashing.stable_hash(F.col("t")), hashing.slugify(F.col("t"))).collect()]
    assert [g[0] for g in got] == [fnv(t) for t in texts] + [fnv("a/b"), None]
    assert [g[1] for g in got] == ["", "a", "src-ts", "n", "x" * 300, "a-b", None]


def test_secrets(spark):
    lines = ['password = "longenough1"', "API-KEY: abcd1234efgh", "db.token=short", "# secret=abcdefghij", "token = ${TOKEN_VALUE}", "my_client_secret=abcdefghij", "tokens = abcdefghij", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "l string").select(F.coalesce(text.is_secret_line(F.col("l")), F.lit(False))).collect()]
    assert got == [True, True, False, False, False, True, False, False]


def test_gate(spark):
    def gate(confidence, *evidence):
        e = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("strength")) for k, s in evidence])
        return spark.range(1).select(scoring.actionable(F.lit(confidence), e)).first()[0]

    assert gate(70, ("manifest", 100)) and gate(60, ("source", 90)) and not gate(60, ("manifest", 100)) and not gate(100, ("inference", 100), ("convention", 95))


def test_merge(spark):
    s = spark.createDataFrame([("u", "s", 1, "a", ["x"], ["e1"], 50), ("u", "s", 2, None, ["y"], ["e2"], 90), ("u", "s", 0, "z", [], ["e0"], 10)], "unit string, symbol string, seq int, framework_kind string, attributes array<string>, evidence array<string>, confidence int")
    assert tuple(merge.merge_symbols(s).first()) == ("u", "s", "a", ["x", "y"], ["e0", "e1", "e2"], 90)
    a = spark.createDataFrame([("k1", "1"), ("k2", "1")], "k string, s string")
    b = spark.createDataFrame([("k2", "2"), ("k3", "1")], "k string, s string")
    assert {tuple(r) for r in merge.state_diff(a, b, ["k"], "s").collect()} == {("k1", "removed"), ("k2", "changed"), ("k3", "added")}


def test_capsule_round_trip(spark):
    files = spark.createDataFrame([("u", "a.py", "x"), ("u", "b.py", "y")], "unit string, rel_path string, text string")
    said = capsule.file_digests(files)
    assert all(r["passed"] for r in capsule.verification_checks(capsule.file_digests(files), said).collect())
    drift = capsule.file_digests(files.withColumn("text", F.when(F.col("rel_path") == "b.py", "z").otherwise(F.col("text"))))
    failed = {r["name"] for r in capsule.verification_checks(drift, said).collect() if not r["passed"]}
    assert failed == {"content-integrity", "payload-integrity"}
    assert capsule.readiness_scores(capsule.verification_checks(drift, said)).first()["readiness"] == 50


def test_scan(spark):
    rows = [(name, path, t) for name in ("express", "react-manifest-only", "spring") for path, t in PROJECTS[name][0].items()]
    rows += [("shop", "package.json", '{"dependencies": {"react": "1"}}'), ("shop", "client.ts", "import React from 'react';\nfetch('/health');"), ("shop", "db/schema.sql", "select 1 from t"), ("shop", "app.properties", "jdbc:postgresql://h/d")]
    s = Engine(Registry.with_defaults()).scan(src.from_texts(spark, rows))
    summary = {r["unit"]: (r["level"], r["role"]) for r in s.units.collect()}
    assert summary["express"] == ("L3", "Backend") and summary["spring"] == ("L3", "Backend") and summary["shop"] == ("L3", "Frontend")
    tech = {(r["unit"], r["name"]) for r in s.technologies.collect()}
    assert {("shop", "PostgreSQL"), ("shop", "SQL"), ("shop", "React"), ("express", "Express")} <= tech and ("react-manifest-only", "React") not in tech
    assert [(r["call_unit"], r["target_unit"]) for r in http_edges(s).collect()] == [("shop", "express")]
    assert {r["kind"] for r in s.dependencies.where("unit = 'spring'").collect()} == {"imports", "references", "requires"}


def test_registry_and_refresh(spark, tmp_path):
    (tmp_path / "repositories.tsv").write_text("a\tA\t/x\nb\tB\t/y\n")
    assert records.read_registry(spark, str(tmp_path / "repositories.tsv")).count() == 2
    (tmp_path / "r.txt").write_text("status=COMPLETED\nnote=a=b\nbroken\n")
    assert {(r["key"], r["value"]) for r in records.read_records(spark, str(tmp_path / "r.txt")).collect()} == {("status", "COMPLETED"), ("note", "a=b")}
    r = Registry.with_defaults()
    assert r.register("declarations", lambda f: f).signature() == "1|declarations|70:60:90"
    old = spark.createDataFrame([("a", 1), ("b", 1)], "repository string, v int")
    new = spark.createDataFrame([("a", 2)], "repository string, v int")
    assert {tuple(x) for x in records.refresh(old, new).collect()} == {("a", 2), ("b", 1)}
    path = records.write_snapshot(old, str(tmp_path / "snap"))
    assert spark.read.parquet(path).count() == 2


def test_stream(spark, tmp_path):
    new = spark.createDataFrame([("a", 2)], "repository string, v int")
    new.write.parquet(str(tmp_path / "in"))
    old, out = spark.createDataFrame([("a", 1), ("b", 1)], "repository string, v int"), {}
    stream = rescan.file_stream(spark, str(tmp_path / "in"), "repository string, v int")
    rescan.rescan(stream, lambda: old, lambda df, i: out.update({i: {tuple(r) for r in df.collect()}}), str(tmp_path / "cp")).awaitTermination(60)
    assert list(out.values()) == [{("a", 2), ("b", 1)}]
