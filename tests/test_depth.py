"""Extraction in depth, and one graph from scan to capsule."""

import json

import pytest
from pyspark.sql import functions as F

from weft.operators import capsule, extract, records, semantics
from weft.plans.engine import Engine
from weft.plans.samples import LINKED, ROUTES
from weft.sources import files as src

@pytest.fixture(scope="module")
def scan(spark):
    rows = [(name, path, text) for name, (files, _) in ROUTES.items() for path, text in files.items()]
    rows += LINKED
    return Engine().scan(src.from_texts(spark, rows))


def test_routes_in_depth(scan):
    got = {}
    for r in scan.entrypoints.collect():
        got.setdefault(r["unit"], set()).add(r["name"])
    for name, (_, want) in ROUTES.items():
        assert got[name] == want, name


def test_calls_and_aliases(scan):
    calls = {(r["method"], r["path"], r["origin"]) for r in scan.http_calls.where("unit = 'web'").collect()}
    assert calls == {("GET", "/u", None), ("POST", "/s/t", None), ("PUT", "/x?y=1", "https://h.org"), ("GET", "dynamic://unresolved", "dynamic://unresolved")}
    names = {(r["unit"], r["id"]): r["file"] for r in scan.components.collect()}
    edges = {(r["unit"], names[r["unit"], r["source"]], names[r["unit"], r["target"]]) for r in scan.dependencies.where("kind = 'imports'").collect()}
    assert {("web", "src/main.ts", "src/app/api.ts"), ("web", "src/main.ts", "src/config.ts"), ("py", "a.py", "b.py"), ("py", "a.py", "c.py")} <= edges


def test_one_graph_from_scan_to_capsule(spark, scan):
    row, wrong = Engine().validate_scan(scan)
    row = row.first()
    assert row["passed"] and row["missing_sources"] == 0 and row["missing_targets"] == 0 and wrong.count() == 0
    cross = {(r["source_unit"], r["target_unit"], r["kind"], r["evidence"]) for r in scan.cross.collect()}
    assert cross == {("web", "express", "http", "/u"), ("web", "lib", "package", "@x/lib")}
    main = scan.components.where("unit = 'web' AND name = 'Main'").first()["id"]
    targets = spark.createDataFrame([("web", f"component:{main}")], "unit string, target string")
    nodes, _ = Engine().slice_targets(scan, targets)
    assert {r["unit"] for r in nodes.collect()} == {"web", "express", "lib"}
    files = {(r["unit"], r["file"]) for r in Engine().capsule_of(scan, targets).collect()}
    assert {("web", "src/main.ts"), ("web", "src/app/api.ts"), ("web", "package.json"), ("web", "tsconfig.json"), ("express", "i.js"), ("lib", "package.json")} <= files and ("web", ".env") not in files
    entry = scan.entrypoints.where("unit = 'express' AND name = 'GET /u'").first()["id"]
    back, _ = Engine().slice_targets(scan, spark.createDataFrame([("express", entry), ("x", "project-unit:lib")], "unit string, target string"), reverse=True)
    assert {r["unit"] for r in back.collect()} == {"web", "express", "lib"}
    lines = Engine().export_json(scan.units, {"components": scan.components, "cross": scan.cross.withColumnRenamed("source_unit", "unit")}).orderBy("unit", "section", "key")
    model = json.loads("".join(r["line"] for r in lines.collect()))
    assert {u["unit"] for u in model["units"]} == {r["unit"] for r in scan.units.collect()}
    assert sum(len(u["components"]) for u in model["units"]) == scan.components.distinct().count()


def test_php_methods(spark):
    files = extract.masked(src.from_texts(spark, [("p", "A.php", "<?php\nclass A {\n  public static function one() {}\n  function two(int $x) {}\n  private function three() {} // function no()\n}")]).withColumn("unit", F.lit("p")))
    assert {(r["name"], r["visibility"], r["static"]) for r in semantics.php_methods(files).collect()} == {("one", "public", True), ("two", "public", False), ("three", "private", False)}


def test_capsule_structure(spark):
    files = [("c", "source", "a.txt", "h1", False, None), ("c", "source", "b.txt", "h2", False, None), ("c", "environment", "required.env", "h3", False, "X=1\nMY_CAPSULE=true"), ("d", "source", "l", "h", True, None)]
    files = spark.createDataFrame(files, "capsule string, area string, rel_path string, sha256 string, symlink boolean, text string")
    d = {(k, r["capsule"]): r["sha256"] for k, f in (("s", files.where("area = 'source'")), ("p", files)) for r in capsule.tree_digest(f, ["capsule"]).collect()}
    good = f'[capsule]\nversion = 1\n[metrics]\nfiles = 2\n[target]\nvalue = "component:x"\n[source]\nroot = "."\n[integrity]\nsource_fingerprint = "{d["s", "c"]}"\npayload_fingerprint = "{d["p", "c"]}"\nsource_sha256 = "{d["s", "c"]}"\n'
    manifests = spark.createDataFrame([("c", good), ("d", '[capsule]\nfiles = 7\n[source]\nroot = "/abs"\n[integrity]\nsource_sha256 = "no"\n')], "capsule string, text string")
    got = {}
    for r in capsule.structural_checks(manifests, files).collect():
        got.setdefault(r["capsule"], {})[r["name"]] = r["passed"]
    assert len(got["c"]) == 11 and all(got["c"].values())
    assert {k for k, ok in got["d"].items() if ok} == {"manifest", "source", "payload-integrity-sha256"}
    listed = capsule.list_capsules(spark.createDataFrame([("out/z/capsule.toml", good), (".tmp/capsule.toml", good), ("x/other.toml", good)], "path string, text string"))
    assert [(r["target"], r["path"]) for r in listed.collect()] == [("component:x", "out/z")]


def test_remotes(spark):
    want = {"https://GitHub.com/Me/Repo.git": "https://github.com/me/repo", "git@h.org:a/B.git": "ssh://h.org/a/B", "ssh://git@h.org/a/": "ssh://h.org/a", "https://u:p@h.org/a": None, "https://h.org:8443/a": None, "https://h.org/a?x": None, "http://h.org/a": None, "https://h.org/": None, "": None}
    df = spark.createDataFrame([(k,) for k in want], "u string").select("u", records.remote_identity(F.col("u")).alias("r"))
    assert {r["u"]: r["r"] for r in df.collect()} == want
