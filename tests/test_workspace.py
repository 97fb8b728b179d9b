"""A workspace scanned again after changes, its audits, benchmark figures and codes of errors."""

import pytest
from pyspark.sql import functions as F

from weft.operators import extract, records
from weft.plans.workspace import KEPT, Workspace, benchmark
from weft.sources import files as src

API = [("api", "package.json", '{"dependencies": {"express": "4"}}'), ("api", "index.js", "const express = require('express');\nconst app = express();\napp.get('/items/:id', h);")]
WEB = [("web", "package.json", '{"dependencies": {"axios": "1"}}'), ("web", "a.ts", "import axios from 'axios';\naxios.get('/items/7');")]
OLD = [("old", "a.py", "def gone(): ...")]


def test_only_what_changed_is_scanned_again(spark, tmp_path):
    w = Workspace(spark, str(tmp_path))
    first = w.refresh(src.from_texts(spark, API + WEB + OLD))
    assert {(r["repository"], r["change"]) for r in first.collect()} == {(n, "added") for n in ("api", "web", "old")}
    assert {(r["call_unit"], r["target_unit"]) for r in w.http_links().collect()} == {("web", "api")}
    assert {r["name"] for r in w.read("entrypoints").collect()} == {"GET /items/{id}"}

    seen = []
    w.engine.scan = lambda files, scan=w.engine.scan: (seen.append({r["repository"] for r in files.select("repository").distinct().collect()}), scan(files))[1]
    changed = [API[0], ("api", "index.js", API[1][2].replace("/items/:id", "/other"))]
    second = w.refresh(src.from_texts(spark, changed + WEB))
    assert {(r["repository"], r["change"]) for r in second.collect()} == {("api", "changed"), ("old", "removed")}
    assert seen == [{"api"}]
    assert {r["name"] for r in w.read("entrypoints").collect()} == {"GET /other"} and w.http_links().count() == 0
    assert {r["unit"] for r in w.read("components").collect()} == {"api", "web"}
    assert {r["repository"] for r in w.audits().collect()} == {"api", "web"} and w.audits("web").first()["status"] == "COMPLETED"

    head = w.store.head()
    assert w.refresh(src.from_texts(spark, changed + WEB)).isEmpty() and w.store.head() == head and set(KEPT) == {"states", "audits", "units", "components", "entrypoints", "dependencies", "http_calls"}


def test_unit_audits_of_odd_rows(spark):
    units = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", None)], "unit string, repository string")
    comps = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "unit string, id string")
    deps = spark.createDataFrame([("a", "x", "y"), ("a", "y", "x"), ("b", "x", "y")], "unit string, source string, target string")
    said = spark.createDataFrame([("b", "warning"), ("z", "error")], "unit string, level string")
    got = {r["unit"]: (r["components"], r["dependencies"], r["errors"], r["warnings"], r["graph_ok"], r["clean"]) for r in records.unit_audits(units, comps, deps, said).collect()}
    assert got == {"a": (2, 2, 0, 0, True, False), "b": (1, 1, 0, 1, False, False), "c": (0, 0, 0, 0, True, True)}


def test_benchmark_and_codes(spark):
    row = benchmark(spark, {"count": (lambda: spark.range(10).count(), 10)}, runs=2).first()
    assert row["case"] == "count" and row["cold_files_per_second"] > 0
    with pytest.raises(ValueError):
        benchmark(spark, {}, runs=11)
    texts = ["Repository 7 NOT FOUND", "name is required", "No such file", "other", None, ""]
    got = [r["c"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(records.error_code(F.col("t")).alias("c")).collect()]
    assert got == ["REPOSITORY_NOT_FOUND", "INVALID_ARGUMENT", "PATH_NOT_FOUND", "COMMAND_FAILED", None, "COMMAND_FAILED"]


def test_imports_leave_out_endings_of_their_own_language(spark):
    rows = [("u", "a.ts", "import './b';"), ("u", "b.py", "def b(): ..."), ("u", "c.py", "import d"), ("u", "d.ts", "1"), ("u", "d/__init__.py", "")]
    files = src.from_texts(spark, rows)
    placed = extract.masked(src.assign_units(files, src.discover_units(files)))
    assert [(r["source"], r["target"]) for r in extract.import_edges(placed, extract.imports(placed)).collect()] == [("c.py", "d/__init__.py")]
