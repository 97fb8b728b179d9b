import pytest
from fixtures import FORBIDDEN, PROJECTS
from pyspark.sql import functions as F

from weft.operators import extract, scoring
from weft.sources import files as src


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(name, path, text) for name, (tree, _, _) in PROJECTS.items() for path, text in tree.items()]
    rows.append(("excluded", "src/Visible.php", "<?php class Visible {}"))
    rows.append(("excluded", "vendor/x/Ignored.php", "<?php class Ignored {}"))
    files = src.from_texts(spark, rows).withColumn("unit", F.col("repository"))
    files = extract.masked(files).cache()
    found = extract.detections(files).cache()
    return files, found


def test_frameworks(scanned):
    _, found = scanned
    got = {}
    for r in found.where("actionable").collect():
        got.setdefault(r["unit"], set()).add(r["name"])
    assert {k: got.get(k, set()) for k in PROJECTS} == {k: v[1] for k, v in PROJECTS.items()}


def test_entrypoints(scanned):
    files, found = scanned
    got = {}
    for r in extract.entrypoints(files, found).collect():
        got.setdefault(r["unit"], set()).add(r["name"])
    missing = {k: want - got.get(k, set()) for k, (_, _, want) in PROJECTS.items() if want - got.get(k, set())}
    assert not missing, (missing, {k: got.get(k) for k in missing})
    extra = {k: bad & got.get(k, set()) for k, bad in FORBIDDEN.items() if bad & got.get(k, set())}
    assert not extra
    assert got["spring"] == {"GET /api/users/{id}"}


def test_components_and_imports(scanned):
    files, _ = scanned
    names = {(r["unit"], r["kind"], r["name"]) for r in extract.components(files).collect()}
    assert ("angular", "class", "UsersComponent") in names and ("excluded", "class", "Visible") in names
    assert not any(n == "Ignored" for _, _, n in names)
    edges = {(r["unit"], r["source"], r["target"]) for r in extract.import_edges(files, extract.imports(files)).collect()}
    assert ("spring", "src/main/java/U.java", "src/main/java/a/b/Service1.java") in edges


def test_http_calls(spark):
    rows = [("r", "a.ts", "fetch('/api/users/42', { method: 'POST' });\naxios.get(`https://x.example.com/items?id=1`);\nthis.http.delete(url);\n// fetch('/no')\n")]
    files = extract.masked(src.from_texts(spark, rows).withColumn("unit", F.lit("u")))
    got = {(r["method"], r["path"], r["origin"]) for r in extract.http_calls(files).collect()}
    assert got == {("POST", "/api/users/42", None), ("GET", "/items?id=1", "https://x.example.com"), ("DELETE", "dynamic://unresolved", "dynamic://unresolved")}


def test_units(spark):
    rows = [("mono", "pnpm-workspace.yaml", ""), ("mono", "package.json", "{}"), ("mono", "apps/api/composer.json", "{}"), ("mono", "apps/api/artisan", ""), ("mono", "apps/web/package.json", '{"react": "1"}'), ("bare", "x.txt", "")]
    files = src.from_texts(spark, rows)
    units = src.discover_units(files)
    assert {(r["repository"], r["root"]) for r in units.collect()} == {("mono", "apps/api"), ("mono", "apps/web"), ("bare", "")}
    placed = {(r["unit"], r["rel_path"]) for r in src.assign_units(files, units).select("unit", "rel_path").collect()}
    assert ("mono/apps/api", "artisan") in placed and ("bare", "x.txt") in placed


def test_read_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("class A: pass")
    (tmp_path / "src/b.bin").write_bytes(b"\0\1")
    (tmp_path / "node_modules/c.js").write_text("x")
    got = {r["rel_path"]: (r["language"], r["is_text"]) for r in src.read_tree(spark, str(tmp_path), "r").collect()}
    assert got == {"src/a.py": ("Python", True), "src/b.bin": ("Unknown", False)}


def test_quality_of_detection(scanned):
    _, found = scanned
    spark = found.sparkSession
    want = spark.createDataFrame([(k, f) for k, v in PROJECTS.items() for f in v[1]], "unit string, name string")
    row = scoring.quality(found.where("actionable"), want, ["unit", "name"]).first()
    assert row["precision"] >= 0.9 and row["recall"] >= 0.9 and row["f1"] >= 0.9
