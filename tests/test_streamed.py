"""States by a stream: batches, restarts, late changes; manifests in JSON."""

from datetime import datetime

from pyspark.sql import functions as F

from weft.operators import manifests, semantics
from weft.streaming import states

CHANGE = "repository string, file string, content string, removed boolean, at timestamp, seq long"


def _at(n):
    return datetime(2024, 1, 1, 0, n)


def test_states_follow_batches_and_late_changes(spark, tmp_path):
    src, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), CHANGE).coalesce(1).write.mode("append").parquet(src)
        states.follow(spark.readStream.schema(CHANGE).parquet(src), out, log, slices=2).awaitTermination()
        return {r.repository: (r.files, r.signature) for r in states.states(spark, out).collect()}

    first = arrive(("a", "x", "1", False, _at(1), 1), ("a", "y", None, False, _at(1), 2), ("b", "x", "1", False, _at(1), 3), (None, "z", "1", False, _at(1), 4), ("a", None, "1", False, _at(1), 5))
    assert {k: v[0] for k, v in first.items()} == {"a": 2, "b": 1}
    rows = spark.read.parquet(out).count()
    # the same content again, and a change older than the one known: nothing is emitted
    assert arrive(("a", "x", "1", False, _at(5), 6), ("b", "x", "0", False, _at(0), 7)) == first
    assert spark.read.parquet(out).count() == rows
    gone = arrive(("b", "x", None, True, _at(6), 8), ("a", "y", "2", False, _at(6), 9), ("a", "y", None, False, _at(7), 10))
    assert gone == {"a": first["a"]}  # changed and changed back
    back = arrive(("b", "x", "1", False, _at(8), 11))
    assert back == first


def test_json_manifests(spark):
    good = '{"name": "@s/app", "version": "1.0.0", "dependencies": {"a.b": "^1", "c": {"v": 2}}, "devDependencies": ["x"], "author": {"name": "n"}}'
    rows = [
        (1, "package.json", "p1", good), (2, "package.json", "p2", '{"name": "cut", "dependencies": {"left": "^1"'), (3, "composer.json", "p3", '{"name": 5, "require": {"v/p": "*"}, "dependencies": {"no": "1"}}'),
        (4, "package.json", "p4", None), (5, "package.json", "p5", "[1]"), (6, "package.json", "p6", '{"name": "", "dependencies": {}}'), (7, "README.md", "p7", good),
    ]
    files = spark.createDataFrame(rows, "unit int, name string, rel_path string, text string")
    m = manifests.parsed(files)
    assert {r.unit for r in m.where(F.col("malformed")).collect()} == {2, 4}
    assert {(r.unit, r.name) for r in manifests.identities(m).collect()} == {(1, "@s/app")}
    assert {(r.unit, r.section, r.name, r.version) for r in manifests.declared(m).collect()} == {(1, "dependencies", "a.b", "^1"), (1, "dependencies", "c", '{"v":2}'), (3, "require", "v/p", "*")}
    assert {(r.unit, r.name) for r in semantics.package_identities(files).collect()} == {(1, "@s/app"), (2, "cut")}
    assert {(r.unit, r.name) for r in semantics.declared_packages(files).collect()} == {(1, "a.b"), (1, "c"), (2, "left"), (3, "v/p")}
