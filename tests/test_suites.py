"""Suites run where they are detected; analyzers as table functions."""

import pytest
from pyspark.sql import functions as F

from weft.plans import suites


FILES = [("a", "1", "# x\ny\n# z"), ("a", "2", None), ("b", "1", "y"), (None, "9", "# n")]


def test_suites_run_where_detected(spark):
    files = spark.createDataFrame(FILES, "unit string, rel_path string, text string")
    called = []

    def analyze(f):
        called.append(1)
        return f.select("unit", "rel_path")

    ran = suites.run(files, [suites.Suite("heads", F.bool_or(F.col("text").startswith("#")), analyze), suites.Suite("tails", F.bool_or(F.col("text").endswith("?")), analyze)])
    assert ran.skipped == ["tails"] and called == [1]
    assert {tuple(r) for r in ran.detected.collect()} == {("a", "heads"), (None, "heads")}
    assert {tuple(r) for r in ran.rows.select("unit", "rel_path", "suite").collect()} == {("a", "1", "heads"), ("a", "2", "heads")}
    assert suites.run(files.limit(0), [suites.Suite("x", F.lit(True), analyze)]).rows is None
    with pytest.raises(ValueError):
        suites.run(files, [suites.Suite("x", F.lit(True), analyze)] * 2)


def test_analyzers_are_table_functions(spark):
    class Heads(suites.Analyzer):
        def __init__(self):
            self.seen = []

        def file(self, path, text):
            self.seen.append(path)
            yield from ((path, line) for line in text.split("\n") if line.startswith("#"))

        def end(self):
            yield (",".join(self.seen), "end")

    suites.register(spark, "heads", Heads, "path string, line string")
    files = spark.createDataFrame(FILES[:3], "unit string, rel_path string, text string")
    by_file = spark.sql("SELECT f.unit, x.* FROM {files} f, LATERAL heads(f.rel_path, f.text) x", files=files)
    assert sorted(map(tuple, by_file.collect())) == [("a", "1", "# x"), ("a", "1", "# z")]
    files.createOrReplaceTempView("test_suites_files")
    by_unit = spark.sql("SELECT * FROM heads_of_unit(TABLE(test_suites_files) PARTITION BY unit ORDER BY rel_path)")
    assert sorted(map(tuple, by_unit.collect())) == [("a", "1", "# x"), ("a", "1", "# z"), ("a", "1,2", "end"), ("b", "1", "end")]
