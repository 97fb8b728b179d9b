"""Suites of analyzers: what a unit's files show decides which run; analyzers written in Python are table functions of SQL.

A suite works on DataFrames. An analyzer that is easier said file by file is a class, registered under a name: over one
file with LATERAL, which needs no shuffle, or over a unit's files in order with PARTITION BY, where rows stream through
one instance and only what it keeps is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..session import cut


@dataclass(frozen=True)
class Suite:
    """detect: an aggregate over a unit's files, true where the suite applies; analyze: its rows, with a column unit, from those units' files."""

    id: str
    detect: Column
    analyze: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Ran:
    """detected(unit, suite); rows of all suites that ran, with suite, or None where none did; ids of those that did not."""

    detected: DataFrame
    rows: DataFrame | None
    skipped: list[str]


def run(files: DataFrame, suites: list[Suite]) -> Ran:
    """Each suite on the files of the units that it detects; a suite that no unit needs is not called at all. All suites are
    detected in one aggregate; a null detection counts as none, and suites' rows may differ in columns."""
    if len({s.id for s in suites}) < len(suites):
        raise ValueError("two suites have the same id")
    seen = files.groupBy("unit").agg(*[F.coalesce(s.detect, F.lit(False)).alias(f"s{i}") for i, s in enumerate(suites)])
    ids = F.array_compact(F.array(*[F.when(F.col(f"s{i}"), F.lit(s.id)) for i, s in enumerate(suites)]))
    detected = cut(seen.select("unit", F.explode(ids).alias("suite")))
    needed = {r.suite for r in detected.select("suite").distinct().collect()}  # no more than there are suites
    rows = None
    for s in suites:
        if s.id in needed:
            own = s.analyze(files.join(detected.where(F.col("suite") == s.id).select("unit"), "unit", "left_semi")).withColumn("suite", F.lit(s.id))
            rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    return Ran(detected, rows, [s.id for s in suites if s.id not in needed])


class Analyzer:
    """An analyzer of files: file() gives the rows of one file, end() what can be said after a unit's last. A row is a tuple of the registered schema."""

    def file(self, path, text: str) -> Iterable[tuple]:
        return ()

    def end(self) -> Iterable[tuple]:
        return ()


def register(spark: SparkSession, name: str, analyzer: type[Analyzer], schema: str) -> None:
    """Two table functions of SQL. name(path, text), for LATERAL, sees one file; name_of_unit(TABLE(...) PARTITION BY unit ORDER BY
    rel_path) sees a unit's files (columns unit, rel_path and text) in order, and its rows begin with the unit. A null text is empty."""

    class OfFile:
        def eval(self, path, text: str):
            yield from analyzer().file(path, text or "")

    class OfUnit:
        def __init__(self):
            self.analyzer, self.unit, self.any = analyzer(), None, False

        def eval(self, row: Row):
            self.unit, self.any = row["unit"], True
            for out in self.analyzer.file(row["rel_path"], row["text"] or ""):
                yield (self.unit, *out)

        def terminate(self):
            if self.any:
                for out in self.analyzer.end():
                    yield (self.unit, *out)

    spark.udtf.register(name, udtf(OfFile, returnType=schema))
    spark.udtf.register(f"{name}_of_unit", udtf(OfUnit, returnType=f"unit string, {schema}"))
