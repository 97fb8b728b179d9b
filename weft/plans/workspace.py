"""A workspace: repositories scanned together, audited, and kept in versions of which only what changed is scanned again."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import link, records
from ..session import cut
from ..sources.records import repository_state
from ..sources.versions import Versions
from .engine import Engine, audit

#: Tables that a workspace keeps, with their keys.
KEPT = {
    "states": ["repository"], "audits": ["repository"], "units": ["unit"], "components": ["unit", "id"], "entrypoints": ["unit", "id"], "dependencies": ["unit", "source", "target", "kind"],
    "http_calls": ["unit", "file", "method", "path", "called_origin"],
}


def benchmark(spark: SparkSession, cases: dict[str, tuple[Callable[[], object], int]], runs: int = 3) -> DataFrame:
    """records.benchmark_stats of cases (name: what to run, how many files it reads), each run 1 to 10 times. What is run must do its work, not only plan it."""
    if not 1 <= runs <= 10:
        raise ValueError("runs is required to be 1 to 10")
    took = []
    for name, (run, files) in cases.items():
        for i in range(1, runs + 1):
            began = time.perf_counter()
            run()
            took.append((name, i, int((time.perf_counter() - began) * 1000), files))
    return records.benchmark_stats(spark.createDataFrame(took, "case string, run int, duration_ms long, files long"))


class Workspace:
    """The newest scan of each repository, in a store of versions."""

    def __init__(self, spark: SparkSession, base: str, engine: Engine | None = None):
        self.engine, self.store = engine or Engine(), Versions(spark, base, KEPT)

    def read(self, name: str) -> DataFrame:
        return self.store.read(name)

    def changed(self, files: DataFrame) -> DataFrame:
        """repository, signature, change (added, changed, removed) of repositories that are not as they were kept."""
        now = repository_state(files)
        if self.store.head() is None:
            return now.withColumn("change", F.lit("added"))
        both = now.join(self.read("states").withColumnRenamed("signature", "kept"), "repository", "full_outer")
        change = F.when(F.col("kept").isNull(), "added").when(F.col("signature").isNull(), "removed").when(F.col("kept") != F.col("signature"), "changed")
        return both.withColumn("change", change).where("change IS NOT NULL").select("repository", "signature", "change")

    def refresh(self, files: DataFrame) -> DataFrame:
        """Scan what was added or changed, drop what is gone, commit both as one version; returns the changes.

        files are all files of all repositories (sources/files.py). Where nothing changed, no version is written."""
        changes = cut(self.changed(files))
        if changes.isEmpty():
            return changes
        live = changes.where("change <> 'removed'")
        s = self.engine.scan(files.join(live.select("repository"), "repository", "left_semi"))
        units = s.files.select("unit", "repository").distinct().join(s.units, "unit")
        calls = s.http_calls.select("unit", "file", "method", "path", F.coalesce("origin", F.lit("")).alias("called_origin"), "component").distinct()
        puts = {
            "states": live.select("repository", "signature"), "audits": audit(s), "units": units, "components": s.components, "dependencies": s.dependencies,
            "entrypoints": s.entrypoints.groupBy("unit", "id").agg(F.min(F.struct(*[c for c in s.entrypoints.columns if c not in ("unit", "id")])).alias("x")).select("unit", "id", "x.*"),
            "http_calls": calls.groupBy("unit", "file", "method", "path", "called_origin").agg(F.min("component").alias("component")),
        }
        drops = {}
        if self.store.head() is not None:
            old = self.read("units").join(changes.select("repository"), "repository", "left_semi").select("unit")
            drops = {n: self.read(n).join(old, "unit", "left_semi") for n in ("units", "components", "entrypoints", "dependencies", "http_calls")}
            drops |= {n: changes.where("change = 'removed'") for n in ("states", "audits")}
        self.store.commit(puts, drops)
        return changes

    def http_links(self) -> DataFrame:
        """Links of all kept calls and endpoints, across repositories whether they were scanned together or not."""
        calls = self.read("http_calls").withColumn("origin", F.nullif("called_origin", F.lit(""))).withColumn("call_id", F.sha2(F.concat_ws("\0", "unit", "file", "method", "path"), 256))
        ends = self.read("entrypoints").select(F.col("id").alias("endpoint_id"), "unit", F.split("name", " ")[0].alias("method"), F.split("name", " ")[1].alias("path")).where("method <> 'ROUTE'")
        return link.http_links(calls, ends)

    def audits(self, repository: str | None = None) -> DataFrame:
        """Kept audit records, newest first; of one repository, where it is named."""
        rows = self.read("audits")
        return records.newest_first(rows.where(F.col("repository") == repository) if repository is not None else rows)
