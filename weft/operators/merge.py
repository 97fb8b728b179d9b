"""Merging what several analyzers contribute, and filling in what none has said."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlay(contributions: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of the last contribution replaces earlier ones whole."""
    w = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return contributions.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_symbols(symbols: DataFrame) -> DataFrame:
    """symbols(unit, symbol, seq, framework_kind, attributes, evidence, confidence): the last kind that is set,
    attributes and evidence one after another, the largest confidence. Lists are as long as contributions make them."""
    lists = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]))
    return symbols.groupBy("unit", "symbol").agg(
        F.max_by("framework_kind", F.when(F.col("framework_kind").isNotNull(), F.col("seq"))).alias("framework_kind"),
        lists("attributes").alias("attributes"), lists("evidence").alias("evidence"), F.max("confidence").alias("confidence"),
    )


#: Confidence of metadata that no analyzer gave.
DEFAULTS = {"symbol": 90, "entrypoint": 95, "dependency": 85}


def with_defaults(rows: DataFrame, metadata: DataFrame, keys: list[str], confidence: int, evidence: str) -> DataFrame:
    """metadata, and for rows without any, one row of defaults."""
    rest = rows.select(*keys).distinct().join(metadata.select(*keys).distinct(), keys, "left_anti")
    return metadata.select(*keys, "confidence", "evidence").unionByName(rest.withColumn("confidence", F.lit(confidence)).withColumn("evidence", F.lit(evidence)))


def with_evidence(edges: DataFrame, metadata: DataFrame, keys: list[str], order: str) -> DataFrame:
    """edges, repeats kept, each with evidence and confidence of the first metadata row of its keys, or the defaults."""
    first = metadata.groupBy(*keys).agg(F.min_by(F.struct("evidence", "confidence"), order).alias("__m"))
    out = edges.join(first, keys, "left").withColumn("evidence", F.coalesce("__m.evidence", F.lit("Resolved internal dependency")))
    return out.withColumn("confidence", F.coalesce("__m.confidence", F.lit(DEFAULTS["dependency"]))).drop("__m")


def fallback_files(files: DataFrame, components: DataFrame, max_bytes: int = 2 << 20) -> DataFrame:
    """Text files that no component names; too_large marks those over the size limit, which get a diagnostic instead."""
    rest = files.join(components.select("unit", F.col("file").alias("rel_path")).distinct(), ["unit", "rel_path"], "left_anti")
    return rest.withColumn("too_large", F.col("size") > max_bytes)


def exclude_roots(rows: DataFrame, roots: DataFrame, file_col: str = "file") -> DataFrame:
    """Rows whose file lies in none of roots(unit, root); the join is on all path prefixes, not on a theta condition."""
    parts = F.split(file_col, "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hit = rows.select("unit", file_col).distinct().select("unit", file_col, F.explode(ups).alias("root")).join(roots.select("unit", "root").distinct(), ["unit", "root"], "left_semi")
    return rows.join(hit.select("unit", file_col).distinct(), ["unit", file_col], "left_anti").select(*rows.columns)


def state_diff(before: DataFrame, after: DataFrame, keys: list[str], signature: str) -> DataFrame:
    """keys, change: added, removed or changed between two snapshots."""
    b = before.select(*keys, F.col(signature).alias("old"), F.lit(True).alias("was"))
    a = after.select(*keys, F.col(signature).alias("new"), F.lit(True).alias("is"))
    both = b.join(a, keys, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change")
