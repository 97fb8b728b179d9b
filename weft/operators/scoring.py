"""Evidence, confidence and what follows from them. Rules are tables; scores are conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least confidence; least with strong source evidence; what strong is.
POLICY = (70, 60, 90)
DIRECT = ("manifest", "configuration", "source")


def detection_score(signals: DataFrame) -> DataFrame:
    """signals(unit, name, signal, weight, kind, strength, source): one confidence for each unit and name.

    Each signal counts once; the sum is capped at 100. evidence lists the first source of each signal."""
    each = signals.groupBy("unit", "name", "signal").agg(F.max("weight").alias("weight"), F.min("source").alias("source"), F.first("kind").alias("kind"), F.max("strength").alias("strength"))
    return each.groupBy("unit", "name").agg(
        F.least(F.lit(100), F.sum("weight")).cast("int").alias("confidence"),
        F.array_sort(F.collect_list(F.struct("kind", "source", "signal", "strength"))).alias("evidence"),
    )  # as many as there are signals for a name: the rule table bounds it


def actionable(confidence: Column, evidence: Column, policy: tuple[int, int, int] = POLICY) -> Column:
    """Direct evidence and enough confidence, or a little less with a strong source."""
    least, less, strong = policy
    direct = F.exists(evidence, lambda e: e["kind"].isin(*DIRECT))
    sure = F.exists(evidence, lambda e: (e["kind"] == "source") & (e["strength"] >= strong))
    return direct & ((confidence >= least) | ((confidence >= less) & sure))


def database_confidence(files: Column) -> Column:
    return F.least(F.lit(100), F.lit(65) + 12 * F.least(files, F.lit(3))).cast("int")


def compatibility(has_framework: Column, edges: Column, components: Column) -> Column:
    return F.when(has_framework, "L3").when(edges > 0, "L2").when(components > 0, "L1").otherwise("L0")


def role(frontend: Column, backend: Column, infrastructure: Column, library: Column, routes: Column) -> Column:
    return (
        F.when(frontend & backend, "Fullstack").when(frontend & library & ~routes, "Library").when(frontend, "Frontend")
        .when(backend, "Backend").when(infrastructure, "Infrastructure").when(library, "Library").otherwise("Unknown")
    )


def quality(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row: true_positives, false_positives, false_negatives, precision, recall, f1."""
    f = found.select(*keys).distinct().withColumn("f", F.lit(1))
    e = expected.select(*keys).distinct().withColumn("e", F.lit(1))
    both = f.join(e, keys, "full_outer").agg(
        F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull()).alias("true_positives"),
        F.count_if(F.col("e").isNull()).alias("false_positives"), F.count_if(F.col("f").isNull()).alias("false_negatives"),
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("true_positives", "false_positives", "false_negatives"))
    safe = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(1.0)
    return both.withColumn("precision", safe(tp, tp + fp)).withColumn("recall", safe(tp, tp + fn)).withColumn("f1", safe(2 * tp, 2 * tp + fp + fn))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def readiness(passed: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(100 * passed / total)).otherwise(0).cast("int")


def audit_status(graph_ok: Column, clean: Column, errors: Column, warnings: Column) -> Column:
    return F.when(~graph_ok | (errors > 0), "PARTIAL").when(~clean | (warnings > 0), "WARNINGS").otherwise("COMPLETED")
