"""What lists, registries and audits show: pages, searches, counts, statistics, validity.

All are joins and aggregates on whole tables; only a page and a one-row summary
are small by nature.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page number (from 1) of rows in the given order; a number beyond the last page gives the last."""
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((min(max(1, number), pages) - 1) * size).limit(size)


def search(rows: DataFrame, words: str = "", columns: tuple[str, ...] = (), **equal: str) -> DataFrame:
    """Rows whose columns have the given values and one of whose searched columns contains the words, without regard to case."""
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    if words and columns:
        rows = rows.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(words.lower()) for c in columns]))
    return rows


def top_kinds(rows: DataFrame, kind: str, n: int) -> DataFrame:
    """The n most frequent kinds with their counts, ties by name."""
    return rows.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("components")).orderBy(F.desc("components"), "kind").limit(n)


def unique_technologies(rows: DataFrame) -> DataFrame:
    """name, confidence, evidence from rows(name, confidence, source): the surest detection and how many sources speak for it."""
    return rows.groupBy("name").agg(F.max("confidence").alias("confidence"), F.count_distinct("source").alias("evidence"))


def cross_counts(cross: DataFrame, source: str = "source_repository", target: str = "target_repository") -> DataFrame:
    """repository, edges: cross edges that begin or end in a repository, one inside it counted once."""
    ends = cross.select(F.explode(F.array_distinct(F.array(source, target))).alias("repository"))
    return ends.groupBy("repository").agg(F.count(F.lit(1)).alias("edges"))


def summary(counts: dict[str, tuple[DataFrame, str]], sums: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """One row: for each name the number of different values of a table's column, and the sums asked for."""
    rows = [df.agg(F.count_distinct(c).alias(name)) for name, (df, c) in counts.items()] + [df.agg(F.sum(c).alias(name)) for name, (df, c) in (sums or {}).items()]
    return reduce(DataFrame.crossJoin, rows)  # one row each


def nearest_rank(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank for each key."""
    return rows.groupBy(*keys).agg(*[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY `{value}`)").alias(name) for name, q in ranks.items()])


def benchmark_stats(runs: DataFrame) -> DataFrame:
    """case, cold_ms, warm_average_ms, p95_ms, cold_files_per_second, warm_files_per_second from runs(case, run, duration_ms, files):
    run 1 is cold, the mean of the others warm (the cold one where there are none)."""
    cold = F.max(F.when(F.col("run") == 1, F.col("duration_ms")))
    warm = F.coalesce(F.avg(F.when(F.col("run") > 1, F.col("duration_ms"))), cold)
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)")
    s = runs.groupBy("case").agg(cold.alias("cold_ms"), warm.alias("warm_average_ms"), p95.alias("p95_ms"), F.max("files").alias("files"))
    rate = lambda c: F.when(F.col(c) > 0, F.col("files") * 1000.0 / F.col(c))
    return s.select("case", "cold_ms", "warm_average_ms", "p95_ms", rate("cold_ms").alias("cold_files_per_second"), rate("warm_average_ms").alias("warm_files_per_second"))


def shown_path(path: Column) -> Column:
    """${x} and :x as {x}, so that a call's path and an endpoint's can be equal."""
    return F.regexp_replace(F.regexp_replace(path, r"\$\{(\w+)\}", "{$1}"), r":(\w+)", "{$1}")


def endpoint_rows(endpoints: DataFrame, links: DataFrame, key: str, linked: str) -> DataFrame:
    """endpoints with state (matched or unmatched) and links: the sorted, joined values of `linked` under the same key."""
    of = links.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(linked)), ",").alias("links"))
    out = endpoints.join(of, key, "left")
    return out.withColumn("state", F.when(F.col("links").isNull(), "unmatched").otherwise("matched")).withColumn("links", F.coalesce("links", F.lit("")))


def consumer_rows(calls: DataFrame, links: DataFrame) -> DataFrame:
    """calls(unit, file, method, path) with the endpoint of links(source_unit, consumer_file, method, path, entrypoint), paths compared as shown."""
    known = links.select(F.col("source_unit").alias("unit"), F.col("consumer_file").alias("file"), F.upper("method").alias("method"), shown_path(F.col("path")).alias("shown"), "entrypoint")
    c = calls.withColumn("method", F.upper("method")).withColumn("shown", shown_path(F.col("path")))
    return c.join(known, ["unit", "file", "method", "shown"], "left").drop("shown").withColumn("state", F.when(F.col("entrypoint").isNull(), "unmatched").otherwise("matched"))


def audit_rollup(units: DataFrame) -> DataFrame:
    """units(repository, components, dependencies, errors, warnings, graph_ok, clean), a row each, as a record for each repository."""
    return units.groupBy("repository").agg(*[F.sum(c).alias(c) for c in ("components", "dependencies", "errors", "warnings")], F.bool_and("graph_ok").alias("graph_ok"), F.bool_and("clean").alias("clean"))


def unit_audits(units: DataFrame, components: DataFrame, dependencies: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """units(unit, repository) with components, dependencies, errors, warnings, graph_ok (no end of a dependency is missing) and clean
    (nor is one its own target or on a cycle). Rows of units that are not listed count nowhere."""
    scoped = lambda c: graph.scoped(F.col("unit"), F.col(c).cast("string"))
    edges = dependencies.select("unit", scoped("source").alias("source"), scoped("target").alias("target"))
    owner = edges.select("unit", F.explode(F.array("source", "target")).alias("node")).distinct()
    vertices = components.select(scoped("id").alias("node")).distinct()
    flag = lambda df, name: df.select("unit").distinct().select("unit", F.lit(True).alias(name))
    missing = flag(owner.join(vertices, "node", "left_anti"), "missing")
    looped = flag(edges.where("source = target").select("unit").unionByName(owner.join(graph.strongly_connected(edges).select("node"), "node", "left_semi").select("unit")), "looped")
    count = lambda df, name: df.groupBy("unit").agg(F.count(F.lit(1)).alias(name))
    levels = diagnostics.groupBy("unit").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    out = units.select("unit", "repository").distinct()
    for part in (count(components, "components"), count(dependencies, "dependencies"), levels, missing, looped):
        out = out.join(part, "unit", "left")
    out = out.fillna(0, ["components", "dependencies", "errors", "warnings"]).fillna(False, ["missing", "looped"])
    return out.withColumn("graph_ok", ~F.col("missing")).withColumn("clean", ~F.col("missing") & ~F.col("looped")).drop("missing", "looped")


#: Code, groups of parts of a message in lower case: all of one group must occur; the first that fits. Fixed values.
ERROR_CODES = [
    ("WORKSPACE_NOT_FOUND", [("workspace", "not found")]), ("REPOSITORY_NOT_FOUND", [("repository", "not found")]), ("TARGET_NOT_FOUND", [("target", "not found")]),
    ("INVALID_ARGUMENT", [("required",), ("unknown command",)]), ("PATH_NOT_FOUND", [("valid path",), ("no such file",)]),
]


def error_code(message: Column) -> Column:
    """The code of a message; COMMAND_FAILED, if none fits, and null for null."""
    low = F.lower(message)
    out = F.when(message.isNotNull(), "COMMAND_FAILED")
    for code, groups in reversed(ERROR_CODES):
        hit = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [low.contains(part) for part in g]) for g in groups])
        out = F.when(hit, code).otherwise(out)
    return out


def audits_with_names(audits: DataFrame, repositories: DataFrame) -> DataFrame:
    """audits with the name of repositories(id, name); an unknown repository goes by its id."""
    names = repositories.select(F.col("id").alias("repository"), F.col("name").alias("repository_name"))
    return audits.join(names, "repository", "left").withColumn("repository_name", F.coalesce("repository_name", F.col("repository").cast("string")))


def newest_first(audits: DataFrame, at: str = "recorded_at", then: str = "repository") -> DataFrame:
    return audits.orderBy(F.desc(at), then)


def cache_validity(registry: DataFrame, cache: DataFrame) -> DataFrame:
    """workspace, valid: whether registry and cache(workspace, id, path) of a workspace hold the same ids at the same paths."""
    a = registry.select("workspace", "id", F.col("path").alias("said"))
    b = cache.select("workspace", "id", F.col("path").alias("found"))
    both = a.join(b, ["workspace", "id"], "full_outer")
    return both.groupBy("workspace").agg(F.bool_and(F.coalesce(F.col("said") == F.col("found"), F.lit(False))).alias("valid"))


def is_safe_id(value: Column) -> Column:
    """A name of one folder: no separator, not empty, not "." or ".."."""
    return (value != "") & ~value.rlike(r"[/\\]") & ~value.isin(".", "..")


def remote_identity(value: Column) -> Column:
    """scheme://host/path of a repository's remote (https, ssh or git@host:path); null for others, and for those with
    credentials, ports, queries or fragments. Hosts are in lower case, and so are paths on github.com."""
    v = F.btrim(value)
    form = r"^(?:https://([^/@:\\?#\s]+)/|ssh://(?:git@)?([^/@:\\?#\s]+)/|git@([^/@:\\?#\s]+):)([^?#\n\r\x00]*)$"
    host = F.lower(F.concat(*[F.regexp_extract(v, form, i) for i in (1, 2, 3)]))
    path = F.regexp_replace(F.btrim(F.regexp_extract(v, form, 4), F.lit("/")), r"(\.git)+$", "")
    scheme = F.when(v.startswith("https://"), "https").otherwise("ssh")
    whole = F.concat(scheme, F.lit("://"), host, F.lit("/"), F.btrim(F.when(host == "github.com", F.lower(path)).otherwise(path), F.lit("/")))
    return F.when((host != "") & (F.btrim(F.regexp_extract(v, form, 4), F.lit("/")) != ""), whole)
