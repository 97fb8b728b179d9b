"""Linking: HTTP calls to endpoints, package declarations to packages, imports to modules.

The theta join on paths is an equi join: endpoints have few distinct masks of
dynamic segments, and a call's literal segments outside a mask, with its method,
are the key under which endpoints of that mask can match it. Only calls that hold
dynamic segments themselves are joined by method and length; a residual compares
segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import http
from ..functions.hashing import ascii_lower
from .graph import keep_first


def _signature(segments: Column, mask: Column) -> Column:
    """Segments in lower case, those under the mask as a blank."""
    return F.array_join(F.zip_with(segments, mask, lambda x, hidden: F.when(hidden, F.lit(" ")).otherwise(ascii_lower(x))), "/")


def http_matches(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """calls(call_id, unit, method, path) with endpoints(endpoint_id, unit, method, path): all matches.

    An endpoint serves a call of its method (or any, for ANY) in another unit whose path fits."""
    c = calls.select("call_id", F.col("unit").alias("call_unit"), F.upper("method").alias("call_method"), F.col("path").alias("call_path"))
    c = c.withColumn("cs", http.segments(http.path_of(F.col("call_path")))).withColumn("m", F.explode(F.array_distinct(F.array(F.col("call_method"), F.lit("ANY")))))
    e = endpoints.select("endpoint_id", F.col("unit").alias("target_unit"), F.upper("method").alias("m"), F.col("path").alias("end_path"))
    e = e.withColumn("es", http.segments(http.path_of(F.col("end_path"))))
    e = e.withColumn("tail", F.when(F.size("es") > 0, http.is_catch_all(F.element_at("es", -1))).otherwise(False)).withColumn("head", F.size("es") - F.col("tail").cast("int"))
    fixed = F.slice("es", F.lit(1), F.col("head"))
    e = e.withColumn("mask", F.transform(fixed, http.is_dynamic)).withColumn("sig", _signature(fixed, F.col("mask")))
    # a call may meet endpoints of its own length, and those that end in a catch-all after any part of it
    lengths = F.concat(F.array(F.struct(F.lit(False).alias("tail"), F.size("cs").alias("head"))), F.transform(F.sequence(F.lit(0), F.size("cs")), lambda n: F.struct(F.lit(True).alias("tail"), n.alias("head"))))
    c = c.withColumn("x", F.explode(lengths)).select("*", "x.tail", "x.head").drop("x")
    wide = F.exists("cs", http.is_dynamic)
    masks = e.select("tail", "head", "mask").distinct()
    plain = c.where(~wide).join(masks, ["tail", "head"]).withColumn("sig", _signature(F.slice("cs", F.lit(1), F.col("head")), F.col("mask")))
    hit = plain.join(e, ["m", "tail", "head", "mask", "sig"]).select("call_id", "call_unit", "call_path", "cs", "endpoint_id", "target_unit", "end_path", "es")
    open_ = c.where(wide).join(e, ["m", "tail", "head"]).select(*hit.columns)
    hit = hit.unionByName(open_).where((F.col("call_unit") != F.col("target_unit")) & http.paths_match(F.col("cs"), F.col("es")))
    same = http.normalize_path(F.col("call_path")) == http.normalize_path(F.col("end_path"))
    return hit.select("call_id", "endpoint_id", "call_unit", "target_unit", "call_path", "end_path", F.when(same, 100).otherwise(90).alias("confidence")).distinct()


def http_candidates(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Matches of calls; with an origin column, those to foreign hosts are dropped and an origin lowers confidence: a
    host must be unresolved (70), local (85) or named like the target's unit (80)."""
    hits = http_matches(calls, endpoints)
    if "origin" in calls.columns:
        hits = hits.join(calls.select("call_id", "origin"), "call_id")
        host = http.origin_host(F.col("origin"))
        dynamic = F.col("origin").startswith("dynamic://")
        named = F.array_contains(http.host_aliases(F.col("target_unit")), host)
        limit = F.when(F.col("origin").isNull(), 100).when(dynamic, 70).when(http.is_local_host(host), 85).when(named, 80)
        hits = hits.withColumn("confidence", F.least("confidence", limit)).where(limit.isNotNull())
    return hits


def only_candidates(hits: DataFrame) -> DataFrame:
    """The candidates of calls that have exactly one."""
    only = Window.partitionBy("call_id")
    return hits.withColumn("candidates", F.count(F.lit(1)).over(only)).where("candidates = 1").drop("candidates")


def http_links(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """http_candidates of calls that have exactly one candidate endpoint."""
    return only_candidates(http_candidates(calls, endpoints))


def package_links(identities: DataFrame, declared: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """identities(unit, name), declared(unit, name), imports(unit, name): links between units by package names
    that one unit alone bears; 100 where the package is imported, else 90."""
    own = identities.select(F.col("unit").alias("target_unit"), "name").distinct()
    single = own.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("target_unit").alias("target_unit")).where("n = 1").select("name", "target_unit")
    links = declared.select(F.col("unit").alias("source_unit"), "name").distinct().join(single, "name").where("source_unit <> target_unit")
    if imports is None:
        return links.withColumn("confidence", F.lit(90))
    used = imports.select(F.col("unit").alias("source_unit"), "name").distinct().withColumn("used", F.lit(True))
    return links.join(used, ["source_unit", "name"], "left").withColumn("confidence", F.when(F.col("used"), 100).otherwise(90)).drop("used")


def ambiguous_names(identities: DataFrame) -> DataFrame:
    """name, owners: names that more than one unit bears."""
    return identities.select("unit", "name").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")


def prefixes(name: Column, dot: str) -> Column:
    """array<struct<prefix, len>> of all dotted prefixes of a name."""
    parts = F.split(name, f"[{dot}]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), dot).alias("prefix"), n.alias("len")))


def longest_prefix(refs: DataFrame, names: DataFrame, dot: str = ".") -> DataFrame:
    """ref, name: the longest dotted prefix of each ref that is a name borne once."""
    single = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("name")
    cut = refs.select("ref").distinct().select("ref", F.explode(prefixes(F.col("ref"), dot)).alias("p")).select("ref", F.col("p.prefix").alias("name"), "p.len")
    return cut.join(single, "name").groupBy("ref").agg(F.max_by("name", "len").alias("name"))


def suffix_resolution(refs: DataFrame, modules: DataFrame) -> DataFrame:
    """ref, module: the module whose key is the ref, else that is its index, else the first that ends in it."""
    keys = modules.select("key").distinct()
    parts = F.split("key", "/")
    ends = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("ref"))
    r = refs.select("ref").distinct()
    ranked = (
        r.join(keys.withColumn("ref", F.col("key")), "ref").select("ref", "key", F.lit(0).alias("way"))
        .unionByName(r.join(keys.withColumn("ref", F.regexp_replace("key", "/index$", "")).where("ref <> key"), "ref").select("ref", "key", F.lit(1).alias("way")))
        .unionByName(r.join(ends, "ref").select("ref", "key", F.lit(2).alias("way")))
    )
    return ranked.groupBy("ref").agg(F.min(F.struct("way", "key")).alias("m")).select("ref", F.col("m.key").alias("module"))


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """candidates(ref, path, ord) with files(path): the first candidate that exists."""
    return candidates.join(files.select("path").distinct(), "path").groupBy("ref").agg(F.min_by("path", "ord").alias("path"))


def cross_edges(http_edges: DataFrame, package_edges: DataFrame) -> DataFrame:
    """Both families, the first of each (source unit, source, target unit, target, kind)."""
    keys = ["source_unit", "source", "target_unit", "target", "kind"]
    both = http_edges.withColumn("__seq", F.lit(0)).unionByName(package_edges.withColumn("__seq", F.lit(1)))
    return keep_first(both, keys, [F.asc("__seq"), F.desc("confidence"), F.asc_nulls_first("evidence")]).drop("__seq")


def endpoint_links(cross: DataFrame, calls: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """cross(source_unit, source, target_unit, entrypoint, evidence, confidence) with the first of calls(unit, component,
    evidence, file, method) behind it and the entrypoint(unit, id, name, file) it reaches; edges without either are left out."""
    consumer = keep_first(calls, ["unit", "component", "evidence"], [F.asc("file"), F.asc("method")])
    consumer = consumer.select(F.col("unit").alias("source_unit"), F.col("component").alias("source"), "evidence", F.col("file").alias("consumer_file"), F.upper("method").alias("method"))
    provider = entrypoints.select(F.col("unit").alias("target_unit"), F.col("id").alias("entrypoint"), F.regexp_replace("name", "^[^ ]* ", "").alias("path"), F.col("file").alias("provider_file"))
    linked = cross.join(consumer, ["source_unit", "source", "evidence"]).join(provider, ["target_unit", "entrypoint"])
    return linked.select("source_unit", "source", "consumer_file", "method", "path", "target_unit", "entrypoint", "provider_file", "confidence")
