"""The engine: a registry of analyzers, and a scan as a bundle of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import capsule, export, extract, graph, link, merge, records, scoring, semantics, technology, text
from ..session import cut, together
from ..sources import files as src


@dataclass
class Registry:
    """Analyzers by id, in the order of registration; an id registered again is replaced in its place.

    An analyzer takes the masked files table and returns components (unit, id, name, kind, language, file, line_no)."""

    analyzers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    policy: tuple[int, int, int] = scoring.POLICY
    schema_version: int = 1

    def register(self, id: str, analyze: Callable[[DataFrame], DataFrame]) -> Registry:
        self.analyzers[id] = analyze
        return self

    def signature(self) -> str:
        return f"{self.schema_version}|{','.join(self.analyzers)}|{':'.join(map(str, self.policy))}"

    @classmethod
    def with_defaults(cls) -> Registry:
        return cls().register("declarations", extract.components)


@dataclass
class Scan:
    """Tables of a scan. Ends of dependencies, components of entrypoints and both sides of cross edges are ids of components."""

    files: DataFrame
    detections: DataFrame
    technologies: DataFrame
    components: DataFrame
    entrypoints: DataFrame
    dependencies: DataFrame
    http_calls: DataFrame
    diagnostics: DataFrame
    requirements: DataFrame
    units: DataFrame
    cross: DataFrame


def _stands_for(components: DataFrame) -> DataFrame:
    """unit, file, component: the component of each file that edges of files lead to, its module if it has one."""
    return components.groupBy("unit", "file").agg(F.min_by("id", F.struct("line_no", "id")).alias("component"))


def _component_edges(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Edges between files of a unit as edges between components."""
    a = owners.select("unit", F.col("file").alias("source"), F.col("component").alias("a"))
    b = owners.select("unit", F.col("file").alias("target"), F.col("component").alias("b"))
    return edges.join(a, ["unit", "source"]).join(b, ["unit", "target"]).select("unit", F.col("a").alias("source"), F.col("b").alias("target"), "kind").where("source <> target")


def scan(files: DataFrame, registry: Registry | None = None, units: DataFrame | None = None) -> Scan:
    """All tables of all repositories of a files table at once; files of units inside others belong to the inner ones."""
    registry = registry or Registry.with_defaults()
    units = src.discover_units(files) if units is None else units
    placed = cut(extract.masked(src.assign_units(files, units)))
    # these read the placed files alone
    routes = [lambda f=f: f(placed) for f in extract.ROUTE_SOURCES]
    imports = lambda: extract.import_edges(placed, extract.aliased(extract.imports(placed), extract.ts_aliases(placed)))
    detected = lambda: extract.detections(placed).withColumn("actionable", scoring.actionable(F.col("confidence"), F.col("evidence"), registry.policy))
    analyzed = [lambda a=a, seq=seq: a(placed).withColumn("seq", F.lit(seq)) for seq, a in enumerate(registry.analyzers.values())]
    first = [detected, *routes, imports, lambda: semantics.java_edges(placed), lambda: semantics.php_edges(placed), lambda: extract.http_calls(placed), lambda: semantics.package_edges(placed), *analyzed]
    found, *made = together(*first)
    routes, (imports, java, php, http, packages), analyzed = made[: len(routes)], made[len(routes) : len(routes) + 5], made[len(routes) + 5 :]
    parts = None
    for c in analyzed:
        parts = c if parts is None else parts.unionByName(c)
    comps = merge.overlay(parts, ["unit", "id"], "seq").drop("seq")
    fallback = merge.fallback_files(placed.where("is_text"), comps).where(~F.col("too_large"))
    rest = fallback.select("unit", F.concat(F.lit("file:"), F.col("rel_path")).alias("id"), "name", F.lit("file").alias("kind"), "language", F.col("rel_path").alias("file"), F.lit(0).alias("line_no"))
    comps = cut(semantics.classified(comps.unionByName(rest), placed, found))
    in_laravel = found.where("actionable AND name = 'Laravel'").select("unit")
    laravel = semantics.laravel_commands(placed).join(in_laravel, "unit", "left_semi")
    commands = laravel.select("unit", F.concat_ws(":", F.lit("laravel"), "kind", "file").alias("id"), "name", "kind", F.lit("Laravel").alias("framework"), "file", F.lit(80).alias("confidence"))
    owners = cut(_stands_for(comps))
    entries_of = extract.entrypoints(placed, found, routes).unionByName(commands)
    deps = imports.unionByName(java).unionByName(php)
    tables = semantics.laravel_tables(placed).join(in_laravel, "unit", "left_semi")
    deps_of = _component_edges(deps.unionByName(semantics.table_owners(tables, semantics.php_types(placed)).drop("confidence")), owners)
    # a declaration needs its module, and so what the module imports
    needs = comps.where("line_no > 0").join(owners, ["unit", "file"]).select("unit", F.col("id").alias("source"), F.col("component").alias("target"), F.lit("requires").alias("kind")).where("source <> target")
    entries, deps, calls = together(
        lambda: entries_of.join(owners, ["unit", "file"], "left"), lambda: deps_of.unionByName(needs).distinct(), lambda: http.join(owners, ["unit", "file"])
    )
    partial = Scan(
        placed, found, technology.technologies(placed, found), comps, entries, deps, calls, technology.diagnostics(placed, found, entries),
        technology.runtime_requirements(placed), technology.unit_summary(placed, found, comps, deps, entries), None,
    )
    return replace(partial, cross=cut(link.cross_edges(_http_cross(partial), _package_cross(placed, owners, packages))))


def _http_cross(s: Scan) -> DataFrame:
    """http_edges as cross edges between components."""
    calls = s.http_calls.select(F.col("unit").alias("call_unit"), F.col("file").alias("source_file"), F.col("component").alias("source")).distinct()
    ends = s.entrypoints.select(F.col("unit").alias("target_unit"), F.col("id").alias("endpoint_id"), F.col("component").alias("target"))
    ends = graph.keep_first(ends, ["target_unit", "endpoint_id"], [F.asc_nulls_last("target")])
    linked = http_edges(s).join(calls, ["call_unit", "source_file"]).join(ends, ["target_unit", "endpoint_id"])
    return linked.select(F.col("call_unit").alias("source_unit"), "source", "target_unit", "target", F.col("endpoint_id").alias("entrypoint"), F.lit("http").alias("kind"), F.col("call_path").alias("evidence"), "confidence")


def _package_cross(files: DataFrame, owners: DataFrame, links: DataFrame) -> DataFrame:
    """Package links between units as cross edges: from the first file that imports the package, else the manifest, to the target's manifest."""
    manifest = files.where(F.col("name").isin(*[r[0] for r in semantics.IDENTITIES])).select("unit", F.col("rel_path").alias("file")).join(owners, ["unit", "file"])
    manifest = manifest.groupBy("unit").agg(F.min_by("component", F.struct(F.length("file"), "file")).alias("component"))
    users = semantics.importing_files(files).join(owners, ["unit", "file"]).groupBy("unit", "name").agg(F.min_by("component", "file").alias("user"))
    out = links.join(users.withColumnRenamed("unit", "source_unit"), ["source_unit", "name"], "left")
    out = out.join(manifest.select(F.col("unit").alias("source_unit"), F.col("component").alias("own")), "source_unit", "left")
    out = out.join(manifest.select(F.col("unit").alias("target_unit"), F.col("component").alias("target")), "target_unit", "left")
    out = out.withColumn("source", F.coalesce("user", "own")).where("source IS NOT NULL")
    return out.select("source_unit", "source", "target_unit", "target", F.lit(None).cast("string").alias("entrypoint"), F.lit("package").alias("kind"), F.col("name").alias("evidence"), "confidence")


def scoped_graph(s: Scan) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, unit, component) and edges of all units, with ids that hold the unit; cross edges included."""
    vertices = s.components.select(graph.scoped(F.col("unit"), F.col("id")).alias("id"), "unit", F.col("id").alias("component"))
    local = s.dependencies.withColumn("evidence", F.lit(None).cast("string")).withColumn("confidence", F.lit(100))
    return vertices, cut(graph.scoped_edges(local, s.cross))


def slice_targets(s: Scan, targets: DataFrame, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (unit, node, depth) and edges that targets(unit, target) need, or with reverse what needs them, across units.

    A target is an entrypoint, a component with or without the prefix "component:", or "project-unit:" and a unit."""
    comps = s.components.select("unit", F.col("id").alias("component"))
    ends = s.entrypoints.select("unit", F.col("id").alias("entrypoint"), F.col("component").alias("entry_component"))
    starts = graph.resolve_targets(targets, comps, ends).where("component IS NOT NULL").select(graph.scoped(F.col("unit"), F.col("component")).alias("node"))
    nodes, edges = (graph.impact_slice if reverse else graph.workspace_slice)(scoped_graph(s)[1], starts)
    return nodes.select(F.expr("left(node, instr(node, chr(0)) - 1)").alias("unit"), F.expr("substring(node, instr(node, chr(0)) + 1)").alias("node"), "depth"), edges


def validate_scan(s: Scan) -> tuple[DataFrame, DataFrame]:
    """graph.integrity of the scoped graph (one row), and what is wrong with each cross edge."""
    vertices, edges = scoped_graph(s)
    comps = s.components.select("unit", F.col("id").alias("component"))
    ends = s.entrypoints.select("unit", F.col("id").alias("entrypoint"), F.col("component").alias("entry_component"))
    return graph.integrity(vertices, edges), graph.workspace_integrity(s.units, comps, ends, s.cross)


def capsule_of(s: Scan, targets: DataFrame) -> DataFrame:
    """unit, file: what a capsule of the targets copies, without files that may hold secrets."""
    nodes, _ = slice_targets(s, targets)
    wanted = capsule.capsule_files(nodes, s.components, s.files)
    code = F.coalesce("text", F.lit(""))
    secret = F.exists(F.split(code, "\n"), text.is_secret_line)
    safe = s.files.where(~text.is_sensitive(F.col("rel_path"), code, secret)).select("unit", F.col("rel_path").alias("file"))
    return wanted.join(safe, ["unit", "file"], "left_semi")


def http_edges(s: Scan) -> DataFrame:
    """Calls linked to endpoints of other units."""
    ids = F.sha2(F.concat_ws("\0", "unit", "file", "method", "path"), 256)
    calls = s.http_calls.withColumn("call_id", ids)
    ends = s.entrypoints.select(F.col("id").alias("endpoint_id"), "unit", F.split("name", " ")[0].alias("method"), F.split("name", " ")[1].alias("path")).where("method <> 'ROUTE'")
    return link.http_links(calls, ends).join(calls.select("call_id", F.col("file").alias("source_file")), "call_id")


def audit(s: Scan) -> DataFrame:
    """repository, components, dependencies, errors, warnings, graph_ok, clean, status, recorded_at (epoch milliseconds): a record of each scanned repository."""
    units = s.files.select("unit", "repository").distinct()
    rows = records.audit_rollup(records.unit_audits(units, s.components, s.dependencies, s.diagnostics))
    return rows.withColumn("status", scoring.audit_status(F.col("graph_ok"), F.col("clean"), F.col("errors"), F.col("warnings"))).withColumn("recorded_at", F.unix_millis(F.current_timestamp()))


def summary(s: Scan) -> DataFrame:
    """One row: how many repositories, units, components, dependencies, entrypoints, calls and cross edges a scan found."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = s.files.agg(F.count_distinct("repository").alias("repositories"))
    for name in ("units", "components", "dependencies", "entrypoints", "http_calls", "cross"):
        out = out.crossJoin(one(getattr(s, name), name))  # one row each
    return out


class Engine:
    """The operations a user calls, each on whole tables."""

    def __init__(self, registry: Registry | None = None):
        self.registry = registry or Registry.with_defaults()

    def scan(self, files: DataFrame) -> Scan:
        return scan(files, self.registry)

    scoped_graph = staticmethod(scoped_graph)
    slice_targets = staticmethod(slice_targets)
    validate_scan = staticmethod(validate_scan)
    audit = staticmethod(audit)
    summary = staticmethod(summary)
    capsule_of = staticmethod(capsule_of)
    slice = staticmethod(graph.dependency_slice)
    impact = staticmethod(graph.impact_slice)
    workspace_slice = staticmethod(graph.workspace_slice)
    workspace_impact = staticmethod(graph.impact_slice)
    validate = staticmethod(graph.integrity)
    validate_workspace = staticmethod(graph.workspace_integrity)
    cycles = staticmethod(graph.cycles)
    link_http = staticmethod(link.http_links)
    link_packages = staticmethod(link.package_links)
    link_endpoints = staticmethod(link.endpoint_links)
    resolve_controllers = staticmethod(semantics.resolve_controllers)
    export_mermaid = staticmethod(export.mermaid_lines)
    export_json = staticmethod(export.json_lines)
    endpoint_rows = staticmethod(records.endpoint_rows)
    page = staticmethod(records.page)
    export_graphml = staticmethod(export.graphml_edges)
    capsule_files = staticmethod(capsule.capsule_files)
    verify = staticmethod(capsule.verification_checks)
    sandbox_plan = staticmethod(capsule.sandbox_plan)
