"""Graph operators over vertices(id, ...) and edges(source, target, ...).

Reachability runs frontier by frontier over an edge table of two columns that is
written once. What a round reads of it is the whole table, but only a frontier whose
counted size is over `BROADCAST_ROWS` shuffles it; smaller ones, which most are, are
broadcast and joined where the edges lie. What was seen is removed by an anti join,
and each frontier is written to the shared folder, so the plan stays short and
survives lost executors. Rounds equal the graph's depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import cut, cut_counted


#: Rows (an id and a number) up to which a counted table is broadcast.
BROADCAST_ROWS = 100_000


def sent(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _reached(links: DataFrame, starts: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, int]:
    """node, depth from links(node, next), a table; and how many there are."""
    frontier, found = cut_counted(starts.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    seen, total, depth = [frontier], found, 0
    while found and (max_depth is None or depth < max_depth):
        depth += 1
        fresh = links.join(sent(frontier.select("node"), found), "node").select(F.col("next").alias("node")).distinct()
        visited = sent(reduce(DataFrame.unionByName, seen).select("node"), total)
        frontier, found = cut_counted(fresh.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if found:
            seen.append(frontier)
            total += found
    return reduce(DataFrame.unionByName, seen), total


def _links(edges: DataFrame, reverse: bool) -> DataFrame:
    ends = ("target", "source") if reverse else ("source", "target")
    return edges.select(F.col(ends[0]).alias("node"), F.col(ends[1]).alias("next")).where("node IS NOT NULL AND next IS NOT NULL")


def closure(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """node, depth: all that is reachable from starts(node), themselves included, known or not; safe with cycles."""
    return _reached(cut(_links(edges, reverse)), starts, max_depth)[0]


def dependency_slice(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forward closure, and the edges with both ends inside, repeats kept."""
    edges = cut(edges)
    nodes, n = _reached(_links(edges, False), starts)
    inside = sent(nodes.select("node"), n)
    kept = edges.join(inside.withColumnRenamed("node", "source"), "source", "left_semi").join(inside.withColumnRenamed("node", "target"), "target", "left_semi")
    return nodes, kept.select(*edges.columns)


def impact_slice(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reverse closure, and all edges into a reached node, distinct."""
    edges = cut(edges)
    nodes, n = _reached(_links(edges, True), starts)
    return nodes, edges.join(sent(nodes.select(F.col("node").alias("target")), n), "target", "left_semi").select(*edges.columns).distinct()


def scoped(unit: Column, component: Column) -> Column:
    return F.concat_ws("\0", unit, component)


def scoped_edges(local: DataFrame, cross: DataFrame) -> DataFrame:
    """Local edges (unit, source, target, kind, evidence, confidence) and cross edges
    (source_unit, source, target_unit, target, kind, evidence, confidence) as one edge table."""
    inner = local.select(scoped(F.col("unit"), F.col("source")).alias("source"), scoped(F.col("unit"), F.col("target")).alias("target"), "kind", "evidence", "confidence")
    outer = cross.where("target IS NOT NULL").select(
        scoped(F.col("source_unit"), F.col("source")).alias("source"), scoped(F.col("target_unit"), F.col("target")).alias("target"), "kind", "evidence", "confidence"
    )
    return inner.unionByName(outer)


def workspace_slice(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Closure over scoped edges, and the edges whose source is reached, the most confident of each (source, target, kind)."""
    edges = cut(edges)
    nodes, n = _reached(_links(edges, False), starts)
    kept = edges.join(sent(nodes.select(F.col("node").alias("source")), n), "source", "left_semi")
    return nodes, keep_first(kept, ["source", "target", "kind"], [F.desc_nulls_last("confidence"), F.asc_nulls_first("evidence")])


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; the rank limit is applied before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def missing_ends(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """side, node: edge ends that are no vertex, distinct."""
    ids = vertices.select(F.col("id").alias("node")).distinct()
    sides = edges.select(F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("source").alias("node")), F.struct(F.lit("target").alias("side"), F.col("target").alias("node")))).alias("x"))
    return sides.select("x.side", "x.node").distinct().join(ids, "node", "left_anti").select("side", "node")


def self_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("source") == F.col("target")).select(F.col("source").alias("node")).distinct()


def strongly_connected(edges: DataFrame) -> DataFrame:
    """node, scc for nodes on cycles of two nodes or more (scc: its largest node).

    Colouring: the largest node that reaches each node is spread along the edges;
    inside a colour, what reaches the colour's own node is its component. Components
    are taken out and the rest is coloured again."""
    rest = cut(edges.select("source", "target").where("source <> target").distinct())
    out = []
    while True:
        rest, left = _trimmed(rest)
        if not left:
            break
        nodes = rest.select(F.explode(F.array("source", "target")).alias("node")).distinct()
        colour = cut(nodes.withColumn("colour", F.col("node")))
        while True:
            pushed = rest.join(colour.withColumnRenamed("node", "source"), "source").select(F.col("target").alias("node"), "colour")
            grown = colour.withColumn("old", F.col("colour")).unionByName(pushed.withColumn("old", F.lit(None).cast("string")))
            grown = grown.groupBy("node").agg(F.max("colour").alias("colour"), F.max("old").alias("old"))
            steps = Observation()
            colour = cut(grown.observe(steps, F.count_if(F.col("colour") != F.col("old")).alias("n"))).select("node", "colour")
            if not steps.get["n"]:
                break
        a, b = colour.toDF("source", "cs"), colour.toDF("target", "ct")
        inside = rest.join(a, "source").join(b, "target").where("cs = ct").select("source", "target")
        roots = colour.where("node = colour").select("node")
        back = closure(inside, roots, reverse=True).select("node")
        found = cut(back.join(colour, "node").select("node", F.col("colour").alias("scc")))
        out.append(found)
        rest = cut(rest.join(found.select(F.col("node").alias("source")), "source", "left_anti").join(found.select(F.col("node").alias("target")), "target", "left_anti"))
    if not out:
        return edges.select(F.col("source").alias("node"), F.col("source").alias("scc")).limit(0)
    every = reduce(DataFrame.unionByName, out)
    big = every.groupBy("scc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("scc")
    return every.join(big, "scc", "left_semi").select("node", "scc")


def _trimmed(edges: DataFrame, rounds: int = 3) -> tuple[DataFrame, int]:
    """Edges (and how many) whose source has an edge in and whose target has an edge out; the others lie on no cycle.

    Goes on as long as a pass of `rounds` takes away a tenth of the edges at least, which long chains need."""
    before = None
    while True:
        for _ in range(rounds):
            edges = edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(
                edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi"
            )
        edges, left = cut_counted(edges.select("source", "target"))
        if not left or (before is not None and left > 0.9 * before):
            return edges, left
        before = left


def cycles(edges: DataFrame, length: int) -> DataFrame:
    """n1..n<length>: elementary cycles of that length, each once, from its smallest node on."""
    e = edges.select("source", "target").where("source <> target").distinct()
    path = e.where("target > source").toDF("n1", "n2")
    for i in range(3, length + 1):
        step = e.toDF(f"n{i - 1}", f"n{i}")
        path = path.join(step, f"n{i - 1}").where(F.col(f"n{i}") > F.col("n1"))
        path = path.where(reduce(lambda a, b: a & b, [F.col(f"n{i}") != F.col(f"n{j}") for j in range(2, i)], F.lit(True)))
    close = e.toDF(f"n{length}", "n1")
    return path.join(close, ["n1", f"n{length}"], "left_semi").select(*[f"n{i}" for i in range(1, length + 1)])


def integrity(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: missing_sources, missing_targets, self_dependencies, in_cycles, passed, is_clean."""
    ends = missing_ends(vertices, edges).groupBy().agg(F.count_if(F.col("side") == "source").alias("missing_sources"), F.count_if(F.col("side") == "target").alias("missing_targets"))
    selves = self_edges(edges).agg(F.count(F.lit(1)).alias("self_dependencies"))
    looped = strongly_connected(edges).agg(F.count(F.lit(1)).alias("in_cycles"))
    row = ends.crossJoin(selves).crossJoin(looped)  # one row each
    passed = (F.col("missing_sources") + F.col("missing_targets")) == 0
    return row.withColumn("passed", passed).withColumn("is_clean", passed & (F.col("self_dependencies") == 0) & (F.col("in_cycles") == 0))


def workspace_integrity(units: DataFrame, components: DataFrame, entrypoints: DataFrame, cross: DataFrame) -> DataFrame:
    """category, value: what is wrong with each cross edge. A missing unit hides later checks of its side."""
    u = units.select("unit").distinct()
    c = components.select("unit", "component").distinct()
    p = entrypoints.select("unit", "entrypoint", "entry_component")
    x = cross.join(u.select(F.col("unit").alias("source_unit"), F.lit(True).alias("su")), "source_unit", "left")
    x = x.join(u.select(F.col("unit").alias("target_unit"), F.lit(True).alias("tu")), "target_unit", "left")
    x = x.join(c.select(F.col("unit").alias("source_unit"), F.col("component").alias("source"), F.lit(True).alias("sc")), ["source_unit", "source"], "left")
    x = x.join(c.select(F.col("unit").alias("target_unit"), F.col("component").alias("target"), F.lit(True).alias("tc")), ["target_unit", "target"], "left")
    x = x.join(p.select(F.col("unit").alias("target_unit"), "entrypoint", F.lit(True).alias("te"), "entry_component"), ["target_unit", "entrypoint"], "left")
    has, no = lambda n: F.col(n).isNotNull(), lambda n: F.col(n).isNull()
    checks = [
        (no("su"), "missing-source-unit", F.col("source_unit")),
        (has("su") & no("sc"), "missing-source-component", F.col("source")),
        (no("tu"), "missing-target-unit", F.col("target_unit")),
        (has("tu") & has("entrypoint") & no("te"), "missing-target-entrypoint", F.col("entrypoint")),
        (has("tu") & has("target") & no("tc") & (no("entrypoint") | has("te")), "missing-target-component", F.col("target")),
        (has("te") & has("target") & (F.col("entry_component") != F.col("target")), "entrypoint-component-mismatch", F.col("entrypoint")),
    ]
    found = F.array(*[F.when(ok, F.struct(F.lit(name).alias("category"), value.alias("value"))) for ok, name, value in checks])
    return x.select(F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select("f.category", "f.value").distinct()


def resolve_targets(targets: DataFrame, components: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """targets with component: an entrypoint's component, else the component with or without the prefix "component:".

    targets(target), components(component), entrypoints(entrypoint, entry_component); where all three bear a unit, names are
    looked up in their unit, and "project-unit:" with a unit gives all of its components. Of repeated names the smallest counts."""
    by = ["unit"] if all("unit" in t.columns for t in (targets, components, entrypoints)) else []
    e = entrypoints.groupBy(*by, F.col("entrypoint").alias("target")).agg(F.min("entry_component").alias("by_entry"))
    c = components.select(*by, F.col("component").alias("bare"), F.col("component").alias("by_id")).distinct()
    t = targets.withColumn("bare", F.regexp_replace("target", "^component:", ""))
    one = t.join(e, [*by, "target"], "left").join(c, [*by, "bare"], "left").select(*by, "target", F.coalesce("by_entry", "by_id").alias("component"))
    if not by:
        return one
    whole = F.col("target").startswith("project-unit:")
    asked = targets.where(whole).select(F.regexp_replace("target", "^project-unit:", "").alias("unit"), "target")
    return one.where(~whole).unionByName(asked.join(components.select("unit", "component").distinct(), "unit").select("unit", "target", "component"))
