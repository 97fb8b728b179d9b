"""Graph queries on a trade graph (nations, customers, orders, parts, suppliers) and on an event graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import export, graph
from ..session import table
from .registry import query


def _id(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """source, target, kind."""
    t = lambda n: table(spark, d, n)
    pair = lambda df, a, b, kind: df.select(_id(*a).alias("source"), _id(*b).alias("target"), F.lit(kind).alias("kind"))
    li = t("lineitem")
    out = pair(t("nation"), ("nation", "n_nationkey"), ("region", "n_regionkey"), "belongs")
    for e in (
        pair(t("customer"), ("customer", "c_custkey"), ("nation", "c_nationkey"), "located"),
        pair(t("supplier"), ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "located"),
        pair(t("orders"), ("order", "o_orderkey"), ("customer", "o_custkey"), "placed"),
        pair(li.select("l_orderkey", "l_partkey").distinct(), ("order", "l_orderkey"), ("part", "l_partkey"), "contains"),
        pair(li.select("l_partkey", "l_suppkey").distinct(), ("part", "l_partkey"), ("supplier", "l_suppkey"), "supplied"),
    ):
        out = out.unionByName(e)
    return out


def trade_vertices(spark: SparkSession, d: str) -> DataFrame:
    """id, kind; only parts under size 40, so that edges with missing ends exist."""
    t = lambda n: table(spark, d, n)
    names = [("region", "r_regionkey", t("region")), ("nation", "n_nationkey", t("nation")), ("customer", "c_custkey", t("customer")),
             ("supplier", "s_suppkey", t("supplier")), ("part", "p_partkey", t("part").where("p_size < 40")), ("order", "o_orderkey", t("orders"))]
    out = None
    for kind, key, df in names:
        v = df.select(_id(kind, key).alias("id"), F.lit(kind).alias("kind"))
        out = v if out is None else out.unionByName(v)
    return out


EDGES = """edges AS (
  SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'belongs' AS kind FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located' FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed' FROM orders
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains' FROM lineitem
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied' FROM lineitem)"""
VERTICES = """vertices AS (
  SELECT 'region:' || r_regionkey AS id FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey FROM part WHERE p_size < 40 UNION ALL SELECT 'order:' || o_orderkey FROM orders)"""


def _reach(starts: str, back: bool = False) -> str:
    a, b = ("target", "source") if back else ("source", "target")
    return f"reach(node) AS (SELECT * FROM (VALUES {starts}) s(node) UNION SELECT e.{b} FROM reach r JOIN edges e ON e.{a} = r.node)"


def _starts(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "node string")


@query(f"WITH RECURSIVE {EDGES}, walk(node, depth) AS (SELECT 'order:1', 0 UNION SELECT e.target, w.depth + 1 FROM walk w JOIN edges e ON e.source = w.node) SELECT node, min(depth)::INTEGER AS depth FROM walk GROUP BY node")
def dependency_closure(spark, d):
    return graph.closure(trade_edges(spark, d), _starts(spark, "order:1"))


@query(f"WITH RECURSIVE {EDGES}, {_reach("('order:1')")} SELECT node FROM reach")
def dependency_slice_nodes(spark, d):
    return graph.dependency_slice(trade_edges(spark, d), _starts(spark, "order:1"))[0].select("node")


@query(f"WITH RECURSIVE {EDGES}, {_reach("('order:1')")} SELECT source, target, kind FROM edges WHERE source IN (SELECT node FROM reach) AND target IN (SELECT node FROM reach)")
def dependency_slice_edges(spark, d):
    return graph.dependency_slice(trade_edges(spark, d), _starts(spark, "order:1"))[1]


@query(f"WITH RECURSIVE {EDGES}, {_reach("('supplier:3')", True)} SELECT node FROM reach")
def impact_slice_nodes(spark, d):
    return graph.impact_slice(trade_edges(spark, d), _starts(spark, "supplier:3"))[0].select("node")


@query(f"WITH RECURSIVE {EDGES}, {_reach("('supplier:3')", True)} SELECT DISTINCT source, target, kind FROM edges WHERE target IN (SELECT node FROM reach)")
def impact_slice_edges(spark, d):
    return graph.impact_slice(trade_edges(spark, d), _starts(spark, "supplier:3"))[1]


@query(f"WITH RECURSIVE {EDGES}, {_reach("('order:1'), ('order:2'), ('customer:7'), ('nowhere:1')")} SELECT node FROM reach")
def multi_source_slice(spark, d):
    return graph.closure(trade_edges(spark, d), _starts(spark, "order:1", "order:2", "customer:7", "nowhere:1")).select("node")


@query(f"WITH RECURSIVE {EDGES}, walk(node, depth) AS (SELECT 'nation:5', 0 UNION SELECT e.source, w.depth + 1 FROM walk w JOIN edges e ON e.target = w.node), m AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node) SELECT depth::INTEGER AS depth, count(*) AS nodes FROM m GROUP BY depth")
def closure_depth_histogram(spark, d):
    return graph.closure(trade_edges(spark, d), _starts(spark, "nation:5"), reverse=True).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


UNITS = {"region": "geo", "nation": "geo", "customer": "sales", "order": "sales", "part": "supply", "supplier": "supply"}
_UNIT_SQL = "CASE split_part({0}, ':', 1) WHEN 'region' THEN 'geo' WHEN 'nation' THEN 'geo' WHEN 'customer' THEN 'sales' WHEN 'order' THEN 'sales' ELSE 'supply' END"


def _unit(c: str):
    kind = F.substring_index(c, ":", 1)
    return F.when(kind.isin("region", "nation"), "geo").when(kind.isin("customer", "order"), "sales").otherwise("supply")


def scoped_trade(spark, d) -> DataFrame:
    """Edges inside a unit are local; those across units carry evidence and a confidence."""
    e = trade_edges(spark, d).withColumn("su", _unit("source")).withColumn("tu", _unit("target")).withColumn("evidence", F.concat_ws(" to ", "source", "target"))
    local = e.where("su = tu").select(F.col("su").alias("unit"), "source", "target", "kind", "evidence", F.lit(85).alias("confidence"))
    cross = e.where("su <> tu").select(F.col("su").alias("source_unit"), "source", F.col("tu").alias("target_unit"), "target", "kind", "evidence", F.when(F.col("kind") == "located", 100).otherwise(90).alias("confidence"))
    return graph.scoped_edges(local, cross)


_SCOPED = f"""{EDGES.replace('edges AS', 'plain AS')}, edges AS (
  SELECT {_UNIT_SQL.format('source')} || chr(0) || source AS source, {_UNIT_SQL.format('target')} || chr(0) || target AS target, kind, source || ' to ' || target AS evidence,
         (CASE WHEN {_UNIT_SQL.format('source')} = {_UNIT_SQL.format('target')} THEN 85 WHEN kind = 'located' THEN 100 ELSE 90 END)::INTEGER AS confidence FROM plain)"""
_SHOWN = "replace(source, chr(0), '/') AS source, replace(target, chr(0), '/') AS target, kind, evidence, confidence"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.translate("source", "\0", "/").alias("source"), F.translate("target", "\0", "/").alias("target"), "kind", "evidence", "confidence")


@query(f"WITH RECURSIVE {_SCOPED}, {_reach("('sales' || chr(0) || 'order:1'), ('sales' || chr(0) || 'order:9')")} SELECT DISTINCT {_SHOWN} FROM edges WHERE source IN (SELECT node FROM reach)")
def workspace_slice(spark, d):
    return _shown(graph.workspace_slice(scoped_trade(spark, d), _starts(spark, "sales\0order:1", "sales\0order:9"))[1])


@query(f"WITH RECURSIVE {_SCOPED}, {_reach("('supply' || chr(0) || 'supplier:3')", True)} SELECT DISTINCT {_SHOWN} FROM edges WHERE target IN (SELECT node FROM reach)")
def workspace_impact(spark, d):
    return _shown(graph.impact_slice(scoped_trade(spark, d), _starts(spark, "supply\0supplier:3"))[1])


def _missing(side: str) -> str:
    return f"WITH {EDGES}, {VERTICES} SELECT DISTINCT {side} AS node FROM edges WHERE NOT EXISTS (SELECT 1 FROM vertices v WHERE v.id = edges.{side})"


@query(_missing("source"))
def integrity_missing_sources(spark, d):
    return graph.missing_ends(trade_vertices(spark, d), trade_edges(spark, d)).where("side = 'source'").select("node")


@query(_missing("target"))
def integrity_missing_targets(spark, d):
    return graph.missing_ends(trade_vertices(spark, d), trade_edges(spark, d)).where("side = 'target'").select("node")


@query(f"""WITH {EDGES}, {VERTICES} SELECT
  (SELECT count(DISTINCT source) FROM edges WHERE source NOT IN (SELECT id FROM vertices)) AS missing_sources,
  (SELECT count(DISTINCT target) FROM edges WHERE target NOT IN (SELECT id FROM vertices)) AS missing_targets,
  0::BIGINT AS self_dependencies, 0::BIGINT AS in_cycles, false AS passed, false AS is_clean""")
def integrity_summary(spark, d):
    return graph.integrity(trade_vertices(spark, d), trade_edges(spark, d))


def event_edges(spark, d) -> DataFrame:
    """event type to the user's next event type, one row for each step."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_type", F.lead("event_type").over(w).alias("next"))
    return e.where("next IS NOT NULL").select(F.col("event_type").alias("source"), F.col("next").alias("target"))


STEPS = "steps AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events), edges AS (SELECT DISTINCT source, target FROM steps WHERE target IS NOT NULL)"


@query(f"WITH {STEPS} SELECT source AS node FROM edges WHERE source = target")
def self_dependencies(spark, d):
    return graph.self_edges(event_edges(spark, d))


@query(f"WITH {STEPS} SELECT source, target, count(*) AS steps FROM steps WHERE target IS NOT NULL GROUP BY source, target")
def edge_multiplicity(spark, d):
    return event_edges(spark, d).groupBy("source", "target").agg(F.count(F.lit(1)).alias("steps"))


@query(f"""WITH RECURSIVE {STEPS}, r(a, b) AS (SELECT source, target FROM edges WHERE source <> target UNION SELECT r.a, e.target FROM r JOIN edges e ON e.source = r.b)
SELECT x.a AS node, max(x.b) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def cycle_scc_members(spark, d):
    return graph.strongly_connected(event_edges(spark, d))


@query(f"WITH {STEPS} SELECT x.source AS n1, x.target AS n2 FROM edges x JOIN edges y ON x.target = y.source AND y.target = x.source WHERE x.source < x.target")
def cycles_len2(spark, d):
    return graph.cycles(event_edges(spark, d), 2)


@query(f"""WITH {STEPS} SELECT x.source AS n1, y.source AS n2, z.source AS n3 FROM edges x JOIN edges y ON x.target = y.source JOIN edges z ON y.target = z.source AND z.target = x.source
WHERE x.source < y.source AND x.source < z.source AND y.source <> z.source""")
def cycles_len3(spark, d):
    return graph.cycles(event_edges(spark, d), 3)


@query("""WITH units AS (SELECT * FROM (VALUES ('nation'), ('customer'), ('order')) u(unit)),
x AS (SELECT 'order' AS su, 'o' || o_orderkey AS s, CASE WHEN o_orderkey % 10 = 0 THEN 'depot' ELSE 'customer' END AS tu, 'c' || o_custkey AS t, CASE WHEN o_orderkey % 3 = 0 THEN 'e' || o_custkey END AS ep FROM orders),
c AS (SELECT c_custkey, 'c' || c_custkey AS component FROM customer WHERE c_custkey % 7 <> 0),
e AS (SELECT 'e' || c_custkey AS entrypoint, 'c' || (c_custkey - c_custkey % 2) AS entry_component FROM customer WHERE c_custkey % 5 <> 0),
j AS (SELECT x.*, tu = 'customer' AS has_tu, c.component, e.entrypoint, e.entry_component FROM x LEFT JOIN c ON x.tu = 'customer' AND x.t = c.component LEFT JOIN e ON x.tu = 'customer' AND x.ep = e.entrypoint)
SELECT DISTINCT 'missing-target-unit' AS category, tu AS value FROM j WHERE NOT has_tu
UNION ALL SELECT DISTINCT 'missing-target-entrypoint', ep FROM j WHERE has_tu AND ep IS NOT NULL AND entrypoint IS NULL
UNION ALL SELECT DISTINCT 'missing-target-component', t FROM j WHERE has_tu AND component IS NULL AND (ep IS NULL OR entrypoint IS NOT NULL)
UNION ALL SELECT DISTINCT 'entrypoint-component-mismatch', ep FROM j WHERE entrypoint IS NOT NULL AND entry_component <> t""")
def workspace_integrity(spark, d):
    orders, cust = table(spark, d, "orders"), table(spark, d, "customer")
    units = spark.createDataFrame([("nation",), ("customer",), ("order",)], "unit string")
    comps = cust.where("c_custkey % 7 <> 0").selectExpr("'customer' AS unit", "concat('c', c_custkey) AS component").unionByName(orders.selectExpr("'order' AS unit", "concat('o', o_orderkey) AS component"))
    entries = cust.where("c_custkey % 5 <> 0").selectExpr("'customer' AS unit", "concat('e', c_custkey) AS entrypoint", "concat('c', c_custkey - c_custkey % 2) AS entry_component")
    cross = orders.selectExpr(
        "'order' AS source_unit", "concat('o', o_orderkey) AS source", "CASE WHEN o_orderkey % 10 = 0 THEN 'depot' ELSE 'customer' END AS target_unit",
        "concat('c', o_custkey) AS target", "CASE WHEN o_orderkey % 3 = 0 THEN concat('e', o_custkey) END AS entrypoint",
    )
    return graph.workspace_integrity(units, comps, entries, cross)


@query("""SELECT source, target, confidence, evidence FROM (SELECT 'customer:' || o_custkey AS source, o_orderpriority AS target, (o_orderkey % 31 + 60)::INTEGER AS confidence, 'order:' || o_orderkey AS evidence,
 row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey % 31 DESC, 'order:' || o_orderkey) AS n FROM orders) WHERE n = 1""")
def cross_edge_keep_first(spark, d):
    e = table(spark, d, "orders").selectExpr("concat('customer:', o_custkey) AS source", "o_orderpriority AS target", "CAST(o_orderkey % 31 + 60 AS INT) AS confidence", "concat('order:', o_orderkey) AS evidence")
    return graph.keep_first(e, ["source", "target"], [F.desc("confidence"), F.asc("evidence")])


@query("""SELECT t.target, coalesce(e.c, v.id) AS component FROM
 (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'component:part:' || p_partkey WHEN p_partkey % 3 = 1 THEN 'entry:' || p_partkey ELSE 'part:' || p_partkey END AS target FROM part) t
 LEFT JOIN (SELECT 'entry:' || p_partkey AS ep, 'part:' || (p_partkey + 1) AS c FROM part WHERE p_partkey % 2 = 0) e ON t.target = e.ep
 LEFT JOIN (SELECT 'part:' || p_partkey AS id FROM part WHERE p_size < 40) v ON regexp_replace(t.target, '^component:', '') = v.id""")
def resolve_target(spark, d):
    part = table(spark, d, "part")
    targets = part.selectExpr("CASE WHEN p_partkey % 3 = 0 THEN concat('component:part:', p_partkey) WHEN p_partkey % 3 = 1 THEN concat('entry:', p_partkey) ELSE concat('part:', p_partkey) END AS target")
    comps = part.where("p_size < 40").selectExpr("concat('part:', p_partkey) AS component")
    entries = part.where("p_partkey % 2 = 0").selectExpr("concat('entry:', p_partkey) AS entrypoint", "concat('part:', p_partkey + 1) AS entry_component")
    return graph.resolve_targets(targets, comps, entries)


def _nation_edges(spark, d) -> DataFrame:
    return table(spark, d, "nation").selectExpr("n_name AS source", "concat('R&', n_regionkey) AS target", "'located' AS kind", "CAST(80 + n_nationkey % 20 AS INT) AS confidence")


@query("""SELECT 0 AS section, '' AS key, 'flowchart LR' AS line
UNION ALL SELECT 1, n_name, '  n_' || regexp_replace(n_name, '[^\\p{L}\\p{N}]', '_', 'g') || '["' || replace(n_name, '"', '''') || '"]' FROM nation
UNION ALL SELECT 2, n_name || chr(9) || 'R&' || n_regionkey || chr(9) || 'located', '  n_' || regexp_replace(n_name, '[^\\p{L}\\p{N}]', '_', 'g') || ' -->|located ' || (80 + n_nationkey % 20) || '%| n_R_' || n_regionkey FROM nation""")
def mermaid_edges(spark, d):
    return export.mermaid_lines(table(spark, d, "nation").selectExpr("n_name AS id", "n_name AS label"), _nation_edges(spark, d))


@query("""SELECT '<edge id="e' || (row_number() OVER (ORDER BY n_name, 'R&' || n_regionkey) - 1) || '" source="' || n_name || '" target="R&amp;' || n_regionkey || '" label="located"/>' AS line FROM nation""")
def graphml_edges(spark, d):
    return export.graphml_edges(_nation_edges(spark, d).select("source", "target", "kind"))
