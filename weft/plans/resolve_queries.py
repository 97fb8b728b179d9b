"""Queries that resolve names, tables and links, on nations, suppliers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import link, merge, semantics
from ..session import table
from .registry import query


def _types(spark, d):
    """A type for each nation, in its region's namespace."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    cap = lambda c: F.concat(F.substring(c, 1, 1), F.lower(F.substring(c, 2, 100)))
    named = n.join(r, n.n_regionkey == r.r_regionkey)
    return named.select(
        F.lit("app").alias("unit"), "n_nationkey", "n_name", "r_name", F.concat("r_name", F.lit("/"), "n_name").alias("file"),
        F.concat(cap("r_name"), cap("n_name")).alias("model"), F.concat_ws("\\", "r_name", "n_name").alias("qualified"),
    )


_NAMED = "types AS (SELECT n_nationkey, n_name, r_name, r_name || '/' || n_name AS file, r_name || '\\' || n_name AS qualified FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(rf"""WITH {_NAMED},
refs AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN lower(qualified) WHEN 1 THEN '\' || n_name WHEN 2 THEN lower(n_name) ELSE 'X\' || n_name END AS ref FROM supplier JOIN types ON s_nationkey = n_nationkey),
hits AS (SELECT ref, file, CASE WHEN lower(trim(ref, '\')) = lower(qualified) THEN 0 ELSE 1 END AS p FROM refs JOIN types
  ON lower(trim(ref, '\')) IN (lower(qualified), lower(n_name)) OR ends_with(qualified, '\' || trim(ref, '\'))),
best AS (SELECT ref, file, row_number() OVER (PARTITION BY ref ORDER BY p, file) AS n FROM hits)
SELECT 'app' AS unit, ref, file FROM best WHERE n = 1""")
def controller_resolution(spark, d):
    types = _types(spark, d)
    s = table(spark, d, "supplier").join(types, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 4
    ref = F.when(k == 0, F.lower("qualified")).when(k == 1, F.concat(F.lit("\\"), "n_name")).when(k == 2, F.lower("n_name")).otherwise(F.concat(F.lit("X\\"), "n_name"))
    return semantics.resolve_controllers(s.select("unit", ref.alias("ref")), types.withColumnRenamed("n_name", "name"))


@query(r"""WITH types AS (SELECT n_nationkey, lower(r_name) || '_' || lower(n_name) AS snake, r_name || '/' || n_name AS file FROM nation JOIN region ON n_regionkey = r_regionkey),
named AS (SELECT *, CASE WHEN ends_with(snake, 's') THEN snake ELSE snake || 's' END AS tab FROM types),
refs AS (SELECT DISTINCT 'supplier/' || s_suppkey AS source, snake || 's' AS ref FROM supplier JOIN types ON s_nationkey = n_nationkey)
SELECT 'app' AS unit, source, file AS target, 'migration-foreign-key' AS kind, 80 AS confidence FROM refs JOIN named ON ref = tab""")
def migration_foreign_keys(spark, d):
    types = _types(spark, d)
    s = table(spark, d, "supplier").join(types, F.col("s_nationkey") == F.col("n_nationkey"))
    refs = s.select("unit", F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("file"), F.concat(F.lower("r_name"), F.lit("_"), F.lower("n_name"), F.lit("s")).alias("references"))
    return semantics.table_owners(refs, types.select("unit", F.col("model").alias("name"), "file"))


@query("""WITH m AS (SELECT l_orderkey, l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem WHERE l_quantity > 45)
SELECT o_orderkey AS source, o_custkey AS target, coalesce(l_returnflag, 'Resolved internal dependency') AS evidence, coalesce(l_quantity::INTEGER, 85) AS confidence
FROM orders LEFT JOIN m ON l_orderkey = o_orderkey AND n = 1""")
def edge_metadata_left_join(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target"))
    meta = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("source"), F.col("l_returnflag").alias("evidence"), F.col("l_quantity").cast("int").alias("confidence"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"))
    return merge.with_evidence(edges, meta, ["source"], "seq").select("source", "target", "evidence", "confidence")


@query("""WITH cross_edges AS (SELECT DISTINCT o_custkey AS source, o_orderpriority AS evidence, c_nationkey AS target_unit FROM orders JOIN customer ON o_custkey = c_custkey),
calls AS (SELECT o_custkey, o_orderpriority, o_orderkey, upper(o_orderstatus) AS method, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey, o_orderstatus) AS n FROM orders WHERE o_totalprice > 100000)
SELECT 'shop' AS source_unit, source, o_orderkey AS consumer_file, method, '/' || lower(n_name) AS path, target_unit, n_nationkey AS entrypoint, n_regionkey AS provider_file, 80 AS confidence
FROM cross_edges JOIN calls ON source = o_custkey AND evidence = o_orderpriority AND n = 1 JOIN nation ON target_unit = n_nationkey WHERE n_regionkey < 3""")
def focused_endpoint_links(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    shop = F.lit("shop")
    cross = o.join(c, o.o_custkey == c.c_custkey).select(shop.alias("source_unit"), F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("evidence"), F.col("c_nationkey").alias("target_unit"), F.col("c_nationkey").alias("entrypoint"), F.lit(80).alias("confidence")).distinct()
    calls = o.where("o_totalprice > 100000").select(shop.alias("unit"), F.col("o_custkey").alias("component"), F.col("o_orderpriority").alias("evidence"), F.col("o_orderkey").alias("file"), F.col("o_orderstatus").alias("method"))
    ends = n.where("n_regionkey < 3").select(F.col("n_nationkey").alias("unit"), F.col("n_nationkey").alias("id"), F.concat(F.lit("GET /"), F.lower("n_name")).alias("name"), F.col("n_regionkey").alias("file"))
    return link.endpoint_links(cross, calls, ends)
