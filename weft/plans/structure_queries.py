"""Structure of the given texts: matched brackets, elements of pages, scopes and what they pass on."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compose, merkle, php, structure
from ..session import cut, table
from .registry import query

_TEXTS = """texts AS (SELECT 'document' AS source, doc_id AS id, text FROM documents UNION ALL SELECT 'page' AS source, page_id AS id, html AS text FROM pages)"""


def _texts(spark, d):
    docs = table(spark, d, "documents").select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), "text")
    return docs.unionByName(table(spark, d, "pages").select(F.lit("page").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text")))


@query(rf"""
WITH {_TEXTS},
gaps AS (SELECT source, id, text, string_split_regex(text, '[()\[\]{{}}]') AS g FROM texts),
each AS (SELECT source, id, text, unnest(range(1, len(g))) AS i, unnest(g[1:len(g) - 1]) AS gap FROM gaps WHERE len(g) > 1),
place AS (SELECT source, id, text, sum(length(gap) + 1) OVER (PARTITION BY source, id ORDER BY i) - 1 AS pos FROM each),
mark AS (SELECT source, id, pos, substr(text, pos::INT + 1, 1) AS c FROM place),
step AS (SELECT source, id, pos, translate(c, ')]}}', '([{{') AS kind, CASE WHEN c IN ('(', '[', '{{') THEN 1 ELSE -1 END AS step FROM mark),
deep AS (SELECT *, sum(step) OVER (PARTITION BY source, id, kind ORDER BY pos) AS depth FROM step)
SELECT o.source, o.id, o.kind, o.depth::BIGINT AS depth, o.pos::BIGINT AS "start", min(c.pos)::BIGINT + 1 AS "end"
FROM deep o JOIN deep c ON o.source = c.source AND o.id = c.id AND o.kind = c.kind AND o.step = 1 AND c.step = -1 AND c.pos > o.pos AND c.depth = o.depth - 1
GROUP BY o.source, o.id, o.kind, o.depth, o.pos""")
def bracket_pairs(spark, d):
    """Every matched bracket of documents and pages."""
    return structure.bracket_pairs(_texts(spark, d), ["source", "id"], "text").select("source", "id", "kind", "depth", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_ELEMENTS = r"""
cuts AS (SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|</?[a-z][a-z0-9]*\b[^>]*>') AS t,
                string_split_regex(html, '(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|</?[a-z][a-z0-9]*\b[^>]*>') AS g FROM pages),
each AS (SELECT page_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS token, unnest(g[1:len(t)]) AS gap FROM cuts),
place AS (SELECT page_id, token, sum(length(gap) + length(token)) OVER (PARTITION BY page_id ORDER BY i) - length(token) AS pos, lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS kind FROM each),
tags AS (SELECT *, CASE WHEN token LIKE '</%' THEN -1 ELSE 1 END AS step FROM place WHERE token NOT LIKE '<!%' AND kind NOT IN ('script', 'style', 'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr') AND token NOT LIKE '%/>'),
deep AS (SELECT *, sum(step) OVER (PARTITION BY page_id, kind ORDER BY pos) AS depth FROM tags),
matched AS (
  SELECT o.page_id, o.kind, o.pos AS a, o.token AS tag, min(c.pos + length(c.token)) AS z FROM deep o
  JOIN deep c ON o.page_id = c.page_id AND o.kind = c.kind AND o.step = 1 AND c.step = -1 AND c.pos > o.pos AND c.depth = o.depth - 1 GROUP BY o.page_id, o.kind, o.pos, o.token),
el AS (SELECT * FROM matched UNION ALL SELECT page_id, kind, pos AS a, regexp_extract(token, '^[^>]*>') AS tag, pos + length(token) AS z FROM place WHERE kind IN ('script', 'style') AND token NOT LIKE '</%')"""


@query(rf"""
WITH {_ELEMENTS},
above AS (SELECT e.page_id, e.a, e.z, s.a AS sa, s.kind, s.tag FROM el e JOIN el s ON e.page_id = s.page_id AND s.a <= e.a AND s.z >= e.z AND (s.a < e.a OR s.z > e.z)),
sums AS (
  SELECT page_id, a, z, count(*) AS depth, string_agg('/' || kind, '' ORDER BY sa) AS path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds,
         arg_max(CASE WHEN tag LIKE '% lang="%' THEN regexp_extract(tag, ' lang="([^"]*)"', 1) END, CASE WHEN tag LIKE '% lang="%' THEN sa END) AS lang
  FROM above GROUP BY page_id, a, z)
SELECT el.page_id, el.kind, el.a::BIGINT AS "start", el.z::BIGINT AS "end", coalesce(depth, 0)::INTEGER AS depth, coalesce(path, '') AS path, coalesce(kinds, '') AS kinds_above, lang
FROM el LEFT JOIN sums ON el.page_id = sums.page_id AND el.a = sums.a AND el.z = sums.z""")
def page_scopes(spark, d):
    """Each element of each page with what the elements around it pass on: path, set of kinds, innermost language."""
    found = structure.elements(table(spark, d, "pages"), ["page_id"], "html")
    lang = F.nullif(F.regexp_extract("tag", r'\slang="([^"]*)"', 1), F.lit(""))
    scopes = cut(structure.nested(found, ["page_id"]).withColumn("part", F.concat(F.lit("/"), "kind")).withColumn("kinds", F.array("kind")).withColumn("lang", lang))
    inner = scopes.select("page_id", "kind", "start", "end", F.col("level").alias("depth"))
    out = structure.inherited(inner, scopes, ["page_id"], joined=["part"], united=["kinds"], innermost=["lang"])
    return out.select("page_id", "kind", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "depth", F.col("all_part").alias("path"), F.array_join("all_kinds", ",").alias("kinds_above"), F.col("all_lang").alias("lang"))


@query(r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, 'track\(([^()]*)\)', 1)) AS argument FROM pages)
SELECT page_id, argument, count(*) AS n FROM a GROUP BY page_id, argument""")
def call_arguments(spark, d):
    """Arguments of a function that the pages' scripts call, by balanced brackets outside string literals."""
    found = structure.calls(table(spark, d, "pages"), ["page_id"], "html", r"\btrack\(")
    return found.groupBy("page_id", "argument").agg(F.count(F.lit(1)).alias("n"))


#: The lexer's states as one pattern; pages hold no heredocs.
_LEX = r"""//[^\n]*|#[^\n]*|/\*[\s\S]*?(?:\*/|\z)|"(?:\\[\s\S]|[^"\\])*(?:"|\z)|''(?:\\[\s\S]|[^''\\])*(?:''|\z)|\$[A-Za-z_\x{80}-\x{10FFFF}][\w\x{80}-\x{10FFFF}]*|(?:\\|[A-Za-z_\x{80}-\x{10FFFF}])[\w\\\x{80}-\x{10FFFF}]*|[0-9][\w.]*|\?->|->|::|=>|\?\?|[^ \t\n\r\f\x0b]"""


@query(rf"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '{_LEX}')) AS v FROM pages)
SELECT page_id, CASE WHEN v LIKE '//%' OR v LIKE '#%' OR v LIKE '/*%' THEN 'comment' WHEN left(v, 1) = '"' OR left(v, 1) = chr(39) THEN 'string' WHEN length(v) > 1 AND left(v, 1) = '$' THEN 'variable'
  WHEN regexp_matches(v, '^[\\A-Za-z_\x{{80}}-\x{{10FFFF}}]') THEN 'name' WHEN regexp_matches(v, '^[0-9]') THEN 'number' ELSE 'symbol' END AS kind, count(*) AS n, sum(length(v))::BIGINT AS chars
FROM t GROUP BY 1, 2""")
def token_counts(spark, d):
    """Tokens of each page by kind, read as code."""
    found = php.tokens(table(spark, d, "pages"), ["page_id"], "html")
    return found.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("value")).alias("chars"))


_SHOWN = " || ',' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, 'N')" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))


@query(f"""
WITH r AS (SELECT sha256({_SHOWN}) AS h, o_custkey, o_orderkey FROM orders),
p AS (SELECT h, row_number() OVER (ORDER BY o_custkey NULLS FIRST, o_orderkey NULLS FIRST, h) - 1 AS i FROM r),
a AS (SELECT i // 1024 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM p GROUP BY 1),
b AS (SELECT i // 1024 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM a GROUP BY 1),
c AS (SELECT i // 1024 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM b GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM p) AS n_rows, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb)
SELECT CASE WHEN na = 1 THEN (SELECT min(h) FROM a) WHEN nb = 1 THEN (SELECT min(h) FROM b) ELSE (SELECT min(h) FROM c) END AS digest, n_rows FROM n""")
def ordered_fingerprint(spark, d):
    """One digest of all orders in the order of customer and key."""
    return merkle.merkle(table(spark, d, "orders"), ["o_custkey", "o_orderkey"], ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS parent, (s_suppkey * s_suppkey + s_nationkey) % (SELECT count(*) FROM supplier) AS child, s_nationkey::VARCHAR AS label FROM supplier),
p(node, labels, nodes) AS (
  SELECT s_suppkey, []::VARCHAR[], [s_suppkey] FROM supplier WHERE s_nationkey = 3
  UNION ALL SELECT e.child, list_append(labels, e.label), list_append(nodes, e.child) FROM p JOIN e ON p.node = e.parent WHERE NOT list_contains(nodes, e.child))
SELECT node, array_to_string(labels, '/') AS path, len(nodes) - 1 AS depth FROM p""")
def composed_paths(spark, d):
    """Labels along every path of a graph with cycles, from one nation's suppliers."""
    s = table(spark, d, "supplier")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    edges = s.join(F.broadcast(n)).select(F.col("s_suppkey").cast("long").alias("parent"), ((F.col("s_suppkey").cast("long") * F.col("s_suppkey") + F.col("s_nationkey")) % F.col("n")).alias("child"), F.col("s_nationkey").cast("string").alias("label"))
    roots = s.where("s_nationkey = 3").select(F.col("s_suppkey").cast("long").alias("node"))
    out = compose.compose(edges, roots)
    return out.select("node", F.array_join("labels", "/").alias("path"), (F.size("nodes") - 1).cast("long").alias("depth"))
