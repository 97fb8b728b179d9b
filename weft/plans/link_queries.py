"""Linking and path queries on pages, parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, http
from ..operators import extract, link
from ..session import table
from .registry import query

_PATH = r"CASE WHEN length(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')) = 0 THEN '/' ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') END"
_DYN = r"'^(\{.*\}|\$\{.*\}|:.+|<.*>|\[.*\]|\*+)$'"
_ALL = r"'^(\*+|\{\*.*\}|\{.*\*\}|\{\.\.\..*\}|\[\.\.\..*\]|:.+\*)$'"
_SEGS = "list_filter(string_split({0}, '/'), lambda s: s <> '')"
_HOST = r"lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', ''))"

#: id, unit, method, path of the endpoints that pages are linked to.
ENDPOINTS = [
    (1, "english", "GET", "/en/{id}"), (2, "any-ten", "ANY", "/{lang}/10"), (3, "french", "GET", "/fr/*"), (4, "german", "GET", "/de/:id"),
    (5, "spanish", "POST", "/es/{id}"), (6, "english-copy", "GET", "/EN/671"),
]
_ENDS = "ends AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{u}', '{m}', '{p}')" for i, u, m, p in ENDPOINTS) + ") e(endpoint_id, target_unit, m, end_path))"
_MATCH = f"""{_ENDS},
calls AS (SELECT page_id AS call_id, {_HOST} AS call_unit, 'GET' AS cm, url AS call_path, {_SEGS.format(_PATH)} AS cs FROM pages),
e2 AS (SELECT *, {_SEGS.format('end_path')} AS es FROM ends),
e3 AS (SELECT *, len(es) > 0 AND regexp_matches(es[-1], {_ALL}) AS tail FROM e2),
hits AS (SELECT * FROM calls JOIN e3 ON m IN (cm, 'ANY') AND call_unit <> target_unit AND (CASE WHEN tail THEN len(cs) >= len(es) - 1 ELSE len(cs) = len(es) END)
  AND len(list_filter(range(1, len(es) + 1 - (CASE WHEN tail THEN 1 ELSE 0 END)), lambda i: NOT (regexp_matches(cs[i], {_DYN}) OR regexp_matches(es[i], {_DYN}) OR lower(cs[i]) = lower(es[i])))) = 0),
normed AS (SELECT call_id, endpoint_id, call_unit, target_unit, call_path, end_path,
  (CASE WHEN '/' || array_to_string(list_transform(cs, lambda s: CASE WHEN regexp_matches(s, {_DYN}) THEN '{{}}' ELSE lower(s) END), '/') = '/' || array_to_string(list_transform(es, lambda s: CASE WHEN regexp_matches(s, {_DYN}) THEN '{{}}' ELSE lower(s) END), '/') THEN 100 ELSE 90 END)::INTEGER AS confidence FROM hits)"""


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url")


def _calls(spark, d):
    return _pages(spark, d).select(F.col("page_id").alias("call_id"), http.origin_host(F.col("url")).alias("unit"), F.lit("GET").alias("method"), F.col("url").alias("path"))


def _endpoints(spark):
    return spark.createDataFrame(ENDPOINTS, "endpoint_id long, unit string, method string, path string")


@query(f"SELECT page_id, '/' || array_to_string(list_transform({_SEGS.format(_PATH)}, lambda s: CASE WHEN regexp_matches(s, {_DYN}) THEN '{{}}' ELSE lower(s) END), '/') AS path FROM pages")
def http_path_normalize(spark, d):
    return _pages(spark, d).select("page_id", http.normalize_path(F.col("url")).alias("path"))


@query(f"SELECT page_id, unnest({_SEGS.format(_PATH)}) AS segment FROM pages")
def http_path_segments(spark, d):
    return _pages(spark, d).select("page_id", F.explode(http.segments(http.path_of(F.col("url")))).alias("segment"))


@query(f"SELECT page_id, {_HOST} AS host FROM pages")
def origin_host(spark, d):
    return _pages(spark, d).select("page_id", http.origin_host(F.col("url")).alias("host"))


@query("""SELECT DISTINCT n_name AS name, unnest([lower(n_name), trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-'), regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g')]) AS alias FROM nation""")
def host_aliases(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), F.explode(http.host_aliases(F.col("n_name"))).alias("alias"))


@query(f"WITH {_MATCH} SELECT * FROM normed")
def http_link_matches(spark, d):
    return link.http_matches(_calls(spark, d), _endpoints(spark))


@query(f"WITH {_MATCH} SELECT * FROM normed WHERE call_id IN (SELECT call_id FROM normed GROUP BY call_id HAVING count(*) = 1)")
def http_link_unique(spark, d):
    return link.http_links(_calls(spark, d), _endpoints(spark))


@query(f"""WITH {_MATCH}, one AS (SELECT normed.*, CASE call_id % 4 WHEN 0 THEN 'dynamic://unresolved' WHEN 1 THEN 'http://localhost:8080' WHEN 2 THEN 'https://English:443/x' END AS origin FROM normed),
lim AS (SELECT *, CASE WHEN origin IS NULL THEN 100 WHEN origin LIKE 'dynamic%' THEN 70 WHEN origin LIKE '%localhost%' THEN 85 WHEN target_unit = 'english' THEN 80 END AS cap FROM one),
kept AS (SELECT * FROM lim WHERE cap IS NOT NULL)
SELECT call_id, endpoint_id, least(confidence, cap)::INTEGER AS confidence FROM kept WHERE call_id IN (SELECT call_id FROM kept GROUP BY call_id HAVING count(*) = 1)""")
def http_link_confidence(spark, d):
    origin = F.when(F.col("call_id") % 4 == 0, "dynamic://unresolved").when(F.col("call_id") % 4 == 1, "http://localhost:8080").when(F.col("call_id") % 4 == 2, "https://English:443/x")
    return link.http_links(_calls(spark, d).withColumn("origin", origin), _endpoints(spark)).select("call_id", "endpoint_id", "confidence")


_PACKAGES = """own AS (SELECT DISTINCT 'brand:' || p_brand AS unit, p_name || '-' || p_size AS name FROM part), single AS (SELECT name, min(unit) AS target_unit FROM own GROUP BY name HAVING count(*) = 1)"""


def _identities(part):
    return part.selectExpr("concat('brand:', p_brand) AS unit", "concat(p_name, '-', p_size) AS name")


@query(f"""WITH {_PACKAGES}, used AS (SELECT DISTINCT 'supplier:' || l_suppkey AS source_unit, p_name || '-' || p_size AS name, max(l_quantity) >= 40 AS imported FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT source_unit, name, target_unit, bool_or(imported) AS i, (CASE WHEN bool_or(imported) THEN 100 ELSE 90 END)::INTEGER AS confidence FROM used JOIN single USING (name) GROUP BY source_unit, name, target_unit""".replace("bool_or(imported) AS i, ", ""))
def package_link(spark, d):
    part, li = table(spark, d, "part"), table(spark, d, "lineitem")
    said = li.join(part, li.l_partkey == part.p_partkey).selectExpr("concat('supplier:', l_suppkey) AS unit", "concat(p_name, '-', p_size) AS name", "l_quantity")
    return link.package_links(_identities(part), said, said.where("l_quantity >= 40"))


@query(f"WITH {_PACKAGES} SELECT name, count(*) AS owners FROM own GROUP BY name HAVING count(*) > 1")
def package_ambiguous_names(spark, d):
    return link.ambiguous_names(_identities(table(spark, d, "part")))


@query("""WITH names AS (SELECT * FROM (VALUES ('com'), ('com.example'), ('com.example.blog'), ('net.example'), ('org'), ('dup'), ('dup')) n(name)),
single AS (SELECT name FROM names GROUP BY name HAVING count(*) = 1),
refs AS (SELECT DISTINCT array_to_string(list_reverse(string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')), '.') AS ref FROM pages),
cut AS (SELECT ref, array_to_string(list_slice(string_split(ref, '.'), 1, n), '.') AS name, n FROM refs, (SELECT unnest(range(1, 9)) AS n) WHERE n <= len(string_split(ref, '.')))
SELECT ref, arg_max(name, n) AS name FROM cut JOIN single USING (name) GROUP BY ref""")
def import_longest_prefix(spark, d):
    refs = _pages(spark, d).select(F.array_join(F.reverse(F.split(F.regexp_extract("url", "://([^/?#]*)", 1), r"\.")), ".").alias("ref"))
    names = spark.createDataFrame([(n,) for n in ("com", "com.example", "com.example.blog", "net.example", "org", "dup", "dup")], "name string")
    return link.longest_prefix(refs, names)


@query(f"""WITH keys AS (SELECT DISTINCT trim({_PATH}, '/') AS key FROM pages),
refs AS (SELECT DISTINCT array_to_string(list_slice(string_split(key, '/'), 2, 9), '/') AS ref FROM keys WHERE key LIKE '%/%' UNION SELECT key FROM keys WHERE length(key) % 2 = 0),
ranked AS (SELECT ref, key, 0 AS way FROM refs JOIN keys ON ref = key
  UNION ALL SELECT ref, key, 2 FROM refs JOIN keys ON key = ref OR key LIKE '%/' || ref)
SELECT ref, arg_min(key, way || key) AS module FROM ranked GROUP BY ref""")
def import_suffix_resolution(spark, d):
    keys = _pages(spark, d).select(F.btrim(http.path_of(F.col("url")), F.lit("/")).alias("key")).distinct()
    tails = keys.where(F.col("key").contains("/")).select(F.regexp_replace("key", "^[^/]*/", "").alias("ref"))
    return link.suffix_resolution(tails.unionByName(keys.where("length(key) % 2 = 0").select(F.col("key").alias("ref"))), keys)


@query("SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id")
def href_calls(spark, d):
    refs = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return refs.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("href").alias("targets"))


@query(r"""SELECT page_id, CASE WHEN len(p) > 0 THEN array_to_string(list_transform(p, lambda x: x[2:-2]), '') END AS url
FROM (SELECT page_id, regexp_extract_all(html, '"[^"\n]*"|''[^''\n]*''|`[^`]*`') AS p FROM pages)""")
def quoted_argument_extract(spark, d):
    return table(spark, d, "pages").select("page_id", extract.called_url(F.col("html")).alias("url"))


@query("SELECT n_name AS name, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM nation UNION ALL SELECT c_name, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') FROM customer UNION ALL SELECT p_type || ' / ' || p_name, trim(regexp_replace(lower(p_type || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '-') FROM part")
def slugify_names(spark, d):
    n = table(spark, d, "nation").selectExpr("n_name AS name").unionAll(table(spark, d, "customer").selectExpr("c_name")).unionAll(table(spark, d, "part").selectExpr("concat(p_type, ' / ', p_name)"))
    return n.select("name", hashing.slugify(F.col("name")).alias("slug"))


_FNV = "lower(lpad(to_hex(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)), 16, '0'))"


@query(f"SELECT name, {_FNV.format('name')} AS hash FROM (SELECT n_name AS name FROM nation UNION ALL SELECT s_name FROM supplier)")
def stable_hash_ids(spark, d):
    n = table(spark, d, "nation").selectExpr("n_name AS name").unionAll(table(spark, d, "supplier").selectExpr("s_name"))
    return n.select("name", hashing.stable_hash(F.col("name")).alias("hash"))


@query(f"SELECT name, 'nation-' || k || ':' || {_FNV.format('v')} AS id FROM (SELECT n_name AS name, n_regionkey AS k, 'Nation ' || n_regionkey || chr(0) || n_name AS v FROM nation)")
def scoped_ids(spark, d):
    n = table(spark, d, "nation").selectExpr("n_name AS name", "concat('Nation ', n_regionkey) AS scope")
    return n.select("name", hashing.scoped_id(F.col("scope"), F.col("name")).alias("id"))
