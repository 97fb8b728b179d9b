"""Queries on what changes between versions: incremental linking, tables in versions, registries, streamed states, JSON manifests, the text index, suites."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import http
from ..operators import link, manifests, relink, text_index
from ..session import cut, shared_dir, table
from ..sources.registry import Registry
from ..sources.versions import Versions
from ..streaming import states
from . import suites
from .link_queries import _DYN, _HOST, _PATH, _SEGS
from .registry import query


# Pages before: without those that anchor at the top; every path is served in any language. After: without a spam farm;
# second pages moved to English, and mobile hosts serve each path in its own language alone.
_LANG = "regexp_extract(url, '://[^/]*/([a-z]+)/', 1)"
_NUMBER = "regexp_extract(url, '://[^/]*/[a-z]+/([0-9]+)', 1)"
_SQL_BEFORE = f"""pb AS (SELECT page_id, url, {_HOST} AS unit, '/{{lang}}/' || {_NUMBER} AS served FROM pages WHERE NOT url LIKE '%#top'),
pa AS (SELECT page_id, CASE WHEN url LIKE '%page=2%' THEN regexp_replace(url, '(://[^/]*)/[a-z]+/', '\\1/en/') ELSE url END AS url, {_HOST} AS unit,
  CASE WHEN {_HOST} LIKE 'm.%' THEN '/' || {_LANG} || '/' || {_NUMBER} ELSE '/{{lang}}/' || {_NUMBER} END AS served FROM pages WHERE NOT {_HOST} LIKE 'spam-farm.%')"""


def _sql_links(pages: str, tag: str) -> str:
    norm = lambda s: f"'/' || array_to_string(list_transform({s}, lambda x: CASE WHEN regexp_matches(x, {_DYN}) THEN '{{}}' ELSE lower(x) END), '/')"
    return f"""c{tag} AS (SELECT page_id AS call_id, unit AS call_unit, url AS call_path, {_SEGS.format(_PATH)} AS cs FROM {pages}),
e{tag} AS (SELECT page_id AS endpoint_id, unit AS target_unit, served AS end_path, {_SEGS.format('served')} AS es FROM {pages}),
h{tag} AS (SELECT call_id, endpoint_id, call_unit, target_unit, call_path, end_path, (CASE WHEN {norm('cs')} = {norm('es')} THEN 100 ELSE 90 END)::INTEGER AS confidence
  FROM c{tag} JOIN e{tag} ON cs[-1] = es[-1] AND len(cs) = len(es) AND call_unit <> target_unit AND (regexp_matches(es[1], {_DYN}) OR lower(es[1]) = lower(cs[1]))),
l{tag} AS (SELECT * FROM h{tag} WHERE call_id IN (SELECT call_id FROM h{tag} GROUP BY call_id HAVING count(*) = 1))"""


_SQL_HTTP = f"{_SQL_BEFORE}, {_sql_links('pb', '0')}, {_sql_links('pa', '1')}"


def _versions_of_pages(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url").withColumn("unit", http.origin_host(F.col("url")))
    number, lang = F.regexp_extract("url", "://[^/]*/[a-z]+/([0-9]+)", 1), F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1)
    anywhere = F.concat(F.lit("/{lang}/"), number)
    before = pages.where(~F.col("url").endswith("#top")).withColumn("served", anywhere)
    after = pages.where(~F.col("unit").startswith("spam-farm.")).withColumn("served", F.when(F.col("unit").startswith("m."), F.concat(F.lit("/"), lang, F.lit("/"), number)).otherwise(anywhere))
    after = after.withColumn("url", F.when(F.col("url").contains("page=2"), F.regexp_replace("url", "(://[^/]*)/[a-z]+/", "$1/en/")).otherwise(F.col("url")))
    calls = lambda p: p.select(F.col("page_id").alias("call_id"), "unit", F.lit("GET").alias("method"), F.col("url").alias("path"))
    ends = lambda p: p.select(F.col("page_id").alias("endpoint_id"), "unit", F.lit("GET").alias("method"), F.col("served").alias("path"))
    return calls(before), ends(before), calls(after), ends(after)


def _relinked(spark, d):
    calls0, ends0, calls1, ends1 = _versions_of_pages(spark, d)
    hits = cut(link.http_candidates(calls0, ends0))
    links = cut(link.only_candidates(hits))
    return relink.relink_http(hits, links, calls1, ends1, cut(relink.changed_keys(calls0, calls1, "call_id")), cut(relink.changed_keys(ends0, ends1, "endpoint_id")))


@query(f"WITH {_SQL_HTTP} SELECT * FROM l1")
def relink_http_delta(spark, d):
    return _relinked(spark, d).links


@query(f"WITH {_SQL_HTTP} SELECT * FROM h1")
def relink_http_candidates(spark, d):
    return _relinked(spark, d).candidates


@query(f"""WITH {_SQL_HTTP}, cc AS (SELECT coalesce(c0.call_id, c1.call_id) AS call_id FROM c0 FULL JOIN c1 ON c0.call_id = c1.call_id WHERE c0.call_path IS DISTINCT FROM c1.call_path),
ce AS (SELECT coalesce(e0.endpoint_id, e1.endpoint_id) AS endpoint_id FROM e0 FULL JOIN e1 ON e0.endpoint_id = e1.endpoint_id WHERE e0.end_path IS DISTINCT FROM e1.end_path),
judged AS (SELECT call_id FROM cc UNION SELECT call_id FROM h0 SEMI JOIN ce USING (endpoint_id) UNION SELECT call_id FROM h1 SEMI JOIN ce USING (endpoint_id))
SELECT 'judged' AS what, count(*) AS n FROM judged UNION ALL SELECT 'removed', count(*) FROM (SELECT * FROM l0 EXCEPT ALL SELECT * FROM l1) UNION ALL SELECT 'added', count(*) FROM (SELECT * FROM l1 EXCEPT ALL SELECT * FROM l0)""")
def relink_http_report(spark, d):
    return _relinked(spark, d).report()


@query(f"""WITH {_SQL_HTTP}, here AS (SELECT page_id FROM pages WHERE url LIKE 'https:%')
SELECT 'missing-call' AS kind, call_id, endpoint_id FROM l0 WHERE call_id NOT IN (FROM here) UNION ALL SELECT 'missing-endpoint', call_id, endpoint_id FROM l0 WHERE endpoint_id NOT IN (FROM here)""")
def relink_gate(spark, d):
    """What the gate says of links that were left as they were when pages without encryption went away."""
    calls, ends, *_ = _versions_of_pages(spark, d)
    gone = table(spark, d, "pages").where(~F.col("url").startswith("https:")).select("page_id")
    left = lambda df, key: df.join(gone.withColumnRenamed("page_id", key), key, "left_anti")
    return relink.unsound(cut(link.http_links(calls, ends)), left(calls, "call_id"), left(ends, "endpoint_id"))


@query("""WITH own AS (SELECT DISTINCT 'brand:' || p_brand AS unit, p_name || '-' || (p_size + CASE WHEN p_brand = 'Brand#7' THEN 1 ELSE 0 END) AS name FROM part),
single AS (SELECT name, min(unit) AS target_unit FROM own GROUP BY name HAVING count(*) = 1),
used AS (SELECT 'supplier:' || l_suppkey AS source_unit, p_name || '-' || p_size AS name, l_quantity >= 40 AS imported FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE NOT (s_nationkey = 3 AND l_returnflag = 'R'))
SELECT source_unit, name, target_unit, (CASE WHEN bool_or(imported) THEN 100 ELSE 90 END)::INTEGER AS confidence FROM used JOIN single USING (name) GROUP BY source_unit, name, target_unit""")
def relink_package_delta(spark, d):
    """One brand renames its packages, and suppliers of one nation no longer declare what was returned."""
    part, supplier = table(spark, d, "part"), table(spark, d, "supplier")
    own = lambda size: part.selectExpr("concat('brand:', p_brand) AS unit", f"concat(p_name, '-', {size}) AS name").distinct()
    before, now = own("p_size"), own("p_size + IF(p_brand = 'Brand#7', 1, 0)")
    said = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    said = said.selectExpr("concat('supplier:', l_suppkey) AS unit", "concat(p_name, '-', p_size) AS name", "l_quantity", "s_nationkey = 3 AND l_returnflag = 'R' AS gone")
    left = said.where("NOT gone")
    links = cut(link.package_links(before, said, said.where("l_quantity >= 40")))
    changed = supplier.where("s_nationkey = 3").selectExpr("concat('supplier:', s_suppkey) AS unit").unionByName(part.where("p_brand = 'Brand#7'").selectExpr("concat('brand:', p_brand) AS unit").distinct())
    return relink.relink_packages(links, (before, now), left, left.where("l_quantity >= 40"), changed).links


def _store(spark, keys):
    return Versions(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}", keys)


@query("""SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'FURNITURE' ELSE c_mktsegment END AS c_mktsegment
FROM customer WHERE c_mktsegment <> 'BUILDING' AND (c_mktsegment <> 'MACHINERY' OR c_acctbal > 5000)""")
def versions_of_customers(spark, d):
    """Created, updated, removed, compacted, removed and created again; each step is a version of the store."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    store = _store(spark, {"customer": ["c_custkey"]})
    store.commit({"customer": c})
    store.commit({"customer": c.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0))}, {"customer": c.where("c_mktsegment = 'BUILDING'").where("c_acctbal >= 0")})
    store.commit({}, {"customer": c.where("c_mktsegment IN ('BUILDING', 'MACHINERY')")})
    store.compact()
    store.commit({"customer": c.where("c_mktsegment = 'MACHINERY' AND c_acctbal > 5000").withColumn("c_mktsegment", F.lit("FURNITURE"))})
    return store.read("customer")


@query("""WITH r AS (SELECT c_mktsegment || '/' || c_nationkey AS id FROM customer WHERE c_nationkey = 1 UNION ALL SELECT c_name FROM customer)
SELECT id, CASE WHEN id LIKE '%/%' THEN 'invalid-id' WHEN count(*) > 1 THEN 'repeated-id' ELSE 'already-exists' END AS code FROM r
WHERE id LIKE '%/%' OR id IN (SELECT c_name FROM customer WHERE c_acctbal > 0) GROUP BY id""")
def registry_refusals(spark, d):
    """Customers with a balance are in the registry when all are created, some under ids that no folder can have."""
    c = table(spark, d, "customer")
    registry = Registry(_store(spark, {"repositories": ["id"]}), "repositories")
    rows = c.select(F.col("c_name").alias("id"), F.col("c_nationkey").cast("long").alias("home"))
    registry.create(rows.join(c.where("c_acctbal > 0").select(F.col("c_name").alias("id")), "id", "left_semi"))
    return registry.create(rows.unionByName(c.where("c_nationkey = 1").selectExpr("concat(c_mktsegment, '/', c_nationkey) AS id", "CAST(c_nationkey AS long) AS home")))


@query("SELECT c_name AS id, CASE WHEN c_acctbal > 9000 THEN -1 ELSE c_nationkey END::BIGINT AS home FROM customer WHERE c_mktsegment <> 'BUILDING'")
def registry_rows(spark, d):
    """All customers, of whom the richest move and one segment is removed."""
    c = table(spark, d, "customer")
    registry = Registry(_store(spark, {"repositories": ["id"]}), "repositories")
    rows = c.select(F.col("c_name").alias("id"), F.col("c_nationkey").cast("long").alias("home"))
    registry.create(rows)
    registry.update(c.where("c_acctbal > 9000").select(F.col("c_name").alias("id"), F.lit(-1).cast("long").alias("home")))
    registry.remove(c.where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("id")))
    return registry.rows()


@query("""WITH e AS (SELECT user_id, regexp_extract(props, '[0-9]+') AS file, round(value * 100)::BIGINT AS content, event_type = 'error' AS removed, ts, event_id FROM events),
held AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, file ORDER BY ts DESC, event_id DESC) = 1)
SELECT 'user-' || user_id AS repository, count(*) AS files, (sum(('0x' || substr(sha256(file || chr(0) || content), 1, 15))::BIGINT::HUGEINT) % 1152921504606846976)::BIGINT AS signature
FROM held WHERE NOT removed GROUP BY user_id""")
def repository_states_stream(spark, d):
    """Events as changes of users' files, an error removing one: states kept by a stream equal those of the whole table."""
    at = f"{shared_dir(spark)}/states-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")  # a pattern, since a stream's source is a folder
    changes = events.select(
        F.concat(F.lit("user-"), "user_id").alias("repository"), F.regexp_extract("props", "[0-9]+", 0).alias("file"), F.round(F.col("value") * 100).cast("long").cast("string").alias("content"),
        (F.col("event_type") == "error").alias("removed"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
    )
    states.follow(changes, f"{at}/out", f"{at}/log", slices=4).awaitTermination()
    return states.states(spark, f"{at}/out")


_MANIFEST_SQL = """WITH m AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'devDependencies' ELSE 'dependencies' END AS section, 'part "' || l_partkey || '"' AS name, max(l_quantity)::INTEGER AS q FROM lineitem GROUP BY ALL)"""


def _manifests_of_orders(spark, d):
    """package.json texts from orders and their lines; those of open partial orders are cut short."""
    li = table(spark, d, "lineitem").selectExpr("l_orderkey", "IF(l_returnflag = 'R', 'devDependencies', 'dependencies') AS section", "concat('part \"', l_partkey, '\"') AS part", "l_quantity")
    one = li.groupBy("l_orderkey", "section", "part").agg(F.concat(F.lit("^"), F.max("l_quantity").cast("int").cast("string")).alias("version"))
    of = one.groupBy("l_orderkey").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("section") == s, F.struct("part", "version")))).alias(s) for s in ("dependencies", "devDependencies")])
    rows = table(spark, d, "orders").join(of, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.to_json(F.struct(F.concat(F.lit("order-"), "o_orderkey").alias("name"), F.lit("1.0.0").alias("version"), "dependencies", "devDependencies", F.struct(F.lit("x").alias("name")).alias("author")))
    cut_short = F.when(F.col("o_orderstatus") == "P", F.expr("left(t, length(t) - 1)")).otherwise(F.col("t"))
    return rows.withColumn("t", text).select(F.col("o_custkey").alias("unit"), F.lit("package.json").alias("name"), F.col("o_orderkey").alias("rel_path"), cut_short.alias("text"))


@query(f"""{_MANIFEST_SQL} SELECT o_custkey AS unit, o_orderkey AS rel_path, section, name, '^' || q AS version FROM m JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'""")
def json_manifest_declared(spark, d):
    return manifests.declared(manifests.parsed(_manifests_of_orders(spark, d)))


@query("SELECT o_custkey AS unit, o_orderkey AS rel_path, CASE WHEN o_orderstatus <> 'P' THEN 'order-' || o_orderkey END AS name, o_orderstatus = 'P' AS malformed FROM orders")
def json_manifest_identities(spark, d):
    m = manifests.parsed(_manifests_of_orders(spark, d))
    return manifests.identities(m).withColumn("malformed", F.lit(False)).unionByName(m.where("malformed").select("unit", "rel_path", F.lit(None).cast("string").alias("name"), "malformed"))


MARKERS = ["license", "@example.com", "https://", "api_key", "Copyright (c)", "ss t", "card", "-", "zzqqx"]
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("SELECT marker, doc_id FROM documents, (VALUES " + ", ".join(f"('{m}')" for m in MARKERS) + f") m(marker) WHERE contains({_LOWER.format('text')}, {_LOWER.format('marker')})")
def text_index_markers(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return text_index.holding(text_index.build(docs, ["doc_id"]), docs, ["doc_id"], MARKERS)


_BUDGET = "WITH f AS (SELECT source AS unit, doc_id, octet_length(encode(text)) AS size FROM documents), c AS (SELECT unit, list({'t': 0::BIGINT, 'ids': [doc_id], 's': size::BIGINT} ORDER BY doc_id) AS l, count(*) AS n FROM f WHERE size <= 9000 GROUP BY unit),\ng AS (SELECT unit, n, list_reduce(list_prepend({'t': 0::BIGINT, 'ids': []::BIGINT[], 's': 0::BIGINT}, l), lambda a, x: CASE WHEN a.t + x.s <= 60000 THEN {'t': a.t + x.s, 'ids': list_concat(a.ids, x.ids), 's': 0::BIGINT} ELSE a END).ids AS ids FROM c)"


def _budgeted(spark, d):
    files = table(spark, d, "documents").select(F.col("source").alias("unit"), F.col("doc_id").alias("rel_path"), F.octet_length("text").alias("size"))
    return text_index.within_budget(files, 9000, 60000)


@query(f"{_BUDGET} SELECT unit, unnest(ids) AS rel_path FROM g")
def text_index_budget(spark, d):
    """60 000 bytes of each source's documents, by id, those over 9 000 left out."""
    return _budgeted(spark, d)[0].select("unit", "rel_path")


@query(f"{_BUDGET} SELECT unit, 'text-index-memory-limit' AS code, (n - len(ids)) || ' files over the limit of the index' AS message FROM g WHERE n > len(ids)")
def text_index_diagnostics(spark, d):
    return _budgeted(spark, d)[1].select("unit", "code", "message")


class LongLines(suites.Analyzer):
    """A file's number among those of its unit that have lines of over 200 characters, and how many; at the end the unit's sums."""

    def __init__(self):
        self.files = self.lines = 0

    def file(self, path, text):
        n = sum(len(line) > 200 for line in text.split("\n"))
        if n:
            self.files += 1
            self.lines += n
            yield (path, self.files, n)

    def end(self):
        yield (None, self.files, self.lines)


_LONG = "WITH f AS (SELECT source AS unit, doc_id AS path, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 200)) AS lines FROM documents)"


def _long_lines(spark, d):
    suites.register(spark, "long_lines", LongLines, "path long, number long, lines long")
    return table(spark, d, "documents").selectExpr("source AS unit", "doc_id AS rel_path", "text")


@query(f"{_LONG} SELECT unit, path, 1::BIGINT AS number, lines FROM f WHERE lines > 0")
def analyzer_of_files(spark, d):
    """An analyzer in Python over each document, called by SQL with LATERAL."""
    return spark.sql("SELECT f.unit, x.* FROM {files} f, LATERAL long_lines(f.rel_path, f.text) x", files=_long_lines(spark, d))


@query(f"{_LONG} SELECT unit, path, row_number() OVER (PARTITION BY unit ORDER BY path) AS number, lines FROM f WHERE lines > 0 UNION ALL SELECT unit, NULL, count(*) FILTER (lines > 0), sum(lines)::BIGINT FROM f GROUP BY unit")
def analyzer_of_units(spark, d):
    """The same analyzer over each source's documents in order."""
    _long_lines(spark, d).createOrReplaceTempView("weft_files")
    return spark.sql("SELECT * FROM long_lines_of_unit(TABLE(weft_files) PARTITION BY unit ORDER BY rel_path)")


@query(f"""WITH p AS (SELECT page_id, url, html, {_HOST} AS unit FROM pages), d AS (SELECT unit, bool_or(url LIKE '%utm_source%') AS tracked, bool_or(contains(html, '<table')) AS tabled FROM p GROUP BY unit)
SELECT p.unit, page_id, 'tracked' AS suite FROM p JOIN d USING (unit) WHERE tracked AND contains(url, '?') UNION ALL SELECT p.unit, page_id, 'tabled' FROM p JOIN d USING (unit) WHERE tabled AND contains(html, '<table')""")
def suites_of_hosts(spark, d):
    """Suites run on hosts that show a reason for them; one that none shows is not called."""

    def never(files):
        raise AssertionError("called without a reason")

    pages = table(spark, d, "pages").select("page_id", "url", "html").withColumn("unit", http.origin_host(F.col("url")))
    some = [
        suites.Suite("tracked", F.bool_or(F.col("url").contains("utm_source")), lambda f: f.where(F.col("url").contains("?")).select("unit", "page_id")),
        suites.Suite("tabled", F.bool_or(F.col("html").contains("<table")), lambda f: f.where(F.col("html").contains("<table")).select("unit", "page_id")),
        suites.Suite("gopher", F.bool_or(F.col("url").startswith("gopher:")), never),
    ]
    return suites.run(pages, some).rows
