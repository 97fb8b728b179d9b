"""Text, scoring, merging, audit and capsule queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capsule, export, merge, records, scoring, technology, text
from ..sources import files as src
from ..session import table
from .registry import query

_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)"


def _files(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("unit"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"), "text", "lang")


def _after(word: str) -> str:
    return rf"regexp_extract(line, '(?:^|[^\p{{L}}\p{{N}}_$]){word}\s+([\p{{L}}_$][\p{{L}}\p{{N}}_$]*)', 1)"


@query(f"""WITH {_LINES}, n AS (SELECT {_after('the')} AS a, {_after('of')} AS b, {_after('and')} AS c FROM lines JOIN documents USING (doc_id) WHERE lang = 'en'),
best AS (SELECT CASE WHEN a <> '' THEN 'article' WHEN b <> '' THEN 'preposition' WHEN c <> '' THEN 'conjunction' END AS kind, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE c END AS name FROM n)
SELECT kind, count(*) AS declarations, count(DISTINCT name) AS names FROM best WHERE kind IS NOT NULL GROUP BY kind""")
def line_explode_declarations(spark, d):
    rules = [("en", "the", "article"), ("en", "of", "preposition"), ("en", "and", "conjunction")]
    found = text.declarations(text.lines(_files(spark, d).withColumnRenamed("lang", "language"), keep=("unit", "rel_path", "language")), rules)
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("declarations"), F.count_distinct("name").alias("names"))


@query(f"WITH {_LINES} SELECT doc_id::VARCHAR AS unit, min(line_no)::INTEGER AS line_no FROM lines WHERE contains(line, 'License') GROUP BY doc_id HAVING count(*) = 1")
def unique_matching_line(spark, d):
    return text.unique_line(text.lines(_files(spark, d)), F.col("line").contains("License")).select("unit", F.col("line_no").cast("int").alias("line_no"))


_SECRET = r"""parts AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\*\*\*|###|%%%|&&&|\$\$\$|\n|\. ')) AS line FROM documents),
kv AS (SELECT doc_id, line, regexp_extract(line, '([A-Za-z][A-Za-z0-9_.-]*)\s*=\s*"([^"]*)"', 1) AS k, regexp_extract(line, '([A-Za-z][A-Za-z0-9_.-]*)\s*=\s*"([^"]*)"', 2) AS v FROM parts),
hit AS (SELECT * FROM kv WHERE k <> '' AND regexp_matches(replace(replace(lower(k), '-', '_'), '.', '_'), '(^|_)(password|passwd|secret|token|api_key|apikey|access_key|private_key|client_secret|auth_token|credentials)$') AND strlen(v) >= 8)"""


def _secrets(spark, d):
    parts = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"\*\*\*|###|%%%|&&&|\$\$\$|\n|\. ", -1)).alias("part"))
    pair = r'([A-Za-z][A-Za-z0-9_.-]*)\s*=\s*"([^"]*)"'
    line = F.concat(F.regexp_extract("part", pair, 1), F.lit("="), F.regexp_extract("part", pair, 2))
    return parts.where(F.regexp_extract("part", pair, 1) != "").select("doc_id", line.alias("line")).where(text.is_secret_line(F.col("line")))


@query(f"WITH {_SECRET} SELECT doc_id, k || '=' || v AS line FROM hit")
def secret_lines(spark, d):
    return _secrets(spark, d)


@query(f"WITH {_SECRET} SELECT source, count(DISTINCT doc_id) AS sensitive FROM hit JOIN documents USING (doc_id) GROUP BY source")
def sensitive_documents(spark, d):
    docs = table(spark, d, "documents")
    pair = r'([A-Za-z][A-Za-z0-9_.-]*)\s*=\s*"([^"]*)"'
    of = lambda part: F.concat(F.regexp_extract(part, pair, 1), F.lit("="), F.regexp_extract(part, pair, 2))
    secret = F.exists(F.split("text", r"\*\*\*|###|%%%|&&&|\$\$\$|\n|\. ", -1), lambda part: (F.regexp_extract(part, pair, 1) != "") & text.is_secret_line(of(part)))
    hit = docs.where(text.is_sensitive(F.lit("conf/app.properties"), F.lit(""), secret))
    return hit.groupBy("source").agg(F.count_distinct("doc_id").alias("sensitive"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_sha256(spark, d):
    found = capsule.file_digests(table(spark, d, "documents").select(F.lit("docs").alias("unit"), F.col("doc_id").alias("rel_path"), "text"))
    return found.select(F.col("rel_path").alias("doc_id"), "sha256")


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_content(spark, d):
    h = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return h.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


_ENDINGS = (
    "java", "ts", "tsx", "js", "jsx", "mjs", "py", "rs", "go", "cs", "fs", "fsx", "php", "kt", "kts", "rb", "dart", "c", "h", "cc", "cpp", "cxx", "hpp", "swift", "scala", "sh", "bash", "zsh", "ps1", "sql",
    "html", "htm", "xml", "css", "scss", "graphql", "gql", "vue", "svelte", "astro", "razor", "ex", "exs", "json", "yml", "md", "toml", "",
)


@query(f"""SELECT doc_id, CASE WHEN ext = 'java' THEN 'Java' WHEN ext IN ('ts', 'tsx') THEN 'TypeScript' WHEN ext IN ('js', 'jsx') THEN 'JavaScript' WHEN ext = 'py' THEN 'Python' WHEN ext = 'rs' THEN 'Rust' WHEN ext = 'go' THEN 'Go'
  WHEN ext = 'cs' THEN 'C#' WHEN ext IN ('fs', 'fsx') THEN 'F#' WHEN ext = 'php' THEN 'PHP' WHEN ext IN ('kt', 'kts') THEN 'Kotlin' WHEN ext = 'rb' THEN 'Ruby' WHEN ext = 'dart' THEN 'Dart' WHEN ext IN ('c', 'h') THEN 'C'
  WHEN ext IN ('cc', 'cpp', 'cxx', 'hpp') THEN 'C++' WHEN ext = 'swift' THEN 'Swift' WHEN ext = 'scala' THEN 'Scala' WHEN ext IN ('sh', 'bash', 'zsh', 'ps1') THEN 'Shell' WHEN ext = 'sql' THEN 'SQL' WHEN ext IN ('html', 'htm') THEN 'HTML'
  WHEN ext = 'xml' THEN 'XML' WHEN ext = 'css' THEN 'CSS' WHEN ext = 'scss' THEN 'SCSS' WHEN ext IN ('graphql', 'gql') THEN 'GraphQL' WHEN ext = 'vue' THEN 'Vue' WHEN ext = 'svelte' THEN 'Svelte' WHEN ext = 'astro' THEN 'Astro'
  WHEN ext = 'razor' THEN 'Razor' WHEN ext IN ('ex', 'exs') THEN 'Elixir' ELSE 'Unknown' END AS language
FROM (SELECT doc_id, {list(_ENDINGS)}[(doc_id % {len(_ENDINGS)}) + 1] AS ext FROM documents)""")
def language_of_source(spark, d):
    ext = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % len(_ENDINGS) + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", src.language_of(ext).alias("language"))


_NAMES = ("pom.xml", "build.gradle", "build.gradle.kts", "package.json", "Cargo.toml", "composer.json", "requirements.txt", "pyproject.toml", "go.mod", "Gemfile", "main.py")


@query(f"""WITH f AS (SELECT p_partkey::VARCHAR AS unit, 'app/' || p_brand || '/' || {list(_NAMES)}[(p_partkey % {len(_NAMES)}) + 1] AS rel_path, {list(_NAMES)}[(p_partkey % {len(_NAMES)}) + 1] AS name FROM part)
SELECT unit, rel_path, CASE WHEN name = 'pom.xml' THEN 'Java/Maven' WHEN name LIKE 'build.gradle%' THEN 'Java/Gradle' WHEN name = 'package.json' THEN 'Node.js' WHEN name = 'Cargo.toml' THEN 'Rust' WHEN name = 'composer.json' THEN 'PHP/Composer' ELSE 'Python' END AS runtime,
  CASE WHEN name = 'pom.xml' THEN 'mvn -o -DskipTests package' WHEN name LIKE 'build.gradle%' THEN 'gradle --offline build -x test' WHEN name = 'package.json' THEN 'npm test --if-present && npm run build --if-present'
    WHEN name = 'Cargo.toml' THEN 'cargo check --locked --offline' WHEN name = 'composer.json' THEN 'composer validate --no-check-publish' ELSE 'python -m compileall .' END AS command, name = 'package.json' AS network
FROM f WHERE name NOT IN ('go.mod', 'Gemfile', 'main.py')""")
def sandbox_plans(spark, d):
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return capsule.sandbox_plan(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("unit"), F.concat_ws("/", F.lit("app"), "p_brand", name).alias("rel_path")))


_MARKED = ("image: postgres", "uses redis", "JDBC:ORACLE:thin", "sqlite://x", "mongodb+srv://h", "mysql://a mariadb://b", "image: mssql", "nothing", "select a from b")
_PLACES = ("docker-compose.yml", "README.md", "application.properties", ".env", "pom.xml", "src/main.py", "conf/db.toml")


@query(f"""WITH f AS (SELECT o_custkey::VARCHAR AS unit, lower({list(_MARKED)}[(o_orderkey % {len(_MARKED)}) + 1]) AS t, {list(_PLACES)}[(o_orderkey // 9 % {len(_PLACES)}) + 1] AS place FROM orders),
m AS (SELECT unit, unnest([CASE WHEN t LIKE '%image: postgres%' THEN 'PostgreSQL' END, CASE WHEN t LIKE '%redis%' THEN 'Redis' END, CASE WHEN t LIKE '%jdbc:oracle:%' THEN 'Oracle' END, CASE WHEN t LIKE '%sqlite://%' THEN 'SQLite' END,
  CASE WHEN t LIKE '%mongodb%' THEN 'MongoDB' END, CASE WHEN t LIKE '%mysql://%' THEN 'MySQL' END, CASE WHEN t LIKE '%mariadb://%' THEN 'MariaDB' END, CASE WHEN t LIKE '%image: mssql%' THEN 'SQL Server' END]) AS name
  FROM f WHERE place NOT IN ('README.md', 'src/main.py'))
SELECT unit, 'Database' AS category, name, least(100, 65 + 12 * least(3, count(*)))::INTEGER AS confidence FROM m WHERE name IS NOT NULL GROUP BY unit, name
UNION ALL SELECT DISTINCT unit, 'Query Language', 'SQL', 90 FROM f WHERE t LIKE '%select % from %'""")
def database_markers(spark, d):
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    place = pick(_PLACES, F.floor(F.col("o_orderkey") / 9))
    files = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("unit"), pick(_MARKED, F.col("o_orderkey")).alias("text"), F.substring_index(place, "/", -1).alias("name"), F.substring_index(place, ".", -1).alias("ext"))
    return technology.databases(files).select("unit", "category", "name", F.col("confidence").cast("int").alias("confidence"))


_TECH = [("Language", "GraphQL"), ("language", "S.C.S.S"), ("language", "Java"), ("Framework", "Next.js"), ("framework", "spring-boot"), ("library", "React"), ("data", "type orm"), ("data", "postgres"), ("build", "pnpm"), ("BUILD", "Webpack"), ("build", "Maven"), ("runtime", "node_js"), ("infrastructure", "Docker"), ("other", "x")]


@query(f"""WITH t(i, category, name) AS (VALUES {", ".join(f"({i}, '{c}', '{n}')" for i, (c, n) in enumerate(_TECH))}),
b AS (SELECT p_partkey, category, name, lower(category) AS c, regexp_replace(lower(name), '[-._ ]', '', 'g') AS n FROM part JOIN t ON p_partkey % {len(_TECH)} = i)
SELECT p_partkey, CASE WHEN c = 'language' AND n IN ('sql', 'graphql') THEN 'Query Language' WHEN c = 'language' AND n IN ('css', 'scss') THEN 'Style Language' WHEN c = 'language' THEN 'Programming Language' WHEN c = 'framework' AND n = 'nextjs' THEN 'Frontend Framework'
  WHEN c = 'framework' THEN 'Backend Framework' WHEN c = 'library' AND n = 'react' THEN 'UI Library' WHEN c = 'data' AND n = 'typeorm' THEN 'ORM' WHEN c = 'data' THEN 'Database' WHEN c = 'build' AND n = 'pnpm' THEN 'Package Manager' WHEN c = 'build' AND n = 'webpack' THEN 'Bundler'
  WHEN c = 'build' THEN 'Build Tool' WHEN c = 'runtime' THEN 'Runtime' WHEN c = 'infrastructure' AND n = 'docker' THEN 'Containerization' ELSE 'Tool' END AS classification,
  CASE n WHEN 'postgres' THEN 'PostgreSQL' WHEN 'springboot' THEN 'Spring Boot' WHEN 'nodejs' THEN 'Node.js' ELSE name END AS canonical FROM b""")
def technology_classification(spark, d):
    known = F.broadcast(spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(_TECH)], "i long, category string, name string"))  # fixed rows
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(_TECH)).alias("i")).join(known, "i")
    return rows.select("p_partkey", technology.classification(F.col("category"), F.col("name")).alias("classification"), technology.canonical_name(F.col("name")).alias("canonical"))


@query("""WITH t AS (SELECT s_nationkey AS unit, s_name AS name FROM supplier), e AS (SELECT c_nationkey AS unit, replace(upper(c_name), 'CUSTOMER', 'SUPPLIER') AS name, max(c_acctbal) AS best FROM customer GROUP BY ALL)
SELECT t.unit, t.name, e.best AS evidence FROM t LEFT JOIN e ON t.unit = e.unit AND lower(t.name) = lower(e.name)""")
def technology_evidence(spark, d):
    tech = table(spark, d, "supplier").select(F.col("s_nationkey").alias("unit"), F.col("s_name").alias("name"))
    name = F.replace(F.upper("c_name"), F.lit("CUSTOMER"), F.lit("SUPPLIER"))
    found = table(spark, d, "customer").select(F.col("c_nationkey").alias("unit"), name.alias("name"), F.col("c_acctbal").alias("confidence"), F.col("c_acctbal").alias("evidence"))
    return technology.with_evidence(tech, found)


#: signal, pattern, weight, kind, strength of evidence for toxic documents.
MARKERS = [
    ("idiot", "idiot|moron|stupid", 55, "source", 95), ("trash", "trash|scum|loser", 30, "source", 90), ("clown", "clown|pathetic", 20, "convention", 85), ("worthless", "worthless|disgusting", 20, "configuration", 90),
]
_SIGNALS = "sig AS (SELECT doc_id, source, s.* FROM documents, (VALUES " + ", ".join(f"('{a}', '{b}', {c}, '{k}', {s})" for a, b, c, k, s in MARKERS) + ") s(signal, pattern, weight, kind, strength) WHERE regexp_matches(text, pattern)), "
_SCORED = _SIGNALS + "scored AS (SELECT doc_id, least(100, sum(weight))::INTEGER AS confidence, count(*) AS signals, bool_or(kind IN ('manifest', 'configuration', 'source')) AS direct, bool_or(kind = 'source' AND strength >= 90) AS strong FROM sig GROUP BY doc_id)"


def _scores(spark, d):
    rules = F.array(*[F.struct(F.lit(a).alias("signal"), F.lit(b).alias("pattern"), F.lit(w).alias("weight"), F.lit(k).alias("kind"), F.lit(s).alias("strength")) for a, b, w, k, s in MARKERS])
    s = table(spark, d, "documents").select("doc_id", "text", "source", F.explode(rules).alias("r")).where(F.regexp(F.col("text"), F.col("r.pattern")))
    s = s.select(F.col("doc_id").alias("unit"), F.lit("toxic").alias("name"), "r.signal", "r.weight", "r.kind", "r.strength", "source")
    return scoring.detection_score(s)


@query(f"WITH {_SCORED} SELECT doc_id AS unit, confidence, signals::INTEGER AS signals FROM scored")
def detection_score(spark, d):
    return _scores(spark, d).select("unit", "confidence", F.size("evidence").alias("signals"))


@query(f"WITH {_SCORED} SELECT doc_id AS unit, direct AND (confidence >= 70 OR (confidence >= 60 AND strong)) AS actionable FROM scored")
def detection_actionable(spark, d):
    return _scores(spark, d).select("unit", scoring.actionable(F.col("confidence"), F.col("evidence")).alias("actionable"))


@query("SELECT lang AS family, count(*) AS files, least(100, 65 + 12 * least(count(*), 3))::INTEGER AS confidence FROM documents WHERE contains(text, 'License') GROUP BY lang")
def database_detection_confidence(spark, d):
    f = table(spark, d, "documents").where(F.col("text").contains("License")).groupBy(F.col("lang").alias("family")).agg(F.count(F.lit(1)).alias("files"))
    return f.withColumn("confidence", scoring.database_confidence(F.col("files")))


@query(f"""WITH {_SCORED}, f AS (SELECT doc_id FROM scored WHERE direct AND (confidence >= 70 OR (confidence >= 60 AND strong))), e AS (SELECT doc_id FROM labels WHERE toxic = 1),
c AS (SELECT (SELECT count(*) FROM f WHERE doc_id IN (SELECT doc_id FROM e)) AS tp, (SELECT count(*) FROM f WHERE doc_id NOT IN (SELECT doc_id FROM e)) AS fp, (SELECT count(*) FROM e WHERE doc_id NOT IN (SELECT doc_id FROM f)) AS fn)
SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2 * tp::DOUBLE / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def detection_quality(spark, d):
    found = _scores(spark, d).where(scoring.actionable(F.col("confidence"), F.col("evidence"))).select(F.col("unit").alias("doc_id"))
    return scoring.quality(found, table(spark, d, "labels").where("toxic = 1"), ["doc_id"])


@query("""WITH o AS (SELECT c_nationkey AS unit, count(o_orderkey) AS edges, count(DISTINCT c_custkey) AS components, coalesce(max(o_totalprice), 0) > 480000 AS fw FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey)
SELECT unit, CASE WHEN fw THEN 'L3' WHEN edges > 0 THEN 'L2' WHEN components > 0 THEN 'L1' ELSE 'L0' END AS level FROM o""")
def compatibility_level(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    g = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy(F.col("c_nationkey").alias("unit")).agg(F.count("o_orderkey").alias("edges"), F.count_distinct("c_custkey").alias("components"), (F.coalesce(F.max("o_totalprice"), F.lit(0.0)) > 480000).alias("fw"))
    return g.select("unit", scoring.compatibility(F.col("fw"), F.col("edges"), F.col("components")).alias("level"))


@query("""WITH s AS (SELECT c_nationkey AS unit, bool_or(c_mktsegment = 'BUILDING' AND c_acctbal > 9000) AS fe, bool_or(c_mktsegment = 'MACHINERY' AND c_acctbal > 9000) AS be, bool_or(c_mktsegment = 'FURNITURE' AND c_acctbal > 8000) AS inf, bool_or(c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 9000) AS lib, bool_or(c_mktsegment = 'AUTOMOBILE' AND c_acctbal > 9500) AS rt FROM customer GROUP BY c_nationkey)
SELECT unit, CASE WHEN fe AND be THEN 'Fullstack' WHEN fe AND lib AND NOT rt THEN 'Library' WHEN fe THEN 'Frontend' WHEN be THEN 'Backend' WHEN inf THEN 'Infrastructure' WHEN lib THEN 'Library' ELSE 'Unknown' END AS role FROM s""")
def role_classification(spark, d):
    has = lambda seg, least: F.bool_or((F.col("c_mktsegment") == seg) & (F.col("c_acctbal") > least))
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("unit")).agg(has("BUILDING", 9000).alias("fe"), has("MACHINERY", 9000).alias("be"), has("FURNITURE", 8000).alias("inf"), has("HOUSEHOLD", 9000).alias("lib"), has("AUTOMOBILE", 9500).alias("rt"))
    return g.select("unit", scoring.role(F.col("fe"), F.col("be"), F.col("inf"), F.col("lib"), F.col("rt")).alias("role"))


@query(f"WITH {_SIGNALS} r AS (SELECT doc_id, signal, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, signal) AS rank FROM sig) SELECT doc_id AS unit, signal, rank::INTEGER AS rank FROM r WHERE rank <= 3")
def evidence_top3(spark, d):
    rules = F.array(*[F.struct(F.lit(a).alias("signal"), F.lit(b).alias("pattern"), F.lit(w).alias("weight")) for a, b, w, _, _ in MARKERS])
    s = table(spark, d, "documents").select(F.col("doc_id").alias("unit"), "text", F.explode(rules).alias("r")).where(F.regexp(F.col("text"), F.col("r.pattern"))).select("unit", "r.signal", "r.weight")
    return scoring.top_k(s, ["unit"], [F.desc("weight"), F.asc("signal")], 3).select("unit", "signal", "rank")


@query("SELECT p_type AS kind, count(*) AS components FROM part GROUP BY p_type ORDER BY components DESC, kind LIMIT 4")
def kinds_top4(spark, d):
    return records.top_kinds(table(spark, d, "part"), "p_type", 4)


@query("SELECT p_name AS name, max(p_size)::INTEGER AS confidence, count(DISTINCT p_brand) AS evidence FROM part GROUP BY p_name")
def technology_unique_max_conf(spark, d):
    return records.unique_technologies(table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("confidence"), F.col("p_brand").alias("source")))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def overlay_last_wins(spark, d):
    return merge.overlay(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("""SELECT o_custkey AS symbol, arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS framework_kind, max(o_orderkey % 100)::INTEGER AS confidence,
 string_agg('a' || o_orderkey, ',' ORDER BY o_orderkey) AS attributes, string_agg('e' || o_orderkey, ',' ORDER BY o_orderkey) AS evidence FROM orders GROUP BY o_custkey""")
def symbol_merge_max_conf(spark, d):
    s = table(spark, d, "orders").selectExpr(
        "'orders' AS unit", "o_custkey AS symbol", "o_orderkey AS seq", "CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS framework_kind",
        "array(concat('a', o_orderkey)) AS attributes", "array(concat('e', o_orderkey)) AS evidence", "CAST(o_orderkey % 100 AS INT) AS confidence",
    )
    return merge.merge_symbols(s).select("symbol", "framework_kind", "confidence", F.array_join("attributes", ",").alias("attributes"), F.array_join("evidence", ",").alias("evidence"))


@query("SELECT doc_id, (CASE WHEN l.doc_id IS NULL THEN 90 ELSE 50 + l.quality * 10 END)::INTEGER AS confidence, CASE WHEN l.doc_id IS NULL THEN 'default' ELSE 'label' END AS evidence FROM documents LEFT JOIN labels l USING (doc_id)".replace("SELECT doc_id", "SELECT documents.doc_id"))
def metadata_defaults_antijoin(spark, d):
    known = table(spark, d, "labels").selectExpr("doc_id", "CAST(50 + quality * 10 AS INT) AS confidence", "'label' AS evidence")
    return merge.with_defaults(table(spark, d, "documents"), known, ["doc_id"], merge.DEFAULTS["symbol"], "default")


@query("SELECT 'doc/' || doc_id AS rel_path, n_chars > 20000 AS too_large FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fallback_files_antijoin(spark, d):
    files = table(spark, d, "documents").selectExpr("'all' AS unit", "concat('doc/', doc_id) AS rel_path", "n_chars AS size")
    known = table(spark, d, "labels").selectExpr("'all' AS unit", "concat('doc/', doc_id) AS file")
    return merge.fallback_files(files, known, 20000).select("rel_path", "too_large")


_AUDIT = """a AS (SELECT n_regionkey AS repository, count(DISTINCT c_custkey) AS components, count(o_orderkey) AS dependencies, count(CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 499000 THEN 1 END) AS errors,
 count(CASE WHEN o_orderpriority = '2-HIGH' AND o_totalprice > 499000 THEN 1 END) AS warnings, bool_and(coalesce(o_totalprice, 1) > 0) AS graph_ok, bool_and(c_acctbal > -999) AS clean FROM nation JOIN customer ON n_nationkey = c_nationkey LEFT JOIN orders ON c_custkey = o_custkey GROUP BY n_regionkey)"""


def _audit(spark, d):
    """Customers stand for units: a row each, rolled up by region."""
    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    j = c.join(F.broadcast(n.select("n_nationkey", "n_regionkey")), c.c_nationkey == n.n_nationkey).join(o, c.c_custkey == o.o_custkey, "left")  # a nation table is 25 rows
    big = F.col("o_totalprice") > 499000
    units = j.groupBy(F.col("n_regionkey").alias("repository"), "c_custkey").agg(
        F.lit(1).cast("long").alias("components"), F.count("o_orderkey").alias("dependencies"), F.count_if((F.col("o_orderpriority") == "1-URGENT") & big).alias("errors"),
        F.count_if((F.col("o_orderpriority") == "2-HIGH") & big).alias("warnings"), F.bool_and(F.coalesce("o_totalprice", F.lit(1.0)) > 0).alias("graph_ok"), F.bool_and(F.col("c_acctbal") > -999).alias("clean"),
    )
    return records.audit_rollup(units)


@query(f"WITH {_AUDIT} SELECT * FROM a")
def audit_record_rollup(spark, d):
    return _audit(spark, d)


@query(f"WITH {_AUDIT} SELECT repository, CASE WHEN NOT graph_ok OR errors > 0 THEN 'PARTIAL' WHEN NOT clean OR warnings > 0 THEN 'WARNINGS' ELSE 'COMPLETED' END AS status FROM a")
def audit_status(spark, d):
    return _audit(spark, d).select("repository", scoring.audit_status(F.col("graph_ok"), F.col("clean"), F.col("errors"), F.col("warnings")).alias("status"))


@query("""WITH e AS (SELECT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT repository, count(*) AS edges FROM (SELECT a AS repository FROM e UNION ALL SELECT b FROM e WHERE a <> b) GROUP BY repository""")
def cross_counts_per_repository(spark, d):
    li, o, c, s = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return records.cross_counts(j, "s_nationkey", "c_nationkey")


@query("SELECT s_suppkey AS unit, n_name AS executable, coalesce(v, 'any') AS version, v IS NOT NULL AS available FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (VALUES ('nation_1', '1.0'), ('nation_7', '7.2'), ('nation_20', '20')) t(k, v) ON lower(n_name) = k")
def runtime_tool_left_join(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    req = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("unit"), F.col("n_name").alias("executable"))
    tools = spark.createDataFrame([("Nation_1", "1.0"), ("Nation_7", "7.2"), ("NATION_20", "20")], "executable string, version string")
    return capsule.tool_status(req, tools)


@query("SELECT p_partkey, p_name, p_type FROM (SELECT p_partkey, p_name, p_type FROM part ORDER BY p_name, p_partkey LIMIT 80 OFFSET 80)")
def paginate_components(spark, d):
    return records.page(table(spark, d, "part").select("p_partkey", "p_name", "p_type"), [F.col("p_name"), F.col("p_partkey")], 2, 80)


@query("SELECT p_partkey, p_name FROM part WHERE p_type = 'ECONOMY' AND contains(lower(p_name), 'bolt')")
def filter_components(spark, d):
    return records.search(table(spark, d, "part"), "Bolt", ("p_name",), p_type="ECONOMY").select("p_partkey", "p_name")


@query("""WITH c AS (SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS links FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey, c_name, CASE WHEN links IS NULL THEN 'unmatched' ELSE 'matched' END AS state, coalesce(links, '') AS links FROM customer LEFT JOIN c ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""")
def endpoint_rows_filter(spark, d):
    ends = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    links = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return records.endpoint_rows(ends, links, "c_custkey", "o_orderkey")


@query("""SELECT c_custkey AS unit, o_orderkey AS entrypoint, CASE WHEN o_orderkey IS NULL THEN 'unmatched' ELSE 'matched' END AS state FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'""")
def consumer_rows(spark, d):
    calls = table(spark, d, "customer").selectExpr("c_custkey AS unit", "c_name AS file", "'get' AS method", "c_mktsegment").withColumn("path", F.concat(F.lit("/x/${id}/"), "c_mktsegment"))
    links = table(spark, d, "orders").where("o_orderstatus = 'F'").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    links = links.selectExpr("c_custkey AS source_unit", "c_name AS consumer_file", "'GET' AS method", "concat('/x/:id/', c_mktsegment) AS path", "o_orderkey AS entrypoint")
    return records.consumer_rows(calls, links).select("unit", "entrypoint", "state")


@query("""SELECT o_orderkey AS repository, o_custkey, coalesce(c_name, CAST(o_orderkey AS VARCHAR)) AS repository_name FROM orders LEFT JOIN (SELECT c_custkey * 4 AS id, c_name FROM customer) ON id = o_orderkey""")
def audit_names(spark, d):
    audits = table(spark, d, "orders").select(F.col("o_orderkey").alias("repository"), "o_custkey")
    return records.audits_with_names(audits, table(spark, d, "customer").select((F.col("c_custkey") * 4).alias("id"), F.col("c_name").alias("name")))


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey FROM orders")
def newest_first(spark, d):
    rows = records.newest_first(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")
    return export.numbered(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")]).select((F.col("i") + 1).alias("place"), "o_orderkey")


@query("""WITH a AS (SELECT o_custkey AS w, o_orderkey AS id, o_orderstatus AS said FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_custkey AS w, o_orderkey AS id, CASE WHEN o_orderkey % 31 = 0 THEN 'x' ELSE o_orderstatus END AS found FROM orders WHERE o_orderkey % 11 <> 0)
SELECT coalesce(a.w, b.w) AS workspace, bool_and(coalesce(said = found, false)) AS valid FROM a FULL JOIN b ON a.w = b.w AND a.id = b.id GROUP BY 1""")
def cache_validity(spark, d):
    o = table(spark, d, "orders")
    registry = o.where("o_orderkey % 7 <> 0").selectExpr("o_custkey AS workspace", "o_orderkey AS id", "o_orderstatus AS path")
    cache = o.where("o_orderkey % 11 <> 0").selectExpr("o_custkey AS workspace", "o_orderkey AS id", "CASE WHEN o_orderkey % 31 = 0 THEN 'x' ELSE o_orderstatus END AS path")
    return records.cache_validity(registry, cache)


@query("""SELECT c_custkey, id, id <> '' AND NOT contains(id, '/') AND id <> '..' AS safe, CASE WHEN c_custkey % 4 = 0 THEN 'https://github.com/x/r' || c_custkey WHEN c_custkey % 4 = 1 THEN 'ssh://h.org/R' || c_custkey END AS remote
FROM (SELECT c_custkey, c_name, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'a/' || c_name WHEN 2 THEN '..' ELSE c_name END AS id FROM customer)""")
def safe_names(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey", "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('a/', c_name) WHEN 2 THEN '..' ELSE c_name END AS id",
        "CASE c_custkey % 4 WHEN 0 THEN concat('https://GitHub.com/X/R', c_custkey, '.git') WHEN 1 THEN concat('git@H.org:R', c_custkey, '/') WHEN 2 THEN concat('https://u:p@h.org/R', c_custkey) ELSE concat('http://h.org/R', c_custkey) END AS url")
    return c.select("c_custkey", "id", records.is_safe_id(F.col("id")).alias("safe"), records.remote_identity(F.col("url")).alias("remote"))


@query("""SELECT o_custkey AS "case", max(CASE WHEN r = 1 THEN d END) AS cold_ms, coalesce(avg(CASE WHEN r > 1 THEN d END), max(CASE WHEN r = 1 THEN d END)) AS warm_average_ms, quantile_disc(d, 0.95) AS p95_ms
FROM (SELECT o_custkey, (o_orderkey % 100 + 1)::DOUBLE AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY o_custkey""")
def benchmark_stats(spark, d):
    runs = table(spark, d, "orders").selectExpr("o_custkey AS case", "CAST(o_orderkey % 100 + 1 AS DOUBLE) AS duration_ms", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run", "100 AS files")
    return records.benchmark_stats(runs).select("case", "cold_ms", "warm_average_ms", "p95_ms")


@query("""WITH u AS (SELECT DISTINCT n_regionkey AS unit FROM nation), c AS (SELECT n_regionkey AS unit, '{"unit":' || n_regionkey || ',"id":"' || n_name || '"}' AS key FROM nation), f AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY key) AS n FROM c)
SELECT unit, -1 AS section, '' AS key, CASE WHEN unit = (SELECT min(unit) FROM u) THEN '{"units": [' ELSE ',' END || '{"unit": ' || unit AS line FROM u UNION ALL SELECT unit, 0, '', ', "components": [' FROM u
UNION ALL SELECT unit, 0, key, CASE WHEN n = 1 THEN '' ELSE ',' END || key FROM f UNION ALL SELECT unit, 1, '', ']' FROM u UNION ALL SELECT unit, 2, '', CASE WHEN unit = (SELECT max(unit) FROM u) THEN '}]}' ELSE '}' END FROM u""")
def json_model_lines(spark, d):
    n = table(spark, d, "nation").selectExpr("n_regionkey AS unit", "n_name AS id")
    return export.json_lines(n, {"components": n})


_CHECKS = """d AS (SELECT source AS unit, doc_id, sha256(text) AS h FROM documents), c AS (SELECT unit, count(CASE WHEN doc_id % 97 = 0 AND unit <> 'src3' THEN 1 END) AS lost, count(CASE WHEN doc_id % 89 = 0 THEN 1 END) AS drifted, count(*) AS declared FROM d GROUP BY unit),
v AS (SELECT unit, 'manifest' AS name, true AS passed, declared::VARCHAR AS detail FROM c UNION ALL SELECT unit, 'file-inventory', lost = 0, lost::VARCHAR FROM c UNION ALL SELECT unit, 'content-integrity', x = 0, x::VARCHAR FROM (SELECT unit, count(CASE WHEN doc_id % 89 = 0 AND NOT (doc_id % 97 = 0 AND unit <> 'src3') THEN 1 END) AS x FROM d GROUP BY unit)
 UNION ALL SELECT unit, 'payload-integrity', x = 0, x::VARCHAR FROM (SELECT unit, count(CASE WHEN doc_id % 89 = 0 OR (doc_id % 97 = 0 AND unit <> 'src3') THEN 1 END) AS x FROM d GROUP BY unit))"""


def _checks(spark, d):
    f = table(spark, d, "documents").selectExpr("source AS unit", "CAST(doc_id AS STRING) AS rel_path", "sha2(text, 256) AS sha256", "doc_id")
    actual = f.where(~((F.col("doc_id") % 97 == 0) & (F.col("unit") != "src3"))).withColumn("sha256", F.when(F.col("doc_id") % 89 == 0, "drift").otherwise(F.col("sha256")))
    return capsule.verification_checks(actual, f)


@query(f"WITH {_CHECKS} SELECT * FROM v")
def verification_checks(spark, d):
    return _checks(spark, d)


@query(f"WITH {_CHECKS} SELECT unit, count(CASE WHEN passed THEN 1 END) AS passed, count(*) AS total, floor(100.0 * count(CASE WHEN passed THEN 1 END) / count(*))::INTEGER AS readiness FROM v GROUP BY unit")
def readiness_score(spark, d):
    return capsule.readiness_scores(_checks(spark, d))


@query("""WITH c AS (SELECT source AS unit, 'c' || (doc_id % 50) AS id, 'doc/' || doc_id AS file FROM documents), s AS (SELECT DISTINCT unit, file FROM c WHERE id IN ('c1', 'c2', 'c3'))
SELECT unit, file FROM s UNION SELECT DISTINCT unit, 'package.json' FROM s""")
def capsule_files(spark, d):
    docs = table(spark, d, "documents")
    comps = docs.selectExpr("source AS unit", "concat('c', doc_id % 50) AS id", "concat('doc/', doc_id) AS file")
    nodes = docs.select(F.col("source").alias("unit")).distinct().withColumn("node", F.explode(F.array(*map(F.lit, ("c1", "c2", "c3")))))
    files = docs.select(F.col("source").alias("unit")).distinct().withColumn("rel_path", F.lit("package.json"))
    return capsule.capsule_files(nodes, comps, files)


@query("SELECT 'all' AS unit, 'doc/' || doc_id AS file FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def capsule_missing(spark, d):
    wanted = table(spark, d, "documents").selectExpr("'all' AS unit", "concat('doc/', doc_id) AS file")
    have = table(spark, d, "labels").where("quality = 1").selectExpr("'all' AS unit", "concat('doc/', doc_id) AS rel_path")
    return capsule.missing_files(wanted, have)


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.5) AS p50 FROM lineitem GROUP BY l_returnflag")
def percentile_nearest_rank(spark, d):
    return records.nearest_rank(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p95": 0.95, "p50": 0.5})


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01')
SELECT o_orderkey, change FROM (SELECT coalesce(b.k, a.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'changed' END AS change FROM b FULL JOIN a ON a.k = b.k) WHERE change IS NOT NULL""")
def snapshot_state_diff(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    before = o.where("o_orderdate < TIMESTAMP '1998-01-01'")
    after = o.where("o_orderdate >= TIMESTAMP '1995-01-01'").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return merge.state_diff(before, after, ["o_orderkey"], "o_orderstatus")


@query("SELECT unit, file FROM (SELECT source AS unit, 'pkg' || (doc_id % 10) || '/doc/' || doc_id AS file, doc_id FROM documents) WHERE NOT (doc_id % 10 = 3 OR (doc_id % 10 = 4 AND unit = 'src2'))")
def exclude_nested_units(spark, d):
    rows = table(spark, d, "documents").selectExpr("source AS unit", "concat('pkg', doc_id % 10, '/doc/', doc_id) AS file")
    units = rows.select("unit").distinct()
    roots = units.select("unit", F.lit("pkg3/doc").alias("root")).unionByName(units.where("unit = 'src2'").select("unit", F.lit("pkg4").alias("root")))
    return merge.exclude_roots(rows, roots)


@query("SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages, sum(n_chars)::BIGINT AS chars FROM documents")
def workspace_status(spark, d):
    docs = table(spark, d, "documents")
    return records.summary({"documents": (docs, "doc_id"), "sources": (docs, "source"), "languages": (docs, "lang")}, {"chars": (docs, "n_chars")})
