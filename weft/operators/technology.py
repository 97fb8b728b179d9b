"""Technologies of a unit: languages, databases, build tools, frameworks, runtimes; with scored evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scoring
from .graph import keep_first

#: Database, markers in lower-case text. Fixed values.
DATABASES = [
    ("PostgreSQL", ("org.postgresql", "jdbc:postgresql://", "postgres://", "postgresql://", "image: postgres")), ("MySQL", ("com.mysql", "jdbc:mysql://", "mysql://", "image: mysql")),
    ("MariaDB", ("org.mariadb", "jdbc:mariadb://", "mariadb://", "image: mariadb")), ("SQL Server", ("mssql-jdbc", "jdbc:sqlserver://", "sqlserver://", "image: mssql")),
    ("Oracle", ("ojdbc", "jdbc:oracle:", "oracle://", "image: oracle")), ("SQLite", ("sqlite-jdbc", "jdbc:sqlite:", "sqlite://", "image: sqlite")),
    ("MongoDB", ("mongodb://", "mongodb+srv://", "mongodb")), ("Redis", ("redis://", "redis", "image: redis")),
]
#: Files that configure: what their lower-case names hold, their whole name, or their ending. Fixed values.
CONFIGURES = r"pom|gradle|package|application|docker|^\.env$|\.(?:yml|yaml|properties|json|toml)$"
#: Tool, category, pattern of the file's name, executable, confidence. Of tools of one line, the first wins.
BUILD_TOOLS = [
    ("Maven", "jvm", r"^pom\.xml$", "mvn", 100), ("Gradle", "jvm", r"^build\.gradle(\.kts)?$", "gradle", 100), ("npm", "node", r"^package-lock\.json$", "npm", 100), ("pnpm", "node", r"^pnpm-lock\.yaml$", "pnpm", 100),
    ("Yarn", "node", r"^yarn\.lock$", "yarn", 100), ("Cargo", "rust", r"^Cargo\.toml$", "cargo", 100), ("Go Modules", "go", r"^go\.mod$", "go", 100), ("Composer", "php", r"^composer\.json$", "composer", 100),
    ("Vite", "bundler", r"^vite\.config\.\w+$", "vite", 85), ("Webpack", "bundler", r"^webpack\.config\.\w+$", "webpack", 85), ("Docker", "container", r"^Dockerfile$", "docker", 95),
]
FRONTEND = ("Angular", "React", "Next.js", "Vue", "Nuxt", "Svelte", "SvelteKit", "Astro", "Blazor")
BACKEND = ("NestJS", "Express", "Fastify", "Hono", "Django", "FastAPI", "Flask", "ASP.NET", "Symfony", "Laravel", "Rails", "Spring Boot", "Quarkus", "Micronaut", "Ktor", "Phoenix", "Go web", "Rust web")


def languages(files: DataFrame) -> DataFrame:
    return files.where("language <> 'Unknown'").groupBy("unit", F.col("language").alias("name")).agg(F.count(F.lit(1)).alias("files")).select("unit", F.lit("Language").alias("category"), "name", F.lit(100).alias("confidence"), F.lit("DIRECT").alias("detection_kind"))


def database_names(text: Column) -> Column:
    """The databases that a lower-case text names by any of their markers."""
    any_of = lambda markers: F.exists(F.array(*map(F.lit, markers)), lambda m: text.contains(m))
    return F.array_compact(F.array(*[F.when(any_of(markers), F.lit(n)) for n, markers in DATABASES]))


def reads_as_sql(text: Column) -> Column:
    """Whether a lower-case text holds a query."""
    return text.contains("@query(nativequery = true)") | (text.contains("select ") & text.contains(" from "))


def databases(files: DataFrame) -> DataFrame:
    """65 and 12 for each of up to three files that configure and hold a marker; SQL itself from .sql files or from a query in any file."""
    low = F.lower(F.coalesce("text", F.lit("")))
    found = files.where(F.lower("name").rlike(CONFIGURES)).select("unit", F.explode(database_names(low)).alias("name")).groupBy("unit", "name").agg(F.count(F.lit(1)).alias("n"))
    out = found.select("unit", F.lit("Database").alias("category"), "name", scoring.database_confidence(F.col("n")).alias("confidence"), F.lit("DIRECT").alias("detection_kind"))
    sql = files.where((F.col("ext") == "sql") | reads_as_sql(low)).select("unit").distinct()
    return out.unionByName(sql.select("unit", F.lit("Query Language").alias("category"), F.lit("SQL").alias("name"), F.lit(90).alias("confidence"), F.lit("DIRECT").alias("detection_kind")))


#: Marker in lower-case text, what it stands for. Fixed values.
MAPPERS = [("Hibernate", r"hibernate"), ("JPA", r"spring-data-jpa|javax\.persistence|jakarta\.persistence"), ("Prisma", r"prisma"), ("TypeORM", r"typeorm"), ("Sequelize", r"sequelize")]


def mappers(files: DataFrame) -> DataFrame:
    """Object-relational mappers that any file names."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = F.array_compact(F.array(*[F.when(low.rlike(p), n) for n, p in MAPPERS]))
    return files.select("unit", F.explode(hits).alias("name")).distinct().select("unit", F.lit("ORM").alias("category"), "name", F.lit(80).alias("confidence"), F.lit("DIRECT").alias("detection_kind"))


#: Category and names without ".", "-", "_" and blanks, their class; the last of a category is for all other names. Fixed values.
CLASSES = [
    ("language", ("sql", "graphql"), "Query Language"), ("language", ("html", "xml"), "Markup Language"), ("language", ("css", "scss"), "Style Language"), ("language", (), "Programming Language"),
    ("framework", ("angular", "vue", "nuxt", "svelte", "sveltekit", "nextjs"), "Frontend Framework"), ("framework", (), "Backend Framework"), ("library", ("react",), "UI Library"),
    ("data", ("hibernate", "prisma", "typeorm", "sequelize", "jpa"), "ORM"), ("data", (), "Database"), ("build", ("npm", "pnpm", "yarn", "composer"), "Package Manager"), ("build", ("webpack",), "Bundler"), ("build", (), "Build Tool"),
    ("runtime", (), "Runtime"), ("infrastructure", ("docker",), "Containerization"),
]
#: Names without ".", "-", "_" and blanks, what they are called. Fixed values.
CANONICAL = [
    (("postgres", "postgresql", "orgpostgresql"), "PostgreSQL"), (("spring", "springboot", "orgspringframeworkboot"), "Spring Boot"), (("node", "nodejs"), "Node.js"), (("typescript",), "TypeScript"),
    (("javascript",), "JavaScript"), (("dotnet", "aspnet", "aspnetcore"), "ASP.NET Core"), (("reactjs",), "React"),
]


def _bare(name: Column) -> Column:
    return F.translate(F.lower(name), ".-_ ", "")


def classification(category: Column, name: Column) -> Column:
    out = F.lit("Tool")
    for c, names, kind in reversed(CLASSES):
        on = F.lower(category) == c
        out = F.when(on & _bare(name).isin(*names) if names else on, kind).otherwise(out)
    return out


def canonical_name(name: Column) -> Column:
    out = name
    for names, called in CANONICAL:
        out = F.when(_bare(name).isin(*names), called).otherwise(out)
    return out


def with_evidence(technologies: DataFrame, detections: DataFrame) -> DataFrame:
    """technologies(unit, name, ...) with the evidence of the detection of the same name, without regard to case; of several the surest."""
    d = keep_first(detections.withColumn("key", F.lower("name")), ["unit", "key"], [F.desc("confidence"), F.asc("name")]).select("unit", "key", "evidence")
    return technologies.withColumn("key", F.lower("name")).join(d, ["unit", "key"], "left").drop("key")


def build_tools(files: DataFrame) -> DataFrame:
    """unit, name, executable, line, ord of tools found."""
    hits = [F.when(F.col("name").rlike(p), F.struct(F.lit(n).alias("name"), F.lit(c).alias("line"), F.lit(x).alias("executable"), F.lit(i).alias("ord"), F.lit(conf).alias("confidence"))) for i, (n, c, p, x, conf) in enumerate(BUILD_TOOLS)]
    found = files.select("unit", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("unit", "h.*").distinct()
    first = keep_first(found.where(F.col("line").isin("jvm", "node")), ["unit", "line"], [F.asc("ord")])
    return first.unionByName(found.where(~F.col("line").isin("jvm", "node")))


def technologies(files: DataFrame, detections: DataFrame) -> DataFrame:
    """unit, category, name, confidence, detection_kind: the surest of each category and name; weak detections are left out."""
    tools = build_tools(files).select("unit", F.lit("Build Tool").alias("category"), "name", "confidence", F.lit("DIRECT").alias("detection_kind"))
    inferred = ~F.exists("evidence", lambda e: e["kind"].isin(*scoring.DIRECT))
    frameworks = detections.where("actionable").select("unit", F.lit("Framework").alias("category"), "name", "confidence", F.when(inferred, "INFERRED").otherwise("DIRECT").alias("detection_kind"))
    return keep_first(languages(files).unionByName(databases(files)).unionByName(mappers(files)).unionByName(tools).unionByName(frameworks), ["unit", "category", "name"], [F.desc("confidence"), F.asc("detection_kind")])


def runtime_requirements(files: DataFrame) -> DataFrame:
    """unit, name, executable, version_hint, required_by from build tools and version fields of manifests."""
    tools = build_tools(files).select("unit", "name", "executable", F.lit(None).cast("string").alias("version_hint"), F.col("name").alias("required_by"))
    hint = lambda name, exe, file, pattern: files.where(F.col("name") == file).select("unit", F.lit(name).alias("name"), F.lit(exe).alias("executable"), F.regexp_extract(F.coalesce("text", F.lit("")), pattern, 1).alias("version_hint"), F.lit(file).alias("required_by")).where("version_hint <> ''")
    java = hint("Java", "java", "pom.xml", r"<(?:java\.version|maven\.compiler\.release|maven\.compiler\.source)>([^<]+)<")
    node = hint("Node.js", "node", "package.json", r'"node"\s*:\s*"([^"]+)"')
    php = hint("PHP", "php", "composer.json", r'"php"\s*:\s*"([^"]+)"')
    return tools.unionByName(java).unionByName(node).unionByName(php).distinct()


def diagnostics(files: DataFrame, detections: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """unit, level, code, message, file."""
    large = files.where("oversized").select("unit", F.lit("warning").alias("level"), F.lit("source-too-large").alias("code"), F.lit("over the size limit").alias("message"), F.col("rel_path").alias("file"))
    quiet = detections.where("actionable").select("unit", F.col("name").alias("framework")).join(entrypoints.select("unit", "framework").distinct(), ["unit", "framework"], "left_anti")
    quiet = quiet.select("unit", F.lit("info").alias("level"), F.lit("framework-no-static-entrypoints").alias("code"), F.col("framework").alias("message"), F.lit(None).cast("string").alias("file"))
    plain = files.where("language = 'PHP'").select("unit").distinct().join(detections.where(F.col("actionable") & F.col("name").isin("Laravel", "Symfony")).select("unit"), "unit", "left_anti")
    plain = plain.select("unit", F.lit("info").alias("level"), F.lit("generic-php-fallback").alias("code"), F.lit("no PHP framework found").alias("message"), F.lit(None).cast("string").alias("file"))
    return large.unionByName(quiet).unionByName(plain)


def unit_summary(files: DataFrame, detections: DataFrame, components: DataFrame, dependencies: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """One row a unit: counts, level and role."""
    count = lambda df, name: df.groupBy("unit").agg(F.count(F.lit(1)).alias(name))
    has = lambda names: F.bool_or(F.col("actionable") & F.col("name").isin(*names))
    d = detections.groupBy("unit").agg(has(FRONTEND).alias("frontend"), has(BACKEND).alias("backend"), F.bool_or("actionable").alias("framework"))
    f = files.groupBy("unit").agg(
        F.count(F.lit(1)).alias("files"), F.bool_or(F.col("name") == "index.html").alias("page"), F.bool_or((F.col("name") == "Dockerfile") | (F.col("ext") == "tf")).alias("infra"),
        F.bool_or(F.coalesce((F.col("name") == "package.json") & F.col("text").rlike('"(main|exports|types)"'), F.lit(False))).alias("library"),
    )
    e = entrypoints.groupBy("unit").agg(F.count(F.lit(1)).alias("entrypoints"), F.bool_or(~F.col("name").startswith("ROUTE ")).alias("serves"), F.bool_or(F.col("name").startswith("ROUTE ")).alias("routes"))
    rows = f.join(d, "unit", "left").join(count(components, "components"), "unit", "left").join(count(dependencies, "dependencies"), "unit", "left").join(e, "unit", "left")
    rows = rows.fillna(False, ["frontend", "backend", "framework", "serves", "routes"]).fillna(0, ["components", "dependencies", "entrypoints"])
    level = scoring.compatibility(F.col("framework"), F.col("dependencies"), F.col("components"))
    role = scoring.role(F.col("frontend") | F.col("page"), F.col("backend") | F.col("serves"), F.col("infra"), F.col("library"), F.col("routes"))
    return rows.select("unit", "files", "components", "dependencies", "entrypoints", level.alias("level"), role.alias("role"))
