"""Source trees as one files table: repository, rel_path, name, ext, language, size, text, is_text.

Trees are read by Spark's binary file source, so listing and reading are spread
and any store that Spark reads will do. Everything else derives from this table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import sent
from ..session import cut_counted

#: Folder names that are never scanned, at any depth. Fixed values.
EXCLUDED_DIRS = (
    ".git", "node_modules", "target", "dist", "build", "out", "bin", "obj", "vendor", ".venv", "venv", ".gradle", "coverage", ".idea",
    ".vscode", ".next", ".nuxt", ".angular", ".svelte-kit", ".astro", ".turbo", ".nx", ".output", ".vercel", ".serverless", ".wrangler", ".dart_tool",
    ".terraform", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", "__pycache__", ".cache", "_build", "deps", "DerivedData", "storage",
)

#: Endings to languages. Fixed values.
LANGUAGES = {
    "java": "Java", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "py": "Python", "rs": "Rust", "go": "Go", "cs": "C#", "fs": "F#", "fsx": "F#",
    "php": "PHP", "kt": "Kotlin", "kts": "Kotlin", "rb": "Ruby", "dart": "Dart", "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++", "swift": "Swift", "scala": "Scala",
    "sh": "Shell", "bash": "Shell", "zsh": "Shell", "ps1": "Shell", "sql": "SQL", "html": "HTML", "htm": "HTML", "xml": "XML", "css": "CSS", "scss": "SCSS", "graphql": "GraphQL", "gql": "GraphQL",
    "vue": "Vue", "svelte": "Svelte", "astro": "Astro", "razor": "Razor", "ex": "Elixir", "exs": "Elixir",
}

MAX_SOURCE_BYTES = 2 << 20
#: Files that make their folder a unit. Fixed values.
MANIFESTS = (
    "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "package.json", "angular.json", "nx.json", "pnpm-workspace.yaml", "Cargo.toml", "pyproject.toml",
    "requirements.txt", "Pipfile", "go.mod", "composer.json", "Gemfile", "pubspec.yaml", "CMakeLists.txt", "mix.exs",
)


def is_excluded(rel_path: Column) -> Column:
    """Any folder on the way is excluded, or is cache inside bootstrap; only the relative path counts."""
    folders = F.split(F.regexp_replace(rel_path, "[^/]*$", ""), "/")
    return F.arrays_overlap(folders, F.array(*map(F.lit, EXCLUDED_DIRS))) | rel_path.rlike(r"(^|/)bootstrap/cache/")


def language_of(ext: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, ext), F.lit("Unknown"))


def described(rows: DataFrame, policy_excluded: bool = True) -> DataFrame:
    """rows(repository, rel_path, size, content) to the files table."""
    name = F.substring_index("rel_path", "/", -1)
    ext = F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    head = F.substring("content", 1, 8192).cast("string")
    is_text = F.is_valid_utf8(head) & (F.instr(head, "\0") == 0)
    out = rows.withColumn("name", name).withColumn("ext", ext).withColumn("language", language_of(F.col("ext"))).withColumn("is_text", is_text).withColumn("oversized", F.col("size") > MAX_SOURCE_BYTES)
    out = out.withColumn("sha256", F.sha2("content", 256)).withColumn("text", F.when(F.col("is_text") & ~F.col("oversized"), text)).drop("content")
    return out.where(~is_excluded(F.col("rel_path"))) if policy_excluded else out


def read_tree(spark: SparkSession, root: str, repository: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.substring_index("path", f"{base}/", -1)
    return described(raw.select(F.lit(repository).alias("repository"), rel.alias("rel_path"), F.col("length").alias("size"), "content"))


def from_texts(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """files table of (repository, rel_path, text) rows, for tests and examples."""
    df = spark.createDataFrame(rows, "repository string, rel_path string, t string")
    return described(df.select("repository", "rel_path", F.octet_length("t").cast("long").alias("size"), F.encode("t", "UTF-8").alias("content")))


def folder(rel_path: Column) -> Column:
    return F.regexp_replace(rel_path, "/?[^/]*$", "")


def discover_units(files: DataFrame) -> DataFrame:
    """repository, root: folders with a manifest; one that holds others only if it is an application itself; else the repository's root."""
    manifest = F.col("name").isin(*MANIFESTS) | F.col("name").rlike(r"\.(sln|csproj)$")
    dirs = files.where(manifest).select("repository", folder(F.col("rel_path")).alias("root")).distinct()
    parts = F.split("root", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    parents = dirs.where("root <> ''").select("repository", F.explode(ups).alias("root")).distinct()
    inner = dirs.join(parents, ["repository", "root"], "left_anti")
    outer = dirs.join(parents, ["repository", "root"], "left_semi").join(application_roots(files), ["repository", "root"], "left_semi")
    found = inner.unionByName(outer)
    bare = files.select("repository").distinct().join(found.select("repository").distinct(), "repository", "left_anti").withColumn("root", F.lit(""))
    return found.unionByName(bare)


def application_roots(files: DataFrame) -> DataFrame:
    """repository, root of folders that look like an application, by what lies in them."""
    f = files.select("repository", folder(F.col("rel_path")).alias("root"), "name", "text")
    t = F.coalesce("text", F.lit(""))
    web = F.col("name").isin("package.json") & t.rlike(r'"(react|vue|next|nuxt|@angular/core|svelte|express|fastify|hono|@nestjs/core|astro)"')
    signs = f.groupBy("repository", "root").agg(
        F.bool_or(F.col("name").isin("artisan", "angular.json", "manage.py")).alias("a"), F.bool_or(web).alias("b"),
        F.bool_or((F.col("name") == "go.mod")).alias("gm"), F.bool_or(F.col("name") == "main.go").alias("gmain"),
        F.bool_or((F.col("name") == "Cargo.toml") & t.contains("[package]")).alias("cargo"), F.bool_or((F.col("name") == "mix.exs") & t.contains(":phoenix")).alias("mix"),
        F.bool_or(F.col("name").rlike(r"\.csproj$") & t.rlike("Sdk.(Web|BlazorWebAssembly)")).alias("cs"), F.bool_or(F.col("name").isin("pom.xml", "build.gradle", "build.gradle.kts") & t.rlike("spring-boot|quarkus|micronaut|ktor")).alias("jvm"),
    )
    return signs.where("a OR b OR (gm AND gmain) OR cargo OR mix OR cs OR jvm").select("repository", "root")


def assign_units(files: DataFrame, units: DataFrame) -> DataFrame:
    """files with unit (repository/root) and rel_path inside it, once for each unit whose root is above the file.

    Units are counted, as few of them are sent to the files; else each file is shuffled with its text once for each folder above it."""
    parts = F.split("rel_path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    spread = files.withColumn("root", F.explode(ups)).join(sent(*cut_counted(units)), ["repository", "root"])
    inside = F.when(F.col("root") == "", F.col("rel_path")).otherwise(F.expr("substring(rel_path, length(root) + 2)"))
    return spread.withColumn("unit", F.concat_ws("/", "repository", F.when(F.col("root") != "", F.col("root")))).withColumn("rel_path", inside).drop("root")
