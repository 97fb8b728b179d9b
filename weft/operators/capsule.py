"""Capsules: what a slice needs copied, and whether a copy is whole.

Plans and checks are DataFrames; copying is left to the caller. A tree's digest is
taken over per-file digests in path order, so no file content leaves its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scoring

#: Files at a unit's root that go along with any slice. Fixed values.
ROOT_MANIFESTS = (
    "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradle.properties", "package.json", "package-lock.json", "yarn.lock",
    "pnpm-lock.yaml", "pnpm-workspace.yaml", "bun.lockb", "tsconfig.json", "jsconfig.json", "angular.json", "nx.json", "next.config.js", "next.config.mjs",
    "next.config.ts", "nuxt.config.js", "nuxt.config.ts", "svelte.config.js", "svelte.config.ts", "astro.config.mjs", "astro.config.ts", "vite.config.js", "vite.config.ts",
    "Cargo.toml", "Cargo.lock", "pyproject.toml", "requirements.txt", "Pipfile", "Pipfile.lock", "poetry.lock", "manage.py", "go.mod", "go.sum", "composer.json",
    "composer.lock", "artisan", "Gemfile", "Gemfile.lock", "mix.exs", "mix.lock", "pubspec.yaml", "pubspec.lock",
)


def capsule_files(nodes: DataFrame, components: DataFrame, files: DataFrame) -> DataFrame:
    """unit, file: files of the slice's components (unit, id, file) and the manifests at the roots of their units."""
    sources = components.join(nodes.select("unit", F.col("node").alias("id")).distinct(), ["unit", "id"], "left_semi").select("unit", "file").distinct()
    name = F.substring_index("rel_path", "/", -1)
    root = (~F.col("rel_path").contains("/")) & (name.isin(*ROOT_MANIFESTS) | name.rlike(r"\.(csproj|fsproj|sln)$"))
    manifests = files.where(root).join(sources.select("unit").distinct(), "unit", "left_semi").select("unit", F.col("rel_path").alias("file"))
    return sources.unionByName(manifests).distinct()


def missing_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the plan that do not exist."""
    return wanted.select("unit", "file").exceptAll(files.select("unit", F.col("rel_path").alias("file")).distinct())


def file_digests(files: DataFrame) -> DataFrame:
    return files.select("unit", "rel_path", F.sha2("text", 256).alias("sha256"))


def verification_checks(actual: DataFrame, declared: DataFrame) -> DataFrame:
    """unit, name, passed, detail: file inventory and content of actual(unit, rel_path, sha256) against declared."""
    a = actual.select("unit", "rel_path", F.col("sha256").alias("is"))
    d = declared.select("unit", "rel_path", F.col("sha256").alias("said"))
    both = a.join(d, ["unit", "rel_path"], "full_outer").groupBy("unit").agg(
        F.count_if(F.col("is").isNull()).alias("lost"), F.count_if(F.col("said").isNull()).alias("extra"),
        F.count_if(F.col("is") != F.col("said")).alias("drifted"), F.count_if(F.col("said").isNotNull()).alias("declared"),
    )
    check = lambda name, ok, detail: F.struct(F.lit(name).alias("name"), ok.alias("passed"), detail.cast("string").alias("detail"))
    checks = F.array(
        check("manifest", F.col("declared") > 0, F.col("declared")), check("file-inventory", (F.col("lost") + F.col("extra")) == 0, F.col("lost") + F.col("extra")),
        check("content-integrity", F.col("drifted") == 0, F.col("drifted")), check("payload-integrity", (F.col("lost") + F.col("drifted")) == 0, F.col("lost") + F.col("drifted")),
    )
    return both.select("unit", F.explode(checks).alias("c")).select("unit", "c.name", "c.passed", "c.detail")


def tree_digest(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, files, sha256: a digest over paths and digests of a tree's files(rel_path, sha256), whatever their order.

    Sums of 64-bit pieces of the per-file digests: no group's files are brought together."""
    one = F.sha2(F.concat_ws("\0", "rel_path", "sha256"), 256)
    pieces = [F.sum(F.conv(F.substring(one, 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")) for i in range(4)]
    g = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.concat_ws(":", F.count(F.lit(1)).cast("string"), *[p.cast("string") for p in pieces]).alias("__s"))
    return g.select(*keys, "files", F.sha2("__s", 256).alias("sha256"))


def structural_checks(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """capsule, name, passed, detail: the eleven checks of a capsule's structure.

    manifests(capsule, text) are the texts of capsule.toml; files(capsule, area, rel_path, sha256, symlink, text) what lies in
    the capsule, area being "source" or "environment". A manifest without SHA-256 digests, of an older capsule, passes those checks."""
    value = lambda section, key: F.nullif(F.regexp_extract("text", rf"(?s)\[{section}\](?:(?!\n\[).)*?\n\s*{key}\s*=\s*\"?([^\"\n]*)\"?", 1), F.lit(""))
    m = manifests.select(
        "capsule", F.col("text").contains("[capsule]").alias("is_manifest"), F.coalesce(value("metrics", "files"), value("capsule", "files")).alias("declared"), value("target", "value").alias("target"),
        value("integrity", "source_fingerprint").alias("source_fp"), value("integrity", "payload_fingerprint").alias("payload_fp"), value("integrity", "source_sha256").alias("source_sha"),
        value("integrity", "payload_sha256").alias("payload_sha"), F.coalesce(value("source", "root"), F.lit("")).alias("root"),
    )
    source = tree_digest(files.where("area = 'source'"), ["capsule"]).select("capsule", "files", F.col("sha256").alias("source_is"))
    payload = tree_digest(files, ["capsule"]).select("capsule", F.col("sha256").alias("payload_is"))
    other = files.groupBy("capsule").agg(F.count_if("symlink").alias("links"), F.bool_or((F.col("area") == "environment") & (F.col("rel_path") == "required.env") & F.coalesce(F.col("text"), F.lit("")).rlike(r"(?m)^\s*(?:\w+_)?CAPSULE=true\s*$")).alias("env"))
    j = m.join(source, "capsule", "full_outer").join(payload, "capsule", "full_outer").join(other, "capsule", "left")
    n, no = F.coalesce("files", F.lit(0)), F.lit(False)
    same = lambda said, found: F.coalesce(F.col(said) == F.col(found), no)
    told = lambda said, found: F.concat(F.lit("declared "), F.coalesce(F.col(said), F.lit("missing")), F.lit(", found "), F.coalesce(F.col(found).cast("string"), F.lit("nothing")))
    absolute = F.col("root").rlike(r"^(/|\\|[A-Za-z]:)") | F.col("root").rlike(r"(^|/)\.\.(/|$)")
    checks = [
        ("manifest", F.coalesce("is_manifest", no), F.lit("capsule.toml")), ("source", n > 0, F.concat(n.cast("string"), F.lit(" files"))), ("file-inventory", F.coalesce(F.col("declared") == n.cast("string"), no), told("declared", "files")),
        ("content-integrity", same("source_fp", "source_is"), told("source_fp", "source_is")), ("payload-integrity", same("payload_fp", "payload_is"), told("payload_fp", "payload_is")),
        ("content-integrity-sha256", F.col("source_sha").isNull() | same("source_sha", "source_is"), told("source_sha", "source_is")), ("payload-integrity-sha256", F.col("payload_sha").isNull() | same("payload_sha", "payload_is"), told("payload_sha", "payload_is")),
        ("symlink-safety", F.coalesce("links", F.lit(0)) == 0, F.concat(F.coalesce("links", F.lit(0)).cast("string"), F.lit(" links"))), ("portable-source-root", ~F.coalesce(absolute, no), F.col("root")),
        ("target", F.col("target").isNotNull(), F.coalesce("target", F.lit("target missing"))), ("environment", F.coalesce("env", no), F.lit("required.env")),
    ]
    rows = F.array(*[F.struct(F.lit(name).alias("name"), ok.alias("passed"), detail.alias("detail")) for name, ok, detail in checks])
    return j.select("capsule", F.explode(rows).alias("c")).select("capsule", "c.name", "c.passed", "c.detail")


def list_capsules(manifests: DataFrame) -> DataFrame:
    """target, path of capsules from manifests(path, text) of capsule.toml files, hidden folders left out, in order."""
    target = F.regexp_extract("text", r'(?s)\[target\](?:(?!\n\[).)*?\n\s*value\s*=\s*"([^"\n]*)"', 1)
    return manifests.where(F.col("path").rlike(r"(^|/)capsule\.toml$") & ~F.col("path").rlike(r"(^|/)\.[^/]+/")).select(target.alias("target"), F.regexp_replace("path", "/?capsule\\.toml$", "").alias("path")).orderBy("target", "path")


def readiness_scores(checks: DataFrame) -> DataFrame:
    return checks.groupBy("unit").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total")).withColumn("readiness", scoring.readiness(F.col("passed"), F.col("total")))


#: Manifest, runtime, command, whether the command needs a network. Fixed values.
SANDBOX = [
    ("pom.xml", "Java/Maven", "mvn -o -DskipTests package", False), ("build.gradle", "Java/Gradle", "gradle --offline build -x test", False), ("build.gradle.kts", "Java/Gradle", "gradle --offline build -x test", False),
    ("package.json", "Node.js", "npm test --if-present && npm run build --if-present", True), ("Cargo.toml", "Rust", "cargo check --locked --offline", False),
    ("composer.json", "PHP/Composer", "composer validate --no-check-publish", False), ("requirements.txt", "Python", "python -m compileall .", False), ("pyproject.toml", "Python", "python -m compileall .", False),
]


def sandbox_plan(files: DataFrame) -> DataFrame:
    """unit, rel_path, runtime, command, network: what could be run; nothing is."""
    rules = files.sparkSession.createDataFrame(SANDBOX, "name string, runtime string, command string, network boolean")
    return files.withColumn("name", F.substring_index("rel_path", "/", -1)).join(F.broadcast(rules), "name").select("unit", "rel_path", "runtime", "command", "network")


def tool_status(requirements: DataFrame, tools: DataFrame) -> DataFrame:
    """requirements(unit, name, executable) with tools(executable, version): available, version."""
    t = tools.select(F.lower("executable").alias("key"), F.col("version").alias("version"), F.lit(True).alias("found"))
    out = requirements.withColumn("key", F.lower("executable")).join(t, "key", "left").drop("key")
    return out.withColumn("available", F.coalesce("found", F.lit(False))).withColumn("version", F.coalesce("version", F.lit("any"))).drop("found")
