"""What declarations mean to one another: type edges, component kinds, relations, packages.

All joins are equi joins on names that are counted first: a name borne more than
once in its scope resolves to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract, link, manifests
from .graph import keep_first

# ---------------------------------------------------------------- Java


def java_types(files: DataFrame) -> DataFrame:
    """unit, file, name, package, qualified: the first type of each Java file."""
    java = files.where("language = 'Java'")
    own = extract.components(java).where("kind <> 'module'").groupBy("unit", "file").agg(F.min_by("name", "line_no").alias("name"))
    spaces = extract.namespaces(java).withColumnRenamed("rel_path", "file")
    return own.join(spaces, ["unit", "file"], "left").select("unit", "file", "name", F.coalesce("namespace", F.lit("")).alias("package"), F.concat_ws(".", "namespace", "name").alias("qualified"))


def _unique(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


def java_edges(files: DataFrame) -> DataFrame:
    """unit, source, target, kind: imports by qualified name (of members, by their longest owner; of packages, if the name is used)
    and references to types of the same package that the code names."""
    java = files.where("language = 'Java'")
    types = java_types(files)
    found = extract.imports(java).select("unit", F.col("rel_path").alias("source"), "specifier")
    by_name = _unique(types, ["unit", "qualified"], "file")
    exact = found.withColumn("p", F.explode(link.prefixes(F.col("specifier"), "."))).select("unit", "source", "specifier", F.col("p.prefix").alias("qualified"), "p.len").join(by_name, ["unit", "qualified"])
    exact = exact.groupBy("unit", "source", "specifier").agg(F.max_by("file", "len").alias("target")).select("unit", "source", "target", F.lit("imports").alias("kind"))
    words = F.array_distinct(F.regexp_extract_all(F.regexp_replace("masked", r'"(\\.|[^"\\])*"', " "), F.lit(r"[\p{L}_$][\p{L}\p{N}_$]*"), F.lit(0)))
    tokens = java.where("masked IS NOT NULL").select("unit", F.col("rel_path").alias("source"), F.explode(words).alias("name"))
    in_package = _unique(types, ["unit", "package", "name"], "file").withColumnRenamed("file", "target")
    whole = found.where(F.col("specifier").endswith(".*")).select("unit", "source", F.expr("left(specifier, length(specifier) - 2)").alias("package")).distinct()
    starred = tokens.join(whole, ["unit", "source"]).join(in_package, ["unit", "package", "name"]).select("unit", "source", "target", F.lit("imports").alias("kind"))
    near = tokens.join(types.select("unit", F.col("file").alias("source"), "package"), ["unit", "source"]).join(in_package, ["unit", "package", "name"])
    near = near.select("unit", "source", "target", F.lit("references").alias("kind"))
    return exact.unionByName(starred).unionByName(near).where("source <> target").distinct()


# ---------------------------------------------------------------- PHP

_NAME = r"\\?[A-Za-z_][\w\\]*"


def _php_files(files: DataFrame) -> DataFrame:
    php = files.where((F.col("language") == "PHP") & F.col("masked").isNotNull())
    spaces = extract.namespaces(php).withColumnRenamed("rel_path", "file")
    return php.select("unit", F.col("rel_path").alias("file"), "masked").join(spaces, ["unit", "file"], "left").withColumn("namespace", F.coalesce("namespace", F.lit("")))


def _qualified(namespace: Column, name: Column) -> Column:
    return F.when(namespace == "", name).otherwise(F.concat(namespace, F.lit("\\"), name))


def php_types(files: DataFrame) -> DataFrame:
    """unit, file, name, qualified: the first type of each PHP file."""
    own = rf"\b(?:class|interface|trait|enum)\s+({_NAME})"
    types = _php_files(files).withColumn("name", F.regexp_extract("masked", own, 1)).where("name <> ''")
    return types.select("unit", "file", "name", _qualified(F.col("namespace"), F.col("name")).alias("qualified"))


def php_methods(files: DataFrame) -> DataFrame:
    """unit, file, name, visibility, static: functions declared inside PHP types; public unless said otherwise."""
    own = r"(?m)^\s*((?:(?:public|private|protected|static|final|abstract)\s+)*)function\s+&?([A-Za-z_]\w*)\s*\("
    rows = _php_files(files).where(F.col("masked").rlike(r"\b(?:class|interface|trait|enum)\s+\w"))
    rows = rows.select("unit", "file", F.explode(F.regexp_extract_all("masked", F.lit(own), F.lit(0))).alias("m"))
    words = F.regexp_extract("m", own, 1)
    said = F.regexp_extract(words, r"(public|private|protected)", 1)
    return rows.select("unit", "file", F.regexp_extract("m", own, 2).alias("name"), F.when(said == "", "public").otherwise(said).alias("visibility"), words.rlike(r"\bstatic\b").alias("static"))


def php_edges(files: DataFrame) -> DataFrame:
    """unit, source, target, kind: extends, implements, uses-trait, injects and eloquent-relation, by name without regard to case.

    A name is absolute, an alias of a use, or relative to the file's namespace."""
    base = _php_files(files)
    types = php_types(files).select("unit", "file", F.lower("qualified").alias("fq"))
    uses = base.select("unit", "file", F.explode(F.regexp_extract_all("masked", F.lit(rf"(?m)^\s*use\s+({_NAME}(?:\s+as\s+\w+)?)\s*;"), F.lit(1))).alias("u"))
    uses = uses.select("unit", "file", F.regexp_replace(F.regexp_extract("u", f"^({_NAME})", 1), r"^\\", "").alias("path"), F.regexp_extract("u", r"\bas\s+(\w+)$", 1).alias("as"))
    uses = uses.select("unit", "file", F.lower(F.when(F.col("as") != "", F.col("as")).otherwise(F.substring_index("path", "\\", -1))).alias("alias"), F.lower("path").alias("alias_fq")).distinct()

    def refs(pattern: str, kind: str, group: int = 1, many: str = "") -> DataFrame:
        got = base.select("unit", "file", "namespace", F.explode(F.regexp_extract_all("masked", F.lit(pattern), F.lit(group))).alias("r"))
        got = got.withColumn("r", F.explode(F.split("r", many))) if many else got
        return got.select("unit", "file", "namespace", F.btrim("r").alias("r"), F.lit(kind).alias("kind")).where("r <> ''")

    found = refs(rf"\bclass\s+\w+\s+extends\s+({_NAME})", "extends").unionByName(refs(rf"\bimplements\s+({_NAME}(?:\s*,\s*{_NAME})*)", "implements", 1, ","))
    found = found.unionByName(refs(rf"(?m)^\s{{2,}}use\s+({_NAME}(?:\s*,\s*{_NAME})*)\s*[;{{]", "uses-trait", 1, ","))
    found = found.unionByName(refs(rf"[(,]\s*(?:(?:public|private|protected|readonly)\s+)*\??({_NAME})\s+\$\w+", "injects"))
    relation = rf"->(?:hasOne|hasMany|belongsTo|belongsToMany|hasOneThrough|hasManyThrough|morphOne|morphMany|morphTo|morphToMany|morphedByMany)\(\s*({_NAME})::class"
    found = found.unionByName(refs(relation, "eloquent-relation"))
    absolute = F.col("r").startswith("\\")
    found = found.withColumn("alias", F.lower(F.substring_index("r", "\\", 1))).join(uses, ["unit", "file", "alias"], "left")
    tail = F.lower(F.regexp_replace("r", r"^[^\\]*", ""))
    fq = F.when(absolute, F.lower(F.expr("substring(r, 2)"))).when(F.col("alias_fq").isNotNull(), F.concat("alias_fq", tail)).otherwise(F.lower(_qualified(F.col("namespace"), F.col("r"))))
    target = _unique(types, ["unit", "fq"], "file").withColumnRenamed("file", "target")
    return found.withColumn("fq", fq).join(target, ["unit", "fq"]).select("unit", F.col("file").alias("source"), "target", "kind").where("source <> target").distinct()


def laravel_tables(files: DataFrame) -> DataFrame:
    """unit, file, table, references: tables that migrations make, and those their foreign keys point to (x_id points to xs unless named)."""
    m = files.where(F.col("rel_path").rlike(r"(^|/)database/migrations/") & F.col("masked").isNotNull())
    key = r"""foreignId\(\s*['"](\w+)['"]\s*\)(?:->\w+\((?!['"])[^)]*\))*->constrained\(\s*(?:['"](\w+)['"])?"""
    rows = m.select("unit", F.col("rel_path").alias("file"), F.regexp_extract("masked", r"""Schema::create\(\s*['"](\w+)['"]""", 1).alias("table"), F.explode_outer(F.regexp_extract_all("masked", F.lit(key), F.lit(0))).alias("k"))
    named, column = F.regexp_extract("k", key, 2), F.regexp_extract("k", key, 1)
    ref = F.when(F.col("k").isNull(), None).when(named != "", named).otherwise(F.concat(F.regexp_replace(column, "_id$", ""), F.lit("s")))
    return rows.where("table <> ''").select("unit", "file", "table", ref.alias("references"))


def conventional_table(name: Column) -> Column:
    """The table a model's name stands for: words by underscores, in the plural."""
    snake = F.concat(F.lower(F.substring(name, 1, 1)), F.lower(F.regexp_replace(F.substring(name, 2, 1 << 20), "([A-Z])", "_$1")))
    return F.when(snake.endswith("s"), snake).otherwise(F.concat(snake, F.lit("s")))


def table_owners(tables: DataFrame, types: DataFrame) -> DataFrame:
    """tables(unit, file, references) with types(unit, name, file): unit, source, target, kind, confidence of each foreign key
    whose table is named after a type; the type in the first file, where several are."""
    owners = types.groupBy("unit", conventional_table(F.col("name")).alias("references")).agg(F.min("file").alias("target"))
    edges = tables.where("references IS NOT NULL").select("unit", F.col("file").alias("source"), "references").distinct().join(owners, ["unit", "references"])
    return edges.select("unit", "source", "target", F.lit("migration-foreign-key").alias("kind"), F.lit(80).alias("confidence")).distinct()


def resolve_controllers(refs: DataFrame, types: DataFrame) -> DataFrame:
    """refs(unit, ref) with types(unit, name, qualified, file): unit, ref, file of the type a route's controller names.

    The whole qualified name comes first, without regard to case; then the type in the first file whose name is
    the reference or whose qualified name ends with it. All three are one equi join on tagged keys."""
    tagged = lambda tag, c: F.struct(F.lit(tag).alias("tag"), c.alias("key"))
    parts = F.split("qualified", r"\\")
    tails = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: tagged(2, F.array_join(F.slice(parts, i, F.size(parts)), "\\")))
    tails = F.when(F.size(parts) > 1, tails).otherwise(F.array().cast("array<struct<tag:int,key:string>>"))
    known = types.select("unit", "file", F.explode(F.concat(F.array(tagged(0, F.lower("qualified")), tagged(1, F.lower("name"))), tails)).alias("k")).select("unit", "file", "k.tag", "k.key")
    clean = F.btrim("ref", F.lit("\\"))
    asked = refs.select("unit", "ref").distinct().select("unit", "ref", F.explode(F.array(tagged(0, F.lower(clean)), tagged(1, F.lower(clean)), tagged(2, clean))).alias("k")).select("unit", "ref", "k.tag", "k.key")
    hits = asked.join(known, ["unit", "tag", "key"])
    return hits.groupBy("unit", "ref").agg(F.min_by("file", F.struct(F.col("tag") > 0, "file")).alias("file"))


def laravel_commands(files: DataFrame) -> DataFrame:
    """unit, file, name, kind: console commands as cli and listeners with a handle method as event entrypoints."""
    php = files.where((F.col("language") == "PHP") & F.col("masked").isNotNull())
    signature = F.regexp_extract("masked", r"""\$signature\s*=\s*['"]([^\s'"]+)""", 1)
    cli = php.where(F.col("masked").rlike(r"\bextends\s+Command\b")).select("unit", F.col("rel_path").alias("file"), F.when(signature != "", signature).otherwise(F.regexp_replace("name", r"\.php$", "")).alias("name"), F.lit("cli").alias("kind"))
    event = php.where(F.col("rel_path").rlike(r"(^|/)Listeners/") & F.col("masked").rlike(r"function\s+handle\s*\(")).select("unit", F.col("rel_path").alias("file"), F.regexp_replace("name", r"\.php$", "").alias("name"), F.lit("event").alias("kind"))
    return cli.unionByName(event)


# ---------------------------------------------------------------- kinds of components

#: framework, pattern of rel_path, pattern of text (empty: none needed), kind; the first that fits a file wins.
KINDS = [
    ("Angular", r"\.component\.ts$", "", "frontend-component"), ("Angular", r"\.service\.ts$", "", "service"), ("Angular", r"\.directive\.ts$", "", "directive"), ("Angular", r"\.pipe\.ts$", "", "pipe"), ("Angular", r"\.guard\.ts$", "", "guard"), ("Angular", r"\.module\.ts$", "", "module"),
    ("React", r"\.(jsx|tsx)$", "", "frontend-component"), ("Next.js", r"(^|/)(app/(.*/)?page|pages/.*)\.(tsx|jsx)$", "", "view"), ("Vue", r"\.vue$", "", "frontend-component"), ("Nuxt", r"\.vue$", "", "frontend-component"),
    ("Svelte", r"\.svelte$", "", "frontend-component"), ("SvelteKit", r"\.svelte$", "", "frontend-component"), ("Astro", r"\.astro$", "", "frontend-component"), ("Blazor", r"\.razor$", "", "frontend-component"),
    ("NestJS", r"\.ts$", r"@Controller\(", "controller"), ("NestJS", r"\.ts$", r"@Injectable\(", "service"), ("NestJS", r"\.ts$", r"@Module\(", "module"),
    ("Spring Boot", r"\.(java|kt)$", r"@(Rest)?Controller\b", "controller"), ("Spring Boot", r"\.(java|kt)$", r"@Service\b", "service"), ("Spring Boot", r"\.(java|kt)$", r"@Repository\b", "repository"), ("Spring Boot", r"\.(java|kt)$", r"@Entity\b", "entity"),
    ("Quarkus", r"\.(java|kt)$", r"@Path\(", "controller"), ("Quarkus", r"\.(java|kt)$", r"@(ApplicationScoped|Singleton)\b", "service"), ("Micronaut", r"\.(java|kt)$", r"@Controller\b", "controller"), ("Micronaut", r"\.(java|kt)$", r"@Singleton\b", "service"),
    ("Django", r"(^|/)views\.py$", "", "view"), ("FastAPI", r"\.py$", r"FastAPI\(|APIRouter\(", "handler"), ("Flask", r"\.py$", r"Flask\(|Blueprint\(", "handler"), ("ASP.NET", r"\.cs$", r"ControllerBase|: Controller\b", "controller"),
    ("Symfony", r"(^|/)Controller/", "", "controller"), ("Rails", r"(^|/)app/controllers/", "", "controller"), ("Rails", r"(^|/)app/models/", "", "model"), ("Phoenix", r"_controller\.ex$", "", "controller"), ("Phoenix", r"_live\.ex$", "", "view"),
    ("Laravel", r"(?i)/http/controllers/", "", "controller"), ("Laravel", r"(?i)/http/middleware/", "", "middleware"), ("Laravel", r"(?i)/console/commands/", "", "command"), ("Laravel", r"(?i)/jobs/", "", "job"), ("Laravel", r"(?i)/events/", "", "event"),
    ("Laravel", r"(?i)/listeners/", "", "listener"), ("Laravel", r"(?i)/models/", "", "model"), ("Laravel", r"(?i)/providers/", "", "provider"), ("Laravel", r"(?i)/migrations/", "", "migration"),
]


def classified(components: DataFrame, files: DataFrame, detections: DataFrame) -> DataFrame:
    """components with the kind that an actionable framework gives to all declarations of a file."""
    hits = []
    for i, (framework, path, pattern, kind) in enumerate(KINDS):
        on = F.col("rel_path").rlike(path)
        on = on & F.col("masked").rlike(pattern) if pattern else on
        hits.append(F.when(on, F.struct(F.lit(framework).alias("framework"), F.lit(i).alias("ord"), F.lit(kind).alias("given"))))
    said = files.select("unit", F.col("rel_path").alias("file"), F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("unit", "file", "h.*")
    said = said.join(detections.where("actionable").select("unit", F.col("name").alias("framework")), ["unit", "framework"], "left_semi")
    first = keep_first(said, ["unit", "file"], [F.asc("ord")]).select("unit", "file", "given")
    kind = F.when(F.col("given").isNotNull() & ~F.col("kind").isin("module", "file"), F.col("given")).otherwise(F.col("kind"))
    return components.join(first, ["unit", "file"], "left").withColumn("kind", kind).select(*components.columns)


# ---------------------------------------------------------------- packages

#: Manifest, pattern whose group 1 is the package's own name.
IDENTITIES = [("package.json", r'"name"\s*:\s*"([^"]+)"'), ("composer.json", r'"name"\s*:\s*"([^"]+)"'), ("Cargo.toml", r'(?s)\[package\][^\[]*?\bname\s*=\s*"([^"]+)"'), ("pyproject.toml", r'(?s)\[project\][^\[]*?\bname\s*=\s*"([^"]+)"'), ("go.mod", r"(?m)^module\s+(\S+)"), ("pom.xml", r"(?s)^(?:(?!<parent>|<dependencies>).)*?<artifactId>([^<]+)<")]
#: Manifest, pattern whose group 1 is a name it declares.
DECLARED = [("package.json", r'"([@\w./-]+)"\s*:\s*"(?:[\^~>=<*]|\d|workspace:|file:|link:|latest)[^"]*"'), ("composer.json", r'"([\w.-]+/[\w.-]+)"\s*:\s*"[^"]*"'), ("Cargo.toml", r"(?m)^([\w-]+)\s*=\s*(?:\"[\d^~]|\{)"), ("pyproject.toml", r"""["']([A-Za-z][\w.-]*)\s*(?:[><=~!;\[][^"']*)?["']"""), ("requirements.txt", r"(?m)^([A-Za-z][\w.-]*)"), ("go.mod", r"(?m)^\s*(?:require\s+)?([\w.-]+/\S+)\s+v"), ("pom.xml", r"(?s)<dependency>.*?<artifactId>([^<]+)<")]


def _by_manifest(files: DataFrame, rules: list[tuple[str, str]], every: bool) -> DataFrame:
    text: Column = F.coalesce("text", F.lit(""))
    hits = F.array().cast("array<string>")
    for name, pattern in rules:
        got = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        hits = F.when(F.col("name") == name, got if every else F.slice(got, 1, 1)).otherwise(hits)
    return files.where(F.col("name").isin(*[r[0] for r in rules])).select("unit", F.explode(hits).alias("package")).select("unit", F.col("package").alias("name")).distinct()


def _searched(files: DataFrame) -> DataFrame:
    """Manifests that are searched as text: those of other formats, and JSON that cannot be parsed."""
    plain = files.where(~F.col("name").isin(*[m for m, _ in manifests.SECTIONS]))
    return plain.unionByName(manifests.parsed(files).where("malformed").select(*files.columns))


def package_identities(files: DataFrame) -> DataFrame:
    read = manifests.identities(manifests.parsed(files)).select("unit", "name")
    return _by_manifest(_searched(files), IDENTITIES, False).unionByName(read).distinct()


def declared_packages(files: DataFrame) -> DataFrame:
    read = manifests.declared(manifests.parsed(files)).select("unit", "name")
    return _by_manifest(_searched(files), DECLARED, True).unionByName(read).distinct()


def imported_packages(files: DataFrame) -> DataFrame:
    """unit, name: packages that imports name, with all their path prefixes."""
    return importing_files(files).select("unit", "name").distinct()


def importing_files(files: DataFrame) -> DataFrame:
    """unit, name, file: which files import a package."""
    found = extract.imports(files).where(~F.col("specifier").startswith("."))
    return found.select("unit", F.col("rel_path").alias("file"), F.explode(F.transform(link.prefixes(F.col("specifier"), "/"), lambda p: p["prefix"])).alias("name")).distinct()


def package_edges(files: DataFrame) -> DataFrame:
    return link.package_links(package_identities(files), declared_packages(files), imported_packages(files))
