"""Extraction: components, imports, HTTP calls, routes and detections from a files table.

Files are unit, rel_path, name, ext, language, text. Rules are literals in
pattern lists; matching is Spark's regular expressions, so nothing leaves the JVM
but three small helpers: comment masking, route scopes that keywords open and the arguments of calls
(structure.py), all per file in Arrow batches without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a64
from ..session import cut_counted
from . import graph, route_groups, scoring, structure, text

# ---------------------------------------------------------------- comments

_C_STYLE = re.compile(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(//[^\n]*|/\*.*?(?:\*/|\Z))""", re.S)
_HASH = re.compile(r"""("(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(\#(?!\[)[^\n]*)""")
HASH_ENDINGS = ("py", "rb", "ex", "exs")


def masked(files: DataFrame) -> DataFrame:
    """files with masked: text in which comments are blanks; line ends stay, so do strings. Only text and ending leave the JVM."""

    @F.pandas_udf("string")
    def without_comments(code: pd.Series, ext: pd.Series) -> pd.Series:
        blank = lambda m: m[1] or re.sub(r"[^\n]", " ", m[2])
        return pd.Series([None if t is None else (_HASH if e in HASH_ENDINGS else _C_STYLE).sub(blank, t) for t, e in zip(code, ext)], dtype=object)

    return files.withColumn("masked", without_comments("text", "ext"))


# ---------------------------------------------------------------- declarations and imports

#: language, keyword, kind in the order in which they are tried.
DECLARATIONS = [
    ("Java", "class", "class"), ("Java", "interface", "interface"), ("Java", "record", "record"), ("Java", "enum", "enum"),
    ("TypeScript", "class", "class"), ("TypeScript", "interface", "interface"), ("TypeScript", "function", "function"), ("JavaScript", "class", "class"), ("JavaScript", "function", "function"),
    ("PHP", "class", "class"), ("PHP", "interface", "interface"), ("PHP", "trait", "trait"), ("PHP", "enum", "enum"),
    ("Python", "class", "class"), ("Python", "def", "function"), ("Ruby", "class", "class"), ("Ruby", "module", "module"),
    ("Rust", "struct", "class"), ("Rust", "enum", "enum"), ("Rust", "trait", "trait"), ("Rust", "fn", "function"), ("Go", "type", "class"), ("Go", "func", "function"),
    ("C#", "class", "class"), ("C#", "interface", "interface"), ("C#", "record", "record"), ("C#", "enum", "enum"), ("Kotlin", "class", "class"), ("Kotlin", "interface", "interface"), ("Kotlin", "object", "class"),
    ("Elixir", "defmodule", "module"), ("Vue", "function", "function"), ("Svelte", "function", "function"), ("Astro", "function", "function"),
]

#: language, pattern whose group 1 is what is imported.
IMPORTS = [
    ("Java", r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"), ("Kotlin", r"^\s*import\s+([\w.*]+)"), ("TypeScript", r"""^\s*(?:import|export)\b[^'"]*['"]([^'"]+)['"]"""),
    ("JavaScript", r"""^\s*(?:import|export)\b[^'"]*['"]([^'"]+)['"]"""), ("Vue", r"""^\s*import\b[^'"]*['"]([^'"]+)['"]"""), ("Svelte", r"""^\s*import\b[^'"]*['"]([^'"]+)['"]"""),
    ("Astro", r"""^\s*import\b[^'"]*['"]([^'"]+)['"]"""), ("PHP", r"^\s*use\s+([\w\\]+)"), ("Python", r"^\s*(?:from|import)\s+([\w.]+)"), ("Ruby", r"""^\s*require_relative\s+['"]([^'"]+)['"]"""),
    ("Rust", r"^\s*(?:pub\s+)?mod\s+(\w+)\s*;"), ("Go", r'^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$'), ("C#", r"^\s*using\s+([\w.]+)\s*;"), ("Elixir", r"^\s*(?:alias|import)\s+([\w.]+)"), ("Razor", r"^\s*@using\s+([\w.]+)"),
]
NAMESPACES = [("Java", r"^\s*package\s+([\w.]+)\s*;"), ("Kotlin", r"^\s*package\s+([\w.]+)"), ("C#", r"^\s*namespace\s+([\w.]+)"), ("PHP", r"^\s*namespace\s+([\w\\]+)\s*;"), ("Elixir", r"^\s*defmodule\s+([\w.]+)\s+do")]


def _code_lines(files: DataFrame) -> DataFrame:
    return text.lines(files.where("masked IS NOT NULL"), "masked", ("unit", "rel_path", "language"))


def components(files: DataFrame) -> DataFrame:
    """unit, id, name, kind, language, file, line_no: a module for each source file, and its declarations."""
    src = files.where(F.col("language").isin(*{r[0] for r in DECLARATIONS}) & F.col("masked").isNotNull())
    lang = F.lower(F.when(F.col("language") == "C#", "csharp").otherwise(F.col("language")))
    modules = src.select("unit", F.concat(lang, F.lit(":module:"), fnv1a64(F.col("rel_path"))).alias("id"), "name", F.lit("module").alias("kind"), "language", F.col("rel_path").alias("file"), F.lit(0).alias("line_no"))
    # literals declare nothing
    bare = _code_lines(src).withColumn("line", F.regexp_replace("line", r""""[^"\n]*"|'[^'\n]*'""", '""'))
    decl = text.declarations(bare, DECLARATIONS)
    ident = F.concat(lang, F.lit(":"), F.col("kind"), F.lit(":"), fnv1a64(F.col("rel_path")), F.lit(":"), F.col("name"))
    decl = decl.select("unit", ident.alias("id"), "name", "kind", "language", F.col("rel_path").alias("file"), "line_no")
    first = decl.groupBy("unit", "id").agg(F.min_by(F.struct("name", "kind", "language", "file", "line_no"), "line_no").alias("x")).select("unit", "id", "x.*")
    return modules.unionByName(first)


def _by_language(rules: list[tuple[str, str]], column: str = "line") -> Column:
    hits = []
    for lang, pattern in rules:
        x = F.regexp_extract(column, pattern, 1)
        hits.append(F.when((F.col("language") == lang) & (x != ""), x))
    return text.interpreted(F.coalesce(*hits))


def imports(files: DataFrame) -> DataFrame:
    """unit, rel_path, language, line_no, specifier."""
    lines = _code_lines(files).withColumn("specifier", _by_language(IMPORTS)).where("specifier IS NOT NULL")
    # Python names several modules after one import
    listed = F.transform(F.split(F.regexp_extract("line", r"^\s*import\s+([^#;]+)", 1), ","), lambda x: F.regexp_extract(x, r"^\s*([\w.]+)", 1))
    several = F.when((F.col("language") == "Python") & F.col("line").rlike(r"^\s*import\s"), F.filter(listed, lambda x: x != "")).otherwise(F.array("specifier"))
    return lines.withColumn("specifier", F.explode(several)).drop("line")


def ts_aliases(files: DataFrame) -> DataFrame:
    """unit, folder, pattern, head, tail, target: paths of tsconfig.json (else jsconfig.json), with what stands before and after the
    pattern's star, and baseUrl alone as the pattern "*". Targets are seen from the unit's root."""
    known = files.where(F.col("name").isin("tsconfig.json", "jsconfig.json") & F.col("masked").isNotNull())
    known = known.withColumn("folder", F.regexp_replace("rel_path", "/?[^/]*$", ""))
    best = known.groupBy("unit", "folder").agg(F.min_by("masked", F.col("name") != "tsconfig.json").alias("t"))  # tsconfig comes first
    config = F.from_json(F.regexp_replace("t", r",(\s*[}\]])", "$1"), "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>")
    o = best.select("unit", "folder", config["compilerOptions"].alias("o")).where("o IS NOT NULL")
    base = F.coalesce("o.baseUrl", F.lit("."))
    plain = o.where("o.baseUrl IS NOT NULL").select("unit", "folder", F.lit("*").alias("pattern"), base.alias("base"), F.lit("*").alias("to"))
    named = o.select("unit", "folder", base.alias("base"), F.explode("o.paths").alias("pattern", "tos")).select("unit", "folder", "pattern", "base", F.explode("tos").alias("to"))
    star = lambda c: F.substring_index(c, "*", 1)
    tail = F.when(F.col("pattern").contains("*"), F.substring_index("pattern", "*", -1)).otherwise("")
    both = plain.unionByName(named)
    return both.select("unit", "folder", "pattern", star(F.col("pattern")).alias("head"), tail.alias("tail"), joined_path(joined_path(F.col("folder"), F.col("base")), F.col("to")).alias("target"))


def aliased(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """imports with the specifiers that their unit's aliases stand for, beside the specifiers themselves; a folder's aliases serve what lies below it."""
    js = found.where(F.col("language").isin("TypeScript", "JavaScript", "Vue", "Svelte", "Astro") & ~F.col("specifier").startswith("."))
    hit = js.join(graph.sent(*cut_counted(aliases)), "unit").where(
        ((F.col("folder") == "") | F.col("rel_path").startswith(F.concat("folder", F.lit("/"))))
        & F.when(F.col("pattern").contains("*"), F.col("specifier").startswith(F.col("head")) & F.col("specifier").endswith(F.col("tail"))).otherwise(F.col("specifier") == F.col("pattern"))
    )  # an equi join on the unit, whose configuration names few aliases
    inner = F.expr("substring(specifier, length(head) + 1, length(specifier) - length(head) - length(tail))")
    return found.unionByName(hit.withColumn("specifier", F.concat(F.lit("/"), F.replace(F.col("target"), F.lit("*"), inner))).select(*found.columns))


def namespaces(files: DataFrame) -> DataFrame:
    """unit, rel_path, namespace: the first of each file."""
    n = _code_lines(files).withColumn("namespace", _by_language(NAMESPACES)).where("namespace IS NOT NULL")
    return n.groupBy("unit", "rel_path").agg(F.min_by("namespace", "line_no").alias("namespace"))


def joined_path(base: Column, rel: Column) -> Column:
    """rel seen from the folder base, with . and .. resolved."""
    parts = F.filter(F.concat(F.split(base, "/"), F.split(rel, "/")), lambda s: (s != "") & (s != "."))
    start = F.expr("CAST(array() AS array<string>)")
    return F.array_join(F.aggregate(parts, start, lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))), "/")


#: Languages, what a specifier of theirs may leave out, in order; None: all others.
ENDINGS = {
    None: (".java", ".kt", ".php", ".ex", ".cs", ".go"),
    ("TypeScript", "JavaScript", "Vue", "Svelte", "Astro"): (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", ".vue", ".svelte"),
    ("Python",): (".py", "/__init__.py"),
    ("Ruby",): (".rb",),
    ("Rust",): (".rs", "/mod.rs"),
}


def _ends(language: Column) -> Column:
    """What a specifier of a language may leave out, in order of preference; nothing comes first."""
    ends = F.array(F.lit(""), *map(F.lit, ENDINGS[None]))
    for family, own in ENDINGS.items():
        if family:
            ends = F.when(language.isin(*family), F.array(F.lit(""), *map(F.lit, own))).otherwise(ends)
    return ends


def import_stems(found: DataFrame) -> DataFrame:
    """unit, rel_path, language, stem: the path that an import means, but for an ending of its language."""
    base = F.regexp_replace("rel_path", "/?[^/]*$", "")
    relative = F.col("specifier").startswith(".")
    dotted = F.regexp_replace(F.regexp_replace("specifier", r"\.\*$", ""), r"[.\\]", "/")
    stem = F.when(relative & F.col("specifier").contains("/"), joined_path(base, F.col("specifier"))).when(F.col("language").isin("Ruby", "Rust"), joined_path(base, F.col("specifier"))).otherwise(F.when(F.col("specifier").contains("/"), F.regexp_replace("specifier", "^/", "")).otherwise(dotted))
    return found.select("unit", "rel_path", "language", stem.alias("stem"))


def file_stems(files: DataFrame) -> DataFrame:
    """unit, stem, ending, exact, least, most: the file that is stem and ending, and the first and last that end in them below a folder of theirs."""
    parts = F.split("rel_path", "/")
    n = F.size(parts)
    # an end of one segment is no path
    ends = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct((i == 1).alias("whole"), F.array_join(F.slice(parts, i, n), "/").alias("path")))
    known = files.select("unit", F.col("rel_path").alias("full"), F.explode(ends).alias("x")).select("unit", "full", "x.*")
    every = F.array(*map(F.lit, sorted({"", *(e for own in ENDINGS.values() for e in own)})))
    stems = F.transform(F.filter(every, lambda e: F.endswith(F.col("path"), e)), lambda e: F.struct(F.left("path", F.char_length("path") - F.char_length(e)).alias("stem"), e.alias("ending")))
    known = known.select("unit", "full", "whole", F.explode(stems).alias("x")).select("unit", "full", "whole", "x.*").repartition("unit", "stem")
    part = F.when(~F.col("whole"), F.col("full"))
    return known.groupBy("unit", "stem", "ending").agg(F.min(F.when(F.col("whole"), F.col("full"))).alias("exact"), F.min(part).alias("least"), F.max(part).alias("most"))


def import_edges(files: DataFrame, found: DataFrame) -> DataFrame:
    """unit, source, target (files), kind: imports that lead to a file of the unit, itself or as the only one that ends in the path.

    Files lose their endings, so that an import is one row of the join and not one for each ending; a row meets at most one for each ending."""
    hit = import_stems(found).join(file_stems(files), ["unit", "stem"]).withColumn("ord", F.array_position(_ends(F.col("language")), F.col("ending"))).where("ord > 0")
    first = F.min_by("exact", F.when(F.col("exact").isNotNull(), F.col("ord")))
    best = hit.groupBy("unit", "rel_path", "stem").agg(first.alias("exact"), F.min("least").alias("least"), F.max("most").alias("most"))
    target = F.coalesce("exact", F.when(F.col("least") == F.col("most"), F.col("least")))
    both = best.select("unit", F.col("rel_path").alias("source"), target.alias("target")).where("target <> source")
    return both.withColumn("kind", F.lit("imports")).distinct()


# ---------------------------------------------------------------- HTTP calls

#: A call of a client's verb, up to its bracket, and one of fetch.
_VERB = r"\b(?:this\.)?#?[\w$]+\.(?:get|post|put|patch|delete)\s*(?:<[^>(]*>)?\("
_FETCH = r"\bfetch\s*\("
#: What in a file names a client: a parameter or field of Angular's type, its injection, an instance of axios.
_CLIENTS = r"([\w$]+)\s*[:?]{1,2}\s*HttpClient\b|([\w$]+)\s*=\s*(?:inject\(\s*HttpClient\s*\)|axios\.create\()"


def called_url(argument: Column) -> Column:
    """The joined literals of an argument; null if it holds none."""
    pieces = F.regexp_extract_all(argument, F.lit(r""""([^"\n]*)"|'([^'\n]*)'|`([^`]*)`"""), F.lit(0))
    bare = F.transform(pieces, lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2))
    return F.when(F.size(pieces) > 0, F.array_join(bare, ""))


def http_calls(files: DataFrame) -> DataFrame:
    """unit, file, method, path, origin: calls of axios, Angular's HttpClient under any name, and fetch; an argument without an
    absolute path gives dynamic://unresolved."""
    src = files.where(F.col("ext").isin("ts", "tsx", "js", "jsx", "mjs", "cjs", "vue", "svelte", "astro") & F.col("masked").isNotNull())
    named = F.transform(F.regexp_extract_all("masked", F.lit(_CLIENTS), F.lit(0)), lambda x: F.regexp_extract(x, r"^([\w$]+)", 1))
    clients = F.concat(F.array(*map(F.lit, ("axios", "http", "httpClient"))), named)
    src = src.select("unit", F.col("rel_path").alias("file"), clients.alias("clients"), "masked")
    found = structure.calls(src, ["unit", "file", "clients"], "masked", f"{_VERB}|{_FETCH}")
    is_fetch = F.col("token").rlike(rf"^{_FETCH}$")
    named_verb = r"^(?:this\.)?#?([\w$]+)\.(\w+)"
    said = F.upper(F.regexp_extract("argument", r"""method\s*:\s*['"`](\w+)['"`]""", 1))  # anywhere in the call's own brackets
    method = F.when(~is_fetch, F.upper(F.regexp_extract("token", named_verb, 2))).when(said != "", said).otherwise("GET")
    both = found.where(is_fetch | F.array_contains("clients", F.regexp_extract("token", named_verb, 1)))
    both = both.select("unit", "file", method.alias("method"), called_url(F.col("first")).alias("url"))
    origin = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    known = F.coalesce(F.col("url").rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*://)"), F.lit(False))
    path = F.when(~known, "dynamic://unresolved").otherwise(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""))
    return both.select("unit", "file", "method", path.alias("path"), F.when(~known, "dynamic://unresolved").when(origin != "", origin).alias("origin")).distinct()


# ---------------------------------------------------------------- detection


@dataclass(frozen=True)
class Signal:
    framework: str
    signal: str
    files: str  # pattern of rel_path
    contains: str  # pattern of text; empty: the file alone
    weight: int
    kind: str
    strength: int


def _node(name: str, package: str, config: str, source: str) -> list[Signal]:
    js = r"\.(tsx?|jsx?|mjs|cjs|vue|svelte|astro)$"
    out = [Signal(name, "manifest", r"(^|/)package\.json$", f'"{package}"\\s*:', 55, "manifest", 100)]
    if config:
        out.append(Signal(name, "configuration", config, "", 20, "configuration", 95))
    if source:
        out.append(Signal(name, "source", js, source, 20, "source", 90))
    return out


_PY = r"(^|/)(requirements[^/]*\.txt|pyproject\.toml|Pipfile|setup\.py)$"
_JVM = r"(^|/)(pom\.xml|build\.gradle(\.kts)?)$"
SIGNALS: list[Signal] = [
    *_node("Angular", "@angular/core", r"(^|/)angular\.json$", "@Component|@NgModule|@Injectable|@angular/"),
    *_node("React", "react", "", "from ['\"]react|react-router|<Route"), *_node("Next.js", "next", r"(^|/)next\.config\.(js|mjs|ts)$", "from ['\"]next|export default function \\w*Page"),
    *_node("Vue", "vue", "", "createApp|createRouter|<template>|defineComponent"), *_node("Nuxt", "nuxt", r"(^|/)nuxt\.config\.(ts|js)$", "defineNuxt|<template>|defineEventHandler"),
    *_node("Svelte", "svelte", r"(^|/)svelte\.config\.js$", "<svelte:|<script|from ['\"]svelte"), *_node("SvelteKit", "@sveltejs/kit", r"(^|/)svelte\.config\.js$", r"\$app/|@sveltejs/kit|<svelte:"),
    *_node("Astro", "astro", r"(^|/)astro\.config\.(mjs|ts|js)$", "---|Astro\\."), *_node("NestJS", "@nestjs/core", "", "@Controller|@Module|@nestjs/"), *_node("Express", "express", "", "express\\(\\)|express\\.Router|from ['\"]express|require\\(['\"]express"),
    *_node("Fastify", "fastify", "", "[Ff]astify\\("), *_node("Hono", "hono", "", "new Hono"),
    Signal("Django", "manifest", _PY, "(?i)django", 55, "manifest", 100), Signal("Django", "manage", r"(^|/)manage\.py$", "", 10, "convention", 85), Signal("Django", "source", r"\.py$", "urlpatterns|django\\.", 20, "source", 90),
    Signal("FastAPI", "manifest", _PY, "(?i)fastapi", 55, "manifest", 100), Signal("FastAPI", "source", r"\.py$", "FastAPI\\(|APIRouter\\(", 20, "source", 90),
    Signal("Flask", "manifest", _PY, "(?i)flask", 55, "manifest", 100), Signal("Flask", "source", r"\.py$", "Flask\\(|Blueprint\\(", 20, "source", 90),
    Signal("Symfony", "manifest", r"(^|/)composer\.json$", "symfony/framework-bundle", 55, "manifest", 100), Signal("Symfony", "console", r"(^|/)bin/console$", "", 10, "convention", 90), Signal("Symfony", "bundles", r"(^|/)config/bundles\.php$", "", 10, "convention", 90), Signal("Symfony", "source", r"\.php$", r"#\[Route|Symfony\\", 20, "source", 90),
    Signal("Laravel", "manifest", r"(^|/)composer\.json$", "laravel/framework", 50, "manifest", 100), Signal("Laravel", "artisan", r"(^|/)artisan$", "", 15, "convention", 85), Signal("Laravel", "bootstrap", r"(^|/)bootstrap/app\.php$", "", 15, "convention", 85), Signal("Laravel", "routes", r"(^|/)routes/[^/]+\.php$", "", 10, "convention", 85), Signal("Laravel", "providers", r"(^|/)app/Providers/", "", 10, "convention", 85),
    Signal("Spring Boot", "manifest", _JVM, "spring-boot", 60, "manifest", 100), Signal("Spring Boot", "source", r"\.(java|kt)$", "@SpringBootApplication|@RestController|@Controller|@Service", 30, "source", 95),
    Signal("Quarkus", "manifest", _JVM, "io\\.quarkus", 65, "manifest", 100), Signal("Quarkus", "source", r"\.(java|kt)$", "@Path|jakarta\\.ws\\.rs", 30, "source", 95),
    Signal("Micronaut", "manifest", _JVM, "micronaut", 65, "manifest", 100), Signal("Micronaut", "source", r"\.(java|kt)$", "io\\.micronaut|@Controller", 30, "source", 95),
    Signal("Ktor", "manifest", _JVM, "io\\.ktor", 65, "manifest", 100), Signal("Ktor", "source", r"\.kt$", "routing\\s*\\{", 30, "source", 95),
    Signal("ASP.NET", "manifest", r"\.csproj$", "Microsoft\\.NET\\.Sdk\\.Web", 70, "manifest", 100), Signal("ASP.NET", "source", r"\.cs$", "ControllerBase|\\.Map(Get|Post|Put|Delete|Patch)\\(|WebApplication", 25, "source", 95),
    Signal("Blazor", "manifest", r"\.csproj$", "BlazorWebAssembly|Components\\.WebAssembly", 70, "manifest", 100), Signal("Blazor", "source", r"\.razor$", "@page", 25, "source", 95),
    Signal("Phoenix", "manifest", r"(^|/)mix\.exs$", ":phoenix", 70, "manifest", 100), Signal("Phoenix", "source", r"\.exs?$", "Phoenix\\.|, :router", 25, "source", 95),
    Signal("Rails", "manifest", r"(^|/)Gemfile$", r"""gem ['"]rails['"]""", 55, "manifest", 100), Signal("Rails", "bin", r"(^|/)bin/rails$", "", 10, "convention", 85), Signal("Rails", "application", r"(^|/)config/application\.rb$", "", 10, "convention", 85), Signal("Rails", "routes", r"(^|/)config/routes\.rb$", "", 10, "convention", 85), Signal("Rails", "source", r"\.rb$", "Rails\\.application|ApplicationController", 15, "source", 90),
    Signal("Go web", "source", r"\.go$", r"net/http|gin-gonic/gin|labstack/echo|gofiber/fiber|go-chi/chi", 60, "source", 95), Signal("Go web", "manifest", r"(^|/)go\.mod$", "", 20, "manifest", 100),
    Signal("Rust web", "manifest", r"(^|/)Cargo\.toml$", r"(?m)^(axum|actix-web|rocket|warp)\s*=", 70, "manifest", 100), Signal("Rust web", "source", r"\.rs$", r"axum::|actix_web|rocket::|warp::|Router::new", 25, "source", 90),
]


def detections(files: DataFrame) -> DataFrame:
    """unit, name, confidence, evidence, actionable."""
    code = F.coalesce("masked", "text", F.lit(""))
    hits = []
    for s in SIGNALS:
        on = F.col("rel_path").rlike(s.files)
        if s.contains:
            on = on & (F.coalesce("text", F.lit("")) if s.kind == "manifest" else code).rlike(s.contains)
        hits.append(F.when(on, F.struct(F.lit(s.framework).alias("name"), F.lit(s.signal).alias("signal"), F.lit(s.weight).alias("weight"), F.lit(s.kind).alias("kind"), F.lit(s.strength).alias("strength"))))
    found = files.select("unit", F.col("rel_path").alias("source"), F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("unit", "source", "h.*")
    return scoring.detection_score(found).withColumn("actionable", scoring.actionable(F.col("confidence"), F.col("evidence")))


# ---------------------------------------------------------------- routes

_Q = r"""['"`]([^'"`]*)['"`]"""


@dataclass(frozen=True)
class Route:
    """In files of a framework: each match of pattern is an entrypoint for each method that the group's text names.

    method: a group's number or a constant. Where inside is given, a match is searched by its two patterns for method and path."""

    framework: str
    files: str
    pattern: str
    method: int | str
    path: int
    confidence: int
    prefix: str = ""  # group 1 of its first match in the file goes before
    when: str = ""  # the file must match
    receiver: int = 0  # this group must be one of RECEIVERS or be assigned as `assigned` says
    assigned: str = ""
    inside: tuple[str, str] | None = None


#: The prefix of a file's first blueprint that has one.
_BLUEPRINT = rf"\bBlueprint\([^)]*?\burl_prefix\s*[=:]\s*{_Q}"
RECEIVERS = ("app", "router", "server", "api")


ROUTES: list[Route] = [
    Route("Angular", r"\.tsx?$", rf"\bpath\s*:\s*{_Q}", "ROUTE", 1, 90, when="Routes|RouterModule"),
    Route("React", r"\.(jsx|tsx|js|ts)$", rf"\bpath\s*[=:]\s*\{{?\s*{_Q}", "ROUTE", 1, 88, when="react-router|<Route|createBrowserRouter"),
    Route("Vue", r"\.(ts|js|vue)$", rf"\bpath\s*:\s*{_Q}", "ROUTE", 1, 92, when="createRouter|vue-router"),
    Route("NestJS", r"\.ts$", rf"@(Get|Post|Put|Patch|Delete|Options|Head)\(\s*(?:{_Q})?\s*\)", 1, 2, 98, prefix=rf"@Controller\(\s*{_Q}"),
    Route("Express", r"\.(js|ts|mjs|cjs)$", rf"\b([\w$]+)\.(get|post|put|patch|delete|options|all)\(\s*{_Q}", 2, 3, 94, receiver=1, assigned=r"([\w$]+)\s*=\s*(?:express\s*\(|(?:express\.)?Router\s*\()"),
    Route("Fastify", r"\.(js|ts|mjs|cjs)$", rf"\.(get|post|put|patch|delete|options|head|all)\(\s*{_Q}", 1, 2, 95),
    Route("Fastify", r"\.(js|ts|mjs|cjs)$", r"\.route\(\s*\{[^}]*\}", 1, 1, 95, inside=(r"""\bmethod\s*:\s*(\[[^\]]*\]|['"`]\w+['"`])""", rf"\b(?:url|path)\s*:\s*{_Q}")),
    Route("Hono", r"\.(js|ts|tsx|mjs)$", rf"\.(get|post|put|patch|delete|options|all)\(\s*{_Q}", 1, 2, 96, prefix=rf"\.basePath\(\s*{_Q}"),
    Route("FastAPI", r"\.py$", rf"@\w+\.(get|post|put|patch|delete|options|head)\(\s*{_Q}", 1, 2, 98),
    Route("Flask", r"\.py$", rf"@\w+\.(get|post|put|patch|delete)\(\s*{_Q}", 1, 2, 98, prefix=_BLUEPRINT),
    Route("Flask", r"\.py$", rf"@\w+\.route\(\s*{_Q}(?:[^)]*?\bmethods\s*=\s*[\[({{]([^\])}}]*))?", 2, 1, 94, prefix=_BLUEPRINT),
    Route("ASP.NET", r"\.cs$", rf"\.Map(Get|Post|Put|Patch|Delete)\(\s*{_Q}", 1, 2, 96),
    Route("ASP.NET", r"\.cs$", rf"\[Http(Get|Post|Put|Patch|Delete)(?:\(\s*{_Q}\s*\))?\]", 1, 2, 98, prefix=rf"\[Route\(\s*{_Q}"),
    Route("Blazor", r"\.razor$", rf"@page\s+{_Q}", "ROUTE", 1, 99),
    Route("Symfony", r"\.php$", rf"#\[Route\(\s*(?:path\s*:\s*)?{_Q}(?:[^\]]*?\bmethods\s*:\s*(\[[^\]]*\]|['\"]\w+['\"]))?", 2, 1, 98),
    Route("Rails", r"(^|/)config/routes\.rb$", rf"(?m)^\s*(get|post|put|patch|delete)\s+{_Q}", 1, 2, 92),
    Route("Go web", r"\.go$", rf"\.HandleFunc\(\s*{_Q}", "ANY", 1, 90), Route("Go web", r"\.go$", rf"\.(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\(\s*{_Q}", 1, 2, 90),
    Route("Rust web", r"\.rs$", rf"#\[(get|post|put|patch|delete)\(\s*{_Q}", 1, 2, 96),
    Route("Quarkus", r"\.(java|kt)$", rf"@(GET|POST|PUT|PATCH|DELETE)\s+(?:@(?!Path)\w+(?:\([^)]*\))?\s+)*@Path\(\s*{_Q}\s*\)", 1, 2, 96, prefix=rf"@Path\(\s*{_Q}"),
    Route("Quarkus", r"\.(java|kt)$", r"@(GET|POST|PUT|PATCH|DELETE)()\s+(?!@Path)(?:@\w+(?:\([^)]*\))?\s+)*(?=public|fun|[A-Z])", 1, 2, 96, prefix=rf"@Path\(\s*{_Q}"),
    Route("Micronaut", r"\.(java|kt)$", rf"@(Get|Post|Put|Patch|Delete)(?:\(\s*{_Q}\s*\))?", 1, 2, 96, prefix=rf"@Controller\(\s*{_Q}"),
]

#: Resources as REST routes: method, what follows the collection's path ({s}: a member).
REST = [("GET", ""), ("POST", ""), ("GET", "/new"), ("GET", "/{s}"), ("PATCH", "/{s}"), ("DELETE", "/{s}"), ("GET", "/{s}/edit")]


def route_path(prefix: Column, path: Column) -> Column:
    """One slash between segments; :id, <int:id> and [id] as {id}."""
    parts = F.filter(F.split(F.concat(prefix, F.lit("/"), path), "/"), lambda s: s != "")
    shown = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"^:(\w+)\??$", r"{$1}"), r"^<(?:\w+:)?(\w+)>$", r"{$1}"))
    return F.concat(F.lit("/"), F.array_join(shown, "/"))


def _methods(said: Column, default: str) -> Column:
    """The verbs that a text names, in capitals; ALL is ANY."""
    verbs = F.array_distinct(F.transform(F.regexp_extract_all(said, F.lit("[A-Za-z]+"), F.lit(0)), lambda v: F.when(F.upper(v) == "ALL", "ANY").otherwise(F.upper(v))))
    return F.when(F.size(verbs) > 0, verbs).otherwise(F.array(F.lit(default)))


def _annotated(args: Column) -> Column:
    """The paths among an annotation's arguments: all literals that belong to no other name than path or value."""
    own = F.regexp_replace(args, r"""(?s)\b(?!(?:path|value)\b)\w+\s*=\s*(?:"(?:\\.|[^"\\\n])*+"|[^"=])*?(?=,\s*\w+\s*=|\z)""", " ")
    found = F.regexp_extract_all(own, F.lit(r'"([^"\n]*)"'), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def spring_routes(files: DataFrame) -> DataFrame:
    """Each base path of the class with each path and method of its methods. A @RequestMapping of a method counts if it names methods."""
    src = files.where(F.col("rel_path").rlike(r"\.(java|kt)$") & F.col("masked").rlike("@[A-Za-z]*Mapping"))
    # annotations before the first type are the class's own
    head = F.char_length(F.regexp_extract("masked", r"(?s)^(.*?)\b(?:class|interface|object)\s", 1))
    found = structure.calls(src, ["unit", "rel_path"], "masked", r"@(?:Get|Post|Put|Patch|Delete|Request)Mapping\s*\(")
    heads = src.select("unit", "rel_path", head.alias("head"), "masked")
    found = found.join(heads.drop("masked"), ["unit", "rel_path"]).withColumn("verb", F.regexp_extract("token", r"^@(\w+)Mapping", 1))
    base = found.where("start < head AND verb = 'Request'").groupBy("unit", "rel_path").agg(F.min_by(_annotated(F.col("argument")), "start").alias("bases"))
    # an annotation without brackets has one empty path
    bare = heads.select("unit", "rel_path", F.explode(F.regexp_extract_all(F.expr("substring(masked, head + 1)"), F.lit(r"@(Get|Post|Put|Patch|Delete)Mapping\b(?!\s*\()"), F.lit(1))).alias("verb"), F.lit("").alias("argument"))
    own = found.where("start >= head").select("unit", "rel_path", "verb", "argument").unionByName(bare).join(base, ["unit", "rel_path"], "left")
    own = own.withColumn("bases", F.coalesce("bases", F.array(F.lit("")))).withColumn("file", F.col("rel_path"))
    named = F.regexp_extract_all("argument", F.lit(r"\b(?:RequestMethod\.)(\w+)"), F.lit(1))
    a = own.where("verb <> 'Request'").select("unit", "file", "bases", F.array(F.upper("verb")).alias("methods"), _annotated(F.col("argument")).alias("paths"))
    b = own.where("verb = 'Request'").select("unit", "file", "bases", named.alias("methods"), _annotated(F.col("argument")).alias("paths")).where(F.size("methods") > 0)
    rows = a.unionByName(b).select("unit", "file", "bases", F.explode("methods").alias("method"), "paths").select("unit", "file", "bases", "method", F.explode("paths").alias("p")).select("unit", "file", F.explode("bases").alias("base"), "method", "p")
    return rows.select(F.lit("Spring Boot").alias("framework"), "unit", "file", "method", route_path(F.col("base"), F.col("p")).alias("path"), F.lit(95).alias("confidence"))


def _rule(r: Route) -> Column:
    """What a rule finds in a file: array<struct<framework, method, path, confidence>>."""
    on = F.col("rel_path").rlike(r.files)
    if r.when:
        on = on & F.col("masked").rlike(r.when)
    of = lambda m, group, i: F.regexp_extract(m, r.inside[i] if r.inside else r.pattern, group)
    hits = F.regexp_extract_all("masked", F.lit(r.pattern), F.lit(0))
    if r.receiver:
        names = F.concat(F.array(*map(F.lit, RECEIVERS)), F.regexp_extract_all("masked", F.lit(r.assigned), F.lit(1)))
        hits = F.filter(hits, lambda m: F.array_contains(names, F.regexp_extract(m, r.pattern, r.receiver)))
    if r.inside:
        hits = F.filter(hits, lambda m: of(m, r.path, 1) != "")
    prefix = F.regexp_extract("masked", f"(?s){r.prefix}", 1) if r.prefix else F.lit("")
    if r.framework == "ASP.NET" and r.prefix:
        prefix = F.replace(prefix, F.lit("[controller]"), F.regexp_replace("name", r"(Controller)?\.cs$", ""))
    default = "GET" if r.framework == "Flask" else "ANY"

    def rows(m: Column) -> Column:
        methods = _methods(of(m, r.method, 0), default) if isinstance(r.method, int) else F.array(F.lit(r.method))
        path = route_path(prefix, of(m, r.path, 1))
        return F.transform(methods, lambda v: F.struct(F.lit(r.framework).alias("framework"), v.alias("method"), path.alias("path"), F.lit(r.confidence).alias("confidence")))

    none = F.expr("CAST(array() AS array<struct<framework:string,method:string,path:string,confidence:int>>)")
    return F.when(on, F.flatten(F.transform(hits, rows))).otherwise(none)


def pattern_routes(files: DataFrame) -> DataFrame:
    """framework, unit, file, method, path, confidence of all rules, in one reading of the files."""
    each = files.where("masked IS NOT NULL").select("unit", F.col("rel_path").alias("file"), F.explode(F.concat(*map(_rule, ROUTES))).alias("x"))
    out = [each.select("x.framework", "unit", "file", "x.method", "x.path", "x.confidence")]
    resources = files.where(F.col("rel_path").rlike(r"(^|/)config/routes\.rb$") & F.col("masked").isNotNull()).select("unit", F.col("rel_path").alias("file"), F.explode(F.regexp_extract_all("masked", F.lit(r"(?m)^\s*resources\s+:(\w+)"), F.lit(1))).alias("r"))
    out.append(rest_routes(resources, "Rails"))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows


def rest_routes(resources: DataFrame, framework: str) -> DataFrame:
    """resources(unit, file, r) as seven routes each."""
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(p).alias("tail")) for m, p in REST])
    rows = resources.withColumn("x", F.explode(each))
    one = F.regexp_replace("r", "s$", "")
    path = F.concat(F.lit("/"), F.replace(F.col("r"), F.lit("_"), F.lit("-")), F.regexp_replace("x.tail", r"\{s\}", "{id}"))
    return rows.withColumn("one", one).select(F.lit(framework).alias("framework"), "unit", "file", "x.method", path.alias("path"), F.lit(85).alias("confidence"))


def file_route(rel: Column, root: str, terminal: str) -> Column:
    """The route that a file's place means: groups, index and private folders dropped, [x] as {x}, [...x] as {x*}."""
    inner = F.regexp_replace(F.regexp_replace(rel, f"^(.*/)?{root}/", ""), terminal, "")
    parts = F.filter(F.split(inner, "/"), lambda s: (s != "") & (s != "index") & ~s.rlike(r"^\(.*\)$") & ~s.startswith("_"))
    shown = F.transform(parts, lambda s: F.regexp_replace(F.regexp_replace(s, r"^\[\[?\.\.\.(\w+)\]?\]$", r"{$1*}"), r"^\[(\w+)\]$", r"{$1}"))
    return F.concat(F.lit("/"), F.array_join(shown, "/"))


#: framework, files, root, what is cut off at the end, kind of method: ROUTE, exported or by file name; confidence.
FILE_ROUTES = [
    ("Next.js", r"(^|/)app/(.*/)?page\.(tsx|jsx|ts|js)$", "app", r"/?page\.\w+$", "ROUTE", 98), ("Next.js", r"(^|/)app/(.*/)?route\.(ts|js)$", "app", r"/?route\.\w+$", "exported", 98),
    ("Next.js", r"(^|/)pages/(?!api/).*\.(tsx|jsx)$", "pages", r"\.\w+$", "ROUTE", 98), ("Next.js", r"(^|/)pages/api/.*\.(ts|js)$", "pages", r"\.\w+$", "exported", 98),
    ("Nuxt", r"(^|/)pages/.*\.vue$", "pages", r"\.vue$", "ROUTE", 98), ("Nuxt", r"(^|/)server/api/.*\.(ts|js)$", "server", r"(\.(get|post|put|patch|delete))?\.\w+$", "named", 95), ("Nuxt", r"(^|/)server/routes/.*\.(ts|js)$", "server/routes", r"(\.(get|post|put|patch|delete))?\.\w+$", "named", 95),
    ("SvelteKit", r"(^|/)src/routes/(.*/)?\+page\.svelte$", "src/routes", r"/?\+page\.svelte$", "ROUTE", 98), ("SvelteKit", r"(^|/)src/routes/(.*/)?\+server\.(ts|js)$", "src/routes", r"/?\+server\.\w+$", "exported", 98),
    ("Astro", r"(^|/)src/pages/.*\.astro$", "src/pages", r"\.astro$", "ROUTE", 98), ("Astro", r"(^|/)src/pages/.*\.(ts|js)$", "src/pages", r"\.\w+$", "exported", 96),
]
_EXPORTED = r"export\s+(?:async\s+)?(?:const|function)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"


def file_routes(files: DataFrame) -> DataFrame:
    out = None
    for framework, pattern, root, terminal, how, confidence in FILE_ROUTES:
        exported = F.array_distinct(F.regexp_extract_all(F.coalesce("masked", F.lit("")), F.lit(_EXPORTED), F.lit(1)))
        named = F.upper(F.regexp_extract("name", r"\.(get|post|put|patch|delete)\.\w+$", 1))
        any_ = F.array(F.lit("ANY"))
        methods = {"ROUTE": F.array(F.lit("ROUTE")), "exported": F.when(F.size(exported) > 0, exported).otherwise(any_), "named": F.when(named != "", F.array(named)).otherwise(any_)}[how]
        rows = files.where(F.col("rel_path").rlike(pattern)).select(F.lit(framework).alias("framework"), "unit", F.col("rel_path").alias("file"), F.explode(methods).alias("method"), file_route(F.col("rel_path"), root, terminal).alias("path"))
        rows = rows.withColumn("confidence", F.when((F.col("method") == "ANY") & (how == "exported"), 88).otherwise(confidence) if how == "exported" else F.lit(confidence))
        out = rows if out is None else out.unionByName(rows)
    return out


@dataclass(frozen=True)
class Scopes:
    """Nested route scopes: a token either opens a scope with a prefix, opens or closes a block, or is a route."""

    framework: str
    files: str
    token: str  # named groups: prefix (opens a scope), open, close, method and path, resource


SCOPED = [
    Scopes("Ktor", r"\.kt$", r"""\broute\(\s*"(?P<prefix>[^"]*)"\s*\)\s*\{|\b(?P<method>get|post|put|patch|delete)\s*(?:\(\s*"(?P<path>[^"]*)"\s*\))?\s*\{|(?P<open>\{)|(?P<close>\})"""),
    Scopes("Phoenix", r"router\.ex$", r"""\bscope\s+(?:path:\s*)?"(?P<prefix>[^"]*)"[^\n]*?\bdo\b|^\s*(?P<method>get|post|put|patch|delete|live)\s+"(?P<path>[^"]*)"|^\s*resources\s+"(?P<resource>[^"]*)"(?:[^\n]*\bdo\b(?P<rdo>))?|(?P<open>\b(?:do|fn)\b(?!:))|(?P<close>\bend\b)"""),
]


def scoped_routes(files: DataFrame) -> DataFrame:
    """Routes inside nested scopes; a stack of prefixes per file."""
    out = None
    for s in SCOPED:
        token = re.compile(s.token, re.S | re.M)

        def run(batches: Iterator[pd.DataFrame], token=token, s=s) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for unit, file, code in zip(b["unit"], b["rel_path"], b["masked"]):
                    stack = [""]
                    for m in token.finditer(code):
                        g = m.groupdict()
                        here = "/".join(stack)
                        if g["prefix"] is not None:
                            stack.append(g["prefix"])
                        elif g["method"] is not None:
                            verb = {"live": "GET", "any": "ANY"}.get(g["method"], g["method"].upper())
                            rows.append((s.framework, unit, file, verb, f"{here}/{g['path'] or ''}", 95))
                            if s.framework == "Ktor":
                                stack.append("")
                        elif g.get("resource") is not None:
                            for v, t in REST:
                                rows.append((s.framework, unit, file, v, f"{here}/{g['resource'].strip('/')}{t.replace('{s}', '{id}')}", 85))
                            if g.get("rdo") is not None:
                                stack.append("")
                        elif g["open"] is not None:
                            stack.append("")
                        elif len(stack) > 1:
                            stack.pop()
                yield pd.DataFrame(rows, columns=["framework", "unit", "file", "method", "raw", "confidence"])

        rows = files.where(F.col("rel_path").rlike(s.files) & F.col("masked").isNotNull()).select("unit", "rel_path", "masked").mapInPandas(run, "framework string, unit string, file string, method string, raw string, confidence int")
        rows = rows.select("framework", "unit", "file", "method", route_path(F.lit(""), F.col("raw")).alias("path"), "confidence")
        out = rows if out is None else out.unionByName(rows)
    return out


def django_routes(files: DataFrame) -> DataFrame:
    """path() and re_path() of Django, with the prefix under which another file includes the module."""
    py = files.where((F.col("ext") == "py") & F.col("masked").isNotNull())
    inc = rf"path\(\s*{_Q}\s*,\s*include\(\s*{_Q}"
    includes = py.select("unit", F.explode(F.regexp_extract_all("masked", F.lit(inc), F.lit(0))).alias("m"))
    includes = includes.select("unit", F.regexp_extract("m", inc, 1).alias("prefix"), F.concat(F.replace(F.regexp_extract("m", inc, 2), F.lit("."), F.lit("/")), F.lit(".py")).alias("tail"))
    parts = F.split("rel_path", "/")
    ends = py.select("unit", "rel_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("tail"))
    prefix = ends.join(includes, ["unit", "tail"]).groupBy("unit", "rel_path").agg(F.min("prefix").alias("prefix"))
    own = rf"\b(?:re_)?path\(\s*r?{_Q}\s*,\s*+(?!include)"
    rows = py.where(F.col("masked").contains("urlpatterns")).select("unit", "rel_path", F.explode(F.regexp_extract_all("masked", F.lit(own), F.lit(1))).alias("p"))
    rows = rows.join(prefix, ["unit", "rel_path"], "left")
    return rows.select(F.lit("Django").alias("framework"), "unit", F.col("rel_path").alias("file"), F.lit("ANY").alias("method"), route_path(F.coalesce("prefix", F.lit("")), F.col("p")).alias("path"), F.lit(94).alias("confidence"))


def _group_routes(files: DataFrame) -> DataFrame:
    return route_groups.group_routes(files).select("framework", "unit", "file", "method", "path", "confidence")


#: What finds routes; none needs another.
ROUTE_SOURCES = (pattern_routes, file_routes, scoped_routes, django_routes, spring_routes, _group_routes, route_groups.router_routes)


def entrypoints(files: DataFrame, found: DataFrame, routes: list[DataFrame] | None = None) -> DataFrame:
    """unit, id, name, kind, framework, file, confidence of frameworks that are actionable in their unit. routes: of ROUTE_SOURCES, where they are made already."""
    rows, *more = routes or [f(files) for f in ROUTE_SOURCES]
    for r in more:
        rows = rows.unionByName(r)
    live = found.where("actionable").select("unit", F.col("name").alias("framework"))
    rows = rows.join(live, ["unit", "framework"], "left_semi")
    rows = rows.groupBy("unit", "framework", "file", "method", "path").agg(F.max("confidence").alias("confidence"))
    ident = F.concat(F.lower(F.regexp_replace("framework", "[^A-Za-z]+", "-")), F.lit(":entrypoint:"), fnv1a64(F.concat_ws("\0", "framework", "file", "method", "path")))
    return rows.select("unit", ident.alias("id"), F.concat_ws(" ", "method", "path").alias("name"), F.lit("http").alias("kind"), "framework", "file", "confidence")
