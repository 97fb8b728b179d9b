"""What the extraction finds in the sample projects, beside rows that say what it must find."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators import capsule, extract, graph, link, semantics, technology
from weft.plans.samples import LINKED, PROJECTS, ROUTES
from weft.session import cut
from weft.sources import files as src

SAMPLES: dict = {}


def _sql(columns: str, rows: list[tuple]) -> tuple:
    return [c.strip(' "') for c in columns.split(",")], rows


def query(want: tuple):
    def add(f):
        SAMPLES[f.__name__] = (f, *want)
        return f

    return add


def _placed(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    files = src.from_texts(spark, rows)
    return cut(extract.masked(src.assign_units(files, src.discover_units(files))))


def _projects() -> list[tuple[str, str, str]]:
    return [(u, p, t) for u, (files, *_) in PROJECTS.items() for p, t in files.items()] + [(f"x-{u}", p, t) for u, (files, _) in ROUTES.items() for p, t in files.items()]


@query(_sql("unit, name", [(u, n) for u, (*_, names) in PROJECTS.items() for n in sorted(names)] + [(f"x-{u}", n) for u, (_, names) in ROUTES.items() for n in sorted(names)]))
def sample_entrypoints(spark, d):
    placed = _placed(spark, _projects())
    return extract.entrypoints(placed, cut(extract.detections(placed))).select("unit", "name")


@query(_sql("unit, framework", [(u, f) for u, (_, frameworks, _) in PROJECTS.items() for f in sorted(frameworks)]))
def sample_frameworks(spark, d):
    placed = _placed(spark, [r for r in _projects() if not r[0].startswith("x-")])
    return extract.detections(placed).where("actionable").select("unit", F.col("name").alias("framework"))


_TREE = [
    ("r", "pom.xml", "<project/>"), ("r", "src/A.java", "class A {}"), ("r", "node_modules/x/i.js", "1"), ("r", "a/bootstrap/cache/c.php", "<?php"), ("r", "Makefile", "all:"), ("r", "web/package.json", "{}"),
    ("r", "web/src/App.tsx", "1"), ("r", "data.bin", "a\0b"), ("s", "main.go", "package main"), ("s", "go.mod", "module x"), ("s", "tools/Gemfile", "gem"), ("s", "vendor/v.go", "1"), ("t", "notes.md", "x"),
]


@query(_sql("repository, rel_path, ext, language, is_text", [
    ("r", "pom.xml", "xml", "XML", True), ("r", "src/A.java", "java", "Java", True), ("r", "Makefile", "", "Unknown", True), ("r", "web/package.json", "json", "Unknown", True), ("r", "web/src/App.tsx", "tsx", "TypeScript", True),
    ("r", "data.bin", "bin", "Unknown", False), ("s", "main.go", "go", "Go", True), ("s", "go.mod", "mod", "Unknown", True), ("s", "tools/Gemfile", "", "Unknown", True), ("t", "notes.md", "md", "Unknown", True),
]))
def sample_files(spark, d):
    return src.from_texts(spark, _TREE).select("repository", "rel_path", "ext", "language", "is_text")


@query(_sql("repository, root", [("r", "web"), ("s", ""), ("s", "tools"), ("t", "")]))
def sample_units(spark, d):
    return src.discover_units(src.from_texts(spark, _TREE)).select("repository", "root")


_CODE = [
    ("j", "pom.xml", "<p/>"), ("j", "a/B.java", "package a;\nimport a.sub.*;\nimport static x.y.C.f;\nimport java.util.List;\n/* class No {} */\npublic class B { D d; E e; String s = \"F\"; }"), ("j", "a/D.java", "package a;\nclass D {}"),
    ("j", "a/F.java", "package a;\nclass F {}"), ("j", "a/sub/E.java", "package a.sub;\npublic record E() {}"), ("j", "x/y/C.java", "package x.y;\npublic class C {}"),
    ("p", "composer.json", "{}"), ("p", "src/A.php", "<?php\nnamespace App;\nuse App\\Contracts\\Sends as S;\nuse App\\Helps;\nclass A extends Base implements S {\n  use Helps;\n  public function __construct(private ?Repo $r) {}\n  public function items() { return $this->hasMany(Item::class); }\n}"),
    ("p", "src/Base.php", "<?php\nnamespace App;\nabstract class Base {}"), ("p", "src/S.php", "<?php\nnamespace App\\Contracts;\ninterface Sends {}"), ("p", "src/H.php", "<?php\nnamespace App;\ntrait Helps {}"), ("p", "src/R.php", "<?php\nnamespace App;\nclass Repo {}"), ("p", "src/I.php", "<?php\nnamespace App;\nclass Item {}"),
    ("t", "package.json", "{}"), ("t", "src/a.ts", "import { b } from './b';\nexport * from '../lib/c';\nimport x from 'react';\nconst s = 'class No'; // class Never {}\nexport interface I {}\nexport function f() {}"), ("t", "src/b/index.ts", "export class K {}"), ("t", "lib/c.tsx", "1"),
    ("y", "setup.py", ""), ("y", "pkg/__init__.py", ""), ("y", "pkg/m.py", "import pkg.n, os\nfrom pkg import q\nclass M:\n    def go(self): ..."), ("y", "pkg/n.py", "# def no(): ..."),
]


@query(_sql("unit, source, target, kind", [
    ("j", "a/B.java", "a/sub/E.java", "imports"), ("j", "a/B.java", "x/y/C.java", "imports"), ("j", "a/B.java", "a/D.java", "references"),
]))
def sample_java_edges(spark, d):
    return semantics.java_edges(_placed(spark, _CODE))


@query(_sql("unit, file, name, package, qualified", [("j", "a/B.java", "B", "a", "a.B"), ("j", "a/D.java", "D", "a", "a.D"), ("j", "a/F.java", "F", "a", "a.F"), ("j", "a/sub/E.java", "E", "a.sub", "a.sub.E"), ("j", "x/y/C.java", "C", "x.y", "x.y.C")]))
def sample_java_types(spark, d):
    return semantics.java_types(_placed(spark, _CODE))


@query(_sql("unit, source, target, kind", [("p", "src/A.php", f"src/{f}.php", k) for f, k in (("Base", "extends"), ("S", "implements"), ("H", "uses-trait"), ("R", "injects"), ("I", "eloquent-relation"))]))
def sample_php_edges(spark, d):
    return semantics.php_edges(_placed(spark, _CODE))


@query(_sql("unit, file, name, visibility, static", [("p", "src/A.php", "__construct", "public", False), ("p", "src/A.php", "items", "public", False)]))
def sample_php_methods(spark, d):
    return semantics.php_methods(_placed(spark, _CODE))


@query(_sql("unit, source, target, kind", [("t", "src/a.ts", "src/b/index.ts", "imports"), ("t", "src/a.ts", "lib/c.tsx", "imports"), ("y", "pkg/m.py", "pkg/n.py", "imports"), ("y", "pkg/m.py", "pkg/__init__.py", "imports")]))
def sample_import_edges(spark, d):
    placed = _placed(spark, [r for r in _CODE if r[0] in "ty"])
    return extract.import_edges(placed, extract.aliased(extract.imports(placed), extract.ts_aliases(placed)))


@query(_sql("unit, file, kind, name", [("t", "src/a.ts", "module", "a.ts"), ("t", "src/a.ts", "interface", "I"), ("t", "src/a.ts", "function", "f"), ("t", "src/b/index.ts", "module", "index.ts"), ("t", "src/b/index.ts", "class", "K"), ("t", "lib/c.tsx", "module", "c.tsx"),
    ("y", "setup.py", "module", "setup.py"), ("y", "pkg/__init__.py", "module", "__init__.py"), ("y", "pkg/m.py", "module", "m.py"), ("y", "pkg/m.py", "class", "M"), ("y", "pkg/m.py", "function", "go"), ("y", "pkg/n.py", "module", "n.py")]))
def sample_components(spark, d):
    return extract.components(_placed(spark, [r for r in _CODE if r[0] in "ty"])).select("unit", "file", "kind", "name")


@query(_sql("ext, masked", [("ts", "a('//x') " + " " * 5 + " b " + " " * 5), ("py", "x = '#' " + " " * 3), ("php", "#[A] " + " " * 6)]))
def sample_masked(spark, d):
    rows = [("m", "a.ts", "a('//x') /*1*/ b //2\t "), ("m", "a.py", "x = '#' # y"), ("m", "a.php", "#[A] // b()")]
    return extract.masked(src.from_texts(spark, rows)).select("ext", "masked")


@query(_sql("method, path, origin", [("GET", "/u", None), ("POST", "/s/t", None), ("PUT", "/x?y=1", "https://h.org"), ("GET", "dynamic://unresolved", "dynamic://unresolved")]))
def sample_http_calls(spark, d):
    return extract.http_calls(_placed(spark, LINKED)).select("method", "path", "origin")


@query(_sql("pattern, target", [("*", "src/*"), ("@app/*", "src/app/*"), ("cfg", "src/config.ts")]))
def sample_ts_aliases(spark, d):
    return extract.ts_aliases(_placed(spark, LINKED)).select("pattern", "target")


@query(_sql("source_unit, name, target_unit, confidence", [("web", "@x/lib", "lib", 100)]))
def sample_package_edges(spark, d):
    return semantics.package_edges(_placed(spark, LINKED)).select("source_unit", "name", "target_unit", "confidence")


_SHOP = [
    ("l", "composer.json", '{"require": {"php": "^8.2", "laravel/framework": "11"}}'), ("l", "artisan", "#"), ("l", "bootstrap/app.php", "<?php"),
    ("l", "app/Http/Controllers/UserController.php", "<?php\nnamespace App\\Http\\Controllers;\nclass UserController {}"), ("l", "app/Models/User.php", "<?php\nnamespace App\\Models;\nclass User {}"), ("l", "app/Console/Commands/Send.php", "<?php\nclass Send extends Command { protected $signature = 'mail:send {id}'; }"),
    ("l", "app/Listeners/Log.php", "<?php\nclass Log { public function handle(E $e) {} }"), ("l", "database/migrations/1_posts.php", "<?php\nSchema::create('posts', function ($t) { $t->foreignId('user_id')->constrained(); $t->foreignId('cat')->nullable()->constrained('kinds'); });"),
    ("n", "package.json", '{"engines": {"node": ">=20"}, "dependencies": {"prisma": "5", "@nestjs/core": "10"}}'), ("n", "package-lock.json", "{}"), ("n", "yarn.lock", ""), ("n", "vite.config.ts", ""), ("n", "Dockerfile", "FROM node"), ("n", "conf/db.properties", "url=jdbc:postgresql://h/d\nredis=1"), ("n", "q/a.sql", "SELECT a FROM b"),
    ("n", "src/a.controller.ts", "import { Controller } from '@nestjs/common';\n@Controller('a')\nexport class AController {}"), ("n", "src/a.service.ts", "@Injectable()\nexport class AService {}"),
]


@query(_sql("unit, name, kind", [("l", "mail:send", "cli"), ("l", "Log", "event")]))
def sample_laravel_commands(spark, d):
    return semantics.laravel_commands(_placed(spark, _SHOP)).select("unit", "name", "kind")


@query(_sql('"table", "references"', [("posts", "users"), ("posts", "kinds")]))
def sample_laravel_tables(spark, d):
    return semantics.laravel_tables(_placed(spark, _SHOP)).select("table", "references")


@query(_sql("source, target, kind", [("database/migrations/1_posts.php", "app/Models/User.php", "migration-foreign-key")]))
def sample_table_owners(spark, d):
    placed = _placed(spark, _SHOP)
    return semantics.table_owners(semantics.laravel_tables(placed), semantics.php_types(placed)).select("source", "target", "kind")


@query(_sql("unit, name, kind", [("l", "UserController", "controller"), ("l", "User", "model"), ("l", "Send", "command"), ("l", "Log", "listener"), ("n", "AController", "controller"), ("n", "AService", "service")]))
def sample_component_kinds(spark, d):
    placed = _placed(spark, _SHOP)
    found = semantics.classified(extract.components(placed), placed, cut(extract.detections(placed)))
    return found.where("kind <> 'module'").select("unit", "name", "kind")


@query(_sql("unit, category, name, confidence", [
    ("l", "Language", "PHP", 100), ("l", "Build Tool", "Composer", 100), ("l", "Framework", "Laravel", 80), ("n", "Language", "TypeScript", 100), ("n", "Language", "SQL", 100), ("n", "Database", "PostgreSQL", 77), ("n", "Database", "Redis", 77),
    ("n", "Query Language", "SQL", 90), ("n", "ORM", "Prisma", 80), ("n", "Build Tool", "npm", 100), ("n", "Build Tool", "Vite", 85), ("n", "Build Tool", "Docker", 95), ("n", "Framework", "NestJS", 75),
]))
def sample_technologies(spark, d):
    placed = _placed(spark, _SHOP)
    return technology.technologies(placed, cut(extract.detections(placed))).select("unit", "category", "name", "confidence")


@query(_sql("unit, name, version_hint", [("l", "Composer", None), ("l", "PHP", "^8.2"), ("n", "npm", None), ("n", "Node.js", ">=20"), ("n", "Vite", None), ("n", "Docker", None)]))
def sample_requirements(spark, d):
    return technology.runtime_requirements(_placed(spark, _SHOP)).select("unit", "name", "version_hint")


@query(_sql("unit, level, code", [("svelte", "info", "framework-no-static-entrypoints"), ("php-plain", "info", "generic-php-fallback"), ("big", "warning", "source-too-large")]))
def sample_diagnostics(spark, d):
    names = ("svelte", "php-plain", "express", "laravel")
    placed = _placed(spark, [r for r in _projects() if r[0] in names] + [("big", "Huge.js", "x" * (src.MAX_SOURCE_BYTES + 1))])
    found = cut(extract.detections(placed))
    return technology.diagnostics(placed, found, extract.entrypoints(placed, found)).select("unit", "level", "code")


@query(_sql("rel_path, runtime, command", [("composer.json", "PHP/Composer", "composer validate --no-check-publish"), ("package.json", "Node.js", "npm test --if-present && npm run build --if-present")]))
def sample_sandbox_plan(spark, d):
    return capsule.sandbox_plan(_placed(spark, _SHOP)).select("rel_path", "runtime", "command")


@query(_sql("file", [("lib/c.tsx",), ("package.json",), ("src/a.ts",), ("src/b/index.ts",)]))
def sample_capsule(spark, d):
    """What the module of src/a.ts needs, by its imports, and the unit's manifests."""
    placed = _placed(spark, [r for r in _CODE if r[0] == "t"])
    edges = extract.import_edges(placed, extract.imports(placed))
    nodes = graph.closure(edges, spark.createDataFrame([("src/a.ts",)], "node string")).select(F.lit("t").alias("unit"), "node")
    comps = placed.select("unit", F.col("rel_path").alias("id"), F.col("rel_path").alias("file"))
    return capsule.capsule_files(nodes, comps, placed).select("file")


_TOML = '[capsule]\nname = "c"\n[metrics]\nfiles = 1\n[target]\nvalue = "component:x"\n[source]\nroot = "repositories/a"\n'


@query(_sql("capsule, name, passed", [("a", n, n not in ("content-integrity", "payload-integrity")) for n in ("manifest", "source", "file-inventory", "content-integrity", "payload-integrity", "content-integrity-sha256", "payload-integrity-sha256", "symlink-safety", "portable-source-root", "target", "environment")]
    + [("b", n, n in ("source", "content-integrity-sha256", "payload-integrity-sha256")) for n in ("manifest", "source", "file-inventory", "content-integrity", "payload-integrity", "content-integrity-sha256", "payload-integrity-sha256", "symlink-safety", "portable-source-root", "target", "environment")]))
def sample_capsule_checks(spark, d):
    manifests = spark.createDataFrame([("a", _TOML), ("b", '[source]\nroot = "/abs"\n')], "capsule string, text string")
    files = [("a", "source", "x", "h", False, None), ("a", "environment", "required.env", "h", False, "CAPSULE=true"), ("b", "source", "y", "h", True, None)]
    files = spark.createDataFrame(files, "capsule string, area string, rel_path string, sha256 string, symlink boolean, text string")
    return capsule.structural_checks(manifests, files).select("capsule", "name", "passed")


@query(_sql("target, path", [("component:x", "out/a"), ("component:x", "out/b")]))
def sample_capsule_list(spark, d):
    manifests = spark.createDataFrame([("out/b/capsule.toml", _TOML), ("out/a/capsule.toml", _TOML), ("out/.tmp/capsule.toml", _TOML), ("out/a/other.toml", _TOML)], "path string, text string")
    return capsule.list_capsules(manifests)


@query(_sql("prefix, len", [("a", 1), ("a.b", 2), ("a.b.c", 3)]))
def sample_prefixes(spark, d):
    return spark.range(1).select(F.explode(link.prefixes(F.lit("a.b.c"), ".")).alias("p")).select("p.prefix", "p.len")


@pytest.mark.parametrize("name", SAMPLES)
def test_sample(spark, name):
    make, columns, rows = SAMPLES[name]
    got = sorted(map(repr, (tuple(r) for r in make(spark, None).select(*columns).collect())))
    assert got == sorted(map(repr, rows))
