from pyspark.sql import functions as F

from weft.operators import extract, link, merge, semantics
from weft.sources import files as src


def prepared(spark, *rows):
    return extract.masked(src.from_texts(spark, [(u, p, t) for u, p, t in rows]).withColumn("unit", F.col("repository")))


def pairs(df):
    return {(r["source"], r["target"], r["kind"]) for r in df.collect()}


def test_java(spark):
    f = prepared(
        spark, ("u", "a/A.java", "package p.a;\nimport p.b.B;\nimport static p.b.C.X;\nimport p.d.*;\npublic class A { D d; N n; /* M */ String s = \"M\"; }"), ("u", "b/B.java", "package p.b;\nclass B {}"),
        ("u", "b/C.java", "package p.b;\nclass C {}"), ("u", "d/D.java", "package p.d;\nclass D {}"), ("u", "d/E.java", "package p.d;\nclass E {}"), ("u", "a/N.java", "package p.a;\nclass N {}"), ("u", "a/M.java", "package p.a;\nclass M {}"),
    )
    assert pairs(semantics.java_edges(f)) == {("a/A.java", "b/B.java", "imports"), ("a/A.java", "b/C.java", "imports"), ("a/A.java", "d/D.java", "imports"), ("a/A.java", "a/N.java", "references")}


def test_php(spark):
    f = prepared(
        spark, ("u", "A.php", "<?php\nnamespace App;\nuse Lib\\Base as B;\nuse Lib\\Help;\nclass A extends B implements \\Lib\\Face, Local {\n  use Help;\n  function __construct(private ?Local $l, int $n) {}\n  function r() { return $this->hasMany(Post::class); }\n}"),
        ("u", "Base.php", "<?php\nnamespace Lib;\nclass Base {}"), ("u", "Help.php", "<?php\nnamespace Lib;\ntrait Help {}"), ("u", "Face.php", "<?php\nnamespace Lib;\ninterface Face {}"), ("u", "Local.php", "<?php\nnamespace App;\ninterface Local {}"), ("u", "Post.php", "<?php\nnamespace App;\nclass Post {}"),
    )
    assert pairs(semantics.php_edges(f)) == {("A.php", "Base.php", "extends"), ("A.php", "Face.php", "implements"), ("A.php", "Local.php", "implements"), ("A.php", "Help.php", "uses-trait"), ("A.php", "Local.php", "injects"), ("A.php", "Post.php", "eloquent-relation")}


def test_laravel_parts(spark):
    f = prepared(
        spark, ("u", "database/migrations/1.php", "<?php Schema::create('posts', function ($t) { $t->foreignId('user_id')->constrained(); $t->foreignId('by')->nullable()->constrained('people'); });"),
        ("u", "app/Console/Commands/Sync.php", "<?php class Sync extends Command { protected $signature = 'sync:all {x}'; }"), ("u", "app/Listeners/Note.php", "<?php class Note { function handle($e) {} }"),
    )
    assert {(r["table"], r["references"]) for r in semantics.laravel_tables(f).collect()} == {("posts", "users"), ("posts", "people")}
    assert {(r["name"], r["kind"]) for r in semantics.laravel_commands(f).collect()} == {("sync:all", "cli"), ("Note", "event")}


def test_kinds_and_packages(spark):
    f = prepared(
        spark, ("lib", "package.json", '{"name": "@x/lib", "version": "1.0.0"}'), ("app", "package.json", '{"name": "app", "dependencies": {"@x/lib": "^1", "@nestjs/core": "10"}}'),
        ("app", "a.controller.ts", "import { f } from '@x/lib/deep';\nimport { Controller } from '@nestjs/common';\n@Controller('a')\nexport class AController {}"), ("rs", "Cargo.toml", "[package]\nname = \"core\"\n[dependencies]\nserde = \"1\""), ("rs2", "Cargo.toml", "[package]\nname = \"cli\"\n[dependencies]\ncore = { path = \"../core\" }"),
    )
    comps = semantics.classified(extract.components(f), f, extract.detections(f))
    assert {(r["name"], r["kind"]) for r in comps.where("unit = 'app'").collect()} == {("a.controller.ts", "module"), ("AController", "controller")}
    got = {(r["source_unit"], r["target_unit"], r["confidence"]) for r in semantics.package_edges(f).collect()}
    assert got == {("app", "lib", 100), ("rs2", "rs", 90)}


def test_controllers_and_tables(spark):
    f = prepared(
        spark, ("u", "a/Post.php", "<?php\nnamespace App\\Http;\nclass PostController {}"), ("u", "b/Post.php", "<?php\nnamespace App\\Old;\nclass PostController {}"),
        ("u", "m/BlogEntry.php", "<?php\nnamespace App;\nclass BlogEntry {}"), ("u", "m/News.php", "<?php\nclass News {}"),
        ("u", "database/migrations/1.php", "<?php Schema::create('posts', function ($t) { $t->foreignId('blog_entry_id')->constrained(); $t->foreignId('n')->constrained('news'); $t->foreignId('user_id')->constrained(); });"),
    )
    types = semantics.php_types(f)
    names = ["\\App\\Old\\PostController", "app\\old\\postcontroller", "postcontroller", "Http\\PostController", "http\\PostController", "News", "Missing"]
    refs = spark.createDataFrame([("u", n) for n in names] + [("other", "News"), ("u", None)], "unit string, ref string")
    assert {(r["unit"], r["ref"], r["file"]) for r in semantics.resolve_controllers(refs, types).collect()} == {
        ("u", names[0], "b/Post.php"), ("u", names[1], "b/Post.php"), ("u", names[2], "a/Post.php"), ("u", names[3], "a/Post.php"), ("u", names[5], "m/News.php"),
    }
    got = pairs(semantics.table_owners(semantics.laravel_tables(f), types))
    assert got == {("database/migrations/1.php", t, "migration-foreign-key") for t in ("m/BlogEntry.php", "m/News.php")}


def test_evidence_and_endpoint_links(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "source string, target string")
    meta = spark.createDataFrame([("a", "b", 2, "late", 50), ("a", "b", 1, "early", 70)], "source string, target string, seq int, evidence string, confidence int")
    got = sorted((r["source"], r["evidence"], r["confidence"]) for r in merge.with_evidence(edges, meta, ["source", "target"], "seq").collect())
    assert got == [("a", "early", 70), ("a", "early", 70), ("b", "Resolved internal dependency", 85)]
    cross = spark.createDataFrame([("web", "c1", "api", "e1", "x", 100), ("web", "c1", "api", "gone", "x", 90), ("web", "c2", "api", "e1", "y", 90)], "source_unit string, source string, target_unit string, entrypoint string, evidence string, confidence int")
    calls = spark.createDataFrame([("web", "c1", "x", "b.ts", "get"), ("web", "c1", "x", "a.ts", "get"), ("web", "c2", "other", "c.ts", "get")], "unit string, component string, evidence string, file string, method string")
    ends = spark.createDataFrame([("api", "e1", "GET /users/{id}", "u.php")], "unit string, id string, name string, file string")
    assert [(r["source"], r["consumer_file"], r["method"], r["path"], r["provider_file"], r["confidence"]) for r in link.endpoint_links(cross, calls, ends).collect()] == [("c1", "a.ts", "GET", "/users/{id}", "u.php", 100)]
