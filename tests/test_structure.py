"""Brackets, scopes, call chains and composed prefixes against brute force."""

import random

import pytest

from weft.operators import compose, extract, route_groups, structure

KEYS = ["unit", "rel_path"]


def brute_pairs(text):
    stacks, out = {}, set()
    for i, c in enumerate(text):
        if c in "([{":
            stacks.setdefault(c, []).append(i)
        elif c in ")]}":
            kind = "([{"[")]}".index(c)]
            if stacks.get(kind):
                out.add((kind, stacks[kind].pop(), i + 1))
    return out


def test_bracket_pairs(spark):
    rng = random.Random(1)
    texts = [None, "", "no brackets", "(" * 3000 + ")" * 3000, ")(", "((" + "x" * 50_000 + ")", "é(日)本]"] + ["".join(rng.choice("()[]{}ab ") for _ in range(rng.randrange(80))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    got = {}
    for r in structure.bracket_pairs(df, ["id"], "t").collect():
        got.setdefault(r["id"], set()).add((r["kind"], r["start"], r["end"]))
        assert (r["inner"], r["stop"]) == (r["start"] + 1, r["end"] - 1)
    for i, t in enumerate(texts):
        assert got.get(i, set()) == brute_pairs(t or ""), t[:80]


def test_calls_have_no_limit(spark):
    deep = "(" * 400 + "1" + ")" * 400
    code = [f"f({deep}, g(')'), \"a,(\", b)", "f(a, (b, c), f(d))", "f(", "f()", "xf(1)", "f(" + "a, " * 5000 + "z)", "f('it\\'s )', 2) f(`x\n)`)"]
    df = spark.createDataFrame(list(enumerate(code)), "id long, t string")
    got = sorted((r["id"], r["start"], r["argument"], r["first"]) for r in structure.calls(df, ["id"], "t", r"\bf\(").collect())
    want = [
        (0, 0, code[0][2:-1], deep), (1, 0, code[1][2:-1], "a"), (1, code[1].index("f(d"), "d", "d"), (3, 0, "", ""),
        (5, 0, code[5][2:-1], "a"), (6, 0, "'it\\'s )', 2", "'it\\'s )'"), (6, 16, "`x\n)`", "`x\n)`"),
    ]
    assert got == want


def test_scopes_pass_on_what_they_hold(spark):
    rng = random.Random(3)
    scopes = []
    for doc in range(12):
        def grow(a, z, depth, doc=doc):
            while z - a > 4 and rng.random() < 0.8:
                s = rng.randrange(a, z - 2)
                e = rng.randrange(s + 2, z + 1)
                scopes.append((doc, s, e, f"p{len(scopes)}/", [f"m{rng.randrange(4)}"], rng.choice([None, f"d{len(scopes)}"])))
                if depth < 6:
                    grow(s + 1, e - 1, depth + 1)
                a = e
        grow(0, 300, 0)
    inner = [(doc, i, i + 1) for doc in range(13) for i in range(0, 300, 7)]
    s = structure.nested(spark.createDataFrame(scopes, "id long, start int, end int, p string, m array<string>, d string"), ["id"])
    i = structure.enclosed(spark.createDataFrame(inner, "id long, start int, end int"), s, ["id"])
    got = structure.inherited(i, s, ["id"], joined=["p"], united=["m"], innermost=["d"]).collect()
    assert len(got) == len(inner)
    for r in got:
        around = sorted((x for x in scopes if x[0] == r["id"] and x[1] <= r["start"] and x[2] >= r["end"]), key=lambda x: (x[1], -x[2]))
        # a place on a scope's end may begin inside and end outside of it: then it is not around
        inside = [x[5] for x in around if x[5]]
        assert (r["all_p"], r["all_m"], r["all_d"]) == ("".join(x[3] for x in around), sorted({m for x in around for m in x[4]}), inside[-1] if inside else None), r


def test_composition_stops_at_cycles(spark):
    edges = [(1, 2, "a"), (2, 3, "b"), (3, 2, "back"), (1, 3, "c"), (3, 4, "d"), (7, 8, "x"), (8, 7, "y"), (None, 2, "z"), (2, None, "z"), (1, 2, "a")]
    got = {(r["node"], "/".join(r["labels"])) for r in compose.compose(spark.createDataFrame(edges, "parent long, child long, label string")).collect()}
    assert got == {(1, ""), (2, "a"), (3, "a/b"), (4, "a/b/d"), (3, "c"), (2, "c/back"), (4, "c/d")}
    chain = spark.createDataFrame([(i, i + 1, str(i)) for i in range(12)], "parent long, child long, label string")
    assert max(len(r["labels"]) for r in compose.compose(chain).collect()) == 12


def masked(spark, rows):
    files = spark.createDataFrame([("u", p, p.rsplit("/", 1)[-1], p.rsplit(".", 1)[-1], t) for p, t in rows], "unit string, rel_path string, name string, ext string, text string")
    return extract.masked(files)


LARAVEL = """<?php
use Illuminate\\Support\\Facades\\Route;
// Route::get('/commented', fn () => 1);
Route::get('/health', HealthController::class);
Route::domain('{tenant}.example.test')->middleware(['web', 'auth'])->prefix('admin')->name('admin.')->group(function () {
    Route::get('/users', [UserController::class, 'index'])->name('users.index')->middleware('can:list');
    Route::prefix('reports')->middleware('audit')->controller(ReportController::class)->group(function () {
        Route::match(['get', 'post'], '/run/{id}', 'run')->name('reports.run');
        Route::group(['x' => 1], function () { Route::delete('old', 'OldController@drop'); });
    });
    Route::any('ping', fn () => strtoupper('pong'));
});
Route::apiResource('photos', PhotoController::class)->only(['index', 'update']);
Route::resource('posts.comments', CommentController::class)->except('edit', 'create', 'destroy');
Route::resources(['tags' => TagController::class, 'notes' => NoteController::class], ['only' => 'x'])->only('show');
Route::view('/static', 'page');
"""


def test_route_groups(spark):
    rows = route_groups.group_routes(masked(spark, [("routes/web.php", LARAVEL), ("app/web.php", "Route::get('/not', 'x');")])).collect()
    got = {(r["method"], r["path"]): r for r in rows}
    assert len(got) == len(rows)
    admin = {(m, "/admin/ping") for m in ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS")}
    assert set(got) == admin | {
        ("GET", "/health"), ("GET", "/admin/users"), ("GET", "/admin/reports/run/{id}"), ("POST", "/admin/reports/run/{id}"), ("DELETE", "/admin/reports/old"),
        ("GET", "/photos"), ("PUT", "/photos/{photo}"), ("GET", "/posts/comments"), ("POST", "/posts/comments"), ("GET", "/posts/comments/{comment}"), ("PUT", "/posts/comments/{comment}"),
        ("GET", "/tags/{tag}"), ("GET", "/notes/{note}"),
    }
    users, run, old = got["GET", "/admin/users"], got["POST", "/admin/reports/run/{id}"], got["DELETE", "/admin/reports/old"]
    assert (users["route_name"], users["domain"], users["middleware"], users["controller"], users["action"]) == ("admin.users.index", "{tenant}.example.test", ["auth", "can:list", "web"], "UserController", "index")
    assert (run["route_name"], run["middleware"], run["controller"], run["action"]) == ("admin.reports.run", ["audit", "auth", "web"], "ReportController", "run")
    assert (old["controller"], old["action"], old["middleware"]) == ("OldController", "drop", ["audit", "auth", "web"])
    assert (got["GET", "/health"]["controller"], got["GET", "/health"]["route_name"], got["GET", "/health"]["domain"]) == ("HealthController", None, None)
    assert (got["PUT", "/photos/{photo}"]["route_name"], got["PUT", "/photos/{photo}"]["action"]) == ("photos.update", "update")


def test_routers_nest_across_files(spark):
    levels = [(f"src/m{i}.rs", f'pub fn r{i}() -> Router {{ Router::new().nest("/l{i}", m{i + 1}::r{i + 1}()) }}') for i in range(1, 7)]
    files = [
        ("src/main.rs", 'fn app() -> Router { Router::new().route("/", get(home)).nest("/api", api::routes()).nest("/deep", m1::r1()) }\nfn same() -> Router { Router::new().route("/same", any(x)) }'),
        ("src/api.rs", 'pub fn routes() -> Router {\n // {\n Router::new().route("/users", get(list).post(add)).route("/x", post(y)).nest("/v1", same()).nest("/loop", routes()) }\nfn same() -> Router { Router::new().route("/inner", delete(z)) }'),
        *levels, ("src/m7.rs", 'pub fn r7() -> Router { Router::new().route("/end", patch(h)) }'),
    ]
    got = {(r["file"], f"{r['method']} {r['path']}") for r in route_groups.router_routes(masked(spark, files)).collect()}
    assert got == {
        ("src/main.rs", "GET /"), ("src/main.rs", "ANY /same"), ("src/api.rs", "GET /api/users"), ("src/api.rs", "POST /api/x"), ("src/api.rs", "DELETE /api/v1/inner"),
        ("src/m7.rs", "PATCH /deep/l1/l2/l3/l4/l5/l6/end"),
    }


def test_http_calls_and_annotations_of_any_length(spark):
    long = ", ".join(f"'X-{i}': [{i}, {{a: ({i})}}]" for i in range(120))
    ts = f"fetch('/api/items', {{ headers: {{ {long} }}, body: f(g(h(1))), method: 'POST' }});\naxios.get(base + '/a' + String([1, (2)]), {{ params: {{}} }});\naxios.delete(`/b/${{f(x, (y))}}`);"
    java = "@RestController @RequestMapping(value = {\"/one\", \"/two\"}, produces = f(g(\"x\")))\npublic class C {\n @GetMapping(path = \"/x\", headers = {" + ", ".join(f'"h{i}=(("' for i in range(90)) + "})\n int a() {}\n @PostMapping\n int b() {}\n}"
    files = masked(spark, [("a.ts", ts), ("C.java", java)])
    assert {(r["method"], r["path"]) for r in extract.http_calls(files).collect()} == {("POST", "/api/items"), ("GET", "/a"), ("DELETE", "/b/${f(x, (y))}")} or pytest.fail(str(extract.http_calls(files).collect()))
    assert {(r["method"], r["path"]) for r in extract.spring_routes(files).collect()} == {("GET", "/one/x"), ("GET", "/two/x"), ("POST", "/one"), ("POST", "/two")}


PHP = r"""<?php
namespace App;
// function no(Type $x)
# also no
class Mailer extends Base {
    use Sends;
    public function __construct(private readonly ?Transport $t, protected Log|File $log = new Log(1, 2), array $opts = ['a' => fn (Inner $i) => $i], string ...$rest) {}
    private static function sendAll(\App\Queue $q, int $n = self::MAX, $loose = null): void {
        $this->t->push("it's (not) a call->x()", $q); Log::write('y'); $q?->next()->go();
        $text = <<<EOT
            function hidden(Nope $x) { $this->nope(); }
            EOT;
        array_map(function (Row $row) use ($q) { return $row; }, []);
    }
}
function helper(&$ref, Foo&Bar $both) { /* ( */ return strlen($ref); }
"""


def test_php_tokens_and_structure(spark):
    from weft.operators import php

    df = spark.createDataFrame([(1, PHP), (2, None), (3, ""), (4, "function f(" + ", ".join(f"T{i} $v{i}" for i in range(300)) + ") {} g('" + "x" * 50_000)], "id long, t string").repartition(2)
    found = php.tokens(df, ["id"], "t").cache()
    kinds = {(r["kind"], r["value"][:8]) for r in found.where("id = 1").collect()}
    assert ("heredoc", "<<<EOT\n ") in kinds and ("comment", "// funct") in kinds and ("symbol", "?->") in kinds and ("name", "\\App\\Que") in kinds
    got = [(r["function"], r["ord"], r["type"], r["variable"]) for r in php.parameters(found, ["id"]).where("id = 1").orderBy("pos", "ord").collect()]
    assert got == [
        ("__construct", 0, "Transport", "$t"), ("__construct", 1, "Log|File", "$log"), ("__construct", 2, "array", "$opts"), ("__construct", 3, "string", "$rest"),
        ("sendAll", 0, "\\App\\Queue", "$q"), ("sendAll", 1, "int", "$n"), ("sendAll", 2, None, "$loose"), ("helper", 0, None, "$ref"), ("helper", 1, "Foo|Bar", "$both"),
    ]
    calls = {(r["receiver"], r["operator"], r["name"]) for r in php.calls(found, ["id"]).collect()}
    assert calls == {("t", "->", "push"), ("Log", "::", "write"), ("$q", "?->", "next"), (None, "->", "go")}
    assert {(r["function"], r["type"]) for r in php.injected(found.where("id = 1"), ["id"]).collect()} >= {("__construct", "Transport"), ("sendAll", "\\App\\Queue")}
    assert php.parameters(found, ["id"]).where("id = 4").count() == 300


def test_ordered_digest(spark):
    from weft.operators.merkle import merkle

    rows = [(i // 3, f"v{i}" if i % 7 else None, i) for i in range(2000)]
    digest = lambda r, parts, fan=16: merkle(spark.createDataFrame(r, "k int, v string, i int").repartition(parts), ["k", "i"], ["k", "v"], fan).first()
    one = digest(rows, 1)
    assert one == digest(rows[::-1], 7) and one["n_rows"] == 2000
    swapped = rows.copy()
    swapped[10], swapped[500] = (*rows[10][:1], rows[500][1], rows[10][2]), (*rows[500][:1], rows[10][1], rows[500][2])
    assert digest(swapped, 3)["digest"] != one["digest"] and digest(rows[:-1], 3)["digest"] != one["digest"]
    assert digest(rows[:1], 2)["n_rows"] == 1
    empty = merkle(spark.createDataFrame([], "k int, v string"), ["k"], ["v"]).first()
    assert empty["n_rows"] == 0
