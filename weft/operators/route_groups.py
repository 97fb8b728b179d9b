"""Routes declared by call chains inside nested groups, and by routers nested in functions.

Chains and groups are read from matched brackets (structure.py): a call with what is chained
to it is one row, a group's argument is a scope, and what scopes pass on to the routes inside
them (path prefixes joined, middleware united, name prefixes joined, the innermost domain and controller)
comes from an as-of join by level, so nesting has no limit. Functions that nest one another's routers may lie in
different files; their prefixes are composed along every path of that graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import structure
from .compose import compose

KEYS = ["unit", "rel_path"]
_CALL = r"(?:\b|\\)Route\s*::\s*\w+\s*\(|\s*->\s*\w+\s*\("
VERBS = ("get", "post", "put", "patch", "delete", "options")
RESOURCES = ("resource", "apiResource", "resources", "apiResources")
#: Actions of a resource: name, method, what follows its path; the last two are not an API's.
ACTIONS = [
    ("index", "GET", ""), ("store", "POST", ""), ("show", "GET", "/{resource}"), ("update", "PUT", "/{resource}"), ("destroy", "DELETE", "/{resource}"),
    ("create", "GET", "/create"), ("edit", "GET", "/{resource}/edit"),
]
_CLASS = r"([\w\\]+)\s*::\s*class"


def joined_path(*parts: Column) -> Column:
    """One slash before each segment."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.concat_ws("/", *parts), "/"), lambda s: s != ""), "/"))


def chains(files: DataFrame) -> DataFrame:
    """unit, rel_path, start, end, steps: each facade call with the calls chained to it, steps array<struct<start, end, name, argument, first>>."""
    found = structure.calls(files, KEYS, "masked", _CALL)
    found = structure.nested(found, KEYS).withColumn("name", F.regexp_extract("token", r"(\w+)\s*\($", 1))
    row = Window.partitionBy(*KEYS, "level").orderBy("start")
    linked = F.coalesce((F.lag("end").over(row) == F.col("start")) & F.ltrim("token").startswith("->"), F.lit(False))
    found = found.withColumn("new", F.when(linked, 0).otherwise(1))
    found = found.withColumn("chain", F.sum("new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    steps = F.array_sort(F.collect_list(F.struct("start", "end", "name", "argument", "first", "token")))
    out = found.groupBy(*KEYS, "level", "chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), steps.alias("steps"))
    return out.where(F.element_at("steps", 1)["token"].contains("::")).select(*KEYS, "start", "end", "steps")


def _said(steps: Column, name: str) -> Column:
    return F.filter(steps, lambda s: s["name"] == name)


def _strings(steps: Column, name: str) -> Column:
    """The first literal of each step of that name."""
    return F.filter(F.transform(_said(steps, name), lambda s: F.get(structure.literals(s["argument"]), F.lit(0))), lambda x: x.isNotNull())


def _context(steps: Column) -> list[Column]:
    """What a chain's steps add: prefix, middleware, name, domain, controller."""
    classes = F.transform(_said(steps, "controller"), lambda s: F.regexp_extract(s["argument"], _CLASS, 1))
    return [
        F.concat(F.lit("/"), F.array_join(_strings(steps, "prefix"), "/")).alias("prefix"),
        F.array_distinct(F.flatten(F.transform(_said(steps, "middleware"), lambda s: structure.literals(s["argument"])))).alias("middleware"),
        F.array_join(_strings(steps, "name"), "").alias("name"), F.try_element_at(_strings(steps, "domain"), F.lit(-1)).alias("domain"),
        F.nullif(F.try_element_at(classes, F.lit(-1)), F.lit("")).alias("controller"),
    ]


def group_routes(files: DataFrame) -> DataFrame:
    """framework, unit, file, method, path, route_name, domain, middleware, controller, action, confidence of the route facade's chains.

    A chain without a verb, a match or a resource declares nothing. Any stands for six methods, a match for those it lists."""
    php = files.where(F.col("rel_path").rlike(r"(^|/)routes/[^/]+\.php$") & F.col("masked").isNotNull())
    each = cut(chains(php.select(*KEYS, "masked")))  # read by several of the joins below
    names = F.transform("steps", lambda s: s["name"])
    group = F.element_at(_said(F.col("steps"), "group"), 1)
    inner = group["end"] - 1 - F.char_length(group["argument"])
    scopes = each.where(F.array_contains(names, "group")).select(*KEYS, inner.alias("start"), (group["end"] - 1).alias("end"), *_context(F.col("steps")))
    scopes = cut(structure.nested(scopes, KEYS))
    verbs = [*VERBS, "any", "match", *RESOURCES]
    verb = F.filter("steps", lambda s: s["name"].isin(*verbs))
    own = each.where(~F.array_contains(names, "group") & (F.size(verb) > 0)).withColumn("verb", F.element_at(verb, 1))
    own = own.select(*KEYS, "start", "end", "steps", "verb", *_context(F.col("steps")))
    own = cut(structure.enclosed(own, scopes, KEYS))
    got = structure.inherited(own, scopes, KEYS, joined=["prefix", "name"], united=["middleware"], innermost=["domain", "controller"])
    argument, said = F.col("verb")["argument"], F.col("verb")["name"]
    listed = F.regexp_extract(argument, r"(?s)^\s*(\[[^\]]*\]|'[^']*'|\"[^\"]*\")\s*,", 1)  # a match names its methods first
    rest = F.when(said == "match", F.expr("substring(verb.argument, instr(verb.argument, listed) + char_length(listed))")).otherwise(argument)
    got = got.withColumn("listed", listed).withColumn("rest", rest).withColumn("said", said)
    first = F.get(structure.literals(F.col("rest")), F.lit(0))
    got = got.withColumn("first", first).where("first IS NOT NULL")
    handler = F.expr("substring(rest, instr(rest, first) + char_length(first) + 1)")
    got = got.withColumn("handler", handler)
    base = [F.col(c) for c in (*KEYS, "steps", "all_prefix", "prefix", "all_name", "name", "all_middleware", "middleware", "all_domain", "domain", "all_controller", "controller", "said")]

    methods = F.when(F.col("said") == "any", F.array(*map(F.lit, map(str.upper, VERBS)))).when(F.col("said") == "match", F.transform(structure.literals(F.col("listed")), F.upper)).otherwise(F.array(F.upper("said")))
    plain = got.where(~F.col("said").isin(*RESOURCES)).select(*base, F.explode(methods).alias("method"), F.col("first").alias("tail"), "handler", F.lit(None).cast("string").alias("resource_name"), F.lit(None).cast("string").alias("resource_action"))

    # resources list several as 'photos' => PhotoController::class; a single one is the same with a comma
    each_resource = F.when(F.col("said").isin("resources", "apiResources"), F.regexp_extract_all("rest", F.lit(r"""(?s)['"][^'"]+['"]\s*=>\s*[\w\\]+\s*::\s*class"""), F.lit(0))).otherwise(F.array("rest"))
    res = got.where(F.col("said").isin(*RESOURCES)).select(*base, F.explode(each_resource).alias("entry"))
    res = res.withColumn("what", F.get(structure.literals(F.col("entry")), F.lit(0)))
    actions = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(m).alias("method"), F.lit(t).alias("tail"), F.lit(i >= 5).alias("page")) for i, (a, m, t) in enumerate(ACTIONS)])
    listed_in = lambda name: F.flatten(F.transform(_said(F.col("steps"), name), lambda s: structure.literals(s["argument"])))
    res = res.withColumn("only", listed_in("only")).withColumn("except", listed_in("except"))
    res = res.withColumn("x", F.explode(actions)).where(~(F.col("x.page") & F.col("said").startswith("api")) & ((F.size("only") == 0) | F.expr("array_contains(only, x.action)")) & ~F.expr("array_contains(except, x.action)"))
    member = F.regexp_replace(F.regexp_extract("what", r"([^./]*)$", 1), "s+$", "")
    tail = F.concat(F.lit("/"), F.replace("what", F.lit("."), F.lit("/")), F.replace("x.tail", F.lit("{resource}"), F.concat(F.lit("{"), member, F.lit("}"))))
    res = res.select(*base, F.col("x.method").alias("method"), tail.alias("tail"), F.regexp_extract("entry", rf"(?s)({_CLASS})", 1).alias("handler"), F.concat_ws(".", F.replace("what", F.lit("/"), F.lit(".")), "x.action").alias("resource_name"), F.col("x.action").alias("resource_action"))

    rows = plain.unionByName(res)
    texts = structure.literals(F.col("handler"))
    at = F.filter(texts, lambda x: x.contains("@"))
    named = F.get(texts, F.lit(0))
    klass = F.nullif(F.regexp_extract("handler", _CLASS, 1), F.lit(""))
    controller = F.when(F.size(at) > 0, F.substring_index(F.get(at, F.lit(0)), "@", 1)).when(named.endswith("Controller"), named).otherwise(klass)
    action = F.when(F.size(at) > 0, F.substring_index(F.get(at, F.lit(0)), "@", -1)).when(named.endswith("Controller"), F.lit("__invoke")).when(klass.isNotNull(), F.try_element_at(texts, F.lit(-1))).otherwise(named)
    direct = F.coalesce(F.col("resource_name"), F.when(F.col("name") != "", F.lit("")))
    return rows.select(
        F.lit("Laravel").alias("framework"), "unit", F.col("rel_path").alias("file"), "method", joined_path(F.col("all_prefix"), F.col("prefix"), F.col("tail")).alias("path"),
        F.when(direct.isNotNull(), F.concat("all_name", "name", direct)).alias("route_name"), F.coalesce("domain", "all_domain").alias("domain"),
        F.array_sort(F.array_union("all_middleware", "middleware")).alias("middleware"), F.coalesce(controller, F.col("controller"), F.col("all_controller")).alias("controller"),
        F.coalesce("resource_action", action).alias("action"), F.lit(100).alias("confidence"),
    )


def router_routes(files: DataFrame) -> DataFrame:
    """framework, unit, file, method, path, confidence: routes under every composition of the prefixes at which routers nest the
    router of their function. A nested name means the function of its own file, else the only one of the unit."""
    rust = files.where((F.col("ext") == "rs") & F.col("masked").isNotNull()).select(*KEYS, "masked")
    bodies = structure.calls(rust, KEYS, "masked", r"\bfn\s+\w+[^{};]*\{").withColumn("fn", F.regexp_extract("token", r"^fn\s+(\w+)", 1))
    scopes = cut(structure.nested(bodies.select(*KEYS, "start", "end", "fn"), KEYS))
    used = structure.calls(rust, KEYS, "masked", r"\.(?:nest|route)\s*\(")
    used = cut(structure.enclosed(used, scopes, KEYS))
    used = structure.inherited(used, scopes, KEYS, innermost=["fn"]).withColumn("prefix", F.get(structure.literals(F.col("first")), F.lit(0))).where("prefix IS NOT NULL")
    used = cut(used)
    nests = used.where(F.col("token").contains("nest") & F.col("all_fn").isNotNull()).select(*KEYS, F.col("all_fn").alias("outer"), "prefix", F.regexp_extract("argument", r"(?s)^[^,]*,\s*(?:\w+\s*::\s*)*(\w+)", 1).alias("inner"))
    known = scopes.select("unit", F.col("rel_path").alias("home"), F.col("fn").alias("inner")).distinct()
    only = known.groupBy("unit", "inner").agg(F.min("home").alias("single"), F.count(F.lit(1)).alias("n"))
    here = known.select("unit", F.col("home").alias("rel_path"), "inner", F.lit(True).alias("here"))
    edges = nests.join(here, ["unit", "rel_path", "inner"], "left").join(only, ["unit", "inner"], "left")
    home = F.when(F.col("here"), F.col("rel_path")).when(F.col("n") == 1, F.col("single"))
    edges = edges.select(F.struct("unit", F.col("rel_path").alias("file"), F.col("outer").alias("fn")).alias("parent"), F.when(home.isNotNull(), F.struct("unit", home.alias("file"), F.col("inner").alias("fn"))).alias("child"), F.col("prefix").alias("label"))
    prefixes = compose(edges).select(F.col("node.unit").alias("unit"), F.col("node.file").alias("rel_path"), F.col("node.fn").alias("all_fn"), F.array_join("labels", "/").alias("under"))
    verb = F.upper(F.regexp_extract("argument", r"\b(get|post|put|patch|delete)\(", 1))
    routes = used.where(F.col("token").contains("route")).select(*KEYS, F.coalesce("all_fn", F.lit("")).alias("all_fn"), F.when(verb == "", F.lit("ANY")).otherwise(verb).alias("method"), "prefix")
    rows = routes.join(prefixes, [*KEYS, "all_fn"], "left")
    return rows.select(F.lit("Rust web").alias("framework"), "unit", F.col("rel_path").alias("file"), "method", joined_path(F.coalesce("under", F.lit("")), F.col("prefix")).alias("path"), F.lit(90).alias("confidence"))
