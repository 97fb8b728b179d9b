"""Imports beside a plain search of all files, and how much of them is shuffled."""

import random

from weft.operators import extract


def joined(base, rel):
    out = []
    for s in [*base.split("/"), *rel.split("/")]:
        if s == "..":
            out = out[:-1]
        elif s not in ("", "."):
            out.append(s)
    return "/".join(out)


def resolved(paths, rel, language, spec):
    ends = next(own for family, own in extract.ENDINGS.items() if family and language in family) if language != "Java" else extract.ENDINGS[None]
    stem = joined(rel.rpartition("/")[0], spec) if spec.startswith(".") and "/" in spec else spec.removeprefix("/") if "/" in spec else spec.removesuffix(".*").replace(".", "/")
    tries = [stem, *(stem + e for e in ends)]
    exact = [t for t in tries if t in paths]
    ending = {p for t in tries if "/" in t for p in paths if f"/{p}".endswith(f"/{t}")}
    return exact[0] if exact else ending.pop() if len(ending) == 1 else None


def test_import_edges_are_one_row_an_import(spark):
    rng = random.Random(3)
    some = lambda k: "/".join(rng.choice("abc") for _ in range(k))
    paths = sorted({some(rng.randint(1, 4)) + rng.choice([".ts", ".tsx", "/index.ts", ".js", ".py", "/__init__.py", ".java", ".vue", ""]) for _ in range(60)})
    rows = []
    for _ in range(500):
        rel = rng.choice(paths)
        spec = rng.choice(["./", "../", "", "/", "../../"]) + some(rng.randint(1, 3))
        rows.append(("u", rel, rng.choice(["TypeScript", "Python", "Java"]), spec.replace("/", ".") if rng.random() < 0.3 and not spec.startswith((".", "/")) else spec))
    files = spark.createDataFrame([(u, p) for p in paths for u in "uv"], "unit string, rel_path string")
    found = spark.createDataFrame(rows, "unit string, rel_path string, language string, specifier string")
    # a file has one language; here each import brings its own, so they are asked language by language
    want = {(lang, u, rel, t) for u, rel, lang, spec in rows if (t := resolved(set(paths), rel, lang, spec)) and t != rel}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = set()
        for lang in ("TypeScript", "Python", "Java"):
            edges = extract.import_edges(files, found.where(f"language = '{lang}'"))
            got |= {(lang, r["unit"], r["source"], r["target"]) for r in edges.collect()}
            assert edges._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == want and len(want) > 100
