"""Calls beside a plain search of each text's tokens, and what they cost."""

import random
import re

import pytest

from weft.operators import extract, structure

CODE = ["f(", "f [", "(", ")", "[", "]", "{", "}", ",", ", ", "x", "'a(,'", '"b)"', "`c\n,`", "'open(\n", "f(", "f(a, b)", "é", "éf(", " f (", "\n", "日,"]
MARKER = r"\bf\s*[(\[]"


def spans(code):
    token = re.compile(r"(?s)" + structure.STRING + "|" + MARKER + r"|[()\[\]{},]")
    marks = [m for m in token.finditer(code) if m[0][-1] in "([{)]},"]
    step = {**dict.fromkeys("([{", 1), **dict.fromkeys(")]}", -1), ",": 0}
    depth = [sum(step[x[0][-1]] for x in marks[: i + 1]) for i in range(len(marks))]
    for i, m in enumerate(marks):
        if m[0][-1] not in "([{" or len(m[0]) == 1:
            continue
        kind = {"(": "()", "[": "[]", "{": "{}"}[m[0][-1]]
        level = 1
        for j in range(i + 1, len(marks)):
            level += step[marks[j][0][-1]] * (marks[j][0][-1] in kind)
            if not level:
                commas = [x.start() for x, d in zip(marks[i + 1 : j], depth[i + 1 :]) if x[0] == "," and d == depth[i]]
                stop = marks[j].start()
                yield m.start(), marks[j].end(), m[0], code[m.end() : stop], code[m.end() : min([stop, *commas])]
                break


@pytest.fixture(scope="module")
def codes():
    rng = random.Random(7)
    return ["".join(rng.choice(CODE) for _ in range(rng.randint(1, 40))) for _ in range(400)]


def test_calls_of_broken_code(spark, codes):
    df = spark.createDataFrame([*enumerate(codes), (-1, None)], "id long, t string").repartition(3)
    got = sorted(tuple(r) for r in structure.calls(df, ["id"], "t", MARKER).select("id", "start", "end", "token", "argument", "first").collect())
    want = sorted((i, *x) for i, t in enumerate(codes) if re.search(MARKER, t) for x in spans(t))
    assert got == want and len(want) > 500


def test_calls_are_found_where_their_files_lie(spark):
    files = spark.createDataFrame([("u", "a.ts", "ts", "axios.get('/a'); fetch('/b', {method: 'PUT'})"), ("u", "b.ts", "ts", None)], "unit string, rel_path string, ext string, masked string")
    found = extract.http_calls(files)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1
    assert {tuple(r) for r in found.collect()} == {("u", "a.ts", "GET", "/a", None), ("u", "a.ts", "PUT", "/b", None)}
