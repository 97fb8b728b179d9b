"""The text index against a search of every text, and the budget against a fold."""

import random

from weft.operators import text_index


def test_markers_as_by_search(spark):
    texts = ["jdbc:postgresql://h", "POSTGRES://x", "postgres", "a redis-cache", "predisx", "", None, "mongo db", "mongodb+srv://", "naïve É", "--", "x" * 5000 + "redis", "redis"]
    files = spark.createDataFrame([("u", str(i), t) for i, t in enumerate(texts)] + [("v", "0", "redis redis")], "unit string, rel_path string, text string")
    markers = ["jdbc:postgresql://", "postgres", "redis", "Mongo DB", "mongodb+srv://", "--", "É", "none-such", "a r"]
    found = text_index.holding(text_index.build(files, ["unit", "rel_path"]), files, ["unit", "rel_path"], markers)
    low = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
    want = {(m, "u", str(i)) for m in markers for i, t in enumerate(texts) if t and low(m) in low(t)} | {("redis", "v", "0")}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


def test_rare_markers_read_few_postings(spark):
    files = spark.createDataFrame([(i, f"common words number {i}") for i in range(300)], "id int, text string")
    postings = text_index.build(files, ["id"])
    assert postings.where("token = 'common'").count() == 300 and postings.where("token = '7'").count() == 1
    held = text_index.holding(postings, files, ["id"], ["number 17"])
    assert {r.id for r in held.collect()} == {17, *range(170, 180)}


def test_budget_is_greedy_by_path(spark):
    rng = random.Random(3)
    rows = [(u, f"{i:04}", rng.choice([1, 3, 7, 20, 45, 90, 101])) for u in ("a", "b") for i in range(120)] + [("c", "x", 5), ("c", "y", None), ("d", "z", 500)]
    want = set()
    for unit in "abcd":
        room = 400
        for u, p, s in sorted(r for r in rows if r[0] == unit and r[2] is not None):
            if s <= 100 and s <= room:
                room -= s
                want.add((u, p))
    taken, said = text_index.within_budget(spark.createDataFrame(rows, "unit string, rel_path string, size int"), 100, 400)
    assert {(r.unit, r.rel_path) for r in taken.collect()} == want
    assert {r.unit for r in said.collect()} == {"a", "b"}
    assert text_index.within_budget(taken.limit(0))[0].isEmpty()
