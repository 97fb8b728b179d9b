"""Approximate nearest neighbours by cosine over balanced posting lists.

A bounded sample gives centroids (spherical k-means that keeps moving the
emptiest centroid to the fullest list). Every vector is written to its nearest
list and, if it lies near a boundary, to up to `replicas` lists whose centroids
are at most `boundary` times as far. Queries walk a graph of the centroids held
in memory, and visit every list at most `ratio` times as far as the nearest.
Long lists, and lists that many queries visit, are dealt in blocks of bounded
size, each block of rows against each block of queries, so no task holds a whole
list. Scores are computed in double precision on the original vectors.

A query visits its lists in two rounds: the nearest first, the square root of their
number, then the others. What the first has found bounds the second: a row below a
query's k + 1 best so far cannot be in its answer and is not written. All lists are
read, but a query's scores grow with the root of its lists instead of their number.

Equal vectors are indexed once; of each, the k + 1 smallest ids are kept, which
is all that an answer of k can name, so copies cost nothing and none is lost.

A list's size grows with the table once there are `MAX_LISTS` lists; blocks keep
every task's share bounded. How much a query must read for a given recall depends on
the data: with clusters a few lists hold all neighbours, while random directions
leave boundaries everywhere (figures in the README).

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component
take no part; vectors of each length are searched on their own, as no cosine is defined
between lengths; components of any size are scaled by a power of two first, which
changes no cosine; rows that repeat an id count as that id's one row of that length;
ties go to the smaller id; a query with fewer candidates gets all; no vectors, no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Bytes of sample vectors the driver holds at most.
SAMPLE_BYTES = 64 << 20
MAX_LISTS = 4096
OUT = "query_id long, rank int, vec_id long, score double"


@dataclass
class Index:
    centroids: np.ndarray  # unit rows
    near: list[np.ndarray]  # the graph: neighbours of each centroid
    start: int

    def lists(self, q: np.ndarray, ratio: float) -> np.ndarray:
        """Lists within ratio of the nearest, nearest first, found by best-first search over the graph."""
        c = self.centroids
        dist = lambda i: np.sqrt(np.maximum(0, 2 - 2 * (c[i] @ q)))
        seen = np.zeros(len(c), bool)
        seen[self.start] = True
        d = float(dist(np.array([self.start]))[0])
        heap, found, best, calm = [(d, self.start)], [], d, 0
        while heap:
            d, i = heapq.heappop(heap)
            calm = calm + 1 if d > best * ratio else 0
            if calm > 8:  # a few steps beyond the limit, to pass over gaps in the graph
                break
            found.append((d, i))
            new = self.near[i][~seen[self.near[i]]]
            if len(new):
                seen[new] = True
                for x, j in zip(dist(new).tolist(), new.tolist()):
                    best = min(best, x)
                    heapq.heappush(heap, (x, j))
        found += heap
        return np.array([i for d, i in sorted(found) if d <= best * ratio + 1e-9], np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, lists: int, rounds: int = 10, degree: int = 16, seed: int = 3) -> Index:
    rng = np.random.default_rng(seed)
    x = unit(sample).astype(np.float32)
    k = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.bincount(own, minlength=k)
        order = np.argsort(size, kind="stable")
        for low, high in zip(order[: k // 16 + 1], order[::-1]):  # balance: the emptiest go to the fullest
            if size[high] > 2 * max(1, len(x) / k) and size[low] < size[high] // 4:
                sums[low] = x[rng.choice(np.flatnonzero(own == high))]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c).astype(np.float32)
    near = []
    for i in range(k):
        order = np.argsort(-(c @ c[i]), kind="stable")
        links = order[order != i][:degree]
        far = rng.choice(k, min(4, k), replace=False)
        near.append(np.unique(np.concatenate([links, far[far != i]])))
    back: list[list[int]] = [[] for _ in range(k)]
    for i, n in enumerate(near):
        for j in n:
            back[j].append(i)
    near = [np.unique(np.concatenate([n, np.array(b, np.int64)])).astype(np.int64) for n, b in zip(near, back)]
    return Index(c.astype(np.float64), near, int((c @ c.mean(0)).argmax()))


def _matrix(col: pd.Series) -> np.ndarray:
    """Rows scaled by powers of two so that their largest component is 0.5 to 1: squares neither overflow nor vanish."""
    x = np.stack(col.to_numpy()).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def postings(centroids: np.ndarray, x: np.ndarray, replicas: int, boundary: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of each list that a row of x belongs to: the nearest, and those at most boundary times as far."""
    d = np.sqrt(np.maximum(0, 2 - 2 * (x @ centroids.T)))
    own = np.argsort(d, axis=1, kind="stable")[:, : min(replicas, len(centroids))]
    far = np.take_along_axis(d, own, 1)
    row, col = np.nonzero(far <= far[:, :1] * boundary + 1e-12)
    return row, own[row, col]


def rounds_of(lists: int, rounds: int) -> np.ndarray:
    """The round of each of a query's lists, nearest first: round r ends at lists ** ((r + 1) / rounds)."""
    ends = np.ceil(lists ** (np.arange(1, rounds) / rounds) - 1e-9)
    return np.searchsorted(ends, np.arange(lists), side="right")


def top(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, row's place, cosine) of the k best rows of each query, ties to the smaller id; none below least, if given."""
    rough = unit(queries) @ unit(rows).T
    if rough.shape[1] > k:
        limit = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k] - 1e-9
    else:
        limit = np.full(len(queries), -2.0)
    if least is not None:
        limit = np.maximum(limit, least - 1e-9)
    qi, ri = np.nonzero(rough >= limit[:, None])
    a, b = queries[qi], rows[ri]
    score = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
    order = np.lexsort((ids[ri], -score, qi))
    qi, ri, score = qi[order], ri[order], score[order]
    place = np.arange(len(qi)) - np.searchsorted(qi, qi)
    keep = place < k
    if least is not None:
        keep &= score >= least[qi] - 1e-12  # what the rounding of equal vectors' scores may differ by
    return qi[keep], ri[keep], score[keep]


def search(vectors: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query holds. how: see _search."""
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"  # floats are widened where they are scored
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v"), is_query.alias("q"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(F.col("id").isNotNull() & fine)
    lengths = sorted(r["n"] for r in v.select(F.size("v").alias("n")).distinct().collect())  # nearly always one
    if not lengths:
        return vectors.sparkSession.createDataFrame([], OUT)
    return reduce(DataFrame.unionByName, [_search(v.where(F.size("v") == n), n, k, **how) for n in lengths])


def _search(
    v: DataFrame, dim: int, k: int, rows_per_list: int = 120, replicas: int = 2, boundary: float = 1.03,
    ratio: float = 1.28, sample_rows: int = 20_000, block: int = 2048, rounds: int = 2,
) -> DataFrame:
    """Of v(id, v, q), vectors of one length."""
    spark = v.sparkSession
    # distinct vectors: one representative, the k + 1 smallest ids; the limit is applied before the shuffle
    least = Window.partitionBy("v").orderBy("id")
    ranked = v.select("v", "id").withColumn("n", F.dense_rank().over(least)).where(F.col("n") <= k + 1)
    distinct = cut(ranked.groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_set("id")).alias("ids")))
    asked = v.where("q").select("id", "v").distinct().join(distinct.select("v", "rep"), "v").select(F.col("id").alias("query_id"), F.col("rep").alias("qrep"), "v")
    asked = cut(asked)
    n = distinct.count()
    bound = max(1, min(sample_rows, SAMPLE_BYTES // (8 * dim)))
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").select("v").limit(bound).toPandas()
    index = fit(_matrix(sample["v"]) if len(sample) else np.zeros((0, dim)), min(MAX_LISTS, -(-n // rows_per_list)))
    sent = spark.sparkContext.broadcast(index)  # at most MAX_LISTS centroids

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value.centroids
        for b in batches:
            if not len(b):
                continue
            row, lists = postings(c, unit(_matrix(b["v"])), replicas, boundary)
            yield pd.DataFrame({"list": lists, "rep": b["rep"].to_numpy()[row], "v": b["v"].to_numpy()[row]})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = sent.value
        for b in batches:
            if not len(b):
                continue
            found = [ix.lists(q, ratio) for q in unit(_matrix(b["v"]))]
            row = np.repeat(np.arange(len(b)), [len(f) for f in found])
            turn = np.concatenate([rounds_of(len(f), rounds) for f in found])
            yield pd.DataFrame({"list": np.concatenate(found), "round": turn, "qrep": b["qrep"].to_numpy()[row]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: small partitions would be joined to one task
    kind = dict(distinct.dtypes)["v"]
    posted = distinct.select("rep", "v").mapInPandas(place, f"list long, rep long, v {kind}")
    queries = asked.groupBy("qrep").agg(F.first("v").alias("v"))
    visits = queries.repartition(parts, "qrep").mapInPandas(visit, "list long, round int, qrep long")
    posted, visits = cut(posted), cut(visits)
    steps = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    key = ["list", "rb", "qb"]

    def score(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"qrep": [], "rep": [], "score": []})
        reps = rows["rep"].to_numpy()
        qi, ri, s = top(_matrix(queries["v"]), _matrix(rows["v"]), reps, k + 1, queries["least"].to_numpy())
        return pd.DataFrame({"qrep": queries["qrep"].to_numpy()[qi], "rep": reps[ri], "score": s})

    def scored(asking: DataFrame) -> DataFrame:
        """Scores of the rows in the lists that asking(list, qrep, v, least) visits."""
        # blocks by list: their numbers are as many as centroids, so they may be broadcast
        splits = F.broadcast(
            posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("rs"))
            .join(asking.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("qs")), "list")
        )
        left = posted.join(splits, "list").withColumn("rb", F.pmod(F.xxhash64("rep"), F.col("rs")).cast("int")).withColumn("qb", steps("qs"))
        right = asking.join(splits, "list").withColumn("qb", F.pmod(F.xxhash64("qrep"), F.col("qs")).cast("int")).withColumn("rb", steps("rs"))
        sides = left.select(*key, "rep", "v").groupBy(*key).cogroup(right.select(*key, "qrep", "v", "least").groupBy(*key))
        return sides.applyInPandas(score, "qrep long, rep long, score double")

    hits, bounded = None, queries.withColumn("least", F.lit(-2.0))
    for r in range(rounds):
        found = scored(visits.where(F.col("round") == r).join(bounded, "qrep").select("list", "qrep", "v", "least"))
        hits = (found if hits is None else hits.unionByName(found)).groupBy("qrep", "rep").agg(F.max("score").alias("score"))
        if r < rounds - 1:
            nth = F.row_number().over(Window.partitionBy("qrep").orderBy(F.desc("score"), "rep"))
            hits = cut(hits.withColumn("n", nth).where(F.col("n") <= k + 1).drop("n"))  # k + 1 rows a query
            least = hits.groupBy("qrep").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("m")).where(F.col("m") > k).select("qrep", "least")
            bounded = queries.join(least, "qrep", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    best = Window.partitionBy("qrep").orderBy(F.desc("score"), "rep")
    hits = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    named = hits.join(distinct.select("rep", "ids"), "rep").select("qrep", "score", F.explode("ids").alias("vec_id"))
    # of k + 1 candidates in order, at most one is the query itself
    short = Window.partitionBy("qrep").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("n", F.row_number().over(short)).where(F.col("n") <= k + 1).select("qrep", "vec_id", "score")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = asked.select("query_id", "qrep").join(named, "qrep").where("vec_id != query_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
