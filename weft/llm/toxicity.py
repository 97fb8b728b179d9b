"""Toxicity: a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings of itself and its prefixes. Filters of
several widths slide over the word vectors of the whole text; their maxima over
the text feed one logistic unit. The score is shifted so that 0.3 is the best
threshold on labelled rows that the fit has not learned from, and thresholds by
language are calibrated on the same rows (languages with under 20 positives among
them share the common one). Only text enters the score.

Training reads at most `sample_rows` labelled rows with at most `sample_mb` of text,
documented bounds: ids in the order of a hash, of each id the text with the smallest
hash, texts that would pass the second bound left out. Thresholds
cover all other labelled rows that are not held out, and the fifth of the sample
that is held back: Spark scores them and counts by language and score bin. Scoring
runs over whole texts in Arrow batches, of which ROWS rows at a time are texts in Python.
For scoring, each word's vector is computed once and looked up; a text's vectors are
multiplied with all filters at once, which equals the convolution, and only for it.

Edge cases: null and empty texts are scored as texts without words; null labels
take no part in training, of repeated labels the largest counts; without labels
of both kinds every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..session import cut
from .common import plain, trim

WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6, 7)
WIDTHS = (1, 2, 3)
THRESHOLD = 0.3
PAD = max(WIDTHS) - 1
#: Words a task keeps vectors for before it starts anew: 4 bytes x dim each.
VOCABULARY = 250_000
#: Rows scored at a time: what a worker holds besides a batch does not grow with the batch.
ROWS = 256
#: Bits that tell which ids may be labelled: 1 MB.
BITS = 1 << 23


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features(word: str, buckets: int) -> list[int]:
    """Hash buckets of the word and its prefixes; 0 is padding."""
    crc, last = zlib.crc32, buckets - 1
    whole = word.encode("utf-8", "surrogatepass")
    cuts = [whole[:n] for n in PREFIXES] if len(whole) == len(word) else [word[:n].encode("utf-8", "surrogatepass") for n in PREFIXES]
    return [1 + crc(whole, 1) % last, *(1 + crc(c) % last for c, n in zip(cuts, PREFIXES) if len(word) >= n)]


def feature_table(words: list[str], buckets: int) -> np.ndarray:
    """A row of buckets for each word, filled up with padding."""
    out = np.zeros((len(words), 1 + len(PREFIXES)), np.int32)
    for i, w in enumerate(words):
        f = features(w, buckets)
        out[i, : len(f)] = f
    return out


@dataclass
class Model:
    embed: np.ndarray
    filters: list[np.ndarray]  # by width: (width, dim, n)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, words: list[str]) -> np.ndarray:
        return self.embed[feature_table(words, len(self.embed))].sum(1)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.out_bias


class Scorer:
    """Scores texts one by one, with a bounded table of word vectors."""

    def __init__(self, model: Model):
        self.model, self.n = model, model.filters[0].shape[2]
        self.filters = np.concatenate([f[j] for f in model.filters for j in range(len(f))], axis=1)  # columns: width, place, filter
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((4096, self.model.embed.shape[1]), np.float32)  # row 0: padding

    def ids_of(self, words: list[str]) -> np.ndarray:
        if len(self.ids) > VOCABULARY:
            self.reset()
        get = self.ids.get
        got = [get(w) for w in words]
        if None in got:
            new = list(dict.fromkeys(w for w, i in zip(words, got) if i is None))
            first = len(self.ids) + 1
            while len(self.rows) < first + len(new):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                self.rows[first + at : first + at + len(part)] = self.model.vectors(part)
            self.ids.update(zip(new, range(first, first + len(new))))
            got = [get(w) for w in words]
        return np.array(got, np.int64)

    def pooled(self, text: str | None) -> np.ndarray:
        words, n = words_of(text), self.n
        best = np.full(n * len(self.model.filters), -np.inf, np.float32)
        for at in range(0, max(1, len(words)), 20_000):  # blocks that overlap by the widest filter
            ids = self.ids_of(words[at : at + 20_000 + PAD])
            pad = np.zeros(PAD, np.int64)
            ids = np.concatenate([pad if at == 0 else pad[:0], ids, pad if at + 20_000 >= len(words) else pad[:0]])
            rows, col = self.rows[ids] @ self.filters, 0
            for k, f in enumerate(self.model.filters):
                w = len(f)
                m = len(ids) - w + 1
                if m > 0:
                    total = rows[:m, col : col + n].copy()
                    for j in range(1, w):
                        total += rows[j : j + m, col + j * n : col + (j + 1) * n]
                    part = best[k * n : (k + 1) * n]
                    np.maximum(part, total.max(0), out=part)
                col += w * n
        return np.maximum(best + self.model.bias, 0)

    def logits(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return np.clip(self.model.logits(np.stack([self.pooled(t) for t in texts])).astype(np.float64), -40, 40)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.logits(texts))


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, at most ROWS at a time."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def held_back(n: int) -> np.ndarray:
    """Which rows of a sample the fit does not learn from: every fifth."""
    return np.arange(n) % 5 == 4


def train(
    texts: list[str | None], labels: np.ndarray, *,
    buckets: int = 1 << 15, dim: int = 16, n_filters: int = 16, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7,
) -> Model:
    """Adam on the logistic loss; held-back rows are left to the thresholds."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.1, (buckets, dim)).astype(np.float32),
        [rng.normal(0, 0.3, (w, dim, n_filters)).astype(np.float32) for w in WIDTHS],
        np.zeros(n_filters * len(WIDTHS), np.float32), rng.normal(0, 0.1, n_filters * len(WIDTHS)).astype(np.float32), -2.0,
    )
    model.embed[0] = 0
    y = np.asarray(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        model.out[:], model.out_bias = 0, -40.0
        return model
    back = held_back(len(y))
    vocab: dict[str, int] = {}
    docs = []
    for t in texts:
        docs.append(np.fromiter((vocab.setdefault(w, len(vocab) + 1) for w in words_of(t)), np.int32))
    width = 1 + len(PREFIXES)
    table = np.concatenate([np.zeros((1, width), np.int32), feature_table(list(vocab), buckets)])
    del vocab
    params = [model.embed, *model.filters, model.bias, model.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    bias_m = bias_v = 0.0
    step = 0
    pool = np.flatnonzero(~back)
    for _ in range(epochs):
        order = rng.permutation(pool)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            step += 1
            seqs = [np.concatenate([np.zeros(PAD, np.int32), docs[i], np.zeros(PAD, np.int32)]) for i in rows]
            uniq, inv = np.unique(np.concatenate(seqs), return_inverse=True)
            tab = table[uniq]
            vec = model.embed[tab].sum(1) * (uniq > 0)[:, None]
            starts = np.concatenate(([0], np.cumsum([len(s) for s in seqs])))
            pooled = np.empty((len(rows), n_filters * len(WIDTHS)), np.float32)
            where = np.empty(pooled.shape, np.int64)
            for k, f in enumerate(model.filters):
                w = len(f)
                prod = [np.ascontiguousarray((vec @ f[j]).T) for j in range(w)]
                m = len(inv) - w + 1
                total = prod[0].take(inv[:m], axis=1)
                for j in range(1, w):
                    total += prod[j].take(inv[j : j + m], axis=1)
                for d in range(len(rows)):
                    a, z = starts[d], starts[d + 1] - w + 1
                    arg = total[:, a:z].argmax(1) + a
                    where[d, k * n_filters : (k + 1) * n_filters] = arg
                    pooled[d, k * n_filters : (k + 1) * n_filters] = total[np.arange(n_filters), arg]
            act = pooled + model.bias
            hid = np.maximum(act, 0)
            p = 1 / (1 + np.exp(-np.clip(hid @ model.out + model.out_bias, -30, 30)))
            g = (p - y[rows]) / len(rows)
            dout = hid.T @ g
            dact = (g[:, None] * model.out) * (act > 0)
            dvec = np.zeros_like(vec)
            dfil = []
            for k, f in enumerate(model.filters):
                w = len(f)
                gk, pos = dact[:, k * n_filters : (k + 1) * n_filters], where[:, k * n_filters : (k + 1) * n_filters]
                df = np.empty_like(f)
                for j in range(w):
                    at_j = inv[pos + j]
                    df[j] = np.einsum("dfe,df->ef", vec[at_j], gk)
                    np.add.at(dvec, at_j.ravel(), (gk[:, :, None] * f[j].T[None]).reshape(-1, dim))
                dfil.append(df)
            dvec[uniq == 0] = 0
            demb = np.zeros_like(model.embed)
            hit = np.flatnonzero(np.abs(dvec).sum(1) > 0)
            np.add.at(demb, tab[hit].ravel(), np.repeat(dvec[hit], width, axis=0))
            demb[0] = 0
            for q, d, a, b in zip(params, [demb, *dfil, dact.sum(0), dout], first, second):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            d = float(g.sum())
            bias_m += 0.1 * (d - bias_m)
            bias_v += 0.001 * (d * d - bias_v)
            model.out_bias -= rate * (bias_m / (1 - 0.9**step)) / (bias_v / (1 - 0.999**step)) ** 0.5 if bias_v else 0
    return model


def _best(bins: list) -> float:
    """The middle of the scores between which F1 is largest. Rows of bins: lo and hi (the ends of its logits), pos, n."""
    bins = sorted(bins, key=lambda b: -b["lo"])
    hits = np.cumsum([b["pos"] for b in bins])
    f1 = 2 * hits / (np.cumsum([b["n"] for b in bins]) + hits[-1])
    i = int(f1.argmax())
    low = _sigmoid(bins[i + 1]["hi"]) if i + 1 < len(bins) else 0.0
    return float(np.clip((_sigmoid(bins[i]["lo"]) + low) / 2, 1e-6, 1 - 1e-6))


def calibrate(model: Model, texts: DataFrame, known: DataFrame, bin_width: float = 0.02, min_positives: int = 20) -> None:
    """Shift the score and set thresholds by language from all texts (__id, t, lang) that known (__id, __toxic) labels.

    Texts are scored where they are read and do not move: a bit set of the labelled ids, BITS whatever their number, tells
    which may be labelled (some others are scored in vain), and only scores meet the labels. What comes to the driver is the bit set
    and a histogram: at most 80 / bin_width bins, and as many for each calibrated language."""
    spark = texts.sparkSession
    place = F.pmod(F.xxhash64("__id"), F.lit(BITS))
    words = np.zeros(BITS // 64, np.int64)
    one_bit = F.expr("shiftleft(1L, CAST(h % 64 AS INT))")
    for r in known.select(place.alias("h")).groupBy(F.floor(F.col("h") / 64).alias("w")).agg(F.bit_or(one_bit).alias("bits")).collect():
        words[r["w"]] = r["bits"]
    sent = spark.sparkContext.broadcast((model, words))
    names = ["__id", "lang", "z"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, bits = sent.value
        scorer = Scorer(mine)
        for b in few(batches):
            h = b.column(3).to_numpy()
            b = b.filter(pa.array((bits[h >> 6] >> (h & 63)) & 1 == 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scorer.logits(b.column(1).to_pylist()), pa.float64())], names)
        del scorer
        trim()

    rows = texts.where(F.col("__id").isNotNull()).select("__id", "t", "lang", place.alias("h"))
    schema = StructType([rows.schema["__id"], StructField("lang", StringType()), StructField("z", DoubleType())])
    scored = rows.mapInArrow(run, schema).join(known.select("__id", (F.col("__toxic") > 0).cast("long").alias("y")), "__id")
    sums = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("pos").alias("pos"), F.sum("n").alias("n")]
    one = scored.select("lang", F.floor(F.col("z") / bin_width).alias("bin"), F.col("z").alias("lo"), F.col("z").alias("hi"), F.col("y").alias("pos"), F.lit(1).cast("long").alias("n"))
    hist = cut(one.groupBy("lang", "bin").agg(*sums))
    common = hist.groupBy("bin").agg(*sums).collect()
    if sum(b["n"] for b in common) < 20 or not sum(b["pos"] for b in common):
        return
    best = _best(common)
    shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(best / (1 - best)))
    model.out_bias += shift
    enough = hist.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.sum("pos").alias("__all")).where(F.col("__all") >= min_positives).select("lang")
    by: dict[str, list] = {}
    for r in hist.join(enough, "lang").collect():
        by.setdefault(r["lang"], []).append({"lo": r["lo"] + shift, "hi": r["hi"] + shift, "pos": r["pos"], "n": r["n"]})
    model.thresholds = {lang: _best(bins) for lang, bins in by.items()}


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, sample_mb: float = 64,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang",
) -> Model:
    """Train on at most sample_rows labelled documents that are not held out, chosen by a hash of the id,
    and calibrate on all the others that are not held out.

    The ids of the sample (bounded) are broadcast; its texts, at most sample_mb, come to the driver."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col))
    known = marks.groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").alias("__toxic"))
    marks = known.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t"), lang.alias("lang"))
    rows = texts.join(F.broadcast(marks), "__id").withColumn("h", F.xxhash64(F.coalesce("t", F.lit(""))))
    sizes = rows.groupBy("__id").agg(F.min(F.struct("h", F.octet_length(F.coalesce("t", F.lit(""))).alias("n"))).alias("x")).select("__id", "x.h", "x.n").toArrow()
    ids, n = sizes["__id"].to_pylist(), sizes["n"].to_pylist()
    left, chosen = sample_mb * 1e6, []
    for i in sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i])):
        if n[i] <= left:
            left -= n[i]
            chosen.append(i)
    # tables go to Spark as Arrow: from lists it makes them in Python workers of another kind, which stay beside those that score
    picked = sizes.take(pa.array(chosen, pa.int64())).select(["__id", "h"])
    schema = StructType([known.schema["__id"], StructField("h", LongType()), StructField("at", LongType())])
    places = docs.sparkSession.createDataFrame(picked.append_column("at", pa.array(range(len(chosen)), pa.int64())), schema)
    mine = rows.join(F.broadcast(places), ["__id", "h"])
    got = mine.groupBy("at").agg(F.first("t").alias("t"), F.first("__toxic").alias("__toxic")).collect()  # equal texts
    got = sorted(got, key=lambda r: r["at"])
    y = np.array([int(r["__toxic"] > 0) for r in got])
    model = train([r["t"] for r in got], y)
    if len(y) and y.min() < y.max():
        learned = [r["at"] for r, back in zip(got, held_back(len(got))) if not back]
        learned = docs.sparkSession.createDataFrame(picked.select(["__id"]).take(pa.array(learned, pa.int64())), StructType([known.schema["__id"]]))
        calibrate(model, texts, known.join(F.broadcast(learned), "__id", "left_anti"))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """docs with __score, and __toxic: whether it reaches its language's threshold (0.3 where none was calibrated)."""
    spark = docs.sparkSession
    docs = docs.select(*plain(docs))
    sent = spark.sparkContext.broadcast(model)  # its size is fixed by buckets x dim
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in few(batches):
            s = scorer.score(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "__score"])
        del scorer
        trim()

    out = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__score", DoubleType())]))
    limit = F.lit(THRESHOLD)
    if lang_col and lang_col in docs.columns:
        for lang, t in sorted(model.thresholds.items()):
            limit = F.when(F.col(lang_col) == lang, F.lit(t)).otherwise(limit)
    return out.withColumn("__toxic", F.col("__score") >= limit)

