"""Information-theoretic sanitisation of personal data, in Spark expressions only.

Patterns with checks find protected entities: mail addresses, IPv4 addresses,
payment cards (Luhn) and phone numbers. Terms in the same document may give an
entity away as well. Over the whole corpus, how much a term t tells of an entity e is the share
of e's information content that t carries:

    disclosure(e, t) = log(N n(e, t) / (n(e) n(t))) / log(N / n(e))

with N different texts, n(e) texts that hold e, n(t) that hold t, n(e, t) that hold
both, however far apart: copies of a text are no evidence of their own. Terms over
`generalise_at` become [TERM], terms over `remove_at` are removed, wherever they
stand in a text that holds the entity; pairs seen in fewer than `support` texts say
nothing and are left alone. Words inside mail addresses, the only entities with
letters, are no terms. n(t) and n(e, t) are counted with partial aggregation over
all words of all texts, so that a frequent entity or term meets one reducer as sums;
an entity in fewer than `support` texts can have no pair and is left out before its
words are listed.

Entities and spans depend on the text alone. Texts with a hint of an entity, a small
share, are written once by the hash of the text, and all joins are among these; the
other texts are read for n(t), each different text once, and passed through.

Patterns that could run in quadratic time start only at the left end of a run of
their characters or where the match before ended, which finds the same matches;
repetition is possessive, so texts of any length need no stack.

Edge cases: null and empty texts have no spans; overlapping spans of different
kinds all count, and the sanitised text hides their union; rows that repeat a text
get one outcome; an entity in every text has no information and discloses nothing;
an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import plain

#: Kinds in the order in which ties are listed, with Java patterns that match what
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and the like match.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for at all.
HINTS = {"email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){13}", "phone": r"\+[0-9][\x20().0-9-]"}
TERM = r"\p{L}[\p{L}\p{N}_'-]{2,}"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    ip = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(digits)
    return (
        F.when(kind == "email", True).when(kind == "ip", ip)
        .when(kind == "card", F.when(n.between(14, 19), luhn(digits)).otherwise(False))
        .otherwise(n.between(10, 15))
    )


def hinted(text: Column) -> Column:
    """Whether a text may hold an entity; never false where it holds one."""
    return text.rlike("|".join(HINTS.values()))


def entities(d: DataFrame) -> DataFrame:
    """From texts (__h, __t) of one row each: __h, kind, start, end, value."""
    none = F.expr("CAST(array() AS array<struct<kind:string,i:int,gap:int,value:string>>)")
    found = []
    for kind, pattern in KINDS.items():
        pairs = F.arrays_zip(F.regexp_extract_all("__t", F.lit(pattern), F.lit(0)).alias("value"), F.split("__t", pattern, -1).alias("part"))
        hits = F.filter(pairs, lambda x: x["value"].isNotNull())  # parts are one more than matches
        name = F.lit(kind).alias("kind")
        rows = F.transform(hits, lambda x, i: F.struct(name, i.alias("i"), F.char_length(x["part"]).alias("gap"), x["value"].alias("value")))  # noqa: B023
        found.append(F.when(F.col("__t").rlike(HINTS[kind]), rows).otherwise(none))
    rows = d.select("__h", F.explode(F.concat(*found)).alias("x")).select("__h", "x.*")
    # gaps and matches add up to places
    so_far = Window.partitionBy("__h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.char_length("value")).over(so_far))
    rows = rows.where(passes(F.col("kind"), F.col("value")))
    return rows.select("__h", "kind", (F.col("end") - F.char_length("value")).alias("start"), "end", "value")


def _outside(text: Column, places: Column) -> Column:
    """text with a blank for every code point of the ordered places; all else keeps its place."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<string>)").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        first = F.greatest(acc["at"], p["start"])
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (first - acc["at"]).cast("int"))
        blanks = F.repeat(F.lit(" "), F.greatest(p["end"] - first, F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], p["end"]).alias("at"), F.concat(acc["out"], F.array(gap, blanks)).alias("out"))

    return F.aggregate(places, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))


def _words(text: Column) -> Column:
    """Distinct terms of a text, none from inside a mail address."""
    plain_text = F.when(text.rlike(HINTS["email"]), F.regexp_replace(text, KINDS["email"], " ")).otherwise(text)
    return F.array_distinct(F.transform(F.regexp_extract_all(plain_text, F.lit(TERM), F.lit(0)), F.lower))


def disclosing_terms(
    d: DataFrame, some: DataFrame, found: DataFrame, support: int = 2, generalise_at: float = 0.6, remove_at: float = 0.9
) -> DataFrame:
    """__h, start, end, remove: terms of a text that tell too much of an entity it holds.

    d(__h, __t) are all texts, repeats included; some those with a hint, one row each; found their entities."""
    ent = found.select("__h", F.xxhash64("kind", F.lower("value"), F.lit("a")).alias("e"), F.xxhash64("value", "kind").alias("e2")).distinct()
    of_entity = ent.groupBy("e", "e2").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= support)
    ent = cut(ent.join(of_entity, ["e", "e2"]))
    held = ent.groupBy("__h").agg(F.collect_list(F.struct("e", "e2", "n_e")).alias("held"))  # bounded by the text
    near = some.join(held, "__h").select("held", F.explode(_words(F.col("__t"))).alias("term")).select(F.explode("held").alias("x"), "term").select("x.*", "term")
    pairs = near.groupBy("e", "e2", "n_e", "term").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= support)
    texts = d.select("__h", "__t").dropDuplicates(["__h"])
    of_term = texts.select(F.explode(_words(F.col("__t"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    told = pairs.join(of_term, "term")
    n, ne, nt, net = F.lit(float(d.select("__h").distinct().count())), *(F.col(c).cast("double") for c in ("n_e", "n_t", "n_et"))
    told = told.where(ne < n).withColumn("share", F.log(n * net / (ne * nt)) / F.log(n / ne)).where(F.col("share") >= generalise_at)
    told = told.select("e", "e2", "term", (F.col("share") >= remove_at).alias("remove"))
    marks = cut(ent.join(told, ["e", "e2"]).groupBy("__h", "term").agg(F.max("remove").alias("remove")))
    # every occurrence outside mail addresses: gaps and terms add up to places
    mails = found.where("kind = 'email'").groupBy("__h").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("places"))
    at = some.join(marks.select("__h").distinct(), "__h", "left_semi").join(mails, "__h", "left")
    at = at.select("__h", F.when(F.col("places").isNull(), F.col("__t")).otherwise(_outside(F.col("__t"), F.col("places"))).alias("__t"))
    at = at.select("__h", F.posexplode(F.arrays_zip(
        F.split("__t", TERM, -1).alias("gap"), F.regexp_extract_all("__t", F.lit(TERM), F.lit(0)).alias("hit")
    )).alias("i", "x")).where(F.col("x.hit").isNotNull())
    at = at.select("__h", "i", F.lower("x.hit").alias("term"), F.char_length("x.hit").cast("long").alias("n"), F.char_length("x.gap").alias("gap"))
    so_far = Window.partitionBy("__h").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(so_far))
    return at.join(marks, ["__h", "term"]).select("__h", (F.col("end") - F.col("n")).alias("start"), "end", "remove")


_SPANS = "array<struct<start:long,rank:int,end:long,kind:string,remove:boolean>>"


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """docs with text_col rewritten, and with __spans: array<struct<start, rank, end, kind, remove>> in order."""
    d = docs.select(*plain(docs)).withColumn("__t", F.coalesce(F.col(text_col), F.lit(""))).withColumn("__h", F.unhex(F.md5("__t")))
    some = cut(d.where(hinted(F.col("__t"))).select("__h", "__t").dropDuplicates(["__h"]))
    found = cut(entities(some))
    ranks = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    base = found.select("__h", F.col("start").cast("long").alias("start"), F.element_at(ranks, F.col("kind")).alias("rank"), F.col("end").cast("long").alias("end"), "kind", F.lit(False).alias("remove"))
    terms = disclosing_terms(d, some, found, **thresholds).select("__h", "start", F.lit(len(KINDS)).alias("rank"), "end", F.lit("term").alias("kind"), "remove")
    spans = base.unionByName(terms).groupBy("__h").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "remove"))).cast(_SPANS).alias("__spans"))
    none = F.expr(f"CAST(array() AS {_SPANS})")
    with_spans = d.where(hinted(F.col("__t"))).join(spans, "__h", "left").withColumn("__spans", F.coalesce("__spans", none))
    with_spans = with_spans.withColumn(text_col, hidden(F.col("__t"), F.col("__spans"))).select(*plain(docs), "__spans")
    without = d.where(~hinted(F.col("__t"))).withColumn(text_col, F.col("__t")).withColumn("__spans", none).select(*plain(docs), "__spans")
    return with_spans.unionByName(without)


def hidden(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind's label or nothing; where spans overlap, the first one's label stands for all."""
    labels = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("CAST(array() AS array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        label = F.when(s["remove"], "").otherwise(F.element_at(labels, s["kind"]))
        add = F.when(s["start"] >= acc["at"], F.array(F.concat(gap, label))).otherwise(F.expr("CAST(array() AS array<string>)"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], add).alias("out"))

    rest = F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(rest)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
