"""Structure of source text: tokens with positions, matched brackets, scopes that nest.

Nearly everything is columns: a pattern's matches and the text between them are two arrays of a
row, exploded side by side, and positions are a running sum. Brackets are matched by
depth: the running sum of +1 and -1 of a kind, and an opening bracket belongs to the next
closing one of its depth. So there is no limit of length or depth, and after one shuffle
by document all windows run on the same partitions, sorting and spilling as Spark sees
fit. Positions count code points from 0; an end is exclusive.

Arguments of calls need only what stands in one text, so they are found by a small helper per text in
Arrow batches, without a shuffle or a sort.

`keys` name the columns that tell rows of a table apart. Null texts have no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A string literal: quotes of three kinds with escapes. Unclosed ones end with the line, template literals with the text.
STRING = r""""(?:\\.|[^"\\\n])*+"?|'(?:\\.|[^'\\\n])*+'?|`(?:\\.|[^`\\])*+`?"""
#: Comments of markup, elements whose content is not markup, and tags.
MARKUP = r"(?is)<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|</?[a-z][a-z0-9]*\b[^>]*>"
#: Elements of markup that have no end.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def tokens(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """keys, pos, token: every match of pattern, from left to right, with its position. The rows of a key share a partition."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(F.col(text), pattern, -1)
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.arrays_zip(gaps.alias("gap"), found.alias("token"))).alias("i", "x"))
    rows = rows.where("x.token IS NOT NULL").select(*keys, "i", F.char_length("x.gap").alias("gap"), F.col("x.token").alias("token")).repartition(*keys)
    size = F.char_length("token")
    end = F.sum(F.col("gap") + size).over(Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*keys, (end - size).alias("pos"), "token")


def pairs(marks: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, kind, depth, start, inner, stop, end and what the opening mark carries, of matched marks (keys, pos, size, kind, step: 1 opens, -1 closes).

    The inside is [inner, stop). Kinds do not see one another. What closes nothing, or is never closed, has no pair."""
    own = Window.partitionBy(*keys, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    m = marks.withColumn("depth", F.sum("step").over(own) + F.when(F.col("step") < 0, 1).otherwise(0))
    level = Window.partitionBy(*keys, "kind", "depth").orderBy("pos")
    after = lambda c: F.lead(c).over(level)
    m = m.withColumn("next", after("step")).withColumn("stop", after("pos")).withColumn("end", after(F.col("pos") + F.col("size")))
    hit = m.where((F.col("step") == 1) & (F.col("next") == -1))
    return hit.select(*keys, "kind", "depth", F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("inner"), "stop", "end", *carry)


def bracket_marks(found: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens that end or begin with a bracket as marks; a mark that opens may have something before its bracket, as a call's name has."""
    last = F.right("token", F.lit(1))
    opens = last.isin("(", "[", "{")
    kind = F.translate(last, ")]}", "([{")
    marks = found.where(last.isin(*"()[]{}"))
    return marks.select(*keys, "pos", F.char_length("token").alias("size"), kind.alias("kind"), F.when(opens, 1).otherwise(-1).alias("step"), "token")


def bracket_pairs(df: DataFrame, keys: list[str], text: str, strings: bool = False) -> DataFrame:
    """Matched ( ), [ ] and { } of each text; with strings, brackets inside literals are none."""
    pattern = rf"(?s){STRING}|[()\[\]{{}}]" if strings else r"[()\[\]{}]"
    return pairs(bracket_marks(tokens(df, keys, text, pattern), keys), keys)


def _spans(code: str, token: re.Pattern) -> list[tuple[int, int, str, str, str]]:
    """(start, end, token, argument, first) of the calls in a text: a stack for each kind of bracket, then from the right the next comma of each depth."""
    marks, open_, depth = [], {"(": [], "[": [], "{": []}, 0
    for m in token.finditer(code):
        last = code[m.end() - 1]
        if last in open_:
            depth += 1
            open_[last].append(mark := [m, depth, None])
            marks.append(mark)
        elif last in ")]}":
            depth -= 1
            if stack := open_["([{"[")]}".index(last)]]:
                stack.pop()[2] = m
        elif last == "," and m.end() - m.start() == 1:
            marks.append([m, depth, m])
    out, comma = [], {}
    for m, depth, closing in reversed(marks):
        if closing is m:
            comma[depth] = m.start()
        elif closing and m.end() - m.start() > 1:
            stop = closing.start()
            out.append((m.start(), closing.end(), m[0], code[m.end() : stop], code[m.end() : min(stop, comma.get(depth, stop))]))
    return out


def calls(df: DataFrame, keys: list[str], text: str, marker: str) -> DataFrame:
    """keys, start, end, token, argument, first: what stands between a match of marker, which ends with an opening bracket, and the
    bracket that closes it, however long or deep; first is its part before the first comma of its own depth. Brackets and commas in
    string literals are none. A call that is never closed has no row. Each text is read once, where it lies, without a shuffle."""
    src = df.where(F.col(text).rlike(marker)).select(*keys, F.col(text).alias("__text"))
    pattern = rf"(?s){STRING}|{marker}|[()\[\]{{}},]"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # letters and blanks are ASCII, as Java's are; what ends a word is not
        token = re.compile(re.sub(r"\\(.)", lambda m: r"(?u:\b)" if m[1] == "b" else m[0], pattern), re.ASCII)

        def made(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int64(), *[pa.string()] * 3))]
            return pa.RecordBatch.from_arrays([*[c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]], *cols], names)

        for b in batches:
            at, rows, size = [], [], 0
            for i, code in enumerate(b.column(b.num_columns - 1)):
                found = _spans(code.as_py(), token)
                at += [i] * len(found)
                rows += found
                size += sum(len(x[3]) for x in found)
                if size > 16 << 20:  # arguments of nested calls repeat the text
                    yield made(b, at, rows)
                    at, rows, size = [], [], 0
            yield made(b, at, rows)

    schema = src.drop("__text").schema.add("start", "long").add("end", "long").add("token", "string").add("argument", "string").add("first", "string")
    names = schema.names
    return src.mapInArrow(run, schema)


def literals(c: Column) -> Column:
    """The string literals of a piece of code, without their quotes."""
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?s){STRING}"), F.lit(0)), lambda x: F.substring(x, F.lit(2), F.char_length(x) - 2))


def elements(pages: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, kind, start, end, tag: the elements of markup that are closed; tags are matched by name, scripts and styles are one token."""
    found = tokens(pages, keys, text, MARKUP).where(~F.col("token").startswith("<!"))
    name = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    found = found.withColumn("kind", name).withColumn("size", F.char_length("token"))
    raw = found.where(F.col("kind").isin("script", "style") & ~F.col("token").startswith("</"))
    single = raw.select(*keys, "kind", F.col("pos").alias("start"), (F.col("pos") + F.col("size")).alias("end"), F.regexp_extract("token", r"^[^>]*>", 0).alias("tag"))
    marks = found.where(~F.col("kind").isin("script", "style", *VOID) & ~F.col("token").endswith("/>"))
    marks = marks.withColumn("step", F.when(F.col("token").startswith("</"), -1).otherwise(1))
    matched = pairs(marks, keys, ("token",)).withColumnRenamed("token", "tag")
    return matched.select(*keys, "kind", "start", "end", "tag").unionByName(single)


# ---------------------------------------------------------------- scopes


def nested(scopes: DataFrame, keys: list[str]) -> DataFrame:
    """scopes (keys, start, end) with level: how many scopes of the key contain it. Scopes nest or are disjoint, as matched brackets are."""
    ends = scopes.select(*keys, F.col("end").alias("at"), F.lit(-1).alias("step"))
    begins = scopes.select("*", F.col("start").alias("at"), F.lit(1).alias("step"))
    events = begins.unionByName(ends, allowMissingColumns=True)
    # at one place, what ends comes before what begins, and the wider scope begins before the narrower
    order = Window.partitionBy(*keys).orderBy("at", "step", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.coalesce(F.sum("step").over(order), F.lit(0))
    return events.withColumn("level", open_before.cast("int")).where("step = 1").select(*scopes.columns, "level")


def ancestors(inner: DataFrame, scopes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, start, end of each row of inner with a row for each scope around it: level and columns of the scope, 0 the outermost.

    inner holds `depth`, how many scopes are around it (level, where inner is the scopes themselves). For each level
    below it, the last scope of that level that began before is the one: an as-of join by window, whose rows are the answer's and
    the scopes', not their product."""
    probe = inner.select(*keys, "start", "end", F.explode(F.expr("sequence(0, depth - 1)")).alias("level"), F.lit(1).alias("side")) if "depth" in inner.columns else None
    if probe is None:
        raise ValueError("inner needs depth")
    known = scopes.select(*keys, F.col("start"), F.col("end"), "level", F.lit(0).alias("side"), F.struct("start", "end", *columns).alias("scope"))
    both = probe.withColumn("scope", F.lit(None).cast(known.schema["scope"].dataType)).unionByName(known)
    # a scope does not contain itself: at one start, what is wider comes first, so a level's own scope comes before what it holds
    order = Window.partitionBy(*keys, "level").orderBy("start", F.col("end").desc(), "side").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("scope", ignorenulls=True).over(order)
    out = both.withColumn("around", last).where((F.col("side") == 1) & (F.col("around")["end"] >= F.col("end")))
    return out.select(*keys, "start", "end", "level", *[F.col("around")[c].alias(c) for c in columns], F.col("around")["start"].alias("scope_start"))


def inherited(inner: DataFrame, scopes: DataFrame, keys: list[str], *, joined: list[str] = (), united: list[str] = (), innermost: list[str] = (), separator: str = "") -> DataFrame:
    """inner (with depth) and what it takes from the scopes around it: strings joined from the outside in, arrays united, and the
    innermost value that is not null. Rows of inner that no scope contains have empty strings, empty arrays and nulls."""
    found = ancestors(inner.where("depth > 0"), scopes, keys, [*joined, *united, *innermost])
    per = [F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("level", c)))).alias(c) for c in [*joined, *united, *innermost]]
    got = found.groupBy(*keys, "start", "end").agg(*per)
    value = lambda c: F.transform(c, lambda x: x[c])
    shaped = [
        *[F.array_join(value(c), separator).alias(f"all_{c}") for c in joined], *[F.array_sort(F.array_distinct(F.flatten(value(c)))).alias(f"all_{c}") for c in united],
        *[F.try_element_at(value(c), F.lit(-1)).alias(f"all_{c}") for c in innermost],
    ]
    out = inner.join(got.select(*keys, "start", "end", *shaped), [*keys, "start", "end"], "left")
    empty = {f"all_{c}": F.coalesce(f"all_{c}", F.lit("")) for c in joined} | {f"all_{c}": F.coalesce(F.col(f"all_{c}"), F.array().cast("array<string>")) for c in united}
    return out.withColumns(empty)


def enclosed(inner: DataFrame, scopes: DataFrame, keys: list[str]) -> DataFrame:
    """inner with depth: how many scopes are around each of its rows (start, end)."""
    cols = inner.columns
    events = (
        inner.select("*", F.col("start").alias("at"), F.lit(0).alias("step"))
        .unionByName(scopes.select(*keys, F.col("start").alias("at"), F.lit(1).alias("step")), allowMissingColumns=True)
        .unionByName(scopes.select(*keys, F.col("end").alias("at"), F.lit(-1).alias("step")), allowMissingColumns=True)
    )
    # at one place: what ends, then what begins, then what is asked for
    turn = F.when(F.col("step") == -1, 0).when(F.col("step") == 1, 1).otherwise(2)
    order = Window.partitionBy(*keys).orderBy("at", turn).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("depth", F.sum("step").over(order).cast("int")).where("step = 0").select(*cols, "depth")

