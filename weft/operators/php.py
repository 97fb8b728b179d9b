"""PHP as tokens, and what windows over the tokens tell: functions, their parameters, and calls.

The lexer runs over Arrow batches: code, comments, strings, heredocs and nowdocs are its states, and each token is a row.
Everything above it is columns: brackets by depth, neighbours by lag and lead, and parameters by the
commas of their own list.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import structure

_NAME = r"[A-Za-z_\x80-\U0010FFFF]"
#: The states of the lexer, in the order in which they are tried. Attributes (#[...]) are comments here.
_STATES = re.compile(
    rf"""(?P<comment>//[^\n]*|\#[^\n]*|/\*[\s\S]*?(?:\*/|\Z))
|(?P<heredoc><<<[ \t]*(?P<quote>['"]?)(?P<label>{_NAME}[\w\x80-\U0010FFFF]*)(?P=quote)\r?\n[\s\S]*?(?:\n[ \t]*(?P=label)\b|\Z))
|(?P<string>"(?:\\[\s\S]|[^"\\])*(?:"|\Z)|'(?:\\[\s\S]|[^'\\])*(?:'|\Z))
|(?P<variable>\${_NAME}[\w\x80-\U0010FFFF]*)
|(?P<name>(?:\\|{_NAME})[\w\\\x80-\U0010FFFF]*)
|(?P<number>[0-9][\w.]*)
|(?P<symbol>\?->|->|::|=>|\?\?|[^ \t\n\r\f\x0b])""",
    re.X | re.A,
)
_KINDS = ("comment", "heredoc", "string", "variable", "name", "number", "symbol")
TOKEN = "i long, pos long, kind string, value string"
#: Types that name no class. Fixed values.
BUILTIN = ("string", "int", "float", "bool", "array", "callable", "iterable", "object", "mixed", "void", "never", "null", "false", "true", "self", "static", "parent")


def tokens(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, i, pos, kind, value of each token; null texts have none."""
    src = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__t"))
    n = len(keys)

    def lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, code in enumerate(b.column(n).to_pylist()):
                found = [(m.start(), next(k for k in _KINDS if m[k] is not None), m[0]) for m in _STATES.finditer(code)]
                if found:
                    pos, kind, value = zip(*found)
                    same = pa.array([row] * len(found), pa.int64())
                    yield pa.RecordBatch.from_arrays([*(c.take(same) for c in b.columns[:n]), pa.array(range(len(found)), pa.int64()), pa.array(pos, pa.int64()), pa.array(kind), pa.array(value)], [*keys, "i", "pos", "kind", "value"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:n])
    return src.mapInArrow(lex, f"{types}, {TOKEN}")


def _code(found: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens that are not comments, with their neighbours."""
    w = Window.partitionBy(*keys).orderBy("i")
    near = {"before": F.lag("value").over(w), "before2": F.lag("value", 2).over(w), "after": F.lead("value").over(w), "after2": F.lead("value", 2).over(w)}
    return found.where("kind <> 'comment'").repartition(*keys).withColumns(near)


def calls(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos, receiver, operator, name of receiver->name( and receiver::name( ; a receiver that is itself a call is null."""
    c = _code(found, keys).where(F.col("before").isin("->", "::", "?->") & (F.col("after") == "(") & (F.col("kind") == "name"))
    plain = F.col("before2").rlike(r"^[$A-Za-z_\\\x80-\x{10FFFF}]")
    return c.select(*keys, "pos", F.when(plain, F.col("before2")).alias("receiver"), F.col("before").alias("operator"), F.col("value").alias("name"))


def parameters(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pos (of the function), function, ord, type, variable: parameters of every named function and method, in order.

    A type is its names joined, with ? and | and & left out as in a declaration of one class; null where there is none."""
    c = _code(found, keys).where("kind <> 'heredoc'")
    marks = c.where(F.col("value").isin(*"()[]{}") & (F.col("kind") == "symbol")).select(*keys, "pos", F.lit(1).alias("size"), F.translate("value", ")]}", "([{").alias("kind"), F.when(F.col("value").isin("(", "[", "{"), 1).otherwise(-1).alias("step"), F.col("before").alias("fn"), F.col("before2").alias("word"), F.col("value").alias("token"))
    lists = structure.pairs(marks, keys, ("fn", "word")).where(F.col("kind") == "(")
    lists = lists.where((F.lower("word") == "function") | ((F.lower("fn") == "function"))).where(F.lower("fn") != "function")
    scopes = structure.nested(lists.select(*keys, F.col("inner").alias("start"), F.col("stop").alias("end"), "fn"), keys)
    inside = structure.enclosed(c.select(*keys, F.col("pos").alias("start"), (F.col("pos") + F.char_length("value")).alias("end"), "value", "kind"), scopes, keys).where("depth > 0")
    around = structure.ancestors(inside, scopes, keys, ["fn"]).withColumn("last", F.max("level").over(Window.partitionBy(*keys, "start", "end"))).where("level = last")
    here = inside.join(around.select(*keys, "start", "end", "fn", "scope_start"), [*keys, "start", "end"])
    own = Window.partitionBy(*keys, "scope_start").orderBy("start")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("value").isin("(", "[", "{") & (F.col("kind") == "symbol"), 1).when(F.col("value").isin(")", "]", "}") & (F.col("kind") == "symbol"), -1).otherwise(0)
    here = here.withColumn("inner", F.sum(step).over(upto)).withColumn("ord", F.sum(F.when((F.col("value") == ",") & (F.col("inner") == 0), 1).otherwise(0)).over(upto))
    default = F.max(F.when((F.col("value") == "=") & (F.col("inner") == 0), 1).otherwise(0)).over(Window.partitionBy(*keys, "scope_start", "ord").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    said = here.withColumn("default", default).where("default = 0 AND inner = 0")
    word = (F.col("kind") == "name") & ~F.lower("value").isin("public", "private", "protected", "readonly")
    per = said.groupBy(*keys, "scope_start", "fn", "ord").agg(
        F.max(F.when(F.col("kind") == "variable", F.col("value"))).alias("variable"), F.array_sort(F.collect_list(F.when(word, F.struct("start", "value")))).alias("words")
    )
    named = F.array_join(F.transform("words", lambda x: x["value"]), "|")
    return per.where("variable IS NOT NULL").select(*keys, F.col("scope_start").alias("pos"), F.col("fn").alias("function"), "ord", F.when(named != "", named).alias("type"), "variable")


def injected(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, function, type of parameters whose type is one class."""
    p = parameters(found, keys).where(F.col("type").isNotNull() & ~F.lower("type").isin(*BUILTIN))
    return p.select(*keys, "function", "type").distinct()
