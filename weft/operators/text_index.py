"""An index of texts: which files hold a token, within a budget of bytes for each unit.

A marker is any text. Its longest token is looked up among the distinct tokens, which are far fewer than texts, the
postings of tokens that fit give candidates, and only candidates' texts are read to verify the whole marker.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import ascii_lower
from ..session import cut

#: Bytes of one file and of one unit's files that are indexed. Fixed values.
FILE_BYTES, UNIT_BYTES = 2 << 20, 64 << 20
TOKEN = "[a-z0-9]+"


def running_total(rows: DataFrame, unit: str, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value over the rows of their unit up to and with them, in the given order (which tells rows of
    a unit apart). Rows are dealt by range, so a unit with most rows is many tasks; sums of parts are added ahead of them."""
    by = [F.col(unit), *map(F.col, order)]
    dealt = cut(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy(unit, "__part").agg(F.sum(value).alias("__sum"))
    ahead = F.coalesce(F.sum("__sum").over(Window.partitionBy(unit).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.sum(value).over(Window.partitionBy(unit, "__part").orderBy(*map(F.col, order)).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(parts.select(unit, "__part", ahead.alias("__ahead")), [unit, "__part"]).withColumn(name, within + F.col("__ahead")).drop("__part", "__ahead")


def within_budget(files: DataFrame, file_bytes: int = FILE_BYTES, unit_bytes: int = UNIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """files(unit, rel_path, size): those that are indexed, and diagnostics of units of which some are not.

    Files are taken by path; one that no longer fits is passed over, and smaller ones after it are still taken. Each
    round takes files up to the first that does not fit, in all units at once, and keeps what is smaller than the bytes
    left after it: rounds are few, since every one takes a file and sizes left fall below the size that did not fit.
    Files without a size, and those over file_bytes, are not candidates."""
    size = F.col("size").cast("long")
    left = files.select("unit", "rel_path", size.alias("size")).where(size <= F.least(F.lit(file_bytes), F.lit(unit_bytes)))
    left = left.withColumn("room", F.lit(unit_bytes).cast("long"))
    first, taken = left, None
    while True:
        summed = cut(running_total(left, "unit", ["rel_path"], "size", "total"))
        fits = F.col("total") <= F.col("room")
        got = summed.where(fits).select("unit", "rel_path", "size")
        taken = got if taken is None else taken.unionByName(got)
        over = summed.groupBy("unit").agg((F.max("room") - F.coalesce(F.max(F.when(fits, F.col("total"))), F.lit(0))).alias("now"), F.bool_or(~fits).alias("more")).where("more")
        # what did not fit is larger than the room that is left, so it goes here as well
        left = cut(summed.where(~fits).join(over.select("unit", "now"), "unit").where("size <= now").select("unit", "rel_path", "size", F.col("now").alias("room")))
        if left.isEmpty():
            break
    skipped = first.select("unit").join(taken.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), "unit", "left").groupBy("unit").agg((F.count(F.lit(1)) - F.coalesce(F.max("n"), F.lit(0))).alias("n")).where("n > 0")
    said = skipped.select("unit", F.lit("warning").alias("level"), F.lit("text-index-memory-limit").alias("code"), F.concat(F.col("n").cast("string"), F.lit(" files over the limit of the index")).alias("message"), F.lit(None).cast("string").alias("file"))
    return taken, said


def tokens(text: Column) -> Column:
    """The distinct tokens of a text: runs of letters and digits of ASCII in lower case."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)))


def build(files: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Postings: token and the key of a file that holds it, dealt and sorted by token, so that a reader of few tokens skips the rest."""
    rows = files.select(*key, F.explode(tokens(F.col(text))).alias("token"))
    return cut(rows.repartitionByRange("token").sortWithinPartitions("token"))


def _probe(marker: str) -> tuple[str, str] | None:
    """The pattern that a token must fit for its files to be able to hold the marker: the longest token in it, whole
    where others stand around it; None for a marker without one."""
    low = marker.lower() if marker.isascii() else "".join(c.lower() if c.isascii() else c for c in marker)
    found = list(re.finditer(TOKEN, low))
    if not found:
        return None
    best = max(found, key=lambda m: m.end() - m.start())
    return low, ("" if best.start() == 0 else "^") + best.group() + ("" if best.end() == len(low) else "$")


def holding(postings: DataFrame, files: DataFrame, key: list[str], markers: list[str], text: str = "text") -> DataFrame:
    """marker and the key of each file whose text holds it, without regard to the case of ASCII letters; the same rows as by
    searching every text. Files are told apart by key. A marker without a letter or digit is looked for in every text."""
    probes = {m: _probe(m) for m in markers}
    spark = files.sparkSession
    low = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    table = spark.createDataFrame([(m, *p) for m, p in probes.items() if p], "marker string, low string, pattern string")
    seen = postings.select("token").distinct()
    fits = seen.join(F.broadcast(table), F.expr("token RLIKE pattern")).select("token", "marker", "low")  # constant rules
    candidates = postings.join(fits, "token").select("marker", "low", *key).distinct()
    hits = candidates.join(files.select(*key, low.alias("__low")), key).where(F.expr("contains(__low, low)")).select("marker", *key)
    rest = [m for m, p in probes.items() if not p]
    if rest:
        every = files.select(*key, F.explode(F.filter(F.array(*map(F.lit, rest)), lambda m: F.contains(low, m))).alias("marker"))
        hits = hits.unionByName(every.select("marker", *key))
    return hits
