"""Exports of cross edges, one row a line, ordered by seq."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graph import keep_first


def mermaid_id(c: Column) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(c, r"[^\p{L}\p{N}]", "_"))


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """section (0 head, 1 nodes, 2 edges), key, line from nodes(id, label) and edges(source, target, kind, confidence)."""
    head = nodes.sparkSession.range(1).select(F.lit(0).alias("section"), F.lit("").alias("key"), F.lit("flowchart LR").alias("line"))
    quoted = F.replace(F.col("label"), F.lit('"'), F.lit("'"))
    n = nodes.select(F.lit(1).alias("section"), F.col("id").alias("key"), F.concat(F.lit("  "), mermaid_id(F.col("id")), F.lit('["'), quoted, F.lit('"]')).alias("line"))
    e = keep_first(edges, ["source", "target", "kind"], [F.desc("confidence")])
    e = e.select(F.lit(2).alias("section"), F.concat_ws("\t", "source", "target", "kind").alias("key"), F.concat(
        F.lit("  "), mermaid_id(F.col("source")), F.lit(" -->|"), F.col("kind"), F.lit(" "), F.col("confidence").cast("string"), F.lit("%| "), mermaid_id(F.col("target"))
    ).alias("line"))
    return head.unionByName(n).unionByName(e)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with i, their place from 0 in the given order.

    Partitions are ranged and sorted, and offsets are sums of partition counts, so no task sees all rows."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("__p", F.spark_partition_id()).withColumn("__r", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__p", (F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("b"))
    return ranged.join(F.broadcast(before), "__p").withColumn("i", F.col("b") + F.col("__r").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__r", "b")  # a row for each partition


def graphml_edges(edges: DataFrame) -> DataFrame:
    """line of each edge, numbered e0, e1, ... by (source, target, kind)."""
    placed = numbered(edges, [F.asc("source"), F.asc("target"), F.asc("kind")])
    return placed.select(F.concat(
        F.lit('<edge id="e'), F.col("i").cast("string"), F.lit('" source="'), xml_escape(F.col("source")), F.lit('" target="'), xml_escape(F.col("target")), F.lit('" label="'), xml_escape(F.col("kind")), F.lit('"/>')
    ).alias("line"))


def json_lines(units: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """unit, section, key, line: a workspace model as JSON. Lines in the order of unit, section and key make one document:
    an object with an array of units, each with an array for each section(unit, ...).

    Each row is one line, so no unit's rows are brought together; commas stand before all but the first of an array, which a
    minimum by unit finds."""
    parts, names = [], list(sections)
    every = units.select("unit").distinct()
    first = every.agg(F.min("unit").alias("first"))
    name_of = F.regexp_extract(F.to_json(F.struct("unit")), r'^\{"unit":(.*)\}$', 1)
    opened = every.crossJoin(first).select("unit", F.lit(-1).alias("section"), F.lit("").alias("key"), F.concat(F.when(F.col("unit") == F.col("first"), '{"units": [').otherwise(","), F.lit('{"unit": '), name_of).alias("line"))
    parts.append(opened)
    for i, name in enumerate(names):
        rows = sections[name].withColumn("__key", F.to_json(F.struct(*sections[name].columns))).select("unit", "__key").join(every, "unit", "left_semi")
        least = rows.groupBy("unit").agg(F.min("__key").alias("least"))
        head = every.select("unit", F.lit(2 * i).alias("section"), F.lit("").alias("key"), F.lit(f', "{name}": [').alias("line"))
        body = rows.distinct().join(least, "unit").select("unit", F.lit(2 * i).alias("section"), F.col("__key").alias("key"), F.concat(F.when(F.col("__key") == F.col("least"), "").otherwise(","), "__key").alias("line"))
        tail = every.select("unit", F.lit(2 * i + 1).alias("section"), F.lit("").alias("key"), F.lit("]").alias("line"))
        parts += [head, body, tail]
    last = every.agg(F.max("unit").alias("last"))
    parts.append(every.crossJoin(last).select("unit", F.lit(2 * len(names)).alias("section"), F.lit("").alias("key"), F.when(F.col("unit") == F.col("last"), "}]}").otherwise("}").alias("line")))
    return reduce(DataFrame.unionByName, parts)
