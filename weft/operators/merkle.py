"""A digest that depends on the order of rows, and on nothing else.

Rows are dealt by range and sorted where they lie; partitions' counts give each row its place; the digests of `fan`
neighbours are hashed together, and so on upwards, until one is left. A group is always
`fan` places of the whole order, so partitions, executors and their number do not show in the digest, and no task holds more
than a partition's rows and a few groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_counted

FAN = 1024


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of the values, each with its length; a null differs from every text."""
    shown = [F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("N")) for c in columns]
    return F.sha2(F.concat_ws(",", *shown), 256)


def merkle(df: DataFrame, order: list[str], columns: list[str], fan: int = FAN) -> DataFrame:
    """digest, n_rows: one row. Rows with equal values of order follow in the order of their own digests."""
    rows = df.select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], row_digest(columns).alias("digest"))
    by = [*[F.col(f"o{i}").asc_nulls_first() for i in range(len(order))], F.col("digest")]
    placed, n = cut_counted(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("digest", F.monotonically_increasing_id().alias("id")))
    if not n:
        return df.sparkSession.range(1).select(F.sha2(F.lit(""), 256).alias("digest"), F.lit(0).cast("long").alias("n_rows"))
    part = F.shiftright("id", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))  # a row a partition
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = placed.withColumn("part", part).join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("digest", (F.col("before") + F.col("id") - F.shiftleft("part", 33)).alias("place"))
    left = n
    while True:
        near = F.array_sort(F.collect_list(F.struct("place", "digest")))
        level = level.groupBy(F.floor(F.col("place") / fan).alias("up")).agg(near.alias("near")).select(F.sha2(F.array_join(F.transform("near", lambda x: x["digest"]), ""), 256).alias("digest"), F.col("up").alias("place"))
        left = -(-left // fan)
        if left == 1:
            return level.select("digest", F.lit(n).cast("long").alias("n_rows"))
