"""What several training-data operators share."""

from __future__ import annotations

import ctypes

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The six blanks that the contracts strip and split at.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def plain(docs: DataFrame) -> list[str]:
    """Columns of docs that operators pass on: names with two leading underscores are their own, and dropped."""
    return [c for c in docs.columns if not c.startswith("__")]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __id, __t (null text: empty) and __k, a 128-bit key of both.

    Rows that repeat both id and text share a key and so an outcome; a null id or
    a repeated id with another text keeps a key of its own."""
    d = docs.select(*plain(docs)).withColumn("__id", F.col(id_col)).withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    named = F.concat(F.coalesce(F.col("__id").cast("string"), F.lit("?")), F.lit("\n"), F.col("__t"))
    return d.withColumn("__k", F.unhex(F.md5(named)))


def trim() -> None:
    """Give memory that a worker process no longer uses back to the system; workers outlive their tasks, and other stages run in them."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
