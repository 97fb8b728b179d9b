"""Line dedup: lines found in many documents are dropped from all of them.

Lines are exploded with their positions, normalised and hashed (MD5); distinct
documents are counted by hash; positions whose hash is over the threshold are
dropped and the rest is joined again in order. Distinct (hash, document) pairs are
shuffled for the counts, which are summed before they meet; the frequent hashes are
written to the shared folder, so Spark knows their size when it joins them with the
lines: a small table is broadcast, and of a large one's join the partition of a hot
line is split, as both of its sides are plain shuffles. The text moves once, beside
its dropped positions.

Edge cases: null and empty texts are one empty line; a key shorter than
min_chars (so by default an empty one) is never dropped; repeated rows of one id
count as one document; an empty table gives an empty table; a document that
loses all lines stays, with empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import BLANKS, ascii_lower, keyed, plain


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with text_col rewritten, and with __n_lines and __n_dropped."""
    d = keyed(docs, id_col, text_col)
    lines = d.select("__k", "__id", F.posexplode(F.split("__t", "\n", -1)).alias("__pos", "__line")).select(
        "__k", "__id", "__pos", ascii_lower(F.btrim("__line", F.lit(BLANKS))).alias("__key")
    )
    lines = lines.where(F.char_length("__key") >= max(min_chars, 0)).select(
        "__k", "__id", "__pos", F.unhex(F.md5("__key")).alias("__hash")
    )
    frequent = cut(
        lines.select("__hash", "__id").distinct().groupBy("__hash").agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") >= min_docs).select("__hash")
    )
    dropped = (
        lines.join(frequent, "__hash", "left_semi").groupBy("__k").agg(F.collect_set("__pos").alias("__drop"))
    )  # a document's own positions: bounded by its text
    split = d.join(dropped, "__k", "left").withColumn("__lines", F.split("__t", "\n", -1))
    last = F.size("__lines") - 1
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), last), F.col("__drop")))
    text = F.array_join(F.transform(kept, lambda i: F.element_at(F.col("__lines"), i + 1)), "\n")
    out = split.withColumn("__n_lines", F.size("__lines").cast("long")).withColumn(
        "__n_dropped", F.coalesce(F.size("__drop"), F.lit(0)).cast("long")
    )
    out = out.withColumn(text_col, F.when(F.col("__drop").isNull(), F.col("__t")).otherwise(text))
    return out.select(*plain(docs), "__n_lines", "__n_dropped")
