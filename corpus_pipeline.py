"""A corpus pipeline of the training-data operators.

documents -> toxicity -> line dedup -> SimHash near-dedup -> benchmark
decontamination -> best-fit packing. Every stage takes what its predecessor
kept, written as Parquet in the shared folder; all but the last return the
columns of documents.

Near-duplicates and contaminated documents are found and dropped by a 64-bit hash
of id and text, so null and repeated ids each have a fate of their own. Of rows
that repeat id and text the near-dedup stage keeps one.

Odd rows, in every stage: an empty table gives an empty table; a null text counts as
empty, and stays null until the line stage makes it an empty text; texts of any length
are read whole; columns beyond those of documents pass through all stages but the last,
save names with two leading underscores, which are the operators' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import decontaminate, line_dedup, packing, simhash, toxicity
from weft.llm.common import keyed
from weft.llm.queries import tokenizer_path
from weft.session import cut, table


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def _with_row(docs: DataFrame) -> DataFrame:
    """docs with __row, which rows share only if they repeat id and text."""
    return keyed(docs, "doc_id", "text").withColumn("__row", F.xxhash64("__k"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach their language's threshold go.

    Repeated rows have one score and one fate; ties with the threshold go; without labels of both kinds all stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(~F.col("__toxic")).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more go; the documents stay.

    Rows that repeat an id count as one document; a document that loses all lines stays with an empty text."""
    return _counted(line_dedup.drop_frequent_lines(docs, min_docs=10, min_chars=1), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word fingerprints, one row with the smallest id stays; a null id comes last.

    Empty texts are copies of one another. Of rows with the smallest id but different texts, the smallest hash stays."""
    rows = _with_row(docs)
    found = simhash.near_duplicates(rows, words=5, max_bits=3, id_col="__row")
    ids = rows.select(F.col("__row").alias("id"), "doc_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "id")
    kept = found.select("id", "component").distinct().join(ids, "id").groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.id").alias("__row"))
    return rows.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with up to 6 % of its characters edited; an empty benchmark leaves all."""
    rows = _with_row(docs)
    found = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="__row")
    gone = cut(found.select(F.col("doc_id").alias("__row")).distinct())
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens. Empty texts are one end token; repeated rows are packed each."""
    return packing.pack_documents(docs, tokenizer_path(), 2048).drop("row_key")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: A trained model, components of near-duplicates and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
