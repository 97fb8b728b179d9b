"""States of repositories, kept by a stream of changes to their files.

A repository's signature adds up a hash of each file it holds, so a change costs one subtraction and one addition, in
whatever order changes come. State is kept by repository and slice of its files: a repository with a third of all
files is many groups, each a map in the state store of one executor, not in a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Slices of a repository's files.
SLICES = 32
#: Signatures are sums modulo this.
MODULUS = 1 << 60
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = "repository string, slice int, files long, part long, revision long"


def file_hash() -> F.Column:
    """60 bits of a file's path and content, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x00", "file", F.coalesce("content", F.lit(""))), 256), 1, 15), 16, 10).cast("long")


class Slice(StatefulProcessor):
    """One slice of one repository: file -> (hash, order of its last change; hash -1 once removed), and the sum of the hashes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "file string", "hash long, at long, seq long")
        self.total = handle.getValueState("total", "files long, part long, revision long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        files, part, revision = self.total.get() if self.total.exists() else (0, 0, 0)
        before = (files, part)
        for batch in rows:
            for file, mark, at, seq in zip(batch["file"], batch["hash"], batch["at"], batch["seq"]):
                old = self.held.getValue((file,)) if self.held.containsKey((file,)) else None
                if old is not None and (int(at), int(seq)) <= (old[1], old[2]):
                    continue  # late: a newer change of the file is known
                was, now = -1 if old is None else old[0], int(mark)
                self.held.updateValue((file,), (now, int(at), int(seq)))
                files += (now >= 0) - (was >= 0)
                part = (part + max(now, 0) - max(was, 0)) % MODULUS
        if (files, part) != before:
            self.total.update((files, part, revision + 1))
            yield pd.DataFrame({"repository": [key[0]], "slice": [key[1]], "files": [files], "part": [part], "revision": [revision + 1]})

    def close(self) -> None:
        pass


def changed_slices(changes: DataFrame, slices: int = SLICES) -> DataFrame:
    """From a stream of changes(repository, file, content, removed, at, seq): a row for each slice whose state a micro-batch
    changed. Of a file's changes the last by (at, seq) holds; a change that changes nothing emits nothing. Changes without
    repository or file are left out; a null content counts as empty."""
    mark = F.when(F.col("removed"), F.lit(-1).cast("long")).otherwise(file_hash())
    c = changes.where(F.col("repository").isNotNull() & F.col("file").isNotNull())
    c = c.select("repository", F.pmod(F.crc32(F.col("file").cast("binary")), F.lit(slices)).cast("int").alias("slice"), "file", mark.alias("hash"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.col("seq").cast("long").alias("seq"))
    return c.groupBy("repository", "slice").transformWithStateInPandas(statefulProcessor=Slice(), outputStructType=PARTS, outputMode="Update", timeMode="None")


def follow(changes: DataFrame, out: str, checkpoint: str, slices: int = SLICES):
    """Run the stream over all that has arrived; changed slices go to out, a folder for each micro-batch. A batch that is run
    again after a failure replaces its own folder, so each change shows once."""
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    return changed_slices(changes, slices).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(spark: SparkSession, out: str) -> DataFrame:
    """repository, files, signature from the newest state of each slice; a repository without files is left out."""
    parts = spark.read.schema(PARTS + ", batch long").option("basePath", out).parquet(out)
    newest = parts.groupBy("repository", "slice").agg(F.max_by(F.struct("files", "part"), "revision").alias("x")).select("repository", "x.*")
    total = newest.groupBy("repository").agg(F.sum("files").alias("files"), F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    return total.where("files > 0").select("repository", "files", F.expr(f"CAST(s % {MODULUS} AS BIGINT)").alias("signature"))
