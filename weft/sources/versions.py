"""Tables in versions: a log of changes in files, with a checksummed manifest that is written last.

A version holds, for each table, the rows that were put and the keys that were dropped, in a folder of its own. Its
manifest names every file with length and SHA-256 and is written when all of them are there: a version without one does
not exist, so a writer that dies leaves nothing to clean up before the next. Readers take the newest version whose
whole chain of files is in order; a damaged version is put in quarantine and the one before it serves. Compaction writes
the live rows as one full version. Nothing is renamed or overwritten, so object stores will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version long, kind string, folder string, name string, schema string, path string, length long, sha256 string, entries long"
QUARANTINE = "version long, name string, path string, reason string"
#: Rows of a file, so that a file's bytes fit in a task when their checksum is taken.
ROWS_PER_FILE = 4_000_000
PUT = "__put"


class Versions:
    """Tables under base, keyed by keys[name]. Of a commit's rows of one table, each key is borne by one, and none is null."""

    def __init__(self, spark: SparkSession, base: str, keys: dict[str, list[str]]):
        self.spark, self.base, self.keys = spark, base.rstrip("/"), keys

    # writing

    def commit(self, puts: dict[str, DataFrame], drops: dict[str, DataFrame] | None = None) -> int:
        """A version with rows put (created or replaced) and keys dropped; returns its number. A key in both is put."""
        return self._write("change", puts, drops or {})

    def compact(self) -> int:
        """A full version of the live rows; readers need no earlier one."""
        return self._write("full", {name: self.read(name) for name in self.keys if self._has(name)}, {})

    def _write(self, kind: str, puts: dict[str, DataFrame], drops: dict[str, DataFrame]) -> int:
        if unknown := (set(puts) | set(drops)) - set(self.keys):
            raise KeyError(f"tables without a key: {sorted(unknown)}")
        version = max([v for v, *_ in self._known()], default=0) + 1
        folder = f"v-{uuid.uuid4().hex}"
        entries = []
        for name in sorted(set(puts) | set(drops)):
            rows = puts[name].withColumn(PUT, F.lit(True)) if name in puts else None
            if name in drops:
                gone = drops[name].select(*self.keys[name]).distinct().withColumn(PUT, F.lit(False))
                if rows is not None:
                    gone = gone.join(rows.select(*self.keys[name]), self.keys[name], "left_anti")
                rows = gone if rows is None else rows.unionByName(gone, allowMissingColumns=True)
            at = f"{self.base}/data/{folder}/{name}"
            rows.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(at)
            entries.append((name, rows.schema.json(), at))
        # schema rows stand for tables, the others for their files
        listed = self.spark.createDataFrame([(n, s, None, None, None) for n, s, _ in entries], "name string, schema string, path string, length long, sha256 string")
        for name, _, at in entries:
            listed = listed.unionByName(_files(self.spark, at, deep=True).select(F.lit(name).alias("name"), F.lit(None).cast("string").alias("schema"), "path", "length", "sha256"))
        head = {"version": F.lit(version).cast("long"), "kind": F.lit(kind), "folder": F.lit(folder), "entries": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))}
        rows = listed.repartition(1).withColumns(head)  # a row for each file, so that the manifest is one file and there or not
        rows.select(*[c.split()[0] for c in MANIFEST.split(", ")]).write.mode("error").parquet(f"{self.base}/manifests/{version:010d}")
        return version

    # reading

    def read(self, name: str, deep: bool = False) -> DataFrame:
        """The live rows of a table as of the newest sound version; deep compares checksums, not lengths alone."""
        chain = [v for v in self._chain(deep) if name in v[3]]
        if not chain:
            raise LookupError(f"no sound version holds {name}")
        keys = self.keys[name]
        parts = [(kind, version, self.spark.read.schema(StructType.fromJson(json.loads(schemas[name]))).parquet(f"{self.base}/data/{folder}/{name}")) for version, kind, folder, schemas in chain]
        if parts[0][0] == "full" or len(parts) == 1:
            whole, changes = parts[0][2].where(PUT), parts[1:]
        else:
            whole, changes = None, parts
        if not changes:
            return whole.drop(PUT)
        log = None
        for _, version, df in changes:
            df = df.withColumn("__version", F.lit(version))
            log = df if log is None else log.unionByName(df, allowMissingColumns=True)
        rest = [c for c in log.columns if c not in (*keys, "__version")]
        last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__version").alias("x")).select(*keys, "x.*")
        live = last.where(PUT).drop(PUT)
        if whole is None:
            return live
        return whole.drop(PUT).join(last.select(*keys), keys, "left_anti").unionByName(live, allowMissingColumns=True)

    def head(self, deep: bool = False) -> int | None:
        """The newest version that read() serves."""
        chain = self._chain(deep)
        return chain[-1][0] if chain else None

    def damage(self, deep: bool = True) -> DataFrame:
        """version, name, path, reason: files of manifests that are missing or are not what they were."""
        m = self._manifests().where("path IS NOT NULL").select("version", "folder", "name", "path", "length", "sha256")
        found = self._found(deep).select("folder", "name", "path", F.col("length").alias("l"), F.col("sha256").alias("s"))
        both = m.join(found, ["folder", "name", "path"], "left")
        reason = F.when(F.col("l").isNull(), "missing").when(F.col("l") != F.col("length"), "length")
        if deep:
            reason = reason.when(F.col("s") != F.col("sha256"), "checksum")
        return both.withColumn("reason", reason).where("reason IS NOT NULL").select("version", "name", "path", "reason")

    def quarantine(self) -> DataFrame:
        """Note the damage that is not noted yet, by checksums; those versions serve no reader any more. Returns all notes."""
        notes = self._notes()
        fresh = self.damage().join(notes, ["version", "name", "path"], "left_anti")
        if not fresh.isEmpty():
            fresh.select("version", "name", "path", "reason").write.mode("append").parquet(f"{self.base}/quarantine")
        return self._notes()

    # what there is

    def _manifests(self) -> DataFrame:
        """Rows of whole manifests; a torn one is as good as none."""
        try:
            rows = self.spark.read.schema(MANIFEST).option("ignoreCorruptFiles", True).parquet(f"{self.base}/manifests/*")
        except AnalysisException:  # nothing was committed yet
            return self.spark.createDataFrame([], MANIFEST)
        whole = rows.groupBy("version").agg((F.count(F.lit(1)) == F.max("entries")).alias("whole")).where("whole").select("version")
        return rows.join(whole, "version", "left_semi")

    def _notes(self) -> DataFrame:
        try:
            return self.spark.read.schema(QUARANTINE).parquet(f"{self.base}/quarantine")
        except AnalysisException:  # nothing was ever damaged
            return self.spark.createDataFrame([], QUARANTINE)

    def _found(self, deep: bool) -> DataFrame:
        try:
            return _files(self.spark, f"{self.base}/data", deep)
        except AnalysisException:
            return self.spark.createDataFrame([], "folder string, name string, path string, length long, sha256 string")

    def _known(self) -> list[tuple]:
        """(version, kind, folder, schemas), oldest first: a row for each version."""
        rows = self._manifests().where("path IS NULL").groupBy("version", "kind", "folder").agg(F.map_from_entries(F.collect_list(F.struct("name", "schema"))).alias("schemas"))
        return [(r.version, r.kind, r.folder, r.schemas) for r in rows.orderBy("version").collect()]

    def _has(self, name: str) -> bool:
        return any(name in v[3] for v in self._chain(False))

    def _chain(self, deep: bool) -> list[tuple]:
        """The versions to read, oldest first: a full one and the changes after it, as far as all are sound. A damaged change
        hides those after it up to the next full version; a damaged full version hides nothing, since it changed nothing."""
        bad = {r.version for r in self.damage(deep).select("version").unionByName(self._notes().select("version")).distinct().collect()}
        chain, broken = [], False
        for v in self._known():
            if v[1] == "full" and v[0] not in bad:
                chain, broken = [v], False
            elif v[1] == "change" and not broken:
                broken = v[0] in bad
                chain = chain if broken else [*chain, v]
        return chain


def _files(spark: SparkSession, at: str, deep: bool) -> DataFrame:
    """folder, name, path, length, sha256 of the Parquet files of versions under a folder; contents are read only if deep."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(at)
    part = lambda i: F.element_at(F.split("path", "/"), i)
    digest = F.sha2("content", 256) if deep else F.lit(None).cast("string")
    return found.select(part(-3).alias("folder"), part(-2).alias("name"), part(-1).alias("path"), "length", digest.alias("sha256"))
