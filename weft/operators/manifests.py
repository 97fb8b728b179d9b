"""Manifests in JSON read as what they are: VARIANT values, their sections exploded into rows.

A text that is not JSON (cut short, keys given twice) stays, marked as malformed, for readers that search text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Manifest, its sections that declare packages. Fixed values.
SECTIONS = [("package.json", ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")), ("composer.json", ("require", "require-dev"))]


def parsed(files: DataFrame) -> DataFrame:
    """files(unit, name, rel_path, text) that are JSON manifests, with doc (variant) and malformed; a null text is malformed."""
    doc = F.try_parse_json("text")
    return files.where(F.col("name").isin(*[m for m, _ in SECTIONS])).withColumn("doc", doc).withColumn("malformed", F.col("doc").isNull())


def identities(manifests: DataFrame) -> DataFrame:
    """unit, rel_path, name: the package's own name, where it is a text that is not empty."""
    own = F.try_variant_get("doc", "$.name", "string")
    texts = F.schema_of_variant(F.try_variant_get("doc", "$.name", "variant")) == "STRING"
    return manifests.where(~F.col("malformed") & texts).select("unit", "rel_path", own.alias("name")).where("name <> ''")


def declared(manifests: DataFrame) -> DataFrame:
    """unit, rel_path, section, name, version: a row for each member of the sections that declare packages. A version that is
    not a text is shown as JSON; sections that are not objects declare nothing."""
    sound = manifests.where(~F.col("malformed"))
    section = lambda s: F.struct(F.lit(s).alias("section"), F.try_variant_get("doc", f"$['{s}']", "variant").alias("members"))
    of = F.array().cast("array<struct<section: string, members: variant>>")
    for manifest, sections in SECTIONS:
        of = F.when(F.col("name") == manifest, F.array(*map(section, sections))).otherwise(of)
    rows = sound.select("unit", "rel_path", F.explode(of).alias("x")).select("unit", "rel_path", "x.*").where(F.schema_of_variant("members").startswith("OBJECT"))
    members = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("members").outer()))
    return members.select("unit", "rel_path", "section", F.col("key").alias("name"), F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value")).alias("version"))
