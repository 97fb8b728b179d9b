"""A registry kept in versions: rows are created, updated and removed in batches, and what cannot be done is returned with a code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.records import is_safe_id
from ..session import cut
from .versions import Versions

#: Codes of refused rows, the first that fits.
INVALID, REPEATED, EXISTS, MISSING = "invalid-id", "repeated-id", "already-exists", "not-found"


class Registry:
    """Table `name` of a store, keyed by the text column `id`, which must be the name of one folder."""

    def __init__(self, store: Versions, name: str, id: str = "id"):
        self.store, self.name, self.id = store, name, id

    def rows(self) -> DataFrame:
        return self.store.read(self.name)

    def create(self, rows: DataFrame) -> DataFrame:
        """Add rows whose ids are new; returns id, code of the others."""
        return self._apply(rows, EXISTS, lambda ok: self.store.commit({self.name: ok}))

    def update(self, rows: DataFrame) -> DataFrame:
        """Replace rows whose ids exist; returns id, code of the others."""
        return self._apply(rows, MISSING, lambda ok: self.store.commit({self.name: ok}))

    def remove(self, ids: DataFrame) -> DataFrame:
        """Remove ids that exist; returns id, code of the others."""
        return self._apply(ids.select(self.id), MISSING, lambda ok: self.store.commit({}, {self.name: ok}))

    def _apply(self, rows: DataFrame, unless: str, write) -> DataFrame:
        """All rows of a repeated id are refused, since none of them is better than the others."""
        counted = rows.groupBy(self.id).agg(F.count(F.lit(1)).alias("__n"))
        known = self.rows().select(self.id, F.lit(True).alias("__known")) if self.store.head() else None
        counted = counted.withColumn("__known", F.lit(None).cast("boolean")) if known is None else counted.join(known, self.id, "left")
        clash = F.col("__known").isNotNull() if unless == EXISTS else F.col("__known").isNull()
        code = F.when(F.col(self.id).isNull() | ~is_safe_id(F.col(self.id)), INVALID).when(F.col("__n") > 1, REPEATED).when(clash, unless)
        judged = cut(counted.select(self.id, code.alias("code")))
        write(rows.join(judged.where("code IS NULL"), self.id, "left_semi").select(*rows.columns))
        return judged.where("code IS NOT NULL")
