"""Links kept up to date after a change, without linking everything again.

A link holds only where a call has one candidate alone, or a name one owner alone, so a changed endpoint or package can
make or break links of units that did not change. Candidates are therefore kept beside the links: a change removes and
adds candidates, and only calls or names whose candidates changed are judged anew. Every join has the change on one
side, so Spark broadcasts it while it is small and shuffles when it is not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import link
from .merkle import row_digest


@dataclass(frozen=True)
class Relinked:
    """candidates and links as they are now; touched: the keys that were judged anew; removed and added links."""

    candidates: DataFrame
    links: DataFrame
    touched: DataFrame
    removed: DataFrame
    added: DataFrame

    def report(self) -> DataFrame:
        """what, n: how many keys were judged anew, and how many links that removed and added."""
        sides = (("judged", self.touched), ("removed", self.removed), ("added", self.added))
        first, *rest = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n") for what, df in sides]
        for df in rest:
            first = first.unionByName(df)
        return first


def changed_keys(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The keys of rows that were added, removed or altered between two tables of the same columns; a key that several
    rows bear counts as altered where their multiset differs. Null keys are left out."""
    columns = [c for c in before.columns if c != key]
    sides = before.select(key, row_digest(columns).alias("d"), F.lit(1).alias("n")).unionByName(after.select(key, row_digest(columns).alias("d"), F.lit(-1).alias("n")))
    return sides.where(F.col(key).isNotNull()).groupBy(key, "d").agg(F.sum("n").alias("n")).where("n <> 0").select(key).distinct()


def _settle(links: DataFrame, touched: DataFrame, fresh: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """links after touched keys took their fresh rows; what went and what came."""
    old = links.join(touched, key, "left_semi").select(*links.columns)
    fresh = cut(fresh.select(*links.columns))
    return links.join(touched, key, "left_anti").select(*links.columns).unionByName(fresh), old.exceptAll(fresh), fresh.exceptAll(old)


def relink_http(candidates: DataFrame, links: DataFrame, calls: DataFrame, endpoints: DataFrame, changed_calls: DataFrame, changed_endpoints: DataFrame) -> Relinked:
    """candidates (http_candidates) and links (only_candidates) of the tables before, calls and endpoints as they are now,
    and the ids that differ (changed_keys): the same candidates and links as by linking everything anew.

    Ids name one row each. Calls that did not change meet changed endpoints only."""
    gone_calls, gone_ends = changed_calls.select("call_id").distinct(), changed_endpoints.select("endpoint_id").distinct()
    rest = calls.join(gone_calls, "call_id", "left_anti").select(*calls.columns)
    new_calls = calls.join(gone_calls, "call_id", "left_semi").select(*calls.columns)
    new_ends = endpoints.join(gone_ends, "endpoint_id", "left_semi").select(*endpoints.columns)
    found = cut(link.http_candidates(new_calls, endpoints).unionByName(link.http_candidates(rest, new_ends)))
    stays = candidates.join(gone_calls, "call_id", "left_anti").join(gone_ends, "endpoint_id", "left_anti").select(*candidates.columns)
    lost = candidates.join(gone_ends, "endpoint_id", "left_semi").select("call_id")
    touched = cut(gone_calls.unionByName(found.select("call_id")).unionByName(lost).distinct())
    now = stays.unionByName(found.select(*candidates.columns))
    settled, removed, added = _settle(links, touched, link.only_candidates(now.join(touched, "call_id", "left_semi").select(*now.columns)), ["call_id"])
    return Relinked(now, settled, touched, removed, added)


def relink_packages(links: DataFrame, identities: tuple[DataFrame, DataFrame], declared: DataFrame, imports: DataFrame, changed_units: DataFrame) -> Relinked:
    """links (package_links) of the tables before; identities(unit, name) before and now, declared and imports as they are
    now, and the units that differ: the same links as by linking everything anew.

    Judged anew are the names that changed units bore, bear or declare; owners of a name are all units that bear it."""
    gone = changed_units.select("unit").distinct()
    of = lambda df: df.join(gone, "unit", "left_semi").select("name")
    before, now = identities
    touched = cut(of(before).unionByName(of(now)).unionByName(of(declared)).distinct())
    on = lambda df: df.join(touched, "name", "left_semi").select("unit", "name")
    fresh = link.package_links(on(now), on(declared), on(imports))
    was_theirs = gone.select(F.col("unit").alias("source_unit"))
    undeclared = links.join(was_theirs, "source_unit", "left_semi").join(touched, "name", "left_anti").select(*links.columns)
    others = links.join(undeclared.select("source_unit", "name"), ["source_unit", "name"], "left_anti").select(*links.columns)
    settled, removed, added = _settle(others, touched, fresh, ["name"])
    return Relinked(now, settled, touched, removed.unionByName(undeclared), added)


def unsound(links: DataFrame, calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """kind, call_id, endpoint_id: links whose call or endpoint is missing, whose ends lie in one unit, or whose call has
    another link. Empty where links may be published."""
    ends = links.select("call_id", "endpoint_id", "call_unit", "target_unit")
    kinds = (
        ("missing-call", ends.join(calls.select("call_id"), "call_id", "left_anti")),
        ("missing-endpoint", ends.join(endpoints.select("endpoint_id"), "endpoint_id", "left_anti")),
        ("own-unit", ends.where("call_unit = target_unit")),
        ("several-links", ends.join(ends.groupBy("call_id").count().where("count > 1").select("call_id"), "call_id", "left_semi")),
    )
    first, *rest = [df.select(F.lit(kind).alias("kind"), "call_id", "endpoint_id") for kind, df in kinds]
    for df in rest:
        first = first.unionByName(df)
    return first
