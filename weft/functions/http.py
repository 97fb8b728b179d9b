"""Paths, origins and hosts of HTTP calls and endpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import ascii_lower

#: A segment that stands for any value: {id}, ${id}, :id, <id>, [id], *
DYNAMIC = r"^(\{.*\}|\$\{.*\}|:.+|<.*>|\[.*\]|\*+)$"
#: A last segment that stands for any number of segments.
CATCH_ALL = r"^(\*+|\{\*.*\}|\{.*\*\}|\{\.\.\..*\}|\[\.\.\..*\]|:.+\*)$"
LOCAL = ("localhost", "127.0.0.1", "0.0.0.0", "::1")


def path_of(c: Column) -> Column:
    """The path of a URL or path, without origin, query and fragment."""
    bare = F.regexp_replace(c, r"[?#].*$", "")
    path = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.when(F.length(path) == 0, F.lit("/")).otherwise(path)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_dynamic(s: Column) -> Column:
    return s.rlike(DYNAMIC)


def is_catch_all(s: Column) -> Column:
    return s.rlike(CATCH_ALL)


def normalize_path(c: Column) -> Column:
    """Dynamic segments as {}, the rest in ASCII lower case, one slash between."""
    parts = F.transform(segments(path_of(c)), lambda s: F.when(is_dynamic(s), F.lit("{}")).otherwise(ascii_lower(s)))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def paths_match(call: Column, endpoint: Column) -> Column:
    """Segment arrays match: same length with dynamic segments on either side, or the endpoint ends in a catch-all."""
    n, m = F.size(call), F.size(endpoint)
    tail = F.when(m > 0, is_catch_all(F.element_at(endpoint, -1))).otherwise(False)
    head = F.when(tail, m - 1).otherwise(m)
    pairs = F.zip_with(F.slice(call, F.lit(1), head), F.slice(endpoint, F.lit(1), head), lambda a, b: is_dynamic(a) | is_dynamic(b) | (ascii_lower(a) == ascii_lower(b)))
    long_enough = F.when(tail, n >= head).otherwise(n == m)
    return long_enough & F.forall(pairs, lambda ok: F.coalesce(ok, F.lit(False)))


def origin_host(c: Column) -> Column:
    """Host of an absolute URL, lower case, without user, port, brackets and trailing dot; null for paths."""
    authority = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(authority, r"^.*@", "")
    six = F.regexp_extract(host, r"^\[([^\]]*)\]", 1)
    plain = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"\.$", "")
    out = ascii_lower(F.when(six != "", six).otherwise(plain))
    return F.when(out != "", out)


def is_local_host(host: Column) -> Column:
    return host.isin(*LOCAL) | host.endswith(".localhost")


def host_aliases(name: Column) -> Column:
    """Names under which a unit may be reached: as it is, with hyphens, and compact."""
    low = ascii_lower(name)
    return F.array_sort(F.array_distinct(F.array(low, F.btrim(F.regexp_replace(low, "[^a-z0-9]+", "-"), F.lit("-")), F.regexp_replace(low, "[^a-z0-9]", ""))))
