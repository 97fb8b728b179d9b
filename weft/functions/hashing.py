"""Identity functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def fnv1a64(c: Column) -> Column:
    """FNV-1a over UTF-8 bytes, 16 lowercase hex digits.

    The 64-bit state is kept in two 32-bit halves, as ANSI arithmetic does not wrap.
    The prime is 2^40 + 0x1b3."""
    digits = F.hex(F.encode(c, "UTF-8"))
    count = (F.length(digits) / 2).cast("int")
    values = F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long")))
    low32 = F.lit(0xFFFFFFFF)

    def step(state: Column, byte: Column) -> Column:
        x = state["lo"].bitwiseXOR(byte)
        low = x * 435
        high = state["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(low32).alias("hi"), low.bitwiseAND(low32).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    shown = lambda s: F.lower(F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0")))
    folded = F.aggregate(F.coalesce(values, F.array().cast("array<bigint>")), start, step, shown)
    return F.when(c.isNotNull(), folded)


def stable_hash(c: Column) -> Column:
    """FNV-1a of a path or name, with backslashes as slashes."""
    return fnv1a64(F.replace(c, F.lit("\\"), F.lit("/")))


def slugify(c: Column) -> Column:
    """Lower-case ASCII letters and digits; every other run is one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def scoped_id(scope: Column, value: Column) -> Column:
    return F.concat(slugify(scope), F.lit(":"), stable_hash(F.concat(scope, F.lit("\0"), value)))
