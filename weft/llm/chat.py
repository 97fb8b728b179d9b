"""Chat formatting from event logs.

A log row is (conv, seq, msg, kind, role, text). Kinds: "delta" adds text to its
message, "edit" replaces it, "regenerate" empties it so that later deltas write
it anew. The fold runs by message (Spark windows and sorts), so a conversation
of any length is spread over tasks; a message's place is its first sequence
number. Rendering is one row per turn, with the span of the loss mask.

The template is <|im_start|>role, newline, text, <|im_end|>, newline. Inside
texts and roles every "<", backslashes, "|" gets one backslash more, so no
control string can occur in them and the way back is exact; a newline in a role
is written as backslash n and its backslashes are doubled.

Edge cases: null text and null role are empty; a null conversation id is a
conversation of its own; ties of seq go by message, then text; unknown kinds
raise an error; an empty log gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*+)\|", r"<$1\\|")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv, seq, msg, kind, role, text) to one row per message: conv, ord, msg, role, text."""
    e = events.select(
        "conv", "seq", "msg", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    known = F.col("kind").isin("delta", "edit", "regenerate")
    e = e.withColumn("kind", F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown event: "), F.coalesce("kind", F.lit("null"))))))
    own = Window.partitionBy("conv", "msg")
    reset = F.when(F.col("kind") != "delta", F.col("seq"))
    e = e.withColumn("from", F.max(reset).over(own)).withColumn("ord", F.min("seq").over(own))
    live = e.where(F.col("from").isNull() | (F.col("seq") >= F.col("from")))
    part = F.struct("seq", F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text")).alias("text"))
    return (
        live.groupBy("conv", "msg")
        .agg(F.min("ord").alias("ord"), F.max_by("role", F.struct(F.col("role") != "", "seq")).alias("role"), F.array_sort(F.collect_list(part)).alias("parts"))
        .select("conv", "ord", "msg", "role", F.concat_ws("", F.col("parts.text")).alias("text"))
    )


def render(messages: DataFrame, learn_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv, ord, msg, formatted, loss_start, loss_end (code points inside formatted; both 0 where nothing is learned)."""
    role = F.regexp_replace(F.regexp_replace(_escaped(F.col("role")), r"\\", r"\\\\"), "\n", r"\\n")
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = _escaped(F.col("text"))
    learned = F.col("role").isin(*learn_roles)
    m = messages.withColumn("__head", head).withColumn("__body", body)
    at = F.char_length("__head")
    return m.select(
        "conv", "ord", "msg", F.concat("__head", "__body", F.lit(f"{END}\n")).alias("formatted"),
        F.when(learned, at).otherwise(0).cast("int").alias("loss_start"),
        F.when(learned, at + F.char_length("__body")).otherwise(0).cast("int").alias("loss_end"),
    )


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(text: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S))


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    if not (formatted.startswith(START) and formatted.endswith(f"{END}\n")):
        raise ValueError("not a rendered turn")
    role, _, body = formatted[len(START) : -len(END) - 1].partition("\n")
    return unescape_role(role), unescape(body)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by conversation and place; state is one conversation's running hashes."""
    now = state = None

    def row():
        n, turns, chars, loss, formatted = state
        return (now[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted)

    for b in batches:
        out = []
        for null, conv, text, a, z in zip(b["null"], b["conv"], b["formatted"], b["loss_start"], b["loss_end"]):
            key = (None if null else int(conv),)
            if key != now:
                if now is not None:
                    out.append(row())
                now, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, body = parse_turn(text)
            learned = unescape(text[a:z])
            state[0] += 1
            state[1].update(f"{role}\n{body}\n".encode())
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += len(text)
        yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})
    if now is not None:
        yield pd.DataFrame([row()], columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from the rendered turns.

    Turns are dealt by conversation, sorted, and streamed: memory holds one batch,
    however long a conversation is."""
    r = rendered.select(F.col("conv").isNull().alias("null"), F.coalesce(F.col("conv").cast("long"), F.lit(0)).alias("conv"), "ord", "msg", "formatted", "loss_start", "loss_end")
    dealt = r.repartition("null", "conv").sortWithinPartitions("null", "conv", "ord", "msg", "formatted")
    return dealt.mapInPandas(_digests, DIGEST)
