"""Relational chat formatting: turns become one training string per conversation, in Spark expressions only.

Template: every run of adjacent turns of one role is `<s>[INST]role[/INST]`, the texts of the run
joined by `[NEXT]`, and `</s>`. Inside roles and texts `~`, `<` and `[` are written `~0`, `~1` and
`~2`. Escaped text therefore holds neither `<` nor `[`, so no control string can be imitated and
every conversation can be read back exactly.

Defined results: a NULL text or role counts as empty; NULL turns sort first, equal turn numbers sort
by role and text, repeated rows stay; rows without a conversation id form one conversation with a
NULL id; an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, NEXT, CLOSE = "<s>[INST]", "[/INST]", "[NEXT]", "</s>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def format_turns(
    turns: DataFrame,
    learn: Sequence[str] = ("assistant",),
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """`key`, `formatted`, and `loss`: (start, length) of the escaped texts of the roles in `learn`.

    Starts are 0-based code points of `formatted`. One aggregate per conversation sorts the
    collected turn structs; merging same-role neighbours, joining and locating the mask are array
    expressions on the sorted list, so the table is shuffled once.
    """
    part = F.struct(
        F.col(turn).alias("t"),
        F.coalesce(F.col(role), F.lit("")).alias("r"),
        F.coalesce(F.col(text), F.lit("")).alias("x"),
    )
    sorted_turns = turns.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(part)).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        """What stands before this turn's text, the text, what stands after, and whether it is learnt."""
        before = F.get(F.col("turns"), i - 1)["r"]
        after = F.get(F.col("turns"), i + 1)["r"]
        opening = F.concat(F.lit(OPEN), escape(t["r"]), F.lit(HEAD))
        return F.struct(
            F.when((i > 0) & (before == t["r"]), F.lit(NEXT)).otherwise(opening).alias("a"),
            escape(t["x"]).alias("x"),
            F.when(after == t["r"], F.lit("")).otherwise(F.lit(CLOSE)).alias("z"),
            t["r"].isin(*learn).alias("l"),
        )

    pieces = sorted_turns.select("key", F.transform("turns", piece).alias("p"))
    width = F.transform("p", lambda p: F.struct((F.length(p["a"]) + F.length(p["x"]) + F.length(p["z"])).cast("long").alias("w"), F.length(p["a"]).cast("long").alias("a"), F.length(p["x"]).cast("long").alias("x"), p["l"].alias("l")))
    sized = pieces.select(
        "key",
        F.array_join(F.transform("p", lambda p: F.concat(p["a"], p["x"], p["z"])), "").alias("formatted"),
        width.alias("w"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def locate(s: Column, p: Column) -> Column:
        span = F.struct((s["at"] + p["a"]).alias("start"), p["x"].alias("length"))
        return F.struct((s["at"] + p["w"]).alias("at"), F.when(p["l"], F.array_append(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return sized.select(F.col("key").alias(key), "formatted", F.aggregate("w", start, locate)["spans"].alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs that a formatted string holds, unescaped, one for every input turn."""
    runs = F.filter(F.split(formatted, CLOSE), lambda r: r != "")
    parts = F.transform(runs, lambda r: F.split(F.substring(r, len(OPEN) + 1, 2147483647), r"\[/INST\]"))
    return F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.split(F.get(p, F.lit(1)), r"\[NEXT\]"),
                lambda x: F.struct(unescape(F.get(p, F.lit(0))).alias("role"), unescape(x).alias("text")),
            ),
        )
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped and joined."""
    return unescape(F.array_join(F.transform(loss, lambda s: F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int"))), ""))
