"""Merkle manifest of a dataset: a root over all rows, and for every row the proof that it belongs.

Leaves of a group ascend by their order column; runs of `FAN` consecutive nodes become the hash of
their children until one node, the group's subroot, remains; subroots in the order of their groups
make the root in the same way.

Method: nested-struct rollup. A row's rank in its group is written as octal digits. The last
`DIGITS` digits address a leaf inside a block of FAN ** DIGITS rows; grouping the digit columns away
one after another hashes each run and nests its children as structs, all inside the block's
partition. The nested block is then transformed into one (row, path) struct per leaf and exploded,
which needs no join. Blocks are the leaves of the next, FAN ** DIGITS times smaller rollup; only its
paths (one row per block) meet the nested blocks by a join. No task holds more than whole blocks.
Ranks come from range-partitioned chunks and a table of chunk offsets, so a group may hold any share
of the rows.

Defined results: a NULL group is a group of its own and the first one; NULL order values come first,
equal ones go by leaf, and of repeated rows every copy is a leaf; an empty or very long text is
hashed as it is, a NULL one as `-`; a run of one node is hashed like any other while its level has
several nodes; an empty table gives an empty result. Input columns other than `group`, `order` and
`leaf` travel along under `item` and may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.plans.session import written

FAN, DIGITS = 8, 3
BLOCK = FAN**DIGITS

STEP = "struct<before: string, after: string>"


def leaf(values: Sequence[Column]) -> Column:
    """sha256 (lower-case hex) of the values, each as `-` if NULL, else its UTF-8 length, `:` and its text."""
    told = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told]), 256)


def fold(own: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, own, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def siblings(path: Column) -> Column:
    """Hex digests of all siblings on a path, from the leaf up, left to right, concatenated."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def _ranked(rows: DataFrame) -> DataFrame:
    """`g`, `n` (rows of the group), `r` (0-based rank), `h`, `item`, from `g`, `o`, `h`, `item`.

    Chunks of the order are written with every row's place in its chunk; a row's rank is its place
    behind the first row of its group there, plus the rows of the group in earlier chunks. Equal
    rows may be cut apart (`_salt`): any order of theirs gives the same result.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("g", "o", "h", "_salt")
    salted = written(rows.select("*", F.monotonically_increasing_id().alias("_salt")))
    placed = written(salted.repartitionByRange(n, *order).sortWithinPartitions(*order).select("g", "h", "item", F.monotonically_increasing_id().alias("at")))
    chunk, place = F.shiftright("at", 33).alias("chunk"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")
    placed = placed.select("g", "h", "item", chunk, place)
    parts = placed.groupBy("g", "chunk").agg(F.count(F.lit(1)).alias("here"), F.min("place").alias("first"))
    before = Window.partitionBy("g").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("g", "chunk", (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("plus"), F.sum("here").over(Window.partitionBy("g")).alias("n"))
    return placed.join(offsets, ["g", "chunk"]).select("g", "n", (F.col("place") + F.col("plus")).alias("r"), "h", "item")


def _rolled(nodes: DataFrame) -> DataFrame:
    """One row per block: `g`, `n`, `b`, `h` and its nested `kids`, grouping one digit of the rank away at a time."""
    digits = [F.pmod(F.floor(F.col("r") / FAN**k), F.lit(FAN)).cast("int").alias(f"d{k}") for k in range(DIGITS)]
    out = nodes.select("g", "n", F.floor(F.col("r") / BLOCK).alias("b"), *digits, "h", "item").repartition("g", "b")
    inner = "item"
    for k in range(DIGITS):
        keys = ["g", "n", "b", *[f"d{j}" for j in range(DIGITS - 1, k, -1)]]
        kids = F.sort_array(F.collect_list(F.struct(f"d{k}", "h", inner)))
        out = out.groupBy(*keys).agg(kids.alias("kids"))
        out = out.withColumn("h", F.when(F.col("n") > FAN**k, F.sha2(F.array_join("kids.h", ""), 256)).otherwise(F.col("kids")[0]["h"]))
        inner = "kids"
    return out


def _leaves(kids: Column, level: int, above: Column) -> Column:
    """(item, h, path) of every leaf below `kids`; a level that has one node adds no step."""

    def below(kid: Column, i: Column) -> Column:
        h = kids["h"]
        own = F.struct(F.array_join(F.slice(h, F.lit(1), i), "").alias("before"), F.array_join(F.slice(h, i + 2, F.lit(FAN)), "").alias("after"))
        path = F.concat(F.when(F.col("n") > FAN**level, F.array(own)).otherwise(F.array().cast(f"array<{STEP}>")), above)
        return _leaves(kid["kids"], level - 1, path) if level else F.struct(kid["item"].alias("item"), kid["h"].alias("h"), path.alias("path"))

    out = F.transform(kids, below)
    return F.flatten(out) if level else out


def _proved(nodes: DataFrame, most: int, crowned) -> DataFrame:
    """`g`, `item`, `h`, `path`, `subroot`, `root` of all nodes; `crowned(tops)` adds what is above the groups' tops."""
    blocks = written(_rolled(nodes))
    if most <= BLOCK:  # every group is one block now
        over = crowned(blocks.select("g", "h")).select("g", F.lit(0).cast("long").alias("b"), "path", "subroot", "root")
    else:
        parents = blocks.select("g", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("b").alias("r"), "h", F.struct("b").alias("item"))
        over = _proved(parents, -(-most // BLOCK), crowned).select("g", "item.b", "path", "subroot", "root")
    rows = blocks.join(over, ["g", "b"])
    leaves = _leaves(F.col("kids"), DIGITS - 1, F.col("path"))
    return rows.select("g", F.explode(leaves).alias("z"), "subroot", "root").select("g", "z.*", "subroot", "root")


def proofs(rows: DataFrame, group: str, order: str, leaf: str) -> DataFrame:
    """`item` (a row of the input), `subroot`, `root` and `path` from its leaf to the root.

    `group` is a string column, `leaf` the row's digest; a path is a list of steps, each with the
    siblings' digests before and after the node, joined.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`")), F.lit(""))  # NULL first, then by bytes
    given = rows.select(g.alias("g"), F.col(f"`{order}`").alias("o"), F.col(f"`{leaf}`").alias("h"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("item"))
    nodes = written(_ranked(given))
    most = nodes.agg(F.max("n")).first()[0] or 0

    def crowned(tops: DataFrame) -> DataFrame:
        one = _ranked(tops.select(F.lit("").alias("g"), F.col("g").alias("o"), "h", F.struct("g").alias("item")))
        count = tops.count()
        bare = lambda t: t.select("g", F.array().cast(f"array<{STEP}>").alias("path"), F.lit("").alias("subroot"), F.col("h").alias("root"))
        return _proved(one, count, bare).select("item.g", "path", F.col("h").alias("subroot"), "root")

    return _proved(nodes, most, crowned).select("item", "subroot", "root", "path")
