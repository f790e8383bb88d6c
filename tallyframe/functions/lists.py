"""Column expressions over list columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def drop_last(c: str | Column, n: int) -> Column:
    """The list without its last n elements; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return c if n <= 0 else F.slice(c, 1, F.greatest(F.size(c) - n, F.lit(0)))


def drop_last_if_longer(c: str | Column, n: int) -> Column:
    """As `drop_last`, but a list of at most n elements is left alone."""
    c = F.col(c) if isinstance(c, str) else c
    return c if n <= 0 else F.when(F.size(c) > n, F.slice(c, 1, F.greatest(F.size(c) - n, F.lit(0)))).otherwise(c)


def pad_to(c: Column, k: int, pad: Column) -> Column:
    """Exactly k elements: cut at the end or filled with `pad`."""
    return F.slice(F.concat(c, F.array_repeat(pad, F.greatest(F.lit(k) - F.size(c), F.lit(0)))), 1, k)


def tail(c: Column, k: int) -> Column:
    return F.slice(c, F.greatest(F.size(c) - k + 1, F.lit(1)), k)


def last_element(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.get(c, F.size(c) - 1)


def halves(c: str | Column) -> tuple[Column, Column]:
    """First floor(n/2) elements and the rest."""
    c = F.col(c) if isinstance(c, str) else c
    mid = F.floor(F.size(c) / 2).cast("int")
    return F.slice(c, 1, mid), F.slice(c, mid + 1, F.size(c))


def list_mode(c: Column) -> Column:
    """Most frequent element, ties to the smallest: one pass over the sorted list."""
    null = F.get(F.filter(c, lambda x: F.lit(False)), F.lit(0))
    start = F.struct(null.alias("cur"), F.lit(0).alias("n"), null.alias("best"), F.lit(0).alias("m"))

    def step(a, x):
        n = F.when(x.eqNullSafe(a["cur"]), a["n"] + 1).otherwise(1)
        better = n > a["m"]
        return F.struct(x.alias("cur"), n.alias("n"), F.when(better, x).otherwise(a["best"]).alias("best"), F.greatest(n, a["m"]).alias("m"))

    return F.aggregate(F.sort_array(c), start, step, lambda a: a["best"])
