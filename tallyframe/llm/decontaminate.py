"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed pattern of kept and ignored word positions. Every window of a benchmark item and
of a text is hashed under each mask from its kept words only, so a window still matches when words at
ignored positions were substituted. Equal hashes place the item beside the text on one diagonal;
there all words are compared. Every segment in which at least four of five words agree, and which is
part of no longer such segment, is returned if it has `MIN_WORDS` words, or all words of a shorter item.

The masks hit any 13 to 25 aligned words of which up to a fifth is substituted (a test tries all cases).
A longer segment has a part of 13 to 25 words of which no larger share is substituted. Items of 5 to 12
words have further masks by length (`SHORT`), as far as the benchmark has such items; items under 5
words are ignored.

Defined results: NULL and empty texts and items match nothing; equal items count as one, named by
the smallest item id; every row is answered by itself, so repeated rows repeat their answer; texts of
any length are read whole; an empty table gives an empty result and an empty benchmark no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.text import STEP, U64, flat, mix, owners, ranges, slices, words

MASKS = ("11010010101", "110101101", "11100111", "110100011001")
#: Further masks for items of (from, to) words.
SHORT = {(5, 7): ("1111", "11011", "11101", "10111"), (8, 9): ("11111",), (10, 12): ("110111", "111101")}
MIN_WORDS = 13
SHORTEST = 5
PIECE = 1 << 19
HIT = "array<struct<item_id:bigint,text_start:int,text_end:int,item_start:int,n_equal:int>>"


class Seeds(NamedTuple):
    """Items as word hashes, and the sorted window hashes of all masks with their positions."""

    ids: np.ndarray
    words: np.ndarray
    off: np.ndarray
    keys: np.ndarray
    at: np.ndarray
    masks: tuple[str, ...]


def windows(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the kept words of every window of the mask's width."""
    n = h.size - len(mask) + 1
    if n < 1:
        return np.zeros(0, U64)
    out = np.full(n, U64(int(mask, 2) * 64 + len(mask)), U64)
    for j, c in enumerate(mask):
        if c == "1":
            out = out * STEP + h[j : j + n]
    return mix(out)


def alike(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of every segment of `least` entries or more in which four of five hold, without those inside a longer one."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -4))])
    low = np.minimum.accumulate(total)
    start = np.searchsorted(-low, -total)  # the first place that is no higher than each end
    later = np.append(np.minimum.accumulate(start[::-1])[::-1][1:], total.size)
    end = np.flatnonzero((start < later) & (np.arange(total.size) - start >= least))
    return list(zip(start[end].tolist(), end.tolist()))


def build(ids: list[int], texts: list[str]) -> Seeds:
    h, off = words(*flat(pa.array(texts, pa.large_string())))
    lens = np.diff(off)
    short = {m: span for span, ms in SHORT.items() if ((lens >= span[0]) & (lens <= span[1])).any() for m in ms}
    keys, at = [], []
    for mask in (*MASKS, *short):
        pos, run = owners(off, len(mask))
        lo, hi = short.get(mask, (SHORTEST, h.size))
        pos = pos[(lens[run] >= lo) & (lens[run] <= hi)]
        keys.append(windows(h, mask)[pos])
        at.append(pos)
    key, pos = np.concatenate(keys), np.concatenate(at)
    order = np.argsort(key, kind="stable")
    return Seeds(np.array(ids, np.int64), h, off, key[order], pos[order], (*MASKS, *short))


def matcher(seeds: Seeds):
    """A function from texts (bytes, offsets) to (text index, item, text start, text end, item start, equal words)."""
    seen = np.zeros(1 << 22, bool)
    seen[(seeds.keys >> U64(42)).astype(np.int64)] = True
    item_of = np.repeat(np.arange(seeds.ids.size), np.diff(seeds.off))

    def match(data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        h, first = words(data, off)
        found = []
        for mask in seeds.masks:
            for start in range(0, h.size, PIECE):
                g = windows(h[start : start + PIECE + len(mask) - 1], mask)
                near = np.flatnonzero(seen[(g >> U64(42)).astype(np.int64)])
                lo, hi = np.searchsorted(seeds.keys, g[near], "left"), np.searchsorted(seeds.keys, g[near], "right")
                n = hi - lo
                pos = np.repeat(near + start, n)
                hit = seeds.at[ranges(lo, n)]
                run = np.searchsorted(first, pos, "right") - 1
                ok = pos + len(mask) <= first[run + 1]
                pos, hit, run = pos[ok], hit[ok], run[ok]
                item = item_of[hit]
                found.append(np.stack([run, item, pos - (hit - seeds.off[item])]))
        if not found or not sum(f.shape[1] for f in found):
            return []
        run, item, diagonal = np.unique(np.concatenate(found, 1), axis=1)
        n = np.diff(seeds.off)[item]
        out = []
        # All words of a short item have to lie in the text; they are compared at once.
        whole = np.flatnonzero((n < MIN_WORDS) & (diagonal >= first[run]) & (diagonal + n <= first[run + 1]))
        if whole.size:
            size = n[whole]
            equal = h[ranges(diagonal[whole], size)] == seeds.words[ranges(seeds.off[item[whole]], size)]
            same = np.add.reduceat(equal.astype(np.int64), np.cumsum(size) - size)
            ok = 5 * same >= 4 * size
            begin = (diagonal - first[run])[whole]
            out += [(r, i, b, b + k, 0, e) for r, i, b, k, e in np.stack([run[whole], item[whole], begin, size, same])[:, ok].T.tolist()]
        long = n >= MIN_WORDS
        for r, i, d in np.stack([run, item, diagonal])[:, long].T.tolist():
            a, b = int(seeds.off[i]), int(seeds.off[i + 1])
            lo, hi = max(0, int(first[r]) - d), min(b - a, int(first[r + 1]) - d)
            equal = h[d + lo : d + hi] == seeds.words[a + lo : a + hi]
            at = d + lo - int(first[r])
            out += [(r, i, at + begin, at + end, lo + begin, int(equal[begin:end].sum())) for begin, end in alike(equal, MIN_WORDS)]
        return sorted(out)

    return match


def load(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_words: int = 1_000_000) -> Iterator[Seeds]:
    """Seeds of the benchmark, in blocks of about `block_words` words whatever its size.

    The driver and the tasks hold one block; a benchmark of several blocks is searched block by block.
    """
    items = benchmark.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.min(item).alias("item"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = sorted(((r["item"] if r["item"] is not None else -1, r["text"]) for r in mine.collect()), key=lambda r: (r[0], r[1]))
        yield build([r[0] for r in rows], [r[1] for r in rows])


def overlaps(seeds: Seeds, text: str = "text") -> Column:
    """Array column: the items of one block that a text overlaps, with positions counted in words."""

    @F.arrow_udf(HIT)
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        match = matcher(seeds)
        struct = pa.struct([("item_id", pa.int64()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("item_start", pa.int32()), ("n_equal", pa.int32())])
        for a in arrays:
            out, n = [], 0
            for b in slices(iter([pa.RecordBatch.from_arrays([a], ["text"])]), limit=4 << 20):
                out += [(n + r, int(seeds.ids[i]), s, e, at, k) for r, i, s, e, at, k in match(*flat(b["text"]))]
                n += b.num_rows
            off = np.searchsorted([r[0] for r in out], np.arange(n + 1)) if out else np.zeros(n + 1, np.int64)
            cols = [pa.array([r[j] for r in out], struct.field(j - 1).type) for j in range(1, 6)]
            yield pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays(cols, fields=list(struct)))

    return run(F.col(text))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", name: str = "overlap") -> DataFrame:
    """Append the array column `name` of overlapped items; it is empty for clean texts."""
    out = docs.drop(name)
    for seeds in load(benchmark):
        found = overlaps(seeds, text)
        out = out.withColumn(name, F.concat(F.col(name), found) if name in out.columns else found)
    return out
