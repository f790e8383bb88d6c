"""N-gram Jaccard join by parity sketches.

A text's set holds the hashes of its distinct 5-word shingles. Two sets with Jaccard similarity of
4/5 or more differ in at most a quarter of either set. A parity sketch XORs every shingle into one
cell of a row of cells, so a differing shingle changes one cell: the cells (or single bits) in which
two sketches differ never exceed the sets' symmetric difference.

1. Equal sets become one class, known by the hash of its set; all further steps see classes only.
2. Pigeonhole join. Sets of one size band (powers of two; a set near its band's end also joins the next
   band) share a number of 64-bit cells. As at most a quarter of n cells can differ, classes that
   link agree in a cell among the first n/4 + 1 non-empty ones of any common order; cells of many
   shingles come first, since unrelated texts rarely share those. With `spare(n)` further cells, linked
   classes agree in spare + 1 of the chosen cells at least.
3. Tasks of one bucket of cells see which classes share a cell and report pairs. Where more than
   CROWD classes share a cell, only pairs with the smallest class are reported. Linked classes that
   these steps miss share spare + 1 crowded cells. Such a class is looked up, in step 5, by its crowded cells
   without its `spare` commonest ones (a prefix filter once more), among classes that are still in other
   components. Passages that many texts share thereby fall out, and what is left is compared by its bit
   sketches inside tasks, in tiles. Classes with a near one in another component come back with their
   sets; a tile then verifies pairs of different components only, joins the two when a pair links, and
   so gives fewer links than it has components, however many pairs are near.
4. Bit sketches (one bit per shingle, about two bits a shingle) reject a pair when their Hamming
   distance exceeds (n1 + n2) / 9, the largest symmetric difference of linked sets.
5. Surviving pairs are verified on the exact sets, and the links make the components.

Texts are never shuffled to be compared: a bitmap of hashed keys, a table of bounded size that travels with
the tasks, tells the few texts whose sets are wanted, and their sets are then joined exactly.

Shingles, sets and classes are compared by 64-bit hashes.

Defined results: NULL and empty texts have an empty set and link with nothing; texts of 1 to 4 words
have one shingle, the whole sequence; repeated rows are copies of each other; rows without a key take
part and have a NULL component if no row with a key is reachable; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from tallyframe.llm.components import components, joined
from tallyframe.llm.text import STEP, U64, flat, grams, mix, owners, pack, ranges, release, slices, unpack, words
from tallyframe.plans.session import written

CROWD = 8
#: Classes and shingles of one part of a group that is compared in tiles, and bytes of text in a block.
PART, PART_SHINGLES = 1500, 1 << 20
BLOCK = 4 << 20
#: Bits of a bitmap for every key in it, and of all of it; past the latter it passes more keys that are not in it.
KEY_BITS, MAP_BITS = 16, 1 << 26


def spare(n):
    """Cells kept beyond those that the pigeonhole needs, for numbers and for columns."""
    return n // 8 + 8 if not isinstance(n, Column) else F.floor(n / 8) + 8


def shingles(data: np.ndarray, off: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and n + 1 offsets."""
    h, first = words(data, off)
    pos, run = owners(first, n)
    g = grams(h, n)[pos]
    count = np.diff(first)
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        if few.size:
            g = np.concatenate([g, mix(grams(h, k)[first[few]] + U64(k))])
            run = np.concatenate([run, few])
    order = np.argsort(g)
    order = order[np.argsort(run[order], kind="stable")]
    g, run = g[order], run[order]
    keep = np.append(True, (g[1:] != g[:-1]) | (run[1:] != run[:-1]))[: g.size]
    g, run = g[keep], run[keep]
    return g, np.searchsorted(run, np.arange(off.size))


def set_keys(g: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hash of every set (0 for the empty one)."""
    n = np.diff(off)
    out = np.zeros(n.size, U64)
    full = n > 0
    out[full] = mix(np.add.reduceat(mix(g * STEP), off[:-1][full]) + n[full].astype(U64))
    return out


def bit_sketch(g: np.ndarray) -> bytes:
    """One parity bit per hash value modulo a power of two of at least twice the set's size, 64 at least."""
    bits = max(64, 1 << int(2 * g.size - 1).bit_length())
    odd = np.bincount((g & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two bit sketches; the longer one is folded onto the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if x.size < y.size:
        x, y = y, x
    if x.size > y.size:
        x = np.bitwise_xor.reduce(x.reshape(-1, y.size), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _cells(g: np.ndarray, off: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each set's chosen cells in the given bands, and the set each belongs to."""
    n = np.diff(off)
    run = np.repeat(np.arange(n.size), n)
    cells = np.where(band < 6, np.int64(1 << 32), (0.6 * 2.0 ** (band + 1)).astype(np.int64)).astype(U64)
    m = mix(g)
    cell = ((m >> U64(32)) * cells[run]) >> U64(32)
    at = (run.astype(U64) << U64(32)) | cell
    order = np.argsort(at, kind="stable")
    at, m = at[order], mix(m[order] + STEP)
    head = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: at.size])
    if not head.size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    held = np.diff(np.append(head, at.size))
    own = (at[head] >> U64(32)).astype(np.int64)
    space = np.where(band < 6, 0, band)[own].astype(U64)
    sig = mix(np.bitwise_xor.reduceat(m, head) + (at[head] & U64(0xFFFFFFFF)) * STEP + space)
    rank = ((U64(255) - np.minimum(held, 255).astype(U64)) << U64(56)) | (sig >> U64(8))
    order = np.lexsort((rank, own))
    own, sig = own[order], sig[order]
    start = np.searchsorted(own, np.arange(n.size))
    total = np.diff(np.append(start, own.size))
    want = n // 4 + 1 + spare(n)
    first = np.arange(own.size) - start[own] < want[own]
    sig, mine = sig[first], own[first]
    lacking = np.flatnonzero((total < n // 4 + 1) & (band >= 6) & (n > 0))
    if lacking.size:
        cut = ranges_of(off, lacking)
        extra, who = _cells(g[cut], np.concatenate([[0], np.cumsum(n[lacking])]), np.zeros(lacking.size, np.int64))
        sig, mine = np.concatenate([sig, extra]), np.concatenate([mine, lacking[who]])
    return sig, mine


def ranges_of(off: np.ndarray, which: np.ndarray) -> np.ndarray:
    return ranges(off[which], off[which + 1] - off[which])


def signatures(g: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All cell hashes of the sets, and the set each belongs to."""
    n = np.diff(off)
    band = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    a, ra = _cells(g, off, band)
    near = np.flatnonzero((n >= 0.8 * 2.0 ** (band + 1)) & (band >= 5))
    cut = ranges_of(off, near)
    b, rb = _cells(g[cut], np.concatenate([[0], np.cumsum(n[near])]), band[near] + 1)
    return np.concatenate([a, b]), np.concatenate([ra, near[rb]])


def _map_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text a row (doc, n, key, sketch)."""
    for b in slices(batches, limit=BLOCK):
        release()
        g, off = shingles(*flat(b["text"]))
        n, key = np.diff(off), set_keys(g, off)
        # One row per class and batch carries the sketch.
        sketch = [None] * len(n)
        for i in _leads(n, key):
            sketch[i] = bit_sketch(g[off[i] : off[i + 1]])
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n), pa.array(key.view(np.int64)), pa.array(sketch, pa.binary())], ["doc_id", "n", "key", "sketch"])


def _leads(n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The first text of every class of a batch, without the empty class."""
    _, lead = np.unique(key, return_index=True)
    return lead[n[lead] > 0]


def _map_cells(spark_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per bucket of cells one block of (cell, class)."""
        for b in slices(batches, limit=BLOCK):
            release()
            g, off = shingles(*flat(b["text"]))
            n, key = np.diff(off), set_keys(g, off)
            lead = _leads(n, key)
            sig, own = signatures(g[ranges_of(off, lead)], np.concatenate([[0], np.cumsum(n[lead])]))
            where = (sig % U64(spark_buckets)).astype(np.int32)
            order = np.lexsort((sig, where))
            sig, own, where = sig[order], own[order], where[order]
            buckets, at = np.unique(where, return_index=True)
            blocks = []
            for i, j in zip(at, np.append(at[1:], where.size)):
                who, local = np.unique(own[i:j], return_inverse=True)
                small = local.astype(np.uint16 if who.size < 65536 else np.uint32)
                blocks.append(pack(np.diff(sig[i:j], prepend=U64(0)), small, key[lead[who]]))
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])

    return run


def _join_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by bucket: report pairs of classes and the members of crowded cells."""

    def finish(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        release()
        parts = [unpack(x) for x in blocks]
        sig = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
        key = np.concatenate([p[2][p[1]] for p in parts])
        del parts
        order = np.argsort(sig, kind="stable")
        sig, key = sig[order], key[order]
        # Only cells that occur again matter from here on.
        again = np.zeros(sig.size, bool)
        again[1:] = sig[1:] == sig[:-1]
        again[:-1] |= sig[:-1] == sig[1:]
        sig, key = sig[again], key[again]
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1]))[: sig.size]
        sig, key = sig[new], key[new]
        head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: sig.size])
        size = np.diff(np.append(head, sig.size))
        group = np.repeat(np.arange(head.size), size)
        rank = np.arange(sig.size) - head[group]
        crowd = size[group] > CROWD
        a, b = [key[head[group]][rank > 0]], [key[rank > 0]]
        for step in range(1, CROWD):
            # Pairs `step` apart in a cell that is not crowded; the first member's are there already.
            left = np.flatnonzero(~crowd & (rank >= 1) & (rank + step < size[group]))
            a.append(key[left])
            b.append(key[left + step])
        a, b = np.concatenate(a), np.concatenate(b)
        if a.size:
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            a, b = a[new], b[new]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([a, key[crowd]]).view(np.int64)),
                pa.array(np.concatenate([b, sig[crowd]]).view(np.int64)),
                pa.array(np.concatenate([np.zeros(a.size, bool), np.ones(int(crowd.sum()), bool)])),
            ],
            ["a", "b", "crowded"],
        )

    bucket, blocks = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            at = batch["bucket"][i].as_py()
            if at != bucket and blocks:
                yield from finish(blocks)
                blocks = []
            bucket = at
            blocks.append(batch["block"][i].as_py())
    if blocks:
        yield from finish(blocks)


@F.arrow_udf(BooleanType())
def _near(a: pa.Array, b: pa.Array, n: pa.Array) -> pa.Array:
    return pa.array([9 * hamming(x.as_py(), y.as_py()) <= t.as_py() for x, y, t in zip(a, b, n)], pa.bool_())


@F.arrow_udf(BooleanType())
def _linked(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b):
        p, q = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
        common = np.intersect1d(p, q, assume_unique=True).size
        out.append(100 * common >= 80 * (p.size + q.size - common))
    return pa.array(out, pa.bool_())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, limit=BLOCK):
        g, off = shingles(*flat(b["text"]))
        key = set_keys(g, off)
        _, lead = np.unique(key, return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(key[lead].view(np.int64)), pa.array([g[off[i] : off[i + 1]].tobytes() for i in lead], pa.binary())], ["key", "set"])


def _bitmap(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(word, mask) of a bitmap of the hashed keys (a NULL key has its own hash), and its bits."""
    keys = written(keys.select(key))
    bits = min(MAP_BITS, 1 << (KEY_BITS * keys.count() + 64).bit_length())
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")))
    return written(keys.groupBy(F.floor(at / 64).alias("word")).agg(mask.alias("mask"))), bits


def _held(rows: DataFrame, key: Column, bitmap: tuple[DataFrame, int]) -> DataFrame:
    """`rows` with `held`: false only if the key is not in the bitmap."""
    words_, bits = bitmap
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    both = rows.withColumn("at", at).join(F.broadcast(words_), F.floor(F.col("at") / 64) == F.col("word"), "left")
    return both.withColumn("held", F.coalesce(F.expr("getbit(mask, cast(at % 64 as int))") == 1, F.lit(False)))


def link_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, key) of every text, and the verified (node, root) components of the classes."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = written(rows.mapInArrow(_map_sets, "doc_id long, n long, key long, sketch binary"))
    members = dealt.select("doc_id", "n", "key")
    classes = written(dealt.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"), F.first("sketch", ignorenulls=True).alias("sketch")))
    blocks = rows.mapInArrow(_map_cells(buckets), "bucket int, block binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = written(blocks.mapInArrow(_join_cells, "a long, b long, crowded boolean"))
    left = classes.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def plausible(pairs: DataFrame) -> DataFrame:
        both = pairs.join(left, "a").join(right, "b").where("5 * na >= 4 * nb and 5 * nb >= 4 * na")
        return written(both.where(_near("sa", "sb", F.col("na") + F.col("nb"))).select("a", "b"))

    def sets_of(need: DataFrame) -> DataFrame:
        ids = classes.join(need, "key", "left_semi").select("doc_id")
        mine = _held(rows, F.col("doc_id"), _bitmap(ids, "doc_id")).where("held").select("text").mapInArrow(_sets, "key long, set binary")
        return written(mine.join(need, "key", "left_semi").dropDuplicates(["key"]))

    def verified(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        one = sets.select(F.col("key").alias("b"), F.col("set").alias("y"))
        two = sets.select(F.col("key").alias("a"), F.col("set").alias("x"))
        return written(pairs.join(one, "b").join(two, "a").where(_linked("x", "y")).select("a", "b"))

    roots = written(components(verified(plausible(found.where("not crowded").select("a", "b").distinct()))))
    crowded = found.where("crowded").select(F.col("a").alias("key"), F.col("b").alias("cell")).distinct()
    open_ = written(_open_cells(_needed_cells(crowded, classes), roots))
    if not open_.isEmpty():
        roots = written(joined(roots, written(_compare_open(open_, classes, sets_of))))
    return members, roots


def _compare_open(open_: DataFrame, classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that join the components which meet in open cells, directly or through others."""
    least = open_.groupBy("cell").agg(F.min("root").alias("a"))
    group = components(open_.join(least, "cell").select("a", F.col("root").alias("b")).distinct())
    member = open_.select("key", "root").distinct().join(group.select(F.col("node").alias("root"), F.col("root").alias("group")), "root")
    member = written(member.join(classes.select("key", "n", "sketch"), "key"))
    near = written(_tiles(member).mapInArrow(_near_classes, "key long").distinct())
    some = written(member.join(near, "key", "left_semi"))
    return _tiles(some.join(sets_of(near), "key")).mapInArrow(_tile_links, "a long, b long").distinct()


def _tiles(member: DataFrame) -> DataFrame:
    """Members of a group dealt into parts; every two parts of it meet in one task, as tile (group, i, j)."""
    size = F.greatest(F.count(F.lit(1)) / PART, F.sum("n") / PART_SHINGLES)
    parts = member.groupBy("group").agg(F.ceil(size).cast("int").alias("parts"))
    dealt = member.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = each.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("parts", "other")
    return tiles.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        ids = np.stack([b[c].to_numpy() for c in ("group", "i", "j")], axis=1)
        cut = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        for start, end in zip([0, *cut], [*cut, b.num_rows]) if b.num_rows else ():
            now = tuple(ids[start])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, end - start))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _near_pairs(tile: pa.Table, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a tile whose sizes and sketches allow a link and whose labels differ, every pair once.

    `label` is read anew for every row, so that the caller may join components meanwhile.
    """
    n, part, key = (tile[c].to_numpy() for c in ("n", "part", "key"))
    one = tile["i"][0].as_py() == tile["j"][0].as_py()
    sketch = tile["sketch"].to_pylist()
    size = np.array([len(x) // 8 for x in sketch])

    def table(mine: np.ndarray, words_: int) -> np.ndarray:
        bits = np.stack([np.frombuffer(sketch[r], U64) for r in mine])
        return bits if bits.shape[1] == words_ else np.bitwise_xor.reduce(bits.reshape(mine.size, -1, words_), axis=1)

    for words_ in np.unique(size).tolist():
        mine = np.flatnonzero(size == words_)
        x = table(mine, words_)
        for more in (words_, 2 * words_):
            others = np.flatnonzero(size == more)
            if not others.size:
                continue
            y = x if more == words_ else table(others, words_)
            for c, r in enumerate(mine.tolist()):
                fit = (label[others] != label[r]) & (5 * n[r] >= 4 * n[others]) & (5 * n[others] >= 4 * n[r]) & ((part[others] != part[r]) | one)
                if more == words_:
                    fit &= key[others] > key[r]
                fit = np.flatnonzero(fit)
                near = 9 * np.bitwise_count(y[fit] ^ x[c]).sum(1, dtype=np.int64) <= n[r] + n[others[fit]]
                if near.any():
                    yield r, others[fit[near]]


def _near_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the classes that are near one of another component."""
    for tile in _by_tile(batches):
        seen = np.zeros(tile.num_rows, bool)
        for r, others in _near_pairs(tile, tile["root"].to_numpy()):
            seen[r] = True
            seen[others] = True
        if seen.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(tile["key"].to_numpy()[seen]))], ["key"])


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of a tile, each between two components that no earlier one has joined."""
    for tile in _by_tile(batches):
        sets = [np.frombuffer(x, U64) for x in tile["set"].to_pylist()]
        key, label = tile["key"].to_numpy(), tile["root"].to_numpy().copy()
        a, b = [], []
        for r, others in _near_pairs(tile, label):
            others = others[label[others] != label[r]]
            if not others.size:
                continue
            mine, theirs = sets[r], [sets[o] for o in others.tolist()]
            size = np.array([t.size for t in theirs])
            every = np.concatenate(theirs)
            at = np.minimum(np.searchsorted(mine, every), mine.size - 1)
            common = np.add.reduceat((mine[at] == every).astype(np.int64), np.cumsum(size) - size)
            for o in others[100 * common >= 80 * (mine.size + size - common)].tolist():
                if label[o] != label[r]:
                    a.append(min(key[r], key[o]))
                    b.append(max(key[r], key[o]))
                    label[label == label[o]] = label[r]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _needed_cells(crowded: DataFrame, classes: DataFrame) -> DataFrame:
    """Of each class's crowded cells those that a lost link would need, the rarest ones.

    A partner has four fifths of the shingles at least, hence so many spare cells; sets of under 12
    shingles have no cells to spare.
    """
    often = crowded.groupBy("cell").agg(F.count(F.lit(1)).alias("often"))
    shared = F.when(F.col("n") < 12, 1).otherwise(F.least(spare(F.floor(F.col("n") * 4 / 5)) + 1, F.col("n") - F.floor(F.col("n") / 4)))
    many = crowded.groupBy("key").agg(F.count(F.lit(1)).alias("many")).join(classes.select("key", "n"), "key")
    unsure = many.select("key", (F.col("many") - shared + 1).alias("keep")).where("keep > 0")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("often", "cell"))
    return crowded.join(unsure, "key").join(often, "cell").withColumn("rank", rank).where("rank <= keep").select("key", "cell")


def _open_cells(crowded: DataFrame, roots: DataFrame) -> DataFrame:
    """(cell, key, root) of the crowded cells whose classes lie in several components."""
    named = crowded.join(roots.withColumnRenamed("node", "key"), "key", "left").select("cell", "key", F.coalesce("root", "key").alias("root"))
    mixed = named.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("cell")
    return named.join(mixed, "cell", "left_semi")


@F.arrow_udf(LongType())
def _class_key(text: pa.Array) -> pa.Array:
    out = [np.zeros(0, U64)]
    for b in slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), limit=BLOCK):
        release()
        out.append(set_keys(*shingles(*flat(b["text"]))))
    return pa.array(np.concatenate(out).view(np.int64))


def class_key(text: Column) -> Column:
    """Hash of a text's shingle set; 0 for the empty set. No filter on it is pushed below it, which would make it twice."""
    return _class_key.asNondeterministic()(text)


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, key, low, root) of every text with words: its class, the class's smallest doc_id, its component."""
    members, roots = link_classes(docs, key, text)
    own = members.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low"))
    named = written(own.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "low", F.coalesce("root", "key").alias("root")))
    return members.join(named, "key", "left")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest key reachable by links, itself included."""
    rows = grouped(docs, key, text)
    lowest = rows.where("n > 0").groupBy(F.col("root")).agg(F.min("low").alias("component_id"))
    some = rows.where("n > 0").join(lowest, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every component: the one with the smallest key (of equal ones the smallest class).

    Texts without words belong to no component and stay.
    """
    rows = grouped(docs, key, text)
    best = rows.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("r"))
    one = best.select("root", F.col("r.doc_id").alias("_id"), F.col("r.key").alias("_key"))
    stays = (F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    # A key whose only row stays, or whose texts all lack words, is settled without its text.
    told = rows.join(one, "root", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("n"), F.min(stays).alias("stays"))
    bitmap = _bitmap(told.where("not (n = 0 or (rows = 1 and stays))"), "doc_id")
    best = one.select("_id", "_key").unionByName(rows.where("n = 0").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct())
    best = _held(best, F.col("_id"), bitmap).where("held").select("_id", "_key")
    twice = not rows.where("n > 0").groupBy("doc_id", "key").count().where("count > 1").isEmpty()
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    dealt = _held(docs.select(own, F.col(f"`{key}`").cast("long").alias("_doc")), F.col("_doc"), bitmap)
    marked = dealt.where("held").select("row", "_doc", class_key(F.col(f"row.`{text}`")).alias("_class"))
    out = marked.join(best, marked["_doc"].eqNullSafe(best["_id"]) & (marked["_class"] == best["_key"]), "left_semi")
    if twice:
        empty = out.where("_class = 0")
        out = out.where("_class <> 0").dropDuplicates(["_doc", "_class"]).unionByName(empty)
    return out.select("row").unionByName(dealt.where("not held").select("row")).select("row.*")
