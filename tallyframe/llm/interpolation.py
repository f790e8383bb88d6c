"""Language-model scores by deleted interpolation.

The probability of a token is a mixture of maximum-likelihood estimates of n-grams of every order
down to single tokens and the uniform distribution. The mixture weights depend on how often the longest
context was seen (powers of two) and are learned by expectation-maximisation: a tenth of the
training texts is held out, the estimates are taken from the others, and the weights maximise
the likelihood of the held-out tokens. Scores use the estimates of all training texts.

How it runs. Texts are read in blocks of about `BLOCK` bytes. A block asks for the counts of its
distinct n-grams: one sorted array of hashes, with the block's own counts, per bucket of the hash range. The
task of a bucket adds the counts of all blocks and answers every block in the order of its question, and the
block then holds all counts its tokens need. The tokens themselves are not kept meanwhile but read again;
a stamp on questions and blocks fails the job if a block should come back with other rows. So an n-gram travels once per block that holds it,
however often it occurs there, hot words put no more on a task than there are blocks, and count
tables grow with the corpus without ever being in one place. The buckets are as many as the session's
shuffle partitions.

Tokens are compared by 64-bit hashes, longer n-grams by 52 bits; of N distinct ones a share of about
N / 2**52 is mistaken for another. Tokens: words and one end after each text. EM runs on counts of held-out
tokens by context bucket and by estimates rounded to quarter powers of two. Ties do not occur: nothing is ranked.

Defined results: a NULL or empty text is the end token alone; repeated rows count as often as they
occur; a NULL key counts as the empty text in the fold rule of the query; without training text every
probability is uniform over the unknown token; an empty table gives an empty result; columns
beyond the key, the text and the fold are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.text import STEP, U64, flat, gathered, mix, pack, unpack, words
from tallyframe.plans.session import written

BLOCK = 4 << 20
END, START = U64(0x5EED0E4D), U64(0x5EED57A7)
#: The bits of an n-gram's hash that count from two tokens on: 52, so that keys are sent in fewer bytes.
KEPT_BITS = U64(0xFFFFFFFFFFFFF000)
QUARTERS = 4
LOWEST = 40


#: Packed arrays; columns of what travels.
PACKS = pa.list_(pa.binary())
NAMES = ["block", "dev", "bucket", "data", "stamp"]


class Weights(NamedTuple):
    """Mixture weights per context bucket: one row of (uniform, order 1, order 2, ...)."""

    table: np.ndarray


def _levels(tokens: np.ndarray, off: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the 1-grams, 2-grams, ... that end at every token; before a text stand start marks."""
    out, last = [tokens], tokens
    starts = off[:-1]
    for k in range(2, order + 1):
        before = np.empty_like(last)
        before[1:] = last[:-1]
        before[starts] = START + U64(k)
        last = mix(before * STEP + tokens)
        out.append(last & KEPT_BITS)
    return out


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    h, first = words(*flat(batch["text"]))
    n = first.size - 1
    return np.insert(h, first[1:], END), first + np.arange(n + 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(id, held-out, batch): held-out training texts have blocks of their own. Ids repeat when a task does."""
    number = TaskContext.get().partitionId() << 24
    for b in gathered(batches, BLOCK):
        dev = b["part"].to_numpy() == 1
        for flag in (False, True):
            mine = b.filter(pa.array(dev == flag))
            if mine.num_rows:
                yield number, flag, mine
            number += 1


def _gaps(sorted_keys: np.ndarray, level: int) -> tuple[bytes, bytes]:
    """Gaps of sorted keys without the bits that do not count, lower and upper halves packed apart."""
    gaps = np.diff(sorted_keys >> U64(12 if level else 0), prepend=U64(0))
    return pack((gaps & U64(0xFFFFFFFF)).astype(np.uint32)), pack((gaps >> U64(32)).astype(np.uint32))


def _keys(low: bytes, high: bytes, level: int) -> np.ndarray:
    gaps = unpack(low)[0].astype(U64) | unpack(high)[0].astype(U64) << U64(32)
    return np.cumsum(gaps, dtype=U64) << U64(12 if level else 0)


def _stamp(tokens: np.ndarray) -> int:
    """A sum of a block's tokens, by which a block read twice is known to be the same."""
    return int(mix(tokens + np.arange(tokens.size, dtype=U64)).sum(dtype=U64).astype(np.int64))


def _questions(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, dev, b in _blocks(batches):
            tokens, off = _read(b)
            train = np.repeat(b["part"].to_numpy() != 0, np.diff(off)).astype(np.float64)
            parts: list[list[bytes]] = [[] for _ in range(buckets)]
            for k, keys in enumerate(_levels(tokens, off, order)):
                u, inv = np.unique(keys, return_inverse=True)
                c = np.bincount(inv, train).astype(np.uint32)
                cut = np.searchsorted((u >> U64(32)) * U64(buckets) >> U64(32), np.arange(buckets + 1))
                for i in range(buckets):
                    s = slice(cut[i], cut[i + 1])
                    parts[i] += [*_gaps(u[s], k), pack(c[s])]
            yield pa.RecordBatch.from_arrays([pa.array([number] * buckets), pa.array([dev] * buckets), pa.array(range(buckets), pa.int32()), pa.array(parts, PACKS), pa.array([_stamp(tokens)] * buckets)], NAMES)

    return run


def _answers(order: int):
    def finish(bucket: int, asked: list[tuple[int, bool, list, int]]) -> Iterator[pa.RecordBatch]:
        replies: list[list[bytes]] = [[] for _ in asked]
        sums = []
        for k in range(order):
            keys = [_keys(*a[2][3 * k : 3 * k + 2], k) for a in asked]
            own = np.concatenate([unpack(a[2][3 * k + 2])[0] for a in asked]).astype(np.float64)
            for a in asked:
                a[2][3 * k : 3 * k + 3] = [None] * 3
            sizes = np.array([x.size for x in keys])
            key = np.concatenate(keys)
            del keys
            held = own * np.repeat(np.array([a[1] for a in asked], float), sizes)
            u, inv = np.unique(key, return_inverse=True)
            every = np.bincount(inv, own, u.size).astype(np.int64)
            dev = np.bincount(inv, held, u.size).astype(np.int64)
            if k == 0:
                sums = [int(every.sum()), int((every > 0).sum()), int(dev.sum()), int((every > dev).sum())]
            cuts = np.cumsum(sizes)[:-1]
            small = np.uint32 if every.max(initial=0) < 1 << 32 else np.uint64
            for r, a, d, (_, held_out, _, _) in zip(replies, np.split(every.astype(small)[inv], cuts), np.split(dev.astype(small)[inv], cuts), asked):
                r.append(pack(*([a, d] if held_out else [a])))
            del key, own, held, u, inv, every, dev
        n = len(asked)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*(a[0] for a in asked), None], pa.int64()), pa.array([*(a[1] for a in asked), None], pa.bool_()), pa.array([bucket] * (n + 1), pa.int32()), pa.array([*replies, None], PACKS), pa.array([*(a[3] for a in asked), None], pa.int64()), pa.array([*[None] * n, sums], pa.list_(pa.int64()))],
            [*NAMES, "sums"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, []
        for b in batches:
            for number, dev, bucket, data, stamp in zip(*(b[c].to_pylist() for c in NAMES)):
                if bucket != now and asked:
                    yield from finish(now, asked)
                    asked = []
                now = bucket
                asked.append((number, dev, data, stamp))
        if asked:
            yield from finish(now, asked)

    return run


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block needs again when its answers arrive: its tokens as indexes into its vocabulary."""
    for number, dev, b in _blocks(batches):
        tokens, off = _read(b)
        u, inv = np.unique(tokens, return_inverse=True)
        ids = b["key"].fill_null(0).to_numpy()
        data = pack(np.diff(u, prepend=U64(0)), inv.astype(np.uint32), off, ids, b["key"].is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), b["part"].to_numpy().astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([dev]), pa.array([-1], pa.int32()), pa.array([[data]], PACKS), pa.array([_stamp(tokens)])], NAMES)


def _joined(order: int, use, held_out: bool):
    """Feed `use` with a block's state arrays, offsets and, level by level, the counts of its tokens' n-grams.

    Blocks of held-out texts are told the held-out counts besides; with `held_out`, these are taken off.
    """

    def finish(rows: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        state = unpack(rows[0][0])
        u, inv, off = np.cumsum(state[0], dtype=U64), state[1], state[2]
        counts, levels = [], _levels(u[inv], off, order)
        for k in range(order):
            at = inv if k == 0 else np.unique(levels[k], return_inverse=True)[1]
            replies = [unpack(r[k]) for r in rows[1:]]
            for r in rows[1:]:
                r[k] = None
            levels[k] = None
            told = np.concatenate([r[0] for r in replies])
            if held_out:
                told = told - np.concatenate([r[1] for r in replies])
            counts.append(told[at])
        rows.clear()
        yield from use(state, off, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stamp, rows = None, None, []
        for b in batches:
            for number, data, mark in zip(*(b[c].to_pylist() for c in ("block", "data", "stamp"))):
                if number != now and rows:
                    yield from finish(rows)
                    rows = []
                if number == now and mark != stamp:
                    raise RuntimeError("a block was read with other rows than before; write the input to a table first")
                now, stamp = number, mark
                rows.append(data)
        if rows:
            yield from finish(rows)

    return run


def _estimates(counts: list[np.ndarray], off: np.ndarray, total: float, kinds: float) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the longest context's frequency, and the estimates (uniform, order 1, ...) of every token."""
    starts, ends = off[:-1], off[1:] - 1
    p = np.zeros((len(counts) + 1, counts[0].size))
    p[0] = 1 / (kinds + 1)
    p[1] = counts[0] / max(1.0, total)
    context = np.full(counts[0].size, float(total))
    for k in range(1, len(counts)):
        context = np.empty(counts[0].size)
        context[1:] = counts[k - 1][:-1]
        # A start mark precedes every training text, as often as the end token follows one.
        context[starts] = counts[0][ends]
        p[k + 1] = np.divide(counts[k], context, out=np.zeros_like(context), where=context > 0)
    return np.minimum(np.floor(np.log2(context + 1)), 63).astype(np.int64), p


def _grid(order: int, total: int, kinds: int):
    """Held-out tokens counted by context bucket and by each estimate in quarter powers of two."""

    def use(state, off, counts) -> Iterator[pa.RecordBatch]:
        bucket, p = _estimates(counts, off, total, kinds)
        cells = [bucket]
        for row in p[1:]:
            with np.errstate(divide="ignore"):
                q = np.floor(QUARTERS * np.log2(row))
            cells.append(np.where(row > 0, np.maximum(q, -QUARTERS * LOWEST), 1).astype(np.int64))
        held, n = np.unique(np.stack(cells), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(held.T.tolist(), pa.list_(pa.int64())), pa.array(n)], ["cell", "n"])

    return _joined(order, use, True)


def expectation_maximisation(cells: np.ndarray, n: np.ndarray, uniform: float, rounds: int = 100) -> Weights:
    """Weights per context bucket that maximise the held-out likelihood; buckets without tokens take the next lower one's."""
    order = cells.shape[1] - 1
    p = np.where(cells[:, 1:] <= 0, 2.0 ** ((cells[:, 1:] + 0.5) / QUARTERS), 0.0)
    p = np.concatenate([np.full((n.size, 1), uniform), np.minimum(p, 1.0)], 1)
    table = np.zeros((64, order + 1))
    before = np.full(order + 1, 1 / (order + 1))
    for b in range(64):
        mine = cells[:, 0] == b
        w = np.full(order + 1, 1 / (order + 1))
        if mine.any():
            q, m = p[mine], n[mine] / n[mine].sum()
            for _ in range(rounds):
                share = q * w
                share /= share.sum(1, keepdims=True)
                new = m @ share
                if np.abs(new - w).max() < 1e-9:
                    break
                w = new
            w = np.maximum(w, 1e-6)
            before = w / w.sum()
        table[b] = before
    return Weights(table)


def _scores(order: int, total: int, kinds: int, weights: Weights):
    def use(state, off, counts) -> Iterator[pa.RecordBatch]:
        bucket, p = _estimates(counts, off, total, kinds)
        mixed = np.zeros(p.shape[1])
        for k, row in enumerate(p):
            mixed += row * weights.table[bucket, k]
        del p
        base = np.log10((counts[0] + 0.1) / (total + 0.1 * (kinds + 1)))
        add = lambda x: np.add.reduceat(x, off[:-1])
        n = off.size - 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(state[3], pa.int64(), mask=state[4] == 0),
                pa.array(state[5].astype(np.int32)),
                pa.array(np.diff(off)),
                pa.array(add((counts[0] > 0).astype(np.int64))),
                pa.array(np.full(n, total, np.int64)),
                pa.array(add(base)),
                pa.array(add(np.log10(mixed))),
            ],
            ["key", "part", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return _joined(order, use, False)


def score(docs: DataFrame, part: Column, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """Score every text. `part` is 0 for texts to learn nothing from, 1 for training texts that the
    weights are learned on, anything else for the other training texts.

    Returns `key`, `part`, n_tokens, n_known, train_tokens, base_score (add-0.1 unigram) and score,
    both log10 probabilities of the whole text.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), part.cast("int").alias("part"))
    form = "block long, dev boolean, bucket int, data array<binary>, stamp long"
    states = rows.mapInArrow(_states, form)
    asked = rows.mapInArrow(_questions(order, buckets), form).repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    told = written(asked.mapInArrow(_answers(order), f"{form}, sums array<long>"))
    sums = told.where("block is null").agg(*[F.coalesce(F.sum(F.get("sums", F.lit(i))), F.lit(0)) for i in range(4)]).first()
    total, kinds, dev_total, rest_kinds = (int(x) for x in sums)
    both = states.unionByName(told.where("block is not null").select(*NAMES))

    def by_block(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "block").sortWithinPartitions("block", "bucket")

    grid = by_block(both.where("dev")).mapInArrow(_grid(order, total - dev_total, rest_kinds), "cell array<long>, n long")
    seen = grid.groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.array([r["cell"] for r in seen], np.int64).reshape(len(seen), order + 1)
    weights = expectation_maximisation(cells, np.array([r["n"] for r in seen], np.float64), 1 / (rest_kinds + 1))
    out = by_block(both).mapInArrow(_scores(order, total, kinds, weights), "key long, part int, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("key", key)
