"""Removal of repeated 400-byte strings with suffix arrays built by two-stage sorting.

A byte goes when it is covered by a string of `LENGTH` bytes that also starts anywhere else in the
corpus, the same text included; strings lie within one text and are judged on the input.

1. Every window of LENGTH bytes names its anchor, the 64-byte gram with the smallest hash in it (the
   leftmost of equal ones). Equal windows name equal anchors, so all comparisons happen among windows
   of one anchor. Neighbouring windows with the same anchor occurrence form one segment, so a text
   has one segment for about 170 bytes.
2. Segments are counted by content. All windows of a segment that occurs twice are repeated; this
   settles copies and the inside of passages without looking at the bytes again.
3. What is left are segments that occur once beside other segments of their anchor: the borders of
   repeated passages. Their bytes are fetched, and per anchor a suffix array is built: suffixes
   smaller than their successors are sorted directly, the others are induced by scanning the buckets
   of the first byte, and adjacent common prefixes of LENGTH bytes or more mark repeated windows.
4. An anchor with more than CROWD different segments would be too much for one task. Its windows are
   compared by hash instead, spread over buckets; the result is the same.

Anchors, segments and texts are compared by 64-bit hashes (two of them together for segments).

Defined results: NULL counts as empty; texts shorter than LENGTH keep everything; of repeated rows each
is elsewhere to the other, so all their bytes go; texts of any length are read in pieces that overlap by
LENGTH - 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tallyframe.llm.text import STEP, U64, flat, gathered, mix, pack, ranges, slices, unpack
from tallyframe.plans.session import written

LENGTH, GRAM = 400, 64
PIECE = 1 << 21
CROWD = 512
CODES = mix((np.arange(256, dtype=np.uint64) + U64(11)) * STEP)


def rolling(data: np.ndarray, widths: tuple[int, ...]) -> np.ndarray:
    """Hash of the sum(widths) bytes from every position; widths are falling powers of two."""
    power, level, at = {}, CODES[data], 1
    while True:
        if at in widths:
            power[at] = level
        if at == widths[0]:
            break
        m = mix(np.array([at], U64) + STEP)
        level = level[: level.size - at] * m + level[at:]
        at *= 2
    total = sum(widths)
    n = max(0, data.size - total + 1)
    out, off = np.zeros(n, U64), 0
    for w in widths:
        out = out * STEP + power[w][off : off + n]
        off += w
    return mix(out)


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    n = x.size - width + 1
    padded = np.concatenate([x, np.full(-x.size % width, ~U64(0), U64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start in the bytes, length, anchor hash) of every segment of the texts."""
    if data.size < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, U64),)
    h = rolling(data, (GRAM,))
    at = np.arange(h.size, dtype=np.uint64)
    ends = np.repeat(off[1:], np.diff(off))[: h.size]
    low = (h & ~U64(0xFFFFFF)) | at
    low[at.astype(np.int64) + GRAM > ends] = ~U64(0)
    best = _window_minimum(low, LENGTH - GRAM + 1)
    start = np.flatnonzero(np.arange(best.size) + LENGTH <= ends[: best.size])
    chosen = (best[start] & U64(0xFFFFFF)).astype(np.int64)
    new = np.append(True, (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1))[: start.size]
    first = np.flatnonzero(new)
    last = np.append(first[1:], start.size) - 1
    s = start[first]
    return np.searchsorted(off, s, "right") - 1, s, start[last] + LENGTH - s, h[chosen[first]]


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets, row numbers and each part's place in its text; a long text comes in overlapping parts."""
    data, off = flat(b["text"])
    if off.size == 2 and data.size > 2 * PIECE:
        for at in range(0, data.size - LENGTH + 1, PIECE):
            part = data[at : at + PIECE + LENGTH - 1]
            yield part, np.array([0, part.size]), np.zeros(1, np.int64), np.array([at])
    else:
        yield data, off, np.arange(off.size - 1), np.zeros(off.size - 1, np.int64)


def _list_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, limit=PIECE):
        ref = b["t"].to_numpy()
        for data, off, row, base in _pieces(b):
            text, s, n, h = segments(data, off)
            view = memoryview(np.ascontiguousarray(data))
            told = b"".join(hashlib.blake2b(view[i : i + k], digest_size=8).digest() for i, k in zip(s.tolist(), n.tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(np.frombuffer(told, np.int64)), pa.array(ref[row[text]]), pa.array(base[text] + s - off[text]), pa.array(n.astype(np.int32))],
                ["h", "s", "t", "at", "n"],
            )


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `text` (bytes, 0 as separator) sorted by their next `depth` bytes, by two-stage sorting."""
    n = text.size
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = 1
    turn = np.where(step != 0, np.arange(n), n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    direct = step[turn] > 0  # smaller than its successor
    b = _direct_sort(text, np.flatnonzero(direct), depth)
    first = text[b]
    cuts = np.searchsorted(first, np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~direct[before]]
        c = text[before]
        order = np.argsort(c, kind="stable")
        before, c = before[order], c[order]
        heads = np.flatnonzero(np.append(True, c[1:] != c[:-1])[: c.size])
        for i, j in zip(heads, np.append(heads[1:], c.size)):
            fronts[c[i]].append(before[i:j])

    out = []
    for c in range(256):
        done = 0
        while done < len(fronts[c]):
            done += 1
            induce(fronts[c][done - 1])
        mine = b[cuts[c] : cuts[c + 1]]
        induce(mine)
        out += [*fronts[c], mine]
    return np.concatenate(out)


def _direct_sort(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Sort positions by their next `depth` bytes: eight bytes a round among those still equal.

    A group whose members agree in the next 64 bytes skips them.
    """
    padded = np.concatenate([text, np.zeros(depth + 2 * GRAM, np.uint8)])
    eights = np.ndarray(padded.size - 7, ">u8", padded.tobytes(), strides=(1,))
    ahead = rolling(padded, (GRAM,))
    at = at[np.argsort(eights[at].astype(U64), kind="stable")]
    key = eights[at].astype(U64)
    head = np.append(True, key[1:] != key[:-1])[: at.size]
    seen = np.full(at.size, 8)
    while True:
        group = np.cumsum(head) - 1
        size = np.bincount(group, minlength=1)
        todo = np.flatnonzero((size[group] > 1) & (seen < depth))
        if not todo.size:
            return at
        g, d = group[todo], seen[todo]
        lead = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        of = np.repeat(np.arange(lead.size), np.diff(np.append(lead, g.size)))
        look = ahead[at[todo] + d]
        same = np.bincount(of, look != look[lead[of]], lead.size) == 0
        seen[todo[same[of]]] += GRAM
        rest = todo[~same[of]]
        if rest.size:
            g, d = group[rest], seen[rest]
            k = eights[at[rest] + d].astype(U64)
            order = np.lexsort((k, g))
            at[rest] = at[rest][order]
            g, k = g[order], k[order]
            head[rest[1:]] |= (k[1:] != k[:-1]) & (g[1:] == g[:-1])
            seen[rest] = seen[rest] + 8


def repeated_starts(parts: list[bytes]) -> list[np.ndarray]:
    """For strings of bytes: the starts of windows of LENGTH bytes that start anywhere else among them."""
    sizes = np.array([len(p) + 1 for p in parts])
    joined = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    off = np.concatenate([[0], np.cumsum(sizes)])
    # Text bytes move up by one, so that 0 only separates; 0xFF does not occur in UTF-8.
    text = np.where(np.isin(np.arange(joined.size), off[1:] - 1), 0, np.minimum(joined, 254) + 1).astype(np.uint8)
    left = np.repeat(off[1:], sizes) - 1 - np.arange(joined.size)
    sa = suffix_array(text, LENGTH)
    sa = sa[left[sa] >= LENGTH]
    equal = np.zeros(sa.size, bool)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eights = np.ndarray(text.size, "<u8", padded.tobytes(), strides=(1,))
    pair = np.arange(1, sa.size)
    for d in range(0, LENGTH, 8):  # adjacent common prefixes, eight bytes at a time
        pair = pair[eights[sa[pair] + d] == eights[sa[pair - 1] + d]]
    equal[pair] = True
    equal[pair - 1] = True
    hit = np.sort(sa[equal])
    return [hit[a:b] - o for a, b, o in zip(np.searchsorted(hit, off[:-1]), np.searchsorted(hit, off[1:]), off[:-1])]


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Covered ranges of sorted window starts."""
    new = np.flatnonzero(np.append(True, starts[1:] > starts[:-1] + LENGTH)[: starts.size])
    last = np.append(new[1:], starts.size) - 1
    return starts[new], starts[last] + LENGTH


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    form = pa.schema([("h", pa.int64()), ("s", pa.int64()), ("t", pa.int64()), ("at", pa.int64()), ("single", pa.bool_()), ("crowded", pa.bool_()), ("bytes", pa.binary())])
    done: set[int] = set()
    for b in slices(batches, limit=4 << 20):
        rows = []
        for i, (t, wanted) in enumerate(zip(b["t"].to_pylist(), b["wanted"].to_pylist())):
            if t in done:
                continue
            if len(done) < 100_000:
                done.add(t)
            body = b["text"][i].as_buffer().to_pybytes()
            rows += [(w["h"], w["s"], t, w["at"], w["single"], w["crowded"], body[w["at"] : w["at"] + w["n"]]) for w in wanted]
        yield pa.RecordBatch.from_pylist([dict(zip(form.names, r)) for r in rows], form)


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and segment: covered ranges of the segments that occur once."""

    def finish(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = []
        for (_, _, t, at, single, _), starts in zip(rows, repeated_starts([r[5] for r in rows])):
            if single and starts.size:
                found += [(t, at + int(a), at + int(b)) for a, b in zip(*_runs(starts))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], ["t", "lo", "hi"])

    rows, size, last = [], 0, None
    for b in batches:
        for r in zip(*(b[c].to_pylist() for c in ("h", "s", "t", "at", "single", "bytes"))):
            if r[:2] == last:
                continue
            if size > 1 << 19 and r[0] != last[0]:
                yield from finish(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[5])
            last = r[:2]
    if rows:
        yield from finish(rows)


def _ask_windows(buckets: int):
    """Blocks of crowded segments: one row with the segments, and per bucket the sorted window hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for b in gathered(batches, 4 << 20, "bytes"):
            col = b["bytes"]
            off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
            data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]]
            off = off - off[0]
            h = rolling(data, (256, 128, 16))
            pos = ranges(off[:-1], np.diff(off) - LENGTH + 1)
            h = h[pos]
            order = np.argsort(h)
            h, pos = h[order], pos[order]
            cut = np.searchsorted((h >> U64(32)) * U64(buckets) >> U64(32), np.arange(buckets + 1))
            state = pack(b["t"].to_numpy(), b["at"].to_numpy(), off, b["single"].to_numpy(zero_copy_only=False).astype(np.uint8))
            data = [state, *(pack(np.diff(h[i:j], prepend=U64(0)), pos[i:j].astype(np.uint32)) for i, j in zip(cut[:-1], cut[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array([number] * (buckets + 1)), pa.array([-1, *range(buckets)], pa.int32()), pa.array(data, pa.binary())], ["block", "bucket", "data"])
            number += 1

    return run


def _answer_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def finish(asked: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(d) for _, d in asked]
        h = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
        _, inv, count = np.unique(h, return_inverse=True, return_counts=True)
        twice = np.split(count[inv] > 1, np.cumsum([p[0].size for p in parts])[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([a[0] for a in asked]), pa.array([0] * len(asked), pa.int32()), pa.array([pack(np.sort(p[1][k])) for p, k in zip(parts, twice)], pa.binary())], ["block", "bucket", "data"])

    now, asked = None, []
    for b in batches:
        for block, bucket, data in zip(*(b[c].to_pylist() for c in ("block", "bucket", "data"))):
            if bucket != now and asked:
                yield from finish(asked)
                asked = []
            now = bucket
            asked.append((block, data))
    if asked:
        yield from finish(asked)


def _apply_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def finish(rows: list[bytes]) -> Iterator[pa.RecordBatch]:
        t, at, off, single = unpack(rows[0])
        hit = np.sort(np.concatenate([unpack(r)[0] for r in rows[1:]])).astype(np.int64)
        found = []
        for i in np.flatnonzero(single):
            mine = hit[np.searchsorted(hit, off[i]) : np.searchsorted(hit, off[i + 1])] - off[i]
            if mine.size:
                found += [(int(t[i]), int(at[i] + a), int(at[i] + b)) for a, b in zip(*_runs(mine))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], ["t", "lo", "hi"])

    now, rows = None, []
    for b in batches:
        for block, data in zip(b["block"].to_pylist(), b["data"].to_pylist()):
            if block != now and rows:
                yield from finish(rows)
                rows = []
            now = block
            rows.append(data)
    if rows:
        yield from finish(rows)


def covered(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts with their hash `t`, ranges (t, lo, hi) that are covered by repeated windows)."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.withColumn("t", F.xxhash64(body, F.octet_length(body))).withColumn("text", body)
    long_ = texts.select("t", "text").where(F.octet_length("text") >= LENGTH)
    listed = written(long_.mapInArrow(_list_segments, "h long, s long, t long, at long, n int"))
    kinds = written(listed.groupBy("h", "s").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("t", "at", "n")).alias("r")))
    copies = listed.join(kinds.where("c > 1").select("h", "s"), ["h", "s"], "left_semi").select("t", F.col("at").alias("lo"), (F.col("at") + F.col("n")).alias("hi"))
    anchors = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.min("c").alias("least")).where("kinds > 1 and least = 1")
    wanted = kinds.join(anchors, "h").select("h", "s", "r.*", (F.col("c") == 1).alias("single"), (F.col("kinds") > CROWD).alias("crowded"))
    by_text = wanted.groupBy("t").agg(F.collect_list(F.struct("h", "s", "at", "n", "single", "crowded")).alias("wanted"))
    cut = written(long_.join(by_text, "t").mapInArrow(_cut, "h long, s long, t long, at long, single boolean, crowded boolean, bytes binary"))
    few = cut.where("not crowded").repartition(buckets, "h").sortWithinPartitions("h", "s")
    borders = written(few.mapInArrow(_sort_groups, "t long, lo long, hi long"))
    asked = cut.where("crowded").dropDuplicates(["h", "s"]).mapInArrow(_ask_windows(buckets), "block long, bucket int, data binary")
    asked = written(asked)
    told = asked.where("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer_windows, "block long, bucket int, data binary")
    both = asked.where("bucket < 0").unionByName(told).repartition(buckets, "block").sortWithinPartitions("block", "bucket")
    crowded = both.mapInArrow(_apply_windows, "t long, lo long, hi long")
    return texts, copies.unionByName(borders).unionByName(crowded)


@F.arrow_udf(StructType([*(StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")), StructField("kept", BinaryType())]))
def _remove(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for body, mine in zip(text, spans):
        data = np.frombuffer(body.as_buffer(), np.uint8)
        edge = np.zeros(data.size + 1, np.int64)
        if mine.is_valid and len(mine):
            lo, hi = mine.values.field("lo").to_numpy(), mine.values.field("hi").to_numpy()
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi, -1)
        gone = np.cumsum(edge[:-1]) > 0
        runs = int((gone & ~np.append(False, gone[:-1])[: gone.size]).sum())
        out.append({"n_bytes": data.size, "n_removed": int(gone.sum()), "n_spans": runs, "kept": data[~gone].tobytes()})
    return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, n_bytes, n_removed, n_spans, kept): `kept` holds the remaining bytes in order."""
    texts, found = covered(docs.select(key, text), text)
    spans = found.groupBy("t").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return texts.join(spans, "t", "left").select(key, _remove("text", "spans").alias("r")).select(key, "r.*")
