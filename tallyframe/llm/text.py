"""Vectorised text work shared by the operators: batches, words, n-grams, packed arrays.

Everything here runs inside Spark tasks on one Arrow batch at a time. A word is a maximal run of
bytes outside space and 0x09-0x0D, A-Z lower-cased; words never cross texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 steps)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


STEP = U64(0x9E3779B97F4A7C15)
KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], U64)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its texts; NULL counts as empty."""
    col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Give back what earlier blocks have freed; Python workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; others return memory by themselves
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one hold at most `limit` bytes; a longer text stands alone."""
    for b in batches:
        if not b.num_rows:
            continue
        off = flat(b.column(b.schema.get_field_index(column)))[1]
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield b.slice(at, to - at)
            at = to


def words(data: np.ndarray, off: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and for each text the index of its first word (n + 1 entries).

    Works through whole texts in blocks of about `block` bytes, which stay in the processor's cache.
    """
    hashes, firsts, at, seen = [], [], 0, 0
    n = off.size - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + block, "right")) - 1)
        h, first = _words(data[off[at] : off[to]], off[at : to + 1] - off[at])
        hashes.append(h)
        firsts.append(first[:-1] + seen)
        seen += h.size
        at = to
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), np.concatenate([*firsts, [seen]]).astype(np.int64)


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = off[:-1][off[:-1] < data.size]
    first[heads] = inside[heads]
    ends = off[1:][off[1:] > 0] - 1
    last[ends] = inside[ends]
    at = np.flatnonzero(first)
    left = np.flatnonzero(last) - at + 1
    eights = np.ndarray(data.size, "<u8", np.concatenate([LOWER[data], np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    h = mix((eights[at] & KEEP[np.minimum(left, 8)]) + left.astype(U64) * STEP)
    more = np.flatnonzero(left > 8)
    done = 8
    while more.size:
        rest = left[more] - done
        h[more] = mix(h[more] * STEP + (eights[at[more] + done] & KEEP[np.minimum(rest, 8)]))
        more = more[rest > 8]
        done += 8
    return h, np.searchsorted(at, off)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n items from every position (positions too near the end are left out)."""
    if h.size < n:
        return np.zeros(0, U64)
    out = h[: h.size - n + 1].copy()
    for j in range(1, n):
        out = out * STEP + h[j : h.size - n + 1 + j]
    return mix(out)


def owners(off: np.ndarray, n: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For runs given by offsets: positions that start an n-item window inside a run, and their run."""
    lens = np.diff(off)
    run = np.repeat(np.arange(lens.size), lens)
    if n == 1:
        return np.arange(run.size), run
    ok = np.arange(run.size) + n <= off[1:][run]
    return np.flatnonzero(ok), run[ok]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then the same for the others."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count - start, count)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; bytes of equal weight stand together."""
    head = [np.array([len(arrays)], np.int32).tobytes()]
    body = []
    for a in arrays:
        code = a.dtype.str.encode().ljust(4)
        planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()
        head.append(code + np.array([a.size], np.int64).tobytes())
        body.append(planes)
    raw = b"".join(head + body)
    return np.array([len(raw)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(block: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(block[:8], np.int64)[0])
    raw = pa.decompress(block[8:], decompressed_size=size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw[:4], np.int32)[0])
    at, kinds = 4, []
    for _ in range(n):
        kinds.append((np.dtype(raw[at : at + 4].decode().strip()), int(np.frombuffer(raw[at + 4 : at + 12], np.int64)[0])))
        at += 12
    out = []
    for kind, size in kinds:
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += size * kind.itemsize
    return out


def gathered(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches joined and cut so that their texts hold about `limit` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in slices(batches, column, limit):
        off = flat(b.column(b.schema.get_field_index(column)))[1]
        if held and size + off[-1] > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(b)
        size += int(off[-1])
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
