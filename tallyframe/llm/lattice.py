"""SentencePiece encoding by sampling distinct segmentations, and decoding.

A text's lattice holds every split into vocabulary pieces; a character without a piece of its own is
spelled in byte pieces. A split's probability is proportional to the product of its pieces'
weights to the power `theta`; a piece weighs 1 / (its rank in the vocabulary + 1). Splits are drawn without
replacement by Gumbel top-k: partial splits carry the maximum of their completions' perturbed
log-probabilities, and a best-first (A*) search always continues the partial split with the largest
one. The first complete split it reaches has the largest perturbed log-probability, the next one the
second largest, and so on, so no split is drawn twice. Random numbers are a function of the row key, the seed and the
place in the search alone.

Pieces hold blanks only at their start, so a lattice is a chain of independent chunks (blanks and the
characters up to the next blank). Equal chunks of some blocks of texts share one lattice, frequent ones
stand first; what a draw adds to the agenda is computed for a block of texts at once.

The inclusion score of a split with log-probability f is the chance that its perturbed value exceeds
the largest one left over, k: 1 - exp(-exp(f - k)). It is returned as a logarithm.

Defined results: NULL and empty texts have one split without pieces; texts with fewer than k splits
return all of them, each with inclusion 1; repeated rows (equal key and text) get equal draws, a NULL
key is a key of its own; a text is one lattice whatever its length; U+2581 is spelled in bytes, so
decoding always returns the text; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.text import STEP, U64, flat, gathered, mix, ranges, release, slices

BLANK, SPELLED = 0x2581, 0x110000
INVERSE = U64(pow(int(STEP), -1, 1 << 64))
#: A second odd multiplier, for counters.
STRIDE = np.array(0xD1342543DE82EF95, U64)
#: More than -log(-log(u)) can be for the largest u drawn.
MARGIN = 40.0


class Model(NamedTuple):
    """Vocabulary: sorted code-point hashes of the pieces with their ids, log weights, and the bytes of all ids.

    `begin` tells where the hashes with the same upper 18 bits begin, `some` whether there are any.
    """

    keys: np.ndarray
    begin: np.ndarray
    some: np.ndarray
    ids: np.ndarray
    weight: np.ndarray
    longest: int
    first_byte: int
    spelled: bytes
    spelled_off: np.ndarray


def load(path: str) -> Model:
    """Read a SentencePiece model with byte pieces on the driver; tasks get its tables."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    keys, ids, out, first_byte, longest = [], [], [], None, 1
    rank = np.full(n, n)
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            first_byte = i if first_byte is None else first_byte
            out.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            out.append(b"")
        else:
            if "▁" in piece[1:] and piece.strip("▁"):
                raise ValueError("a piece holds a blank after its start")
            points = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
            keys.append(_piece_hash(points))
            ids.append(i)
            rank[i] = len(ids)
            longest = max(longest, points.size)
            out.append(piece.replace("▁", " ").encode())
    if first_byte is None:
        raise ValueError("the model has no byte pieces")
    order = np.argsort(np.array(keys, U64))
    w = -np.log(rank + 1.0)
    w -= np.log(np.exp(w).sum())
    sorted_keys = np.array(keys, U64)[order]
    begin = np.searchsorted(sorted_keys >> U64(46), np.arange((1 << 18) + 1, dtype=np.uint64)).astype(np.int32)
    return Model(sorted_keys, begin, begin[1:] > begin[:-1], np.array(ids, np.int32)[order], w, longest, first_byte, b"".join(out), np.cumsum([0, *map(len, out)]))


def _piece_hash(points: np.ndarray) -> int:
    """Hash of a piece: its code points as digits, see `_pieces_at`."""
    h = 1
    for p in points.tolist():
        h = (h * int(STEP) + p) % 2**64
    return h * int(STEP) % 2**64


def _sorted(x: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0 on; numpy counts out those of 16 bits, which is faster."""
    return np.argsort(x.astype(np.uint16) if int(x.max(initial=0)) < 1 << 16 else x, kind="stable")


def _pieces_at(points: np.ndarray, room: np.ndarray, begins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, id) of every piece that fits; lengths rise, and only positions with room go on.

    `room` lists the positions by the room they have, `begins` where those with room for n + 1 begin.
    """
    begin = model.begin
    digits = points.astype(U64)
    at, h = room[::-1].astype(np.int32), np.ones(points.size, U64)  # most room first
    out: list[tuple[np.ndarray, ...]] = []
    for n in range(1, min(model.longest, begins.size - 1) + 1):
        at, h = at[: points.size - begins[n - 1]], h[: points.size - begins[n - 1]]
        h = h * STEP + digits[at + n - 1]
        key = h * STEP
        top = (key >> U64(46)).view(np.int64)
        maybe = np.flatnonzero(model.some[top])
        top, key = top[maybe], key[maybe]
        here, end = begin[top], begin[top + 1]
        while maybe.size:
            same = model.keys[here] == key
            out.append((at[maybe[same]], np.full(int(same.sum()), n, np.int32), model.ids[here[same]]))
            here += 1
            more = np.flatnonzero(~same & (here < end))
            maybe, here, end, key = maybe[more], here[more], end[more], key[more]
    if not out:
        return (np.zeros(0, np.int32),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


class Lattices(NamedTuple):
    """Arcs of many chunks, by start position; a position without arcs is a chunk's end.

    `out` holds each position's first arc and, in the lower 16 bits, how many it has.
    An arc's piece is an id, or -1 - the code point of a character to spell in bytes.
    """

    out: np.ndarray
    to: np.ndarray
    log: np.ndarray
    upto: np.ndarray
    start: np.ndarray
    piece: np.ndarray


def build(points: np.ndarray, off: np.ndarray, model: Model, theta: float, part: int = 1 << 15) -> Lattices:
    """Lattices of chunks given as code points; every chunk has one more position, its end.

    They are built some chunks at a time, so that the working arrays stay in the processor's cache.
    """
    parts, at, places, arcs = [], 0, 0, 0
    while at < off.size - 1 or not parts:
        to = max(min(at + 1, off.size - 1), int(np.searchsorted(off, off[at] + part, "right")) - 1)
        lat = _build(points[off[at] : off[to]], off[at : to + 1] - off[at], model, theta)
        parts.append(lat._replace(out=lat.out + (arcs << 16), to=lat.to + places, start=lat.start + places))
        places, arcs, at = places + lat.out.size, arcs + lat.to.size, to
    return Lattices(*(np.concatenate(x) for x in zip(*parts)))


def _build(points: np.ndarray, off: np.ndarray, model: Model, theta: float) -> Lattices:
    lens = np.diff(off)
    slots = off[:-1] + np.arange(lens.size)  # the first position of each chunk
    run = np.repeat(np.arange(lens.size, dtype=np.int32), lens)
    left = (off[1:][run] - np.arange(points.size)).astype(np.int32)
    by_left = _sorted(left)
    steps = np.searchsorted(left[by_left], np.arange(1, int(left.max(initial=0)) + 2))
    at, size, piece = _pieces_at(points, by_left, steps, model)
    known = np.zeros(points.size, bool)
    known[at[size == 1]] = True
    plain = np.flatnonzero(~known)
    code = np.where(points[plain] == SPELLED, BLANK, points[plain]).astype(np.int64)
    at = np.concatenate([at, plain.astype(np.int32)])
    size = np.concatenate([size, np.ones(plain.size, np.int32)])
    piece = np.concatenate([piece, (-1 - code).astype(np.int32)])
    order = _sorted(at)
    at, size, piece = at[order], size[order], piece[order]
    lone = np.flatnonzero(piece < 0)
    w = (theta * model.weight)[np.maximum(piece, 0)]
    w[lone] = theta * (_utf8(-1 - piece[lone]) * model.weight[model.first_byte])
    # Log mass of all completions, from the chunks' ends backwards.
    place = np.arange(points.size, dtype=np.int32) + run
    total = np.zeros(points.size + lens.size)
    degree = np.bincount(at, minlength=points.size)
    begin = np.concatenate([[0], np.cumsum(degree)])
    to = (at + run[at] + size) if at.size else at
    n = degree[by_left]
    ends = np.concatenate([[0], np.cumsum(n)])
    arcs = ranges(begin[by_left], n)  # in the order in which they are needed
    w_of, to_of, place_of = w[arcs], to[arcs], place[by_left]
    for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
        i, j = ends[a], ends[b]
        v = w_of[i:j] + total[to_of[i:j]]
        cut = ends[a:b] - i
        top = np.maximum.reduceat(v, cut)
        total[place_of[a:b]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, n[a:b])), cut))
    log = w + total[to] - np.repeat(total[place], degree) if at.size else np.zeros(0)
    p = np.exp(log)
    running = np.cumsum(p)
    upto = running - np.repeat((running - p)[begin[:-1]], degree) if at.size else p
    out = np.zeros(total.size, np.int64)
    out[place] = (begin[:-1] << 16) + degree
    return Lattices(out, to, log, upto, slots, piece)


def _utf8(code: np.ndarray) -> np.ndarray:
    """How many bytes characters take."""
    return 1 + (code > 0x7F).astype(np.int8) + (code > 0x7FF) + (code > 0xFFFF)


def _ids(piece: np.ndarray, first_byte: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the arcs' pieces, characters spelled in byte pieces, and the offsets of each arc's ids."""
    lone = np.flatnonzero(piece < 0)
    code = -1 - piece[lone]
    utf8 = _utf8(code)
    width = np.ones(piece.size, np.int64)
    width[lone] = utf8
    off = np.concatenate([[0], np.cumsum(width)])
    ids = np.repeat(piece, width) if lone.size else piece
    for n in (1, 2, 3, 4):
        sel = np.flatnonzero(utf8 == n)
        c = code[sel]
        for j in range(n):
            low = (c >> (6 * (n - 1 - j))) & 0x3F
            byte = c if n == 1 else (low | 0x80 if j else (c >> (6 * (n - 1))) | (0xC0, 0xE0, 0xF0)[n - 2])
            ids[off[lone[sel]] + j] = first_byte + byte
    return ids, off


def chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with a blank before every text, the chunks' offsets, and each text's first chunk."""
    texts = [t.decode("utf-8", "replace") for t in (data[a:b].tobytes() for a, b in zip(off[:-1], off[1:]))]
    lens = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    points = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le"), np.uint32)
    head, lower = points == 32, points == BLANK
    points = points.copy()
    points[head], points[lower] = BLANK, SPELLED
    head[1:] &= points[:-1] != BLANK
    starts = np.cumsum(lens) - lens
    head[starts[lens > 0]] = True
    at = np.flatnonzero(head)
    return points, np.append(at, points.size), np.searchsorted(at, np.append(starts, points.size))


def _uniform(seed: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) from seeds and counters."""
    h = mix(seed + np.asarray(b).astype(U64) * STRIDE)
    return ((h >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _walk(lat: Lattices, seed: np.ndarray, place: np.ndarray, turn: int) -> tuple[np.ndarray, ...]:
    """Follow one random completion from `place` in every chunk: (chunk row, place, arc) in reading order; a seed per chunk."""
    taken = []
    now, here = np.arange(place.size), place
    steps = np.zeros(place.size, np.int64)
    while now.size:
        out = lat.out[here]
        count = out & 0xFFFF
        live = np.flatnonzero(count)
        if live.size < now.size:
            steps[now[count == 0]] = len(taken)
            now, here, seed, out, count = now[live], here[live], seed[live], out[live], count[live]
        u = _uniform(seed, turn * 4_000_000_007 + 2 * len(taken))
        # The first arc that reaches u; the longest ones are the likeliest, so they are tried first.
        first = out >> 16
        arc = first + (count - 1)
        less = np.flatnonzero(arc > first)
        while less.size:
            less = less[lat.upto[arc[less] - 1] >= u[less]]
            arc[less] -= 1
            less = less[arc[less] > first[less]]
        taken.append((now, here, arc))
        here = lat.to[arc].astype(np.int64)
    cut = np.cumsum(steps) - steps
    places, arcs = np.empty(int(steps.sum()), np.int64), np.empty(int(steps.sum()), np.int64)
    for step, (now, here, arc) in enumerate(taken):
        places[cut[now] + step], arcs[cut[now] + step] = here, arc
    return np.repeat(np.arange(steps.size), steps), places, arcs


def sample(lat: Lattices, kind: np.ndarray, first: np.ndarray, seed: np.ndarray, k: int) -> list[list[tuple[float, float, np.ndarray]]]:
    """Per text up to k + 1 (perturbed value, log-probability, arcs), best first; the last only bounds.

    `kind` is the lattice of every chunk and `first` each text's first chunk. The last entry of a
    text has no arcs when it is the bound left on the agenda.
    """
    n = first.size - 1
    start_of = lat.start
    out: list[list] = [[] for _ in range(n)]
    agenda: list[list[tuple]] = [[] for _ in range(n)]
    # What to continue: text, chunk, place in the chunk, value, log so far, arcs so far.
    todo = [(t, int(first[t]), -1, float(x), 0.0, np.zeros(0, np.int64)) for t, x in enumerate(-np.log(-np.log(_uniform(mix(seed + STEP), 1))))]
    for turn in range(k):
        text = np.array([x[0] for x in todo], np.int64)
        if not text.size:
            break
        begin = np.array([x[1] for x in todo], np.int64)
        span = first[text + 1] - begin
        chunk = ranges(begin, span)
        owner = np.repeat(np.arange(text.size), span)
        origin = start_of[kind[chunk]]
        place = origin.copy()
        inside = np.array([x[2] for x in todo], np.int64)
        lead = (np.cumsum(span) - span)[(inside >= 0) & (span > 0)]
        place[lead] = inside[(inside >= 0) & (span > 0)]
        local = chunk - first[text][owner]
        row, here, arc = _walk(lat, seed[text][owner] + local.astype(U64) * STEP, place, turn)
        of = owner[row]
        cut = np.searchsorted(of, np.arange(text.size + 1))
        value = np.array([x[3] for x in todo])
        so_far = np.array([x[4] for x in todo])
        logs = lat.log[arc]
        cum = np.concatenate([[0.0], np.cumsum(logs)])
        before = so_far[of] + cum[:-1] - cum[cut[:-1]][of]
        want = k - turn
        others = (lat.out[here] & 0xFFFF) - 1

        def offer(nodes: np.ndarray) -> np.ndarray:
            """Put each text's `want` best partial splits on its agenda: arcs not taken at these nodes of the path.

            Each carries the largest perturbed value of its completions, drawn below the one taken.
            Returns for each text the last value that was put there.
            """
            times, mine, at = others[nodes], of[nodes], here[nodes]
            node = np.repeat(nodes, times)
            ends = np.cumsum(times, dtype=np.int64)
            rank = np.arange(node.size) - np.repeat(ends - times, times)
            side = np.repeat(lat.out[at] >> 16, times) + rank
            side += side >= np.repeat(arc[nodes], times)
            f = np.repeat(before[nodes], times) + lat.log[side]
            in_chunk = row[nodes]
            drawn = seed[text][mine] + mix(local[in_chunk].astype(U64) + U64(1)) + (at - origin[in_chunk]).astype(U64) * STEP
            u = _uniform(np.repeat(drawn, times), rank * 64 + 2 * turn + 1)
            left = f - np.log(np.exp(f - np.repeat(value[mine], times)) - np.log(u))
            spot = np.append(0, ends)[np.searchsorted(mine, np.arange(text.size + 1))]
            worst = np.full(text.size, -np.inf)
            full = np.flatnonzero(np.diff(spot) > 0)
            for step in range(want):
                if not full.size:
                    break
                top = np.maximum.reduceat(left, spot[full])
                full = full[top > -np.inf]
                for i, m in zip(full, top[top > -np.inf]):
                    j = spot[i] + int(np.argmax(left[spot[i] : spot[i + 1]]))
                    e = int(node[j])
                    agenda[text[i]].append((float(m), int(chunk[row[e]]), int(lat.to[side[j]]), float(f[j]), i, e - int(cut[i]), int(side[j]), turn))
                    left[j] = -np.inf
                    if step == want - 1:
                        worst[i] = m
            return worst

        # A value exceeds its log-probability by less than MARGIN, so arcs far down the path, whose
        # prefix has become unlikely, need no draw where better ones fill the agenda.
        low = value - MARGIN - 10
        worst = offer(np.flatnonzero((others > 0) & (before > low[of])))
        again = (worst <= low + MARGIN) & (np.bincount(of[(others > 0) & (before <= low[of])], minlength=text.size) > 0)
        if again.any():
            for i in np.flatnonzero(again):
                agenda[text[i]] = [a for a in agenda[text[i]] if len(a) < 8 or a[7] != turn]
            offer(np.flatnonzero((others > 0) & again[of]))
        nxt = []
        for i, x in enumerate(todo):
            t = x[0]
            path = np.concatenate([x[5], arc[cut[i] : cut[i + 1]]])
            total = float(x[4] + cum[cut[i + 1]] - cum[cut[i]])
            out[t].append((x[3], total, path))
            base = x[5].size
            # Entries of this round know their path only now; what they take of it is copied when they are continued.
            agenda[t] = [(a[0], a[1], a[2], a[3], path, base + a[5], a[6]) if len(a) == 8 and a[7] == turn else a for a in agenda[t]]
            agenda[t].sort(key=lambda a: -a[0])
            del agenda[t][want:]
            if agenda[t]:
                best = agenda[t][0]
                if turn + 1 < k:
                    agenda[t].pop(0)
                    nxt.append((t, best[1], best[2], best[0], best[3], np.append(best[4][: best[5]], best[6])))
                else:
                    out[t].append((best[0], best[3], None))
        todo = nxt
    return out


HEAD = "key long, sample int, n_pieces int, log_prob double, perturbed double, log_inclusion double, "


def _encode(model: Model, k: int, theta: float, seed: int, block: int, digest: bool = False, decoded: bool = False, shared: int = 1 << 21):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = pa.Array.from_buffers(pa.large_binary(), model.spelled_off.size - 1, [None, pa.py_buffer(model.spelled_off.astype(np.int64)), pa.py_buffer(model.spelled)])
        for big in gathered(batches, max(block, shared)):
            release()
            data, off = flat(big["text"])
            points, at, first = chunks(data, off)
            held = np.zeros(at.size - 1, U64)
            if held.size:
                lens = np.diff(at)
                # Powers count from the block's start; those of the inverse take each chunk's start off again.
                power, back = (np.cumprod(np.full(points.size, x, U64), dtype=U64) for x in (STEP, INVERSE))
                held = mix(np.add.reduceat(mix(points.astype(U64)) * power, at[:-1]) * back[at[:-1]] + lens.astype(U64))
            told = pa.array(held).dictionary_encode()
            kind = told.indices.to_numpy().astype(np.int64)
            one = np.empty(len(told.dictionary), np.int64)
            one[kind[::-1]] = np.arange(kind.size)[::-1]  # where each kind is first
            often = np.argsort(-np.bincount(kind, minlength=one.size), kind="stable")  # frequent chunks lie together
            place = np.empty(often.size, np.int64)
            place[often] = np.arange(often.size)
            one, kind = one[often], place[kind]
            size = np.diff(at)[one] if one.size else np.zeros(0, np.int64)
            lat = build(points[ranges(at[one], size)], np.concatenate([[0], np.cumsum(size)]), model, theta)
            points = at = held = told = power = back = None
            keys = big["key"].fill_null(0).to_numpy()
            null = big["key"].is_null().to_numpy(zero_copy_only=False)
            seeds = mix(keys.view(U64) * STEP + U64(seed) + null.astype(U64) * U64(7919))
            i = 0
            while i < big.num_rows:
                j = max(i + 1, int(np.searchsorted(off, off[i] + block, "right")) - 1)
                drawn = sample(lat, kind[first[i] : first[j]], first[i : j + 1] - first[i], seeds[i:j], k)
                yield _rows(big["key"].slice(i, j - i), drawn, lat, model.first_byte, spelled if digest or decoded else None, digest)
                i = j

    return run


def _rows(keys: pa.Array, drawn: list, lat: Lattices, first_byte: int, spelled: pa.Array | None, digest: bool) -> pa.RecordBatch:
    """The drawn splits as rows; the ids of all of them, and the bytes of these, are looked up in one go."""
    row, num, logp, value, incl, paths = [], [], [], [], [], [np.zeros(0, np.int64)]
    for i, found in enumerate(drawn):
        whole = [x for x in found if x[2] is not None]
        bound = next((x[0] for x in found if x[2] is None), -np.inf)
        for j, (g, f, path) in enumerate(whole):
            row.append(i)
            num.append(j + 1)
            logp.append(f)
            value.append(g)
            x = f - bound
            incl.append(0.0 if x > 4 else x if x < -30 else float(np.log(-np.expm1(-np.exp(x)))) + 0.0)
            paths.append(path)
    arcs = np.concatenate(paths)
    ids, off = _ids(lat.piece[arcs], first_byte)
    at = off[np.cumsum([x.size for x in paths])]
    columns = [keys.take(pa.array(row, pa.int64())), pa.array(num, pa.int32()), pa.array(np.diff(at).astype(np.int32)), pa.array(logp), pa.array(value), pa.array(incl)]
    names = ["key", "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion"]
    texts = []
    if spelled is not None:
        _, off, data = spelled.take(pa.array(ids)).buffers()
        cut = np.frombuffer(off, np.int64)[at].tolist()
        data = memoryview(data) if data is not None else b""
        texts = [data[i + 1 : j] for i, j in zip(cut[:-1], cut[1:])]  # without the blank before every text
    if digest:
        told = [[hashlib.sha256(ids[i:j]).hexdigest() for i, j in zip(at[:-1].tolist(), at[1:].tolist())], [hashlib.sha256(x).hexdigest() for x in texts]]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(t, pa.string()) for t in told)], [*names, "ids_sha256", "text_sha256"])
    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
    if spelled is not None:
        text = pa.array([str(x, "utf-8", "replace") for x in texts], pa.string())
        return pa.RecordBatch.from_arrays([*columns, lists, text], [*names, "ids", "text"])
    return pa.RecordBatch.from_arrays([*columns, lists], [*names, "ids"])


def encode(
    docs: DataFrame,
    model: Model,
    k: int = 3,
    theta: float = 1.0,
    seed: int = 1,
    key: str = "doc_id",
    text: str = "text",
    digest: bool = False,
    decoded: bool = False,
    block: int = 1 << 18,
    shared: int = 1 << 21,
) -> DataFrame:
    """Up to k distinct segmentations per row: `key`, sample (1 is the best), n_pieces, log_prob, perturbed, log_inclusion, ids.

    With `digest`, ids_sha256 (of the ids as 4-byte little-endian numbers) and text_sha256 (of the
    text decoded from them) stand in place of the ids. With `decoded`, a column text holds what the
    ids decode to, made by the same task.

    Texts of `shared` bytes share their lattices, as chunks repeat; `block` bytes of them are drawn at a time.
    """
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    last = "ids_sha256 string, text_sha256 string" if digest else "ids array<int>" + ", text string" * decoded
    return rows.mapInArrow(_encode(model, k, theta, seed, block, digest, decoded, shared), HEAD + last).withColumnRenamed("key", key)


def decoder(model: Model):
    """A function from an id array to its text."""
    table, off = np.frombuffer(model.spelled, np.uint8), model.spelled_off

    def decode(ids: np.ndarray) -> bytes:
        return table[ranges(off[ids], off[ids + 1] - off[ids])].tobytes()[1:]

    return decode


def decode(ids, model: Model):
    """Text column of an id column; ids outside the vocabulary are an error."""

    @F.arrow_udf("string")
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        back = decoder(model)
        for a in arrays:
            a = a.cast(pa.list_(pa.int32()))
            yield pa.array([back(x.values.to_numpy()).decode("utf-8", "replace") if x.is_valid else None for x in a], pa.string())

    return run(ids)
