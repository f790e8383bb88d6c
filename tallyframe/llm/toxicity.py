"""Toxicity by a convolutional text classifier, trained in numpy.

Words (runs of letters and digits, lower-cased) are hashed into buckets with an embedding each; a word's
embedding is the sum of its own and that of its stem (its first bytes), so that inflected forms share
one. Filters over 1, 2 and 3 neighbouring words, the maximum of each filter over the whole text and one
logistic layer give a logit; the language of the text (told by the trigram filter from the text alone)
shifts it by a threshold calibrated for that language, so 0.5 is the threshold in every language.

The model is fitted on all labelled rows, whole texts. They are dealt by the hash of their key into parts;
tasks train one model a part from the same start, and the model is their mean, weighted by rows. Thresholds
come from the logits of all labelled rows: the mean of the other parts' models scores a part (with a single
part, models fitted on its other folds). With several parts logits are rounded to 1 / GRAIN for that, so that the
driver gets counts of a bounded number of values. A language's own threshold counts as much as it
has positive rows, the threshold of all languages as SHRINK of them.

Defined results: NULL and empty texts are scored as a text without words; labels other than 0 and 1,
and labels without a document, are not used; a document labelled more than once counts with its
largest label; without examples of both classes every score is 0; repeated rows get equal scores; an
empty table gives an empty result; ties among logits share a side of every threshold; columns other
than the key, the text, the language (of the fit) and the label are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import language
from tallyframe.llm.text import KEEP, STEP, U64, flat, mix, slices, words
from tallyframe.plans.session import written

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 8, (1, 2, 3)
PAD = max(WIDTHS)
#: Bytes of a word's stem; bucket of blanks (behind those of words and stems); folds and weight of the pooled threshold.
STEM, BLANK, FOLDS, SHRINK = 5, 2 * BUCKETS, 5, 20
#: Rows and words of a part, rows of the rarer class that it should hold, weights in a chunk, steps of a rounded logit.
PART_ROWS, PART_WORDS, PART_RARE, CHUNK, GRAIN = 5000, 1 << 22, 8, 1 << 13, 1024
#: Bytes of words, lower-cased; all others end a word.
LETTER = np.full(256, 32, np.uint8)
for _low, _high, _plus in ((48, 58, 0), (65, 91, 32), (97, 123, 0), (128, 256, 0)):
    LETTER[_low:_high] = np.arange(_low, _high) + _plus


class Model(NamedTuple):
    embedding: np.ndarray
    filters: tuple[np.ndarray, ...]
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    languages: language.Filter
    thresholds: np.ndarray


def buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word and of its stem (two columns) with PAD blank words after each text, and the texts' starts."""
    data = LETTER[data]
    accent = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    data[accent] += 0x20  # capitals of U+00C0 to U+00DE
    h, first = words(data, off)
    inside = data != 32
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    starts, ends = off[:-1][off[:-1] < data.size], off[1:][off[1:] > 0] - 1
    head[starts], tail[ends] = inside[starts], inside[ends]
    at = np.flatnonzero(head)
    size = np.minimum(np.flatnonzero(tail) - at + 1, STEM)
    eights = np.ndarray(data.size, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    stem = mix((eights[at] & KEEP[size]) ^ STEP)
    ids = np.stack([h % U64(BUCKETS), stem % U64(BUCKETS) + U64(BUCKETS)], 1).astype(np.int32)
    return np.insert(ids, np.repeat(first[1:], PAD), BLANK, axis=0), first + PAD * np.arange(off.size)


def _pooled(x: list[np.ndarray], starts: np.ndarray) -> list[np.ndarray]:
    """Maximum of every filter over the windows of each text, the one of blanks only included."""
    cuts = np.stack([starts[:-1], starts[1:] - PAD + 1], 1).reshape(-1)
    return [np.maximum.reduceat(c, cuts, axis=0)[::2] for c in x]


def _tables(embedding: np.ndarray, filters) -> list[list[np.ndarray]]:
    return [[embedding @ f[j] for j in range(f.shape[0])] for f in filters]


def _convolve(tables: list[list[np.ndarray]], ids: np.ndarray) -> list[np.ndarray]:
    out = []
    for parts in tables:
        c = parts[0][ids[:, 0]] + parts[0][ids[:, 1]]
        for j, t in enumerate(parts[1:], 1):
            c[:-j] += t[ids[j:, 0]] + t[ids[j:, 1]]
        out.append(c)
    return out


def _log_odds(ids: np.ndarray, starts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of the label given that a text holds a word or stem of the bucket."""
    text = np.repeat(np.arange(y.size), np.diff(starts))
    held = np.unique((text[:, None] * (BLANK + 1) + ids).reshape(-1))
    of, b = held // (BLANK + 1), held % (BLANK + 1)
    pos = np.bincount(b, y[of], BLANK + 1)
    neg = np.bincount(b, 1 - y[of], BLANK + 1)
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
    odds[pos + neg < 3] = 0
    odds[BLANK] = 0
    return np.clip(odds, -3, 3) / 2


def train(ids: np.ndarray, starts: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.02, batch: int = 64, seed: int = 7):
    """Embedding, filters, bias, output weights: Adam on the logistic loss, classes weighted alike."""
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (BLANK + 1, DIM)).astype(np.float32)
    e[:, 0] = _log_odds(ids, starts, y)
    e[BLANK] = 0
    k = FILTERS * len(WIDTHS)
    p = {f"f{w}": rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        p[f"f{w}"][0, 0, :] = np.abs(p[f"f{w}"][0, 0, :]) + 0.3
    p |= {"e": e, "b": np.zeros(k, np.float32), "v": np.full(k, 0.1, np.float32), "o": np.zeros(1, np.float32)}
    m1 = {n: np.zeros_like(a) for n, a in p.items()}
    m2 = {n: np.zeros_like(a) for n, a in p.items()}
    share = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    step = 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(y.size), max(1, y.size // batch)):
            step += 1
            cut = [np.arange(starts[r], starts[r + 1]) for r in rows]
            mine = ids[np.concatenate(cut)]
            st = np.concatenate([[0], np.cumsum([c.size for c in cut])])
            held = np.zeros(BLANK + 1, bool)
            held[mine] = True
            touched = np.flatnonzero(held)
            place = np.cumsum(held) - 1
            conv = _convolve(_tables(p["e"][touched], [p[f"f{w}"] for w in WIDTHS]), place[mine])
            at = [np.stack([st[i] + c[st[i] : st[i + 1] - PAD + 1].argmax(0) for i in range(rows.size)]) for c in conv]
            top = np.concatenate([np.take_along_axis(c, a, 0) for c, a in zip(conv, at)], 1) + p["b"]
            act = np.tanh(top)
            z = act @ p["v"] + p["o"][0]
            gz = (share[rows] * (1 / (1 + np.exp(-z)) - y[rows]) / rows.size).astype(np.float32)
            g = {n: np.zeros_like(a) for n, a in p.items()}
            g["v"], g["o"][0] = act.T @ gz, gz.sum()
            gt = gz[:, None] * p["v"] * (1 - act * act)
            g["b"] = gt.sum(0)
            for q, w in enumerate(WIDTHS):
                gw = gt[:, q * FILTERS : (q + 1) * FILTERS]
                for j in range(w):
                    word = mine[at[q] + j]
                    g[f"f{w}"][j] = np.einsum("nfd,nf->df", p["e"][word[..., 0]] + p["e"][word[..., 1]], gw)
                    push = (gw[:, :, None] * p[f"f{w}"][j].T[None]).reshape(-1, DIM)
                    np.add.at(g["e"], word[..., 0].reshape(-1), push)
                    np.add.at(g["e"], word[..., 1].reshape(-1), push)
            g["e"][BLANK] = 0
            for n in p:
                i = touched if n == "e" else slice(None)
                m1[n][i] = 0.9 * m1[n][i] + 0.1 * g[n][i]
                m2[n][i] = 0.999 * m2[n][i] + 0.001 * g[n][i] ** 2
                p[n][i] -= rate * (m1[n][i] / (1 - 0.9**step)) / (np.sqrt(m2[n][i] / (1 - 0.999**step)) + 1e-8)
            p["e"][BLANK] = 0
    return p["e"], tuple(p[f"f{w}"] for w in WIDTHS), p["b"], p["v"], float(p["o"][0])


def logits(model: Model, ids: np.ndarray, starts: np.ndarray, tables=None) -> np.ndarray:
    tables = tables or _tables(model.embedding, model.filters)
    top = np.concatenate(_pooled(_convolve(tables, ids), starts), 1) + model.bias
    return (np.tanh(top) @ model.weight + model.offset).astype(np.float64)


def _threshold(z: np.ndarray, hits: np.ndarray, n: np.ndarray) -> float:
    """The cut between two neighbouring logits with the best F1; of equal ones the middle. Each logit stands once, with its positives and rows."""
    order = np.argsort(-z)
    found = np.cumsum(hits[order])
    f1 = 2 * found / (np.cumsum(n[order]) + hits.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    i = int(best[best.size // 2])
    below = z[order][i + 1] if i + 1 < z.size else z[order][i] - 2
    return float((z[order][i] + below) / 2)


def _packed(weights: tuple) -> np.ndarray:
    e, filters, b, v, o = weights
    return np.concatenate([x.reshape(-1) for x in (e, *filters, b, v)] + [np.array([o])]).astype(np.float32)


def _unpacked(flat_: np.ndarray) -> tuple:
    k = FILTERS * len(WIDTHS)
    shapes = [(BLANK + 1, DIM), *[(w, DIM, FILTERS) for w in WIDTHS], (k,), (k,)]
    at = np.cumsum([0, *[int(np.prod(x)) for x in shapes]])
    e, *filters, b, v = (flat_[i:j].astype(np.float32).reshape(x) for i, j, x in zip(at[:-1], at[1:], shapes))
    return e, tuple(filters), b, v, float(np.float32(flat_[-1]))


def _bags(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray], np.ndarray]:
    pdf = pdf.sort_values(["key", "ids"])
    return pdf, [np.frombuffer(x, np.uint16).reshape(-1, 2) for x in pdf["ids"]], pdf["y"].to_numpy(np.float64)


def _part_model(pdf: pd.DataFrame) -> pd.DataFrame:
    """(part, n, model) of a part; none if it lacks a class."""
    part, (_, bags, y) = pdf["part"].iloc[0], _bags(pdf)
    if not 0 < y.sum() < y.size:
        return pd.DataFrame({"part": [], "n": [], "model": []}).astype({"part": "int64", "n": "int64", "model": object})
    return pd.DataFrame({"part": [part], "n": [y.size], "model": [_packed(train(*_joined(bags, np.ones(y.size, bool)), y)).tobytes()]})


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for n, model in zip(pdf["n"], pdf["model"]):
            cut = [model[i : i + 4 * CHUNK] for i in range(0, len(model), 4 * CHUNK)]
            yield pd.DataFrame({"chunk": np.arange(len(cut)), "n": n, "piece": cut})


def _sum(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(n * np.frombuffer(x, np.float32).astype(np.float64) for n, x in sorted(zip(pdf["n"], pdf["piece"])))
    return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "piece": [total.tobytes()]})


def fit(
    docs: DataFrame,
    labels: DataFrame,
    part_rows: int = PART_ROWS,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    label: str = "toxic",
) -> Model:
    """Fit on all labelled rows, in parts of about `part_rows` rows; the driver gets the mean of the parts' models.

    Parts are larger where positives (or negatives) are so rare that a part would hold none. The language filter is
    learned from the labelled texts' languages.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y"))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(known), "key")  # twelve bytes a label travel instead of all texts

    filter_ = language.learn(texts)

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell, names = language.scorer(filter_), pa.array([*filter_.languages, "und"])
        for b in slices(batches, limit=language.BLOCK):
            data, off = flat(b["text"])
            ids, starts = buckets(data, off)
            blocks = [ids[s : e - PAD].astype(np.uint16).tobytes() for s, e in zip(starts[:-1], starts[1:])]
            told = names.take(pa.array(tell(data, off)[0] % len(names)))
            yield pa.RecordBatch.from_arrays([b["key"], b["y"], told, pa.array(blocks, pa.binary())], ["key", "y", "told", "ids"])

    rows = written(texts.select("key", "y", "text").mapInArrow(bag, "key long, y int, told string, ids binary"))  # no text is stored
    none = np.zeros(len(filter_.languages) + 1)
    n, hits, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()
    if not 0 < hits < n:
        return Model(np.zeros((BLANK + 1, DIM), np.float32), tuple(np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS), np.zeros(FILTERS * len(WIDTHS), np.float32), np.zeros(FILTERS * len(WIDTHS), np.float32), -1e4, filter_, none)
    parts = max(1, min(max(-(-n // part_rows), -(-size // (4 * PART_WORDS))), min(hits, n - hits) // PART_RARE))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    models = written(rows.repartition(parts, "part").groupBy("part").applyInPandas(_part_model, "part long, n long, model binary"))
    pieces = models.mapInPandas(_pieces, "chunk long, n long, piece binary").groupBy("chunk").applyInPandas(_sum, "chunk long, piece binary")
    total = np.concatenate([np.frombuffer(r["piece"]) for r in pieces.orderBy("chunk").collect()])
    used = models.agg(F.sum("n")).first()[0]

    def judged(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        pdf, bags, y = _bags(pdf)
        if parts == 1:
            return pdf[["told", "y"]].assign(z=out_of_fold(bags, y))
        mine, held = (0.0, 0) if own.empty or own["n"].iloc[0] == used else (np.frombuffer(own["model"].iloc[0], np.float32).astype(np.float64), own["n"].iloc[0])
        model = Model(*_unpacked((total - held * mine) / (used - held)), None, None)
        tables, z = _tables(model.embedding, model.filters), np.zeros(y.size)
        for i in range(0, y.size, 64):
            z[i : i + 64] = logits(model, *_joined(bags[i : i + 64], np.ones(len(bags[i : i + 64]), bool)), tables)
        return pdf[["told", "y"]].assign(z=np.round(z * GRAIN) / GRAIN)

    z = rows.groupBy("part").cogroup(models.groupBy("part")).applyInPandas(judged, "told string, y int, z double")
    got = z.groupBy("told", "z").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n")).toPandas()
    return Model(*_unpacked(total / used), filter_, _calibrated(got, filter_.languages))


def _joined(bags: list[np.ndarray], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept bags (without blanks) in one array, as `buckets` gives them."""
    mine = [b for b, k in zip(bags, keep) if k]
    first = np.concatenate([[0], np.cumsum([len(b) for b in mine])])
    ids = np.insert(np.concatenate(mine).astype(np.int32), np.repeat(first[1:], PAD), BLANK, axis=0)
    return ids, first + PAD * np.arange(first.size)


def out_of_fold(bags: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Logit of every text by a model fitted without its fold; folds deal out each class in turn."""
    fold = np.zeros(y.size, int)
    for c in (0, 1):
        fold[y == c] = np.arange((y == c).sum()) % FOLDS
    z = np.zeros(y.size)
    for f in np.unique(fold):
        out = fold == f
        rest = ~out if 0 < y[~out].sum() < (~out).sum() else np.ones(y.size, bool)
        model = Model(*train(*_joined(bags, rest), y[rest]), None, None)
        z[out] = logits(model, *_joined(bags, out))
    return z


def _calibrated(got: pd.DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Threshold of every language (the last one for none), its own by its positives and the pooled one by SHRINK; from (told, z, hits, n)."""

    def cut(rows: pd.DataFrame) -> float:
        each = rows.groupby("z")[["hits", "n"]].sum()
        return _threshold(each.index.to_numpy(), each["hits"].to_numpy(np.float64), each["n"].to_numpy(np.float64))

    every = cut(got)
    cuts = np.full(len(languages) + 1, every)
    for i, name in enumerate(languages):
        mine = got[got["told"] == name]
        if 0 < mine["hits"].sum() < mine["n"].sum():
            own = float(mine["hits"].sum())
            cuts[i] = (own * cut(mine) + SHRINK * every) / (own + SHRINK)
    return cuts


def score(model: Model, text: str = "text") -> Column:
    """Toxicity from 0 to 1 of a text column."""

    @F.arrow_udf("double")
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = _tables(model.embedding, model.filters)
        tell = language.scorer(model.languages)
        for a in arrays:
            out = [np.zeros(0)]
            for b in slices(iter([pa.RecordBatch.from_arrays([a], ["text"])]), limit=1 << 20):
                data, off = flat(b["text"])
                z = logits(model, *buckets(data, off), tables) - model.thresholds[tell(data, off)[0]]
                out.append(np.where(z < -700, 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 700)))))
            yield pa.array(np.concatenate(out))

    return run(F.col(text))
