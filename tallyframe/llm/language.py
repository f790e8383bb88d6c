"""Language identification with language-bitmask n-gram filters.

Letter trigrams (lower case, runs of other characters as one blank, blanks around the text) are
counted per language over all training texts. A bit-sliced Bloom filter holds one bit per language in
each slot, so `HASHES` lookups and an AND return all languages that contain a trigram. Per text the
hits of every language are counted, corrected for the filter's false positives, and the largest
corrected count decides.

Defined results: NULL texts and texts without a letter give `und` and score 0, as does a filter
learned from nothing; ties go to the language with more training text, then to the smaller name;
repeated rows count as often as they occur; very long texts are read in blocks; an empty table gives
an empty result; input columns named like a result column give way to it.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.base import replaced
from tallyframe.llm.text import STEP, U64, flat, mix, slices
from tallyframe.plans.session import written

HASHES = 3
BLOCK = 1 << 20


class Filter(NamedTuple):
    """Languages in order of training text, and the slots: one row of 64-language words per slice."""

    languages: tuple[str, ...]
    slots: np.ndarray

    def rates(self) -> np.ndarray:
        """Share of absent trigrams that each language's filter reports as present."""
        n = len(self.languages)
        fill = [float(((self.slots[i // 64] >> U64(i % 64)) & U64(1)).mean()) for i in range(n)]
        return np.array(fill) ** HASHES


def _tables(size: int) -> np.ndarray:
    """Lower-case letter of each code point, 0 for all that is no letter."""
    out = np.zeros(size, np.int32)
    for i in range(size):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def trigram_reader() -> Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """A function from texts (bytes, offsets) to pieces of (trigram, text index)."""
    table = _tables(0x3000)

    def letters(points: np.ndarray) -> np.ndarray:
        nonlocal table
        if points.size and points.max() >= table.size:
            table = _tables(0x110000 if points.max() >= 0x10000 else 0x10000)
        return table[points]

    def keys(y: np.ndarray) -> np.ndarray:
        z = y.astype(U64)
        return z[:-2] | (z[1:-1] << U64(21)) | (z[2:] << U64(42))

    def read(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if off.size == 2 and data.size > 2 * BLOCK:
            decoder, carry = codecs.getincrementaldecoder("utf-8")("replace"), np.zeros(1, np.int32)
            for at in range(0, data.size + BLOCK, BLOCK):
                last = at >= data.size
                text = " " if last else decoder.decode(data[at : at + BLOCK].tobytes())
                x = np.concatenate([carry, letters(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32))])
                y = x[np.append(True, (x[1:] != 0) | (x[:-1] != 0))]
                if y.size > 2:
                    yield keys(y), np.zeros(y.size - 2, np.int32)
                carry = y[-2:]
            return
        try:
            points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            lens = np.diff(np.append(0, np.cumsum((data & 0xC0) != 0x80))[off])
        except UnicodeDecodeError:
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:])]
            lens = np.array([len(t) for t in texts], np.int64)
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        # One blank after every text; a blank belongs to the text before it.
        x = np.concatenate([[np.int32(0)], np.insert(letters(points), np.cumsum(lens), 0)])
        run = np.concatenate([[np.int32(-1)], np.repeat(np.arange(lens.size, dtype=np.int32), lens + 1)])
        keep = np.append(True, (x[1:] != 0) | (x[:-1] != 0))
        y, run = x[keep], run[keep]
        if y.size > 2:
            ok = run[1:-1] == run[2:]
            yield keys(y)[ok], run[1:-1][ok]

    return read


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = trigram_reader()
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (k, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k.size, pa.string()), pa.array(k.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    for b in slices(batches, limit=BLOCK):
        codes = b["lang"].dictionary_encode()
        of = codes.indices.to_numpy(zero_copy_only=False)
        for key, run in read(*flat(b["text"])):
            mine = of[run]
            for i, lang in enumerate(codes.dictionary.to_pylist()):
                k, n = np.unique(key[mine == i], return_counts=True)
                if lang in held:
                    k, at = np.unique(np.concatenate([held[lang][0], k]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([held[lang][1], n])).astype(np.int64)
                held[lang] = (k, n)
        if sum(k.size for k, _ in held.values()) > 1_000_000:
            yield from flush()
    yield from flush()


def learn(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_share: float = 1e-5,
    ratio: float = 0.2,
    slots: int = 1 << 20,
    max_languages: int = 1024,
) -> Filter:
    """Count the trigrams of all rows of `df` with a text and a language, and build the filter.

    A language contains a trigram when the trigram makes up `min_share` of the language's trigrams
    and at least `ratio` of the share it has where it is commonest. Both are shares, so the filter
    holds alike at every size and at most 1 / min_share trigrams a language. The driver receives the
    slots, `slots` x languages / 64 words whatever the input, and one row per language; more than
    `max_languages` is an error.
    """
    spark = df.sparkSession
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_counter, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts)
    totals = [(r["lang"], r["t"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).limit(max_languages + 1).collect()]
    if len(totals) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    totals.sort(key=lambda r: (-r[1], r[0]))
    languages = tuple(r[0] for r in totals)
    bits = np.zeros((max(1, -(-len(languages) // 64)), slots), U64)
    if languages:
        small = spark.createDataFrame([(name, i, float(t)) for i, (name, t) in enumerate(totals)], "lang string, i int, t double")
        shares = counts.join(F.broadcast(small), "lang").select("gram", "i", (F.col("n") / F.col("t")).alias("share")).where(F.col("share") >= min_share)
        best = F.max("share").over(Window.partitionBy("gram"))
        held = shares.withColumn("best", best).where(F.col("share") >= ratio * F.col("best")).select("gram", "i")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                i = b["i"].to_numpy()
                for at in _slots(b["gram"].to_numpy().view(U64), slots):
                    bit = np.left_shift(U64(1), (i % 64).astype(U64))
                    yield pa.RecordBatch.from_arrays([pa.array(i // 64, pa.int32()), pa.array(at.astype(np.int64)), pa.array(bit.view(np.int64))], ["part", "slot", "mask"])

        masks = held.mapInArrow(place, "part int, slot long, mask long").groupBy("part", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
        bits[masks["part"].to_numpy(), masks["slot"].to_numpy()] = masks["mask"].to_numpy(np.int64).view(U64)
    return Filter(languages, bits)


def _slots(key: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    for j in range(1, HASHES + 1):
        yield (mix(key + U64(j * int(STEP) % 2**64)) % U64(slots)).astype(np.int64)


def scorer(model: Filter) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """A function from texts (bytes, offsets) to (language index or -1, score)."""
    read, rates = trigram_reader(), model.rates()

    def score(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = off.size - 1
        hits, total = np.zeros((n, len(model.languages))), np.zeros(n)
        for key, run in read(data, off):
            total += np.bincount(run, minlength=n)
            at = list(_slots(key, model.slots.shape[1]))
            for part in range(model.slots.shape[0]):
                mask = model.slots[part][at[0]]
                for a in at[1:]:
                    mask &= model.slots[part][a]
                for i in range(64 * part, min(64 * part + 64, len(model.languages))):
                    hits[:, i] += np.bincount(run[(mask >> U64(i % 64)) & U64(1) != 0], minlength=n)
        if not model.languages:
            return np.full(n, -1), np.zeros(n)
        sure = np.maximum(0.0, (hits - total[:, None] * rates) / np.maximum(1e-9, 1 - rates))
        best = np.where(total > 0, sure.argmax(1), -1)
        return best, np.where(total > 0, np.minimum(1.0, sure.max(1) / np.maximum(total, 1)), 0.0)

    return score


def predict(model: Filter, text: str = "text") -> Column:
    """Struct column (lang_pred, score) computed from the text alone.

    The function counts as non-deterministic, so that a filter on its result is not pushed below it, which
    would read every text twice and hold two Python workers a task.
    """
    languages = [*model.languages, "und"]

    @F.arrow_udf("lang_pred string, score double")
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = scorer(model)
        for a in arrays:
            best, sure = [np.zeros(0, np.int64)], [np.zeros(0)]
            for b in slices(iter([pa.RecordBatch.from_arrays([a], ["text"])]), limit=BLOCK):
                i, s = score(*flat(b["text"]))
                best.append(i)
                sure.append(s)
            names = pa.array(languages).take(pa.array(np.concatenate(best) % len(languages)))
            yield pa.StructArray.from_arrays([names, pa.array(np.concatenate(sure))], ["lang_pred", "score"])

    return run.asNondeterministic()(F.col(text))


def letters(text: str = "text") -> Column:
    """The struct of `predict` where there is no language to learn from: score 1 if the text has a letter."""
    has = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return F.struct(F.when(has, F.lit("any")).otherwise(F.lit("und")).alias("lang_pred"), has.cast("double").alias("score"))


def identify(df: DataFrame, model: Filter, text: str = "text") -> DataFrame:
    """Append `lang_pred` and `score`."""
    out = replaced(df, _language=predict(model, text))
    names = [c for c in df.columns if c.lower() not in ("lang_pred", "score", "_language")]
    return out.select(*[F.col(f"`{c}`") for c in names], "_language.lang_pred", "_language.score")
