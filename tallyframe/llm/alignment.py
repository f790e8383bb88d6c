"""Cross-tokenizer alignment: byte ranges of two tokenizations of a text cut into common groups.

Method: pointer jumping. The tokens of both tokenizations of many texts stand in one array. Every
token points to its farthest-right overlapping token, that is the token of the other side that holds
its last byte; where both end together, the first side points to the second and that to itself.
Doubling the pointers (`next = next[next]`) until nothing changes brings every token to the last
token of its component, which labels its group. Rounds grow with the logarithm of the longest chain.

A link is a pair of token occurrences of the two sides whose byte ranges end together, one for each
group as no token is empty. The count of an id pair is the number of its links in the whole corpus.
Texts are tokenized once: blocks of about `BLOCK` bytes keep their links as distinct pairs per text,
ask for the counts of their distinct pairs by a join, and add them up.

Defined results: a text that is NULL, empty, or whose tokens on either side do not spell space+text
has no tokens (zeros, no groups); special tokens inside a text are plain text; repeated rows count
and stay; ties for the highest count all count as best; an empty table gives an empty result; input
columns besides the key and the text are ignored. One text and one block have to fit into a task.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.text import flat, gathered, pack, ranges, slices, unpack
from tallyframe.plans.session import written

#: Bytes of text in one block (whose distinct pairs ask for their counts together) and in one step.
BLOCK, STEP_BYTES = 8 << 20, 1 << 19


class Tokenizers(NamedTuple):
    """Contents of a byte-level merge tokenizer (JSON) and of a piece model; constant in size."""

    a: bytes
    b: bytes


class Table(NamedTuple):
    """Bytes of every id of a vocabulary: those of id i are data[at[i] : at[i] + size[i]]."""

    data: np.ndarray
    at: np.ndarray
    size: np.ndarray


def load(byte_level: str, pieces: str) -> Tokenizers:
    """Read both files on the driver; their contents travel with the tasks."""
    with open(byte_level, "rb") as a, open(pieces, "rb") as b:
        return Tokenizers(a.read(), b.read())


def _table(tokens: list[bytes]) -> Table:
    size = np.array([len(t) for t in tokens], np.int64)
    return Table(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size)


def _byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable ones as they are, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: Fixed value: the public split pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of blanks from this length on are left to the slower of the two engines, which needs no stack for them.
LONG_BLANK = re.compile(r"\s{20000}")


def _ranks(file: dict, letters: dict[str, int]) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks, if the file is a plain byte-level one whose ids follow its merges, else None."""
    model, split = file["model"], file["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
    plain &= file["normalizer"] is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", False)
    vocab = model["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]] if plain else []
    if not plain or any(vocab.get(m) != 256 + i for i, m in enumerate(merged)):
        return None
    added = {t["content"] for t in file["added_tokens"]}
    return {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}


class Encoders:
    """Both tokenizers as loaded in a task.

    A plain byte-level file is run by a second engine on the same vocabulary, about four times as
    fast; a test holds both against each other.
    """

    def __init__(self, files: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.a.decode())
        self.a.encode_special_tokens = True
        file, letters = json.loads(files.a), _byte_letters()
        ranks = _ranks(file, letters)
        self.fast = tiktoken.Encoding("pairs", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        added = {t["id"]: t["content"].encode() for t in file["added_tokens"]}
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = _table([added[i] if i in added else bytes(letters[c] for c in names.get(i, "")) for i in range(max(names, default=-1) + 1)])
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        n = range(self.b.get_piece_size())
        self.b_bytes = _table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in n for p in [self.b.id_to_piece(i)]])

    def encode_a(self, text: str) -> list[int]:
        if self.fast is None or LONG_BLANK.search(text):
            return self.a.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids of all texts, number of ids of each) for both sides."""
        a = [self.encode_a(" " + t) for t in texts]
        b = self.b.encode(texts, num_threads=1)
        return [(np.fromiter(chain.from_iterable(side), np.int64), np.array([len(x) for x in side], np.int64)) for side in (a, b)]


def _spelt(ids: np.ndarray, count: np.ndarray, table: Table, want: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which texts (`size` bytes each, all in `want`) their tokens spell."""
    doc = np.repeat(np.arange(count.size), count)
    ok = np.bincount(doc, table.size[ids], count.size).astype(np.int64) == size
    mine = ids[ok[doc]]
    got = table.data[ranges(table.at[mine], table.size[mine])]
    differs = got != want[np.repeat(ok, size)]
    where = np.repeat(np.arange(size.size), np.where(ok, size, 0))
    return ok & (np.bincount(where, differs, size.size) == 0)


def _jump(end_a: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Pointer jumping: the last token (an index of the second side) of every token's component, first side first.

    Ends are byte positions in one line of texts that both sides cover.
    """
    n = end_a.size
    over_a = np.searchsorted(end_b, end_a) + n
    over_b = np.searchsorted(end_a, end_b)
    over_b = np.where(end_a[over_b] == end_b, np.arange(end_b.size) + n, over_b)
    succ = np.concatenate([over_a, over_b])
    while True:
        far = succ[succ]
        if np.array_equal(far, succ):
            return succ - n
        succ = far


class Aligned(NamedTuple):
    """Of a run of texts: tokens, groups, links a text, links as (text, a << 32 | b, times), and the groups spelt out."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray
    groups: list[bytes]


def align_texts(enc: Encoders, column: pa.Array) -> Aligned:
    """Tokens, groups and links of the texts of one column."""
    data, off = flat(column)
    n = off.size - 1
    want = np.insert(data, off[:-1], 32)
    size = np.diff(off) + 1
    (a, n_a), (b, n_b) = enc.encode([t or "" for t in column.to_pylist()])
    ok = _spelt(a, n_a, enc.a_bytes, want, size) & _spelt(b, n_b, enc.b_bytes, want, size) & (size > 1)
    a, b = a[np.repeat(ok, n_a)], b[np.repeat(ok, n_b)]
    n_a, n_b = n_a * ok, n_b * ok
    doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    end_a, end_b = np.cumsum(enc.a_bytes.size[a]), np.cumsum(enc.b_bytes.size[b])
    if not a.size:
        zero = np.zeros(n, np.int64)
        return Aligned(zero, zero, zero, zero[:0], zero[:0], zero[:0], [b""] * n)
    last = _jump(end_a, end_b)
    ends = np.flatnonzero(last[a.size :] == np.arange(b.size))  # terminal tokens: the second side's, where both end
    group = np.searchsorted(ends, last)
    n_groups = np.bincount(doc_b[ends], minlength=n)
    with_a = np.searchsorted(end_a, end_b[ends])
    pairs = (a[with_a] << 32) | b[ends]
    order = np.lexsort((pairs, doc_b[ends]))
    doc, pairs = doc_b[ends][order], pairs[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pairs[1:] != pairs[:-1])])
    return Aligned(n_a, n_b, n_groups, doc[new], pairs[new], np.diff(np.r_[new, doc.size]), _spell(a, b, doc_a, doc_b, group, n))


def _spell(a: np.ndarray, b: np.ndarray, doc_a: np.ndarray, doc_b: np.ndarray, group: np.ndarray, n: int) -> list[bytes]:
    """The groups of every text as `a1,a2|b1;a3|b2,b3`."""
    ids, doc, side = np.concatenate([a, b]), np.concatenate([doc_a, doc_b]), np.repeat([0, 1], [a.size, b.size])
    order = np.argsort(group * 2 + side, kind="stable")
    ids, doc, side, group = ids[order], doc[order], side[order], group[order]
    digits = _table([str(i).encode() + b"," for i in range(int(ids.max()) + 1)])
    out = digits.data[ranges(digits.at[ids], digits.size[ids])]
    stop = np.cumsum(digits.size[ids])
    same = group[1:] == group[:-1]
    out[stop[:-1] - 1] = np.where(~same, ord(";"), np.where(side[1:] != side[:-1], ord("|"), ord(",")))
    upto = np.concatenate([[0], stop])[np.searchsorted(doc, np.arange(n + 1))]
    whole = out.tobytes()
    return [whole[i : max(i, j - 1)] for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


_COUNTS = ("n_a", "n_b", "n_groups")


def _read(files: Tokenizers, key: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number = Encoders(files), TaskContext.get().partitionId() << 32
        for block in gathered(batches, BLOCK):
            parts, before, held = [], 0, []
            for step in slices(iter([block]), limit=STEP_BYTES):
                got = align_texts(enc, step["text"])
                groups = [hashlib.sha256(g).hexdigest() if g and digest else g.decode() for g in got.groups]
                parts.append([*[getattr(got, c) for c in _COUNTS], groups])
                held.append((got.text + before, got.pair, got.times))
                before += step.num_rows
            text, pair, times = (np.concatenate(x) for x in zip(*held, strict=True))
            distinct, at = np.unique(pair, return_inverse=True)
            total = np.bincount(at, times, distinct.size).astype(np.int64)
            links = pack(text.astype(np.uint32), at.astype(np.uint32), times.astype(np.uint32))
            counts = [pa.array(np.concatenate(x)) for x in list(zip(*parts, strict=True))[:3]]
            rows = pa.StructArray.from_arrays([block[key], *counts, pa.array([g for p in parts for g in p[3]], pa.string())], [key, *_COUNTS, "groups"])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([number]), one(rows), pa.array([links], pa.binary()), one(pa.array(distinct)), one(pa.array(total))], ["block", "rows", "links", "pair", "times"])
            number += 1

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the links of every text, from the block's pairs and the answers for them."""
    for b in batches:
        for i in range(b.num_rows):
            rows = b["rows"].slice(i, 1).flatten()
            text, at, times = unpack(b["links"][i].as_py())
            said = b["said"].slice(i, 1).flatten()
            pair, count, top = (said.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            order = np.argsort(pair)  # links name a pair by its rank in the block
            count, best = count[order], (count == top)[order]
            n = len(rows)
            n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(n_best, text, times * best[at])
            np.add.at(total, text, times.astype(np.int64) * count[at])
            own = rows.flatten()
            yield pa.RecordBatch.from_arrays([own[0], own[1], own[2], own[3], own[3], pa.array(n_best), pa.array(total), own[4]], [rows.type.field(0).name, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def align(docs: DataFrame, files: Tokenizers, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """`key`, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row of `docs`.

    n_best: links whose pair's count is the highest of its second id in the corpus; count_sum: the
    counts of all links; `groups`: the ids of every group as `a1,a2|b1;a3|b2,b3` (with `digest`
    its lower-case hex sha256, or '' without tokens).
    """
    kind = docs.schema[key].dataType
    row = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("groups", T.StringType())])
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(row)), T.StructField("links", T.BinaryType()), T.StructField("pair", longs), T.StructField("times", longs)])
    blocks = written(docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(_read(files, key, digest), schema))
    asked = blocks.select("block", F.explode(F.arrays_zip("pair", "times")).alias("z")).select("block", "z.pair", "z.times")
    counts = asked.groupBy("pair").agg(F.sum("times").alias("count"))
    # of one second id there are no more pairs than the first vocabulary has ids
    told = counts.withColumn("top", F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(0xFFFFFFFF))))
    answers = asked.join(told, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "count", "top")).alias("said"))
    none = F.array().cast("array<struct<pair: bigint, count: bigint, top: bigint>>")
    full = blocks.join(answers, "block", "left").select("rows", "links", F.coalesce("said", none).alias("said"))
    longs = [T.StructField(c, T.LongType()) for c in (*_COUNTS, "n_links", "n_best", "count_sum")]
    return full.mapInArrow(_add, T.StructType([T.StructField(key, kind), *longs, T.StructField("groups", T.StringType())]))
