import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_fixtures import ls, odd  # noqa: F401
from tallyframe.llm import decontaminate, interpolation, jaccard, lattice, suffixes, toxicity
from tallyframe.llm.components import components
from tallyframe.llm.queries import QUERIES
from tallyframe.llm.q_text import PIECES
from tallyframe.llm.text import flat, pack, unpack, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def texts(spark, sf=SF):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_words_are_the_plain_ones():
    rng = random.Random(1)
    many = ["".join(rng.choice("aBé \t\n\x0b.xyz") for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", " ", "x" * 999 + " Yy"]
    seen = {}
    for block in (16, 1 << 18):
        h, first = words(*flat(pa.array(many)), block)
        for i, t in enumerate(many):
            plain = WORD.findall(low(t))
            assert len(plain) == first[i + 1] - first[i]
            for w, x in zip(plain, h[first[i] : first[i + 1]].tolist()):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    for a in (np.zeros(0, np.uint64), np.arange(9, dtype=np.uint32)):
        assert (unpack(pack(a, a))[1] == a).all()


# op1


def test_op1_base_and_counts(ls):
    got = QUERIES["op1_deleted_interpolation"](ls, SF).collect()
    tok = {d: [*WORD.findall(low(t)), None] for d, t in texts(ls).items()}
    c = collections.Counter()
    for d, w in tok.items():
        if zlib.crc32(str(d).encode()) % 10:
            c.update(w)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(tok)
    for r in got:
        w = tok[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_interpolation_equals_plain_mixture(ls, order, monkeypatch):
    """Plain counts, the same weights: equal scores; small blocks, so that counts meet from several."""
    monkeypatch.setattr(interpolation, "BLOCK", 64)
    kept = {}
    real = interpolation.expectation_maximisation
    monkeypatch.setattr(interpolation, "expectation_maximisation", lambda *a, **k: kept.setdefault("w", real(*a, **k)))
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("a b c dd e".split()) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(60, None), (60, None), (None, "a b")]
    df = ls.createDataFrame(rows, "doc_id long, text string")
    got = interpolation.score(df, F.coalesce(F.col("doc_id"), F.lit(0)) % 10, order=order).collect()
    w = kept["w"].table
    assert np.allclose(w.sum(1), 1)
    train = [(*["<s>"] * order, *WORD.findall(t or ""), "</s>") for i, t in rows if (i or 0) % 10]
    grams = [collections.Counter(tuple(t[j - k + 1 : j + 1]) for t in train for j in range(order, len(t))) for k in range(1, order + 1)]
    total, kinds = sum(grams[0].values()), len(grams[0])
    starts = len(train)
    want = collections.defaultdict(list)
    for i, t in rows:
        s, full = 0.0, ["<s>"] * order + WORD.findall(t or "") + ["</s>"]
        for j in range(order, len(full)):
            p, context = [1 / (kinds + 1), grams[0][(full[j],)] / total], total
            for k in range(2, order + 1):
                before = tuple(full[j - k + 1 : j])
                context = starts if set(before) == {"<s>"} else grams[k - 2][before]
                p.append(grams[k - 1][(*before, full[j])] / context if context else 0.0)
            s += math.log10(float(w[min(63, int(math.log2(context + 1)))] @ np.array(p)))
        want[i].append(round(s, 9))
    have = collections.defaultdict(list)
    for r in got:
        have[r["doc_id"]].append(round(r["score"], 9))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_op1_query_is_a_trigram_model(ls):
    rows = ls.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    want = {r["doc_id"]: r["score"] for r in interpolation.score(rows, part, order=3).collect()}
    got = {r["doc_id"]: r["score"] for r in QUERIES["op1_deleted_interpolation"](ls, SF).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_em_finds_the_likelier_source():
    cells = np.array([[3, -4, -40], [3, 1, -8]])
    w = interpolation.expectation_maximisation(cells, np.array([90.0, 10.0]), 1e-6).table
    assert w[3][1] > 0.85 and np.allclose(w[10], w[3])


def test_op1_odd(ls, odd):
    out = interpolation.score(odd, F.lit(2)).collect()
    assert sorted(r["n_tokens"] for r in out) == sorted(len(WORD.findall(r["text"] or "")) + 1 for r in odd.collect())
    assert interpolation.score(odd.limit(0), F.lit(2)).count() == 0
    none = interpolation.score(odd, F.lit(0)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)


# op2


@pytest.fixture(scope="module")
def model():
    return lattice.load(PIECES)


def segmentations(text, model, theta=1.0):
    """All splits with their log weights."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    s = "▁" + text.replace(" ", "▁")
    out = []

    def go(at, ids, w):
        if at == len(s):
            out.append((tuple(ids), w))
        for n in range(1, 17):
            if s[at : at + n] in pieces and at + n <= len(s):
                i = pieces[s[at : at + n]]
                go(at + n, [*ids, i], w + theta * model.weight[i])
        if at < len(s) and s[at] not in pieces:
            b = [model.first_byte + x for x in s[at].encode()]
            go(at + 1, ids + b, w + theta * sum(model.weight[x] for x in b))

    go(0, [], 0.0)
    return out


def draw(model, rows, k, theta=1.0, block=1 << 20):
    b = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] or "" for r in rows])], ["key", "text"])
    return pa.Table.from_batches(list(lattice._encode(model, k, theta, 1, block)(iter([b])))).to_pylist()


def test_splits_are_distinct_and_their_probabilities_right(model):
    text = "it is  中é"
    every = dict(segmentations(text, model))
    top = max(every.values())
    z = top + math.log(sum(math.exp(w - top) for w in every.values()))
    got = draw(model, [(1, text)], len(every) + 5)
    assert len(got) == len(every) == len({tuple(r["ids"]) for r in got})
    for r in got:
        assert r["log_prob"] == pytest.approx(every[tuple(r["ids"])] - z, abs=1e-9)
    values = [r["perturbed"] for r in got]
    assert values == sorted(values, reverse=True)
    assert all(r["log_inclusion"] == 0 for r in got)


def test_draws_follow_sampling_without_replacement(model):
    text, theta, n = "it is", 0.2, 6000
    every = segmentations(text, model, theta)
    z = math.log(sum(math.exp(w) for _, w in every))
    p = {s: math.exp(w - z) for s, w in every}
    got = draw(model, [(i, text) for i in range(n)], 2, theta, block=1 << 12)
    by = collections.defaultdict(dict)
    for r in got:
        by[r["key"]][r["sample"]] = tuple(r["ids"])
    first = collections.Counter(v[1] for v in by.values())
    second = collections.Counter(v[2] for v in by.values())
    for s in p:
        want = sum(p[a] * p[s] / (1 - p[a]) for a in p if a != s)
        for have, q in ((first[s], p[s]), (second[s], want)):
            assert abs(have / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3
    # Mean inverse inclusion is the number of splits: the scores are proper weights.
    weight = sum(math.exp(r["log_prob"] - r["log_inclusion"]) for r in got) / n
    assert weight == pytest.approx(1.0, abs=0.05)


def test_op2_round_trip_and_odd(ls, odd, model):
    got = QUERIES["op2_sampled_pieces"](ls, SF).collect()
    source = texts(ls)
    assert collections.Counter(r["doc_id"] for r in got) == {d: 3 for d in source}
    assert all(r["text_sha256"] == hashlib.sha256(source[r["doc_id"]].encode()).hexdigest() for r in got)
    assert len({(r["doc_id"], r["ids_sha256"]) for r in got}) == len(got)
    out = lattice.encode(odd, model, k=2)
    back = out.select("doc_id", "sample", "n_pieces", lattice.decode(F.col("ids"), model).alias("text")).where("sample = 1").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(r["doc_id"]), r["text"] or "") for r in odd.collect())
    twins = [tuple(r["ids"]) for r in out.where("doc_id = 4").orderBy("sample").collect()]
    assert twins[0] == twins[1] and twins[2] == twins[3] != twins[0]
    assert lattice.encode(odd.limit(0), model).count() == 0


def test_draws_do_not_depend_on_batches(model):
    rows = [(i, "one or two plain words, again " * (i % 7) + str(i)) for i in range(60)]
    a = draw(model, rows, 3)
    b = [r for row in rows for r in draw(model, [row], 3)]
    assert [r["ids"] for r in a] == [r["ids"] for r in b]


def test_blocks_share_the_lattices_of_equal_chunks(model, monkeypatch):
    rows = [(i, "one or two plain words again and again") for i in range(200)]
    built, build = [], lattice.build
    monkeypatch.setattr(lattice, "build", lambda points, *rest: built.append(points.size) or build(points, *rest))
    got = draw(model, rows, 3, block=1 << 10)  # 8 blocks
    assert built == [len("".join({" " + w for w in rows[0][1].split()}))]
    monkeypatch.undo()
    assert [r["ids"] for r in got] == [r["ids"] for row in rows for r in draw(model, [row], 3)]


def test_chunks_of_any_length_decode(model):
    text = "aé中\U0001f600▁" * 14_000  # more characters than 16 bits count
    got = draw(model, [(1, text), (2, "short"), (3, None)], 2)
    back = lattice.decoder(model)
    assert [back(np.array(r["ids"], np.int64)).decode() for r in got] == [text, text, "short", "short", ""]


# op3


def plain_repeats(bodies):
    c = collections.Counter(b[i : i + 400] for b in bodies for i in range(len(b) - 399))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if c[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(bool(g) and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_equals_plain_sort():
    rng = np.random.default_rng(1)
    for alphabet, n in ((1, 50), (2, 900), (26, 900), (250, 900)):
        t = rng.integers(1, alphabet + 1, n).astype(np.uint8)
        t[rng.integers(0, n, 5)] = 0
        t[-1] = 0
        raw = t.tobytes() + b"\0" * 2000
        got = suffixes.suffix_array(t, 64)
        assert sorted(got.tolist()) == list(range(n))
        keys = [raw[i : i + 64] for i in got.tolist()]
        assert keys == sorted(keys)


@pytest.mark.parametrize("crowd", [512, 1])
def test_op3_equals_plain(ls, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "PIECE", 3000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long_ = prose(150), prose(90)
    bodies = [prose(60) + passage[:k] + prose(40) for k in (390, 399, 400, 401, 500, 500, 500)]
    bodies += [prose(30) + long_ + prose(30) + long_ + prose(10), "a" * 1200, "ab" * 450 + "c" + "ab" * 450, "x" * 399, "y" * 400, "y" * 400, prose(3000), "", None, "z" * 9000 + prose(50)]
    copy = prose(120)
    bodies += [copy, copy, copy[:200] + "!" + copy[200:]]
    rows = [(i if i != 3 else None, b, "clash") for i, b in enumerate(bodies)]
    df = ls.createDataFrame(rows, "doc_id long, text string, t string")
    got = suffixes.remove_repeats(df).collect()
    have = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got}
    want = plain_repeats([(b or "").encode() for b in bodies])
    assert len(got) == len(rows)
    for (i, _, _), w in zip(rows, want):
        assert have[i] == w, i
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


def test_op3_query(ls):
    source = texts(ls)
    ids = list(source)
    want = dict(zip(ids, plain_repeats([(source[i] or "").encode() for i in ids])))
    got = QUERIES["op3_suffix_dedup"](ls, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


# op4


def test_masks_hit_every_double_substitution():
    import itertools

    for n in (0, 1, 2):
        for gone in itertools.combinations(range(13), n):
            assert any(all(c == "0" or i + j not in gone for j, c in enumerate(m)) for m in decontaminate.MASKS for i in range(14 - len(m)))


def plain_overlaps(text, items):
    """Items beside every place of the text: the longest stretch with four of five words equal."""
    w, out = WORD.findall(low(text)), set()
    for item, t in items:
        b = WORD.findall(low(t))
        for d in range(-len(b) + 1, len(w)):
            same = [w[d + k] == b[k] for k in range(max(0, -d), min(len(b), len(w) - d))]
            need = min(13, len(b))
            if len(b) < 5 or 5 * sum(same) < 4 * need:
                continue
            if any(5 * sum(same[i:j]) >= 4 * (j - i) for i in range(len(same)) for j in range(i + need, len(same) + 1)):
                out.add(item)
    return out


def test_op4_finds_planted_passages(ls, odd):
    rng = random.Random(2)
    voc = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(voc) for _ in range(n)]
    items = [make(n) for n in (40, 20, 13, 9, 5, 3, 30)]
    docs, planted = [], {}
    for i in range(60):
        body = make(rng.randint(0, 80))
        if i % 3 == 0:
            item = items[(i // 3) % 7]
            part = list(item)
            if len(part) >= 13 and i % 2:
                for at in rng.sample(range(len(part)), 1 + len(part) // 20):
                    part[at] = "Other"
            planted[i] = (i // 3) % 7
            at = rng.randint(0, len(body))
            body = body[:at] + part + body[at:]
        docs.append((i, " ".join(body)))
    bench = [(j, " ".join(x)) for j, x in enumerate(items)] + [(50, " ".join(items[0])), (51, None), (None, ""), (52, " ")]
    b = ls.createDataFrame(bench, "item_id long, text string")
    d = ls.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: {o["item_id"] for o in r["overlap"]} for r in decontaminate.contaminated(d, b).collect()}
    for i, t in docs:
        assert got[i] == plain_overlaps(t, [(j, x) for j, x in bench[:7]])
        if i in planted and len(items[planted[i]]) >= 5:
            assert planted[i] in got[i]
    out = decontaminate.contaminated(odd, b)
    assert out.count() == odd.count() and out.where(F.size("overlap") > 0).count() == 0
    assert decontaminate.contaminated(d, b.limit(0)).where(F.size("overlap") > 0).count() == 0
    assert decontaminate.contaminated(d.limit(0), b).count() == 0


def test_masks_hit_every_allowed_substitution():
    """All patterns with a fifth of 5 to 25 words substituted; fewer substitutions leave more hits."""
    import itertools

    for n in range(5, 26):
        masks = [*decontaminate.MASKS, *(m for (a, b), ms in decontaminate.SHORT.items() if a <= n <= b for m in ms)]
        gone = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(n), n // 5)])
        hit = np.zeros(gone.size, bool)
        for m in masks:
            for i in range(n - len(m) + 1):
                hit |= gone & (int(m[::-1], 2) << i) == 0
        assert hit.all(), n


def found(texts, items):
    return decontaminate.matcher(decontaminate.build(list(range(len(items))), items))(*flat(pa.array(texts)))


def test_op4_finds_items_of_every_length_and_every_segment():
    rng = random.Random(9)
    make = lambda n, p: [f"{p}{rng.randrange(10**6)}" for _ in range(n)]
    for n in range(5, 26):
        items = [make(n, "i") for _ in range(30)]
        texts = []
        for x in items:
            y = list(x)
            for at in rng.sample(range(n), n // 5):
                y[at] = "other"
            texts.append(" ".join(make(3, "t") + y + make(3, "t")))
        got = found(texts, [" ".join(x) for x in items])
        assert {(r, i) for r, i, *_ in got} == {(i, i) for i in range(30)}, n
        if n < 13:
            assert all((s, e, at, k) == (3, 3 + n, 0, n - n // 5) for _, _, s, e, at, k in got)
    x, y = make(40, "i"), make(6, "j")
    text = make(9, "t") + x + make(30, "t") + x + make(5, "t") + y + y + x[:14]
    got = found([" ".join(text)], [" ".join(x), " ".join(y)])
    assert {g[1:5] for g in got if g[1] == 1} == {(1, 84 + 40, 130, 0), (1, 130, 136, 0)}
    assert {(9, 49, 0), (79, 119, 0), (136, 150, 0)} == {g[2:5] for g in got if g[1] == 0}
    # Segments of a diagonal: all that are part of no longer one.
    for _ in range(200):
        equal = np.array([rng.random() < 0.8 for _ in range(40)])
        good = [(a, b) for a in range(40) for b in range(a + 13, 41) if 5 * equal[a:b].sum() >= 4 * (b - a)]
        assert decontaminate.alike(equal, 13) == sorted(g for g in good if not any(o != g and o[0] <= g[0] and g[1] <= o[1] for o in good))


def test_op4_blocks_of_a_large_benchmark(ls):
    b = ls.read.parquet(f"{SF}/benchmark.parquet")
    d = ls.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    whole = {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_spaced_seeds"](ls, SF).collect()}
    parts = set()
    for seeds in decontaminate.load(b, block_words=100):
        parts |= {(r["doc_id"], r["i"]) for r in d.select("doc_id", F.explode(decontaminate.overlaps(seeds)).alias("o")).select("doc_id", F.col("o.item_id").alias("i")).collect()}
    source = texts(ls)
    items = [(r["item_id"], r["text"]) for r in b.collect()]
    exact = {(d_, i) for d_, t in source.items() for i, x in items if x in (t or "")}
    assert exact <= whole and parts == whole


# op6


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    inv = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            inv[g].append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        c = collections.Counter(j for g in s for j in inv[g] if j < i)
        for j, k in c.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in v if x is not None), default=None) for g, v in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("crowd", [8, 1])
def test_op6_equals_plain(ls, monkeypatch, crowd):
    """Chains of changed copies, crowds of near copies, shared passages, short texts, copies."""
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rng = random.Random(4)
    voc = [f"v{i}" for i in range(3000)]
    make = lambda n: [rng.choice(voc) for _ in range(n)]

    def changed(w, n):
        w = list(w)
        for at in rng.sample(range(len(w)), n):
            w[at] = rng.choice(voc)
        return w

    bodies = []
    for n in (8, 30, 60, 120, 300, 700):
        base = make(n)
        bodies += [base, base]
        for _ in range(12):
            bodies.append(changed(base, max(1, n * 2 // 100)))
        chain = base
        for _ in range(6):
            chain = changed(chain, max(1, n * 2 // 100))
            bodies.append(chain)
        bodies += [base[: n - n // 5], base[: n - n // 4], base + make(n // 5), base + make(n // 3)]
    passage = make(60)
    bodies += [passage + make(rng.randint(5, 80)) for _ in range(40)]
    bodies += [make(k) for k in (1, 2, 3, 4)] * 2
    bodies = [" ".join(b) for b in bodies] + [None, "", "  "]
    rng.shuffle(bodies)
    rows = [(i if i % 17 else None, b) for i, b in enumerate(bodies)]
    df = ls.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, n int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()), key=repr)
    assert got == plain_components(rows)
    kept = jaccard.without_near_duplicates(df)
    assert kept.columns == df.columns
    groups = {c for _, n, c in got if n and c is not None}
    ids = collections.Counter(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None and WORD.search(r["text"] or ""))
    assert set(ids) == groups and max(ids.values()) == 1
    assert jaccard.near_duplicates(df.limit(0)).count() == 0 and jaccard.without_near_duplicates(df.limit(0)).count() == 0


def _recorded(monkeypatch, module):
    """Columns of every table that the module stores."""
    seen, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df: seen.append(df.columns) or write(df))
    return seen


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_near_duplicates_store_and_shuffle_no_texts(ls, monkeypatch, bits):
    """Neither the cells nor the texts are stored, texts that stay are not shuffled; a full bitmap changes nothing."""
    monkeypatch.setattr(jaccard, "MAP_BITS", bits)
    seen = _recorded(monkeypatch, jaccard)
    rng = random.Random(5)
    bodies = [[f"w{rng.randint(0, 5000)}" for _ in range(40)] for _ in range(60)]
    near = [[*b[:-1], "other"] for b in bodies[:6]]
    texts_ = [" ".join(b) for b in bodies + near + bodies[:3]] + [None, "", " "]
    rows = [(None if i in (2, 63) else i, t) for i, t in enumerate(texts_)] + [(5, texts_[5]), (25, texts_[20]), (7, ""), (None, None)]
    df = ls.createDataFrame([(*r, "a", 1, True) for r in rows], "doc_id long, text string, word string, at int, held boolean")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()), key=repr)
    assert got == plain_components(rows)
    out = jaccard.without_near_duplicates(df)
    want = [(c, True) for c in {c for _, n, c in got if n}] + [(d, False) for d, t in rows if not (t or "").strip()]
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], bool((r["text"] or "").strip())) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert not [c for c in seen if {"block", "text"} & set(c)]
    settled = out._jdf.queryExecution().optimizedPlan().children().last().toString()
    assert "LeftSemi" not in settled and "text" in settled, settled


def test_op6_query(ls):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in QUERIES["op6_parity_join"](ls, SF).collect()), key=repr)
    assert got == plain_components(list(texts(ls).items()))


def test_sketch_distance_bounds_symmetric_difference():
    rng = np.random.default_rng(3)
    for n, m in ((5, 5), (100, 130), (700, 2000)):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, m).astype(np.uint64)]))
        assert jaccard.hamming(jaccard.bit_sketch(a), jaccard.bit_sketch(b)) <= np.setxor1d(a, b).size


def test_components(ls):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(500, 500 + i) for i in range(100)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components(ls.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# op7


def test_op7_held_out_accuracy(ls):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op7_toxicity_cnn"](ls, sf)
    labels = ls.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    assert rows.count() == 10000
    got = rows.join(labels, "doc_id").where("held_out").collect()
    pos = [r for r in got if r["toxic"] == 1]
    neg = [r for r in got if r["toxic"] == 0]
    assert sum(r["predicted"] for r in pos) >= 0.85 * len(pos)
    assert sum(r["predicted"] for r in neg) <= 0.05 * len(neg)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_op7_learns_from_every_labelled_row(ls):
    """A word that only the labelled rows with the largest hashes of their class hold, and several parts."""
    words = np.array("sun rain tree road house river stone bread wind light".split())
    rng = np.random.default_rng(4)
    rank = ls.range(6000).selectExpr("id", "id % 2 AS y", "row_number() OVER (PARTITION BY id % 2 ORDER BY xxhash64(id), id) AS r").collect()
    rows = [(r["id"], " ".join([*rng.choice(words, 12), "blub" if r["r"] <= 2500 else "zork"] if r["y"] else rng.choice(words, 13)), "en", r["y"]) for r in rank]
    df = ls.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(df, df, part_rows=2000)
    seen = ls.createDataFrame([("a zork on the road",), ("the blub in rain",), ("a river and the road",), (" ".join(words[:7]),)], "text string")
    assert [r["p"] >= 0.5 for r in seen.select(toxicity.score(model).alias("p")).collect()] == [True, True, False, False]


def test_op7_stores_no_texts(ls, monkeypatch):
    seen = _recorded(monkeypatch, toxicity)
    docs, labels = ls.read.parquet(f"{SF}/documents.parquet"), ls.read.parquet(f"{SF}/labels.parquet")
    assert len(toxicity.fit(docs, labels).languages.languages) > 1
    assert seen and not [c for c in seen if "text" in c]


def test_op7_odd(ls, odd):
    docs = ls.read.parquet(f"{SF}/documents.parquet")
    labels = ls.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    out = odd.select("doc_id", toxicity.score(model).alias("p")).collect()
    assert len(out) == odd.count() and all(0 <= r["p"] <= 1 for r in out)
    assert len({round(r["p"], 12) for r in out if r["doc_id"] == 4}) == 1
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r["p"] for r in odd.select(toxicity.score(none).alias("p")).collect()} == {0.0}
    assert toxicity.fit(docs.limit(0), labels.limit(0)) is not None
