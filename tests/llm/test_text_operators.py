import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from llm_fixtures import ls, odd  # noqa: F401
from tallyframe.llm import chat, language, pii, quality
from tallyframe.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def base_spans(t):
    """The stated patterns, run plainly."""
    out = []
    t = t or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[ -]", "", m.group())
        if 14 <= len(d) <= 19:
            s = 0
            for i, c in enumerate(reversed(d)):
                x = int(c) * (1 + i % 2)
                s += x - 9 if x > 9 else x
            if s % 10 == 0:
                out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


TRICKY = [
    "a@b.c_d@e.f x@y z@q..r @a.b a@b.c@d.e +@x.yy",
    "1.2.3.4.5.6.7.8.9 256.1.1.1 1..2.3.4.5 001.002.003.004 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111-2 4111  1111 378282246310005",
    "+1 (017) 555-7713) +12 +1-- +49 30 1234567890123456 ++1 234 567 8901. +1 22 333 4444 -",
    "mail7.1.2.3@x.org 10.0.0.1@host.net +441234567890@mail.example.com",
    "é@x.y ü1.2.3.4ß٣ +٣ 1.2.3.٤",
]


def test_pii_spans_equal_plain_patterns():
    find = pii.finder()
    for t in TRICKY:
        assert [s for s in find(t) if s[1] < 4] == base_spans(t), t


def test_added_kinds():
    find = pii.finder()
    t = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and http://bob:pw123@h.example/x IBAN: GB82 WEST 1234 5698 7654 32 account 12345678'
    kinds = [pii.KINDS[k] for _, k, _ in find(t)]
    assert {"secret", "login", "account"} <= set(kinds)


def test_cues_of_any_spelling():
    find = pii.finder()
    for cue in ("Api_Key", "PassWord", "SECRET", "aPI-kEY"):
        for lead in ("", "İ ß ", "ǅ İİ"):  # lower case of the second text is longer than the text
            t = f"{lead}{cue}: abcdEFGH1234 end"
            assert [(pii.KINDS[k], t[a:b]) for a, k, b in find(t)] == [("secret", "abcdEFGH1234")], t
    t = "IBaN GB82 WEST 1234 5698 7654 32"
    assert [pii.KINDS[k] for _, k, _ in find(t) if k > 3] == ["account"]


def test_op8_rows(ls):
    got = QUERIES["op8_pii_anchors"](ls, SF).collect()
    source = docs(ls)
    assert len(got) == len(source)
    for r in got:
        want = base_spans(source[r["doc_id"]]["text"])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in want) for k in range(4)]
        told = ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(r["spans"].split(","))
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [kinds.count(k) for k in pii.KINDS]


def test_pii_odd_rows(odd):
    assert odd.select(F.size(pii.spans()).alias("n")).agg(F.sum("n")).first()[0] == 0
    assert pii.redact(odd).exceptAll(odd).count() == 0
    assert pii.redact(odd.limit(0)).count() == 0
    one = odd.sparkSession.createDataFrame([(1, "hi a@b.co +1 234 567 8901!")], "doc_id long, text string")
    assert pii.redact(one).first()["text"] == "hi <email> <phone>!"


def test_op5_held_out_accuracy(ls):
    got = QUERIES["op5_language_filter"](ls, "/root/testdata/sf0.01").collect()
    source = {r["doc_id"]: r["lang"] for r in ls.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(got) == len(source)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == source[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_rows(ls, odd):
    model = language.learn(ls.read.parquet(f"{SF}/documents.parquet"))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(odd, model).collect()]
    und = [i for i, lang, _ in got if lang == "und"]
    assert sorted(und) == [0, 1, 2]
    assert len(got) == odd.count()
    empty = language.learn(odd.limit(0))
    assert {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0


def test_long_texts_read_in_blocks(ls):
    """A text beyond the block size gives the trigrams of one read in one piece."""
    import numpy as np

    from tallyframe.llm.text import flat
    import pyarrow as pa

    text = ("Déjà vu, 12 times! " * 160000)[:-1]
    data, off = flat(pa.array([text]))
    parts = [k for k, _ in language.trigram_reader()(data, off)]
    whole = [k for k, _ in language.trigram_reader()(*flat(pa.array([text, "z"])))][0]
    a, b = np.unique(np.concatenate(parts), return_counts=True), np.unique(whole[:-1], return_counts=True)
    assert all((x == y).all() for x, y in zip(a, b))


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(spark_rows, sql_rows, cols):
    key = lambda r: tuple(str(r[c]) for c in cols)
    assert sorted(map(key, spark_rows)) == sorted(map(key, sql_rows))


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(ls, con, name):
    got = QUERIES[name](ls, SF)
    want = con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    same([r.asDict() for r in got.collect()], want.to_dict("records"), sorted(got.columns))


def test_chat_round_trip(ls):
    rows = [
        (1, 0, "user", "</s>[INST] ok [/INST]"),
        (1, 0, "user", "~0~1[NEXT]"),
        (1, 1, "assistant", None),
        (1, 2, "assistant", "~"),
        (1, None, None, "<s>[INST]"),
        (None, 1, "user", "x" * 50000),
        (None, 1, "user", "x" * 50000),
        (2, 1, "assistant", ""),
    ]
    df = ls.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_turns(df)
    got = {r["conv_id"]: ([tuple(t) for t in r["t"]], r["l"]) for r in out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    for c in (1, 2, None):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert got[c][0] == [(r[2] or "", r[3] or "") for r in mine]
        assert got[c][1] == "".join(r[3] or "" for r in mine if r[2] == "assistant")
    assert chat.format_turns(df.limit(0)).count() == 0


def base_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, marked = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            marked |= {i + j for i in at for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked)


def test_op10_base_counts(ls, odd):
    got = QUERIES["op10_quality_divergence"](ls, SF).collect()
    source = docs(ls)
    assert len(got) == len(source)
    for r in got:
        want = base_quality(source[r["doc_id"]]["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])
    refs = quality.references(odd)
    out = quality.divergence(odd, refs).collect()
    assert sorted(r["n_words"] for r in out) == sorted(base_quality(t)[0] for t in [r["text"] for r in odd.collect()])
    assert quality.divergence(odd, quality.references(odd.limit(0))).count() == odd.count()


def test_divergence_verdict(ls):
    plain = "the cat of the house and the dog was in it for a day to rest " * 3
    texts = [(i, " ".join(f"w{(i * 37 + j * j) % 1000}x the of and {j}" for j in range(80)), "en") for i in range(40)]
    junk = (99, " ".join("#$%&*" * 3 + str(j) for j in range(300)), "en")
    df = ls.createDataFrame([*texts, junk, (100, plain, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.divergence(df, quality.references(df.where("doc_id < 40"))).collect()}
    assert not got[99]["kept"] and not got[99]["base_failed"]
    assert all(got[i]["kept"] for i in range(40))


def test_op10_short_junk_is_judged(ls):
    """Junk of 10 to 199 words by its word distance alone; clean texts of the same lengths stay."""
    rng = random.Random(7)
    common = "the of and to in is was for it on as at by he be his that with from this".split()
    clean = lambda n: " ".join(rng.choice(common) if rng.random() < 0.25 else f"word{chr(97 + rng.randrange(26))}{rng.randrange(999)}" for _ in range(n))
    lengths = [10, 15, 20, 30, 50, 100, 199]
    base = [(i, clean(300), "en") for i in range(40)]
    good = [(100 + i, clean(n), "en") for i, n in enumerate(lengths * 20)]
    junk = [(1000 + i, " ".join("for" if j % 4 else f"odd{j}" for j in range(n)), "en") for i, n in enumerate(lengths)]
    df = ls.createDataFrame([*base, *good, *junk], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.divergence(df, quality.references(df.where("doc_id < 100"))).collect()}
    assert all(r["word_distance"] is not None for r in got.values())
    assert all(got[g[0]]["kept"] for g in good)
    assert all(not got[j[0]]["kept"] and not got[j[0]]["base_failed"] for j in junk)


def test_op10_small_languages_have_their_own_reference(ls):
    """Clean texts of a non-Latin language of a thousandth of a thousandth of the words stay; one too small for a reference is not judged."""
    rng = random.Random(8)
    latin = [(i, " ".join(rng.choice(["the", "of", "and", f"word{rng.randrange(99)}x"]) for _ in range(5000)), "en") for i in range(300)]
    letters = [chr(0x4E00 + i) for i in range(60)]
    foreign = [(1000 + i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(120)), "zh") for i in range(12)]
    few = [(2000, " ".join(letters * 3), "xx"), (2001, " ".join(rng.choice(letters) + "a" for _ in range(150)), None)]
    junk = (1999, " ".join(f"#{j}$%&*#" for j in range(120)), "zh")
    df = ls.createDataFrame([*latin, *foreign, *few, junk], "doc_id long, text string, lang string")
    refs = quality.references(df)
    assert {r["lang"] for r in refs.collect()} == {"en", "zh", None}
    got = {r["doc_id"]: r for r in quality.divergence(df, refs).collect()}
    assert len(got) == df.count()
    assert all(got[f[0]]["kept"] and got[f[0]]["class_distance"] < 0.3 for f in foreign)
    assert not got[1999]["kept"] and not got[1999]["base_failed"]
    assert got[2000]["class_distance"] is None and got[2000]["word_distance"] is None
    assert got[2001]["word_distance"] is not None
