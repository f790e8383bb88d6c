"""Alignment, URL trees and manifests against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_fixtures import ls, odd  # noqa: F401
from tallyframe.llm import alignment, manifest, urls
from tallyframe.llm.q_data import BYTE_LEVEL, PIECES
from tallyframe.llm.q_native import RULES
from tallyframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"

# op11


@pytest.fixture(scope="module")
def files():
    return alignment.load(BYTE_LEVEL, PIECES)


def plain_alignment(texts):
    """Token by token, with both libraries; rows as the operator returns them."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    letters = alignment._byte_letters()
    spell_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    rows, count = [], collections.Counter()
    for key, t in texts:
        whole = (" " + (t or "")).encode()
        xs = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ys = b.encode(t) if t else []
        if not t or b"".join(map(spell_a, xs)) != whole or b"".join(map(spell_b, ys)) != whole:
            rows.append((key, 0, 0, [], ""))
            continue
        ends = [set(), set()]
        for side, (ids, spell) in enumerate(((xs, spell_a), (ys, spell_b))):
            at = 0
            for i in ids:
                at += len(spell(i))
                ends[side].add(at)
        cuts = sorted(ends[0] & ends[1])
        groups = [[[], []] for _ in cuts]
        for side, (ids, spell) in enumerate(((xs, spell_a), (ys, spell_b))):
            at = g = 0
            for i in ids:
                at += len(spell(i))
                groups[g][side].append(i)
                g += at == cuts[g]
        links = [(g[0][-1], g[1][-1]) for g in groups]
        count.update(links)
        rows.append((key, len(xs), len(ys), links, ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)))
    top = collections.defaultdict(int)
    for (x, y), n in count.items():
        top[y] = max(top[y], n)
    return sorted([(k, x, y, len(li), len(li), sum(count[p] == top[p[1]] for p in li), sum(count[p] for p in li), g) for k, x, y, li, g in rows], key=repr)


def aligned(df, files, **more):
    return sorted([tuple(r) for r in alignment.align(df, files, **more).collect()], key=repr)


def test_op11_equals_plain(ls, files, monkeypatch):
    rng = random.Random(5)
    odd_ones = ["", None, " ", "a", "</s><|endoftext|><s><unk><0x41>", "▁x", "x▁", "a\x00b", "  two  blanks ", "\n\r\n\t", "中文字 \U0001f600é́", "é" * 50, "x" * 3000, "\u200b\ufeff﷽", "1234567890" * 9]
    many = odd_ones + ["".join(rng.choice("ab eé.,'s\n1中") for _ in range(rng.randint(1, 80))) for _ in range(120)] + ["the cat sat on the mat"] * 7
    rows = [(i // 2, t) for i, t in enumerate(many)] + [(None, "no key"), (None, "no key")]
    df = ls.createDataFrame([(k, t, 1, "n", t) for k, t in rows], "doc_id long, text string, n_a int, block string, `odd.name` string").repartition(5)
    want = plain_alignment(rows)
    assert aligned(df, files) == want
    monkeypatch.setattr(alignment, "BLOCK", 300)
    monkeypatch.setattr(alignment, "STEP_BYTES", 90)
    assert aligned(df, files) == want
    told = [hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "" for r in want]
    assert sorted(r[-1] for r in aligned(df, files, digest=True)) == sorted(told)
    assert aligned(df.limit(0), files) == []
    renamed = df.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"))
    assert [r[1:] for r in aligned(renamed, files, key="id", text="body")] == [r[1:] for r in sorted([(None if r[0] is None else str(r[0]), *r[1:]) for r in want], key=repr)]


def test_op11_query(ls):
    docs = [(r["doc_id"], r["text"]) for r in ls.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in QUERIES["op11_tokenizer_alignment"](ls, SF).collect()], key=repr)
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in plain_alignment(docs)]
    assert got == sorted(want, key=repr)


def test_op11_engines_agree(files):
    enc = alignment.Encoders(files)
    assert enc.fast is not None
    for c in [*range(0x3000), *range(0xFE00, 0x10000), *range(0x1F000, 0x1FB00, 7)]:
        t = f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}. {chr(c)} {chr(c)}{chr(c)}z"
        assert enc.fast.encode_ordinary(t) == enc.a.encode(t, add_special_tokens=False).ids
    long = "a" + " \n" * 400_000 + "b"
    assert enc.encode_a(long) == enc.a.encode(long, add_special_tokens=False).ids
    got = alignment.align_texts(enc, pa.array([long, "b"]))
    assert got.n_a[0] > 0 and got.n_groups[1] == 1


# op12


def plain_parts(u):
    u = u or ""
    rest = u.split("://", 1)[1] if "://" in u else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(len(r.host + r.path), r.host + r.path, r.verdict) for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits) if fits else None


URLS = [
    None, "", "no scheme", "://", "http://", "http://net/", "https://NET/x", "http://a.net", "http://a.net?x=/", "http://xnet/", "http://a.b.example.net/en/1",
    "http://example.net/en", "http://u:p@example.com:80/de/x", "http://example.com/de/x?y#z", "http://example.com/de?/de/", "http://w.org/fr/#a?b", "ftp://org/fr/x://net/",
    "http://é.org/fr/\n/x", "http://a.com/" + "x" * 50000, "http://a.com/%20[]+~", "//a.net/", "http:///path", "http://a.com/\U0001f600",
]


def test_op12_rules_and_odd_urls(ls):
    rows = [(i, u, 1.0, "x", "y") for i, u in enumerate([*URLS, *URLS])] + [(None, "http://a.net/", 0.0, None, None)]
    df = ls.createDataFrame(rows, "page_id long, url string, size double, verdict string, key string")
    got = urls.filter_urls(df, RULES).collect()
    assert len(got) == len(rows)
    by = {i: u for i, u, *_ in rows}
    for r in got:
        host, path = plain_parts(by[r["page_id"]])
        rule = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule[1] if rule else None)
        assert r["verdict"] == rule[2] if rule else r["verdict"] in ("allow", "block")
    half = len(URLS)
    told = {r["page_id"]: r["verdict"] for r in got}
    assert all(told[i] == told[i + half] for i in range(half))
    assert urls.filter_urls(df.limit(0), RULES).collect() == []
    assert {r["verdict"] for r in urls.filter_urls(df, []).collect()} == {"allow"}
    assert {r["verdict"] for r in urls.filter_urls(df, [urls.Rule("block", "net", "/")]).collect()} == {"block"}


def test_op12_features_equal_plain(ls):
    df = ls.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    for r in urls.describe(df, RULES, "page_id", "url").collect():
        u = r["url"] or ""
        host, path = plain_parts(u)
        query = u.split("?", 1)[1].split("#")[0] if "?" in u else ""
        bits = lambda t: -sum(n / len(t) * math.log2(n / len(t)) for n in collections.Counter(t).values()) if t else 0.0
        assert (r["size"], r["host_size"], r["path_size"], r["query_size"]) == (len(u), len(host), len(path), len(query))
        assert r["depth"] == len(re.findall("/[^/]", path)) and r["labels"] == (host.count(".") + 1 if host else 0)
        assert r["parameters"] == (query.count("&") + 1 if query else 0)
        assert r["digits"] == pytest.approx(sum(c in "0123456789" for c in u) / len(u) if u else 0)
        assert r["entropy"] == pytest.approx(bits(u), abs=1e-9) and r["host_entropy"] == pytest.approx(bits(host), abs=1e-9)


def test_op12_trees_learn_lexical_signs(ls):
    """Blocked URLs are long and full of digits; the rules know a part of each kind, the trees tell the rest."""
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        bad, known = i % 2, i % 4 < 2
        host = f"{'x' * rng.randint(3, 9)}.{'bad' if bad and known else 'good' if known else 'other'}.com"
        path = "".join(rng.choice("0123456789") for _ in range(rng.randint(12, 40))) if bad else "/".join(["news", "page"][: rng.randint(1, 2)])
        rows.append((i, f"http://{host}/{path}", bad, known))
    df = ls.createDataFrame(rows, "page_id long, url string, bad int, known boolean")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(df, [urls.Rule("block", "bad.com", "/"), urls.Rule("allow", "good.com", "/")]).collect()}
    unknown = [(i, bad) for i, _, bad, known in rows if not known]
    assert sum((got[i] == "block") == bool(bad) for i, bad in unknown) >= 0.97 * len(unknown)


def test_op12_query_has_no_python(ls):
    out = QUERIES["op12_url_trees"](ls, SF)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert out.count() == ls.read.parquet(f"{SF}/pages.parquet").count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# op13


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """(doc_id, source, lang, n_chars, text) rows to the contract's rows."""
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaves = []
    for d, s, la, n, t in rows:
        tampered = zlib.crc32((b"" if d is None else str(d).encode())) % 3 == 0
        leaves.append((d, la, H(*map(told, (d, s, la, n, t))), H(*map(told, (d, s, la, n, lower(t)))) if tampered else None))

    def climb(nodes):
        """Root, and per node the (before, after) siblings of its path."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i in range(len(paths)):
                run = at[i] // 8 * 8
                paths[i].append((nodes[run : at[i]], nodes[at[i] + 1 : run + 8]))
                at[i] //= 8
            nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        return nodes[0], paths

    langs = sorted({x[1] for x in leaves}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for la in langs:
        mine = sorted((x for x in leaves if x[1] == la), key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
        trees[la] = (mine, *climb([x[2] for x in mine]))
    if not langs:
        return []
    root, tops = climb([trees[la][1] for la in langs])
    out = []
    for la, top in zip(langs, tops, strict=True):
        mine, sub, paths = trees[la]
        for (d, _, own, other), path in zip(mine, paths, strict=True):
            h = other or own
            for before, after in [*path, *top]:
                h = H(*before, h, *after)
            out.append((d, own, sub, root, H(*[x for b, a in [*path, *top] for x in [*b, *a]]), h, h == root))
    return sorted(out, key=repr)


def check_manifest(ls, monkeypatch, tmp_path, rows, name):
    df = ls.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = QUERIES["op13_merkle_manifest"](ls, f"{tmp_path}/{name}")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted([tuple(r) for r in got.collect()], key=repr) == plain_manifest(rows)


def test_op13_equals_plain(ls, monkeypatch, tmp_path):
    rng = random.Random(2)
    text = lambda: rng.choice([None, "", "Some TEXT", "éÉ 中", "x" * 9000, "lower", "A:1-"])
    rows = [(rng.randint(0, 500), rng.choice([None, "s", ""]), rng.choice([None, "", "en", "en", "en", "de", "z", "é"]), rng.choice([None, 3]), text()) for _ in range(700)]
    rows += [(None, None, None, None, None)] * 3 + [(7, "s", "en", 1, "Twice")] * 20
    check_manifest(ls, monkeypatch, tmp_path, rows, "small")
    monkeypatch.setattr(manifest, "DIGITS", 1)
    monkeypatch.setattr(manifest, "BLOCK", 8)
    check_manifest(ls, monkeypatch, tmp_path, rows, "deep")
    for n in (0, 1, 2, 8, 9, 64, 65):
        check_manifest(ls, monkeypatch, tmp_path, [(i, "s", "en", 1, "T") for i in range(n)], f"n{n}")
    many = [(i, "s", f"l{i:03}", 1, "T") for i in range(70)]
    check_manifest(ls, monkeypatch, tmp_path, many, "languages")


def test_op13_keeps_other_columns_and_finds_tampering(ls):
    rows = [(i, "en" if i % 3 else None, H(str(i)), f"p{i}", i) for i in range(100)]
    df = ls.createDataFrame(rows, "doc_id long, lang string, leaf string, path string, r int")
    out = manifest.proofs(df, "lang", "doc_id", "leaf")
    told = out.select("item.*", "root", manifest.fold(F.col("item.leaf"), F.col("path")).alias("right"), manifest.fold(F.lit(H("?")), F.col("path")).alias("wrong")).toPandas()
    assert (told.right == told.root).all() and (told.wrong != told.root).all() and told.root.nunique() == 1
    assert sorted(told.path) == sorted(r[3] for r in rows) and isinstance(told, pd.DataFrame)


def test_op13_blocks_hold_no_more_than_their_rows(ls):
    """One partition of the rollup holds whole blocks; inside a block nothing is exchanged or joined."""
    nodes = ls.range(5000).selectExpr("string(id % 2) AS g", "id * 0 + 2500 AS n", "id div 2 AS r", "sha2(string(id), 256) AS h", "struct(id) AS item")
    plan = manifest._rolled(nodes)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan
