"""Merkle manifests, phrase fingerprints and ranked search against brute force, with odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import lz_fingerprint, merkle, ranked_search


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Root, and each leaf's siblings bottom up with whether they stand left."""
    ways, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for k, p in enumerate(at):
            if p ^ 1 < len(leaves):
                ways[k].append((leaves[p ^ 1], p & 1))
        leaves = [sha("".join(leaves[k : k + 2])) for k in range(0, len(leaves), 2)]
        at = [p // 2 for p in at]
        for way, p in zip(ways, at, strict=True):
            if len(way) < len(max(ways, key=len)):
                way.append(("", 0))
    return leaves[0], ways


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text) → sorted results."""
    encode = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    if not rows:
        return []
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, encode(r)))
        trees[g] = plain_tree([encode(r) for r in groups[g]])
    root, tops = plain_tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for r, way in zip(groups[g], trees[g][1], strict=True):
            told = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                told = (*r[:3], r[3] + 1, r[4])
            h = encode(told)
            for other, left in way + top:
                h = sha(other + h if left else h + other)
            out.append((r[0], encode(r), trees[g][0], root, sha("".join(s for s, _ in way + top)), h, h == root))
    return sorted(map(str, out))


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, pos int, total int, h string, id int"


def _manifest(spark, rows, **terms):
    df = spark.createDataFrame([(*r, "x", 1, 2, "y", None) for r in rows], SCHEMA).repartition(3)
    odd = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    out = merkle.manifest(df, claims={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, where=odd, **terms).drop("pos", "total")
    return sorted(str(tuple(r)) for r in out.collect())


@pytest.fixture(scope="module")
def records():
    rng = random.Random(3)
    ids = [*range(0, 40), -5, -(2**63), 2**63 - 1, 10**12, 77, 77, None, None, *(rng.randrange(-(2**40), 2**40) for _ in range(30))]
    rows = [(i, rng.choice(["a", "", None]), rng.choice(["en", "de", "", None, "é", "z" * 70]), rng.choice([0, 5, None, 2**63 - 1]), rng.choice(["t", "", None, "naïve 🙂", "x" * 100_000])) for i in ids]
    return rows + [rows[3]] * 20 + [rows[-1]] * 3


@pytest.mark.parametrize(("block", "digit"), [(12, 3), (2, 1)])
def test_manifest_against_a_plain_tree(spark, records, monkeypatch, block, digit):
    monkeypatch.setattr(merkle, "DIGIT", digit)
    assert _manifest(spark, records, block=block) == plain_manifest(records)


def test_manifest_of_small_tables(spark, records):
    for rows in ([], records[:1], records[:2], [r for r in records if r[2] == "en"][:3], [(7, None, "en", 1, None)] * 5):
        assert _manifest(spark, rows) == plain_manifest(rows)


def test_manifest_of_an_id_with_very_many_unlike_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGIT", 1)
    rows = [(4, None, "en", k, f"t{k}") for k in range(300)] + [(k, None, "en", 1, None) for k in range(9)]
    assert _manifest(spark, rows) == plain_manifest(rows)


def phrases(text):
    seen, p = set(), ""
    for c in text:
        p += c
        if p not in seen:
            seen.add(p)
            p = ""
    return seen


def test_phrases_and_likeness(corpus):
    texts = [t or "" for _, t, *_ in corpus] + ["", "a", "ab", "aaa", "aaaaaaa", "北京北京北京北", "🙂" * 50]
    after = texts[1:] + texts[:1]
    own, other = lz_fingerprint.signatures(texts, after)
    for k, (text, follows) in enumerate(zip(texts, after, strict=True)):
        parser = lz_fingerprint.Parser()
        keep, tail = lz_fingerprint.edited(text, follows)
        ends = parser.feed(text[:keep])
        mine = [0, *ends, *parser.tried(text[keep:])]
        assert {text[a:b] for a, b in zip(mine, mine[1:], strict=False)} == phrases(text)
        rest, changed = [0, *ends, *parser.feed(tail)], text[:keep] + tail
        assert {changed[a:b] for a, b in zip(rest, rest[1:], strict=False)} == phrases(changed)
        a, b = phrases(text), phrases(changed)
        assert abs((own[k] == other[k]).mean() - (len(a & b) / len(a | b) if a | b else 1)) < 0.25
    one, _ = lz_fingerprint.signatures(texts[5:6], [""])
    assert np.array_equal(one[0], own[5])


def test_phrases_forget_after_a_period(monkeypatch):
    monkeypatch.setattr(lz_fingerprint, "PERIOD", 7)
    text = "abababababababababababab"
    want = []
    for a in range(0, len(text), 7):
        part, seen, p = text[a : a + 7], set(), ""
        for k, c in enumerate(part, a + 1):
            p += c
            if p not in seen:
                seen.add(p)
                want.append(k)
                p = ""
        if p and len(part) == 7:
            want.append(a + 7)
    whole, pieces = lz_fingerprint.Parser(), lz_fingerprint.Parser()
    assert whole.feed(text) == want
    assert [x for a in range(0, len(text), 5) for x in (pieces.tried("ba" * 9), pieces.feed(text[a : a + 5]))[1]] == want


@pytest.mark.parametrize("size", [lz_fingerprint.SLICE, 200])
def test_neighbours(spark, corpus, empty, size):
    rows = [(i, t or "") for i, t, *_ in corpus]
    df = spark.createDataFrame([(i, t, "x", 1, "e") for i, t, *_ in corpus], "doc_id long, text string, h string, id int, edge string").repartition(3)
    got = lz_fingerprint.neighbours(df, limit=size).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))  # equal ids in this corpus have equal texts
    after = [t for _, t in order[1:]] + [order[0][1]]
    own, other = lz_fingerprint.signatures([t for _, t in order], after)
    hexed = lambda r: r.astype("<u2").tobytes().hex()
    want = []
    for k, (i, t) in enumerate(order):
        cut = len(t) // 3
        want.append((i, len(t), sha(t[: len(t) - cut] + after[k][:cut]), hexed(own[k]), hexed(other[k]), float((own[k] == other[k]).mean()), float((own[k] == own[(k + 1) % len(order)]).mean())))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert lz_fingerprint.neighbours(empty).count() == 0
    alone = lz_fingerprint.neighbours(df.where("doc_id = 1")).first()
    assert alone.near_next == 1 and alone.doc_id == 1


def test_fingerprints_and_likeness(spark, docs, corpus):
    by = {r.doc_id: r.fingerprint for r in lz_fingerprint.fingerprints(docs).collect()}
    row = spark.createDataFrame([(by[0], by[1])], "a string, b string").select(lz_fingerprint.likeness(F.col("a"), F.col("b")), lz_fingerprint.likeness(F.col("a"), F.col("a"))).first()
    own, _ = lz_fingerprint.signatures([corpus[0][1], corpus[1][1]], ["", ""])
    assert row[0] == (own[0] == own[1]).mean() and row[1] == 1


TERM = re.compile(ranked_search.TERM)


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms_of(text))
    out = []
    for item, words in asked.items():
        scored = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if s > 0:
                scored.append((-s, i is None, i))
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(scored[:top])]
    return sorted(map(str, out))


@pytest.mark.parametrize(("window", "block"), [(ranked_search.WINDOW, ranked_search.BLOCK_TERMS), (7, 5)])
def test_search_against_brute_force(spark, docs, corpus, empty, monkeypatch, window, block):
    monkeypatch.setattr(ranked_search, "WINDOW", window)
    items = [(k, " ".join((corpus[5 * k][1] or "").split()[:9]).upper()) for k in range(8)]
    items += [(3, "the and\x00of"), (90, None), (91, ""), (92, "zzzz-qqqq"), (None, "one Words 北京 NAÏVE x"), (93, "it's ￿ don't_stop 12%% 34"), (94, "the " * 500)]
    asked = spark.createDataFrame([(*r, "d", 5) for r in items], "item_id long, text string, doc_id string, rank int").repartition(2)
    got = sorted(str(tuple(r)) for r in ranked_search.search(docs, asked, block_terms=block).collect())
    want = plain_search([(i, t) for i, t, *_ in corpus], items)
    assert len(want) > 40 and got == want
    assert ranked_search.search(empty, asked).count() == 0 and ranked_search.search(docs, asked.where("1 = 0")).count() == 0


def test_asked_terms_are_compared_by_bytes():
    asked = ranked_search.Asked({0: ["abc", "xy"], 1: ["abc"]})
    n, text, term, counts = asked.pairs(pa.array(["ABC abc. ab xyz,xy", None, "", "xy"]))
    assert n.tolist() == [5, 0, 0, 1]
    assert [(t, asked.words[w], c) for t, w, c in zip(text.tolist(), term.tolist(), counts.tolist(), strict=True) if t == 3] == [(3, b"xy", 1)]
    assert Counter({asked.words[w]: c for t, w, c in zip(text.tolist(), term.tolist(), counts.tolist(), strict=True) if t == 0}) == {b"abc": 2, b"xy": 1}
    asked.h[:] = 0  # as if all hashes were one: nothing may match by hash alone
    asked.h[1] = 1
    assert asked.pairs(pa.array(["zz zz"]))[1].size == 0
