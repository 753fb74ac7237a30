"""Candidate components that chance agreements chain together: cut by sketches, without losing a link."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pulsegrid.llm import ngram_join

from .test_near import brute


def _chain(rng, k):
    """Texts of two of a few passages each, which many texts share; some copies with an edit; and texts of mostly one passage."""
    word = lambda: f"w{rng.randint(0, 9000)}"
    passages, common = [[word() for _ in range(30)] for _ in range(k // 3)], [word() for _ in range(25)]
    chosen = rng.sample([(a, b) for b in range(k // 3) for a in range(b)], k)
    texts = [passages[a] + passages[b] for a, b in chosen]
    for i in range(0, k, 6):
        copy = list(texts[i])
        copy[7 + i % 11] = word()
        texts.append(copy)
    for i in range(20):  # mostly the common passage: some within the similarity of each other, some just beyond
        texts.append(common + [word() for _ in range(1 + i % 5)])
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("sketch_bytes", [ngram_join.SKETCH_BYTES, 700])
def test_a_chain_moves_only_sets_that_may_link(spark, monkeypatch, sketch_bytes):
    rows = _chain(random.Random(4), 60)
    want = brute(rows, 5, 0.8)
    sets, cand, real = [], [], ngram_join.staged
    monkeypatch.setattr(ngram_join, "staged", lambda df, name: [out := real(df, name), {"sets": sets, "candidates": cand}.get(name, []).append(out)][0])
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(ngram_join, "SKETCH_BYTES", sketch_bytes)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=5, threshold=0.8).collect()}
    assert got == want
    assert cand[0].count() > 60 and cand[0].groupBy("comp").count().agg({"count": "max"}).first()[0] > 40
    linked = sum(list(want.values()).count(x) > 1 for x in want.values())
    assert linked <= sets[0].count() <= linked + 8


@pytest.mark.parametrize("t", [0.9, 0.8, 0.5])
def test_sketches_never_deny_a_link(t):
    rng, terms = np.random.default_rng(2), ngram_join.Terms.of(5, t)
    sets, denied, apart = [], 0, 0
    for n in (1, 2, 31, 32, 33, 60, 64, 65, 150, 400, 3000):
        for _ in range(12):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            y = np.r_[x[rng.integers(0, n // 2 + 1) :], rng.integers(0, 1 << 63, rng.integers(0, n // 3 + 1), dtype=np.uint64)]
            sets += [np.sort(x), np.sort(y)]
    n = np.array([len(s) for s in sets])
    sketches = ngram_join.Sketches(ngram_join.odd_sketches(np.concatenate(sets), np.r_[0, np.cumsum(n)]), n, terms)
    i, j = np.triu_indices(len(sets), 1)
    ok = sketches.allow(i, j)
    for a, b, may in zip(i, j, ok, strict=True):
        if not may:
            denied += 1
            assert not ngram_join.similar(sets[a], sets[b], terms)
        else:
            apart += not len(np.intersect1d(sets[a], sets[b])) and min(n[a], n[b]) > 8
    assert denied > 0.9 * len(ok) and (t < 0.8 or apart == 0)


@pytest.mark.parametrize("pairs", [1, 7, 1 << 17])
def test_parts_join_whatever_sketches_allow(monkeypatch, pairs):
    """Two parts of families of near sets: one task joins each part's families and no others, and no labels it was given twice."""
    monkeypatch.setattr(ngram_join, "PAIRS", pairs)
    rng, terms = np.random.default_rng(3), ngram_join.Terms.of(5, 0.8)
    sets, family = [], []
    for f in range(9):
        base = rng.integers(0, 1 << 63, 100 + 20 * f, dtype=np.uint64)
        for _ in range(5):
            sets.append(np.sort(np.r_[base[:-2], rng.integers(0, 1 << 63, 2, dtype=np.uint64)]))
            family.append(f)
    n = np.array([len(s) for s in sets])
    raw = ngram_join.odd_sketches(np.concatenate(sets), np.r_[0, np.cumsum(n)])
    k, family = len(sets), np.array(family)
    cls, label = np.arange(k) + 1000, np.arange(k) + 1000
    label[1] = label[0]
    order = rng.permutation(2 * k)
    both = lambda x: pa.array(np.r_[x, x][order])
    sig = np.r_[np.zeros(k, np.int64), np.ones(k, np.int64)][order]
    table = pa.table({"sig": sig, "cls": both(cls), "label": both(label), "n": both(n), "block": both(cls % 2), "sketch": pa.array([(raw + raw)[i] for i in order], pa.binary())})
    for b, c in ((0, 0), (0, 1)):
        out = ngram_join._group_task(terms, (5, b, c), table)
        root = {x: x for x in cls.tolist()} | {1001: 1000}
        for u, v in zip(out.column("u").to_pylist(), out.column("v").to_pylist(), strict=True):
            assert family[u - 1000] == family[v - 1000] and (b == c or u % 2 != v % 2)
            root = {x: root[u] if r == root[v] else r for x, r in root.items()}
        assert all(len({root[x] for x in cls[family == f].tolist()}) == 1 for f in range(9))
        assert out.num_rows == k - 1 - 9  # a forest
    cross = ngram_join._cross_task(terms, (0,), table)
    got = set(zip(cross.column("u").to_pylist(), cross.column("v").to_pylist(), strict=True))
    fits = lambda a, b: 10 * min(n[a], n[b]) >= 8 * max(n[a], n[b])
    assert cross.num_rows == len(got) and got == {(1000 + a, 1000 + b) for a in range(k) for b in range(a + 1, k) if label[a] != label[b] and fits(a, b)}
