"""The n-gram join under other terms than op3's, and the pipeline's stage, against brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from pulsegrid.llm import ngram_join

from .test_pairs import WORD


def brute(rows, n, t):
    """Least id of each row's component."""
    t, sets, least = Fraction(str(t)), [], [i for i, _ in rows]
    for _, text in rows:
        w = WORD.findall(text.lower())
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    for _ in range(len(rows)):
        was = list(least)
        for a in range(len(rows)):
            for b in range(a):
                if least[a] != least[b] and sets[a] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                    low, high = sorted((least[a], least[b]))
                    least = [low if x == high else x for x in least]
        if was == least:
            break
    return {i: x for (i, _), x in zip(rows, least, strict=True)}


@pytest.fixture(scope="module")
def near():
    """Families of copies with edits around both thresholds, inserted and dropped passages, all lengths, one passage in all."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randint(0, 4000)}"
    passage, rows = [word() for _ in range(14)], []
    for size in (3, 5, 8, 12, 20, 33, 60, 110, 200, 420):
        base = [word() for _ in range(size)] + (passage if size > 40 else [])
        for j in range(7):
            w, at = list(base), rng.randrange(size)
            if j in (1, 2, 3):
                for _ in range(max(1, size * j // 90)):
                    w[rng.randrange(len(w))] = word()
            elif j == 4:
                w[at:at] = [word() for _ in range(max(1, size * 18 // 100))]
            elif j == 5:
                del w[at : at + max(1, size * 15 // 100)]
            elif j == 6:
                w += [word() for _ in range(size // 4)]
            rows.append((len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "t"), [(5, 0.8), (3, 0.9), (2, 0.7), (4, 1.0)])
def test_components_under_other_terms(spark, near, monkeypatch, n, t):
    df = spark.createDataFrame(near, "doc_id long, text string")
    want = brute(near, n, t)
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df, n=n, threshold=t).collect()} == want
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df, n=n, threshold=t).collect()} == want


def test_pipeline_stage_keeps_one_of_near_copies(spark, near):
    df = spark.createDataFrame(near, "doc_id long, text string")
    want = brute(near, 5, 0.8)
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, df, "").collect()}
    assert kept == set(want.values()) and kept != set(brute(near, 3, 0.9).values())


@pytest.mark.parametrize("t", [0.9, 0.8, 0.7, 0.5])
def test_parts_never_lose_a_link_at_any_threshold(t):
    rng = np.random.default_rng(1)
    terms = ngram_join.Terms.of(5, t)
    for n in [1, 3, 4, 7, 12, 15, 16, 19, 20, 23, 24, 31, 45, 80, 150, 400]:
        for _ in range(40):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            y = x[rng.integers(0, terms.differing(n) + 1) :]
            y = np.r_[y, rng.integers(0, 1 << 63, rng.integers(0, max(1, terms.differing(n) - (n - len(y)) + 1)), dtype=np.uint64)]
            if not len(y) or not ngram_join.similar(np.sort(x), np.sort(y), terms):
                continue
            sig, doc = ngram_join.part_signatures(np.r_[np.sort(x), np.sort(y)], np.array([0, len(x), len(x) + len(y)]), terms)
            assert np.intersect1d(sig[doc == 0], sig[doc == 1]).size
