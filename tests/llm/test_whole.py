"""Corpus operators take in the whole input: all labelled rows, whole blocks, and the terms they are given."""

import random
import re

import numpy as np
import pyarrow as pa

from pulsegrid.llm import html_text, toxicity

from .conftest import prose


def test_toxicity_counts_all_labelled_rows(spark):
    """An expression that stands in labelled rows far beyond the sample is known, and counts equal those of one pass."""
    rng = random.Random(6)
    rows = [(i, prose(rng, "en", 30) + (f" zq{i}xv" if i % 2 else ""), i % 2) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, sample=30)
    kept = {r.doc_id for r in docs.where(toxicity.fold(docs.doc_id, 3) != 1).collect()}
    keys, _ = toxicity._counts([r[1] for r in rows if r[0] in kept])
    assert np.array_equal(model.grams.keys, keys)
    for toxic in (0, 1):
        own, _ = toxicity._counts([r[1] for r in rows if r[0] in kept and r[2] == toxic])
        assert len(own) and np.isin(own, model.grams.keys).all()
    seen = [f"zq{i}xv" for i in sorted(kept) if i % 2]
    assert (model.evidence(pa.array(seen))[:, 1] > 0).all() and model.weights.any()


def test_html_telling_words_count_in_the_middle_of_a_block():
    filler = "lorem ipsum dolor sit amet " * 12
    path = (("div", ()),)
    for word, kind in (("consent", "cookie"), ("all rights reserved", "rights"), ("sponsored", "ad"), ("newsletter", "act"), ("posted by", "talk")):
        assert f"says:{kind}" in html_text.features([(f"{filler}{word} {filler}".strip(), path, 0.0)])[0]
    assert not [f for f in html_text.features([((filler * 2).strip(), path, 0.0)])[0] if f.startswith("says:")]
    # an article's long paragraph that merely mentions such words stays text
    field = html_text.train(250)
    paragraphs = [f"{filler}{word} {filler}end." for word in ("sea", "privacy", "copyright", "comments", "search", "promoted", "sky")]
    page = f"<nav><a href='/x'>m</a></nav><article><h1>T</h1>{''.join(f'<p>{p}</p>' for p in paragraphs)}</article><footer>&copy; x</footer>"
    assert html_text.main_text(page, field).split("\n\n") == ["T", *paragraphs]


def test_toxicity_by_textbook_counts():
    """Log ratios of a small corpus against interpolated Kneser-Ney written out with dictionaries."""
    from collections import Counter, defaultdict

    order, d = toxicity.ORDER, toxicity.DISCOUNT
    texts = {1: ["You ugly fool", "fool, foolish scum!", "ugly"], 0: ["the old fountain", "a foot of you", "The beauty of it"]}
    counts = {0: Counter(), 1: Counter()}
    for c, each in texts.items():
        for word in re.findall(r"[a-z]+", " ".join(each).lower()):
            padded = " " * (order - 1) + word + " "
            counts[c].update(padded[i : i + order] for i in range(len(word) + 1))
    longer, lower = set(counts[0]) | set(counts[1]), {}
    for n in range(order - 1, 0, -1):
        seen = Counter(g[-n:] for g in longer)  # distinct n-grams one longer
        total, kinds = defaultdict(int), Counter(g[:-1] for g in seen)
        for g, k in seen.items():
            total[g[:-1]] += k
        lower[n] = seen, total, kinds
        longer = set(seen)

    def shared(gram):
        p = 1 / 256
        for n in range(1, order):
            seen, total, kinds = lower[n]
            g = gram[-n:]
            if total[g[:-1]]:
                p = max(seen[g] - d, 0) / total[g[:-1]] + d * kinds[g[:-1]] / total[g[:-1]] * p
        return p

    def own(c, gram):
        total = sum(k for g, k in counts[c].items() if g[:-1] == gram[:-1])
        kinds = sum(g[:-1] == gram[:-1] for g in counts[c])
        if not total:
            return shared(gram)
        return max(counts[c][gram] - d, 0) / total + d * kinds / total * shared(gram)

    both = [toxicity._counts(texts[c]) for c in (0, 1)]
    grams = np.union1d(both[0][0], both[1][0])
    n = np.zeros((2, len(grams)))
    for c, (keys, count) in enumerate(both):
        n[c, np.searchsorted(grams, keys)] = count
    model = toxicity._model(grams, *n)
    spelt = {int.from_bytes(g.encode(), "big"): g for g in counts[0] | counts[1]}
    assert sorted(spelt) == model.grams.keys.tolist()
    want = [np.log(own(1, spelt[k]) / own(0, spelt[k])) for k in model.grams.keys.tolist()]
    assert np.allclose(model.grams.values[:-1], want)
    unseen = "     z", " foolx", "fools "
    for g in unseen:  # neither class has it: what is left of its context decides
        key = np.array([int.from_bytes(g[-order:].rjust(order).encode(), "big")], np.uint64)
        got = model.contexts.get(key >> np.uint64(8))[0]
        gram = g[-order:].rjust(order)
        assert abs(got - np.log(own(1, gram) / own(0, gram))) < 1e-9
