"""Exact dedup, substring dedup and the n-gram join against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import exact_dedup, mixing, ngram_join, substring_dedup
from pulsegrid.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact_groups(docs, corpus, empty):
    groups = defaultdict(list)
    for i, t, *_ in corpus:
        groups[t or ""].append(i)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(corpus)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    kept = Counter()
    for r in got:
        ids = groups[by_sha[r.text_sha256]]
        top = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size) == (top, len(ids))
        assert not r.kept or r.doc_id == top
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup.exact_groups(empty).count() == 0
    out = exact_dedup.drop_exact(docs)
    assert out.columns == docs.columns and out.count() == len(groups)


def test_small_buckets_split_and_own_their_rows(docs, corpus):
    index = exact_dedup.Index(docs, "doc_id", "text", 2)
    rows = index.entries.collect()
    assert len({r.bucket for r in rows}) > 8 and index.depth > 3
    # a bucket is the range of hashes that share its first bits
    width = {r.bucket: 64 - r.local_depth for r in rows}
    for r in rows:
        first = r.bucket << (64 - index.depth)
        assert first <= r.h % (1 << 64) < first + (1 << width[r.bucket])
    for c in (1, 3, 4096):
        got = sorted(map(tuple, exact_dedup.exact_groups(docs, capacity=c).drop("bucket").collect()), key=str)
        assert got == sorted(map(tuple, exact_dedup.exact_groups(docs).drop("bucket").collect()), key=str)


def test_hashes_that_collide_are_chained_by_their_bytes(docs, corpus, monkeypatch):
    keyed = exact_dedup._keyed
    monkeypatch.setattr(exact_dedup, "_keyed", lambda *a: keyed(*a).withColumn("h", F.pmod("h", F.lit(3)) * (1 << 61)))
    got = exact_dedup.exact_groups(docs, capacity=4).collect()
    assert len({r.text_sha256 for r in got}) == len({t or "" for _, t, *_ in corpus}) and max(r.chain for r in got) > 5
    sizes = Counter(t or "" for _, t, *_ in corpus)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in sizes}
    assert all(r.group_size == sizes[by_sha[r.text_sha256]] for r in got) and sum(r.kept for r in got) == len(sizes)


def test_hot_texts_fold_before_they_move(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 4)
    df = spark.range(40).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'hot', concat('t', id % 7)) AS text")
    got = exact_dedup.exact_groups(df).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id % 2 == 0} == {(38, 20)} and sum(r.kept for r in got) == 8


#: Columns that bear names which operators could use for themselves.
CLASHES = ["id", "h", "t", "n", "sha", "key", "source ", "part", "row", "size", "copy", "taken", "cls", "comp", "block", "bucket", "__id", "__sha", "__n", "_id", "text_sha256", "tie", "th", "root", "a.b", "`q`", "component_id"]


def clashing(spark, rows):
    """(doc_id, text, source) rows with those columns, whose values name the row."""
    data = [(*r, *(f"{k}-{c}" for c in range(len(CLASHES)))) for k, r in enumerate(rows)]
    names = ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHES)
    return spark.createDataFrame(data, f"doc_id long, text string, source string, {names}"), data


def test_clashing_names_keep_their_values(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [" ".join(words[k:] + words[:k]) for k in range(8)]
    df, data = clashing(spark, [(k, texts[k % 8], "s") for k in range(10)] + [(20, None, None)])
    whole = {tuple(r) for r in data}
    for out, ids in ((exact_dedup.drop_exact(df), {2, 3, 4, 5, 6, 7, 8, 9, 20}), (ngram_join.keep_one(df, n=5, threshold=0.8), {*range(8), 20})):
        assert out.columns == df.columns
        rows = {tuple(r) for r in out.collect()}
        assert rows <= whole and {r[0] for r in rows} == ids
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    assert {r[:1] + r[2:] for r in map(tuple, mixed.collect())} <= {r[:1] + r[2:] for r in whole}
    for other in (exact_dedup.exact_groups(df), mixing.mix(df), ngram_join.jaccard_components(df), substring_dedup.remove_repeats(df)):
        assert other.count() == 11


def test_repeated_ids_lose_no_text(spark):
    a, b, c = ("one two three four five six seven", "quite another text that is not like it at all", "a third text which stands alone in this small world")
    rows = [(1, a), (5, a), (5, b), (5, c), (5, c), (None, b), (None, "a text without any id or copy of its own here"), (7, ""), (7, ""), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, ngram_join.keep_one(df, n=5, threshold=0.8).collect()), key=str)
    assert kept == sorted([(1, a), (5, b), (5, c), (None, rows[6][1]), (7, ""), (7, ""), (8, None)], key=str)
    kept = sorted(map(tuple, exact_dedup.drop_exact(df).collect()), key=str)
    assert sorted(t or "" for _, t in kept) == sorted({t or "" for _, t in rows}) and (5, a) in kept and (5, b) in kept


def test_near_copies_without_an_id_are_linked(spark):
    words = [f"w{k}" for k in range(200)]
    other = [*words[:100], "changed", *words[101:]]
    df = spark.createDataFrame([(None, " ".join(words)), (4, " ".join(other)), (9, " ".join(words[::-1])), (None, "no id at all")], "doc_id long, text string")
    got = ngram_join.jaccard_components(df).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, 4), (4, 4), (9, 9), (None, None)}
    assert {r.doc_id for r in ngram_join.keep_one(df).collect()} == {4, 9, None} and ngram_join.keep_one(df).count() == 3


def test_mixed_rows_write_what_the_mix_takes(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 6), " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 12))), rng.choice(["a", "b", None])) for _ in range(60)]
    df = spark.createDataFrame(rows + rows[:9], "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r.source] += r.taken
    for parts in (1, 5):
        written = Counter()
        for r in mixing.mixed_rows(df.repartition(parts)).collect():
            written[r.source] += len(WORD.findall(r.text))
        assert written == taken


def test_components_that_do_not_settle_are_an_error(spark):
    with pytest.raises(RuntimeError):
        components(spark.range(300).selectExpr("id AS u", "id + 1 AS v"), max_rounds=1)


def brute_repeats(rows, n):
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    words = [WORD.findall(t or "") for _, t in rows]
    for k in order:
        for s in range(len(words[k]) - n + 1):
            seen.setdefault(tuple(words[k][s : s + n]), (rows[k][0], s))
    for k, (i, _) in enumerate(rows):
        gone = [False] * len(words[k])
        for s in range(len(words[k]) - n + 1):
            if seen[tuple(words[k][s : s + n])] != (i, s):
                gone[s : s + n] = [True] * n
        out.append((i, len(words[k]), sum(gone), " ".join(w for w, g in zip(words[k], gone, strict=True) if not g)))
    return sorted(out, key=str)


def check_repeats(df, rows, n):
    got = substring_dedup.remove_repeats(df, min_words=n).collect()
    mine = sorted(((r.doc_id, r.n_words, sum(x.stop - x.start for x in r.removed), r.kept_text) for r in got), key=str)
    assert mine == brute_repeats(rows, n)


def test_substring_dedup(docs, corpus, empty):
    check_repeats(docs, [r[:2] for r in corpus], 20)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_within_a_document_and_at_odd_lengths(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(99, "x y z " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (5, 13, 26):
        check_repeats(df, rows, n)


def test_levels_double():
    assert substring_dedup.levels(20) == [10, 20] and substring_dedup.levels(50) == [7, 13, 25, 50] and substring_dedup.levels(8) == [8]


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return sorted([(i, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=i)) for k, (i, _) in enumerate(rows)], key=str)


def test_ngram_components(docs, corpus, empty):
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()], key=str)
    assert got == brute_components([r[:2] for r in corpus])
    assert ngram_join.jaccard_components(empty).count() == 0
    assert ngram_join.keep_one(docs).columns == docs.columns


def test_ngram_large_components_go_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for g in range(3):
        base = [f"w{g}x{rng.randint(0, 999)}" for _ in range(80)]
        for j in range(40):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(80)] = f"v{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(500 + k, f"short text {k % 2}") for k in range(6)]
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 500)
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()], key=str)
    assert got == brute_components(rows)


def test_parts_never_lose_a_link():
    """Any two sets at the threshold share a sent part, for all sizes: sets differ as much as they may."""
    rng = np.random.default_rng(0)
    for n in [1, 2, 5, 9, 10, 17, 18, 26, 27, 44, 45, 80, 150, 333, 1000]:
        for _ in range(12):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            drop = rng.integers(0, n // 10 + 1)
            y = x[drop:]
            room = int(len(y) / 0.9 + 1e-9) - n
            y = np.r_[y, rng.integers(0, 1 << 63, max(0, rng.integers(0, max(1, room + 1))), dtype=np.uint64)]
            common = len(np.intersect1d(x, y))
            if 19 * common < 9 * (len(x) + len(y)):
                continue
            h, bounds = np.r_[np.sort(x), np.sort(y)], np.array([0, len(x), len(x) + len(y)])
            sig, doc = ngram_join.part_signatures(h, bounds)
            assert np.intersect1d(sig[doc == 0], sig[doc == 1]).size


def test_short_texts_are_one_shingle():
    h, bounds = ngram_join.shingle_sets(pa.array(["", None, "a", "A", "a b", "a b c", "a b c d"]))
    assert np.diff(bounds).tolist() == [0, 0, 1, 1, 1, 1, 2] and h[bounds[2]] == h[bounds[3]] != h[bounds[4]]


def test_components_of_a_long_path(spark):
    e = spark.range(200).selectExpr("id AS u", "id + 1 AS v").union(spark.sql("SELECT 1000L AS u, 1001L AS v"))
    got = {r.node: r.root for r in components(e).collect()}
    assert got == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000}
