"""The pipeline's stages against brute force: which rows are left, word for word."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from pulsegrid.llm import common, language_id, mixing, tokens

from .test_corpus import library_ids
from .test_near import brute
from .test_pairs import WORD, clashing


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def survivors(rows):
    """(doc_id, text) of each component's least id; rows without words all stay."""
    worded = [r for r in rows if WORD.findall(r[1] or "")]
    # brute force names rows by place, so that ids may repeat or lack
    least = brute([(k, t) for k, (_, t, _) in enumerate(worded)], 5, 0.8)
    groups = {}
    for k, r in enumerate(worded):
        groups.setdefault(least[k], []).append(r)
    return groups, [r for r in rows if not WORD.findall(r[1] or "")]


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    """Each stage's input and output tables, written and read again."""
    at = tmp_path_factory.mktemp("pipeline")
    more = docs.where("doc_id IN (5, 9)").selectExpr("doc_id", "concat(text, ' and a few words that nothing else has at all ', doc_id) AS text", "lang", "source", "h", "n")
    docs.unionByName(more).write.parquet(str(at / "documents.parquet"))  # repeated ids with other texts
    now = spark.read.parquet(str(at / "documents.parquet"))
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(at)).write.parquet(str(at / name))
        nxt = spark.read.parquet(str(at / name))
        out.append((name, now, nxt))
        now = nxt
    return at, out


def test_stages_keep_the_right_rows(spark, stages):
    at, both = stages
    for name, before, after in both:
        if name != "packing":
            assert after.columns == before.columns
        old, new = rows_of(before), rows_of(after) if name != "packing" else None
        if name == "language_id":
            no = language_id.fit(before).predict(pa.array([t for _, t, _ in old], pa.string()))[2]
            assert Counter(new) == Counter(r for r, bad in zip(old, no, strict=True) if not bad)
        elif name == "exact_dedup":
            best = {}
            for i, t, s in old:
                k = t or ""
                if k not in best or (i is not None and (best[k] is None or i > best[k])):
                    best[k] = i
            assert Counter((i, t or "") for i, t, _ in new) == Counter((i, t) for t, i in best.items())
        elif name == "ngram_join":
            groups, plain = survivors(old)
            want = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
            assert Counter(i for i, _, _ in new) == Counter(i for i, _, _ in want + plain)
            assert Counter(new) <= Counter(old)
        elif name == "mixing":
            taken = Counter()
            for r in mixing.mix(before).collect():
                taken[r.source] += r.taken
            words = Counter()
            for _, t, s in new:
                words[s] += len(WORD.findall(t or ""))
            assert words == taken and {i for i, _, _ in new} <= {i for i, _, _ in old}
            texts = {(i, tuple(WORD.findall(t or ""))) for i, t, _ in old}
            assert all(any(w == full[: len(w)] for k, full in texts if k == i) for i, w in ((i, tuple(WORD.findall(t or ""))) for i, t, _ in new))
        else:
            pieces = Counter()
            for i, t, _ in old:
                ids = library_ids(tokens.BYTE_BPE, t, 0)
                pieces.update((i, s, min(1024, len(ids) - s), len(ids)) for s in range(0, len(ids), 1024))
            assert Counter((r.doc_id, r.start, r.length, r.doc_tokens) for r in after.collect()) == pieces
            ends = {}
            for r in after.orderBy("sequence_id", "offset").collect():
                assert r.offset == ends.get(r.sequence_id, 0)
                ends[r.sequence_id] = r.offset + r.length
            assert max(ends.values()) <= 1024 and np.mean(list(ends.values())) > 800


def test_runs_agree(spark, stages):
    at, both = stages
    run = lambda: Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(at)).collect())
    assert run() == run() == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in both[-1][2].collect())


def test_stages_carry_clashing_columns_and_empty_tables(spark):
    df, data = clashing(spark, [(k, f"the quick brown fox number {k} jumps over lazy dogs " * 3, "s") for k in range(6)])
    df = df.selectExpr("*", "CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'de' END AS lang")
    for rows in (df, df.where("1 = 0")):
        now = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = common.staged(stage(spark, now, ""), "clash")
            assert now.columns == df.columns
        corpus_pipeline.pack(spark, now, "").collect()
        assert {r.id for r in now.collect()} <= {r[3] for r in data}


def test_staged_tables_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "work_dir", lambda spark: str(tmp_path))
    common.staged(spark.range(3).toDF("x"), "some")
    assert (tmp_path / "pulsegrid").exists()
    common.clean_up(spark)
    assert not (tmp_path / "pulsegrid").exists()
