"""What the n-gram join moves."""

import random

from pyspark.sql import functions as F

from pulsegrid.llm import ngram_join


def _near(spark, monkeypatch, rows):
    """The plan that gives the links between classes and their heads, and the texts that became sets."""
    seen, sets = [], []
    real_components, real_staged = ngram_join.components, ngram_join.staged
    monkeypatch.setattr(ngram_join, "components", lambda edges: seen.append(edges) or real_components(edges))
    monkeypatch.setattr(ngram_join, "staged", lambda df, name: (sets.append(df) if name == "sets" else None) or real_staged(df, name))
    out = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=5, threshold=0.8)
    return out, seen[0]._jdf.queryExecution().executedPlan().toString(), sets[0]._jdf.queryExecution().optimizedPlan().toString()


def _rows():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(40)]
    return [(k, t) for k, t in enumerate(texts)] + [(100 + k, t + " end") for k, t in enumerate(texts[:5])]


def test_parts_are_cut_and_dealt_once(spark, monkeypatch):
    out, near, _ = _near(spark, monkeypatch, _rows())
    near = near.split("== Initial Plan ==")[-1]
    assert near.count("MapInArrow") == 1
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(k, k) for k in range(40)} | {(100 + k, k) for k in range(5)}


def test_only_texts_that_may_speak_move(spark, monkeypatch):
    _, _, sets = _near(spark, monkeypatch, _rows())
    assert "bitmap" in sets.lower()


def test_a_bitmap_finds_all_its_keys_and_few_others(spark, monkeypatch):
    keys = spark.range(3000).select(F.xxhash64("id").alias("k"))
    for slots in (1 << 15, 1 << 26):
        monkeypatch.setattr(ngram_join, "BITMAP_SLOTS", slots)
        bits = ngram_join._bitmap(keys, F.col("k"))
        slot = ngram_join._slot(F.col("k"))
        asked = spark.range(6000).select("id", F.xxhash64("id").alias("k")).join(F.broadcast(bits), F.bitmap_bucket_number(slot) == F.col("bucket"))
        got = {r.id for r in asked.where(ngram_join._holds(F.col("bits"), F.bitmap_bit_position(slot))).select("id").collect()}
        assert set(range(3000)) <= got and len(got) < 3600
