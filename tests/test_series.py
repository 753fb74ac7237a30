"""As-of joins and interpolation across range borders, exact quantiles by counting, matching of long recordings, grouping sets."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import align, evaluate, ranks, studies


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    left, right = [], []
    for key in (1, 2, None, 5):
        right += [(key, round(rng.uniform(0, 100), 1), rng.choice([None, rng.uniform(-5, 5)])) for _ in range(60 if key != 5 else 0)]
        left += [(key, rng.choice([None, round(rng.uniform(-10, 110), 1)]), f"r{k}") for k in range(80)]
    right += [(7, 50.0, 1.0), (1, None, 3.0)]
    left += [(7, 50.0, "at"), (7, 49.9, "before"), (7, 99.0, "after"), (8, 1.0, "none")]
    unique = list({(k, t): (k, t, x) for k, t, x in right}.values())
    return left, unique, spark.createDataFrame(left, "key int, t double, name string").repartition(7), spark.createDataFrame(unique, "key int, t double, x double").repartition(5)


@pytest.mark.parametrize("parts", ["3", "40"])
def test_asof_and_interpolation(spark, series, parts):
    left, right, l, r = series  # noqa: E741
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many ranges, most of them tiny
    try:
        got = sorted(map(str, (tuple(x) for x in align.asof(l, r, ["key"], "t", ["x"], within=9.0).collect())))
        want = []
        for key, t, name in left:
            near = max(((rt, x) for k, rt, x in right if k == key and rt is not None and t is not None and rt <= t), default=(None, None), key=lambda p: p[0])
            near = (None, None) if near[0] is None or t - near[0] > 9 else near
            want.append(str((key, t, name, *near)))
        assert got == sorted(want)
        got = {(x.key, x.name): x.x for x in align.interpolated(l, r, ["key"], "t", "x").where("t IS NOT NULL").collect()}
        for key, t, name in left:
            pairs = sorted((rt, x) for k, rt, x in right if k == key and rt is not None and x is not None)
            if t is not None and not pairs:
                assert got[key, name] is None
            elif t is not None:
                assert abs(got[key, name] - np.interp(t, *zip(*pairs, strict=True))) < 1e-9
        torn = align.interpolated(l, r, ["key"], "t", "x", longest=1.0).where("key = 1 AND x IS NULL AND t > 10 AND t < 90").count()
        assert torn > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    none = l.where("1 = 0")
    assert align.asof(none, r, ["key"], "t", ["x"]).count() == 0 and align.asof(l, r.where("1 = 0"), ["key"], "t", ["x"]).where("x IS NOT NULL").count() == 0


def test_uneven_stamps_on_an_even_base(spark):
    rng = np.random.default_rng(6)
    t = np.sort(rng.uniform(0, 20, 400))
    s = spark.createDataFrame([(1, float(a), float(np.sin(a))) for a in t], "key int, t double, x double")
    out = align.resampled(s, ["key"], "t", "x", 25.0).orderBy("i").toPandas()
    assert len(out) == int((t[-1] - t[0]) * 25) + 1 and np.abs(out.x - np.sin(out.t)).max() < 0.02
    assert np.allclose(np.diff(out.t), 0.04) and np.allclose(out.x, np.interp(out.t, t, np.sin(t)))


@pytest.mark.parametrize("few", [ranks.FEW, 3])
def test_quantiles_by_counting(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "CUTS", 4 if few == 3 else ranks.CUTS)
    rng = random.Random(8)
    groups = {
        "even": [rng.uniform(-1, 1) for _ in range(200)], "odd": [rng.gauss(0, 100) for _ in range(151)], "wild": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(120)], "same": [2.5] * 90,
        "two": [1.0] * 50 + [2.0] * 50, "zero": [0.0, -0.0] * 20 + [1e-320, -1e-320] * 21, "one": [7.0], "pair": [1.0, 4.0], None: [3.0, 1.0, 2.0], "ends": [-1.7e308, 1.7e308] * 6, "near": [1 + k * 2e-16 for k in range(60)],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("none", None), ("even", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    for q in (0.5, 0.9, 0.0, 1.0):
        got = {r.g: r.m for r in ranks.quantiles(df, ["g"], "x", q, "m").collect()}
        want = {r.g: r.m for r in df.groupBy("g").agg(F.percentile("x", F.lit(q)).alias("m")).collect()}
        assert got.keys() == want.keys()
        for g in want:
            assert (got[g] is None) == (want[g] is None) and (got[g] is None or got[g] == want[g] or abs(got[g] - want[g]) <= 1e-12 * abs(want[g])), (g, q)
    assert ranks.quantiles(df, [], "x").first()[0] == df.select(F.percentile("x", F.lit(0.5))).first()[0]
    assert ranks.quantiles(df.where("1 = 0"), ["g"], "x").count() == 0


def test_study_medians_of_many_sessions(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 5)
    sessions = spark.range(400).select(F.col("id").alias("session_id"), F.when(F.col("id") < 300, 1).when(F.col("id") < 399, 2).alias("study_id"))
    samples = spark.range(1200).select((F.col("id") % 400).alias("session_id"), (F.col("id") * 7919 % 1009 / 10.0).alias("hr_bpm"), F.lit(None).cast("string").alias("reason")).where("session_id <> 5")
    got = {r.study_id: r.median_hr for r in studies.study_aggregate(sessions, samples).collect()}
    per = sessions.join(samples.groupBy("session_id").agg(F.median("hr_bpm").alias("m")), "session_id", "left")
    assert got == {r.study_id: round(r.m, 6) for r in per.groupBy("study_id").agg(F.median("m").alias("m")).collect()} and set(got) == {1, 2, None}


def plain_matches(times, truths, tolerance):
    left, hits = sorted(truths), 0
    for x in sorted(times):
        best = min(left, key=lambda t: (abs(t - x), t), default=None)
        if best is not None and abs(best - x) <= tolerance:
            left.remove(best)
            hits += 1
    return hits


def test_matching_against_all_pairs(spark):
    rng = random.Random(12)
    d, t = {}, {}
    for key in (*range(30), None):
        span = rng.choice([20, 300])
        d[key] = [round(rng.uniform(0, span), 1) for _ in range(rng.randint(0, 40))]
        t[key] = [round(rng.uniform(0, span), 1) for _ in range(rng.randint(0, 40))]
    rows = lambda x: spark.createDataFrame([(k, v) for k, vs in x.items() for v in vs] + [(1, None)], "key int, t double").repartition(4)
    got = {r.key: (r.n_detected, r.n_truth, r.tp) for r in evaluate.match_events(rows(d), rows(t), 2.5).collect()}
    assert got == {k: (len(d[k]), len(t[k]), plain_matches(d[k], t[k], 2.5)) for k in d if d[k] or t[k]}
    assert evaluate.match_events(rows(d).where("1 = 0"), rows(t).where("1 = 0"), 1.0).count() == 0


def test_a_million_events_of_one_key(spark):
    n = 500_000
    d = spark.range(n).select(F.lit("one").alias("key"), (F.col("id") * 10.0 + F.col("id") % 3).alias("t"))
    t = spark.range(n).select(F.lit("one").alias("key"), (F.col("id") * 10.0).alias("t"))
    began = time.time()
    assert evaluate.match_events(d, t, 1.5).first().tp == len([k for k in range(n) if k % 3 < 2])
    assert time.time() - began < 60


def test_subgroups_are_one_expand(spark, capsys):
    rows = [(k, "a" if k % 2 else None, 18 + k % 3, True, 10, 8, 2.0 + k) for k in range(12)]
    s = spark.createDataFrame(rows, "recording_id int, sex string, age int, usable boolean, n_windows long, n_valid long, mae_all double")
    out = evaluate.subgroup_metrics(s, ["sex", "age"])
    out.explain()
    assert capsys.readouterr().out.count("Expand") == 1
    got = {(r.key, r.value): (r.n_subjects, r.median_mae_all) for r in out.collect()}
    assert got == {("sex", "a"): (6, 8.0), ("age", "18"): (4, 6.5), ("age", "19"): (4, 7.5), ("age", "20"): (4, 8.5)}
