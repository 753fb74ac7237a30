"""Offline analysis, the live engine and the operators around them."""

import json

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import baseline, evaluate, ocular, windows
from pulsegrid.operators.analyze import analyze
from pulsegrid.sources import packets, synth
from pulsegrid.streaming import engine


@pytest.fixture(scope="module")
def cohort(spark):
    return synth.frames(spark, synth.cohort(2, seconds=40.0)).cache()


def test_known_rates_are_recovered(spark, cohort):
    a = analyze(cohort, 30.0, stride_s=2.0).toPandas()
    truth = cohort.groupBy("recording_id").agg(F.avg("hr").alias("gt")).toPandas()
    m = a.merge(truth, on="recording_id")
    assert len(a) == 22 and m.valid.all()
    assert (m["hr_pred"] - m["gt"]).abs().median() < 6


def test_invalid_frames_refuse_with_a_reason(spark, cohort):
    a = analyze(cohort.withColumn("valid", F.lit(False)), 30.0, stride_s=5.0).toPandas()
    assert set(a.reason) == {"insufficient_valid_frames"} and a.hr_pred.isna().all() and a.hr_bpm.isna().all()


def test_refused_windows_keep_their_would_be_rate(spark, cohort):
    a = analyze(cohort.withColumn("face", F.lit(0.0)).withColumn("lighting", F.lit(0.0)).withColumn("motion", F.lit(0.0)).withColumn("compression", F.lit(0.0)), 30.0, stride_s=5.0).toPandas()
    assert set(a.reason) == {"low_quality"} and a.hr_bpm.notna().all() and a.hr_pred.isna().all()


def test_live_engine_equals_offline(spark, cohort):
    a = analyze(cohort, 30.0, stride_s=1.0).where("recording_id = 0").toPandas().sort_values("end_s")
    pdf = cohort.where("recording_id = 0").orderBy("i").toPandas()
    e, out = engine.Engine(30.0), []
    for i, row in zip(pdf["i"], pdf[["r", "g", "b", "valid", *engine.QUALITY]].astype(object).values.tolist(), strict=True):
        out += e.push(int(i), row)
    assert len(out) == len(a)
    assert max(abs(x["hr_bpm"] - y) for x, y in zip(out, a.hr_bpm, strict=True)) < 1e-9


def test_engine_drops_duplicates_and_puts_frames_in_order(spark, cohort):
    pdf = cohort.where("recording_id = 1").orderBy("i").toPandas()
    rows = pdf[engine.COLUMNS].astype(object).values.tolist()
    straight, moved = engine.Engine(30.0, calibration_s=24.0), engine.Engine(30.0, calibration_s=24.0)
    a = [s for i, r in enumerate(rows) for s in straight.push(i, r)]
    order = list(range(len(rows)))
    order[10], order[12] = order[12], order[10]
    b = [s for i in order for s in moved.push(i, rows[i]) + moved.push(i, rows[i])]
    many = engine.Engine(30.0, calibration_s=24.0)
    c = many.push_many(order[:700], engine._rows(pdf)[order[:700]]) + many.push_many(order[650:], engine._rows(pdf)[order[650:]])
    assert len(a) == len(b) == len(c) == 21
    for x, y, z in zip(a, b, c, strict=True):
        assert x == y and x.keys() == z.keys() and x["reason"] == z["reason"] and abs(x["hr_bpm"] - z["hr_bpm"]) < 1e-9
    assert a[-1]["calibrated"] and a[-1]["arousal_bpm"] is not None and a[0]["reason"] == "calibrating"
    assert set(a[0]["quality"]) == {"overall", "face", "lighting", "motion", "compression", "valid_frame_ratio"}


GOOD = [100.0, 90.0, 80.0, True, 0.9, 0.9, 0.9, 0.9, 1.0]


def test_leaps_make_nothing_up():
    e = engine.Engine(4.0, 5.0, patience=3)
    out = [s for i in range(30) for s in e.push(i, GOOD)]
    assert [s["t"] for s in out] == [5.0, 6.0, 7.0]
    assert e.push(10**12, GOOD) == [] and e.n == 30  # one corrupt index waits
    more = [s for i in range(30, 40) for s in e.push(i, GOOD)]
    assert [s["t"] for s in more] == [8.0, 9.0, 10.0]
    assert e.drain() == [] and e.n == 40 and not e.waiting  # and is dropped in the end
    resumed = [s for i in range(5000, 5044) for s in e.push(i, GOOD)]
    assert [s["t"] for s in resumed] == [1255.0, 1256.0, 1257.0, 1258.0, 1259.0, 1260.0, 1261.0]  # a whole window later, none for the pause
    assert e.push(39, GOOD) == [] and e.push(4000, GOOD) == []
    short = engine.Engine(4.0, 5.0, patience=3)
    held = [s for i in [*range(22), *range(26, 40)] for s in short.push(i, GOOD)]
    assert [s["t"] for s in held] == [5.0, 6.0, 7.0, 8.0, 9.0, 10.0] and held[2]["reason"] == "signal_gap_too_long"


def _live(spark, schema, folder, name, **options):
    stream = spark.readStream.schema(schema).parquet(str(folder / "in"))
    q = engine.states(stream, 4.0, window_s=5.0, patience=3, **options).writeStream.option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start(str(folder / name), "parquet")
    q.awaitTermination(180)


def _timed(spark, rows):
    """(session, i, seconds) as frames."""
    at = F.timestamp_micros((F.lit(1e15) + F.col("s") * 1e6).cast("long")).alias("ts")
    frame = [F.lit(v).alias(c) for c, v in zip(engine.COLUMNS, GOOD, strict=True)]
    return spark.createDataFrame(rows, "session_id long, i long, s double").select("session_id", "i", at, *frame).repartition(1)


def test_a_session_that_resumes_repeats_nothing(spark, tmp_path):
    """Idle sessions are flushed, give up their traces and keep their clock; repeated, late and far frames change nothing."""
    parts = [
        [(1, i, i / 4) for i in [*range(24), *range(26, 29)]] + [(2, i, i / 4) for i in range(24)],
        [(2, i, 200.0 + i / 4) for i in range(24, 48)] + [(None, 0, 1.0)],  # the watermark passes session 1 by a minute
        [(1, i, 300.0 + i / 4) for i in [*range(0, 24), *range(40, 70)]] + [(1, 10**12, 300.0)],
    ]
    for part in parts:
        frames = _timed(spark, part)
        frames.write.mode("append").parquet(str(tmp_path / "in"))
        _live(spark, frames.schema, tmp_path, "out")
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert len(got) == len(got[["session_id", "t"]].drop_duplicates())
    # 1: ticks at 20 and 24; the flush brings 28; then 11 missing frames from 29 on, and a tick every 4 frames after a whole window
    assert sorted(got[got.session_id == 1].t * 4) == [20, 24, 28, *range(52, 69, 4)]
    assert sorted(got[got.session_id == 2].t * 4) == [*range(20, 49, 4)]
    assert got.quality.map(lambda q: dict(q)["valid_frame_ratio"]).between(0, 1).all()


def test_a_restart_gives_the_same_samples(spark, cohort, tmp_path):
    f = cohort.withColumnRenamed("recording_id", "session_id").withColumn("ts", F.timestamp_micros((F.lit(1e15) + F.col("i") * 1e6 / 30).cast("long"))).select("session_id", "i", "ts", *engine.COLUMNS)
    got = []
    for name, cuts in (("one", [0, 2000]), ("three", [0, 500, 741, 2000])):
        at = tmp_path / name
        for a, b in zip(cuts, cuts[1:], strict=False):
            f.where((F.col("i") >= a) & (F.col("i") < b)).write.mode("append").parquet(str(at / "in"))
            stream = spark.readStream.schema(f.schema).parquet(str(at / "in"))
            engine.states(stream, 30.0, calibration_s=24.0).writeStream.option("checkpointLocation", str(at / "ck")).trigger(availableNow=True).start(str(at / "out"), "parquet").awaitTermination(180)
        got.append(spark.read.parquet(str(at / "out")).orderBy("session_id", "t").toPandas())
    one, three = got
    assert len(one) == 2 * 21 and one.hr_bpm.notna().all() and one.calibrated.any()
    for c in one.columns.drop("quality"):
        assert [x if isinstance(x, str) else round(float(x), 6) if x is not None else None for x in one[c]] == [x if isinstance(x, str) else round(float(x), 6) if x is not None else None for x in three[c]] or one[c].isna().equals(three[c].isna())
    assert (one.hr_bpm - three.hr_bpm).abs().max() < 1e-6 and (one.reason.fillna("") == three.reason.fillna("")).all()


def test_packets(spark):
    rows = [
        (1, json.dumps({"rgb": [1, 2, 3], "valid": True, "face": 0.5})),
        (2, "{}"),
        (3, json.dumps({"rgb": None, "valid": True})),
        (4, json.dumps({"rgb": [1, 2], "valid": True})),
        (5, json.dumps({"rgb": "x", "valid": True, "motion": "bad"})),
        (6, json.dumps({"frames": [{"rgb": [1, 2, 3], "valid": True}, {"rgb": [4, 5, 6], "valid": False}]})),
        (7, json.dumps({"frames": []})),
        (8, json.dumps({"close": True})),
        (9, None),
    ]
    out = packets.parse(spark.createDataFrame(rows, "id int, json string")).toPandas().sort_values(["id", "at"])
    assert out.id.tolist() == [1, 2, 3, 4, 5, 6, 6]
    assert out.valid.tolist() == [True, False, False, False, False, True, False]
    assert out.motion.tolist() == [1.0] * 7 and out.face.tolist()[0] == 0.5


def test_hop_windows_only_full_ones(spark):
    f = spark.createDataFrame([(1, i) for i in range(25)] + [(2, i) for i in range(9)], "recording_id int, i long")
    w = windows.hop_windows(f, 10, 5).groupBy("recording_id", "start").count().toPandas()
    assert sorted(zip(w.recording_id, w.start, w["count"], strict=True)) == [(1, 0, 10), (1, 5, 10), (1, 10, 10), (1, 15, 10)]


def test_gap_fill_holds_the_edges(spark):
    rows = [(1, i, None if not v else float(i), v) for i, v in enumerate([False, True, False, False, True, False])]
    out = windows.gap_fill(spark.createDataFrame(rows, "recording_id int, i long, x double, valid boolean")).orderBy("i").toPandas()
    assert out.filled.tolist() == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_baseline_needs_three_confident_windows(spark):
    rows = [(1, 20.0 + 2 * k, 60.0 + k, True, 0.9) for k in range(5)] + [(2, 20.0, 60.0, True, 0.9), (2, 22.0, 61.0, True, 0.3), (2, 24.0, 62.0, False, 0.9)]
    w = spark.createDataFrame(rows, "session_id int, end_s double, hr_bpm double, valid boolean, confidence double")
    b = baseline.fit(w, features=("hr_bpm",)).toPandas()
    assert b.session_id.tolist() == [1] and b.location[0] == 62.0
    rel = baseline.transform(w, baseline.fit(w, features=("hr_bpm",)), "hr_bpm").toPandas()
    assert rel[rel.session_id == 2].relative.isna().all()
    with pytest.raises(ValueError):
        baseline.transform(w, w, "hr_bpm", "ratio")


def test_event_matching_is_greedy_and_one_to_one(spark):
    d = spark.createDataFrame([(1, 103), (1, 303), (2, 160), (2, 360), (3, 100), (3, 101)], "key int, t int")
    t = spark.createDataFrame([(1, 100), (1, 300), (2, 100), (2, 300), (3, 100), (4, 5)], "key int, t int")
    m = {r.key: r.tp for r in evaluate.match_events(d, t, 9.0).collect()}
    assert m == {1: 2, 2: 0, 3: 1, 4: 0}


def test_blinks(spark):
    x = [40.0] * 600
    for at, width in ((60, 5), (200, 6), (203, 1), (350, 1), (500, 60)):
        x[at : at + width] = [16.0] * width
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "recording_id int, i long, openness double")
    b = ocular.blinks(s, 30.0).toPandas()
    assert sorted(b.start) == [60, 200]
    sparse = s.withColumn("openness", F.when(F.col("i") % 5 == 0, F.col("openness")))
    assert ocular.ocular_stats(sparse, 30.0).first().reason == "eye_region_unusable"


def test_text_sources(spark, tmp_path):
    from pulsegrid.sources import datasets

    for s in ("a", "b"):
        (tmp_path / s).mkdir()
        (tmp_path / s / "ground_truth.txt").write_text("1 2 3 4\n70 71 72 73\n0.0 0.5 1.0 1.5\n")
    rec, rows = datasets.load(spark, "three_row_text", str(tmp_path))
    assert {r.recording_id: r.fps for r in rec.collect()} == {"a": 2.0, "b": 2.0}
    assert rows.count() == 8
    with pytest.raises(ValueError):
        datasets.load(spark, "none", "x")
    assert set(datasets.available()) >= {"three_row_text", "nested_json", "task_csv", "keyed_csv"}


