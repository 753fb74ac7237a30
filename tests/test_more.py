"""Window stamps and truth, eye sweeps, sources, the store's commits, idle sessions and the commands."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid import cli
from pulsegrid.functions import vision_np as vi
from pulsegrid.operators import analyze as an
from pulsegrid.operators import baseline, ocular, store
from pulsegrid.operators.store import Store
from pulsegrid.sources import datasets, synth
from pulsegrid.streaming import engine


def test_uneven_stamps_lower_quality_and_confidence(spark, monkeypatch):
    f = synth.frames(spark, [synth.Config(0, seconds=16.0)])
    jitter = f.withColumn("t", F.col("t") + F.when(F.col("i") % 7 == 3, 0.025).otherwise(0.0))
    even, uneven = (an.analyze(x, 30.0, 8.0, 1.0).orderBy("start_s").toPandas() for x in (f, jitter))
    assert np.allclose(even.fps_stability, 1) and (uneven.fps_stability < 0.8).all() and (uneven.fps_stability > 0.2).all()
    assert (uneven.quality < even.quality).all() and (uneven.confidence < even.confidence).all() and uneven.hr_bpm.equals(even.hr_bpm)
    dt = np.diff(jitter.where("i < 240").orderBy("i").toPandas().t)
    assert abs(uneven.fps_stability[0] - (1 - dt.std() / dt.mean())) < 1e-9
    # windows by the handful give what windows all at once give
    monkeypatch.setattr(an, "SLICE_FRAMES", 1)
    assert an.analyze(f, 30.0, 8.0, 1.0).orderBy("start_s").toPandas().round(9).equals(even.round(9))


def test_each_window_has_its_own_truth(spark):
    f = synth.frames(spark, [synth.Config(0, seconds=30.0, drift_bpm=20.0)])
    w = an.analyze(f, 30.0, 10.0, 5.0, truth="hr").toPandas()
    hr = f.orderBy("i").toPandas().hr.to_numpy()
    for r in w.itertuples():
        s = round(r.start_s * 30)
        assert abs(r.gt - hr[s : s + 300].mean()) < 1e-9
    assert w["gt"].max() - w["gt"].min() > 3 and (w.hr_bpm - w["gt"]).abs().median() < 3


def test_degradations_by_axis(spark):
    for name in synth.AXES:
        f = synth.frames(spark, synth.axis(name, levels=4, n=1, seconds=24.0))
        w = an.analyze(f, 30.0, 10.0, 2.0, truth="hr").groupBy("recording_id").agg(F.avg("confidence").alias("c")).orderBy("recording_id").toPandas()
        assert w.c.iloc[0] > 0.6 and w.c.iloc[-1] < 0.8 * w.c.iloc[0], (name, w.c.tolist())
    with pytest.raises(ValueError):
        synth.axis("fog")


def test_blink_sweep_scores(spark):
    f = synth.frames(spark, [synth.Config(0, seconds=40.0), synth.Config(1, seconds=40.0, base_hr=90.0)])
    eyes, times = cli.blinking(f)
    got = {r.drop_ratio: r for r in ocular.sweep_scores(eyes, times, 30.0, (0.3, 0.75)).collect()}
    assert got[0.75].f1 == 1.0 and (got[0.3].n_detected, got[0.3].recall, got[0.3].f1) == (0, 0.0, 0.0)
    each = ocular.blinks(eyes, 30.0, 0.75)
    both = ocular.blink_sweep(eyes, 30.0, (0.3, 0.75)).where("drop_ratio = 0.75").drop("drop_ratio")
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, both.collect()))
    rate = {r.recording_id: r.per_minute for r in ocular.blink_rates(eyes, each, 30.0).collect()}
    assert rate == pytest.approx({0: 9 * 60 / 40, 1: 9 * 60 / 40})


def test_baselines_that_fail_say_why(spark):
    data = [("late", 99.0, True, 0.9, 70.0), *[("refused", float(k), False, 0.9, 70.0) for k in range(5)], *[("unsure", float(k), True, 0.1, 70.0) for k in range(5)], *[("gaps", float(k), True, 0.9, 70.0 if k < 2 else None) for k in range(5)], *[("fine", float(k), True, 0.9, 70.0) for k in range(5)]]
    df = spark.createDataFrame(data, "session_id string, end_s double, valid boolean, confidence double, hr_bpm double")
    got = {r.session_id: (r.n, r.reason) for r in baseline.reasons(df, features=("hr_bpm",)).collect()}
    assert got == {"late": (0, "no_windows"), "refused": (0, "refused"), "unsure": (0, "low_confidence"), "gaps": (2, "too_few")}
    assert {r.session_id for r in baseline.fit(df, features=("hr_bpm",)).collect()} == {"fine"}


def test_small_frames_have_block_edges():
    frame = np.zeros((16, 16, 3), np.uint8)
    frame[:, 8:] = 90
    assert vi.blockiness(frame) > 1 and vi.blockiness(frame[:15, :15]) == 0.0


def test_text_sources(spark, tmp_path):
    for s in ("s1", "s2"):
        (tmp_path / s).mkdir()
    (tmp_path / "s1" / "a.xmp").write_text("".join(f"{k * 20},{70 + k % 3},98,{k % 7}\n" for k in range(50)) + "stamp,rate,spo2,wave\n")
    rec, rows = datasets.load(spark, "oximeter_xmp", str(tmp_path))
    assert rec.first().n_samples == 50 and abs(rec.first().fps - 50) < 1e-9
    assert [r.bvp for r in rows.orderBy("j").limit(8).collect()] == [0, 1, 2, 3, 4, 5, 6, 0]
    (tmp_path / "s2" / "eda_s2_T1.csv").write_text("0.5\n0.6\nx\n0.7\n")
    eda = datasets.skin_conductance(spark, str(tmp_path)).orderBy("j").collect()
    assert [(r.recording_id, r.task, r.t, r.eda) for r in eda] == [("s2_T1", "T1", 0.0, 0.5), ("s2_T1", "T1", 0.25, 0.6), ("s2_T1", "T1", 0.5, None), ("s2_T1", "T1", 0.75, 0.7)]


def test_image_sequences_go_by_number(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    for k in (2, 10, 1):
        (tmp_path / "r1" / f"frame{k}.png").write_bytes(bytes([k]))
    (tmp_path / "r1" / "notes.txt").write_text("no frame")
    got = datasets.image_sequence(spark, str(tmp_path), 10.0).orderBy("i").collect()
    assert [(r.recording_id, r.i, r.t, bytes(r.content)) for r in got] == [("r1", 0, 0.0, b"\x01"), ("r1", 1, 0.1, b"\x02"), ("r1", 2, 0.2, b"\x0a")]


def _filled(spark, root):
    s = Store(spark, root)
    a, b = s.create_session(), s.create_session()
    for x in (a, b):
        s.grant(x, "1", ["camera", "measurements"])
        s.append_samples(spark.createDataFrame([(x, 0.0, 70.0, 0.9, None)], "session_id string, t double, hr_bpm double, confidence double, reason string"))
    return s, a, b


def test_erasure_survives_a_crash(spark, tmp_path, monkeypatch):
    s, a, b = _filled(spark, str(tmp_path))
    sessions = lambda x: {r.session_id for r in x.read("samples").collect()}
    with monkeypatch.context() as m:  # before the commit: nothing happened, and the new folders are litter
        m.setattr(Store, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            s.withdraw(a)
    assert sessions(Store(spark, str(tmp_path))) == {a, b}
    with monkeypatch.context() as m:  # after the commit, before the old folders are deleted
        m.setattr(Store, "_sweep", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            s.withdraw(a)
    kept = lambda: {r.session_id for r in spark.read.parquet(*[str(p) for p in (tmp_path / "samples").rglob("bucket=*")]).select("session_id").collect()}
    assert sessions(s) == {b} and kept() == {a, b}
    again = Store(spark, str(tmp_path))  # opening finishes the deletion
    assert sessions(again) == {b} and kept() == {b}


def test_writers_see_each_other_and_do_not_overwrite(spark, tmp_path, monkeypatch):
    s, a, b = _filled(spark, str(tmp_path))
    other = Store(spark, str(tmp_path))
    other.mark(a, 1.0, "seen")
    assert s.read("marks").first().label == "seen"
    old = s._manifest()
    s.mark(a, 2.0, "newer")
    with pytest.raises(RuntimeError):
        other._commit(*old)
    s.close_session(b)
    assert s.read("sessions").where(F.col("session_id") == b).first().closed_at is not None
    for bad in (b, "nobody"):
        with pytest.raises(KeyError):
            s.close_session(bad)
    before = sorted(map(tuple, s.read("samples").collect()))
    s.compact()
    assert sorted(map(tuple, s.read("samples").collect())) == before and len(list((tmp_path / "sessions").iterdir())) == 1
    assert all(len({n for n in names if n.endswith(f"={k}")}) <= 1 for names in s._manifest()[1].values() for k in range(16))


SAMPLE = "session_id string, t double, hr_bpm double, confidence double, reason string"


def test_opening_a_store_leaves_live_writers_alone(spark, tmp_path, monkeypatch):
    s, a, b = _filled(spark, str(tmp_path))
    rows = spark.createDataFrame([(a, 1.0, 71.0, 0.9, None)], SAMPLE)
    draft = s._write("samples", rows)
    Store(spark, str(tmp_path))  # opens between a write and its commit
    number, names = s._manifest()
    s._commit(number, names | {"samples": [*names["samples"], *draft]})
    assert s.read("samples", a).count() == 2
    late = s._write("samples", rows)
    monkeypatch.setattr(store, "LEASE_S", -1.0)  # as if hours had passed
    Store(spark, str(tmp_path))
    number, names = s._manifest()
    with pytest.raises(RuntimeError, match="is gone"):
        s._commit(number, names | {"samples": [*names["samples"], *late]})
    assert s.read("samples").count() == 3  # nothing that is listed went


def test_a_withdrawal_while_samples_are_written_counts(spark, tmp_path, monkeypatch):
    s, a, b = _filled(spark, str(tmp_path))
    other, write = Store(spark, str(tmp_path)), Store._write
    both = spark.createDataFrame([(a, 5.0, 71.0, 0.9, None), (b, 5.0, 72.0, 0.9, None)], SAMPLE)

    def meanwhile(self, table, rows):
        out = write(self, table, rows)
        if self is s and table == "samples":
            monkeypatch.setattr(Store, "_write", write)
            other.withdraw(a)
        return out

    monkeypatch.setattr(Store, "_write", meanwhile)
    s.append_samples(both, consenting=True)
    assert {(r.session_id, r.t) for r in s.read("samples").collect()} == {(b, 0.0), (b, 5.0)}
    with pytest.raises(store.ConsentError):
        s.append_samples(both)


def test_a_batch_is_taken_in_once_and_erasure_touches_one_partition(spark, tmp_path):
    s, a, b = _filled(spark, str(tmp_path))
    rows = lambda v: spark.createDataFrame([(b, 9.0, v, 0.9, None)], SAMPLE)
    for number, value in ((0, 70.0), (1, 71.0), (0, 99.0), (1, 99.0)):
        s.append_samples(rows(value), batch=("stream", number))
    assert s.read("samples", b).where("t = 9").first().hr_bpm == 71.0
    ids = [f"s{k}" for k in range(60)]
    s._append("samples", spark.createDataFrame([(i, 0.0, 70.0, 0.9, None) for i in ids], SAMPLE))
    before = set(s._manifest()[1]["samples"])
    s.withdraw("s7")
    after = set(s._manifest()[1]["samples"])
    assert len({n.rsplit("=")[1] for n in before - after}) == 1 and len(after - before) == 1 and before & after
    assert {r.session_id for r in s.read("samples").collect()} == {a, b, *ids} - {"s7"}
    plan = s.read("samples", "s8")._jdf.queryExecution().simpleString()
    assert s.read("samples", "s8").count() == 1 and len(s.read("samples", "s8").inputFiles()) <= 3 < len(s.read("samples").inputFiles()) and "session_id" in plan


def test_an_idle_session_is_flushed(spark):
    e = engine.Engine(4.0, 5.0)
    frame = [100.0, 90.0, 80.0, True, 0.9, 0.9, 0.9, 0.9, 1.0]
    for i in [*range(10), *range(12, 24)]:
        assert e.push(i, frame) == []
    late = e.drain()
    assert [x["t"] for x in late] == [5.0, 6.0] and not e.waiting and e.n == 24


def test_commands(capsys, tmp_path, monkeypatch, spark):
    monkeypatch.setattr(cli, "build_session", lambda *a: spark)
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    run = lambda *a: (cli.main(list(a)), capsys.readouterr().out)
    code, out = run("bench", "--methods", "pos,green", "--limit", "2", "--duration", "14", "--window", "8", "--out", str(tmp_path / "r.json"))
    rows = json.loads(out)
    assert code == (0 if any(r["go"] for r in rows) else 1) and len(rows) == 2 and all({"go_mae", "go_coverage", "go_capture", "capture_ratio"} <= set(r) for r in rows)
    assert json.loads((tmp_path / "r.json").read_text()) == rows
    code, out = run("sweep", "--axis", "motion", "--limit", "4", "--duration", "14", "--window", "8")
    assert code == 0 and {r["axis"] for r in json.loads(out)} == {"motion"} and {r["level"] for r in json.loads(out)} == {0, 1}
    code, out = run("ocular", "--limit", "1", "--duration", "30")
    assert max(r["f1"] for r in json.loads(out)) == 1.0
    code, out = run("ablate", "--limit", "2", "--duration", "40", "--window", "8")
    assert code == 0 and set(json.loads(out)[0]) >= {"raw", "baselined", "within", "delta", "gap_recovered"}
    code, out = run("readiness", "--limit", "2", "--duration", "5", "--table")
    assert code == 0 and out.splitlines()[0].startswith("recording_id")
