"""The study store's contract and the pixel stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scoring as sc
from pulsegrid.functions import signal_np as sig
from pulsegrid.functions import vision_np as vi
from pulsegrid.operators import ingest
from pulsegrid.operators.store import ConsentError, SessionConfig, Store

ALL = ["camera", "measurements"]


def samples(spark, session, n=4, reason=None, hr=70.0):
    return spark.createDataFrame([(session, float(k), hr + k, 0.8, reason) for k in range(n)], "session_id string, t double, hr_bpm double, confidence double, reason string")


def test_store_lifecycle(spark, tmp_path):
    s = Store(spark, str(tmp_path), notice=("2", "what we record"))
    study = s.create_study("calm", 30)
    a, b = s.create_session(study), s.create_session(study, external_ref="p2")
    with pytest.raises(ConsentError):
        s.append_samples(samples(spark, a))
    with pytest.raises(ConsentError):
        s.grant(a, "1", ALL)
    with pytest.raises(ConsentError):
        s.grant(a, "2", ["camera"])
    for x in (a, b):
        s.grant(x, "2", ALL)
        s.append_samples(samples(spark, x))
    s.append_samples(samples(spark, a, 2, hr=90.0))  # replaces t = 0 and 1
    assert s.read("samples").where(F.col("session_id") == a).count() == 4
    s.mark(a, 1.5, "start")
    row = s.export(a).first()
    assert [x.hr_bpm for x in row.samples] == [90.0, 91.0, 72.0, 73.0] and row.marks[0].label == "start" and row.scopes == ALL
    agg = s.aggregate(study).first()
    assert (agg.n_sessions, agg.n_usable, agg.answered_ratio) == (2, 2, 1.0)
    s.withdraw(a)
    again = Store(spark, str(tmp_path), notice=("2", ""))
    assert again.read("sessions").select("session_id").collect() == [(b,)]
    assert again.read("samples").select("session_id").distinct().collect() == [(b,)] and again.read("marks").count() == 0
    again.withdraw(b, erase=False)
    assert again.read("samples").count() == 0 and again.read("sessions").first().withdrawn_at is not None
    assert again.aggregate(study).count() == 0
    assert again.purge_expired(now=4e9) == 1 and again.read("sessions").count() == 0
    assert again.list_studies().count() == 1


def test_bounds():
    for bad in ({"fps": 0}, {"fps": 121}, {"window_s": 4.9}, {"emit_hz": 5.1}, {"calibration_s": -1}):
        with pytest.raises(ValueError):
            SessionConfig(**bad)


def test_a_study_needs_bounds_and_sessions_a_study(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    for bad in (("", 30), ("x", 0), ("x", 731)):
        with pytest.raises(ValueError):
            s.create_study(*bad)
    with pytest.raises(KeyError):
        s.create_session("nope")


def frame(tone, background=20, shape=(96, 128)):
    y, x = np.mgrid[: shape[0], : shape[1]]
    f = np.full((*shape, 3), background, np.uint8)
    f[((y - 48) / 40) ** 2 + ((x - 64) / 32) ** 2 <= 1] = tone
    return f


@pytest.mark.parametrize("tone", [(198, 158, 140), (157, 117, 102), (76, 54, 43), (46, 34, 26)])
def test_colour_of_each_tone(tone):
    got = vi.Faces(frame(tone)[None], [(32, 8, 64, 80)]).colours()[0]
    assert np.allclose(got["rgb"], tone, atol=1e-9) and got["skin_fraction"] > 0.7


def test_hairlines_move_foreheads_in_a_batch():
    """Faces whose hair ends at different rows, one without skin and one hardly on the frame, measured together and alone."""
    tone, hair = np.array([180, 140, 120], np.uint8), np.array([20, 15, 10], np.uint8)
    frames = np.tile(tone, (5, 180, 150, 1))
    for k, rows in enumerate((35, 40, 85)):
        frames[k, :rows] = hair
    frames[3] = (0, 0, 255)
    boxes = np.array([(15, 10, 120, 150)] * 4 + [(148, 178, 120, 150)], float)
    faces = vi.Faces(frames, boxes)
    assert faces.hairlines()[:3].tolist() == [35, 40, 85]
    tops = faces.regions()[0, :, 1]
    assert np.allclose(tops[:2], [(35 - 10) / 150 + 0.06, (40 - 10) / 150 + 0.06]) and tops[2] == vi.REGIONS["forehead"][1]  # the third would meet the eyes
    both = faces.colours()
    assert both[4] is None
    for k in range(3):
        assert np.allclose(both[k]["rgb"], tone) and both[k] | {"rgb": 0} == vi.Faces(frames[k : k + 1], boxes[k : k + 1]).colours()[0] | {"rgb": 0}
    assert both[0]["skin_fraction"] > both[2]["skin_fraction"]
    bare = vi.Faces(frames[:1], boxes[:1])
    bare.skin = np.zeros_like(bare.skin)
    assert np.isnan(bare.hairlines()).all() and bare.colours() == [None]


def test_frame_quality_measures():
    rng = np.random.default_rng(0)
    noisy = rng.integers(60, 200, (64, 64, 3)).astype(np.uint8)
    blocks = np.kron(rng.integers(60, 200, (8, 8, 3)), np.ones((8, 8, 1))).astype(np.uint8)
    assert vi.blockiness(blocks) > 10 > 0.5 > vi.blockiness(noisy)
    grey = np.repeat(noisy[..., :1], 3, axis=2)
    assert vi.chroma_ratio(grey) < 0.01 < vi.chroma_ratio(noisy)
    assert vi.detail(noisy) > 100 > vi.detail(np.full((64, 64, 3), 90, np.uint8))
    assert vi.exposure(np.full((64, 64, 3), 255, np.uint8)) == (255.0, 1.0)
    assert vi.eye_openness(noisy, (0, 0, 64, 64)) > vi.eye_openness(np.full((64, 64, 3), 90, np.uint8), (0, 0, 64, 64)) == 0
    assert vi.eye_openness(noisy, (0, 0, 8, 8)) is None
    assert vi.skin_locus(frame((198, 158, 140))).any()


def test_pixel_stage_to_frame_rows(spark):
    schema = "recording_id long, i long, pixels binary, height int, width int, face struct<x:double,y:double,w:double,h:double>"
    pix = frame((157, 117, 102))
    face = (32.0, 8.0, 64.0, 80.0)
    rows = [(1, i, pix.tobytes(), 96, 128, None if i == 2 else (face[0] + (3.2 if i == 4 else 0), *face[1:])) for i in range(6)]
    out = ingest.trace(ingest.measure(spark.createDataFrame(rows, schema))).orderBy("i").toPandas()
    assert out.valid.tolist() == [True, True, False, True, True, True]
    assert np.allclose(out.r[out.valid], 157) and out.r.isna().tolist() == [False, False, True, False, False, False]
    assert out.compression.nunique() == 1 and out.motion.tolist()[3] == 1.0 and abs(out.motion.tolist()[4] - 0.375) < 1e-9


def test_scores_keep_nulls_apart(spark):
    row = spark.range(1).select(sc.clip(F.lit(None).cast("double")).alias("a"), sc.pulse_quality(F.lit(10.0), F.lit(None).cast("double")).alias("b"), sc.motion(F.lit(1.0), F.lit(0.0)).alias("c"), sc.age_band(F.lit(29.5)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (None, 0.0, 0.0, None)


def test_spectral_cross_entropy_prefers_the_true_rate():
    t = np.arange(600) / 30
    x = np.sin(2 * np.pi * 1.2 * t)[None]
    loss = [sig.spectral_cross_entropy(x, np.array([b]), 30.0)[0] for b in (60.0, 72.0, 90.0)]
    assert loss[1] < loss[0] and loss[1] < loss[2]


def test_imports_without_a_session_and_without_the_corpus_part():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['pulsegrid.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'study_aggregate' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
