"""The signal queries read the given events: every recording with a full window, whatever its length."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import analyze
from pulsegrid.plans import catalog
from pulsegrid.sources import synth


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Recordings of 39, 40, 66 and 900 events."""
    path = str(tmp_path_factory.mktemp("traces"))
    sizes = {1: 39, 2: 40, 3: 66, 4: 900}
    rows = [(u * 10_000 + j, 1_700_000_000 + 7 * j, u, "error" if j % 9 == 4 else "view", float((j * 37 + u * 11) % 200), f'{{"k": {(j * 13 + u) % 101}}}') for u, n in sizes.items() for j in range(n)]
    e = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    e.select("event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value", "props").repartition(5).write.parquet(f"{path}/events.parquet")
    return path


WINDOWS = {2: 1, 3: 6, 4: 173}


@pytest.mark.parametrize("name", ["bvp_features", "chrom_bvp", "green_bvp", "gt_window_hr"])
def test_every_recording_has_its_windows(spark, sf, name):
    out = catalog.queries()[name](spark, sf)
    assert {r.recording_id: r["count"] for r in out.groupBy("recording_id").count().collect()} == WINDOWS
    assert out.where("hr_bpm IS NOT NULL" if name != "gt_window_hr" else "hr_gt IS NOT NULL").select("recording_id").distinct().count() == 3


def test_benchmark_counts_all_windows(spark, sf):
    assert {r.method: r.n_windows for r in catalog.queries()["run_benchmark"](spark, sf).collect()} == dict.fromkeys(["pos", "chrom", "green"], sum(WINDOWS.values()))


def test_stream_samples_every_recording(spark, sf):
    out = catalog.queries()["stream_state"](spark, sf)
    assert {r.session_id: r["count"] for r in out.groupBy("session_id").count().collect()} == {2: 1, 3: 4, 4: 108}


def test_blocks_change_nothing(spark, monkeypatch):
    f = synth.frames(spark, synth.cohort(1, seconds=40.0))
    whole = analyze.window_features(f, 30.0, 4.0, 0.5).orderBy("start_s").toPandas()
    monkeypatch.setattr(analyze, "BLOCK", 130)
    assert analyze.window_features(f, 30.0, 4.0, 0.5).orderBy("start_s").toPandas().round(9).equals(whole.round(9)) and len(whole) == 73
