"""Recordings as a data source and a stream, measured stamps on an even base, and the incremental cache of image traces."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import align, ingest
from pulsegrid.sources import datasets, recordings

from .test_images import picture, png


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    recordings.register(spark)


def _subject(root, name, n, shift=0.0):
    (root / name).mkdir(exist_ok=True)
    rows = [[f"{np.sin(k):.4f}" for k in range(n)], [str(60 + k % 7) for k in range(n)], [f"{shift + k / 30:.4f}" for k in range(n)]]
    (root / name / "ground_truth.txt").write_text("\n".join(" ".join(r) for r in rows) + "\n")


def test_reading_filters_and_stretches(spark, tmp_path):
    for k in range(5):
        _subject(tmp_path, f"s{k}", 90 + k)
    read = lambda **o: spark.read.format("recordings").options(**o).load(str(tmp_path))
    assert read().count() == sum(90 + k for k in range(5))
    _, rows = datasets.load(spark, "three_row_text", str(tmp_path))
    both = [sorted(map(tuple, x.select("recording_id", "j", "t", "bvp", "hr").collect())) for x in (read(), rows)]
    assert both[0] == both[1]
    one = read().where("recording_id = 's3' AND t >= 1 AND t < 2")
    assert one.rdd.getNumPartitions() == 1 and {r.recording_id for r in one.collect()} == {"s3"} and one.count() == 30
    assert read().where(F.col("recording_id").isin("s0", "s4", "none")).rdd.getNumPartitions() == 2
    assert read(chunk="300").rdd.getNumPartitions() > 20
    assert sorted(map(tuple, read(chunk="300").select("recording_id", "j", "bvp").collect())) == sorted(map(tuple, read().select("recording_id", "j", "bvp").collect()))
    assert read().where("recording_id = 'nobody'").count() == 0
    with pytest.raises(Exception, match="unknown layout"):
        read(layout="none").count()


def test_other_layouts(spark, tmp_path):
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "x.xmp").write_text("stamp,rate,sat,wave\n2000,71,98,0.5\n1000,70,98,0.25\nbad\n3000,,98,0.75\n")
    got = spark.read.format("recordings").option("layout", "oximeter_xmp").load(str(tmp_path)).orderBy("t").collect()
    assert [(r.recording_id, r.j, r.t, r.bvp, r.hr) for r in got] == [("p1", 0, 1.0, 0.25, 70.0), ("p1", 1, 2.0, 0.5, 71.0), ("p1", 2, 3.0, 0.75, None)]
    (tmp_path / "p1" / "bvp_p1_T2.csv").write_text("1.5\nx\n2.5\n")
    got = spark.read.format("recordings").option("layout", "task_csv").load(str(tmp_path)).orderBy("j").collect()
    assert [(r.recording_id, r.t, r.bvp) for r in got] == [("p1_T2", 0.0, 1.5), ("p1_T2", 1 / 64, None), ("p1_T2", 2 / 64, 2.5)]


def test_recordings_that_arrive(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        _subject(tmp_path / "in", f"s{k}", 40)
        time.sleep(0.02)

    def run():
        stream = spark.readStream.format("recordings").option("maxFiles", "2").load(str(tmp_path / "in"))
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start(str(tmp_path / "out"), "parquet")
        q.processAllAvailable()
        q.stop()
        return {r.recording_id: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("recording_id").count().collect()}

    assert run() == {"s0": 40, "s1": 40, "s2": 40}
    _subject(tmp_path / "in", "s9", 12)
    assert run() == {"s0": 40, "s1": 40, "s2": 40, "s9": 12}


def test_measured_stamps_on_an_even_base(spark, tmp_path):
    rng = np.random.default_rng(3)
    t = np.cumsum(0.03 + 0.012 * rng.random(200))
    (tmp_path / "ppg").mkdir()
    (tmp_path / "meta").mkdir()
    (tmp_path / "db.csv").write_text("patient,camera,step,age\n1,cam,before,30\n2,cam,after,40\n")
    (tmp_path / "ppg" / "1_cam_before.txt").write_text("".join(f"{np.sin(2 * x):.6f} 0\n" for x in t))
    stamp = np.datetime64("2024-05-01T10:00:00") + (t * 1e6).astype("timedelta64[us]")
    (tmp_path / "meta" / "1_cam_before.txt").write_text("frame\ttime\n" + "".join(f"{k}\t{s}\n" for k, s in enumerate(stamp)) + "end\n")
    rec, rows = datasets.load(spark, "keyed_csv", str(tmp_path))
    got = {r.recording_id: (r.n_samples, r.fps) for r in rec.collect()}
    assert got["2_cam_after"] == (None, None) and got["1_cam_before"][0] == 200 and abs(got["1_cam_before"][1] - 199 / (t[-1] - t[0])) < 1e-3
    even = align.resampled(rows.withColumnRenamed("bvp", "x"), ["recording_id"], "t", "x", 30.0).orderBy("i").toPandas()
    assert len(even) == int((t[-1] - t[0]) * 30) + 1 and np.abs(even.x - np.interp(even.t, t - t[0], np.sin(2 * t))).max() < 1e-3


def test_only_new_or_changed_recordings_are_measured(spark, tmp_path, monkeypatch):
    root, cache = tmp_path / "frames", tmp_path / "cache"
    for name in ("a", "b"):
        (root / name).mkdir(parents=True)
        for k in range(4):
            (root / name / f"f{k}.png").write_bytes(png(picture(True, 30 + k)))
    asked, measured = [], ingest._measured
    monkeypatch.setattr(ingest, "_measured", lambda s, r, names, *rest: (asked.append(sorted(names)), measured(s, r, names, *rest))[1])
    got = lambda: sorted(map(str, ingest.cached_traces(spark, str(root), str(cache)).collect()))
    first = got()
    assert asked == [["a", "b"]] and len(first) == 8
    want = ingest.trace(ingest.measure_images(datasets.images(spark, str(root))))
    assert first == sorted(map(str, want.select(*ingest.cached_traces(spark, str(root), str(cache)).columns).collect()))
    assert got() == first and asked == [["a", "b"]]  # nothing is read again
    (root / "b" / "f4.png").write_bytes(png(picture(True, 31)))
    (root / "c").mkdir()
    (root / "c" / "f0.png").write_bytes(png(picture(True, 30)))
    assert len(got()) == 10 and asked[1:] == [["b", "c"]]
    for f in (root / "a").iterdir():
        f.unlink()
    assert len(got()) == 6 and len(asked) == 2
