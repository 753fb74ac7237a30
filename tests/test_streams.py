"""Packets stream in as JSON, states land in the store, and a replay changes nothing."""

import json

from pyspark.sql import functions as F

from pulsegrid.operators.store import Store
from pulsegrid.sources import synth
from pulsegrid.streaming import engine, sources_sinks


def test_packets_to_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    f = synth.frames(spark, [synth.Config(0, seconds=12.0)]).orderBy("i").toPandas()
    rows = []
    for k in range(0, len(f), 30):
        part = f.iloc[k : k + 30]
        batch = [{"rgb": [r.r, r.g, r.b], "valid": True, "face": r.face, "lighting": r.lighting, "sharpness": r.sharpness, "motion": r.motion, "compression": 1.0} for r in part.itertuples()]
        rows.append(json.dumps({"session_id": 7, "seq": k, "ts": f"2024-01-01T00:00:{k // 30:02d}Z", "json": json.dumps({"frames": batch})}))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(rows))
    store._put("consents", "7", 0.0, "1", "", ["camera"], None)
    states = engine.states(sources_sinks.packet_stream(spark, str(tmp_path / "in")), 30.0, window_s=10.0)
    sources_sinks.to_store(states, store, str(tmp_path / "ck")).awaitTermination(180)
    got = store.read("samples")
    assert got.count() == 3 and got.where(F.col("hr_bpm").isNull()).count() == 0
    store.append_samples(got)
    assert store.read("samples").count() == 3


def _start(spark, tmp_path, name, frames):
    frames.write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(frames.schema).parquet(str(tmp_path / name))


def test_a_withdrawn_session_stops_alone(spark, tmp_path):
    """One micro-batch with a withdrawn and a consenting session: the one's samples go in, the other's don't; a replay changes nothing."""
    store = Store(spark, str(tmp_path / "store"))
    for session, withdrawn in (("1", None), ("2", 5.0)):
        store._put("consents", session, 0.0, "1", "", ["camera"], withdrawn)
    samples = spark.createDataFrame([(s, t, 70.0, 0.9, None) for s in (1, 2, 3) for t in (1.0, 2.0)], "session_id long, t double, hr_bpm double, confidence double, reason string")
    stream = _start(spark, tmp_path, "in", samples)
    sources_sinks.to_store(stream, store, str(tmp_path / "ck")).awaitTermination(120)
    assert {(r.session_id, r.t) for r in store.read("samples").collect()} == {("1", 1.0), ("1", 2.0)}
    samples.where("session_id = 1").withColumn("t", F.col("t") + 5).write.mode("append").parquet(str(tmp_path / "in"))
    sources_sinks.to_store(stream, store, str(tmp_path / "ck")).awaitTermination(120)
    assert store.read("samples").count() == 4
    store.append_samples(samples.withColumn("session_id", F.col("session_id").cast("string")), consenting=True, batch=(str(tmp_path / "ck"), 1))
    assert store.read("samples").count() == 4 and store._manifest()[1]["_batches"] == {str(tmp_path / "ck"): 1}


def test_consent_that_changes_under_a_stream(spark, tmp_path):
    """Grants, withdrawals and grants again, all in the frames' own micro-batch; frames without consent at their time never pass."""
    at = lambda c: F.timestamp_micros((F.lit(1e15) + F.col(c) * 1e6).cast("long"))
    rows = [(s, i, float(i)) for s in (1, 2, 3, 4) for i in range(40)] + [(1, 3, 3.0), (None, 1, 1.0)]
    frames = spark.createDataFrame(rows, "session_id long, i long, s double").select("session_id", "i", at("s").alias("ts"), F.lit(0.5).alias("face"))
    events = [(1, -5.0, True), (1, 20.0, False), (2, 0.0, True), (2, 7.0, False), (2, 12.0, True), (4, -1000.0, True), (3, 4.0, False), (3, 9.0, True), (3, 9.0, False), (None, 0.0, True)]
    consents = spark.createDataFrame(events, "session_id long, s double, granted boolean").select("session_id", at("s").alias("at"), "granted")
    passed = sources_sinks.consented(_start(spark, tmp_path, "frames", frames), _start(spark, tmp_path, "consents", consents), delay_s=1.0)
    run = lambda: passed.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"), "parquet").awaitTermination(180)
    run()
    later = spark.createDataFrame([(9, 1, 100.0)], "session_id long, i long, s double").select("session_id", "i", at("s").alias("ts"), F.lit(0.5).alias("face"))
    later.write.mode("append").parquet(str(tmp_path / "frames"))  # the watermark passes the rest
    spark.createDataFrame([(9, 100.0, True)], "session_id long, s double, granted boolean").select("session_id", at("s").alias("at"), "granted").write.mode("append").parquet(str(tmp_path / "consents"))
    run()
    got = sorted((r.session_id, r.i) for r in spark.read.parquet(str(tmp_path / "out")).where("session_id <> 9").collect())
    assert got == sorted([(1, i) for i in range(20)] + [(1, 3)] + [(2, i) for i in range(7)] + [(2, i) for i in range(12, 40)] + [(4, i) for i in range(40)])
