"""Queries that run as streams: recordings of ``events`` arrive as files in the shared folder, pass the live engine, and are read back from its sinks.

Sessions start together; a frame's event time is its index over the rate. Files come in rounds of ``ROUND`` frames of each session, and the stream is
stopped and resumed from its checkpoint between them, so no round holds more of a session than that. Rows without a session are dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.store import Store
from pulsegrid.plans.catalog import query
from pulsegrid.plans.evaluation_queries import FPS, WINDOW_S, traces
from pulsegrid.plans.tables import FRAMES_SQL
from pulsegrid.staging import shared_folder
from pulsegrid.streaming import engine, sources_sinks

CALIBRATION_S = 7.0
#: When sessions start; a stream's first watermark is the epoch, and nothing may be older.
START_US = 1_000_000_000_000_000
ROUND = 4096
#: Frames of a message.
MESSAGE = 16


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``traces`` as sessions on event time."""
    f = traces(spark, sf_dir).withColumnRenamed("recording_id", "session_id").where("session_id IS NOT NULL")
    return f.select("session_id", "i", F.timestamp_micros(F.lit(START_US) + (F.col("i") * F.lit(1e6 / FPS)).cast("long")).alias("ts"), *engine.COLUMNS)


def messages(frames: DataFrame) -> DataFrame:
    """Frames as JSON messages of ``MESSAGE`` frames: session_id, seq, ts, json."""
    one = F.struct("i", F.array("r", "g", "b").alias("rgb"), "valid", *engine.QUALITY)
    per = frames.groupBy("session_id", F.floor(F.col("i") / MESSAGE).alias("m")).agg(F.sort_array(F.collect_list(one)).alias("frames"), F.min("i").alias("seq"), F.min("ts").alias("ts"))
    return per.select("session_id", "seq", "ts", F.to_json(F.struct("frames")).alias("json"))


def _rounds(frames: DataFrame, folder: str, shaped, start) -> None:
    """Lets the frames arrive in ``folder`` round by round, as ``shaped`` makes them, and runs ``start()`` after each."""
    last = frames.agg(F.max("i")).first()[0]
    for a in range(0, (-1 if last is None else last) + 1, ROUND):
        shaped(frames.where((F.col("i") >= a) & (F.col("i") < a + ROUND))).mode("append").save(folder)
        start().awaitTermination()


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/pulsegrid/stream-{uuid.uuid4().hex}"


@query("stream_state")
def stream_state(spark, sf_dir):
    """Samples of the live engine over all recordings, by a file source, the stateful operator and a file sink."""
    at, f = _folder(spark), sessions(spark, sf_dir)

    def start():
        live = engine.states(spark.readStream.schema(f.schema).parquet(f"{at}/in"), FPS, window_s=WINDOW_S, calibration_s=CALIBRATION_S)
        return live.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out", "parquet")

    _rounds(f, f"{at}/in", lambda rows: rows.write.format("parquet"), start)
    none = spark.createDataFrame([], engine.OUTPUT)
    return none if f.isEmpty() else spark.read.schema(none.schema).parquet(f"{at}/out")


_WIN, _HZ = int(FPS * WINDOW_S), int(FPS)
_GAP = int(0.5 * FPS)


@query("stream_gates", f"""WITH {FRAMES_SQL}, f AS (SELECT recording_id AS session_id, i, coalesce(valid, false) AND x IS NOT NULL AND k IS NOT NULL AS ok FROM frames WHERE recording_id IS NOT NULL AND recording_id % 5 <> 0),
ticks AS (SELECT session_id, i + 1 AS p FROM f WHERE (i + 1) % {_HZ} = 0 AND i + 1 >= {_WIN}),
w AS (SELECT t.session_id, p, i, ok, max(CASE WHEN ok THEN i END) OVER (PARTITION BY t.session_id, p ORDER BY i) AS seen FROM ticks t JOIN f ON f.session_id = t.session_id AND f.i >= p - {_WIN} AND f.i < p),
g AS (SELECT session_id, p, avg(ok::INT) AS ratio, max(i - coalesce(seen, p - {_WIN} - 1)) AS gap FROM w GROUP BY 1, 2)
SELECT session_id, p / {FPS}::DOUBLE AS t, CASE WHEN ratio < 0.75 THEN 'insufficient_valid_frames' WHEN gap > {_GAP} THEN 'signal_gap_too_long' ELSE 'measured' END AS gate FROM g""")  # fmt: skip
def stream_gates(spark, sf_dir):
    """Gates of live samples: JSON messages, the parser, the engine and the study store, where every fifth session has withdrawn its consent."""
    at, f = _folder(spark), sessions(spark, sf_dir)
    store = Store(spark, f"{at}/store")
    gone = F.when(F.col("session_id") % 5 == 0, 1.0)
    known = f.select("session_id").distinct()
    store._append("consents", known.select(F.col("session_id").cast("string"), F.lit(0.0).alias("granted_at"), F.lit("1").alias("notice_version"), F.lit("").alias("notice_text"), F.array(F.lit("measurements")).alias("scopes"), gone.alias("withdrawn_at")))

    def start():
        live = engine.states(sources_sinks.packet_stream(spark, f"{at}/in"), FPS, window_s=WINDOW_S, calibration_s=CALIBRATION_S)
        return sources_sinks.to_store(live, store, f"{at}/checkpoint")

    _rounds(f, f"{at}/in", lambda rows: messages(rows).write.format("json"), start)
    gate = F.when(F.col("reason").isin("insufficient_valid_frames", "signal_gap_too_long"), F.col("reason")).otherwise("measured")
    return store.read("samples").select(F.col("session_id").cast("long").alias("session_id"), "t", gate.alias("gate"))
