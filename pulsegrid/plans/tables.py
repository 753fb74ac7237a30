"""Readers of the driver tables and the adapters that shape them into the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as state samples: session, t (s since the session's first event), hr, confidence, reason.

    The first stamp per session is a partial aggregate joined back on the
    session, so the events are not sorted for it.
    """
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_id"),
        F.col("value").alias("hr_bpm"),
        (F.get_json_object("props", "$.k").cast("int") / F.lit(100.0)).alias("confidence"),
        F.when(F.col("event_type") == "error", "low_confidence").when(F.col("event_type") == "signup", "calibrating").alias("reason"),
    )
    first = e.groupBy("session_id").agg(F.min("us").alias("us0"))
    return e.join(first, "session_id").select(
        "session_id", "event_id", ((F.col("us") - F.col("us0")) / F.lit(1e6)).alias("t"), "hr_bpm", "confidence", "reason"
    )


SAMPLES_SQL = """
samples AS (
  SELECT user_id AS session_id, event_id,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t,
         value AS hr_bpm, CAST(json_extract_string(props, '$.k') AS INT) / 100.0::DOUBLE AS confidence,
         CASE event_type WHEN 'error' THEN 'low_confidence' WHEN 'signup' THEN 'calibrating' END AS reason
  FROM events)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as per-frame traces: recording_id, i (0-based arrival index), us, x, valid, event_type, k."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("recording_id"),
        (F.row_number().over(w) - 1).cast("long").alias("i"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("value").alias("x"),
        (F.col("event_type") != "error").alias("valid"),
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "event_id",
    )


FRAMES_SQL = """
frames AS (
  SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
         epoch_us(ts) AS us, value AS x, event_type <> 'error' AS valid, event_type,
         CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id
  FROM events)
"""
