"""Blinks and eye openness over per-frame series (recording_id, i, openness)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators import evaluate

DROP_RATIO, MIN_S, MAX_S, REFRACTORY_S, MIN_VALID, MAD_TO_SIGMA = 0.90, 0.1, 0.5, 0.2, 0.6, 1.4826


def _runs(series: DataFrame, fs: float, drop_ratios: tuple[float, ...]) -> DataFrame:
    """Runs (recording_id, drop_ratio, start, stop) below each share of the open-eye level: one level and one sort for all shares."""
    level = series.groupBy("recording_id").agg(F.percentile("openness", F.lit(0.75)).alias("level"), F.count("openness").alias("k"))
    level = level.where((F.col("k") >= int(fs * 2)) & (F.col("level") > 1e-9))
    rows = series.join(level, "recording_id")
    w = W.partitionBy("recording_id").orderBy("i")
    low = lambda r: F.coalesce(F.col("openness") < r * F.col("level"), F.lit(False))
    cells = [F.struct(F.lit(float(r)).alias("drop_ratio"), low(r).alias("low"), F.sum((~low(r)).cast("int")).over(w).alias("island")) for r in drop_ratios]
    rows = rows.select("recording_id", "i", F.array(*cells).alias("cells")).select("recording_id", "i", F.explode(F.filter("cells", lambda c: c["low"])).alias("c"))
    rows = rows.select("recording_id", "i", "c.drop_ratio", "c.island")
    return rows.groupBy("recording_id", "drop_ratio", "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop")).drop("island")


def closed_runs(series: DataFrame, fs: float, drop_ratio: float = DROP_RATIO) -> DataFrame:
    """Runs (recording_id, start, stop) below the open-eye level; missing frames count as open.

    The level is the 75th percentile of present values, null under two seconds of them.
    """
    return _runs(series, fs, (drop_ratio,)).drop("drop_ratio")


def blink_sweep(series: DataFrame, fs: float, drop_ratios: tuple[float, ...], min_s: float = MIN_S, max_s: float = MAX_S, refractory_s: float = REFRACTORY_S) -> DataFrame:
    """Accepted blinks (recording_id, drop_ratio, start, stop) at each share of the level."""
    lo, hi, rest = int(min_s * fs), int(max_s * fs), int(refractory_s * fs)
    runs = _runs(series, fs, drop_ratios).where((F.col("stop") - F.col("start")).between(lo, hi))
    per = runs.groupBy("recording_id", "drop_ratio").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def step(acc, r):
        last = F.element_at(acc, -1)["stop"]
        return F.when((F.size(acc) > 0) & (r["start"] - last < rest), acc).otherwise(F.concat(acc, F.array(r)))

    acc = F.aggregate("runs", empty, lambda a, r: F.when(F.size(a) == 0, F.array(r)).otherwise(step(a, r)))
    return per.select("recording_id", "drop_ratio", F.explode(acc).alias("b")).select("recording_id", "drop_ratio", "b.start", "b.stop")


def blinks(series: DataFrame, fs: float, drop_ratio: float = DROP_RATIO, min_s: float = MIN_S, max_s: float = MAX_S, refractory_s: float = REFRACTORY_S) -> DataFrame:
    """Accepted blinks (recording_id, start, stop): runs of a blink's length, not too soon after the last accepted one."""
    return blink_sweep(series, fs, (drop_ratio,), min_s, max_s, refractory_s).drop("drop_ratio")


def blink_rates(series: DataFrame, found: DataFrame, fs: float) -> DataFrame:
    """Per recording: blinks, minutes of frames, and blinks a minute; null without frames."""
    length = series.groupBy("recording_id").agg((F.count("*") / F.lit(fs * 60.0)).alias("minutes"))
    n = found.groupBy("recording_id").agg(F.count("*").alias("n_blinks"))
    out = length.join(n, "recording_id", "left").withColumn("n_blinks", F.coalesce("n_blinks", F.lit(0)))
    return out.withColumn("per_minute", F.col("n_blinks") / F.nullif(F.col("minutes"), F.lit(0.0)))


def sweep_scores(series: DataFrame, truth: DataFrame, fs: float, drop_ratios: tuple[float, ...], tolerance_s: float = 0.25, **limits) -> DataFrame:
    """Precision, recall and F1 of blinks against true times (recording_id, t in frames) at each share, over all recordings."""
    found = blink_sweep(series, fs, drop_ratios, **limits).withColumn("t", (F.col("start") + F.col("stop") - 1) / 2.0)
    key = F.struct("recording_id", "drop_ratio")
    true = truth.select("recording_id", "t", F.explode(F.array(*[F.lit(float(r)) for r in drop_ratios])).alias("drop_ratio"))
    matched = evaluate.match_events(found.select(key.alias("key"), "t"), true.select(key.alias("key"), "t"), tolerance_s * fs)
    per = matched.groupBy(F.col("key.drop_ratio").alias("drop_ratio")).agg(*[F.sum(c).alias(c) for c in ("n_detected", "n_truth", "tp")])
    return evaluate.f1(per)


def ocular_stats(series: DataFrame, fs: float) -> DataFrame:
    """Median, robust spread and valid share per recording; a reason instead where the eye is mostly missing."""
    base = series.groupBy("recording_id").agg(F.count("*").alias("n"), F.avg(F.col("openness").isNotNull().cast("double")).alias("valid_fraction"), F.median("openness").alias("med"))
    dev = series.join(base, "recording_id").groupBy("recording_id", "n", "valid_fraction", "med").agg((MAD_TO_SIGMA * F.median(F.abs(F.col("openness") - F.col("med")))).alias("spread"))
    reason = F.when(F.col("n") < int(fs * 2), "window_too_short").when(F.col("valid_fraction") < MIN_VALID, "eye_region_unusable")
    out = dev.withColumn("reason", reason)
    shown = F.col("reason").isNull()
    return out.select("recording_id", "n", "valid_fraction", F.when(shown, F.col("med")).alias("openness_median"), F.when(shown, F.col("spread")).alias("openness_spread"), "reason")
