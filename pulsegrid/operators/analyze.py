"""Offline analysis of frame traces: one row per recording, method and rolling window.

A recording is dealt in blocks of ``BLOCK`` frames and those that the block's
last window reaches beyond it. A task goes through its blocks in order; windows of
several recordings are filtered and transformed as one batch. So a frame crosses
the shuffle once or twice, however many windows and methods see it, a long
recording spreads over tasks, and short ones share the cost of a call.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pulsegrid.functions import signal_np as sig
from pulsegrid.functions.scoring import MAX_GAP_S, MIN_VALID_RATIO, clip, confidence, decision, image_quality, pulse_quality, window_overall

#: Frames at whose multiples a recording is cut, at least.
BLOCK = 4096
QUALITY = ("face", "lighting", "sharpness", "motion", "compression")
FEATURES = "hr_bpm double, pulse_snr_db double, hr_stability_bpm double, pulse_amplitude double, ibi_mean_s double, rmssd_proxy_ms double, n_beats long"
SCHEMA = f"recording_id long, method string, start_s double, end_s double, valid_ratio double, longest_gap long, face double, lighting double, sharpness double, motion double, compression double, fps_stability double, gt double, {FEATURES}"
#: Frames of the windows that are filtered at once: 32 windows of 20 s at 30 fps.
SLICE_FRAMES = 19_200


def _steadiness(t: np.ndarray) -> np.ndarray:
    """Per row of stamps 1 - spread of the frame intervals over their mean, within [0, 1]; 0 under three stamps or without progress."""
    out = np.zeros(len(t))
    whole = np.isfinite(t).all(axis=1)
    for rows in [np.flatnonzero(whole), *np.flatnonzero(~whole)[:, None]]:  # rows that lack stamps have lengths of their own
        dt = np.diff(t[rows] if whole[rows].all() else t[rows][np.isfinite(t[rows])][None])
        if not len(rows) or dt.shape[1] < 2:
            continue
        mean = dt.mean(axis=1)
        out[rows] = np.where(mean > 0, np.clip(1 - dt.std(axis=1) / np.where(mean > 0, mean, 1.0), 0, 1), 0.0)
    return out


def _tenth(x: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Per row the 10th percentile of the values used, between neighbours; NaN without any or with a NaN among them."""
    n = use.sum(axis=1)
    at = 0.1 * np.maximum(n - 1, 0)
    low = at.astype(int)
    ranked = np.sort(np.where(use, x, np.inf), axis=1)
    row = np.arange(len(x))
    a, b = ranked[row, low], ranked[row, np.minimum(low + 1, np.maximum(n - 1, 0))]
    bad = (n == 0) | (use & np.isnan(x)).any(axis=1)
    return np.where(bad, np.nan, np.where(bad, 0.0, a) + (np.where(bad, 0.0, b) - np.where(bad, 0.0, a)) * (at - low))


def _features(t: pa.Table, fps: float, win: int, stride: int, size: int, methods: list[str], schema: pa.Schema) -> Iterable[pa.RecordBatch]:
    """Features of the windows of whole blocks of recordings, in order: windows of all of them together, ``size`` at a time."""
    number = lambda c: t.column(c).cast(pa.float64()).to_numpy().astype(float)  # nulls are NaN
    rgb = np.column_stack([number(c) for c in "rgb"])
    valid = t.column("valid").fill_null(False).to_numpy() & np.isfinite(rgb).all(axis=1)
    quality, stamps, truth, place = {c: number(c) for c in QUALITY}, number("t"), number("truth"), t.column("place").to_numpy()
    where = np.arange(len(valid))
    lost = where - np.maximum.accumulate(np.where(valid, where, -1))  # frames since the last valid one
    edges = _edges(t)
    starts = np.concatenate([np.arange(a, e - win + 1, stride) for a, e in zip(edges, edges[1:], strict=False)] or [where[:0]])
    for k in range(0, len(starts), size):
        s = starts[k : k + size]
        at = s[:, None] + np.arange(win)
        v = valid[at]
        n = v.sum(axis=1)
        gap = np.minimum(lost[at], np.arange(win) + 1).max(axis=1)
        base = {"recording_id": t.column("recording_id").take(pa.array(s)).combine_chunks(), "start_s": place[s] / fps, "end_s": (place[s] + win) / fps, "valid_ratio": n / win, "longest_gap": gap}
        for c, x in quality.items():
            mean = np.where(n > 0, np.where(v, x[at], 0.0).sum(axis=1) / np.maximum(n, 1), np.nan)
            base[c] = _tenth(x[at], v) if c in ("face", "motion") else mean
        g = truth[at]
        base |= {"fps_stability": _steadiness(stamps[at]), "gt": np.where(np.isfinite(g).all(axis=1), g.mean(axis=1), np.nan)}
        use = np.flatnonzero((n > 0) & (n / win >= MIN_VALID_RATIO) & (gap <= int(MAX_GAP_S * fps)))
        held = rgb[at[use]]
        for j in np.flatnonzero(n[use] < win):
            held[j] = sig.fill_gaps(held[j], v[use[j]], fps, MAX_GAP_S)
        for name in methods:
            part = base | {"method": [name] * len(s)}
            found = sig.cardiac(sig.method(name)(held, fps), fps) if len(use) else {}
            for c in (f.split()[0] for f in FEATURES.split(", ")):
                part[c] = np.zeros(len(s), np.int64) if c == "n_beats" else np.full(len(s), np.nan)
                if len(use):
                    part[c][use] = found[c]
            yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) if not isinstance(part[f.name], pa.Array) else part[f.name] for f in schema], schema=schema)


def _edges(t: pa.Table) -> list[int]:
    """Where each block begins, and the end: places run on within a block, and a recording begins at place 0."""
    place, block = t.column("place").to_numpy(), t.column("block").to_numpy()
    return [0, *(np.flatnonzero((np.diff(place) != 1) | (np.diff(block) != 0)) + 1).tolist(), len(place)] if len(place) else [0]


def window_features(frames: DataFrame, fps: float, window_s: float = 20.0, stride_s: float = 1.0, methods: Iterable[str] = ("pos",), truth: str | None = None) -> DataFrame:
    """Quality and cardiac features of each window and method; features are null behind the valid-share and gap gates.

    ``fps_stability`` comes from the frames' stamps ``t`` (seconds) where there are
    some, else frames count as even. ``gt`` is the window's mean of column ``truth``.
    """
    win, stride, names = int(round(window_s * fps)), max(int(round(stride_s * fps)), 1), list(methods)
    for m in names:
        sig.method(m)
    stamp = F.col("t").cast("double") if "t" in frames.columns else F.col("i") / F.lit(float(fps))
    rows = frames.select("recording_id", "i", "r", "g", "b", "valid", *QUALITY, stamp.alias("t"), (F.col(truth) if truth else F.lit(None)).cast("double").alias("truth"))
    block = stride * -(-max(BLOCK, win) // stride)
    place = (F.row_number().over(W.partitionBy("recording_id").orderBy("i")) - 1).cast("long")
    b = F.floor(F.col("place") / block)
    both = F.when((b > 0) & (F.col("place") % block < win - stride), F.array(b, b - 1)).otherwise(F.array(b))
    rows = rows.withColumn("place", place).withColumn("block", F.explode(both))

    kind = frames.schema["recording_id"].dataType.simpleString()
    schema = SCHEMA.replace("recording_id long", f"recording_id {kind}")
    size = max(8, SLICE_FRAMES // win)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            last = _edges(t)[-2] if len(t) else 0
            if last:
                yield from _features(t.slice(0, last).combine_chunks(), fps, win, stride, size, names, arrow)
            held = t.slice(last)  # the last block may go on in the next batch
        if held is not None:
            yield from _features(held.combine_chunks(), fps, win, stride, size, names, arrow)

    dealt = rows.repartition("recording_id", "block").sortWithinPartitions("recording_id", "block", "place")
    out = dealt.mapInArrow(run, schema)
    doubles = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    out = out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in doubles})
    return out if truth else out.drop("gt")


def score(features: DataFrame, fps: float) -> DataFrame:
    """Adds quality, confidence, reason, valid and the answered rate ``hr_pred``; would-be values stay in ``hr_bpm``."""
    cols = {c: F.coalesce(F.col(c), F.lit(1.0 if c in ("motion", "compression") else 0.0)) for c in QUALITY} | {"fps_stability": F.col("fps_stability")}
    overall = window_overall(cols, F.col("valid_ratio"))
    pulse = pulse_quality(F.col("pulse_snr_db"), F.col("hr_stability_bpm"))
    conf = confidence(image_quality(cols, F.col("valid_ratio"), F.col("fps_stability")), pulse)
    out = features.withColumn("quality", overall).withColumn("confidence", conf)
    reason = decision(F.col("valid_ratio"), F.col("longest_gap"), F.lit(int(MAX_GAP_S * fps)), F.col("quality"), F.col("confidence"), F.col("hr_bpm"))
    out = out.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
    return out.withColumn("hr_pred", F.when(F.col("valid"), F.col("hr_bpm"))).withColumn("confidence", clip(F.col("confidence")))


def analyze(frames: DataFrame, fps: float, window_s: float = 20.0, stride_s: float = 1.0, methods: Iterable[str] = ("pos",), truth: str | None = None) -> DataFrame:
    return score(window_features(frames, fps, window_s, stride_s, methods, truth), fps)


def truth_rates(samples: DataFrame, gt_fps: float, fps: float, window_s: float = 20.0, stride_s: float = 1.0) -> DataFrame:
    """Rate of a contact trace (recording_id, j, bvp) per frame window: resampled to the frames, same estimator; null under four seconds."""
    win, stride = int(round(window_s * fps)), max(int(round(stride_s * fps)), 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j", kind="stable")
        n = int((len(pdf) - 1) / gt_fps * fps) + 1
        x = np.interp(np.arange(n) / fps, np.arange(len(pdf)) / gt_fps, pdf["bvp"].to_numpy(float))
        starts = np.arange(0, n - win + 1, stride)
        if not len(starts):
            return pd.DataFrame(columns=["recording_id", "start_s", "end_s", "hr_gt"])
        hr = np.full(len(starts), np.nan)
        if win >= int(fps * 4):
            size = max(8, SLICE_FRAMES // win)
            views = np.lib.stride_tricks.sliding_window_view(x, win)[::stride]
            for k in range(0, len(starts), size):  # spectra of some windows at a time, whatever the recording's length
                hr[k : k + size] = sig.rates(*sig.welch(sig.bandpass(views[k : k + size], fps), fps))
        return pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "start_s": starts / fps, "end_s": (starts + win) / fps, "hr_gt": hr})

    out = samples.select("recording_id", "j", "bvp").groupBy("recording_id").applyInPandas(run, "recording_id long, start_s double, end_s double, hr_gt double")
    return out.withColumn("hr_gt", F.when(~F.isnan("hr_gt"), F.col("hr_gt")))
