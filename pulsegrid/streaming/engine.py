"""Live sessions: packets in, one state sample per tick out, as a stateful operator on event time.

State per session: a clock (next frame, fitted baseline), the calm samples before the baseline, a ring of the last window's frames, and frames that came
early. The frame index orders frames: repeated and late ones are dropped, a frame waits for those before it, and once more than ``patience``
wait, missing ones count as invalid. A leap longer than a window begins a new segment instead, which samples again after a
whole window: nothing is made up in between, and time runs on by index.

A session whose event time stands still while the watermark passes ``idle_s`` is flushed and its colour traces are removed. Its clock and baseline
stay for ``forget_s``, so that a session that resumes neither repeats nor overwrites a sample. State and checkpoints hold
seconds of colour trace: keep their retention short and apart from study tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.functions import scoring as sc
from pulsegrid.functions import signal_np as sig
from pulsegrid.operators.analyze import SLICE_FRAMES, _tenth

QUALITY = ("face", "lighting", "sharpness", "motion", "compression")
COLUMNS = ["r", "g", "b", "valid", *QUALITY]
OUTPUT = "session_id long, t double, hr_bpm double, snr_db double, confidence double, reason string, calibrated boolean, arousal_bpm double, baseline_bpm double, quality map<string,double>"
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
#: ``quality``'s keys; its values leave the operator as columns of numbers, which cost far less than a map a row.
SHOWN = ("overall", "face", "lighting", "motion", "compression", "valid_frame_ratio")
_PLAIN = ", ".join([*OUTPUT.split(", ")[:-1], *(f"{c} double" for c in SHOWN)])
#: A frame that never came.
MISSING = np.array([np.nan, np.nan, np.nan, 0, 0, 0, 0, 1, 1], float)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(pdf: pd.DataFrame) -> np.ndarray:
    """Frames as numbers: null is NaN, and not valid."""
    valid = pdf["valid"].to_numpy()
    if valid.dtype != bool:
        valid = pdf["valid"].astype(object).where(pdf["valid"].notna(), False)
    return np.column_stack([np.asarray(valid, float) if c == "valid" else pdf[c].to_numpy(float) for c in COLUMNS])


class Engine:
    """One session's sequential logic. Frames go through in runs, and the windows of a run are measured as one batch."""

    def __init__(self, fps: float, window_s: float = 20.0, emit_hz: float = 1.0, calibration_s: float = 45.0, method: str = "pos", patience: int = 30):
        self.fps, self.window = fps, int(round(window_s * fps))
        self.every = max(int(round(fps / max(emit_hz, 1e-6))), 1)
        self.calibration_s, self.method, self.patience = calibration_s, method, patience
        self.n, self.ring, self.waiting = 0, np.empty((0, len(COLUMNS))), {}
        self.calibration: list[tuple[float, float]] = []
        self.baseline: float | None = None

    def push(self, i: int, frame) -> list[dict]:
        """``frame``: [r, g, b, valid, *QUALITY]; returns the samples that became due."""
        return self.push_many([i], np.array([[np.nan if v is None else float(v) for v in frame]]))

    def push_many(self, index, rows: np.ndarray) -> list[dict]:
        """The same for frames in any order; of repeated ones the first counts."""
        for i, row in zip(np.asarray(index).tolist(), rows, strict=True):
            if i >= self.n:
                self.waiting.setdefault(i, row)
        return self._advance(False)

    def drain(self) -> list[dict]:
        """The session is over or pauses: waiting frames go through, missing ones between them as invalid.

        Those behind a leap longer than a window are dropped: alone they are too few for a sample. Traces are forgotten.
        """
        out = self._advance(True)
        self.ring, self.waiting = self.ring[:0], {}
        return out

    def _advance(self, over: bool) -> list[dict]:
        order = sorted(self.waiting)
        run, out, k = [], [], 0
        while k < len(order):
            gap = order[k] - self.n - len(run)
            if gap and not over and len(order) - k <= self.patience:
                break
            if gap > self.window:
                if over:
                    break
                out += self._through(run)
                run, self.ring, self.n = [], self.ring[:0], order[k]
            elif gap:
                run += [MISSING] * gap
            run.append(self.waiting.pop(order[k]))
            k += 1
        return out + self._through(run)

    def _through(self, run: list[np.ndarray]) -> list[dict]:
        if not run:
            return []
        frames = np.concatenate([self.ring, np.array(run)])
        first, self.n = self.n - len(self.ring), self.n + len(run)
        ends = np.arange(self.n - len(run) + 1, self.n + 1)
        ends = ends[(ends % self.every == 0) & (ends - first >= self.window)]
        out, size = [], max(1, SLICE_FRAMES // self.window)
        for a in range(0, len(ends), size):
            at = (ends[a : a + size] - first - self.window)[:, None] + np.arange(self.window)
            out += self._samples(frames[at], ends[a : a + size] / self.fps)
        self.ring = frames[-self.window :]
        return out

    def _samples(self, held: np.ndarray, t: np.ndarray) -> list[dict]:
        """Samples of windows (windows, frames, columns) that end at ``t``."""
        valid = (held[..., 3] > 0) & np.isfinite(held[..., :3]).all(axis=2)
        n, place = valid.sum(axis=1), np.arange(self.window)
        ratio = n / self.window
        gap = (place - np.maximum.accumulate(np.where(valid, place, -1), axis=1)).max(axis=1)
        quality = {}
        for c, x in zip(QUALITY, np.moveaxis(held[..., 4:], 2, 0), strict=True):
            value = _tenth(x, valid) if c in ("face", "motion") else np.where(n > 0, np.where(valid, x, 0.0).sum(axis=1) / np.maximum(n, 1), np.nan)
            quality[c] = np.where(np.isnan(value), 1.0 if c in ("motion", "compression") else 0.0, value)
        weighed = lambda weights: sum(w * (quality[c] if c in quality else 1.0) for c, w in weights.items())  # frames count as even
        overall = np.clip(weighed(sc.WINDOW_WEIGHTS), 0, 1) * ratio
        image = sum(w * np.clip(quality[c], 0, 1) for c, w in sc.IMAGE_WEIGHTS.items()) * ratio
        short, torn = ratio < sc.MIN_VALID_RATIO, gap > int(sc.MAX_GAP_S * self.fps)
        use = np.flatnonzero(~short & ~torn)
        hr, snr, spread = (np.full(len(t), np.nan) for _ in range(3))
        if len(use):
            rgb = held[use, :, :3]
            for j in np.flatnonzero(n[use] < self.window):
                rgb[j] = sig.fill_gaps(rgb[j], valid[use[j]], self.fps, sc.MAX_GAP_S)
            found = sig.pulse(sig.method(self.method)(rgb, self.fps), self.fps)
            hr[use], snr[use], spread[use] = found["hr_bpm"], found["pulse_snr_db"], found["hr_stability_bpm"]
        sure = np.isfinite(snr) & np.isfinite(spread)
        pulse = np.where(sure, 1 / (1 + np.exp(-(np.where(sure, snr, 0) - sc.SNR_MID_DB) / sc.SNR_SCALE_DB)) * np.exp(-((np.where(sure, spread, 0) / sc.STABILITY_SCALE_BPM) ** 2)), 0.0)
        conf = np.clip(image * pulse, 0, 1)
        conf[short | torn] = 0.0
        number = lambda v: float(v) if np.isfinite(v) else None
        out = []
        for k in range(len(t)):
            shown = {"overall": float(overall[k])} | {c: float(quality[c][k]) for c in ("face", "lighting", "motion", "compression")} | {"valid_frame_ratio": float(ratio[k])}
            one = dict.fromkeys(_NAMES[1:]) | {"t": float(t[k]), "hr_bpm": number(hr[k]), "snr_db": number(snr[k]), "confidence": float(conf[k]), "quality": shown}
            reason = "insufficient_valid_frames" if short[k] else "signal_gap_too_long" if torn[k] else "low_confidence" if conf[k] < sc.ABSTAIN_BELOW else "no_hr_peak" if one["hr_bpm"] is None else None
            out.append(one | (self._relative(one) if reason is None else {"reason": reason, "calibrated": self.baseline is not None}))
        return out

    def _relative(self, one: dict) -> dict:
        """An answered sample against the session's calm ones, which are fitted once calibration is over."""
        if self.baseline is None:
            if one["t"] <= self.calibration_s:
                self.calibration.append((one["hr_bpm"], one["confidence"]))
            else:
                good = [h for h, c in self.calibration if c >= 0.45]
                self.baseline = float(np.median(good)) if len(good) >= 3 else None
        if self.baseline is None:
            return {"reason": "calibrating", "calibrated": False}
        return {"calibrated": True, "arousal_bpm": one["hr_bpm"] - self.baseline, "baseline_bpm": self.baseline}


class Live(StatefulProcessor):
    """The engine over a stream: state by kind, timers on event time."""

    def __init__(self, fps: float, idle_s: float, forget_s: float, options: dict):
        self.terms, self.idle_ms, self.forget_ms = (fps, options), int(idle_s * 1000), int(forget_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "n long, baseline double")
        self.calm = handle.getListState("calm", "hr double, confidence double")
        self.trace = handle.getValueState("trace", "ring binary")
        self.early = handle.getMapState("early", "i long", "frame binary")

    def _load(self) -> Engine:
        engine = Engine(self.terms[0], **self.terms[1])
        if self.clock.exists():
            engine.n, engine.baseline = self.clock.get()
            engine.calibration = [tuple(x) for x in self.calm.get()]
        frames = lambda raw: np.frombuffer(raw, float).reshape(-1, len(COLUMNS))
        if self.trace.exists():
            engine.ring = frames(bytes(self.trace.get()[0]))
            engine.waiting = {key[0]: frames(bytes(value[0]))[0] for key, value in self.early.iterator()}
        return engine

    def _save(self, engine: Engine, traces: bool, known: int, early: bool) -> None:
        """``known``: calm samples that state has already; ``early``: whether it has frames that came early."""
        self.clock.update((engine.n, engine.baseline))
        if engine.calibration[known:]:
            self.calm.appendList(engine.calibration[known:])
        if early:
            self.early.clear()
        if not traces:
            self.trace.clear()
        else:
            self.trace.update((engine.ring.tobytes(),))
            for i, row in engine.waiting.items():
                self.early.updateValue((i,), (row.tobytes(),))

    def _wake(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def _out(self, key: tuple, samples: list[dict]) -> Iterator[pd.DataFrame]:
        if samples:
            columns = {c: [one.get(c) for one in samples] for c in _NAMES[1:-1]} | {c: [one["quality"][c] for one in samples] for c in SHOWN}
            yield pd.DataFrame({"session_id": [key[0]] * len(samples)} | columns)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        engine, last = self._load(), timerValues.getCurrentWatermarkInMs()
        known, early = len(engine.calibration), bool(engine.waiting)
        parts = list(rows)
        pdf = parts[0] if len(parts) == 1 else pd.concat(parts)
        out = engine.push_many(pdf["i"].to_numpy(np.int64), _rows(pdf))
        last = max(last, int(pdf["ms"].max()))
        self._save(engine, True, known, early)
        self._wake(last + self.idle_ms)
        yield from self._out(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.trace.exists():  # idle long since
            self.clock.clear()
            self.calm.clear()
            return
        engine = self._load()
        known, early = len(engine.calibration), bool(engine.waiting)
        out = engine.drain()
        self._save(engine, False, known, early)
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.forget_ms)
        yield from self._out(key, out)

    def close(self) -> None:
        pass


def states(packets: DataFrame, fps: float, idle_s: float = 60.0, delay_s: float = 10.0, forget_s: float = 86400.0, **options) -> DataFrame:
    """State samples of a stream of frames (session_id, i, ts, r, g, b, valid, QUALITY columns); ``ts`` is event time.

    Frames without a session, index or time are dropped, and so are those older than the watermark, ``delay_s`` behind the newest. The session's state store
    becomes RocksDB, which this kind of state needs.
    """
    spark = packets.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = packets.select("session_id", "i", "ts", F.unix_millis("ts").alias("ms"), *COLUMNS).where("session_id IS NOT NULL AND i IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", f"{delay_s} seconds")
    schema = _PLAIN.replace("session_id long", f"session_id {packets.schema['session_id'].dataType.simpleString()}")
    out = rows.groupBy("session_id").transformWithStateInPandas(Live(fps, idle_s, forget_s, options), schema, "append", "eventTime")
    quality = F.create_map(*[x for c in SHOWN for x in (F.lit(c), F.col(c))])
    return out.select(*_NAMES[:-1], quality.cast("map<string,double>").alias("quality"))
