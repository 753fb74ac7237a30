"""What the live operator does for one session: calls to state cost a round trip each, and features that no sample shows are not measured."""

from collections import Counter

import numpy as np
import pandas as pd

from pulsegrid.functions import signal_np as sig
from pulsegrid.streaming import engine


class _State:
    def __init__(self, calls):
        self.calls, self.held = calls, []

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[0] if self.held and not isinstance(self.held[0], list) else iter(self.held[0] if self.held else [])

    def iterator(self):
        return iter(())

    def update(self, value):
        self.calls["update"] += 1
        self.held = [value]

    def appendList(self, values):
        self.calls["append"] += 1
        self.held = [[*(self.held[0] if self.held else []), *values]]

    def appendValue(self, value):
        self.appendList([value])

    def clear(self):
        self.calls["clear"] += 1
        self.held = []


class _Handle:
    def __init__(self):
        self.calls = Counter()

    def getValueState(self, *_):
        return _State(self.calls)

    getListState = getMapState = getValueState

    def listTimers(self):
        return iter(())

    def registerTimer(self, at):
        self.calls["timer"] += 1


class _Times:
    def getCurrentWatermarkInMs(self):
        return 0


def test_a_session_is_read_and_written_once_a_batch():
    n = 96
    t = np.arange(n) / 8.0
    pulse = np.sin(2 * np.pi * 1.2 * t)
    frames = {"i": np.arange(n), "ms": (t * 1000).astype(int), "r": 100 + pulse, "g": 100 - 2 * pulse, "b": 100 + 0.5 * pulse, "valid": True}
    pdf = pd.DataFrame(frames | dict.fromkeys(engine.QUALITY, 1.0) | {"motion": 0.0, "compression": 0.0})
    live, handle = engine.Live(8.0, 60.0, 3600.0, {"window_s": 5.0, "calibration_s": 9.0}), _Handle()
    live.init(handle)
    rows = []
    for part in (pdf[:48], pdf[48:]):
        rows += list(live.handleInputRows((7,), iter([part]), _Times()))
    out = pd.concat(rows)
    straight = engine.Engine(8.0, window_s=5.0, calibration_s=9.0).push_many(pdf["i"], engine._rows(pdf))
    assert out["t"].tolist() == [s["t"] for s in straight] and out["overall"].tolist() == [s["quality"]["overall"] for s in straight]
    # per batch: clock and trace are updated, a timer is set, calm samples go in at once; nothing is cleared that isn't there
    assert handle.calls["clear"] == 0 and handle.calls["update"] == 4 and handle.calls["timer"] == 2 and handle.calls["append"] <= 2


def test_pulse_is_the_part_of_cardiac_that_samples_show():
    x = np.random.default_rng(3).normal(size=(5, 80))
    whole = sig.cardiac(x, 8.0)
    for k, v in sig.pulse(x, 8.0).items():
        np.testing.assert_array_equal(v, whole[k])
