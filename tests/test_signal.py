"""Signal routines against signals whose answer is known, and against direct evaluations of their definitions."""

import numpy as np
import pytest

from pulsegrid.functions import signal_np as sig


def pulse(hz, fs, seconds, seed, noise=0.25, harmonic=0.3):
    """A beat with a harmonic and noise, at a random phase."""
    rng = np.random.default_rng(seed)
    at = 2 * np.pi * hz * np.arange(int(seconds * fs)) / fs + rng.uniform(0, 6)
    return np.cos(at) + harmonic * np.cos(2 * at) + noise * rng.standard_normal(len(at))


@pytest.mark.parametrize(("fs", "seconds"), [(25.0, 18), (30.0, 24), (50.0, 16)])
def test_rates_over_the_whole_band(fs, seconds):
    hz = np.linspace(0.85, 2.6, 8)
    rows = np.stack([pulse(f, fs, seconds, 100 + k) for k, f in enumerate(hz)])
    found = sig.cardiac(sig.bandpass(rows, fs), fs)
    assert np.abs(found["hr_bpm"] - 60 * hz).max() < 0.8
    assert (found["pulse_snr_db"] > 8).all() and (found["hr_stability_bpm"] < 1.5).all() and (found["n_beats"] >= 0.8 * hz * seconds).all()


def test_nothing_to_find():
    fs = 25.0
    assert np.isnan(sig.rates(*sig.welch(np.full((2, 500), 7.0), fs))).all()
    noise = sig.bandpass(np.random.default_rng(77).standard_normal((60, 450)), fs)
    assert np.median(sig.stability(noise, fs)) > 2  # beats stay under 1.5
    assert np.isnan(sig.cardiac(np.ones((3, 80)), fs)["hr_bpm"]).all() and sig.cardiac(np.ones((3, 80)), fs)["n_beats"].tolist() == [0, 0, 0]


def test_slow_drift_and_steps_leave_the_rate():
    fs = 32.0
    t = np.arange(int(22 * fs)) / fs
    x = np.stack([np.cos(2 * np.pi * 1.45 * t) + 30 * (t / 22) ** 2 - 12 * t, np.cos(2 * np.pi * 1.45 * t) + 20 * np.cos(2 * np.pi * 0.11 * t + 1)])
    assert np.abs(sig.rates(*sig.welch(sig.bandpass(sig.detrend(x, fs), fs), fs)) - 87).max() < 0.8


@pytest.mark.parametrize(("order", "edges", "fs"), [(2, (0.5,), 30.0), (4, (0.7, 3.0), 30.0), (3, (0.8, 2.5), 20.0)])
def test_butterworth_gain_by_its_definition(order, edges, fs):
    """|H| of the digital filter is the analogue prototype's at the warped frequency."""
    b, a = sig.butterworth(order, edges, fs)
    f = np.linspace(0.05, 0.45 * fs, 60)
    z = np.exp(-2j * np.pi * f / fs)
    got = np.abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z))
    w, e = np.tan(np.pi * f / fs), [np.tan(np.pi * x / fs) for x in edges]
    ratio = e[0] / w if len(e) == 1 else (w**2 - e[0] * e[1]) / (w * (e[1] - e[0]))
    assert np.abs(got - 1 / np.sqrt(1 + ratio ** (2 * order))).max() < 1e-6


def test_zero_phase_is_symmetric_and_linear():
    m = sig.zero_phase(3, (0.8, 2.4), 20.0, 160)
    assert np.abs(m - np.flip(m)).max() < 1e-6
    x = np.random.default_rng(8).standard_normal((2, 160))
    assert np.allclose(sig.bandpass(x[:1] + 3 * x[1:], 20.0), sig.bandpass(x[:1], 20.0) + 3 * sig.bandpass(x[1:], 20.0))


def test_welch_by_a_direct_transform():
    fs, x = 10.0, np.random.default_rng(5).standard_normal(200)
    f, p = sig.welch(x[None], fs, seconds=8.0)
    per, w = 80, 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(80) / 80)
    want = np.zeros(3)
    for s in (0, 40, 80, 120):
        part = (x[s : s + per] - x[s : s + per].mean()) * w
        want += [2 * abs((part * np.exp(-2j * np.pi * v * np.arange(per) / fs)).sum()) ** 2 for v in f[[40, 97, 200]]]
    assert np.allclose(p[0, [40, 97, 200]], want / 4 / fs / (w**2).sum())


def test_gaps_fill_or_refuse():
    fs, n = 20.0, 240
    ramp = np.stack([np.linspace(a, b, n) for a, b in ((90, 130), (60, 50), (10, 80))], axis=1)
    holes = np.ones(n, bool)
    holes[[0, 1, 33, 34, 35, 120, n - 1]] = False
    torn = np.where(holes[:, None], ramp, np.nan)
    filled = sig.fill_gaps(torn, holes, fs)
    assert np.allclose(filled[2:-1], ramp[2:-1]) and np.allclose(filled[0], ramp[2]) and np.allclose(filled[-1], ramp[-2])
    holes[60:71] = False  # eleven frames at 20 Hz: over half a second
    assert sig.fill_gaps(torn, holes, fs) is None and sig.fill_gaps(torn, np.zeros(n, bool), fs) is None


@pytest.mark.parametrize("name", ["pos", "chrom", "green"])
@pytest.mark.parametrize("hz", [0.95, 1.7])
def test_projections_recover_the_pulse(name, hz):
    fs = 25.0
    beat = pulse(hz, fs, 20, 3, noise=0.0)
    tone, depth = np.array([170.0, 120.0, 95.0]), np.array([0.7, 2.1, 1.2])
    rgb = tone + beat[:, None] * depth + 0.04 * np.random.default_rng(9).standard_normal((len(beat), 3))
    assert abs(sig.rates(*sig.welch(sig.method(name)(rgb[None], fs), fs))[0] - 60 * hz) < 1.2


def test_methods_have_names():
    with pytest.raises(ValueError, match="unknown method"):
        sig.method("median")


def test_p_of_a_correlation_by_summing_its_density():
    from pulsegrid.functions.stats_np import correlation_p

    for n in (3, 4, 7, 25, 400):
        for rho in (0.0, 0.05, -0.4, 0.83):
            v = n - 2
            t = abs(rho) * np.sqrt(v / (1 - rho**2))
            angle = np.linspace(np.arctan(t / np.sqrt(v)), np.pi / 2, 200_001)  # t = sqrt(v) tan(angle) makes the density a power of its cosine
            whole = np.linspace(0, np.pi / 2, 200_001)
            area = lambda a: np.trapezoid(np.cos(a) ** (v - 1), a)
            assert abs(correlation_p(np.array([rho]), np.array([n]))[0] - area(angle) / area(whole)) < 1e-7
    assert correlation_p(np.array([1.0, np.nan, 0.5]), np.array([9, 9, 2])).tolist()[0] == 0 and np.isnan(correlation_p(np.array([np.nan, 0.5]), np.array([9, 2]))).all()
