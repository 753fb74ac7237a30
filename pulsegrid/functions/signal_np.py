"""Signal routines in numpy, from published definitions: Butterworth filters, zero-phase filtering with
least-squares initial states, Welch spectra, rate, SNR, stability, beats, and the projections.

Zero-phase filtering is linear in the signal, so for a given length it is one
matrix, built once per worker and applied to a whole batch of windows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

BAND_HZ = (0.7, 3.0)
MAD_TO_SIGMA = 1.4826
POS_SECONDS = 1.6


@lru_cache(64)
def butterworth(order: int, edges: tuple[float, ...], fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital Butterworth: high-pass for one edge, band-pass for two; bilinear with pre-warped edges."""
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    warped = [2 * fs * math.tan(math.pi * e / fs) for e in edges]
    if len(edges) == 1:
        p, z, gain = warped[0] / poles, np.zeros(order), np.real(1 / np.prod(-poles))
    else:
        width, centre = warped[1] - warped[0], warped[0] * warped[1]
        half = poles * width / 2
        root = np.sqrt(half**2 - centre)
        p, z, gain = np.concatenate([half + root, half - root]), np.zeros(order), width**order
    k = gain * np.real(np.prod(2 * fs - z) / np.prod(2 * fs - p))
    pz, zz = (2 * fs + p) / (2 * fs - p), (2 * fs + z) / (2 * fs - z)
    zz = np.concatenate([zz, -np.ones(len(pz) - len(zz))])
    return np.real(k * np.poly(zz)), np.real(np.poly(pz))


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed over the last axis, all rows at once."""
    y = np.empty_like(x)
    s = state.copy()
    for t in range(x.shape[-1]):
        v = x[:, t]
        out = b[0] * v + s[:, 0]
        s[:, :-1] = s[:, 1:]
        s[:, -1] = 0
        s += v[:, None] * b[1:] - out[:, None] * a[1:]
        y[:, t] = out
    return y


@lru_cache(32)
def zero_phase(order: int, edges: tuple[float, ...], fs: float, n: int) -> np.ndarray:
    """The matrix of forward-backward filtering of ``n`` samples.

    Initial states of both passes are those for which forward-then-backward and
    backward-then-forward agree best (least squares); y = x @ M.
    """
    b, a = butterworth(order, edges, fs)
    m = len(a) - 1
    eye, zero = np.eye(n), np.zeros((n, m))
    h = _run(b, a, eye, zero)  # row i: response to an impulse at i
    obs = _run(b, a, np.zeros((m, n)), np.eye(m))  # responses to unit initial states
    back = lambda x: _run(b, a, x[:, ::-1], np.zeros((len(x), m)))[:, ::-1]
    forward = lambda x: _run(b, a, x, np.zeros((len(x), m)))
    fb, bf = back(h), forward(h[::-1, ::-1])
    obs_fb, obs_bf = back(obs), obs[:, ::-1]
    # fb + obs_fb' s + rev(obs)' u = bf + obs' s2 ...: with states (forward s, backward u) shared by both orders
    left = np.concatenate([obs_fb - obs, obs_bf - forward(obs_bf)])
    states = np.linalg.lstsq(left.T, (bf - fb).T, rcond=None)[0]
    return fb + states.T @ np.concatenate([obs_fb, obs_bf])


def _centred(x):
    return x - x.mean(axis=-1, keepdims=True)


def detrend(x: np.ndarray, fs: float, cutoff: float = 0.5) -> np.ndarray:
    """High-pass rows of ``x``; short rows lose their mean only."""
    n = x.shape[-1]
    if n < 16:
        return _centred(x)
    return x @ zero_phase(2, (min(cutoff, 0.99 * fs / 2),), fs, n)


def bandpass(x: np.ndarray, fs: float, band: tuple[float, float] = BAND_HZ, order: int = 4) -> np.ndarray:
    n = x.shape[-1]
    lo, hi = band[0], min(band[1], 0.99 * fs / 2)
    if n < 3 * order or lo >= hi:
        return _centred(x)
    return x @ zero_phase(order, (lo, hi), fs, n)


def normalize(x: np.ndarray) -> np.ndarray:
    sd = x.std(axis=-1, keepdims=True)
    return np.where(sd < 1e-12, 0.0, _centred(x) / np.where(sd < 1e-12, 1.0, sd))


def welch(x: np.ndarray, fs: float, seconds: float = 12.0) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, power of each row): half-overlapping Hann segments, mean removed, zero-padded eightfold."""
    n = x.shape[-1]
    per = int(min(n, max(fs * seconds, 64)))
    if per < 16:
        return np.zeros(0), np.zeros((len(x), 0))
    nfft = int(2 ** math.ceil(math.log2(per * 8)))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(per) / per)
    step = per - per // 2
    total = 0.0
    starts = range(0, n - per + 1, step)
    for s in starts:
        total = total + np.abs(np.fft.rfft(_centred(x[:, s : s + per]) * window, nfft)) ** 2
    power = total / len(starts) / (fs * (window**2).sum())
    power[:, 1:-1] *= 2
    return np.fft.rfftfreq(nfft, 1 / fs), power


def rates(freqs: np.ndarray, power: np.ndarray, band: tuple[float, float] = BAND_HZ) -> np.ndarray:
    """Beats per minute of each row's band peak, refined by a parabola on the log spectrum; NaN without one."""
    out = np.full(len(power), np.nan)
    mask = (freqs >= band[0]) & (freqs <= band[1])
    if not mask.any():
        return out
    f, p = freqs[mask], power[:, mask]
    k = p.argmax(axis=1)
    at = np.arange(len(p))
    good = np.isfinite(p).all(axis=1) & (p[at, k] > 0)
    peak = f[k].astype(float)
    inner = (k > 0) & (k < len(f) - 1)
    c = np.clip(k, 1, max(1, len(f) - 2))
    if len(f) >= 3:
        y0, y1, y2 = (np.log(p[at, c + d] + 1e-30) for d in (-1, 0, 1))
        bend = y0 - 2 * y1 + y2
        delta = 0.5 * (y0 - y2) / np.where(np.abs(bend) > 1e-12, bend, np.inf)
        peak = np.where(inner & (np.abs(bend) > 1e-12) & (np.abs(delta) <= 1), peak + delta * (f[1] - f[0]), peak)
    out[good] = peak[good] * 60
    return out


def snr_db(freqs: np.ndarray, power: np.ndarray, hr: np.ndarray, half: float = 0.2, band: tuple[float, float] = BAND_HZ) -> np.ndarray:
    """Power near the rate and its double against the rest of the band; NaN where either is absent."""
    if not len(freqs):
        return np.full(len(power), np.nan)
    f0 = hr[:, None] / 60
    region = (freqs >= band[0]) & (freqs <= min(2 * band[1], freqs[-1]))
    near = ((np.abs(freqs - f0) <= half) | (np.abs(freqs - 2 * f0) <= half)) & region
    sig, noise = (power * near).sum(axis=1), (power * (region & ~near)).sum(axis=1)
    good = (sig > 0) & (noise > 0) & np.isfinite(hr)
    return np.where(good, 10 * np.log10(np.where(good, sig, 1) / np.where(good, noise, 1)), np.nan)


def stability(x: np.ndarray, fs: float, parts: int = 5) -> np.ndarray:
    """Robust spread of the rates of ``parts`` overlapping sub-windows; NaN where they coincide or one has no peak."""
    n = x.shape[-1]
    win = int(max(4.0, 0.6 * (n / fs)) * fs)
    step = (n - win) // (parts - 1) if n >= win else 0
    if n < win or win < int(fs * 4) or step <= 0:
        return np.full(len(x), np.nan)
    hr = np.stack([rates(*welch(x[:, i * step : i * step + win], fs)) for i in range(parts)], axis=1)
    med = np.median(hr, axis=1, keepdims=True)
    return MAD_TO_SIGMA * np.median(np.abs(hr - med), axis=1)


def beats(x: np.ndarray, fs: float, band: tuple[float, float] = BAND_HZ) -> np.ndarray:
    """Seconds between peaks of one trace: strict local maxima (plateaus at their middle), the higher of two too close."""
    if len(x) < int(fs * 2):
        return np.zeros(0)
    edge = np.flatnonzero(np.diff(x) != 0)
    starts, stops = np.r_[0, edge + 1], np.r_[edge, len(x) - 1]
    v = x[starts]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    peaks = (starts[top] + stops[top]) // 2
    gap = max(int(fs / band[1]), 1)
    keep = np.ones(len(peaks), bool)
    for j in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[j]:
            close = np.abs(peaks - peaks[j]) < gap
            close[j] = False
            keep[close] = False
    peaks = peaks[keep]
    return np.diff(peaks) / fs if len(peaks) >= 2 else np.zeros(0)


# --- projections; rgb: (windows, frames, 3)


def pos(rgb: np.ndarray, fs: float) -> np.ndarray:
    """Plane-orthogonal-to-skin: short windows normalised by their means, two projections, overlap-add."""
    m, n, _ = rgb.shape
    w = int(POS_SECONDS * fs)
    if n < 16 or w < 4:
        return np.zeros((m, n))
    slabs = np.lib.stride_tricks.sliding_window_view(rgb, w, axis=1)  # (m, starts, 3, w)
    mu = slabs.mean(axis=-1)
    good = (mu > 1e-9).all(axis=-1)
    c = slabs / np.where(mu > 1e-9, mu, 1.0)[..., None]
    s1, s2 = c[:, :, 1] - c[:, :, 2], c[:, :, 1] + c[:, :, 2] - 2 * c[:, :, 0]
    d1, d2 = s1.std(axis=-1), s2.std(axis=-1)
    alpha = np.where(d2 > 1e-12, d1 / np.where(d2 > 1e-12, d2, 1.0), 0.0)
    h = _centred(s1 + alpha[..., None] * s2) * good[..., None]
    out = np.zeros((m, n))
    for j in range(w):
        out[:, j : j + h.shape[1]] += h[:, :, j]
    return normalize(bandpass(out, fs))


def chrom(rgb: np.ndarray, fs: float) -> np.ndarray:
    """Chrominance: half-overlapping windows, two band-passed projections, Hann-weighted overlap-add."""
    m, n, _ = rgb.shape
    w = int(POS_SECONDS * fs)
    if n < 16 or w < 4:
        return np.zeros((m, n))
    out, weight, hann = np.zeros((m, n)), np.zeros((m, n)), np.hanning(w)
    for s in range(0, n - w + 1, max(w // 2, 1)):
        seg = rgb[:, s : s + w]
        mu = seg.mean(axis=1)
        good = (mu > 1e-9).all(axis=1)
        c = seg / np.where(mu > 1e-9, mu, 1.0)[:, None]
        x, y = bandpass(3 * c[..., 0] - 2 * c[..., 1], fs), bandpass(1.5 * c[..., 0] + c[..., 1] - 1.5 * c[..., 2], fs)
        sy = y.std(axis=1)
        alpha = np.where(sy > 1e-12, x.std(axis=1) / np.where(sy > 1e-12, sy, 1.0), 0.0)
        out[:, s : s + w] += hann * _centred(x - alpha[:, None] * y) * good[:, None]
        weight[:, s : s + w] += hann * good[:, None]
    return normalize(np.where(weight > 1e-9, out / np.where(weight > 1e-9, weight, 1.0), out))


def green(rgb: np.ndarray, fs: float) -> np.ndarray:
    return normalize(bandpass(detrend(rgb[..., 1], fs), fs))


METHODS = {"pos": pos, "chrom": chrom, "green": green}


def register(name: str, method) -> None:
    """Adds a projection: (windows, frames, 3), fs -> (windows, frames)."""
    METHODS[name] = method


def method(name: str):
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}; there are {sorted(METHODS)}")
    return METHODS[name]


def pulse(bvp: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    """Rate, SNR and stability of each row; NaN for rows under four seconds."""
    if bvp.shape[1] < int(fs * 4):
        return {k: np.full(len(bvp), np.nan) for k in ("hr_bpm", "pulse_snr_db", "hr_stability_bpm")}
    freqs, power = welch(bvp, fs)
    hr = rates(freqs, power)
    return {"hr_bpm": hr, "pulse_snr_db": snr_db(freqs, power, hr), "hr_stability_bpm": stability(bvp, fs)}


def cardiac(bvp: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    """``pulse`` and the features of beats of each row; NaN (0 beats) for rows under four seconds."""
    m, n = bvp.shape
    out = pulse(bvp, fs)
    if n < int(fs * 4):
        return out | {k: np.full(m, np.nan) for k in ("pulse_amplitude", "ibi_mean_s", "rmssd_proxy_ms")} | {"n_beats": np.zeros(m, np.int64)}
    ibis = [beats(row, fs) for row in bvp]
    return out | {
        "pulse_amplitude": np.percentile(bvp, 95, axis=1) - np.percentile(bvp, 5, axis=1),
        "ibi_mean_s": np.array([x.mean() if len(x) else np.nan for x in ibis]),
        "rmssd_proxy_ms": np.array([np.sqrt(np.mean(np.diff(x) ** 2)) * 1000 if len(x) >= 3 else np.nan for x in ibis]),
        "n_beats": np.array([len(x) + 1 if len(x) else 0 for x in ibis], np.int64),
    }


def fill_gaps(rgb: np.ndarray, valid: np.ndarray, fs: float, max_gap_s: float = 0.5) -> np.ndarray | None:
    """One window's trace with short gaps interpolated; None for a longer one."""
    bad = ~valid
    edge = np.flatnonzero(np.diff(np.r_[False, bad, False]))
    if len(edge) and (edge[1::2] - edge[::2]).max() > int(max_gap_s * fs) or not valid.any():
        return None
    if not bad.any():
        return rgb
    i = np.arange(len(rgb))
    return np.stack([np.interp(i, i[valid], rgb[valid, c]) for c in range(3)], axis=1)


def spectral_cross_entropy(x: np.ndarray, bpm: np.ndarray, fs: float, sigma_bpm: float = 3.0, pad: int = 4) -> np.ndarray:
    """Cross-entropy of each row's band spectrum against a Gaussian around its reference rate."""
    n = x.shape[-1]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.abs(np.fft.rfft(_centred(x) * window, n * pad)) ** 2
    f = np.fft.rfftfreq(n * pad, 1 / fs)
    mask = (f >= BAND_HZ[0]) & (f <= BAND_HZ[1])
    logits = np.log(power[:, mask] + 1e-12)
    target = np.exp(-0.5 * ((f[mask] * 60 - np.asarray(bpm)[:, None]) / sigma_bpm) ** 2)
    target /= target.sum(axis=1, keepdims=True) + 1e-12
    top = logits.max(axis=1, keepdims=True)
    return -(target * (logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True)))).sum(axis=1)
