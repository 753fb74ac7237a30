"""DuckDB text of the offline analysis: windows, gates, gap filling, projections, filters, spectra, rate, SNR, stability, beats, confidence.

Filtering without phase is linear, so for a window length it is one matrix, which stands in the text as rows (i, j, weight); spectra are sums over cosines and sines
of the bins asked for. Everything else is written from its definition, a row a sample of a window.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pulsegrid.functions import scoring as sc
from pulsegrid.functions import signal_np as sig
from pulsegrid.plans.frame_queries import QUALITY_SQL
from pulsegrid.plans.tables import FRAMES_SQL

LOW, HIGH = sig.BAND_HZ
PI = "3.141592653589793::DOUBLE"


@lru_cache(8)
def _matrix(kind: str, fps: float, n: int) -> str:
    """Weights of detrending or band-passing ``n`` samples: y[j] = sum of x[i] * w."""
    order, edges = (2, (0.5,)) if kind == "detrend" else (4, sig.BAND_HZ)
    m = sig.zero_phase(order, edges, fps, n)
    return "(VALUES " + ", ".join(f"({i}, {j}, {float(m[i, j])!r}::DOUBLE)" for i in range(n) for j in range(n)) + ") AS w(i, j, w)"


def _filtered(name: str, source: str, kind: str, fps: float, n: int) -> str:
    """``name`` (w, j, x): ``source`` (w, j, x) through a matrix."""
    return f"{name} AS (SELECT s.w, m.j, sum(s.x * m.w) AS x FROM {source} s JOIN {_matrix(kind, fps, n).replace('AS w(i, j, w)', 'AS m(i, j, w)')} ON m.i = s.j GROUP BY 1, 2)"


def _normal(name: str, source: str) -> str:
    return f"""{name} AS (SELECT w, j, CASE WHEN sd < 1e-12 THEN 0.0::DOUBLE ELSE (x - mean) / sd END AS x
 FROM (SELECT *, avg(x) OVER (PARTITION BY w) AS mean, stddev_pop(x) OVER (PARTITION BY w) AS sd FROM {source}))"""


def rates(name: str, source: str, fps: float, n: int, keep: bool = False) -> str:
    """``name`` (w, hr): rates of signals ``source`` (w, j, x) of ``n`` samples, one segment long; the spectrum stays as ``name``_p if ``keep``."""
    size = 2 ** math.ceil(math.log2(8 * n))
    top = min(2 * HIGH, fps / 2)
    first, last, end = math.ceil(LOW * size / fps), math.floor(HIGH * size / fps), math.floor(top * size / fps)
    end = end if keep else last
    return f"""{name}_c AS (SELECT w, j, (x - avg(x) OVER (PARTITION BY w)) * (0.5 - 0.5 * cos(2 * {PI} * j / {n})) AS x FROM {source}),
{name}_b AS (SELECT j, k, cos(2 * {PI} * j * k / {size}) AS c, sin(2 * {PI} * j * k / {size}) AS s FROM (SELECT unnest(range({n})) AS j), (SELECT unnest(range({first}, {end} + 1)) AS k)),
{name}_p AS MATERIALIZED (SELECT w, k, (pow(sum(x * c), 2) + pow(sum(x * s), 2)) * CASE WHEN k = {size // 2} THEN 1 ELSE 2 END AS p FROM {name}_c JOIN {name}_b USING (j) GROUP BY w, k),
{name}_n AS (SELECT *, ln(p + {name}_e) AS l, ln(lag(p) OVER o + {name}_e) AS l0, ln(lead(p) OVER o + {name}_e) AS l2, row_number() OVER (PARTITION BY w ORDER BY p DESC, k) AS rn
 FROM (SELECT *, {1e-30 * fps * 0.375 * n!r}::DOUBLE AS {name}_e FROM {name}_p WHERE k <= {last}) WINDOW o AS (PARTITION BY w ORDER BY k)),
{name} AS (SELECT w, CASE WHEN p > 0 THEN 60 * {fps}::DOUBLE / {size} * (k + CASE WHEN k > {first} AND k < {last} AND abs(l0 - 2 * l + l2) > 1e-12 AND abs(0.5 * (l0 - l2) / (l0 - 2 * l + l2)) <= 1
 THEN 0.5 * (l0 - l2) / (l0 - 2 * l + l2) ELSE 0 END) END AS hr FROM {name}_n WHERE rn = 1)"""


def windows(fps: float, win: int, stride: int) -> str:
    """``win_q``: gates and quality of every window w; ``use_rgb`` (w, j, r, g, b): the filled samples of those behind both gates."""
    limit = int(sc.MAX_GAP_S * fps)
    line = lambda c: f"""CASE WHEN ok THEN {c} WHEN lo IS NULL THEN hi.{c} WHEN hi IS NULL THEN lo.{c} ELSE lo.{c} + (hi.{c} - lo.{c}) * (j - lo.j) / (hi.j - lo.j)::DOUBLE END AS {c}"""
    return f"""{FRAMES_SQL}, {QUALITY_SQL},
tr AS (SELECT recording_id, i, x + 50 AS r, x * 0.7::DOUBLE + k + 40 AS g, x * 0.4::DOUBLE + (k * 7) % 101 + 30 AS b, k::DOUBLE AS bvp, x / 5.0::DOUBLE + (((k * 37) % 101) - 50) / 5.0::DOUBLE AS hr,
 coalesce(valid, false) AND x IS NOT NULL AND k IS NOT NULL AS ok, face, lighting, sharpness, motion, compression FROM quality),
len AS (SELECT recording_id, count(*) AS n FROM tr GROUP BY 1),
win AS (SELECT row_number() OVER (ORDER BY recording_id, start) AS w, * FROM (SELECT recording_id, unnest(range(0, n - {win} + 1, {stride})) AS start FROM len WHERE n >= {win})),
s AS MATERIALIZED (SELECT w, t.i - start AS j, t.* EXCLUDE (recording_id, i) FROM win JOIN tr t ON t.recording_id = win.recording_id AND t.i >= start AND t.i < start + {win}),
gaps AS (SELECT *, j - coalesce(max(CASE WHEN ok THEN j END) OVER (PARTITION BY w ORDER BY j), -1) AS lost FROM s),
win_g AS (SELECT w, avg(ok::INT) AS ratio, max(lost) AS gap, CASE WHEN count(hr) = count(*) THEN avg(hr) END AS gt,
 coalesce(quantile_cont(face, 0.1) FILTER (WHERE ok), 0) AS face, coalesce(quantile_cont(motion, 0.1) FILTER (WHERE ok), 1) AS motion, coalesce(avg(lighting) FILTER (WHERE ok), 0) AS lighting,
 coalesce(avg(sharpness) FILTER (WHERE ok), 0) AS sharpness, coalesce(avg(compression) FILTER (WHERE ok), 1) AS compression FROM gaps GROUP BY w),
win_q AS (SELECT *, ratio >= {sc.MIN_VALID_RATIO} AND gap <= {limit} AND ratio > 0 AS used,
 greatest(0, least(1, {' + '.join(f'{v}::DOUBLE * ' + ('1' if c == 'fps_stability' else c) for c, v in sc.WINDOW_WEIGHTS.items())})) * ratio AS overall,
 ({' + '.join(f'{v}::DOUBLE * greatest(0, least(1, {c}))' for c, v in sc.IMAGE_WEIGHTS.items())}) * ratio AS image FROM win_g),
ends AS (SELECT s.w, j, ok, r, g, b, last_value(CASE WHEN ok THEN struct_pack(j := j, r := r, g := g, b := b) END IGNORE NULLS) OVER (PARTITION BY s.w ORDER BY j) AS lo,
 first_value(CASE WHEN ok THEN struct_pack(j := j, r := r, g := g, b := b) END IGNORE NULLS) OVER (PARTITION BY s.w ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM s JOIN win_q USING (w) WHERE used),
use_rgb AS MATERIALIZED (SELECT w, j, {line('r')}, {line('g')}, {line('b')} FROM ends)"""


def _slabs(name: str, length: int, starts: str) -> str:
    """Samples of short windows inside each window, divided by their means; means that vanish spoil a slab."""
    part = lambda c: f"{c} / CASE WHEN avg({c}) OVER v > 1e-9 THEN avg({c}) OVER v ELSE 1.0 END AS {c}"
    return f"""{name} AS (SELECT w, a, j, {part('r')}, {part('g')}, {part('b')}, avg(r) OVER v > 1e-9 AND avg(g) OVER v > 1e-9 AND avg(b) OVER v > 1e-9 AS good
 FROM use_rgb JOIN ({starts}) st ON j >= a AND j < a + {length} WINDOW v AS (PARTITION BY w, a))"""


def projection(method: str, fps: float, win: int) -> str:
    """``<method>_x`` (w, j, x): the pulse signal of each used window."""
    length = int(sig.POS_SECONDS * fps)
    if method == "green":
        return f"green_0 AS (SELECT w, j, g AS x FROM use_rgb),\n{_filtered('green_d', 'green_0', 'detrend', fps, win)},\n{_filtered('green_f', 'green_d', 'band', fps, win)},\n{_normal('green_x', 'green_f')}"
    if method == "pos":
        return f"""{_slabs('pos_s', length, f'SELECT unnest(range({win} - {length} + 1)) AS a')},
pos_1 AS (SELECT w, a, j, good, g - b AS x, g + b - 2 * r AS y FROM pos_s),
pos_2 AS (SELECT w, a, j, good, x + CASE WHEN stddev_pop(y) OVER v > 1e-12 THEN stddev_pop(x) OVER v / stddev_pop(y) OVER v ELSE 0 END * y AS h FROM pos_1 WINDOW v AS (PARTITION BY w, a)),
pos_3 AS (SELECT w, j, CASE WHEN good THEN h - avg(h) OVER (PARTITION BY w, a) ELSE 0 END AS h FROM pos_2),
pos_0 AS (SELECT w, j, sum(h) AS x FROM pos_3 GROUP BY 1, 2),
{_filtered('pos_f', 'pos_0', 'band', fps, win)},
{_normal('pos_x', 'pos_f')}"""
    starts = f"SELECT unnest(range(0, {win} - {length} + 1, {max(length // 2, 1)})) AS a"
    key = "w * 1000 + a"
    return f"""{_slabs('chrom_s', length, starts)},
chrom_l AS (SELECT {key} AS w, j - a AS j, 3 * r - 2 * g AS x FROM chrom_s), chrom_r AS (SELECT {key} AS w, j - a AS j, 1.5 * r + g - 1.5 * b AS x FROM chrom_s),
{_filtered('chrom_u', 'chrom_l', 'band', fps, length)},
{_filtered('chrom_v', 'chrom_r', 'band', fps, length)},
chrom_1 AS (SELECT u.w, u.j, u.x, v.x AS y FROM chrom_u u JOIN chrom_v v ON v.w = u.w AND v.j = u.j),
chrom_2 AS (SELECT w, j, x - CASE WHEN stddev_pop(y) OVER v > 1e-12 THEN stddev_pop(x) OVER v / stddev_pop(y) OVER v ELSE 0 END * y AS h FROM chrom_1 WINDOW v AS (PARTITION BY w)),
chrom_3 AS (SELECT s.w, s.j, s.good, 0.5 - 0.5 * cos(2 * {PI} * (s.j - s.a) / {length - 1}) AS hann, h - avg(h) OVER (PARTITION BY c.w) AS h FROM chrom_2 c JOIN chrom_s s ON s.w * 1000 + s.a = c.w AND s.j - s.a = c.j),
chrom_4 AS (SELECT w, j, sum(CASE WHEN good THEN hann * h ELSE 0 END) AS x, sum(CASE WHEN good THEN hann ELSE 0 END) AS n FROM chrom_3 GROUP BY 1, 2),
chrom_0 AS (SELECT u.w, u.j, CASE WHEN n > 1e-9 THEN x / n ELSE coalesce(x, 0) END AS x FROM use_rgb u LEFT JOIN chrom_4 c ON c.w = u.w AND c.j = u.j),
{_normal('chrom_x', 'chrom_0')}"""


def cardiac(method: str, fps: float, win: int) -> str:
    """``<method>`` (w, hr, snr, spread, n_beats) of the signals ``<method>_x``."""
    m = method
    size = 2 ** math.ceil(math.log2(8 * win))
    part = int(max(4.0, 0.6 * (win / fps)) * fps)
    step = (win - part) // 4
    near = f"abs(k * {fps}::DOUBLE / {size} - hr / 60) <= 0.2 OR abs(k * {fps}::DOUBLE / {size} - hr / 30) <= 0.2"
    return f"""{rates(f'{m}_hr', f'{m}_x', fps, win, keep=True)},
{m}_snr AS (SELECT w, sum(p) FILTER (WHERE {near}) AS sig, sum(p) FILTER (WHERE NOT ({near})) AS noise FROM {m}_hr_p JOIN {m}_hr USING (w) GROUP BY 1),
{m}_parts AS (SELECT w * 10 + a AS w, j - a * {step} AS j, x FROM {m}_x JOIN (SELECT unnest(range(5)) AS a) ON j >= a * {step} AND j < a * {step} + {part}),
{rates(f'{m}_sub', f'{m}_parts', fps, part)},
{m}_mid AS (SELECT w // 10 AS w, hr, median(hr) OVER (PARTITION BY w // 10) AS mid, count(hr) OVER (PARTITION BY w // 10) AS n FROM {m}_sub),
{m}_dev AS (SELECT w, CASE WHEN min(n) = 5 THEN {sig.MAD_TO_SIGMA}::DOUBLE * median(abs(hr - mid)) END AS spread FROM {m}_mid GROUP BY 1),
{m}_top AS (SELECT w, x > lag(x) OVER o AND x > lead(x) OVER o AS top FROM {m}_x WINDOW o AS (PARTITION BY w ORDER BY j)),
{m}_n AS (SELECT w, count(*) FILTER (WHERE top) AS tops FROM {m}_top GROUP BY 1),
{m} AS (SELECT w, hr, CASE WHEN sig > 0 AND noise > 0 THEN 10 * log10(sig / noise) END AS snr, spread, CASE WHEN tops >= 2 THEN tops ELSE 0 END AS n_beats
 FROM {m}_hr JOIN {m}_snr USING (w) JOIN {m}_dev USING (w) JOIN {m}_n USING (w))"""


def analysed(method: str, fps: float) -> str:
    """``<method>_a``: every window with rate, SNR, confidence and reason."""
    limit, m = int(sc.MAX_GAP_S * fps), method
    return f"""{m}_k AS (SELECT q.*, win.recording_id, win.start, hr AS hr_bpm, snr, spread, coalesce(n_beats, 0) AS n_beats, CASE WHEN snr IS NULL OR spread IS NULL THEN 0
 ELSE 1 / (1 + exp(-(snr - {sc.SNR_MID_DB}) / {sc.SNR_SCALE_DB})) * exp(-pow(spread / {sc.STABILITY_SCALE_BPM}, 2)) END AS pulse FROM win_q q JOIN win USING (w) LEFT JOIN {m} USING (w)),
{m}_a AS (SELECT *, greatest(0, least(1, image * pulse)) AS confidence, CASE WHEN ratio < {sc.MIN_VALID_RATIO} THEN 'insufficient_valid_frames' WHEN gap > {limit} THEN 'signal_gap_too_long'
 WHEN overall < {sc.MIN_WINDOW_QUALITY} THEN 'low_quality' WHEN greatest(0, least(1, image * pulse)) < {sc.ABSTAIN_BELOW} THEN 'low_confidence' WHEN hr_bpm IS NULL THEN 'no_hr_peak' END AS reason FROM {m}_k)"""


def bvp(method: str, fps: float, win: int, stride: int) -> str:
    """Twin of one method's windows."""
    return f"""WITH {windows(fps, win, stride)},
{projection(method, fps, win)},
{cardiac(method, fps, win)},
{analysed(method, fps)}
SELECT recording_id, '{method}' AS method, start / {fps}::DOUBLE AS start_s, round(hr_bpm, 3) AS hr_bpm, round(snr, 3) AS pulse_snr_db, round(confidence, 4) AS confidence, reason, n_beats::BIGINT AS n_beats FROM {method}_a"""


def truth(fps: float, win: int, stride: int) -> str:
    """Twin of the contact trace's rate per window."""
    return f"""WITH {FRAMES_SQL}, f AS (SELECT recording_id, i, k::DOUBLE AS x, count(*) OVER (PARTITION BY recording_id) AS n FROM frames),
win AS (SELECT row_number() OVER (ORDER BY recording_id, start) AS w, * FROM (SELECT DISTINCT recording_id, unnest(range(0, n - {win} + 1, {stride})) AS start FROM f WHERE n >= {win})),
raw AS (SELECT w, i - start AS j, x FROM win JOIN f ON f.recording_id = win.recording_id AND i >= start AND i < start + {win}),
{_filtered('flt', 'raw', 'band', fps, win)},
{rates('rate', 'flt', fps, win)}
SELECT recording_id, start / {fps}::DOUBLE AS start_s, round(hr, 3) AS hr_gt FROM win LEFT JOIN rate USING (w)"""


def benchmark(methods: list[str], fps: float, win: int, stride: int) -> str:
    """Twin of all methods over all recordings: errors per recording, then across them, and the bars."""
    each = ",\n".join(f"{projection(m, fps, win)},\n{cardiac(m, fps, win)},\n{analysed(m, fps)}" for m in methods)
    rows = " UNION ALL ".join(f"SELECT '{m}' AS method, recording_id, hr_bpm AS hr, gt, reason IS NULL AS valid, snr, overall AS quality FROM {m}_a" for m in methods)
    pair = "valid AND hr IS NOT NULL AND gt IS NOT NULL"
    return f"""WITH {windows(fps, win, stride)},
{each},
everything AS ({rows}),
subj AS (SELECT method, recording_id, count(*) AS n_windows, count(*) FILTER (WHERE valid) AS n_valid, avg(abs(hr - gt)) FILTER (WHERE {pair}) AS mae, avg(abs(hr - gt)) AS mae_all,
 coalesce(avg(abs(hr - gt)) <= 5, true) AS usable FROM everything GROUP BY 1, 2),
bench AS (SELECT method, count(*) AS n_subjects, sum(n_windows)::BIGINT AS n_windows, sum(n_valid)::DOUBLE / sum(n_windows) AS coverage, median(mae_all) AS median_mae_all, max(mae_all) AS worst_mae_all, avg(usable::INT) AS usable_rate,
 median(mae) AS median_mae, avg(mae) AS mean_mae, max(mae) AS worst_mae, (sum(n_valid) FILTER (WHERE usable))::DOUBLE / nullif(sum(n_windows) FILTER (WHERE usable), 0) AS coverage_within_usable FROM subj GROUP BY 1)
SELECT method, n_subjects, n_windows, {', '.join(f'round({c}, 4) AS {c}' for c in ('coverage', 'median_mae_all', 'worst_mae_all', 'usable_rate', 'median_mae', 'mean_mae', 'worst_mae', 'coverage_within_usable'))},
 coalesce(median_mae_all <= 5, false) AS go_mae, coalesce(coverage >= 0.8, false) AS go_coverage, coalesce(median_mae_all <= 5, false) AND coalesce(coverage >= 0.8, false) AS go FROM bench"""
