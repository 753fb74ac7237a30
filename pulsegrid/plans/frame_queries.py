"""Queries over frame traces: rates, quality scores, windows, gaps, resampling and projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pulsegrid.functions import scoring as sc
from pulsegrid.operators import windows as win
from pulsegrid.plans.catalog import query
from pulsegrid.plans.tables import FRAMES_SQL, frames, table

R = lambda c, name=None: F.round(c if not isinstance(c, str) else F.col(c), 6).alias(name or c)
CLIP = "CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x})) END"

#: Quality columns made from an event: k spreads face, motion and the rest over [0, 1].
QUALITY_SQL = """
quality AS (SELECT *, k / 100.0::DOUBLE AS face, (100 - k) / 100.0::DOUBLE AS motion, ((k * 7) % 101) / 100.0::DOUBLE AS lighting,
  ((k * 13) % 101) / 100.0::DOUBLE AS sharpness, ((k * 29) % 101) / 100.0::DOUBLE AS compression FROM frames)
"""


def quality_frames(spark, sf_dir):
    k = F.col("k")
    mod = lambda m: F.pmod(k * m, F.lit(101)) / F.lit(100.0)
    return frames(spark, sf_dir).withColumns({"face": k / F.lit(100.0), "motion": (100 - k) / F.lit(100.0), "lighting": mod(7), "sharpness": mod(13), "compression": mod(29)})


@query("measured_fps", f"""WITH {FRAMES_SQL}
SELECT recording_id, count(us) AS n_stamps, round(CASE WHEN count(us) >= 10 AND max(us) > min(us) THEN (count(us) - 1) / ((max(us) - min(us)) / 1e6) END, 12) AS fps
FROM frames GROUP BY 1""")  # fmt: skip
def measured_fps(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("t", F.col("us") / 1e6)
    return win.measured_fps(rows, ["recording_id"], "t").select("recording_id", "n_stamps", F.round("fps", 12).alias("fps"))


@query("fps_stability", f"""WITH {FRAMES_SQL}, d AS (SELECT recording_id, us / 1e6 - lag(us / 1e6) OVER (PARTITION BY recording_id ORDER BY us) AS dt FROM frames),
a AS (SELECT recording_id, count(*) AS n_frames, avg(dt) AS m, stddev_pop(dt) AS s FROM d GROUP BY 1)
SELECT recording_id, n_frames, round(CASE WHEN n_frames >= 3 AND m > 0 THEN greatest(0.0, least(1.0, 1.0 - s / m)) ELSE 0.0 END, 6)::DOUBLE AS fps_stability FROM a""")  # fmt: skip
def fps_stability(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("t", F.col("us") / 1e6)
    return win.fps_stability(rows, ["recording_id"], "t").select("recording_id", "n_frames", R("fps_stability"))


@query("motion_score", f"""WITH {FRAMES_SQL}, d AS (SELECT event_id, recording_id, abs(x - lag(x) OVER (PARTITION BY recording_id ORDER BY i)) AS disp FROM frames)
SELECT event_id, recording_id, round({CLIP.format(x='1.0 - disp / 500.0 / 0.08')}, 6) AS motion FROM d""")  # fmt: skip
def motion_score(spark, sf_dir):
    rows = frames(spark, sf_dir)
    disp = F.abs(F.col("x") - F.lag("x").over(W.partitionBy("recording_id").orderBy("i")))
    return rows.withColumn("disp", disp).select("event_id", "recording_id", R(sc.motion(F.col("disp"), F.lit(500.0)), "motion"))


@query("lighting_score", f"""WITH {FRAMES_SQL}, l AS (SELECT event_id, least(x, 255.0) AS luma, k / 1000.0::DOUBLE AS clipped FROM frames)
SELECT event_id, round({CLIP.format(x='(CASE WHEN luma < 60 THEN luma / 60.0::DOUBLE WHEN luma > 200 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - (luma - 200) / 55.0::DOUBLE) ELSE 1.0::DOUBLE END) * (1.0::DOUBLE - clipped)')}, 10) AS lighting FROM l""")  # fmt: skip
def lighting_score(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return rows.select("event_id", F.round(sc.lighting(F.least("x", F.lit(255.0)), F.col("k") / F.lit(1000.0)), 10).alias("lighting"))


@query("sharpness_score", f"WITH {FRAMES_SQL} SELECT event_id, round(x / (x + 8.0::DOUBLE), 6) AS sharpness FROM frames")
def sharpness_score(spark, sf_dir):
    return frames(spark, sf_dir).select("event_id", R(sc.sharpness(F.col("x")), "sharpness"))


@query("compression_score", f"""WITH {FRAMES_SQL}, c AS (SELECT event_id, x / 5000.0::DOUBLE AS ratio, k / 100.0::DOUBLE AS block FROM frames)
SELECT event_id, round({CLIP.format(x='(log10(greatest(ratio, 1e-9)) - log10(0.001::DOUBLE)) / (log10(0.05::DOUBLE) - log10(0.001::DOUBLE))')} / (1.0::DOUBLE + 8.0::DOUBLE * block), 6) AS compression FROM c""")  # fmt: skip
def compression_score(spark, sf_dir):
    return frames(spark, sf_dir).select("event_id", R(sc.compression(F.col("x") / F.lit(5000.0), F.col("k") / F.lit(100.0)), "compression"))


@query("frame_overall", f"""WITH {FRAMES_SQL}, {QUALITY_SQL}
SELECT event_id, round({CLIP.format(x='0.30::DOUBLE * face + 0.20::DOUBLE * lighting + 0.18::DOUBLE * motion + 0.15::DOUBLE * sharpness + 0.17::DOUBLE * compression')}, 6) AS overall FROM quality""")  # fmt: skip
def frame_overall(spark, sf_dir):
    cols = {c: F.col(c) for c in sc.FRAME_WEIGHTS}
    return quality_frames(spark, sf_dir).select("event_id", R(sc.weighted(sc.FRAME_WEIGHTS, cols), "overall"))


_P10 = f"""
wq AS (SELECT recording_id, quantile_cont(face, 0.1) FILTER (WHERE valid) AS face, quantile_cont(motion, 0.1) FILTER (WHERE valid) AS motion,
  avg(lighting) FILTER (WHERE valid) AS lighting, avg(sharpness) FILTER (WHERE valid) AS sharpness, avg(compression) FILTER (WHERE valid) AS compression,
  avg(valid::INT) AS valid_ratio, count(*) FILTER (WHERE valid) AS n_valid FROM quality GROUP BY 1)
"""


@query("quality_window_p10", f"""WITH {FRAMES_SQL}, {QUALITY_SQL}, {_P10}
SELECT recording_id, round(face, 6) AS face, round(motion, 6) AS motion, round(lighting, 6) AS lighting, round(sharpness, 6) AS sharpness, round(compression, 6) AS compression,
 round(valid_ratio, 6) AS valid_ratio, n_valid, CASE WHEN n_valid = 0 THEN 'no_valid_frames' END AS reason FROM wq""")  # fmt: skip
def quality_window_p10(spark, sf_dir):
    q = win.window_quality(quality_frames(spark, sf_dir), ["recording_id"])
    return q.select("recording_id", *[R(c) for c in ("face", "motion", "lighting", "sharpness", "compression", "valid_ratio")], "n_valid", "reason")


@query("window_overall", f"""WITH {FRAMES_SQL}, {QUALITY_SQL}, {_P10}
SELECT recording_id, round({CLIP.format(x='0.25::DOUBLE * face + 0.16::DOUBLE * lighting + 0.16::DOUBLE * motion + 0.12::DOUBLE * sharpness + 0.19::DOUBLE * compression + 0.12::DOUBLE')} * valid_ratio, 6) AS overall FROM wq""")  # fmt: skip
def window_overall(spark, sf_dir):
    q = win.window_quality(quality_frames(spark, sf_dir), ["recording_id"])
    cols = {c: F.col(c) for c in sc.WINDOW_WEIGHTS if c != "fps_stability"} | {"fps_stability": F.lit(1.0)}
    return q.select("recording_id", R(sc.window_overall(cols, F.col("valid_ratio")), "overall"))


@query("hop_windows", f"""WITH {FRAMES_SQL}, n AS (SELECT recording_id, count(*) AS n FROM frames GROUP BY 1),
s AS (SELECT recording_id, unnest(generate_series(0, n - 20, 5)) AS start FROM n WHERE n >= 20)
SELECT s.recording_id, s.start, count(*) AS n_frames, round(avg(f.x), 6) AS mean_x, round(avg(f.valid::INT), 6) AS valid_ratio
FROM s JOIN frames f ON f.recording_id = s.recording_id AND f.i >= s.start AND f.i < s.start + 20 GROUP BY 1, 2""")  # fmt: skip
def hop_windows(spark, sf_dir):
    w = win.hop_windows(frames(spark, sf_dir), 20, 5)
    return w.groupBy("recording_id", "start").agg(F.count("*").alias("n_frames"), R(F.avg("x"), "mean_x"), R(F.avg(F.col("valid").cast("int")), "valid_ratio"))


_RUNS = """
isl AS (SELECT *, sum(valid::INT) OVER (PARTITION BY recording_id ORDER BY i) AS island FROM frames),
runs AS (SELECT recording_id, island, count(*) AS n, sum(valid::INT) AS ok FROM isl GROUP BY 1, 2),
gaps AS (SELECT recording_id, sum(n)::BIGINT AS n_frames, sum(ok)::DOUBLE / sum(n) AS valid_ratio, max(n - ok)::BIGINT AS longest_gap FROM runs GROUP BY 1)
"""


@query("gap_runs", f"WITH {FRAMES_SQL}, {_RUNS} SELECT recording_id, n_frames, round(valid_ratio, 6) AS valid_ratio, longest_gap FROM gaps")
def gap_runs(spark, sf_dir):
    return win.longest_gap(frames(spark, sf_dir), ["recording_id"]).select("recording_id", "n_frames", R("valid_ratio"), "longest_gap")


@query("valid_ratio_gate", f"""WITH {FRAMES_SQL}, {_RUNS} SELECT recording_id, CASE WHEN valid_ratio < 0.75 THEN 'insufficient_valid_frames' WHEN longest_gap > 3 THEN 'signal_gap_too_long' END AS reason FROM gaps""")
def valid_ratio_gate(spark, sf_dir):
    g = win.longest_gap(frames(spark, sf_dir), ["recording_id"])
    one = F.lit(1.0)
    return g.select("recording_id", sc.decision(F.col("valid_ratio"), F.col("longest_gap"), F.lit(3), one, one, one).alias("reason"))


@query("gap_fill_linear", f"""WITH {FRAMES_SQL}, e AS (SELECT *,
  max(CASE WHEN valid THEN i END) OVER (PARTITION BY recording_id ORDER BY i) AS bi,
  min(CASE WHEN valid THEN i END) OVER (PARTITION BY recording_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ai FROM frames)
SELECT e.recording_id, e.i, round(CASE WHEN e.valid THEN e.x WHEN e.bi IS NULL THEN a.x WHEN e.ai IS NULL THEN b.x
  ELSE b.x + (a.x - b.x) * (e.i - e.bi) / (e.ai - e.bi) END, 6) AS filled
FROM e LEFT JOIN frames b ON b.recording_id = e.recording_id AND b.i = e.bi LEFT JOIN frames a ON a.recording_id = e.recording_id AND a.i = e.ai""")  # fmt: skip
def gap_fill_linear(spark, sf_dir):
    return win.gap_fill(frames(spark, sf_dir)).select("recording_id", "i", R("filled"))


@query("resample_linear", f"""WITH {FRAMES_SQL}, t AS (SELECT recording_id, i AS j, x, lead(x) OVER (PARTITION BY recording_id ORDER BY i) AS nx FROM frames),
m AS (SELECT recording_id, max(j) AS top FROM t GROUP BY 1),
g AS (SELECT recording_id, top, unnest(generate_series(0, floor(top / 64.0::DOUBLE * 30.0::DOUBLE)::BIGINT)) AS i FROM m)
SELECT g.recording_id, g.i, round(t.x + (coalesce(t.nx, t.x) - t.x) * (g.i * 64.0::DOUBLE / 30.0::DOUBLE - t.j), 6) AS x
FROM g JOIN t ON t.recording_id = g.recording_id AND t.j = least(floor(g.i * 64.0::DOUBLE / 30.0::DOUBLE)::BIGINT, g.top)""")  # fmt: skip
def resample_linear(spark, sf_dir):
    trace = frames(spark, sf_dir).select("recording_id", F.col("i").alias("j"), "x")
    return win.resample(trace, 64.0, 30.0).select("recording_id", "i", R("x"))


@query("window_condition", f"""WITH {FRAMES_SQL}, n AS (SELECT recording_id, count(*) AS n FROM frames GROUP BY 1),
s AS (SELECT recording_id, unnest(generate_series(0, n - 20, 5)) AS s FROM n WHERE n >= 20)
SELECT recording_id, s AS start, CASE WHEN s + 20 <= 30 THEN 'rest' WHEN s >= 30 + 10 AND s + 20 <= 60 THEN 'task' WHEN s >= 60 + 10 THEN 'recovery' END AS condition FROM s""")  # fmt: skip
def window_condition(spark, sf_dir):
    starts = win.hop_windows(frames(spark, sf_dir), 20, 5).select("recording_id", "start").distinct()
    s = F.col("start")
    cond = F.when(s + 20 <= 30, "rest").when((s >= 40) & (s + 20 <= 60), "task").when(s >= 70, "recovery")
    return starts.withColumn("condition", cond)


@query("normalize_trace", f"""WITH {FRAMES_SQL}, s AS (SELECT *, avg(x) OVER (PARTITION BY recording_id) AS m, stddev_pop(x) OVER (PARTITION BY recording_id) AS sd FROM frames)
SELECT recording_id, i, round(CASE WHEN sd < 1e-12 THEN 0.0 ELSE (x - m) / sd END, 6)::DOUBLE AS z FROM s""")  # fmt: skip
def normalize_trace(spark, sf_dir):
    return win.normalize(frames(spark, sf_dir), ["recording_id"], "x").select("recording_id", "i", R("z"))


@query("diff_label", f"""WITH {FRAMES_SQL}, d AS (SELECT recording_id, i, x - lag(x) OVER (PARTITION BY recording_id ORDER BY i) AS d FROM frames),
s AS (SELECT recording_id, i, d, avg(d) OVER (PARTITION BY recording_id) AS m, stddev_pop(d) OVER (PARTITION BY recording_id) AS sd FROM d WHERE d IS NOT NULL)
SELECT recording_id, i, round(CASE WHEN sd < 1e-12 THEN 0.0 ELSE (d - m) / sd END, 6)::DOUBLE AS label FROM s""")  # fmt: skip
def diff_label(spark, sf_dir):
    d = frames(spark, sf_dir).withColumn("d", F.col("x") - F.lag("x").over(W.partitionBy("recording_id").orderBy("i"))).where("d IS NOT NULL")
    return win.normalize(d, ["recording_id"], "d").select("recording_id", "i", R("z", "label"))


_RGB = """
rgb AS (SELECT recording_id, i, x + 50 AS r, x * 0.7::DOUBLE + k + 40 AS g, x * 0.4::DOUBLE + ((k * 7) % 101) + 30 AS b FROM frames)
"""


@query("pos_overlap_add", f"""WITH {FRAMES_SQL}, {_RGB}, c AS (
  SELECT *, count(*) OVER a AS cnt, avg(r) OVER a AS mr, avg(g) OVER a AS mg, avg(b) OVER a AS mb,
    covar_pop(r, r) OVER a AS rr, covar_pop(g, g) OVER a AS gg, covar_pop(b, b) OVER a AS bb, covar_pop(r, g) OVER a AS rg, covar_pop(r, b) OVER a AS rb, covar_pop(g, b) OVER a AS gb
  FROM rgb WINDOW a AS (PARTITION BY recording_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
v AS (SELECT *, sqrt(greatest(gg / (mg * mg) + bb / (mb * mb) - 2 * gb / (mg * mb), 0.0)) AS s1,
    sqrt(greatest(4 * rr / (mr * mr) + gg / (mg * mg) + bb / (mb * mb) - 4 * rg / (mr * mg) - 4 * rb / (mr * mb) + 2 * gb / (mg * mb), 0.0)) AS s2 FROM c),
al AS (SELECT *, CASE WHEN cnt = 12 THEN CASE WHEN s2 > 1e-12 THEN s1 / s2 ELSE 0.0 END END AS alpha FROM v)
SELECT recording_id, i, round(r * coalesce(sum(-2 * alpha / mr) OVER w, 0) + g * coalesce(sum((1 + alpha) / mg) OVER w, 0) + b * coalesce(sum((alpha - 1) / mb) OVER w, 0), 6) AS h
FROM al WINDOW w AS (PARTITION BY recording_id ORDER BY i ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")  # fmt: skip
def pos_overlap_add(spark, sf_dir):
    k, x = F.col("k"), F.col("x")
    rgb = frames(spark, sf_dir).select("recording_id", "i", (x + 50).alias("r"), (x * 0.7 + k + 40).alias("g"), (x * 0.4 + F.pmod(k * 7, F.lit(101)) + 30).alias("b"))
    return win.pos_overlap_add(rgb, 12, ["recording_id"]).select("recording_id", "i", R("h"))


@query("packet_parse", f"""WITH p AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type, value FROM events)
SELECT event_id, round(CASE WHEN event_type NOT IN ('error', 'view') THEN value END, 6) AS r, round(CASE WHEN event_type NOT IN ('error', 'view') THEN k END, 6) AS g,
  event_type NOT IN ('error', 'view') AS valid, round(k / 100, 6) AS face, 1.0::DOUBLE AS motion, CASE WHEN event_type = 'click' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS lighting FROM p""")  # fmt: skip
def packet_parse(spark, sf_dir):
    from pulsegrid.sources import packets

    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    rgb = F.when(F.col("event_type") == "view", F.lit("null")).otherwise(F.concat(F.lit("["), F.col("value").cast("string"), F.lit(","), k, F.lit(",1]")))
    light = F.when(F.col("event_type") == "click", F.lit('"bad"')).otherwise(F.lit("0.5"))
    body = F.concat(F.lit('{"rgb":'), rgb, F.lit(',"valid":'), (F.col("event_type") != "error").cast("string"), F.lit(',"lighting":'), light, F.lit(',"face":'), (k.cast("double") / 100).cast("string"), F.lit("}"))
    out = packets.parse(e.select("event_id", F.concat(F.lit('{"frames":['), body, F.lit("]}")).alias("json")))
    return out.select("event_id", R("r"), R("g"), "valid", R("face"), "motion", "lighting")


_WAVES = """
waves AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(64)) AS n FROM embeddings)
"""


def waves(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("n", "x")).withColumn("x", F.col("x").cast("double"))


@F.pandas_udf(ArrayType(DoubleType()))
def _bins(x: pd.Series) -> pd.Series:
    """Power of bins 1..31 of 64-sample waveforms, a batch at a time; null where samples lack."""
    whole = [k for k, v in enumerate(x) if v is not None and len(v) == 64]
    out = np.full(len(x), None, object)
    if whole:
        samples = np.stack([np.asarray(x.iloc[k], float) for k in whole])
        power = np.abs(np.fft.rfft(samples, axis=1))[:, 1:32] ** 2
        for k, row in zip(whole, power, strict=True):
            out[k] = None if np.isnan(row).any() else row
    return pd.Series(out)


def powers(spark, sf_dir):
    """vec_id and ``p``: the power of bins 1..31 of a 64-sample waveform (8 Hz), from its own row without a shuffle.

    The transform is numpy's over Arrow batches: nested array lambdas are interpreted, and took ten times as long.
    """
    return table(spark, sf_dir, "embeddings").select("vec_id", _bins("embedding").alias("p"))


_SPECTRUM = f"""
{_WAVES}, b AS (SELECT unnest(range(1, 32)) AS bin),
sp AS (SELECT vec_id, label, bin, sum(x * cos(n * bin * (2 * 3.141592653589793 / 64)))::DOUBLE AS c, sum(x * sin(n * bin * (2 * 3.141592653589793 / 64)))::DOUBLE AS s FROM waves, b GROUP BY 1, 2, 3),
spectrum AS (SELECT *, c * c + s * s AS power, bin / 8.0::DOUBLE AS hz FROM sp)
"""


@query("dft_power", f"WITH {_SPECTRUM} SELECT vec_id, bin::INT AS bin, round(power, 5) AS power FROM spectrum")
def dft_power(spark, sf_dir):
    return powers(spark, sf_dir).select("vec_id", F.posexplode("p").alias("at", "power")).select("vec_id", (F.col("at") + 1).alias("bin"), F.round("power", 5).alias("power"))


def _peaks(spark, sf_dir):
    """vec_id, p and the rate of the strongest bin in the pulse band (6..24, the first of equals), refined by its neighbours."""
    best = F.array_max(F.transform(F.sequence(F.lit(6), F.lit(24)), lambda b: F.struct(F.get("p", b - 1).alias("power"), (-b).alias("b"))))
    top = powers(spark, sf_dir).withColumn("bin", -best["b"])
    y = [F.log(F.get("p", F.col("bin") + d) + 1e-30) for d in (-2, -1, 0)]
    bend = y[0] - 2 * y[1] + y[2]
    delta = F.when(F.abs(bend) > 1e-12, 0.5 * (y[0] - y[2]) / bend)
    inner = (F.col("bin") > 6) & (F.col("bin") < 24)
    return top.withColumn("hr_bpm", 60 * (F.col("bin") / 8.0 + F.when(inner & (F.abs(delta) <= 1), delta / 8.0).otherwise(F.lit(0.0))))


_PEAKS = f"""{_SPECTRUM}, nb AS (SELECT *, lag(power) OVER (PARTITION BY vec_id ORDER BY bin) AS p0, lead(power) OVER (PARTITION BY vec_id ORDER BY bin) AS p2 FROM spectrum),
tp AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY power DESC, bin) AS rn FROM nb WHERE hz >= 0.7 AND hz <= 3.0),
dl AS (SELECT *, ln(p0 + 1e-30) - 2 * ln(power + 1e-30) + ln(p2 + 1e-30) AS bend, ln(p0 + 1e-30) - ln(p2 + 1e-30) AS lean FROM tp WHERE rn = 1),
peaks AS (SELECT vec_id, label, 60 * (hz + CASE WHEN bin > 6 AND bin < 24 AND abs(bend) > 1e-12 AND abs(0.5 * lean / bend) <= 1 THEN 0.5 * lean / bend / 8.0 ELSE 0.0 END) AS hr_bpm FROM dl)
"""


@query("hr_peak", f"WITH {_PEAKS} SELECT vec_id, round(hr_bpm, 4) AS hr_bpm FROM peaks")
def hr_peak(spark, sf_dir):
    return _peaks(spark, sf_dir).select("vec_id", F.round("hr_bpm", 4).alias("hr_bpm"))


@query("snr_db", f"""WITH {_PEAKS}, m AS (SELECT s.vec_id, sum(CASE WHEN abs(hz - hr_bpm / 60) <= 0.2 OR abs(hz - hr_bpm / 30) <= 0.2 THEN power END) AS sig,
 sum(CASE WHEN abs(hz - hr_bpm / 60) <= 0.2 OR abs(hz - hr_bpm / 30) <= 0.2 THEN NULL ELSE power END) AS noise FROM spectrum s JOIN peaks p ON p.vec_id = s.vec_id WHERE hz >= 0.7 GROUP BY 1)
SELECT vec_id, round(CASE WHEN sig > 0 AND noise > 0 THEN 10 * log10(sig / noise) END, 4) AS snr_db FROM m""")  # fmt: skip
def snr_db(spark, sf_dir):
    f0 = F.col("hr_bpm") / 60
    near = lambda hz: (F.abs(hz - f0) <= 0.2) | (F.abs(hz - 2 * f0) <= 0.2)
    bins = F.sequence(F.lit(6), F.lit(31))
    part = lambda keep: F.aggregate(F.filter(bins, lambda b: keep(b / 8.0)), F.lit(0.0), lambda s, b: s + F.get("p", b - 1))
    out = _peaks(spark, sf_dir).select("vec_id", part(near).alias("sig"), part(lambda hz: ~near(hz)).alias("noise"))
    return out.select("vec_id", F.round(F.when((F.col("sig") > 0) & (F.col("noise") > 0), 10 * F.log10(F.col("sig") / F.col("noise"))), 4).alias("snr_db"))


@query("xcorr_lag", f"""WITH {FRAMES_SQL}, a AS (SELECT recording_id, i, x, k::DOUBLE AS y FROM frames), l AS (SELECT unnest(range(-3, 4)) AS lag),
c AS (SELECT a.recording_id, l.lag, corr(a.x, b.y) AS r FROM a JOIN l ON true JOIN a b ON b.recording_id = a.recording_id AND b.i = a.i + l.lag GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY abs(r) DESC, lag) AS rn FROM c)
SELECT recording_id, lag::INT AS lag, round(r, 6) AS r FROM o WHERE rn = 1""")  # fmt: skip
def xcorr_lag(spark, sf_dir):
    a = frames(spark, sf_dir).select("recording_id", "i", "x", F.col("k").cast("double").alias("y"))
    by = W.partitionBy("recording_id").orderBy("i")
    # shifted copies along one sort instead of a self-join
    wide = a.select("recording_id", "x", *[(F.lead("y", k) if k >= 0 else F.lag("y", -k)).over(by).alias(f"y{k + 3}") for k in range(-3, 4)])
    agg = wide.groupBy("recording_id").agg(*[F.corr(F.when(F.col(f"y{j}").isNotNull(), F.col("x")), F.col(f"y{j}")).alias(f"c{j}") for j in range(7)])
    pairs = F.array(*[F.struct((-F.abs(F.col(f"c{j}"))).alias("a"), F.lit(j - 3).alias("lag"), F.col(f"c{j}").alias("r")) for j in range(7)])
    best = agg.select("recording_id", F.array_min(pairs).alias("b"))
    return best.select("recording_id", "b.lag", R(F.col("b.r"), "r"))


@query("guided_gate", f"""WITH {FRAMES_SQL}, g AS (SELECT *, valid AND k >= 20 AS good FROM frames), s AS (SELECT *, sum((NOT good)::INT) OVER (PARTITION BY recording_id ORDER BY i) AS isl FROM g),
r AS (SELECT *, CASE WHEN good THEN row_number() OVER (PARTITION BY recording_id, isl, good ORDER BY i) ELSE 0 END AS streak FROM s)
SELECT recording_id, min(i) AS unlocked_at FROM r WHERE streak >= 4 GROUP BY 1""")  # fmt: skip
def guided_gate(spark, sf_dir):
    """First tick of each recording after four good ones in a row."""
    good = F.col("valid") & (F.col("k") >= 20)
    return win.first_streak(frames(spark, sf_dir), good, 4)


@query("forehead_band", f"""WITH {FRAMES_SQL}, f AS (SELECT event_id, k * 2 AS hair, 20.0::DOUBLE AS fy, 200.0::DOUBLE AS fh FROM frames)
SELECT event_id, round(CASE WHEN (hair - fy) / fh + 0.06 >= 0 AND (hair - fy) / fh + 0.24 <= 0.45 THEN (hair - fy) / fh + 0.06 END, 6)::DOUBLE AS top FROM f""")  # fmt: skip
def forehead_band(spark, sf_dir):
    top, bottom = ((F.col("k") * 2 - 20.0) / F.lit(200.0) + d for d in (0.06, 0.24))
    return frames(spark, sf_dir).select("event_id", R(F.when((top >= 0) & (bottom <= 0.45), top), "top"))


@query("chunks", f"""WITH {FRAMES_SQL}, n AS (SELECT recording_id, count(*) AS n FROM frames GROUP BY 1), s AS (SELECT recording_id, unnest(range(0, n - 13, 12)) AS start FROM n)
SELECT s.recording_id, s.start, count(*) AS n_frames, round(avg(x), 6) AS mean_x FROM s JOIN frames f ON f.recording_id = s.recording_id AND f.i BETWEEN s.start AND s.start + 12 GROUP BY 1, 2""")  # fmt: skip
def chunks(spark, sf_dir):
    """Training chunks: twelve frames and one more, without overlap of starts."""
    c = win.training_chunks(frames(spark, sf_dir), 12)
    return c.groupBy("recording_id", "start").agg(F.count("*").alias("n_frames"), R(F.avg("x"), "mean_x"))


@query("chunks_lagged", f"""WITH {FRAMES_SQL}, n AS (SELECT recording_id, count(*) AS n, recording_id % 7 - 3 AS lag FROM frames GROUP BY 1), s AS (SELECT recording_id, n, lag, unnest(range(0, n - 13, 12)) AS start FROM n)
SELECT s.recording_id, s.start, count(*) AS n_frames, round(avg(x), 6) AS mean_x, (SELECT round(avg(g.k), 6) FROM frames g WHERE g.recording_id = s.recording_id AND g.i BETWEEN s.start + s.lag AND s.start + s.lag + 12) AS mean_label
FROM s JOIN frames f ON f.recording_id = s.recording_id AND f.i BETWEEN s.start AND s.start + 12 WHERE s.start + s.lag >= 0 AND s.start + s.lag + 13 <= s.n GROUP BY s.recording_id, s.start, s.lag""")  # fmt: skip
def chunks_lagged(spark, sf_dir):
    """Training chunks whose labels come from a recording's lag later."""
    f = frames(spark, sf_dir).select("recording_id", "i", "x", "k")
    lags = f.select("recording_id").distinct().withColumn("lag", F.col("recording_id") % 7 - 3)
    c = win.training_chunks(f, 12, "k", lags)
    return c.groupBy("recording_id", "start").agg(F.count("*").alias("n_frames"), R(F.avg("x"), "mean_x"), R(F.avg("k"), "mean_label"))
