"""Queries over analysed windows: decisions, baselines, errors, ranks, thresholds, blinks and readiness."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import scoring as sc
from pulsegrid.operators import baseline as bl
from pulsegrid.operators import evaluate as ev
from pulsegrid.operators import ocular, readiness
from pulsegrid.plans import pulse_twins
from pulsegrid.plans.catalog import query
from pulsegrid.plans.frame_queries import CLIP, QUALITY_SQL, quality_frames
from pulsegrid.plans.tables import FRAMES_SQL, frames, table


def R(c, name=None, n=6):
    """``c`` rounded as the twins round: scaled, taken to a whole number and scaled back, where ``round`` goes by decimal digits (0.5040625 is 504062.49999999994 millionths)."""
    value, unit = F.col(c) if isinstance(c, str) else c, F.lit(10.0**n)
    return F.when(F.abs(value * unit) < math.inf, F.round(value * unit) / unit).otherwise(value).alias(name or c)


WINDOWS_SQL = f"""{FRAMES_SQL},
windows AS (SELECT event_id, recording_id, i, recording_id % 7 AS cohort, event_type, x / 5.0::DOUBLE AS hr, x / 5.0::DOUBLE + (((k * 37) % 101) - 50) / 5.0::DOUBLE AS gt, valid, k / 100.0::DOUBLE AS confidence,
  ((k * 7) % 101) / 100.0::DOUBLE AS quality, i * 2.0::DOUBLE + 20 AS end_s, 60.0::DOUBLE / (x / 5.0::DOUBLE + 1) AS ibi_mean_s, 1 + k / 50.0::DOUBLE AS pulse_amplitude FROM frames),
errs AS (SELECT *, abs(hr - gt) AS err FROM windows)
"""


def windows(spark, sf_dir):
    """Events as analysed windows: a would-be rate, a truth up to ten bpm off, confidence and quality from k."""
    k, x = F.col("k"), F.col("x")
    hr = x / F.lit(5.0)
    return frames(spark, sf_dir).select(
        "event_id", "recording_id", "i", (F.col("recording_id") % 7).alias("cohort"), "event_type", hr.alias("hr"),
        (hr + (F.pmod(k * 37, F.lit(101)) - 50) / F.lit(5.0)).alias("gt"), "valid", (k / F.lit(100.0)).alias("confidence"),
        (F.pmod(k * 7, F.lit(101)) / F.lit(100.0)).alias("quality"), (F.col("i") * 2.0 + 20).alias("end_s"), (60.0 / (hr + 1)).alias("ibi_mean_s"), (1 + k / F.lit(50.0)).alias("pulse_amplitude"),
    )


def errors(spark, sf_dir):
    return windows(spark, sf_dir).withColumn("err", ev.abs_error()).withColumn("conf", F.col("confidence"))


@query("pulse_quality", f"""WITH {FRAMES_SQL}, s AS (SELECT event_id, x / 20 - 5 AS snr, CASE WHEN valid THEN k / 10.0::DOUBLE END AS stab FROM frames)
SELECT event_id, round(CASE WHEN stab IS NULL THEN 0.0::DOUBLE ELSE least(1.0, greatest(0.0, 1.0 / (1.0 + exp(-(snr - 3.0) / 3.0)) * exp(-power(stab / 6.0, 2)))) END, 8) AS pulse FROM s""")  # fmt: skip
def pulse_quality(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.select("event_id", F.round(sc.pulse_quality(F.col("x") / 20 - 5, F.when(F.col("valid"), F.col("k") / F.lit(10.0))), 8).alias("pulse"))


_CONF = f"""
conf AS (SELECT event_id, recording_id, i, x, k, valid, (0.34::DOUBLE * face + 0.20::DOUBLE * lighting + 0.20::DOUBLE * motion + 0.26::DOUBLE * compression) * 0.9::DOUBLE * 0.95::DOUBLE AS image,
  CASE WHEN valid THEN 1.0 / (1.0 + exp(-(x / 20 - 5 - 3.0) / 3.0)) * exp(-power(k / 20.0::DOUBLE / 6.0, 2)) ELSE 0.0::DOUBLE END AS pulse, face, lighting, motion, sharpness, compression FROM quality),
scored AS (SELECT *, {CLIP.format(x='image * pulse')} AS confidence FROM conf)
"""


def scored(spark, sf_dir):
    q = quality_frames(spark, sf_dir)
    cols = {c: F.col(c) for c in ("face", "lighting", "motion", "sharpness", "compression")}
    pulse = sc.pulse_quality(F.col("x") / 20 - 5, F.when(F.col("valid"), F.col("k") / F.lit(20.0)))
    image = sc.image_quality(cols, F.lit(0.9), F.lit(0.9))
    return q.withColumn("confidence", sc.confidence(image, pulse)).withColumn("model", sc.confidence(image, pulse, F.col("k") / F.lit(100.0)))


@query("confidence_score", f"""WITH {FRAMES_SQL}, {QUALITY_SQL}, {_CONF} SELECT event_id, round(confidence, 8) AS confidence, round(confidence * (0.5 + 0.5 * (k / 100.0::DOUBLE)), 8) AS with_model, confidence < 0.2 AS abstain FROM scored""")
def confidence_score(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("event_id", F.round("confidence", 8).alias("confidence"), F.round("model", 8).alias("with_model"), (F.col("confidence") < sc.ABSTAIN_BELOW).alias("abstain"))


@query("window_decision", f"""WITH {FRAMES_SQL}, {QUALITY_SQL}, {_CONF} SELECT event_id, CASE WHEN lighting / 0.2::DOUBLE < 0.75 THEN 'insufficient_valid_frames' WHEN k > 95 THEN 'signal_gap_too_long'
 WHEN (0.25::DOUBLE * face + 0.16::DOUBLE * lighting + 0.16::DOUBLE * motion + 0.12::DOUBLE * sharpness + 0.19::DOUBLE * compression + 0.12::DOUBLE) < 0.35 THEN 'low_quality'
 WHEN confidence < 0.2 THEN 'low_confidence' WHEN x < 5 THEN 'no_hr_peak' END AS reason, round(x, 6) AS would_be_hr FROM scored""")  # fmt: skip
def window_decision(spark, sf_dir):
    s = scored(spark, sf_dir)
    cols = {c: F.col(c) for c in sc.WINDOW_WEIGHTS if c != "fps_stability"} | {"fps_stability": F.lit(1.0)}
    overall = sc.window_overall(cols, F.lit(1.0))
    reason = sc.decision(F.col("lighting") / 0.2, F.col("k"), F.lit(95), overall, F.col("confidence"), F.when(F.col("x") >= 5, F.col("x")))
    return s.select("event_id", reason.alias("reason"), R("x", "would_be_hr"))


_FIT = f"""
u AS (SELECT * FROM windows WHERE end_s <= 60 AND valid AND confidence >= 0.45),
lg AS (SELECT recording_id, 'hr_bpm' AS feature, hr AS v FROM u UNION ALL SELECT recording_id, 'ibi_mean_s', ibi_mean_s FROM u UNION ALL SELECT recording_id, 'pulse_amplitude', pulse_amplitude FROM u),
ce AS (SELECT recording_id, feature, median(v) AS location, count(*) AS n FROM lg GROUP BY 1, 2 HAVING count(*) >= 3),
sp AS (SELECT lg.recording_id, lg.feature, location, n, median(abs(v - location)) AS mad FROM lg JOIN ce USING (recording_id, feature) GROUP BY 1, 2, 3, 4),
fitted AS (SELECT recording_id AS session_id, feature, location, greatest(1.4826 * mad, 0.02 * abs(location), 1e-9)::DOUBLE AS scale, n, 1.4826 * mad < 0.02 * abs(location) AS floored FROM sp)
"""


def session_windows(spark, sf_dir):
    return windows(spark, sf_dir).withColumnsRenamed({"recording_id": "session_id", "hr": "hr_bpm"})


@query("baseline_fit", f"WITH {WINDOWS_SQL}, {_FIT} SELECT session_id, feature, round(location, 8) AS location, round(scale, 8) AS scale, n, floored FROM fitted")
def baseline_fit(spark, sf_dir):
    b = bl.fit(session_windows(spark, sf_dir), 60.0)
    return b.select("session_id", "feature", R("location", n=8), R("scale", n=8), "n", "floored")


def _relative(spark, sf_dir, mode):
    w = session_windows(spark, sf_dir)
    return bl.transform(w, bl.fit(w, 60.0), "hr_bpm", mode).select("event_id", R("relative", n=5))


@query("baseline_delta", f"WITH {WINDOWS_SQL}, {_FIT} SELECT event_id, round(hr - location, 5) AS relative FROM windows LEFT JOIN fitted ON session_id = recording_id AND feature = 'hr_bpm'")
def baseline_delta(spark, sf_dir):
    return _relative(spark, sf_dir, "delta")


@query("baseline_z", f"WITH {WINDOWS_SQL}, {_FIT} SELECT event_id, round((hr - location) / scale, 5) AS relative FROM windows LEFT JOIN fitted ON session_id = recording_id AND feature = 'hr_bpm'")
def baseline_z(spark, sf_dir):
    return _relative(spark, sf_dir, "z")


@query("baseline_drift", f"""WITH {WINDOWS_SQL}, {_FIT}, rc AS (SELECT * FROM windows WHERE end_s > 60), rl AS (
 SELECT recording_id, 'hr_bpm' AS feature, hr AS v FROM rc UNION ALL SELECT recording_id, 'ibi_mean_s', ibi_mean_s FROM rc UNION ALL SELECT recording_id, 'pulse_amplitude', pulse_amplitude FROM rc),
m AS (SELECT recording_id, feature, median(v) AS recent FROM rl GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT session_id, f.feature, round((recent - location) / scale, 5) AS z, abs((recent - location) / scale) > 3 AS drifted FROM m JOIN fitted f ON f.session_id = m.recording_id AND f.feature = m.feature""")  # fmt: skip
def baseline_drift(spark, sf_dir):
    w = session_windows(spark, sf_dir)
    return bl.drift(w.where("end_s > 60"), bl.fit(w, 60.0)).select("session_id", "feature", R("z", n=5), "drifted")


_SUBJECT = """
subj AS (SELECT recording_id, cohort, count(*) AS n_windows, count(*) FILTER (WHERE valid) AS n_valid, avg(err) FILTER (WHERE valid) AS mae, avg(err) AS mae_all,
  sqrt(avg((hr - gt) * (hr - gt)) FILTER (WHERE valid)) AS rmse, CASE WHEN count(*) FILTER (WHERE valid) >= 3 THEN corr(hr, gt) FILTER (WHERE valid) END AS pearson_r, avg(quality) AS mean_quality,
  count(*) FILTER (WHERE valid)::DOUBLE / count(*) AS coverage, avg(err) <= 5 AS usable FROM errs GROUP BY 1, 2)
"""


def subjects(spark, sf_dir):
    return ev.subject_metrics(windows(spark, sf_dir), ["recording_id", "cohort"], ["event_id"])


@query("subject_metrics", f"""WITH {WINDOWS_SQL}, {_SUBJECT} SELECT recording_id, n_windows, n_valid, round(mae, 6) AS mae, round(mae_all, 6) AS mae_all, round(rmse, 6) AS rmse,
 round(pearson_r, 6) AS pearson_r, round(mean_quality, 6) AS mean_quality, round(coverage, 6) AS coverage, usable FROM subj""")  # fmt: skip
def subject_metrics(spark, sf_dir):
    s = subjects(spark, sf_dir)
    return s.select("recording_id", "n_windows", "n_valid", *[R(c) for c in ("mae", "mae_all", "rmse", "pearson_r", "mean_quality", "coverage")], "usable")


_BENCH = """
bench AS (SELECT cohort, count(*) AS n_subjects, sum(n_windows)::BIGINT AS n_windows, sum(n_valid)::DOUBLE / sum(n_windows) AS coverage, median(mae_all) AS median_mae_all, max(mae_all) AS worst_mae_all,
  avg(usable::INT) AS usable_rate, median(mae) AS median_mae, avg(mae) AS mean_mae, max(mae) AS worst_mae, (sum(n_valid) FILTER (WHERE usable))::DOUBLE / sum(n_windows) FILTER (WHERE usable) AS coverage_within_usable
  FROM subj GROUP BY 1)
"""
_METRICS = ("coverage", "median_mae_all", "worst_mae_all", "usable_rate", "median_mae", "mean_mae", "worst_mae", "coverage_within_usable")


@query("benchmark_metrics", f"WITH {WINDOWS_SQL}, {_SUBJECT}, {_BENCH} SELECT cohort, n_subjects, n_windows, {', '.join(f'round({c}, 6) AS {c}' for c in _METRICS)} FROM bench")
def benchmark_metrics(spark, sf_dir):
    b = ev.benchmark_metrics(subjects(spark, sf_dir), ["cohort"])
    return b.select("cohort", "n_subjects", "n_windows", *[R(c) for c in _METRICS])


@query("go_no_go", f"WITH {WINDOWS_SQL}, {_SUBJECT}, {_BENCH} SELECT cohort, median_mae_all <= 5 AND coverage >= 0.8 AS go FROM bench")
def go_no_go(spark, sf_dir):
    return ev.go_no_go(ev.benchmark_metrics(subjects(spark, sf_dir), ["cohort"])).select("cohort", "go")


@query("subgroup_metrics", f"""WITH {WINDOWS_SQL}, {_SUBJECT}, l AS (SELECT s.*, c.c_mktsegment AS segment, CASE WHEN recording_id % 100 BETWEEN 18 AND 29 THEN '18-29' WHEN recording_id % 100 BETWEEN 30 AND 49 THEN '30-49' WHEN recording_id % 100 >= 50 THEN '50+' END AS age_band
 FROM subj s LEFT JOIN customer c ON c.c_custkey = s.recording_id),
p AS (SELECT 'segment' AS key, segment AS value, * FROM l WHERE segment IS NOT NULL UNION ALL SELECT 'age_band', age_band, * FROM l WHERE age_band IS NOT NULL)
SELECT key, value, count(*) AS n_subjects, round(sum(n_valid)::DOUBLE / sum(n_windows), 6) AS coverage, round(median(mae_all), 6) AS median_mae_all, round(avg(usable::INT), 6) AS usable_rate, count(*) < 4 AS underpowered FROM p GROUP BY 1, 2""")  # fmt: skip
def subgroup_metrics(spark, sf_dir):
    label = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("recording_id"), F.col("c_mktsegment").alias("segment"))
    s = subjects(spark, sf_dir).join(label, "recording_id", "left").withColumn("age_band", sc.age_band(F.col("recording_id") % 100))
    g = ev.subgroup_metrics(s, ["segment", "age_band"])
    return g.select("key", "value", "n_subjects", R("coverage"), R("median_mae_all"), R("usable_rate"), "underpowered")


def _order():
    return [F.col("conf").desc(), F.col("event_id")]


_RC = """
rc AS (SELECT event_id, cohort, row_number() OVER w AS rank, row_number() OVER w / count(*) OVER (PARTITION BY cohort)::DOUBLE AS coverage, (sum(err::DECIMAL(28,6)) OVER (PARTITION BY cohort ORDER BY confidence DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / row_number() OVER w AS risk
  FROM errs WINDOW w AS (PARTITION BY cohort ORDER BY confidence DESC, event_id))
"""


@query("risk_coverage", f"WITH {WINDOWS_SQL}, {_RC} SELECT event_id, cohort, rank, round(coverage, 6) AS coverage, risk FROM rc")
def risk_coverage(spark, sf_dir):
    r = ev.risk_coverage(errors(spark, sf_dir), ["cohort"], _order())
    return r.select("event_id", "cohort", F.col("rank").cast("long").alias("rank"), R("coverage"), "risk")


@query("aurc", f"""WITH {WINDOWS_SQL}, {_RC}, o AS (SELECT cohort, row_number() OVER (PARTITION BY cohort ORDER BY err, event_id) AS rank, row_number() OVER (PARTITION BY cohort ORDER BY err, event_id) / count(*) OVER (PARTITION BY cohort)::DOUBLE AS coverage,
  avg(err) OVER (PARTITION BY cohort ORDER BY err, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS risk FROM errs),
a AS (SELECT cohort, (risk + lag(risk) OVER (PARTITION BY cohort ORDER BY rank)) / 2 * (coverage - lag(coverage) OVER (PARTITION BY cohort ORDER BY rank)) AS s FROM rc),
b AS (SELECT cohort, (risk + lag(risk) OVER (PARTITION BY cohort ORDER BY rank)) / 2 * (coverage - lag(coverage) OVER (PARTITION BY cohort ORDER BY rank)) AS s FROM o),
sa AS (SELECT cohort, sum(s) AS aurc FROM a GROUP BY 1), sb AS (SELECT cohort, sum(s) AS oracle FROM b GROUP BY 1)
SELECT cohort, round(aurc, 6) AS aurc, round(oracle, 6) AS aurc_oracle FROM sa JOIN sb USING (cohort)""")  # fmt: skip
def aurc(spark, sf_dir):
    e = errors(spark, sf_dir)
    best = ev.aurc(e, ["cohort"], [F.col("err"), F.col("event_id")], "aurc_oracle")
    return ev.aurc(e, ["cohort"], _order(), "aurc").join(best, "cohort").select("cohort", R("aurc"), R("aurc_oracle"))


_RANK = "rank() OVER (PARTITION BY cohort ORDER BY {c}) + (count(*) OVER (PARTITION BY cohort, {c}) - 1) / 2.0::DOUBLE"


@query("spearman", f"""WITH {WINDOWS_SQL}, r AS (SELECT cohort, {_RANK.format(c='confidence')} AS rx, {_RANK.format(c='err')} AS ry FROM errs)
SELECT cohort, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1""")  # fmt: skip
def spearman(spark, sf_dir):
    return ev.spearman(errors(spark, sf_dir), ["cohort"], "conf", "err").select("cohort", "n", R("rho"))


@query("confidence_deciles", f"""WITH {WINDOWS_SQL}, d AS (SELECT *, ntile(10) OVER (PARTITION BY cohort ORDER BY confidence, event_id) AS decile FROM errs)
SELECT cohort, decile::INT AS decile, round(avg(confidence), 6) AS conf_mean, round(avg(err), 6) AS mae, count(*) AS n FROM d GROUP BY 1, 2""")  # fmt: skip
def confidence_deciles(spark, sf_dir):
    d = ev.deciles(errors(spark, sf_dir), ["cohort"], [F.col("conf"), F.col("event_id")])
    return d.select("cohort", "decile", R("conf_mean"), R("mae"), "n")


@query("kept_vs_abstained", f"""WITH {WINDOWS_SQL} SELECT cohort, round(avg((NOT valid)::INT), 6) AS abstain_rate, round(avg(err) FILTER (WHERE valid), 6) AS mae_kept, round(avg(err) FILTER (WHERE NOT valid), 6) AS mae_abstained,
 coalesce(avg(err) FILTER (WHERE NOT valid) <= avg(err) FILTER (WHERE valid), false) AS discards_usable FROM errs GROUP BY 1""")  # fmt: skip
def kept_vs_abstained(spark, sf_dir):
    k = ev.kept_and_abstained(errors(spark, sf_dir), ["cohort"])
    return k.select("cohort", R("abstain_rate"), R("mae_kept"), R("mae_abstained"), "discards_usable")


@query("threshold_sweep", f"""WITH {WINDOWS_SQL}, g AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in ev.THRESHOLDS)}]) AS threshold), n AS (SELECT count(*) AS total FROM errs)
SELECT threshold, round(count(*)::DOUBLE / any_value(total), 6) AS coverage, round(avg(err), 6) AS mae, round(quantile_cont(err, 0.9), 6) AS p90, round(max(err), 6) AS max_error FROM g JOIN errs ON confidence >= threshold, n GROUP BY 1""")  # fmt: skip
def threshold_sweep(spark, sf_dir):
    return ev.threshold_sweep(errors(spark, sf_dir)).select("threshold", *[R(c) for c in ("coverage", "mae", "p90", "max_error")])


@query("threshold_recommended", f"""WITH {WINDOWS_SQL}, w AS (SELECT count(*) AS n_windows, count(*) FILTER (WHERE err > 9.9) AS n_bad, max(confidence) FILTER (WHERE err > 9.9) AS worst FROM errs)
SELECT n_windows, n_bad, round(worst, 6) AS worst_bad_confidence, round(worst + 0.04, 6) AS recommended, round((SELECT avg((confidence >= worst + 0.04)::INT) FROM errs), 6) AS coverage_at_recommended FROM w""")  # fmt: skip
def threshold_recommended(spark, sf_dir):
    r = ev.recommended_threshold(errors(spark, sf_dir), bad=9.9)
    return r.select("n_windows", "n_bad", R("worst_bad_confidence"), R("recommended"), R("coverage_at_recommended"))


_AUC = """
rk AS (SELECT {g} AS g, y, rank() OVER (PARTITION BY {g} ORDER BY s) + (count(*) OVER (PARTITION BY {g}, s) - 1) / 2.0::DOUBLE AS r FROM {t}),
au AS (SELECT g, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg, sum(r) FILTER (WHERE y = 1) AS ranks FROM rk GROUP BY 1)
"""
_AREA = "CASE WHEN pos > 0 AND neg > 0 THEN (ranks - pos * (pos + 1) / 2.0::DOUBLE) / (pos * neg) END"


@query("auroc", f"""WITH b AS (SELECT d.source, l.toxic AS y, d.n_chars AS s FROM labels l JOIN documents d USING (doc_id)), {_AUC.format(g='source', t='b')}
SELECT g AS source, pos, neg, round({_AREA}, 6) AS auroc FROM au""")  # fmt: skip
def auroc(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return ev.auroc(rows, ["source"], "n_chars", "toxic").select("source", "pos", "neg", R("auroc"))


@query("within_subject_auroc", f"""WITH {WINDOWS_SQL}, b AS (SELECT recording_id, (event_type = 'purchase')::INT AS y, hr AS s FROM windows WHERE event_type IN ('purchase', 'view')), {_AUC.format(g='recording_id', t='b')}
SELECT count(*) AS n_subjects, round(avg({_AREA}), 6) AS within_auroc FROM au""")  # fmt: skip
def within_subject_auroc(spark, sf_dir):
    rows = windows(spark, sf_dir).where(F.col("event_type").isin("purchase", "view")).withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    return ev.auroc(rows, ["recording_id"], "hr", "y").agg(F.count("*").alias("n_subjects"), R(F.avg("auroc"), "within_auroc"))


@query("rising_edges", f"""WITH {FRAMES_SQL}, a AS (SELECT recording_id, i, x > 100 AS above, lag(x > 100) OVER (PARTITION BY recording_id ORDER BY i) AS was FROM frames)
SELECT recording_id, i FROM a WHERE above AND NOT was""")  # fmt: skip
def rising_edges(spark, sf_dir):
    return ev.rising_edges(frames(spark, sf_dir), ["recording_id"], "i", F.col("x") > 100).select("recording_id", "i")


def _matches(spark, sf_dir):
    f = frames(spark, sf_dir).select(F.col("recording_id").alias("key"), F.col("i").alias("t"), "event_type")
    return ev.match_events(f.where("event_type = 'purchase'"), f.where("event_type = 'click'"), 2.0)


#: Greedy matching: detections in order take their nearest unused truth (the earlier of two as near) within two frames.
_MATCH = f"""{FRAMES_SQL},
d AS (SELECT recording_id AS key, i AS t, row_number() OVER (PARTITION BY recording_id ORDER BY i) AS j FROM frames WHERE event_type = 'purchase'),
g AS (SELECT recording_id AS key, list(i ORDER BY i) AS ts FROM frames WHERE event_type = 'click' GROUP BY 1),
m AS (SELECT key, 0::BIGINT AS j, ts AS unused, 0::BIGINT AS hits FROM g
  UNION ALL
  SELECT key, j, CASE WHEN near IS NULL THEN unused ELSE list_filter(unused, lambda x: x <> near) END, hits + (near IS NOT NULL)::BIGINT
  FROM (SELECT m.key, d.j, m.unused, m.hits, list_filter(list_sort(list_transform(unused, lambda x: {{'far': abs(x - d.t), 'at': x}})), lambda s: s.far <= 2)[1].at AS near FROM m JOIN d ON d.key = m.key AND d.j = m.j + 1)),
best AS (SELECT key, max(hits) AS tp FROM m GROUP BY 1),
nd AS (SELECT key, count(*) AS n_detected FROM d GROUP BY 1), ng AS (SELECT key, len(ts) AS n_truth FROM g),
matched AS (SELECT coalesce(nd.key, ng.key) AS key, coalesce(n_detected, 0) AS n_detected, coalesce(n_truth, 0) AS n_truth, coalesce(tp, 0) AS tp FROM nd FULL JOIN ng ON nd.key = ng.key LEFT JOIN best ON best.key = ng.key),
pr AS (SELECT key, CASE WHEN n_detected > 0 THEN tp::DOUBLE / n_detected ELSE 0 END AS p, CASE WHEN n_truth > 0 THEN tp::DOUBLE / n_truth ELSE 0 END AS r FROM matched)
"""


@query("event_match", f"WITH RECURSIVE {_MATCH} SELECT key, n_detected, n_truth, tp FROM matched")
def event_match(spark, sf_dir):
    return _matches(spark, sf_dir)


@query("f1_score", f"WITH RECURSIVE {_MATCH} SELECT key, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM pr")
def f1_score(spark, sf_dir):
    m = ev.f1(_matches(spark, sf_dir))
    return m.select("key", R("precision"), R("recall"), R("f1"))


@query("blink_runs", f"""WITH {FRAMES_SQL}, o AS (SELECT recording_id, i, CASE WHEN valid THEN 50 + x / 10 END AS openness FROM frames),
l AS (SELECT recording_id, quantile_cont(openness, 0.75) AS level FROM o GROUP BY 1 HAVING count(openness) >= 16),
b AS (SELECT o.recording_id, i, coalesce(openness < 0.9 * level, false) AS low FROM o JOIN l USING (recording_id)),
n AS (SELECT *, sum((NOT low)::INT) OVER (PARTITION BY recording_id ORDER BY i) AS isl FROM b)
SELECT recording_id, min(i) AS start, max(i) + 1 AS stop FROM n WHERE low GROUP BY recording_id, isl""")  # fmt: skip
def blink_runs(spark, sf_dir):
    return ocular.closed_runs(_eyes(spark, sf_dir), 8.0)


def _eyes(spark, sf_dir):
    return frames(spark, sf_dir).select("recording_id", "i", F.when(F.col("valid"), 50 + F.col("x") / 10).alias("openness"))


def _blink_sql(ratios, rest):
    """Runs of a blink's length below the level, and of those the accepted: not within ``rest`` frames of the last accepted."""
    return f"""{FRAMES_SQL}, o AS (SELECT recording_id, i, CASE WHEN valid THEN 50 + x / 10 END AS openness FROM frames),
l AS (SELECT recording_id, quantile_cont(openness, 0.75) AS level FROM o GROUP BY 1 HAVING count(openness) >= 16),
q AS (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in ratios)}]) AS drop_ratio),
b AS (SELECT o.recording_id, drop_ratio, i, coalesce(openness < drop_ratio * level, false) AS low FROM o JOIN l USING (recording_id), q),
n AS (SELECT *, sum((NOT low)::INT) OVER (PARTITION BY recording_id, drop_ratio ORDER BY i) AS isl FROM b),
u AS (SELECT recording_id, drop_ratio, min(i) AS start, max(i) + 1 AS stop FROM n WHERE low GROUP BY recording_id, drop_ratio, isl HAVING count(*) <= 8),
k AS (SELECT *, row_number() OVER (PARTITION BY recording_id, drop_ratio ORDER BY start) AS j FROM u),
a AS (SELECT recording_id, drop_ratio, j, start, stop, stop AS last, true AS took FROM k WHERE j = 1
  UNION ALL SELECT k.recording_id, k.drop_ratio, k.j, k.start, k.stop, CASE WHEN k.start - a.last >= {rest} THEN k.stop ELSE a.last END, k.start - a.last >= {rest} FROM a JOIN k ON k.recording_id = a.recording_id AND k.drop_ratio = a.drop_ratio AND k.j = a.j + 1)
"""


@query("blinks", f"WITH RECURSIVE {_blink_sql([0.9], 4)} SELECT recording_id, start, stop FROM a WHERE took")
def blinks(spark, sf_dir):
    return ocular.blinks(_eyes(spark, sf_dir), 8.0, max_s=1.0, refractory_s=0.5)


_RATIOS = (0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


@query("blink_threshold_sweep", f"WITH RECURSIVE {_blink_sql(_RATIOS, 1)} SELECT drop_ratio, count(*) AS n_blinks FROM a WHERE took GROUP BY 1")
def blink_threshold_sweep(spark, sf_dir):
    return ocular.blink_sweep(_eyes(spark, sf_dir), 8.0, _RATIOS, max_s=1.0).groupBy("drop_ratio").agg(F.count("*").alias("n_blinks"))


@query("ocular_stats", f"""WITH {FRAMES_SQL}, o AS (SELECT recording_id, i, CASE WHEN valid THEN 50 + x / 10 END AS openness FROM frames),
m AS (SELECT recording_id, count(*) AS n, avg((openness IS NOT NULL)::INT) AS v, median(openness) AS med FROM o GROUP BY 1),
s AS (SELECT o.recording_id, n, v, med, 1.4826 * median(abs(openness - med)) AS spread FROM o JOIN m USING (recording_id) GROUP BY 1, 2, 3, 4)
SELECT recording_id, n, round(v, 6) AS valid_fraction, CASE WHEN n >= 16 AND v >= 0.8 THEN round(med, 6) END AS openness_median, CASE WHEN n >= 16 AND v >= 0.8 THEN round(spread, 6)::DOUBLE END AS openness_spread,
 CASE WHEN n < 16 THEN 'window_too_short' WHEN v < 0.8 THEN 'eye_region_unusable' END AS reason FROM s""".replace("0.8 ", "0.6 "))  # fmt: skip
def ocular_stats(spark, sf_dir):
    s = ocular.ocular_stats(_eyes(spark, sf_dir), 8.0)
    return s.select("recording_id", "n", R("valid_fraction"), R("openness_median"), R("openness_spread"), "reason")


_READY = f"""{FRAMES_SQL}, f AS (SELECT recording_id, i, valid AS face, 0.5 + k / 200.0::DOUBLE AS skin, x / 200.0::DOUBLE AS light, CASE WHEN i % 15 = 0 THEN k / 100.0::DOUBLE END AS comp FROM frames WHERE i < 40),
a AS (SELECT recording_id, avg(face::INT) AS ff, median(skin) FILTER (WHERE face) AS skin, median(light) FILTER (WHERE face) AS light, median(comp) FILTER (WHERE face) AS comp FROM f GROUP BY 1),
rd AS (SELECT recording_id, ff, skin, CASE WHEN ff < 0.5 OR skin IS NULL THEN 'no_face' WHEN skin >= 0.86 THEN 'good' WHEN skin >= 0.70 THEN 'marginal' ELSE 'poor' END AS verdict, light, comp FROM a)
"""


def _ready(spark, sf_dir):
    k = F.col("k")
    f = frames(spark, sf_dir).select(
        "recording_id", "i", F.col("valid").alias("face"), (0.5 + k / F.lit(200.0)).alias("skin_fraction"), (F.col("x") / F.lit(200.0)).alias("lighting"), F.when(F.col("i") % 15 == 0, k / F.lit(100.0)).alias("compression")
    )
    return readiness.readiness(f, 40)


@query("readiness_bands", f"""WITH {_READY} SELECT recording_id, round(ff, 6) AS face_fraction, round(skin, 6) AS skin_fraction, verdict, CASE verdict WHEN 'good' THEN 0.71::DOUBLE WHEN 'marginal' THEN 0.69::DOUBLE WHEN 'poor' THEN 0.18::DOUBLE END AS expected_usable,
 coalesce(verdict <> 'no_face' AND light < 0.6, false) AS poor_light FROM rd""")  # fmt: skip
def readiness_bands(spark, sf_dir):
    r = _ready(spark, sf_dir)
    return r.select("recording_id", R("face_fraction"), R("skin_fraction"), "verdict", "expected_usable", F.array_contains("messages", "poor_lighting").alias("poor_light"))


@query("readiness_confusion", f"""WITH {WINDOWS_SQL}, {_SUBJECT}, {_READY.replace(FRAMES_SQL + ',', '')}, j AS (SELECT cohort, verdict IN ('good', 'marginal') AS r, usable AS u FROM rd JOIN subj USING (recording_id))
SELECT cohort, count(*) FILTER (WHERE r AND u) AS tp, count(*) FILTER (WHERE r AND NOT u) AS fp, count(*) FILTER (WHERE NOT r AND u) AS fn, count(*) FILTER (WHERE NOT r AND NOT u) AS tn FROM j GROUP BY 1""")  # fmt: skip
def readiness_confusion(spark, sf_dir):
    return readiness.confusion(_ready(spark, sf_dir).join(subjects(spark, sf_dir), "recording_id"), ["cohort"])


@query("subject_split", """WITH r AS (SELECT c_custkey AS subject_id, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR || ':split'), c_custkey) AS rank, count(*) OVER () AS n FROM customer)
SELECT subject_id, CASE WHEN rank <= greatest(1, round(n * 0.2)) THEN 'test' ELSE 'train' END AS part FROM r""")  # fmt: skip
def subject_split(spark, sf_dir):
    subjects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject_id"))
    return ev.exact_split(subjects, "subject_id", 0.2)


@query("calib_by_level", f"""WITH {WINDOWS_SQL} SELECT floor(quality * 5)::INT AS level, count(*) AS n_windows, count(*) FILTER (WHERE valid) AS n_answered, round(avg(confidence), 6) AS mean_confidence, round(avg(err), 6) AS mae FROM errs GROUP BY 1""")
def calib_by_level(spark, sf_dir):
    e = errors(spark, sf_dir)
    return e.groupBy(F.floor(F.col("quality") * 5).cast("int").alias("level")).agg(F.count("*").alias("n_windows"), F.count_if("valid").alias("n_answered"), R(F.avg("conf"), "mean_confidence"), R(F.avg("err"), "mae"))


@query("pilot_by_arm", f"""WITH {WINDOWS_SQL} SELECT event_type AS arm, count(*) AS n, round(avg(err), 6) AS mae, round(median(err), 6) AS median_err, round(quantile_cont(err, 0.9), 6) AS p90, round(avg((err <= 5)::INT), 6) AS within_5 FROM errs GROUP BY 1""")
def pilot_by_arm(spark, sf_dir):
    e = errors(spark, sf_dir)
    return e.groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("n"), R(F.avg("err"), "mae"), R(F.median("err"), "median_err"), R(F.percentile("err", F.lit(0.9)), "p90"), R(F.avg((F.col("err") <= 5).cast("int")), "within_5"))


#: Events have no frame rate. At 8 Hz, that of ``waves``, the projection's 1.6 s are the 12 frames of ``pos_overlap_add``,
#: the pulse band stays below half the rate, and windows of 40 frames, 5 apart as in ``hop_windows``, fit in recordings of some 65.
FPS, WINDOW_S, STRIDE_S = 8.0, 5.0, 0.625


def traces(spark, sf_dir):
    """All recordings of the events as colour traces (``pos_overlap_add``'s rgb), the truth ``hr`` of ``windows`` and k as contact trace.

    As in ``hop_windows``, a recording has only full windows.
    """
    k, x = F.col("k"), F.col("x")
    hr = x / F.lit(5.0) + (F.pmod(k * 37, F.lit(101)) - 50) / F.lit(5.0)
    return quality_frames(spark, sf_dir).select(
        "recording_id", "i", hr.alias("hr"), k.cast("double").alias("bvp"), (x + 50).alias("r"), (x * 0.7 + k + 40).alias("g"), (x * 0.4 + F.pmod(k * 7, F.lit(101)) + 30).alias("b"),
        F.coalesce("valid", F.lit(False)).alias("valid"), "face", "lighting", "sharpness", "motion", "compression",
    )


def _bvp(method):
    def run(spark, sf_dir):
        from pulsegrid.operators.analyze import analyze

        a = analyze(traces(spark, sf_dir), FPS, WINDOW_S, STRIDE_S, methods=[method])
        return a.select("recording_id", "method", "start_s", R("hr_bpm", n=3), R("pulse_snr_db", n=3), R("confidence", n=4), "reason", "n_beats")

    return run


_WIN, _STRIDE = int(FPS * WINDOW_S), int(FPS * STRIDE_S)
for _name, _method in (("bvp_features", "pos"), ("chrom_bvp", "chrom"), ("green_bvp", "green")):
    query(_name, pulse_twins.bvp(_method, FPS, _WIN, _STRIDE))(_bvp(_method))


@query("run_benchmark", pulse_twins.benchmark(["pos", "chrom", "green"], FPS, _WIN, _STRIDE))
def run_benchmark(spark, sf_dir):
    """All methods over all recordings, each trace read once, each window against its own truth; best median error first."""
    from pulsegrid.operators.analyze import analyze

    f = traces(spark, sf_dir)
    w = analyze(f, FPS, WINDOW_S, STRIDE_S, methods=["pos", "chrom", "green"], truth="hr").withColumn("hr", F.col("hr_bpm"))
    m = ev.go_no_go(ev.benchmark_metrics(ev.subject_metrics(w, ["method", "recording_id"], ["start_s"]), ["method"])).orderBy(F.col("median_mae_all").asc_nulls_last())
    return m.select("method", "n_subjects", "n_windows", *[R(c, n=4) for c in _METRICS], "go_mae", "go_coverage", "go")


_AREAS = f"""{_RC}, o AS (SELECT cohort, row_number() OVER w AS rank, row_number() OVER w / count(*) OVER (PARTITION BY cohort)::DOUBLE AS coverage,
  avg(err) OVER (PARTITION BY cohort ORDER BY err, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS risk FROM errs WINDOW w AS (PARTITION BY cohort ORDER BY err, event_id)),
a AS (SELECT cohort, (risk + lag(risk) OVER w) / 2 * (coverage - lag(coverage) OVER w) AS s FROM rc WINDOW w AS (PARTITION BY cohort ORDER BY rank)),
b AS (SELECT cohort, (risk + lag(risk) OVER w) / 2 * (coverage - lag(coverage) OVER w) AS s FROM o WINDOW w AS (PARTITION BY cohort ORDER BY rank)),
sa AS (SELECT cohort, sum(s) AS aurc FROM a GROUP BY 1), sb AS (SELECT cohort, sum(s) AS oracle FROM b GROUP BY 1), sn AS (SELECT cohort, count(*) AS n, avg(err) * (1 - 1.0::DOUBLE / count(*)) AS random FROM errs GROUP BY 1)
"""


@query("capture_ratio", f"""WITH {WINDOWS_SQL}, {_AREAS} SELECT cohort, n, round(random, 6) AS aurc_random, round(CASE WHEN n >= 10 AND random - oracle > 1e-12 THEN greatest(-1.0, least(1.0, (random - aurc) / (random - oracle))) END, 6)::DOUBLE AS capture_ratio
FROM sa JOIN sb USING (cohort) JOIN sn USING (cohort)""")  # fmt: skip
def capture_ratio(spark, sf_dir):
    c = ev.capture_ratio(errors(spark, sf_dir), ["cohort"], _order(), [F.col("err"), F.col("event_id")])
    return c.select("cohort", "n", R("aurc_random"), R("capture_ratio"))


@query("risk_at_coverage", f"""WITH {WINDOWS_SQL}, {_RC}, n AS (SELECT cohort, count(*) AS n FROM errs GROUP BY 1), g AS (SELECT cohort, unnest(range(1, 11)) AS step, n FROM n)
SELECT g.cohort, step::INT AS step, rc.rank, risk FROM g JOIN rc ON rc.cohort = g.cohort AND rc.rank = greatest(round_even(step * n / 10.0::DOUBLE, 0), 1)::BIGINT""")  # fmt: skip
def risk_at_coverage(spark, sf_dir):
    return ev.risk_at_coverage(errors(spark, sf_dir), ["cohort"], _order()).select("cohort", "step", F.col("rank").cast("long").alias("rank"), "risk")


def _auc_of(name, source, group="1"):
    return f"""{name}_r AS (SELECT {group} AS g, y, rank() OVER (PARTITION BY {group} ORDER BY s) + (count(*) OVER (PARTITION BY {group}, s) - 1) / 2.0::DOUBLE AS r FROM ({source})),
{name} AS (SELECT g, CASE WHEN count(*) FILTER (WHERE y = 1) > 0 AND count(*) FILTER (WHERE y = 0) > 0 THEN (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) END AS auc FROM {name}_r GROUP BY 1)"""


@query("baseline_ablation", f"""WITH {WINDOWS_SQL}, {_FIT}, z AS (SELECT w.recording_id, (event_type = 'purchase')::INT AS y, hr, hr - location AS rel FROM windows w LEFT JOIN fitted f ON session_id = recording_id AND feature = 'hr_bpm' WHERE event_type IN ('purchase', 'view') AND end_s > 60),
{_auc_of('pa', 'SELECT y, hr AS s FROM z')}, {_auc_of('pb', 'SELECT y, rel AS s FROM z WHERE rel IS NOT NULL')}, {_auc_of('pc', 'SELECT recording_id, y, hr AS s FROM z', 'recording_id')}
SELECT round(pa.auc, 6) AS auroc_raw, round(pb.auc, 6) AS auroc_baselined, round((SELECT avg(auc) FROM pc), 6) AS auroc_within, round(pb.auc - pa.auc, 6) AS delta FROM pa, pb""")  # fmt: skip
def baseline_ablation(spark, sf_dir):
    w = session_windows(spark, sf_dir)
    rel = bl.transform(w, bl.fit(w, 60.0), "hr_bpm").where((F.col("end_s") > 60) & F.col("event_type").isin("purchase", "view"))
    rel = rel.withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    return ev.baseline_ablation(rel, "session_id", "hr_bpm", "relative", "y").select(R("auroc_raw"), R("auroc_baselined"), R("auroc_within"), R("delta"))


@query("gt_window_hr", pulse_twins.truth(FPS, _WIN, _STRIDE))
def gt_window_hr(spark, sf_dir):
    """Rate of the contact trace per window of the frames."""
    from pulsegrid.operators.analyze import truth_rates

    f = traces(spark, sf_dir)
    gt = f.select("recording_id", F.col("i").alias("j"), "bvp")
    return truth_rates(gt, FPS, FPS, WINDOW_S, STRIDE_S).select("recording_id", "start_s", R("hr_gt", n=3))
