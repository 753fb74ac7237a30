"""Command line over the synthetic cohorts: list, methods, bench, sweep, calib, ablate, threshold, ocular, readiness."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import signal_np
from pulsegrid.operators import baseline as bl
from pulsegrid.operators import evaluate as ev
from pulsegrid.operators import ocular, readiness
from pulsegrid.operators.analyze import analyze
from pulsegrid.session import build_session
from pulsegrid.sources import datasets, synth

COHORTS = {"synthetic": synth.cohort, "synthetic_stress": synth.stress, "synthetic_protocol": synth.protocol}


def analysed(frames: DataFrame, methods: list[str], stride_s: float, window_s: float = 20.0) -> DataFrame:
    """Analysed windows with the mean true rate of each window."""
    w = analyze(frames, 30.0, window_s=window_s, stride_s=stride_s, methods=methods, truth="hr").withColumn("hr", F.col("hr_bpm"))
    return w.withColumn("err", ev.abs_error()).withColumn("conf", F.col("confidence"))


def benchmark(w: DataFrame) -> DataFrame:
    """A row a method, best first, with the capture ratio among its bars."""
    rows = w.where("err IS NOT NULL AND conf IS NOT NULL")
    tie = [F.col("recording_id"), F.col("start_s")]
    capture = ev.capture_ratio(rows, ["method"], [F.col("conf").desc(), *tie], [F.col("err"), *tie]).select("method", "capture_ratio")
    m = ev.benchmark_metrics(ev.subject_metrics(w, ["method", "recording_id"], ["start_s"]), ["method"]).join(capture, "method", "left")
    return ev.go_no_go(m, "capture_ratio").orderBy(F.col("median_mae_all").asc_nulls_last())


def blinking(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An eye openness that closes for six frames every four seconds, and those times: what ``ocular`` is scored on."""
    every = 120
    shut = F.col("i") % every < 6
    eyes = frames.select("recording_id", "i", (20 + F.col("bvp") - F.when(shut & (F.col("i") >= every), 8.0).otherwise(F.lit(0.0))).alias("openness"))
    return eyes, frames.where((F.col("i") % every == 0) & (F.col("i") >= every)).select("recording_id", (F.col("i") + 2.5).alias("t"))


def ablation(windows: DataFrame, calibration_s: float = 45.0) -> DataFrame:
    """AUROC of task against rest: raw, baselined, within subjects, and the share of the gap recovered."""
    w = windows.withColumn("session_id", F.col("recording_id"))
    e, s = F.col("end_s"), F.col("start_s")
    rel = bl.transform(w, bl.fit(w, calibration_s), "hr_bpm")
    lo, hi = synth.PROTOCOL_TASK
    # rest windows that calibrated are held out
    rel = rel.withColumn("y", F.when((s >= calibration_s) & (e <= lo), 0).when((s >= lo + 10) & (e <= hi), 1)).where("y IS NOT NULL")
    out = ev.baseline_ablation(rel, "recording_id", "hr_bpm", "relative", "y")
    return out.select(*[F.col(f"auroc_{c}").alias(c) for c in ("raw", "baselined", "within")], "delta", "gap_recovered", "n_task", "n_rest")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pulsegrid")
    p.add_argument("command", choices=["list", "bench", "sweep", "calib", "ablate", "threshold", "methods", "ocular", "readiness"])
    p.add_argument("--dataset", choices=sorted(COHORTS), default="synthetic")
    p.add_argument("--methods", default="pos,chrom,green")
    p.add_argument("--stride", type=float, default=2.0)
    p.add_argument("--window", type=float, default=20.0, help="seconds of a window")
    p.add_argument("--limit", type=int, help="recordings at most")
    p.add_argument("--duration", type=float, help="seconds of a recording")
    p.add_argument("--axis", choices=sorted(synth.AXES), default="noise", help="what sweep degrades")
    p.add_argument("--strict", action="store_true", help="bench: fail unless every method passes its bars")
    p.add_argument("--table", action="store_true", help="print a text table instead of JSON")
    p.add_argument("--config")
    p.add_argument("--out")
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(argv)
    if a.command == "list":
        print(json.dumps(datasets.available(a.config) | dict.fromkeys(COHORTS, "built in"), indent=1))
        return 0
    if a.command == "methods":
        print(json.dumps(sorted(signal_np.METHODS)))
        return 0
    spark = build_session("pulsegrid-cli", a.master)
    name = "synthetic_protocol" if a.command == "ablate" else "synthetic_stress" if a.command in ("calib", "threshold") else a.dataset
    configs = synth.axis(a.axis) if a.command == "sweep" else COHORTS[name]()
    configs = [replace(c, seconds=a.duration) if a.duration else c for c in configs[: a.limit]]
    frames = synth.frames(spark, configs)
    one = ["method"]
    if a.command in ("ocular", "readiness"):
        w = None
    else:
        w = analysed(frames, a.methods.split(",") if a.command == "bench" else ["pos"], a.stride, a.window)
    if a.command == "bench":
        out = benchmark(w)
    elif a.command == "ablate":
        out = ablation(w)
    elif a.command == "threshold":
        out = ev.threshold_sweep(w.where("err IS NOT NULL AND conf IS NOT NULL"), least=20).orderBy("threshold")
    elif a.command == "sweep":
        out = w.groupBy(F.lit(a.axis).alias("axis"), F.floor(F.col("recording_id") / 2).alias("level"), "method").agg(F.count("*").alias("n_windows"), F.avg(F.col("valid").cast("double")).alias("coverage"), F.avg("err").alias("mae_all"), F.avg(F.when(F.col("valid"), F.col("err"))).alias("mae")).orderBy("level")
    elif a.command == "ocular":
        eyes, times = blinking(frames)
        out = ocular.sweep_scores(eyes, times, 30.0, (0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)).orderBy("drop_ratio")
    elif a.command == "readiness":
        shown = frames.select("recording_id", "i", F.col("valid").alias("face"), F.col("face").alias("skin_fraction"), "lighting", "compression")
        out = readiness.readiness(shown, 90)
    else:
        out = ev.kept_and_abstained(w, one).join(ev.spearman(w.where("err IS NOT NULL AND conf IS NOT NULL"), one, "conf", "err"), one)
    if a.table:
        shown = [c for c, t in out.dtypes if not t.startswith("array")]
        print("\n".join(r.line for r in ev.table_text(out, shown).collect()))
        spark.stop()
        return 0
    rows = [r.asDict() for r in out.collect()]
    text = json.dumps(rows, indent=1)
    print(text)
    if a.out:
        Path(a.out).write_text(text)
    ok = a.command != "bench" or (all if a.strict else any)(r["go"] for r in rows)
    spark.stop()
    return 0 if ok else 1


if __name__ == "__main__":
    raise SystemExit(main())
