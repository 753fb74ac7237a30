"""Frame-index windows, gaps, resampling and per-window quality over ordered frame rows.

Relations carry (recording_id, i): i is the frame index within its recording.
All operators partition by recording and keep one shuffle where they chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions.scoring import clip

def _by():
    return W.partitionBy("recording_id").orderBy("i")


def hop_windows(frames: DataFrame, win: int, stride: int) -> DataFrame:
    """Each frame once per full window that holds it: adds ``start`` (first frame index).

    Starts are multiples of ``stride``; a recording of n frames has windows only
    up to n - win, so a short one has none. Generated per row, without a join.
    """
    n = F.max("i").over(W.partitionBy("recording_id")) + 1
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") - (win - 1)) / stride)).cast("long")
    last = F.least(F.floor(F.col("i") / stride), F.floor((F.col("n") - win) / stride)).cast("long")
    out = frames.withColumn("n", n).where(F.col("n") >= win).withColumn("first", first).withColumn("last", last).where("first <= last")
    return out.withColumn("hop", F.explode(F.sequence("first", "last"))).withColumn("start", F.col("hop") * stride).drop("n", "first", "last", "hop")


def longest_gap(rows: DataFrame, keys: list[str], order: str = "i") -> DataFrame:
    """Per key the frames, the valid share and the longest run of invalid frames (gaps and islands)."""
    by = W.partitionBy(*keys).orderBy(order)
    island = rows.withColumn("island", F.sum(F.col("valid").cast("int")).over(by))
    runs = island.groupBy(*keys, "island").agg(F.count("*").alias("rows"), F.sum(F.col("valid").cast("int")).alias("ok"))
    return runs.groupBy(*keys).agg(
        F.sum("rows").alias("n_frames"), (F.sum("ok") / F.sum("rows")).alias("valid_ratio"), F.max(F.col("rows") - F.col("ok")).alias("longest_gap")
    )


def gap_fill(frames: DataFrame, value: str = "x") -> DataFrame:
    """Linear interpolation over invalid frames; before the first and after the last valid one the nearest holds."""
    seen = F.when(F.col("valid"), F.struct(F.col("i").alias("i"), F.col(value).alias("x")))
    before = F.last(seen, ignorenulls=True).over(_by().rowsBetween(W.unboundedPreceding, 0))
    after = F.first(seen, ignorenulls=True).over(_by().rowsBetween(0, W.unboundedFollowing))
    out = frames.withColumn("b", before).withColumn("a", after)
    span = F.col("a.i") - F.col("b.i")
    lerp = F.col("b.x") + (F.col("a.x") - F.col("b.x")) * (F.col("i") - F.col("b.i")) / F.nullif(span, F.lit(0))
    filled = F.when(F.col("valid"), F.col(value)).when(F.col("b").isNull(), F.col("a.x")).when(F.col("a").isNull(), F.col("b.x")).otherwise(lerp)
    return out.withColumn("filled", filled).drop("a", "b")


def resample(trace: DataFrame, src_fps: float, dst_fps: float, value: str = "x") -> DataFrame:
    """A constant-rate trace (recording_id, j, value) linearly onto another rate: equi-joins on the floor index, ends held."""
    last = trace.groupBy("recording_id").agg(F.max("j").alias("top"))
    n = F.floor((F.col("top") / F.lit(src_fps)) * dst_fps).cast("long")
    grid = last.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n)))
    pos = F.col("i") * F.lit(src_fps) / F.lit(dst_fps)
    grid = grid.withColumn("pos", pos).withColumn("lo", F.least(F.floor("pos").cast("long"), F.col("top")))
    nxt = F.lead(value).over(W.partitionBy("recording_id").orderBy("j"))
    pairs = trace.withColumn("nxt", nxt).select("recording_id", F.col("j").alias("lo"), F.col(value).alias("x0"), F.coalesce("nxt", value).alias("x1"))
    out = grid.join(pairs, ["recording_id", "lo"])
    return out.select("recording_id", "i", (F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("pos") - F.col("lo"))).alias("x"))


def fps_stability(rows: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """1 - coefficient of variation of frame intervals within [0, 1]; 0 under three stamps or without progress."""
    dt = rows.withColumn("dt", F.col(stamp) - F.lag(stamp).over(W.partitionBy(*keys).orderBy(stamp)))
    agg = dt.groupBy(*keys).agg(F.count("*").alias("n_frames"), F.avg("dt").alias("mean_dt"), F.stddev_pop("dt").alias("sd_dt"))
    good = (F.col("n_frames") >= 3) & (F.col("mean_dt") > 0)
    return agg.withColumn("fps_stability", F.when(good, clip(1.0 - F.col("sd_dt") / F.nullif(F.col("mean_dt"), F.lit(0.0)))).otherwise(F.lit(0.0)))


def measured_fps(rows: DataFrame, keys: list[str], stamp: str, least: int = 10) -> DataFrame:
    """(n - 1) / (last - first); null under ``least`` stamps or without a positive span."""
    agg = rows.groupBy(*keys).agg(F.count(stamp).alias("n_stamps"), F.min(stamp).alias("t0"), F.max(stamp).alias("t1"))
    span = F.col("t1") - F.col("t0")
    return agg.withColumn("fps", F.when((F.col("n_stamps") >= least) & (span > 0), (F.col("n_stamps") - 1) / F.nullif(span, F.lit(0.0)))).drop("t0", "t1")


def window_quality(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Quality of valid frames: 10th percentile of face and motion, means of the rest; nulls and a reason without any."""
    ok = F.col("valid")
    low = lambda c: F.percentile(F.when(ok, F.col(c)), F.lit(0.1)).alias(c)
    mean = lambda c: F.avg(F.when(ok, F.col(c))).alias(c)
    agg = rows.groupBy(*keys).agg(
        low("face"), low("motion"), mean("lighting"), mean("sharpness"), mean("compression"), F.avg(ok.cast("double")).alias("valid_ratio"), F.count_if(ok).alias("n_valid")
    )
    return agg.withColumn("reason", F.when(F.col("n_valid") == 0, "no_valid_frames"))


def normalize(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Zero mean and unit population deviation per key; zeros where there is no variation."""
    by = W.partitionBy(*keys)
    sd, mu = F.stddev_pop(value).over(by), F.avg(value).over(by)
    return rows.withColumn("sd", sd).withColumn("z", F.when(F.col("sd") < 1e-12, F.lit(0.0)).otherwise((F.col(value) - mu) / F.nullif(F.col("sd"), F.lit(0.0)))).drop("sd")


def pos_overlap_add(frames: DataFrame, w: int, keys: list[str]) -> DataFrame:
    """POS projection before its band-pass as two chained window frames over one partitioning (r, g, b per frame i).

    Each start normalises by its own means, so its two projections have mean 0
    and their deviations follow from (co)variances; overlap-add is a backward sum
    of per-start coefficients. Starts without a whole frame or with a mean of 0
    give nothing.
    """
    by = W.partitionBy(*keys).orderBy("i")
    ahead, back = by.rowsBetween(0, w - 1), by.rowsBetween(-(w - 1), 0)
    out = frames.withColumn("cnt", F.count("*").over(ahead))
    for c in "rgb":
        out = out.withColumn(f"m{c}", F.avg(c).over(ahead))
    for p, q in ("rr", "gg", "bb", "rg", "rb", "gb"):
        out = out.withColumn(f"v{p}{q}", F.covar_pop(p, q).over(ahead))
    ok = (F.col("cnt") == w) & (F.col("mr") > 1e-9) & (F.col("mg") > 1e-9) & (F.col("mb") > 1e-9)
    n = lambda p, q: F.col(f"v{p}{q}") / (F.col(f"m{p}") * F.col(f"m{q}"))
    var1 = n("g", "g") + n("b", "b") - 2 * n("g", "b")
    var2 = 4 * n("r", "r") + n("g", "g") + n("b", "b") - 4 * n("r", "g") - 4 * n("r", "b") + 2 * n("g", "b")
    sd = lambda v: F.sqrt(F.greatest(v, F.lit(0.0)))
    out = out.withColumn("ok", ok).withColumn("s1", F.when(ok, sd(var1))).withColumn("s2", F.when(ok, sd(var2)))
    out = out.withColumn("alpha", F.when(F.col("s2") > 1e-12, F.col("s1") / F.nullif(F.col("s2"), F.lit(0.0))).when(F.col("ok"), F.lit(0.0)))
    coef = {"r": -2 * F.col("alpha") / F.col("mr"), "g": (1 + F.col("alpha")) / F.col("mg"), "b": (F.col("alpha") - 1) / F.col("mb")}
    total = F.lit(0.0)
    for c, k in coef.items():
        total = total + F.col(c) * F.coalesce(F.sum(F.when(F.col("ok"), k)).over(back), F.lit(0.0))
    return out.withColumn("h", total).select(*keys, "i", "h")


def first_streak(rows: DataFrame, good, length: int) -> DataFrame:
    """Per recording the first frame that ends ``length`` good ones in a row."""
    marked = rows.withColumn("good", good).withColumn("isl", F.sum((~F.col("good")).cast("int")).over(_by()))
    streak = F.row_number().over(W.partitionBy("recording_id", "isl", "good").orderBy("i"))
    return marked.withColumn("streak", streak).where(F.col("good") & (F.col("streak") >= length)).groupBy("recording_id").agg(F.min("i").alias("unlocked_at"))


def training_chunks(frames: DataFrame, chunk: int, label: str | None = None, lags: DataFrame | None = None) -> DataFrame:
    """Frames of consecutive chunks of ``chunk`` + 1 frames that start every ``chunk``; adds ``start``.

    The frame where one chunk ends and the next begins belongs to both. A chunk
    starts only where more than ``chunk`` + 1 frames are left. With ``lags`` (recording_id, lag in frames) the column ``label`` is that of ``lag`` frames later, none for
    recordings that have no lag, and chunks whose labels would leave the recording are dropped.
    """
    n = F.max("i").over(W.partitionBy("recording_id")) + 1
    rows = frames.withColumn("n", n)
    if lags is not None:
        shift = F.coalesce("lag", F.lit(0)).cast("long")
        known = rows.join(lags.select("recording_id", "lag"), "recording_id", "left").withColumn("lag", shift)
        later = known.select("recording_id", (F.col("i") - F.col("lag")).alias("i"), F.col(label).alias("_label"))
        rows = known.join(later, ["recording_id", "i"], "left").drop(label).withColumnRenamed("_label", label)
    both = F.when((F.col("i") % chunk == 0) & (F.col("i") > 0), F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0)))
    out = rows.withColumn("back", F.explode(both)).withColumn("start", (F.floor(F.col("i") / chunk) - F.col("back")) * chunk)
    out = out.where(F.col("start") < F.col("n") - chunk - 1)
    if lags is not None:
        out = out.where((F.col("start") + F.col("lag") >= 0) & (F.col("start") + F.col("lag") + chunk + 1 <= F.col("n")))
    return out.drop("n", "back", "lag")
