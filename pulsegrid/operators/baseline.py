"""Personal baselines: fit on the calm opening, express later windows against it, watch for drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WINDOWS, MIN_CONFIDENCE, MAD_TO_SIGMA, MIN_SCALE_FRACTION, DRIFT_SIGMA = 3, 0.45, 1.4826, 0.02, 3.0
FEATURES = ("hr_bpm", "ibi_mean_s", "pulse_amplitude")


def unpivot(windows: DataFrame, keys: list[str], features=FEATURES) -> DataFrame:
    """(keys, feature, value) rows of the non-null, finite features."""
    pairs = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in features)
    return windows.selectExpr(*keys, f"stack({len(features)}, {pairs}) AS (feature, value)").where("value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('Infinity')")


def fit(windows: DataFrame, calibration_s: float = 45.0, features=FEATURES) -> DataFrame:
    """Per session and feature: location (median), scale (floored 1.4826 MAD), n, floored.

    Uses answered windows that end in the calibration period with enough
    confidence; a session or feature with fewer than three has no baseline.
    """
    use = windows.where((F.col("end_s") <= calibration_s) & F.col("valid") & (F.col("confidence") >= MIN_CONFIDENCE))
    long = unpivot(use, ["session_id"], features)
    centre = long.groupBy("session_id", "feature").agg(F.median("value").alias("location"), F.count("*").alias("n")).where(F.col("n") >= MIN_WINDOWS)
    spread = long.join(centre, ["session_id", "feature"]).groupBy("session_id", "feature").agg(
        F.first("location").alias("location"), F.first("n").alias("n"), F.median(F.abs(F.col("value") - F.col("location"))).alias("mad")
    )
    raw, floor = MAD_TO_SIGMA * F.col("mad"), MIN_SCALE_FRACTION * F.abs(F.col("location"))
    return spread.select("session_id", "feature", "location", F.greatest(raw, floor, F.lit(1e-9)).alias("scale"), "n", (raw < floor).alias("floored"))


def reasons(windows: DataFrame, calibration_s: float = 45.0, features=FEATURES) -> DataFrame:
    """Per session and feature without a baseline, why: no_windows, refused, low_confidence or too_few, the first that explains it."""
    early = F.col("end_s") <= calibration_s
    sure = early & F.col("valid") & (F.col("confidence") >= MIN_CONFIDENCE)
    counts = [F.count_if(early).alias("early"), F.count_if(early & F.col("valid")).alias("answered"), F.count_if(sure).alias("sure")]
    usable = lambda f: F.count_if(sure & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))).alias(f"k_{f}")
    per = windows.groupBy("session_id").agg(*counts, *[usable(f) for f in features])
    long = per.selectExpr("session_id", "early", "answered", "sure", f"stack({len(features)}, {', '.join(f'{chr(39)}{f}{chr(39)}, k_{f}' for f in features)}) AS (feature, k)")
    why = F.when(F.col("early") == 0, "no_windows").when(F.col("answered") < MIN_WINDOWS, "refused").when(F.col("sure") < MIN_WINDOWS, "low_confidence").otherwise("too_few")
    return long.where(F.col("k") < MIN_WINDOWS).select("session_id", "feature", F.col("k").alias("n"), why.alias("reason"))


def transform(windows: DataFrame, baseline: DataFrame, feature: str, mode: str = "delta") -> DataFrame:
    """Adds ``relative``: the feature's distance from its baseline, in its unit or in scales; null without one."""
    if mode not in ("delta", "z"):
        raise ValueError(f"mode must be 'delta' or 'z', got {mode!r}")
    base = baseline.where(F.col("feature") == feature).select("session_id", "location", "scale")
    delta = F.col(feature) - F.col("location")
    return windows.join(base, "session_id", "left").withColumn("relative", delta / F.col("scale") if mode == "z" else delta)


def drift(windows: DataFrame, baseline: DataFrame, features=FEATURES) -> DataFrame:
    """Per session and feature: z of the windows' median against the baseline, and whether it left it."""
    recent = unpivot(windows, ["session_id"], features).groupBy("session_id", "feature").agg(F.median("value").alias("recent"), F.count("*").alias("k")).where(F.col("k") >= MIN_WINDOWS)
    z = (F.col("recent") - F.col("location")) / F.col("scale")
    return recent.join(baseline, ["session_id", "feature"]).select("session_id", "feature", z.alias("z"), (F.abs(z) > DRIFT_SIGMA).alias("drifted"))
