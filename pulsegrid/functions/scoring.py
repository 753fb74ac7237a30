"""Quality and confidence as Column expressions. Null stays null: nothing missing turns into a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the score's definition.
GOOD_LUMA = (60.0, 200.0)
CHROMA_FLOOR, CHROMA_GOOD, BLOCKINESS_SCALE = 0.001, 0.05, 8.0
MOTION_TOLERANCE = 0.02
SNR_MID_DB, SNR_SCALE_DB, STABILITY_SCALE_BPM = 3.0, 3.0, 6.0
ABSTAIN_BELOW, MIN_WINDOW_QUALITY, MIN_VALID_RATIO, MAX_GAP_S = 0.20, 0.35, 0.75, 0.5
FRAME_WEIGHTS = {"face": 0.30, "lighting": 0.20, "motion": 0.18, "sharpness": 0.15, "compression": 0.17}
WINDOW_WEIGHTS = {"face": 0.25, "lighting": 0.16, "motion": 0.16, "sharpness": 0.12, "compression": 0.19, "fps_stability": 0.12}
IMAGE_WEIGHTS = {"face": 0.34, "lighting": 0.20, "motion": 0.20, "compression": 0.26}
READY_GOOD, READY_POOR, MIN_FACE_FRACTION = 0.86, 0.70, 0.5


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """``x`` within [lo, hi]; greatest and least skip nulls, so those are kept apart."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def lighting(luma: Column, clipped: Column) -> Column:
    lo, hi = GOOD_LUMA
    ramp = F.when(luma < lo, luma / lo).when(luma > hi, F.greatest(F.lit(0.0), 1.0 - (luma - hi) / (255.0 - hi))).otherwise(F.lit(1.0))
    return F.when(luma.isNotNull(), clip(ramp * (1.0 - clipped)))


def sharpness(variance: Column) -> Column:
    return variance / (variance + 8.0)


def compression(chroma_ratio: Column, blockiness: Column) -> Column:
    span = F.log10(F.lit(CHROMA_GOOD)) - F.log10(F.lit(CHROMA_FLOOR))
    chroma = clip((F.log10(F.greatest(chroma_ratio, F.lit(1e-9))) - F.log10(F.lit(CHROMA_FLOOR))) / span)
    return F.when(chroma_ratio.isNotNull(), chroma / (1.0 + BLOCKINESS_SCALE * blockiness))


def motion(displacement: Column, width: Column) -> Column:
    return F.when(width <= 0, F.lit(0.0)).otherwise(clip(1.0 - displacement / F.nullif(width, F.lit(0.0)) / (4 * MOTION_TOLERANCE)))


def weighted(weights: dict[str, float], columns: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * columns[name]
    return clip(total)


def window_overall(columns: dict[str, Column], valid_ratio: Column) -> Column:
    return weighted(WINDOW_WEIGHTS, columns) * clip(valid_ratio)


def snr_quality(snr: Column) -> Column:
    """Logistic of the SNR; missing evidence scores 0."""
    good = snr.isNotNull() & ~F.isnan(snr) & (F.abs(snr) < float("inf"))
    return F.when(good, 1.0 / (1.0 + F.exp(-(snr - SNR_MID_DB) / SNR_SCALE_DB))).otherwise(F.lit(0.0))


def pulse_quality(snr: Column, stability: Column) -> Column:
    good = stability.isNotNull() & ~F.isnan(stability) & (F.abs(stability) < float("inf"))
    return F.when(good, clip(snr_quality(snr) * F.exp(-F.pow(stability / STABILITY_SCALE_BPM, F.lit(2.0))))).otherwise(F.lit(0.0))


def image_quality(columns: dict[str, Column], valid_ratio: Column, fps_stability: Column) -> Column:
    total = F.lit(0.0)
    for name, w in IMAGE_WEIGHTS.items():
        total = total + w * clip(columns[name])
    return total * clip(valid_ratio) * clip(0.5 + 0.5 * fps_stability)


def confidence(image: Column, pulse: Column, model: Column | None = None) -> Column:
    value = clip(image * pulse)
    return value if model is None else clip(value * (0.5 + 0.5 * clip(model)))


def decision(valid_ratio: Column, longest_gap: Column, gap_limit: Column, overall: Column, conf: Column, hr: Column) -> Column:
    """The reason a window is refused, null when it is answered; the first that applies."""
    return (
        F.when(valid_ratio < MIN_VALID_RATIO, "insufficient_valid_frames")
        .when(longest_gap > gap_limit, "signal_gap_too_long")
        .when(overall < MIN_WINDOW_QUALITY, "low_quality")
        .when(conf < ABSTAIN_BELOW, "low_confidence")
        .when(hr.isNull(), "no_hr_peak")
    )


def age_band(age: Column) -> Column:
    return F.when((age >= 18) & (age <= 29), "18-29").when((age >= 30) & (age <= 49), "30-49").when((age >= 50) & (age <= 120), "50+")
