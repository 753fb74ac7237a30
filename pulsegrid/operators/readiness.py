"""Whether a session is worth running, from a short preview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions.scoring import MIN_FACE_FRACTION, READY_GOOD, READY_POOR


def readiness(frames: DataFrame, max_frames: int = 90) -> DataFrame:
    """Per recording over its first frames: face share, medians, verdict, expected usable share, messages.

    ``frames`` has recording_id, i, face (present), skin_fraction, lighting, compression (null where not sampled).
    """
    first = frames.withColumn("rn", F.row_number().over(W.partitionBy("recording_id").orderBy("i"))).where(F.col("rn") <= max_frames)
    on = lambda c: F.when(F.col("face"), F.col(c))
    agg = first.groupBy("recording_id").agg(
        F.avg(F.col("face").cast("double")).alias("face_fraction"), F.median(on("skin_fraction")).alias("skin_fraction"), F.median(on("lighting")).alias("lighting"), F.median(on("compression")).alias("compression")
    )
    seen = (F.col("face_fraction") >= MIN_FACE_FRACTION) & F.col("skin_fraction").isNotNull()
    good, fair = F.col("skin_fraction") >= READY_GOOD, F.col("skin_fraction") >= READY_POOR
    verdict = F.when(~seen, "no_face").when(good, "good").when(fair, "marginal").otherwise("poor")
    expected = F.when(seen, F.when(good, 0.71).when(fair, 0.69).otherwise(0.18))
    notes = F.array_compact(
        F.array(
            F.when(~seen, "no_face"),
            F.when(seen & ~fair, "little_skin"),
            F.when(seen & (F.col("lighting") < 0.6), "poor_lighting"),
            F.when(seen & (F.col("compression") < 0.15), "compressed"),
        )
    )
    out = agg.withColumn("verdict", verdict).withColumn("expected_usable", expected).withColumn("ready", F.col("verdict").isin("good", "marginal"))
    return out.withColumn("messages", F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit("ready"))))


def confusion(rows: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn of ``ready`` against ``usable``."""
    r, u = F.col("ready"), F.col("usable")
    return rows.groupBy(*by).agg(F.count_if(r & u).alias("tp"), F.count_if(r & ~u).alias("fp"), F.count_if(~r & u).alias("fn"), F.count_if(~r & ~u).alias("tn"))
