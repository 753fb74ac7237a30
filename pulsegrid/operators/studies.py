"""Session and study aggregates over state samples, and the study store's lifecycle operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators.ranks import quantiles
from pulsegrid.staging import staged


def session_scores(samples: DataFrame) -> DataFrame:
    """Per session: samples scored (not calibrating), answered (no reason) and the median rate."""
    return samples.groupBy("session_id").agg(
        F.count_if(~F.col("reason").eqNullSafe("calibrating")).alias("scored"),
        F.count_if(F.col("reason").isNull()).alias("answered"),
        F.median("hr_bpm").alias("median_hr"),
    )


def study_aggregate(sessions: DataFrame, samples: DataFrame, usable_ratio: float = 0.5) -> DataFrame:
    """Per study: sessions, usable sessions, the pooled answered ratio and the exact median of the sessions' rates; sessions without samples count.

    A study may have any number of sessions: counts fold before they move, and the median is found by counting (``ranks.quantiles``).
    """
    per = staged(sessions.join(session_scores(samples), "session_id", "left").fillna(0, ["scored", "answered"]), "scores")
    usable = F.when((F.col("scored") > 0) & (F.col("answered") >= usable_ratio * F.col("scored")), 1).otherwise(0)
    out = per.groupBy("study_id").agg(
        F.count("*").alias("n_sessions"),
        F.sum(usable).alias("n_usable"),
        F.round(F.sum(usable).cast("double") / F.count("*"), 6).alias("usable_rate"),
        F.round(F.sum("answered").cast("double") / F.greatest(F.sum("scored"), F.lit(1)).cast("double"), 6).alias("answered_ratio"),
    )
    middle = quantiles(per, ["study_id"], "median_hr", name="median_hr")
    return out.join(middle, out["study_id"].eqNullSafe(middle["study_id"])).select(*[out[c] for c in out.columns], F.round("median_hr", 6).alias("median_hr"))


def session_summary(samples: DataFrame) -> DataFrame:
    """Per session over all samples: counts, answered share, rate range, mean confidence, reasons by count."""
    reasons = samples.where("reason IS NOT NULL").groupBy("session_id", "reason").agg(F.count("*").alias("k"))
    hist = reasons.groupBy("session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "k")))).alias("reasons"))
    agg = samples.groupBy("session_id").agg(
        F.count("*").alias("n_samples"),
        F.count_if(F.col("reason").isNull()).alias("n_answered"),
        F.median("hr_bpm").alias("median_hr"), F.min("hr_bpm").alias("min_hr"), F.max("hr_bpm").alias("max_hr"),
        F.avg("confidence").alias("mean_confidence"),
    )
    return agg.withColumn("answered_ratio", F.col("n_answered") / F.col("n_samples")).join(hist, "session_id", "left")


def reason_histogram(samples: DataFrame) -> DataFrame:
    return samples.groupBy("session_id", F.coalesce("reason", F.lit("answered")).alias("reason")).agg(F.count("*").alias("n"))


def latest(rows: DataFrame, keys: list[str], newest: list) -> DataFrame:
    """Upsert: the newest row of each key."""
    w = W.partitionBy(*keys).orderBy(*newest)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def consent_gate(rows: DataFrame, consents: DataFrame, version: str | None = None, scope: str | None = None) -> DataFrame:
    """Rows of sessions whose consent is active, and current and in scope where asked."""
    active = consents.where("withdrawn_at IS NULL")
    if version is not None:
        active = active.where(F.col("notice_version") == version)
    if scope is not None:
        active = active.where(F.array_contains("scopes", scope))
    return rows.join(active.select("session_id").distinct(), "session_id", "left_semi")


def erase(rows: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """A table without the withdrawn sessions' rows; every table and copy that carries the session is rewritten so."""
    return rows.join(withdrawn.select("session_id").distinct(), "session_id", "left_anti")


def expired_sessions(sessions: DataFrame, studies: DataFrame, now: float, default_days: int = 90) -> DataFrame:
    """Sessions past their study's retention; a session without a study falls under the default."""
    days = F.coalesce("retention_days", F.lit(default_days))
    return sessions.join(studies.select("study_id", "retention_days"), "study_id", "left").where(F.col("created_at") < F.lit(now) - days * 86400.0).select("session_id")


def retention_purge(rows: DataFrame, sessions: DataFrame, studies: DataFrame, now: float, default_days: int = 90) -> DataFrame:
    return erase(rows, expired_sessions(sessions, studies, now, default_days))


def session_export(sessions: DataFrame, samples: DataFrame, marks: DataFrame) -> DataFrame:
    """Each session with its samples and marks as arrays ordered by time; a session's own rows only meet in one task."""
    s = samples.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("t", "hr_bpm", "confidence", "reason"))).alias("samples"))
    m = marks.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("t", "label"))).alias("marks"))
    return sessions.join(s, "session_id", "left").join(m, "session_id", "left")


def overlay_segments(samples: DataFrame) -> DataFrame:
    """Runs of answered samples of each session, never joined across a refusal: segment number, range in time and rate."""
    w = W.partitionBy("session_id").orderBy("t", "event_id")
    gaps = samples.withColumn("segment", F.sum(F.col("reason").isNotNull().cast("int")).over(w))
    return gaps.where("reason IS NULL").groupBy("session_id", "segment").agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"), F.min("hr_bpm").alias("low"), F.max("hr_bpm").alias("high"))


def overlay_usable(sessions: DataFrame, samples: DataFrame, first: int = 12, usable_ratio: float = 0.5) -> DataFrame:
    """``overlay_segments`` of each study's first ``first`` usable sessions (study_id, session_id, in ``created_at`` order), with their ``position``."""
    good = (F.col("scored") > 0) & (F.col("answered") >= usable_ratio * F.col("scored"))
    rank = F.row_number().over(W.partitionBy("study_id").orderBy("created_at", "session_id"))
    picked = sessions.join(session_scores(samples), "session_id").where(good).withColumn("position", rank).where(F.col("position") <= first).select("study_id", "session_id", "position")
    return overlay_segments(samples.join(picked.select("session_id"), "session_id", "left_semi")).join(picked, "session_id")


def study_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions not withdrawn, newest first within their study."""
    rank = F.row_number().over(W.partitionBy("study_id").orderBy(F.col("created_at").desc(), "session_id"))
    return sessions.where("withdrawn_at IS NULL").withColumn("position", rank)
