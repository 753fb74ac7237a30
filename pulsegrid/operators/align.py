"""Series with stamps of their own, brought together: as-of joins and interpolation between irregular times.

Both series go into one order, dealt by ranges of (key, time). A row takes the last or next row of the other series from its own range, and
from the borders of the ranges before or after it where its own has none. So a key of any length spreads over tasks, and nothing is
compared pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.ranks import Ordered


def _both(left: DataFrame, right: DataFrame, by: list[str], t: str, values: list[str]) -> Ordered:
    """One order of both: at one time the right rows come first, so that they count as known."""
    kept = [c for c in left.columns if c not in by and c != t]
    one = left.select(*by, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.struct(F.lit(0).alias("_"), *kept).alias("_left"), F.lit(None).cast(right.select(F.struct(F.col(t).alias("t"), *values)).schema[0].dataType).alias("_right"))
    two = right.where(F.col(t).isNotNull()).select(*by, F.col(t).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(one.schema["_left"].dataType).alias("_left"), F.struct(F.col(t).alias("t"), *values).alias("_right"))
    both = one.unionByName(two).withColumn("_tie", F.xxhash64("_right"))
    return Ordered(both, by, ["_t", "_side", "_tie"])


def asof(left: DataFrame, right: DataFrame, by: list[str], t: str, values: list[str], within: float | None = None) -> DataFrame:
    """``left`` with ``<t>_asof`` and the ``values`` of the newest right row of its key at or before its time; null without one, or one older than ``within``.

    Null keys are a key. Of right rows at one time one is chosen, the same each time. Left rows without a time meet nothing; right rows without one are ignored.
    """
    kept = [c for c in left.columns if c not in by and c != t]
    rows = _both(left, right, by, t, values).before("_found", F.col("_right")).done().where("_side = 1")
    near = F.col("_t").isNotNull() if within is None else F.col("_t") - F.col("_found.t") <= within
    take = lambda c: F.when(near, F.col(f"_found.{c}"))
    return rows.select(*by, F.col("_t").alias(t), *[F.col(f"_left.{c}").alias(c) for c in kept], take("t").alias(f"{t}_asof"), *[take(c).alias(c) for c in values])


def interpolated(left: DataFrame, right: DataFrame, by: list[str], t: str, value: str, longest: float | None = None) -> DataFrame:
    """``left`` with ``value`` of the right series at its times: linear between the rows around it, the nearest one's before the first and after the last.

    Null where the rows around are more than ``longest`` apart, or where the key has none. Null values of the right series are skipped.
    """
    kept = [c for c in left.columns if c not in by and c != t]
    known = right.where(F.col(value).isNotNull())
    rows = _both(left, known, by, t, [value]).before("_a", F.col("_right")).after("_b", F.col("_right")).done().where("_side = 1")
    t0, t1, x0, x1 = F.col("_a.t"), F.col("_b.t"), F.col(f"_a.{value}").cast("double"), F.col(f"_b.{value}").cast("double")
    share = (F.col("_t") - t0) / F.nullif(t1 - t0, F.lit(0.0))
    x = F.when(F.col("_t").isNull(), None).when(t0.isNull(), x1).when(t1.isNull() | (F.col("_t") == t0), x0).otherwise(x0 + (x1 - x0) * share)
    if longest is not None:
        x = F.when(t0.isNull() | t1.isNull() | (F.col("_t") == t0) | (t1 - t0 <= longest), x)
    return rows.select(*by, F.col("_t").alias(t), *[F.col(f"_left.{c}").alias(c) for c in kept], x.alias(value))


def grid(series: DataFrame, by: list[str], t: str, step: Column | float) -> DataFrame:
    """(by, i, t): even times from a key's first stamp to its last, ``step`` apart."""
    ends = series.groupBy(*by).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    each = F.lit(step) if isinstance(step, (int, float)) else step
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_t1") - F.col("_t0")) / each).cast("long")))
    return ends.where("_t0 IS NOT NULL").select(*by, "_t0", i.alias("i")).select(*by, "i", (F.col("_t0") + F.col("i") * each).alias(t))


def resampled(series: DataFrame, by: list[str], t: str, value: str, fps: float, longest: float | None = None) -> DataFrame:
    """(by, i, t, value): a series with uneven stamps on an even time base of ``fps``."""
    return interpolated(grid(series, by, t, 1.0 / fps), series, by, t, value, longest)
