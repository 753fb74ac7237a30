"""Queries over series with stamps of their own, and over exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import align, ranks
from pulsegrid.plans.catalog import query
from pulsegrid.plans.tables import table

R = lambda c, n=6: F.round(c, n).alias(c)


def series(spark, sf_dir):
    """``events`` as an irregular series of each user: key, t in seconds, x, event_type and event_id."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("t"), F.col("value").alias("x"), "event_type", "event_id")


_SERIES = "series AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS t, value AS x, event_type, event_id FROM events)"


@query("asof_values", f"""WITH {_SERIES}, l AS (SELECT key, t, event_id FROM series WHERE event_type = 'purchase'), r AS (SELECT key, t, x FROM series WHERE event_type = 'view')
SELECT l.key, l.event_id, CASE WHEN l.t - r.t <= 86400 THEN round(l.t - r.t, 3) END AS age_s, CASE WHEN l.t - r.t <= 86400 THEN r.x END AS x FROM l ASOF LEFT JOIN r ON l.key = r.key AND l.t >= r.t""")  # fmt: skip
def asof_values(spark, sf_dir):
    """The newest view up to a day before each purchase."""
    s = series(spark, sf_dir)
    found = align.asof(s.where("event_type = 'purchase'").select("key", "t", "event_id"), s.where("event_type = 'view'").select("key", "t", "x"), ["key"], "t", ["x"], within=86400.0)
    return found.select("key", "event_id", F.round(F.col("t") - F.col("t_asof"), 3).alias("age_s"), "x")


#: Seconds of the even time base.
STEP = 21600.0


@query("resample_uneven", f"""WITH {_SERIES}, e AS (SELECT key, min(t) AS t0, max(t) AS t1 FROM series GROUP BY 1),
g AS (SELECT key, i, t0 + i * {STEP}::DOUBLE AS t FROM (SELECT key, t0, unnest(range(0, floor((t1 - t0) / {STEP}::DOUBLE)::BIGINT + 1)) AS i FROM e)),
b AS (SELECT g.key, g.i, g.t, a.t AS ta, a.x AS xa FROM g ASOF LEFT JOIN series a ON g.key = a.key AND g.t >= a.t)
SELECT b.key, b.i, round(CASE WHEN n.t IS NULL OR b.t = ta THEN xa ELSE xa + (n.x - xa) * ((b.t - ta) / (n.t - ta)) END, 5) AS x FROM b ASOF LEFT JOIN series n ON b.key = n.key AND b.t < n.t""")  # fmt: skip
def resample_uneven(spark, sf_dir):
    """Each user's values on an even time base, six hours apart."""
    out = align.resampled(series(spark, sf_dir), ["key"], "t", "x", 1.0 / STEP)
    return out.select("key", "i", R("x", 5))


@query("value_quantiles", f"""WITH {_SERIES} SELECT event_type, round(quantile_cont(x, 0.5), 6) AS median_x, round(quantile_cont(x, 0.9), 6) AS p90_x FROM series GROUP BY 1""")
def value_quantiles(spark, sf_dir):
    """Exact median and 90th percentile of each event type, found by counting."""
    s = series(spark, sf_dir)
    half, tenth = (ranks.quantiles(s, ["event_type"], "x", q, name) for q, name in ((0.5, "median_x"), (0.9, "p90_x")))
    both = half.join(tenth.withColumnRenamed("event_type", "of"), F.col("event_type").eqNullSafe(F.col("of"))).drop("of")
    return both.select("event_type", R("median_x"), R("p90_x"))
