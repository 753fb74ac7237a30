"""Study store queries: session and study aggregates with coverage beside every number."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import studies
from pulsegrid.plans.catalog import query
from pulsegrid.plans.tables import SAMPLES_SQL, samples, table


@query(
    "study_aggregate",
    f"""
WITH {SAMPLES_SQL},
per AS (
  SELECT c.c_custkey AS session_id, n.n_nationkey AS study_id,
         count(s.event_id) FILTER (WHERE s.reason IS DISTINCT FROM 'calibrating') AS scored,
         count(s.event_id) FILTER (WHERE s.reason IS NULL) AS answered,
         median(s.hr_bpm) AS median_hr
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN samples s ON s.session_id = c.c_custkey
  GROUP BY 1, 2)
SELECT study_id, count(*) AS n_sessions,
       sum(CASE WHEN scored > 0 AND answered >= 0.5 * scored THEN 1 ELSE 0 END)::BIGINT AS n_usable,
       round(sum(CASE WHEN scored > 0 AND answered >= 0.5 * scored THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS usable_rate,
       round(sum(answered)::DOUBLE / greatest(sum(scored), 1)::DOUBLE, 6) AS answered_ratio,
       round(median(median_hr), 6) AS median_hr
FROM per GROUP BY study_id
""",
)
def study_aggregate(spark, sf_dir):
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("study_id"))
    return studies.study_aggregate(sessions, samples(spark, sf_dir))


NOW = 1706659200.0  # 2024-01-31, just past the last event


@query("session_summary", f"""WITH {SAMPLES_SQL} SELECT session_id, count(*) AS n_samples, count(*) FILTER (WHERE reason IS NULL) AS n_answered,
 round(median(hr_bpm), 6) AS median_hr, min(hr_bpm) AS min_hr, max(hr_bpm) AS max_hr, round(avg(confidence), 6) AS mean_confidence,
 round(count(*) FILTER (WHERE reason IS NULL)::DOUBLE / count(*), 6) AS answered_ratio, count(*) FILTER (WHERE reason = 'calibrating') AS n_calibrating
FROM samples GROUP BY 1""")  # fmt: skip
def session_summary(spark, sf_dir):
    s = studies.session_summary(samples(spark, sf_dir))
    r = lambda c: F.round(c, 6).alias(c)
    return s.select("session_id", "n_samples", "n_answered", r("median_hr"), "min_hr", "max_hr", r("mean_confidence"), r("answered_ratio"), F.coalesce(F.col("reasons")["calibrating"], F.lit(0)).alias("n_calibrating"))


@query("reason_histogram", f"WITH {SAMPLES_SQL} SELECT session_id, coalesce(reason, 'answered') AS reason, count(*) AS n FROM samples GROUP BY 1, 2")
def reason_histogram(spark, sf_dir):
    return studies.reason_histogram(samples(spark, sf_dir))


def sessions(spark, sf_dir):
    """Customers as sessions: study = nation, created at their first order, withdrawn where the balance is negative."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("session_id")).agg(F.min(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(1e6)).alias("created_at"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.when(F.col("c_nationkey") > 0, F.col("c_nationkey")).alias("study_id"), F.when(F.col("c_acctbal") < 0, F.lit(1.0)).alias("withdrawn_at"))
    return c.join(first, "session_id", "left")


SESSIONS_SQL = """
sessions AS (SELECT c_custkey AS session_id, CASE WHEN c_nationkey > 0 THEN c_nationkey END AS study_id, CASE WHEN c_acctbal < 0 THEN 1.0 END AS withdrawn_at,
  (SELECT min(epoch_us(o_orderdate)) / 1e6 FROM orders WHERE o_custkey = c_custkey) AS created_at FROM customer)
"""


def order_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("sample_id"), "o_totalprice")


@query("consent_gate", f"""WITH {SESSIONS_SQL} SELECT o_custkey AS session_id, o_orderkey AS sample_id, o_totalprice FROM orders
WHERE o_custkey IN (SELECT session_id FROM sessions WHERE withdrawn_at IS NULL)""")  # fmt: skip
def consent_gate(spark, sf_dir):
    return studies.consent_gate(order_rows(spark, sf_dir), sessions(spark, sf_dir))


@query("withdraw_erase", f"""WITH {SESSIONS_SQL} SELECT o_custkey AS session_id, o_orderkey AS sample_id, o_totalprice FROM orders
WHERE o_custkey NOT IN (SELECT session_id FROM sessions WHERE withdrawn_at IS NOT NULL)""")  # fmt: skip
def withdraw_erase(spark, sf_dir):
    return studies.erase(order_rows(spark, sf_dir), sessions(spark, sf_dir).where("withdrawn_at IS NOT NULL"))


@query("retention_purge", f"""WITH {SESSIONS_SQL}, x AS (SELECT session_id FROM sessions LEFT JOIN nation ON n_nationkey = study_id
 WHERE created_at < {NOW} - coalesce(CASE WHEN n_nationkey IS NOT NULL THEN 9000 + 30 * n_nationkey END, 9200) * 86400.0)
SELECT o_custkey AS session_id, o_orderkey AS sample_id, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT session_id FROM x)""")  # fmt: skip
def retention_purge(spark, sf_dir):
    study = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("study_id"), (9000 + 30 * F.col("n_nationkey")).alias("retention_days"))
    return studies.retention_purge(order_rows(spark, sf_dir), sessions(spark, sf_dir), study, NOW, 9200)


@query("upsert_latest", """SELECT l_orderkey, l_partkey % 3 AS slot, l_linenumber, l_quantity FROM (
 SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_shipdate DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1""")  # fmt: skip
def upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 3).alias("slot"), "l_linenumber", "l_quantity", "l_shipdate")
    # lines of one date and number tie, which the SQL leaves open: the larger quantity stays, so that reruns agree
    return studies.latest(rows, ["l_orderkey", "slot"], [F.col("l_shipdate").desc(), F.col("l_linenumber").desc(), F.col("l_quantity").desc()]).drop("l_shipdate")


@query("session_export", f"""WITH {SAMPLES_SQL}, s AS (SELECT session_id, count(*) AS n, min(t) AS t0, arg_min(hr_bpm, t) AS first_hr, arg_max(hr_bpm, t) AS last_hr FROM samples GROUP BY 1),
 m AS (SELECT session_id, count(*) AS n FROM samples WHERE reason = 'calibrating' GROUP BY 1)
SELECT c_custkey AS session_id, coalesce(s.n, 0) AS n_samples, s.first_hr, s.last_hr, coalesce(m.n, 0) AS n_marks FROM customer LEFT JOIN s ON s.session_id = c_custkey LEFT JOIN m ON m.session_id = c_custkey""")  # fmt: skip
def session_export(spark, sf_dir):
    s = samples(spark, sf_dir)
    marks = s.where("reason = 'calibrating'").select("session_id", "t", F.col("reason").alias("label"))
    out = studies.session_export(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id")), s, marks)
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return out.select("session_id", size("samples").alias("n_samples"), F.col("samples")[0]["hr_bpm"].alias("first_hr"), F.when(F.col("samples").isNotNull(), F.element_at("samples", -1)["hr_bpm"]).alias("last_hr"), size("marks").alias("n_marks"))


@query("overlay_segments", f"""WITH {SAMPLES_SQL}, g AS (SELECT *, sum((reason IS NOT NULL)::INT) OVER (PARTITION BY session_id ORDER BY t, event_id) AS segment FROM samples)
SELECT session_id, segment::BIGINT AS segment, round(min(t), 6) AS t0, round(max(t), 6) AS t1, count(*) AS n, min(hr_bpm) AS low, max(hr_bpm) AS high FROM g WHERE reason IS NULL GROUP BY 1, 2""")  # fmt: skip
def overlay_segments(spark, sf_dir):
    s = studies.overlay_segments(samples(spark, sf_dir))
    return s.select("session_id", "segment", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"), "n", "low", "high")


@query("study_sessions", f"""WITH {SESSIONS_SQL} SELECT session_id, coalesce(study_id, -1)::BIGINT AS study_id, row_number() OVER (PARTITION BY study_id ORDER BY created_at DESC NULLS LAST, session_id) AS position
FROM sessions WHERE withdrawn_at IS NULL""")  # fmt: skip
def study_sessions(spark, sf_dir):
    return studies.study_sessions(sessions(spark, sf_dir)).select("session_id", F.coalesce("study_id", F.lit(-1)).cast("long").alias("study_id"), F.col("position").cast("long").alias("position"))


@query("overlay_usable", f"""WITH {SAMPLES_SQL}, sc AS (SELECT session_id, count(*) FILTER (WHERE reason IS DISTINCT FROM 'calibrating') AS scored, count(*) FILTER (WHERE reason IS NULL) AS answered FROM samples GROUP BY 1),
p AS (SELECT c_nationkey AS study_id, session_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, session_id) AS position FROM sc JOIN customer ON c_custkey = session_id WHERE scored > 0 AND answered >= 0.5 * scored QUALIFY position <= 12),
g AS (SELECT s.*, sum((reason IS NOT NULL)::INT) OVER (PARTITION BY s.session_id ORDER BY t, event_id) AS segment FROM samples s WHERE s.session_id IN (SELECT session_id FROM p))
SELECT p.study_id, p.session_id, p.position::INT AS position, segment::BIGINT AS segment, min(t) AS t0, max(t) AS t1, count(*) AS n, min(hr_bpm) AS low, max(hr_bpm) AS high FROM g JOIN p USING (session_id) WHERE reason IS NULL GROUP BY 1, 2, 3, 4""")  # fmt: skip
def overlay_usable(spark, sf_dir):
    """Lines of each study's first twelve usable sessions."""
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").alias("study_id"), F.col("c_acctbal").alias("created_at"))
    return studies.overlay_usable(sessions, samples(spark, sf_dir)).select("study_id", "session_id", "position", "segment", "t0", "t1", "n", "low", "high")


@query("export_rows", f"""WITH {SAMPLES_SQL}, o AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t, hr_bpm, confidence, reason NULLS FIRST) - 1 AS position, t, hr_bpm, confidence, reason FROM samples)
SELECT session_id, position::INT AS position, t, hr_bpm, confidence, reason FROM o""")  # fmt: skip
def export_rows(spark, sf_dir):
    """Every sample of every session's export, at its place."""
    all_samples = samples(spark, sf_dir)
    marks = all_samples.where("reason = 'calibrating'").select("session_id", "t", F.col("reason").alias("label"))
    out = studies.session_export(all_samples.select("session_id").distinct(), all_samples, marks)
    return out.select("session_id", F.posexplode("samples").alias("position", "s")).select("session_id", "position", "s.t", "s.hr_bpm", "s.confidence", "s.reason")
