"""Rows that tie in a query's order don't depend on how they arrive."""

from pulsegrid.plans import catalog
from pulsegrid.plans.evaluation_queries import R


def test_upsert_of_tied_lines_is_the_same_in_any_order(spark, tmp_path):
    day = "timestamp'1998-01-02 00:00:00'"
    rows = [(7, p, 3, float(q)) for p in (3, 6, 9) for q in range(1, 8)] + [(8, 4, 1, 5.0)]
    got = []
    for k, ordered in enumerate((rows, rows[::-1])):
        at = str(tmp_path / str(k))
        spark.createDataFrame(ordered, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").coalesce(1).selectExpr("*", f"{day} AS l_shipdate").write.parquet(f"{at}/lineitem.parquet")
        got.append(sorted(tuple(r) for r in catalog.queries()["upsert_latest"](spark, at).select("l_orderkey", "slot", "l_linenumber", "l_quantity").collect()))
    assert got[0] == got[1] == [(7, 0, 3, 7.0), (8, 1, 1, 5.0)]


def test_mean_error_at_the_limit_is_the_same_for_any_files(spark, tmp_path):
    """Errors of 8.8, 5.6, 6.8, 1.8, 0.6 and 6.4 bpm: 5.0 added in order, 5.000000000000001 added backwards or as two sums."""
    ks = [8, 84, 5, 48, 26, 65]
    rows = [(i, 14, "view", 0.0, '{"k": %d}' % k) for i, k in enumerate(ks)]
    for name, files in (("whole", [rows]), ("backwards", [rows[::-1]]), ("two", [rows[::2], rows[1::2]])):
        at = str(tmp_path / name)
        for part in files:
            df = spark.createDataFrame(part, "event_id long, user_id long, event_type string, value double, props string").coalesce(1)
            df.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id) AS ts").write.mode("append").parquet(f"{at}/events.parquet")
        (metrics,) = catalog.queries()["subject_metrics"](spark, at).collect()
        assert (metrics.mae_all, metrics.usable) == (5.0, True), name
        (cells,) = catalog.queries()["readiness_confusion"](spark, at).collect()
        assert tuple(cells) == (0, 0, 0, 1, 0), name  # little skin, but usable


def test_means_half_way_between_roundings_round_as_in_the_sql(spark):
    import duckdb

    values = [0.5040625, -0.5040625, 2.5e-6, 1.0000005, 4.1179215, 1e303, float("inf"), None]
    got = [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", R("x")).orderBy("i").collect()]
    assert got == [duckdb.sql(f"SELECT round({'NULL' if v is None else repr(str(v))}::DOUBLE, 6)").fetchall()[0][0] for v in values]
