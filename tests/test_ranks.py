"""Ranks, running sums and what rests on them, against pandas and plain loops."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import evaluate as ev
from pulsegrid.operators.ranks import average_ranks, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(k, rng.choice(["a", "b", None]), rng.choice([0.1, 0.25, 0.25, 0.5, rng.random()]), round(rng.random() * 9, 3)) for k in range(700)]
    pdf = pd.DataFrame(data, columns=["id", "g", "conf", "err"])
    return pdf, spark.createDataFrame(data, "id long, g string, conf double, err double").repartition(5)


def test_running_ranks_and_sums(rows):
    pdf, df = rows
    got = running(df, ["g"], [F.col("conf").desc(), F.col("id")], {"total": "err"}).toPandas().set_index("id")
    for _, part in pdf.groupby("g", dropna=False):
        part = part.sort_values(["conf", "id"], ascending=[False, True])
        assert got.loc[part.id, "rank"].tolist() == list(range(1, len(part) + 1)) and set(got.loc[part.id, "n"]) == {len(part)}
        assert np.allclose(got.loc[part.id, "total"], part.err.cumsum())


def test_no_window_spans_a_group(rows):
    _, df = rows
    plan = running(df, [], [F.col("conf")], {"total": "err"})._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan
    assert running(df.where("1 = 0"), [], [F.col("conf")], {}).count() == 0


def test_average_ranks_share_ties(rows):
    pdf, df = rows
    got = {r.conf: r.average_rank for r in average_ranks(df, [], "conf", {}).collect()}
    want = dict(zip(pdf.conf, pdf.conf.rank(), strict=True))
    assert got == want


def test_spearman_with_a_p_value(rows):
    pdf, df = rows
    got = {r.g: r for r in ev.spearman(df, ["g"], "conf", "err").collect()}
    for g, part in pdf.groupby("g", dropna=False):
        rho = np.corrcoef(part.conf.rank(), part.err.rank())[0, 1]
        r = got[None if g is np.nan or g != g else g]
        assert r.n == len(part) and abs(r.rho - rho) < 1e-9
        v = len(part) - 2
        angle = np.linspace(math.asin(abs(rho)), math.pi / 2, 100_001)  # the t distribution's tail: its density is a power of the cosine
        whole = np.linspace(0, math.pi / 2, 100_001)
        assert abs(r.p_value - np.trapezoid(np.cos(angle) ** (v - 1), angle) / np.trapezoid(np.cos(whole) ** (v - 1), whole)) < 1e-6


def test_risk_coverage_and_area(rows):
    pdf, df = rows
    order = [F.col("conf").desc(), F.col("id")]
    got = ev.risk_coverage(df, [], order).orderBy("rank").toPandas()
    part = pdf.sort_values(["conf", "id"], ascending=[False, True])
    risk = part.err.expanding().mean().to_numpy()
    assert got.id.tolist() == part.id.tolist() and np.allclose(got.risk, risk)
    assert abs(ev.aurc(df, [], order, "area").first().area - np.trapezoid(risk, np.arange(1, len(risk) + 1) / len(risk))) < 1e-9


def test_deciles_match_ntile(rows):
    pdf, df = rows
    for k in (3, 7, 12):
        some = df.where(F.col("id") < k)
        sizes = [r.n for r in ev.deciles(some, [], [F.col("conf"), F.col("id")]).orderBy("decile").collect()]
        assert sizes == [len(x) for x in np.array_split(np.arange(k), 10) if len(x)]


def test_threshold_sweep_is_exact(rows):
    pdf, df = rows
    got = ev.threshold_sweep(df, least=300).orderBy("threshold").collect()
    for r in got:
        err = pdf.err[pdf.conf >= r.threshold]
        assert (r.n, r.supported) == (len(err), len(err) >= 300) and abs(r.coverage - len(err) / len(pdf)) < 1e-12
        assert abs(r.mae - err.mean()) < 1e-9 and abs(r.p90 - np.percentile(err, 90)) < 1e-9 and r.max_error == err.max()
    assert len(got) == sum((pdf.conf >= t).any() for t in ev.THRESHOLDS)


def test_auroc_counts_pairs(spark):
    rng = random.Random(1)
    data = [(rng.randint(0, 9), rng.choice([0, 1, None])) for _ in range(90)]
    df = spark.createDataFrame(data, "s int, y int")
    pos, neg = ([s for s, y in data if y == v] for v in (1, 0))
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert abs(ev.auroc(df, [], "s", "y").first().auroc - want) < 1e-9
    assert ev.auroc(df.where("y = 1"), [], "s", "y").first().auroc is None


def test_bars_name_what_fails(spark):
    m = spark.createDataFrame([("a", 1.0, 0.9, 0.5), ("b", 9.0, 0.9, 0.5), ("c", 1.0, 0.9, 0.1), ("d", None, 0.9, 0.5)], "method string, median_mae_all double, coverage double, capture double")
    got = {r.method: (r.go_mae, r.go_coverage, r.go_capture, r.go) for r in ev.go_no_go(m, "capture").collect()}
    assert got == {"a": (True, True, True, True), "b": (False, True, True, False), "c": (True, True, False, False), "d": (False, True, True, False)}


def test_split_has_its_share(spark):
    df = spark.range(41).toDF("subject").union(spark.range(5).toDF("subject"))
    got = ev.exact_split(df, "subject", 0.2).collect()
    assert len(got) == 41 and sum(r.part == "test" for r in got) == 8
    assert {(r.subject, r.part) for r in got} == {(r.subject, r.part) for r in ev.exact_split(df.repartition(3), "subject", 0.2).collect()}
    assert ev.exact_split(df.limit(1), "subject", 0.2).first().part == "test"


def test_negative_pearson(spark):
    df = spark.createDataFrame([("x", float(k), 2.0 * k) for k in range(9)] + [("y", float(k), 1.0) for k in range(9)], "g string, a double, b double")
    got = {r.g: r.loss for r in ev.negative_pearson(df, ["g"], "a", "b").collect()}
    assert abs(got["x"]) < 1e-9 and got["y"] == 1.0


def test_text_table_shows_coverage(spark):
    df = spark.createDataFrame([("pos", 1.25, 0.5, 8), ("green", None, 0.25, 8)], "method string, mae double, coverage double, n_windows int")
    lines = [r.line for r in ev.table_text(df, ["method", "mae"]).collect()]
    assert lines[0].split() == ["method", "mae", "n_windows", "coverage"] and lines[1].split() == ["pos", "1.250", "8", "0.500"] and "-" in lines[2]
