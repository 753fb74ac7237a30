"""Evaluation: errors with a right to abstain, risk-coverage, thresholds, ranks and subgroups.

``windows`` has recording_id, subject_id, hr (would-be prediction), gt, valid,
confidence and quality columns; errors count refused windows too.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pulsegrid.functions.stats_np import correlation_p
from pulsegrid.operators.ranks import Ordered, average_ranks, running

USABLE_ERROR_BPM, PASS_COVERAGE, MIN_CAPTURE, MIN_SUBGROUP = 5.0, 0.80, 0.25, 4
THRESHOLDS = tuple(round(0.05 * k, 2) for k in range(16))


def abs_error() -> Column:
    return F.abs(F.col("hr") - F.col("gt"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson r over rows that have both; null where either doesn't vary (``corr`` itself divides by zero there)."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.when(spread > 0, spread)


def guarded_corr(x: str, y: str, on: Column) -> Column:
    """Pearson r of the chosen rows; null under three of them or without variation."""
    a, b = F.when(on, F.col(x)), F.when(on, F.col(y))
    good = (F.count(a) >= 3) & (F.stddev_pop(a) >= 1e-9) & (F.stddev_pop(b) >= 1e-9)
    return F.when(good, correlation(a, b))


def subject_metrics(windows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Per recording: coverage, error of answered and of all windows, correlation, usable.

    A mean error of exactly the limit, and a mean half-way between two roundings, hang on the order in which doubles are added: a recording's windows are
    added one after another in ``order``, which should tell them apart, and not as partial sums of whatever partitions they were read in.
    """
    pair = F.col("valid") & F.col("hr").isNotNull() & F.col("gt").isNotNull()
    out = windows.repartition(*by).sortWithinPartitions(*by, *order).groupBy(*by).agg(
        F.count("*").alias("n_windows"),
        F.count_if("valid").alias("n_valid"),
        F.avg(F.when(pair, abs_error())).alias("mae"),
        F.avg(abs_error()).alias("mae_all"),
        F.sqrt(F.avg(F.when(pair, F.pow(F.col("hr") - F.col("gt"), F.lit(2.0))))).alias("rmse"),
        guarded_corr("hr", "gt", pair).alias("pearson_r"),
        F.avg("quality").alias("mean_quality"),
        *([F.avg("pulse_snr_db").alias("mean_snr_db")] if "pulse_snr_db" in windows.columns else []),
    )
    return out.withColumn("coverage", F.col("n_valid") / F.col("n_windows")).withColumn("usable", F.coalesce(F.col("mae_all") <= USABLE_ERROR_BPM, F.lit(True)))


def _cohort() -> list[Column]:
    return [
        F.count("*").alias("n_subjects"),
        F.sum("n_windows").alias("n_windows"),
        (F.sum("n_valid") / F.nullif(F.sum("n_windows"), F.lit(0))).alias("coverage"),
        F.median("mae_all").alias("median_mae_all"),
        F.max("mae_all").alias("worst_mae_all"),
        F.avg(F.col("usable").cast("double")).alias("usable_rate"),
    ]


def benchmark_metrics(subjects: DataFrame, by: list[str]) -> DataFrame:
    """Across recordings of each group; coverage is pooled, and beside it that within usable ones."""
    within = F.sum(F.when(F.col("usable"), F.col("n_valid"))) / F.nullif(F.sum(F.when(F.col("usable"), F.col("n_windows"))), F.lit(0))
    return subjects.groupBy(*by).agg(*_cohort(), F.median("mae").alias("median_mae"), F.avg("mae").alias("mean_mae"), F.max("mae").alias("worst_mae"), within.alias("coverage_within_usable"))


def subgroup_metrics(subjects: DataFrame, labels: list[str]) -> DataFrame:
    """One row per label and value, all labels in one pass by grouping sets; null labels drop out."""
    text = subjects.withColumns({c: F.col(c).cast("string") for c in labels})
    sets = text.groupingSets([[F.col(c)] for c in labels], *[F.col(c) for c in labels])
    out = sets.agg(*_cohort(), *[F.grouping(c).alias(f"_{c}") for c in labels])
    key = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.lit(c)) for c in labels])
    out = out.select(key.alias("key"), F.coalesce(*labels).alias("value"), *[c for c in out.columns if c not in (*labels, *(f"_{c}" for c in labels))])
    return out.where("value IS NOT NULL").withColumn("underpowered", F.col("n_subjects") < MIN_SUBGROUP)


def go_no_go(metrics: DataFrame, capture: str | None = None) -> DataFrame:
    """Adds each bar's verdict and ``go``: median error of all windows, coverage, and with ``capture`` its column's ratio. What is missing fails."""
    bars = {"go_mae": F.col("median_mae_all") <= USABLE_ERROR_BPM, "go_coverage": F.col("coverage") >= PASS_COVERAGE}
    if capture:
        bars["go_capture"] = F.col(capture) >= MIN_CAPTURE
    out = metrics.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in bars.items()})
    return out.withColumn("go", reduce(lambda x, y: x & y, [F.col(k) for k in bars]))


def risk_coverage(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Adds rank, n, coverage and risk (mean error so far) along an order of (conf, err) rows, in millionths added exactly."""
    exact = rows.withColumn("_err", F.col("err").cast("decimal(28,6)"))
    out = running(exact, by, order, {"_total": "_err"})
    # the same sum without the row itself: the risk one rank before
    before = (F.col("_total") - F.coalesce("_err", F.lit(0))).cast("double") / F.nullif(F.col("rank") - 1, F.lit(0))
    out = out.withColumn("coverage", F.col("rank") / F.col("n")).withColumn("risk", F.col("_total").cast("double") / F.col("rank")).withColumn("risk_before", before)
    return out.drop("_err", "_total")


def aurc(rows: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Area under risk-coverage by the trapezoid rule."""
    strip = (F.col("risk") + F.col("risk_before")) / 2 / F.col("n")
    return risk_coverage(rows, by, order).groupBy(*by).agg(F.sum(strip).alias(name))


@F.pandas_udf(DoubleType())
def _p(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(correlation_p(rho.to_numpy(float), n.to_numpy())).astype(object).where(lambda p: p.notna(), None)


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with averaged ties, n, and the two-sided p-value by the t distribution, from one row a group; null under three rows."""
    out = rows
    for c in (x, y):
        ranks = average_ranks(rows, by, c, {}).select(*by, c, F.col("average_rank").alias(f"rank_{c}")).drop("ties")
        same = reduce(lambda a, b: a & b, [out[k].eqNullSafe(ranks[k]) for k in [*by, c]])
        out = out.join(ranks, same).select(*[out[k] for k in out.columns], ranks[f"rank_{c}"])
    agg = out.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, correlation(F.col(f"rank_{x}"), F.col(f"rank_{y}"))).alias("rho"))
    return agg.withColumn("p_value", _p("rho", "n"))


def deciles(rows: DataFrame, by: list[str], order: list[Column], parts: int = 10) -> DataFrame:
    """Equal parts by confidence, worst first, larger parts first."""
    whole, more = F.floor(F.col("n") / parts), F.col("n") % parts
    early = more * (whole + 1)
    decile = F.when(F.col("rank") <= early, F.ceil(F.col("rank") / (whole + 1))).otherwise(more + F.ceil((F.col("rank") - early) / F.greatest(whole, F.lit(1))))
    cut = running(rows, by, order, {}).withColumn("decile", decile.cast("int")).drop("n")
    return cut.groupBy(*by, "decile").agg(F.avg("conf").alias("conf_mean"), F.avg("err").alias("mae"), F.count("*").alias("n"))


def kept_and_abstained(rows: DataFrame, by: list[str]) -> DataFrame:
    out = rows.groupBy(*by).agg(
        F.avg((~F.col("valid")).cast("double")).alias("abstain_rate"),
        F.avg(F.when(F.col("valid"), F.col("err"))).alias("mae_kept"),
        F.avg(F.when(~F.col("valid"), F.col("err"))).alias("mae_abstained"),
    )
    return out.withColumn("discards_usable", F.coalesce(F.col("mae_abstained") <= F.col("mae_kept"), F.lit(False)))


def threshold_sweep(rows: DataFrame, grid=THRESHOLDS, least: int = 0) -> DataFrame:
    """Coverage and errors at each abstain threshold that some row reaches, and whether at least ``least`` rows stand behind it.

    Rows fold to their distinct errors with a count for each threshold; exact
    percentiles come from running sums of those counts.
    """
    per = rows.groupBy("err").agg(*[F.count_if(F.col("conf") >= t).alias(f"k{i}") for i, t in enumerate(grid)], F.count("*").alias("rows"))
    along = running(per.where("err IS NOT NULL"), [], [F.col("err")], {f"s{i}": f"k{i}" for i in range(len(grid))})
    total = per.agg(*[F.sum(f"k{i}").alias(f"n{i}") for i in range(len(grid))], *[F.sum(F.when(F.col("err").isNotNull(), F.col(f"k{i}"))).alias(f"e{i}") for i in range(len(grid))], F.sum("rows").alias("total"))
    along = along.join(F.broadcast(total))  # one row
    cells = []
    for i in range(len(grid)):
        k, s, n = F.col(f"k{i}"), F.col(f"s{i}"), F.col(f"e{i}")
        place = 0.9 * (n - 1)
        at = lambda r, k=k, s=s: F.max(F.when((k > 0) & (s - k <= r) & (r < s), F.col("err")))
        lo, hi = at(F.floor(place)), at(F.ceil(place))
        p90 = lo + (hi - lo) * F.max(place - F.floor(place))
        cells.append(F.struct(F.lit(float(grid[i])).alias("threshold"), F.max(f"n{i}").alias("n"), (F.max(f"n{i}") / F.max("total")).alias("coverage"), (F.sum(k * F.col("err")) / F.max(n)).alias("mae"), p90.alias("p90"), F.max(F.when(k > 0, F.col("err"))).alias("max_error")))
    out = along.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*").where("n > 0")
    return out.withColumn("supported", F.col("n") >= least)


def recommended_threshold(rows: DataFrame, bad: float = USABLE_ERROR_BPM, margin: float = 0.04) -> DataFrame:
    """The highest confidence of a bad window plus a margin, and the coverage it leaves."""
    top = rows.agg(F.count("*").alias("n_windows"), F.count_if(F.col("err") > bad).alias("n_bad"), F.max(F.when(F.col("err") > bad, F.col("conf"))).alias("worst_bad_confidence"))
    top = top.withColumn("recommended", F.col("worst_bad_confidence") + margin)
    return rows.join(F.broadcast(top)).groupBy("n_windows", "n_bad", "worst_bad_confidence", "recommended").agg(F.avg((F.col("conf") >= F.col("recommended")).cast("double")).alias("coverage_at_recommended"))


def auroc(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Rank-sum AUROC with averaged ties; null with one class only."""
    use = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    hit = F.col(label) == 1
    per = average_ranks(use, by, score, {"pos": hit.cast("int"), "neg": (F.col(label) == 0).cast("int")})
    agg = per.groupBy(*by).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * F.col("average_rank")).alias("ranks"))
    area = (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2.0) / F.nullif(F.col("pos") * F.col("neg"), F.lit(0))
    return agg.withColumn("auroc", F.when((F.col("pos") > 0) & (F.col("neg") > 0), area)).drop("ranks")


def rising_edges(rows: DataFrame, by: list[str], order: str, above: Column) -> DataFrame:
    """Rows where a condition begins to hold."""
    before = F.lag("above").over(W.partitionBy(*by).orderBy(order))
    return rows.withColumn("above", above).withColumn("was", before).where("above AND NOT was").drop("above", "was")


def _runs(detected: DataFrame, truth: DataFrame, tolerance: float) -> DataFrame:
    """All events (key, t, truth or not), with the start of their run: a run ends where the next event of the key is further than the tolerance."""
    side = lambda rows, of: rows.select("key", F.col("t").cast("double").alias("t"), F.lit(of).alias("truth")).where("t IS NOT NULL")
    both = side(detected, False).unionByName(side(truth, True)).withColumn("tie", F.col("truth").cast("int"))
    apart = F.col("was").isNull() | (F.col("t") - F.col("was") > tolerance)
    return Ordered(both, ["key"], ["t", "tie"]).before("was", F.col("t"), own=False).before("run", F.when(apart, F.col("t"))).done().select("key", "run", "t", "truth")


def matched(times: list[float], truths: list[float], tolerance: float) -> int:
    """Greedy one-to-one matches of two sorted lists: each time takes the nearest truth left, the earlier of two as near, if within the tolerance."""
    hits, left, ahead = 0, [], 0
    for x in times:
        while ahead < len(truths) and truths[ahead] <= x + tolerance:
            left.append(truths[ahead])
            ahead += 1
        drop = 0
        while drop < len(left) and left[drop] < x - tolerance:
            drop += 1
        del left[:drop]  # later times are further still
        near = [k for k, t in enumerate(left) if abs(t - x) <= tolerance]
        if near:
            del left[min(near, key=lambda k: abs(left[k] - x))]
            hits += 1
    return hits


def match_events(detected: DataFrame, truth: DataFrame, tolerance: float) -> DataFrame:
    """Greedy one-to-one matching per key (columns key, t): detections in order take their nearest unused truth, if near enough.

    Events further apart than the tolerance never meet, so a key's events fall into runs, and a long recording spreads over tasks.
    A task goes through its runs in order; a detection looks only at truths within the tolerance. Null keys are a key, events without a time don't count.
    """

    def run(batches):
        held, now = ([], []), None
        for batch in batches:
            out = []
            for key, start, t, true in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (key, start):
                    if now is not None:
                        out.append((now[0], matched(*held, tolerance)))
                    held, now = ([], []), (key, start)
                held[true].append(t)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], batch.schema.field(0).type), pa.array([n for _, n in out], pa.int64())], ["key", "hits"])
            kind = batch.schema.field(0).type
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([matched(*held, tolerance)], pa.int64())], ["key", "hits"])

    rows = _runs(detected, truth, tolerance).repartition("key", "run").sortWithinPartitions("key", "run", "t")
    hits = rows.select("key", "run", "t", "truth").mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, hits long")
    count = lambda side, found, wanted: side.groupBy("key").agg(F.count("t").alias(found)).withColumn(wanted, F.lit(0).cast("long"))
    sizes = count(detected, "n_detected", "n_truth").unionByName(count(truth, "n_truth", "n_detected")).withColumn("tp", F.lit(0).cast("long"))
    each = sizes.unionByName(hits.select("key", F.lit(0).cast("long").alias("n_detected"), F.lit(0).cast("long").alias("n_truth"), F.col("hits").alias("tp")))
    return each.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n_detected", "n_truth", "tp")])


def f1(matches: DataFrame) -> DataFrame:
    """Precision, recall and F1; 0 where nothing fired or nothing was there."""
    p = F.when(F.col("n_detected") > 0, F.col("tp") / F.nullif(F.col("n_detected"), F.lit(0))).otherwise(F.lit(0.0))
    r = F.when(F.col("n_truth") > 0, F.col("tp") / F.nullif(F.col("n_truth"), F.lit(0))).otherwise(F.lit(0.0))
    out = matches.withColumn("precision", p).withColumn("recall", r)
    total = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(total, F.lit(0.0))).otherwise(F.lit(0.0)))


def capture_ratio(rows: DataFrame, by: list[str], order: list[Column], best: list[Column]) -> DataFrame:
    """How much of the way from random to perfect ordering a confidence goes, within [-1, 1].

    Under random order every prefix has the mean error in expectation, so its
    area needs no permutations: mean * (1 - 1 / n). Null under ten rows or where
    nothing separates random from perfect.
    """
    n = rows.groupBy(*by).agg(F.count("*").alias("n"), (F.avg("err") * (1 - 1 / F.count("*"))).alias("aurc_random"))
    out = n.join(aurc(rows, by, order, "aurc"), by).join(aurc(rows, by, best, "aurc_oracle"), by)
    span = F.col("aurc_random") - F.col("aurc_oracle")
    ratio = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("aurc_random") - F.col("aurc")) / F.nullif(span, F.lit(0.0))))
    return out.withColumn("capture_ratio", F.when((F.col("n") >= 10) & (span > 1e-12), ratio))


def risk_at_coverage(rows: DataFrame, by: list[str], order: list[Column], steps: int = 10) -> DataFrame:
    """Risk at 10, 20, ... 100 % coverage, at the rank nearest to each (halves to even)."""
    at = F.explode(F.sequence(F.lit(1), F.lit(steps)))
    n = rows.groupBy(*by).agg(F.count("*").alias("n")).withColumn("step", at)
    want = n.select(*by, "step", F.greatest(F.bround(F.col("step") * F.col("n") / F.lit(float(steps))), F.lit(1.0)).cast("long").alias("rank"))
    return risk_coverage(rows, by, order).drop("n").join(want, [*by, "rank"]).select(*by, "step", "rank", "risk")


def baseline_ablation(rows: DataFrame, subject: str, raw: str, relative: str, label: str) -> DataFrame:
    """AUROC pooled raw, pooled against personal baselines, and within subjects; the share of the gap that baselines close."""
    a = auroc(rows, [], raw, label).select(F.col("auroc").alias("auroc_raw"), F.col("pos").alias("n_task"), F.col("neg").alias("n_rest"))
    b = auroc(rows, [], relative, label).select(F.when(F.col("pos") + F.col("neg") >= 10, F.col("auroc")).alias("auroc_baselined"))
    c = auroc(rows, [subject], raw, label).agg(F.count("*").alias("n_subjects"), F.avg("auroc").alias("auroc_within"))
    out = a.join(F.broadcast(b)).join(F.broadcast(c))  # one row each
    out = out.withColumn("delta", F.col("auroc_baselined") - F.col("auroc_raw"))
    gap = F.col("auroc_within") - F.col("auroc_raw")
    return out.withColumn("gap_recovered", F.when(gap > 1e-9, F.col("delta") / F.nullif(gap, F.lit(0.0))))


def negative_pearson(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """1 - r of two traces per group, the loss of waveform training; 1 where either doesn't vary."""
    flat = (F.stddev_pop(x) < 1e-9) | (F.stddev_pop(y) < 1e-9)
    return rows.groupBy(*by).agg(F.when(flat, F.lit(1.0)).otherwise(1 - correlation(F.col(x), F.col(y))).alias("loss"))


def exact_split(subjects: DataFrame, key: str, share: float, seed: str = "split") -> DataFrame:
    """``part`` of each subject: the ``share`` with the least hashes (one at least) are test, the others train; deterministic."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    ranked = running(subjects.select(key).distinct().withColumn("_h", h), [], [F.col("_h"), F.col(key)], {})
    test = F.col("rank") <= F.greatest(F.lit(1), F.round(F.col("n") * share))
    return ranked.select(key, F.when(test, "test").otherwise("train").alias("part"))


def table_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One ``line`` of fixed-width text a row, after a heading with ``n_windows`` and ``coverage`` never left out; nulls show as a dash."""
    wanted = [*columns, *[c for c in ("n_windows", "coverage") if c in rows.columns and c not in columns]]
    kinds = dict(rows.dtypes)
    cell = lambda c: F.rpad(F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c))) if kinds[c] == "double" else F.col(c).cast("string"), F.lit("-")), 14, " ")
    head = rows.sparkSession.createDataFrame([("".join(c[:13].ljust(14) for c in wanted).rstrip(),)], "line string")
    return head.unionByName(rows.select(F.rtrim(F.concat(*[cell(c) for c in wanted])).alias("line")))
