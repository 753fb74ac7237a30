"""Ranks and running sums along an order, without a task that holds a whole group.

Rows are dealt by ranges of the order and staged, so that a row's range is fixed.
Each range is summed, a window over those few sums gives a range its offsets, and
a window inside each range finishes ranks and sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.staging import staged


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds rank (from 1), n (rows of the group), and for each name: column of ``sums`` the sum up to and including the row.

    ``order`` should tell rows apart; null keys are a group of their own.
    """
    placed = staged(rows.repartitionByRange(*[F.col(k) for k in by], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    keys = [*by, "_range"]
    per = placed.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()])
    ahead, whole = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by)
    before = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_ahead{c}")
    per = per.select(*keys, F.sum("_n").over(whole).alias("n"), before("_n"), *[before(f"_sum_{name}") for name in sums])
    inside = W.partitionBy(*keys).orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    ranked = placed.withColumns({"rank": F.row_number().over(inside).cast("long")} | {name: F.coalesce(F.sum(c).over(upto), F.lit(0)) for name, c in sums.items()})
    out = ranked.join(per, _same(ranked, per, keys))
    return out.select(*[ranked[c] for c in rows.columns], (ranked["rank"] + per["_ahead_n"]).alias("rank"), per["n"], *[(ranked[name] + per[f"_ahead_sum_{name}"]).alias(name) for name in sums])


def average_ranks(rows: DataFrame, by: list[str], value: str, counts: dict[str, Column]) -> DataFrame:
    """(by, value, the counts' sums, average rank) of each distinct value: ties share their mean rank."""
    per = rows.groupBy(*by, value).agg(F.count("*").alias("ties"), *[F.sum(c).alias(k) for k, c in counts.items()])
    out = running(per, by, [F.col(value)], {"upto": "ties"})
    return out.withColumn("average_rank", F.col("upto") - (F.col("ties") - 1) / F.lit(2.0)).drop("rank", "n", "upto")


class Ordered:
    """Rows dealt by ranges of an order, once, for several looks along it: each range answers for its own rows and takes the rest from the borders before or after it."""

    def __init__(self, rows: DataFrame, by: list[str], order: list[str]):
        self.by, self.order, self.columns = by, order, rows.columns
        self.rows = staged(rows.repartitionByRange(*[F.col(c) for c in [*by, *order]]).withColumn("_range", F.spark_partition_id()), "ordered")

    def _look(self, name: str, seen: Column, after: bool, own: bool) -> None:
        keys = [*self.by, "_range"]
        rows = self.rows.withColumn("_seen", seen)
        inside, along = W.partitionBy(*keys).orderBy(*self.order), W.partitionBy(*self.by).orderBy("_range")
        start = 0 if own else 1
        pick, best = (F.first, F.min_by) if after else (F.last, F.max_by)
        near = pick("_seen", ignorenulls=True).over(inside.rowsBetween(start, W.unboundedFollowing) if after else inside.rowsBetween(W.unboundedPreceding, -start))
        edge = rows.groupBy(*keys).agg(best("_seen", F.when(F.col("_seen").isNotNull(), F.struct(*self.order))).alias("_edge"))
        beyond = along.rowsBetween(1, W.unboundedFollowing) if after else along.rowsBetween(W.unboundedPreceding, -1)
        edge = edge.select(*keys, pick("_edge", ignorenulls=True).over(beyond).alias("_edge"))
        rows = rows.withColumn(name, near)
        self.rows = rows.join(edge, _same(rows, edge, keys)).select(*[rows[c] for c in self.rows.columns], F.coalesce(rows[name], edge["_edge"]).alias(name))

    def before(self, name: str, seen: Column, own: bool = True) -> Ordered:
        """Adds ``name``: the last ``seen`` that isn't null of the rows up to this one, which counts itself if ``own``."""
        self._look(name, seen, False, own)
        return self

    def after(self, name: str, seen: Column, own: bool = False) -> Ordered:
        """Adds ``name``: the first ``seen`` that isn't null from this row on, itself left out unless ``own``."""
        self._look(name, seen, True, own)
        return self

    def done(self) -> DataFrame:
        return self.rows.drop("_range")


#: Values that one task sorts to find the middle one.
FEW = 4096
#: Ranges that a round of the search cuts its range into.
CUTS = 4096


def quantiles(rows: DataFrame, by: list[str], value: str, q: float = 0.5, name: str = "quantile") -> DataFrame:
    """(by, name): the exact quantile of each group, between neighbours as ``percentile`` has it; null without values. Null keys are a group.

    Every round counts a group's values by ranges and keeps the range that holds the rank sought: first by sign and power of two, then by ``CUTS``
    equal parts. Counts fold before their shuffle. Once a range has few values or one, it is sorted; so no task holds a group.
    NaN counts as the largest value.
    """
    x = F.col(value).cast("double")
    rows = rows.select(*by, x.alias("_x"))
    sign = F.when(F.isnan("_x"), F.lit(5000.0)).when(F.col("_x") == 0, F.lit(0.0)).otherwise(F.signum("_x") * (2000 + F.floor(F.log2(F.abs(F.col("_x"))))))
    goal = rows.groupBy(*by).agg(F.count("_x").alias("_n"))
    at = (F.col("_n") - 1) * F.lit(float(q))
    goal = goal.select(*by, F.floor(at).alias("_rank"), (at - F.floor(at)).alias("_part"), F.lit(None).cast("double").alias("_low"), F.lit(None).cast("double").alias("_high"), F.lit(None).cast("double").alias("_next"), "_n")
    goal, bins = staged(goal, "goal"), sign
    while True:
        wide = (F.col("_n") > FEW) & (F.col("_low").isNull() | (F.col("_low") < F.col("_high")))
        if not goal.where(wide).limit(1).count():
            break
        todo = goal.where(wide)
        mine = rows.join(todo, _same(rows, todo, by) if by else F.lit(True)).where("_x IS NOT NULL AND (_low IS NULL OR _x BETWEEN _low AND _high)").select(*[todo[c] for c in todo.columns], "_x", bins.alias("_bin"))
        per = mine.groupBy(*by, "_rank", "_part", "_next", "_bin").agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
        order = W.partitionBy(*by).orderBy("_bin")
        per = per.withColumns({"_ahead": F.sum("_n").over(order) - F.col("_n"), "_least": F.lead("_low").over(order)})
        found = per.where((F.col("_ahead") <= F.col("_rank")) & (F.col("_rank") < F.col("_ahead") + F.col("_n")))
        ends = F.when(F.col("_rank") + 1 == F.col("_ahead") + F.col("_n"), F.col("_least"))  # the neighbour above is the next range's least
        found = found.select(*by, (F.col("_rank") - F.col("_ahead")).alias("_rank"), "_part", "_low", "_high", F.coalesce("_next", ends).alias("_next"), "_n")
        goal = staged(goal.where(~wide | wide.isNull()).unionByName(found), "goal")
        span = F.col("_high") / 2 - F.col("_low") / 2
        bins = F.floor(F.least((F.col("_x") / 2 - F.col("_low") / 2) / span, F.lit(1.0)) * CUTS).cast("double")
    few = goal.where((F.col("_n") <= FEW) & (F.col("_low").isNull() | (F.col("_low") < F.col("_high"))))
    mine = rows.join(few, _same(rows, few, by) if by else F.lit(True)).where("_x IS NOT NULL AND (_low IS NULL OR _x BETWEEN _low AND _high)").select(*[few[c] for c in few.columns], "_x")
    sorted_ = mine.groupBy(*by, "_rank", "_part", "_next").agg(F.sort_array(F.collect_list("_x")).alias("_all"))
    rank = F.col("_rank").cast("int")
    small = sorted_.select(*by, "_part", F.get("_all", rank).alias("_a"), F.coalesce("_next", F.get("_all", rank + 1)).alias("_b"))
    flat = goal.where("_low IS NOT NULL AND _low = _high").select(*by, "_part", F.col("_low").alias("_a"), F.coalesce("_next", "_low").alias("_b"))
    none = goal.where("_n = 0").select(*by, "_part", F.lit(None).cast("double").alias("_a"), F.lit(None).cast("double").alias("_b"))
    mixed = F.when(F.col("_part") > 0, (1 - F.col("_part")) * F.col("_a") + F.col("_part") * F.col("_b")).otherwise(F.col("_a"))
    return small.unionByName(flat).unionByName(none).select(*by, mixed.alias(name))
