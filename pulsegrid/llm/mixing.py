"""Mixing sources to target weights. DataFrame operations only.

Every row draws a hash-random key; rows are ordered by it within their source.
The order is cut into key ranges (leading hex digits of the key), words are
summed per (source, range), a window over those few sums gives each range its
offset, and a window inside each range finishes the prefix sum. No task holds a
source: the number of ranges follows the row count. A source takes its whole
epochs first and then the prefix of its order that exhausts the budget exactly,
so the last row may be taken in part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import WORD, every, staged, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Rows of one source that a key range holds on average.
RANGE_ROWS = 20_000
SEED = "mix-1"
#: Hex digits of the key that name a range at most: 16 million ranges a source; beyond, ranges hold more rows.
MAX_DIGITS = 6


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Per source: ix (order by code point, null last), source, source_size, weight, target.

    Targets are weight * level, held at ``cap`` times the source's size, with the
    level at which they add up to ``share`` of all words: where resharing the
    excess by weight ends. Sources sort by the level at which they fill; with k of
    them full the level follows from two prefix sums, and the k that agrees is taken.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.lit(None).cast("double")
    for i, w in enumerate(weights):
        pick = F.when(F.pmod(F.col("ix") - 1, F.lit(len(weights))) == i, F.lit(float(w))).otherwise(pick)
    per = per.withColumn("ix", F.row_number().over(order).cast("long")).withColumn("weight", pick)
    fill = W.orderBy((F.col("full") / F.col("weight")), "ix")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("full", F.lit(float(cap)) * F.col("source_size"))
    per = per.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(W.partitionBy()))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # in fill order the first source that its own level does not fill fixes the level of all that follow
    per = per.withColumn("open", F.col("weight") * F.col("level") <= F.col("full"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, 0))
    return per.withColumn("at", level).select("ix", "source", "source_size", "weight", F.when(F.col("at").isNull(), F.col("full")).otherwise(F.least(F.col("weight") * F.col("at"), F.col("full"))).alias("target"))


def _prepared(rows: DataFrame, seed: str) -> DataFrame:
    """``rows`` (id, size, source, tie ...) with their hash-random key; rows without an id draw it from their text."""
    rows = rows.withColumns({"src": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})
    return rows.withColumn("key", F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.concat(F.lit("text "), F.col("tie").cast("string"))), F.lit(f":{seed}"))))


def _taken(rows: DataFrame, sizes: DataFrame, weights, share: float, cap: int) -> DataFrame:
    """``rows`` with source_size, target and taken. ``sizes`` holds the same rows without what is carried along."""
    # the number of sources bounds this table; it stays a DataFrame and is joined, not collected
    targets = staged(source_targets(sizes, weights, share, cap), "targets")
    budget = F.floor(F.col("target")).cast("long")
    n = sizes.count()
    digits = max(1, min(MAX_DIGITS, math.ceil(math.log(max(1, n) / RANGE_ROWS, 16)))) if n > RANGE_ROWS else 1
    part, by = F.substring("key", 1, digits), ["src", "none", "part"]
    sums = sizes.groupBy("src", "none", part.alias("part")).agg(F.sum("size").alias("words"))
    ahead = W.partitionBy("src", "none").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("words").over(ahead), F.lit(0).cast("long")))
    targets = targets.select(F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("none"), "source_size", "target", budget.alias("budget"))
    plan = sums.join(targets, ["src", "none"]).drop("words")
    # the join and the prefix sums share one dealing, so rows move once
    placed = rows.withColumn("part", part).join(plan, by)
    inside = W.partitionBy(*by).orderBy("key", F.col("id").asc_nulls_first(), "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("offset") - F.col("ahead")
    placed = placed.withColumn("epochs", epochs)
    return placed.withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest)))


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), word_count(text).alias("size"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("tie"), *more)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, source, mix_key.

    ``size`` is the number of words (null text: 0); ``taken`` counts repeats and
    lies between 0 and ``cap`` * size. A null source is a source of its own and
    sorts last. Ties of the key (repeated ids) fall back on size and a hash of the
    text, so reruns agree; rows that repeat id and text are alike, whichever of them
    the budget cuts. Very long texts count whole. An empty table gives no rows;
    sources without words take none. Other columns are ignored.
    """
    rows = staged(_prepared(_rows(docs, id_col, text_col, source_col), seed), "sizes")
    placed = _taken(rows, rows, weights, share, cap)
    return placed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", F.col("key").alias("mix_key"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row once per epoch taken, cut to its first words where the budget ends inside it.

    Each row carries its own share, also where ids repeat, so the words written
    are those ``mix`` takes. Rows without words weigh nothing in a mix and stay once.
    """
    sizes = staged(_prepared(_rows(docs, id_col, text_col, source_col), seed), "sizes")
    # the whole row travels as one column, so its columns' names can't clash
    rows = _prepared(_rows(docs, id_col, text_col, source_col, F.struct(*[c.alias(f"c{i}") for i, c in enumerate(every(docs))]).alias("row"), F.col(text_col).alias("text")), seed)
    rows = _taken(rows, sizes, weights, share, cap)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int"))
    rows = rows.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), left.cast("int")), " ")
    text = F.when(left < F.col("size"), cut).otherwise(F.col("text"))
    return rows.select(*[(text if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR || ':mix-1') AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS ix FROM s),
w AS (SELECT *, CASE (ix - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS full_size FROM o),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(full_size) OVER f, 0)) /
             ((sum(weight) OVER ()) - coalesce(sum(weight) OVER f, 0)) AS level
      FROM w WINDOW f AS (ORDER BY full_size / weight, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, (SELECT arg_min(b.level, (b.full_size / b.weight, b.ix)) FROM l b WHERE b.weight * b.level <= b.full_size) AS at_level,
             (SELECT min((b.full_size / b.weight, b.ix)) FROM l b WHERE b.weight * b.level <= b.full_size) AS at_pos FROM l),
t AS (SELECT source, source_size, CASE WHEN at_pos IS NULL OR (full_size / weight, ix) < at_pos THEN full_size ELSE least(weight * at_level, full_size) END AS target FROM a),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // greatest(source_size, 1) ELSE 0 END * size
        + greatest(0, least(size, budget - (CASE WHEN source_size > 0 THEN budget // greatest(source_size, 1) ELSE 0 END) * source_size - ahead)))::BIGINT AS taken
FROM r
"""
