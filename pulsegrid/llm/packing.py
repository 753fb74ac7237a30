"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document's ids are cut at multiples of the sequence length; whole pieces fill a
sequence each, and the histogram of the remainders, one count per class of
``CLASS`` neighbouring lengths, is the demand of a cutting-stock problem. A linear program over patterns (how many
remainders of each length share a sequence) starts from one-length patterns;
each round a knapsack by dynamic programming prices the pattern of most dual
value, until none exceeds 1 by more than ``GAP``. Floors of the solution become
sequences, and what rounding leaves is packed first-fit decreasing. The plan has
no more rows than there are lengths times a few, whatever the corpus holds.

Pieces are then ranked within their class by distributed prefix counts; a
class's ranks map to the plan's slots by arithmetic, so a piece learns its
sequence and place there. A window over the few pieces of a sequence turns places
into offsets.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import frugal, lean, staged, table, trim
from pulsegrid.llm.tokens import BYTE_BPE, closed, encoder, public_path
from pulsegrid.llm.wordhash import slices

LENGTH = 1024
END_ID = 0
#: Lengths that share a class; patterns count each as its largest, which costs half a class a piece.
CLASS = 4
#: The program stops when no pattern could improve it by more than this share.
GAP = 0.004
MAX_ROUNDS = 6000
#: Pieces that a rank bucket holds on average over all classes, so that a class with a third of them still parts well.
RANK_ROWS = 2_000
TEXT_BYTES = 2 << 20


def best_pattern(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the counts of ``sizes`` (ascending) with most value within ``room``."""
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        k = fits[c]
        best[c], pick[c] = best[c - 1], -1
        if k:
            v = best[c - sizes[:k]] + values[:k]
            j = int(v.argmax())
            if v[j] > best[c] + 1e-12:
                best[c], pick[c] = v[j], j
    out = np.zeros(len(sizes), np.int64)
    c = room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[room]), out


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, max_rounds: int = MAX_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Basic patterns (rows) and their fractional multiplicities for ``min sum x, patterns' x >= demand``.

    Revised simplex with an explicit inverse; over-supply enters as a column of cost 0.
    """
    m = len(sizes)
    counts = room // sizes
    patterns = np.diag(counts).astype(float)
    inverse, x, cost = np.diag(1.0 / counts), demand / counts, np.ones(m)
    for _ in range(max_rounds):
        y = cost @ inverse
        if y.min() < -1e-9:
            column, price = np.zeros(m), 0.0
            column[int(y.argmin())] = -1
        else:
            value, counts_ = best_pattern(sizes, np.maximum(y, 0), room)
            if value <= 1 + gap:
                break
            column, price = counts_.astype(float), 1.0
        u = inverse @ column
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        r = int(ratio.argmin())
        step = ratio[r]
        if not np.isfinite(step):
            break
        x = np.maximum(x - step * u, 0)
        x[r] = step
        row = inverse[r] / u[r]
        inverse -= np.outer(u, row)
        inverse[r] = row
        patterns[r], cost[r] = column, price
    real = cost > 0
    return patterns[real].astype(np.int64), x[real]


def plan(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, sequences) pairs that hold exactly ``histogram`` (size: pieces), sizes up to ``room``."""
    sizes = np.array(sorted(k for k, n in histogram.items() if n and k < room), np.int64)
    left = np.array([histogram[int(k)] for k in sizes], np.int64)
    out = [({room: 1}, histogram[room])] if histogram.get(room) else []
    if len(sizes):
        patterns, x = solve(sizes, left.astype(float), room)
        for p, times in sorted(zip(patterns, np.floor(x + 1e-6).astype(np.int64), strict=True), key=lambda q: -q[1]):
            has = p > 0
            times = int(min(times, (left[has] // p[has]).min())) if has.any() else 0
            if times > 0:
                left -= times * p
                out.append(({int(s): int(n) for s, n in zip(sizes[has], p[has], strict=True)}, times))
    while left.any() if len(sizes) else False:  # first-fit decreasing over counts; equal sequences fold into one pattern
        free, p = room, np.zeros(len(sizes), np.int64)
        for i in range(len(sizes) - 1, -1, -1):
            if left[i] and sizes[i] <= free:
                p[i] = min(left[i], free // sizes[i])
                free -= int(p[i] * sizes[i])
        has = p > 0
        times = int((left[has] // p[has]).min())
        left -= times * p
        out.append(({int(s): int(n) for s, n in zip(sizes[has], p[has], strict=True)}, times))
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, stop rank, pieces a sequence, first sequence, first place) rows of a plan."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n, at = pattern[length], rank.get(length, 0)
            rows.append((length, at, at + n * times, n, sequence, offset))
            rank[length] = at + n * times
            offset += n
        sequence += times
    return rows


def _cutter(path: str, kind: str, end: int, length: int):
    def run(batches):
        enc = encoder(path, kind)
        for batch in batches:
            for a, b in slices(batch.column(1), TEXT_BYTES):
                piece = batch.slice(a, b - a)
                ids, bounds = closed(*enc.encode(piece.column(1)), end)
                wide = memoryview(ids.astype("<u4")).cast("B")
                total = np.diff(bounds)
                parts = -(-total // length)
                doc = np.repeat(np.arange(len(piece)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * length
                size = np.minimum(length, total[doc] - start)
                lo = 4 * (bounds[doc] + start)
                crc = [zlib.crc32(wide[x:y]) for x, y in zip(lo.tolist(), (lo + 4 * size).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, size, crc, total[doc]))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                trim()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, kind: str = "byte", end: int = END_ID, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and holds the end id alone. Rows that repeat an id pack
    as documents of their own, and so do rows without an id, whose pieces have none. Very long
    texts are encoded whole, in windows, and cut into as many pieces as they need. An empty table
    gives no rows. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    lean(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = staged(rows.mapInArrow(frugal(_cutter(path or public_path(BYTE_BPE), kind, end, length), encodes=True), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / CLASS).cast("long"))
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most length / CLASS rows
    table_ = slots(plan(histogram, -(-length // CLASS)))
    plan_df = spark.createDataFrame(table_, "len long, first long, stop long, per long, sequence long, at long")
    # at most length / CLASS rows, of as many slots as the plan has: its size follows from ``length`` alone
    plan_df = plan_df.groupBy("len").agg(F.sort_array(F.collect_list(F.struct("first", "stop", "per", "sequence", "at"))).alias("slots"))
    buckets = max(1, sum(histogram.values()) // RANK_ROWS)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    counts = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    ahead = W.partitionBy("class").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("class").alias("l"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")).alias("before"))
    inside = W.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(counts, (F.col("class") == F.col("l")) & (F.col("part") == F.col("p"))).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(plan_df), F.col("class") == F.col("len"))
    placed = placed.withColumn("slot", F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["stop"]))[0])
    inner = F.col("rank") - F.col("slot.first")
    placed = placed.withColumn("sequence_id", F.col("slot.sequence") + F.floor(inner / F.col("slot.per"))).withColumn("place", F.col("slot.at") + F.pmod(inner, F.col("slot.per")))
    left = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(left), F.lit(0).cast("long"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))


def op4_pack(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
