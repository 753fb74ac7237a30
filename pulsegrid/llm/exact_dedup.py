"""Exact duplicates through an extendible-hash index kept in shared files. DataFrame operations only.

1. *Directory.* Distinct hashes of texts are counted by their top ``G`` bits and
   summed up the binary tree of prefixes. A bucket of depth d holds the prefixes
   whose count at d fits ``capacity`` while the count at d-1 did not: what
   directory doubling reaches when it splits each overfull bucket. A slot per
   ``G``-bit prefix, at most 2**MAX_DEPTH, bounds its broadcast; a bucket that is
   overfull at that depth stays one and has more entries.
2. *Owners.* A row's slot names its bucket and texts move once, to the task that
   owns the bucket, a range of hashes. Texts of which there are very many copies
   (at least one row in ``HOT``) fold before they move, so no bucket receives them whole.
3. *Chains.* The owner groups its rows by (hash, text), which compares bytes.
   Texts that collide are numbered in the hash's chain. It writes the index:
   bucket, hash, chain, digest, survivor, rows.
4. *Probe.* A row goes to its slot's bucket, there along the chain of its hash to
   the entry of its digest, and learns the survivor. Texts don't move again; copies
   fold first, and adaptive execution splits a hot entry.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import every, fresh, staged

#: Most bits of the directory: 2**20 slots of three longs, 24 MB.
MAX_DEPTH = 20
#: Entries a bucket holds before it splits.
CAPACITY = 1024
#: A text with more than one of so many rows folds before it moves; fewer than ``HOT`` texts can have that many, which bounds their broadcast.
HOT = 1000


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))


def _prefix(h, depth: int):
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(hashes: DataFrame, depth: int, capacity: int = CAPACITY) -> DataFrame:
    """Slots of a directory of ``depth`` bits over distinct hashes (h): slot, local_depth, bucket (its first slot)."""
    fine = hashes.groupBy(_prefix(F.col("h"), depth).alias("slot")).agg(F.count("*").alias("n"))
    up = fine.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    up = up.select("slot", "n", "d", F.expr(f"shiftright(slot, {depth} - d)").alias("prefix"))
    nodes = up.groupBy("d", "prefix").agg(F.sum("n").alias("n"))
    fits = nodes.where((F.col("n") <= capacity) | (F.col("d") == depth)).select("d", "prefix")
    # on a slot's path counts only fall, so its bucket is the shallowest ancestor that fits
    found = up.join(fits, ["d", "prefix"]).groupBy("slot").agg(F.min(F.struct("d", "prefix")).alias("b"))
    return found.select("slot", F.col("b.d").alias("local_depth"), F.expr(f"shiftleft(b.prefix, {depth} - b.d)").alias("bucket"))


class Index:
    """A built index: ``entries`` (bucket, local_depth, h, chain, sha, keep_id, n rows) and the ``slots`` that lead to its buckets."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, capacity: int):
        rows = _keyed(docs, id_col, text_col)
        hashes = staged(rows.groupBy("h").agg(F.count("*").alias("n")), "hashes")
        distinct, total = hashes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, distinct) / capacity)) + 2)) if distinct else 0
        self.slots = staged(directory(hashes, self.depth, capacity), "directory")
        hot = F.broadcast(hashes.where(F.col("n") * HOT > total).select("h"))
        many = rows.join(hot, "h", "left_semi").groupBy("h", "t").agg(F.max("id").alias("id"), F.count("*").alias("n"))
        few = rows.join(hot, "h", "left_anti").select("h", "t", "id", F.lit(1).cast("long").alias("n"))
        owned = self.routed(few.unionByName(many)).repartition("bucket")  # the grouping and the chains below keep this dealing
        entries = owned.groupBy("bucket", "local_depth", "h", "t").agg(F.max("id").alias("keep_id"), F.sum("n").alias("n")).select("*", F.sha2("t", 256).alias("sha"))
        chain = F.row_number().over(W.partitionBy("bucket", "h").orderBy("sha"))
        self.entries = staged(entries.drop("t").withColumn("chain", chain), "index")

    def routed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the bucket of their hash, column h."""
        return rows.withColumn("slot", _prefix(F.col("h"), self.depth)).join(F.broadcast(self.slots), "slot").drop("slot")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Null text counts as empty. Of equal texts the row with the largest id stays;
    of repeated rows with that same id exactly one does. A null id loses to any
    other; a group of null ids keeps one row. Very long texts are compared whole.
    An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    index = Index(docs, id_col, text_col, capacity)
    rows = _keyed(docs, id_col, text_col).groupBy("id", "h", F.sha2("t", 256).alias("sha")).agg(F.count("*").alias("copies"))
    hit = index.routed(rows).drop("local_depth").join(index.entries.drop("local_depth"), ["bucket", "h", "sha"])
    return hit.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "bucket",
        "chain",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``docs`` with one row of each distinct text, all columns as they came, whatever their names.

    Rows and ids are chosen as in ``exact_groups``; of rows that repeat both id and text any one stays.
    """
    by = fresh(docs, "id", "sha")
    never_null = lambda c: F.coalesce(c.cast("long"), F.lit(-(1 << 63)))
    index = Index(docs, id_col, text_col, capacity)
    kept = index.entries.select(never_null(F.col("keep_id")).alias(by[0]), F.col("sha").alias(by[1]))
    keyed = docs.withColumns({by[0]: never_null(F.col(id_col)), by[1]: F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)})
    # repeated rows fold before they move, and the join keeps the dealing: texts move once
    return keyed.dropDuplicates(by).join(kept, by, "left_semi").select(*every(docs))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
