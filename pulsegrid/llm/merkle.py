"""A Merkle manifest of a corpus: a tree of digests per group, the groups' roots under one root, and a proof for every row.

1. *Leaves.* A row's leaf is the SHA-256 of its fields. Texts don't move: rows go on as id, leaf and, where a claim differs, the claim's leaf.
2. *Ranks.* An id is a string of hexadecimal digits in the ids' order. Rows are counted by all but the last ``DIGIT`` digits, those counts by all but
   the last twice as many, and so on. Running sums among the children of one prefix (at most 16**DIGIT), added from the top down, tell how
   many rows of a group come before a bucket; inside a bucket rows are few, and numbered. Nothing is sorted as a whole. Ids with very
   many unlike rows go on with digits of the leaf, which is evenly spread.
3. *Trie.* A node's key is its rank without its last binary digits. A task takes the nodes that share all but ``BLOCK`` digits and climbs these levels
   at once; what is left goes into the next round, so that 10**11 rows take four.
4. *Proofs.* Siblings go down the same way: a block learns those above it once, and its rows hash and fold all of them where they stand.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import staged, table
from pulsegrid.operators import ranks

#: Children of a node.
FANOUT = 2
#: Levels that one task climbs at once; a block has at most FANOUT**BLOCK nodes.
BLOCK = 12
#: Hexadecimal digits that a level of the histograms adds.
DIGIT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = "g string, pos long, total long, h string"
_TOP = "subroot string, root string, gpos long, gtotal long, gsibs string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _name(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def leaf(values: list[Column]) -> Column:
    """Hexadecimal SHA-256 of the values: ``-`` for null, else the bytes of UTF-8, a colon and the value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def rank(rows: DataFrame, key: str, width: int, tie: str) -> DataFrame:
    """Adds ``pos`` (rows of the group g before it, from 0) and ``total`` (rows of the group), counting each row n times.

    ``key`` holds ``width`` hexadecimal digits in the rows' order; ``tie`` orders rows of one key. At most 16**DIGIT
    keys share all but the last digits, so no window holds more than that many distinct keys.
    """
    cuts = [*range(width - DIGIT, 0, -DIGIT), 0]
    levels = [staged(rows.groupBy("g", F.substring(key, 1, cuts[0]).alias("p")).agg(F.sum("n").alias("n")), "histogram")]
    for cut in cuts[1:]:
        levels.append(levels[-1].groupBy("g", F.substring("p", 1, cut).alias("p")).agg(F.sum("n").alias("n")))
    found = levels[-1].select("g", "p", F.lit(0).cast("long").alias("base"), F.col("n").alias("total"))
    for finer, (_, cut) in zip(levels[-2::-1], list(pairwise(cuts))[::-1], strict=True):
        earlier = W.partitionBy("g", "up").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
        part = finer.withColumn("up", F.substring("p", 1, cut)).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        found = part.join(found.withColumnRenamed("p", "up"), ["g", "up"]).select("g", "p", (F.col("base") + F.col("before")).alias("base"), "total")
    upto = W.partitionBy("g", "p").orderBy(key, tie).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("p", F.substring(key, 1, cuts[0])).join(found, ["g", "p"]).withColumn("pos", F.col("base") + F.sum("n").over(upto) - F.col("n")).drop("p", "base")


def _keyed(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` with the digits of their id that tell ids apart, as key; and how many there are. Null ids come first."""
    digits = F.hex(F.col("id").bitwiseXOR(F.lit(-(1 << 63)))).alias("x")  # in the order of signed ids
    low, high, nulls = rows.agg(F.min(F.lpad(digits, 16, "0")), F.max(F.lpad(digits, 16, "0")), F.coalesce(F.max(F.col("id").isNull()), F.lit(False))).first()
    low, high = low or "0" * 16, high or "0" * 16
    shared = next((k for k in range(16) if low[k] != high[k]), 15)
    key, width = F.substring(F.lpad(digits, 16, "0"), shared + 1, 16), 16 - shared
    if nulls:
        key, width = F.coalesce(F.concat(F.lit("1"), key), F.lit("0" * (width + 1))), width + 1
    rows = rows.withColumn("key", key)
    most = rows.groupBy("g", F.substring("key", 1, max(0, width - DIGIT)).alias("p")).count().agg(F.max("count")).first()[0] or 0
    more = 0
    while most > 16**DIGIT and more < 60:  # ids repeat with unlike rows
        more, most = more + DIGIT, most / 16**DIGIT
    return rows.withColumn("key", F.concat("key", F.substring(F.hex("leaf"), 1, more))) if more else rows, width + more


def _climb(hashes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block, level by level; it starts at a multiple of its size."""
    out = [hashes]
    for _ in range(levels):
        now = out[-1]
        out.append([digest(now[k] + now[k + 1] if k + 1 < len(now) else now[k]) for k in range(0, len(now), FANOUT)])
    return out


def _block(nodes: pa.Table, block: int) -> tuple[pa.Table, list[list[str]]]:
    nodes = nodes.sort_by("pos")
    return nodes, _climb(nodes["h"].to_pylist(), min(block, (nodes["total"][0].as_py() - 1).bit_length()))


def _reduced(nodes: DataFrame, largest: int, block: int) -> list[DataFrame]:
    """Rounds of nodes (g, pos, total, h) from ``nodes`` up to one node a group, a round at least."""

    def run(key, part):
        part, levels = _block(part, block)
        total = -(-part["total"][0].as_py() // FANOUT ** (len(levels) - 1))
        return pa.table({"g": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([key[1].as_py()], pa.int64()), "total": pa.array([total], pa.int64()), "h": pa.array(levels[-1], pa.string())})

    out = [nodes]
    while len(out) == 1 or largest > 1:
        out.append(staged(out[-1].select("g", "pos", "total", "h").groupBy("g", _up(block)).applyInArrow(run, _NODES), "nodes"))
        largest = -(-largest // FANOUT**block)
    return out


def _up(block: int) -> Column:
    return F.shiftright("pos", block).alias("up")


def _siblings(levels: list[list[str]], k: int) -> str:
    """Those of the block's k-th node inside its block, bottom up."""
    out = []
    for nodes in levels[:-1]:
        if k ^ 1 < len(nodes):
            out.append(nodes[k ^ 1])
        k >>= 1
    return "".join(out)


def fold(h: str, pos: int, total: int, siblings: str) -> str:
    """The root that a node and its siblings give, bottom up."""
    at = 0
    while total > 1:
        if pos ^ 1 < total:
            other = siblings[at : at + 64]
            at += 64
            h = digest(other + h if pos & 1 else h + other)
        else:
            h = digest(h)
        pos, total = pos >> 1, (total + 1) >> 1
    return h


def _lowered(rounds: list[DataFrame], above: DataFrame, keep: str, block: int) -> DataFrame:
    """Siblings (sibs) of the nodes of ``rounds[0]``, from those of the last round, ``above`` (g, pos, sibs and the columns of ``keep``)."""
    names = [c.split()[0] for c in keep.split(", ")] if keep else []

    def run(key, nodes, over):
        nodes, levels = _block(nodes, block)
        rest, n = over["sibs"][0].as_py(), len(nodes)
        columns = {"g": nodes["g"], "pos": nodes["pos"], "sibs": pa.array([_siblings(levels, k) + rest for k in range(n)], pa.string())}
        return pa.table(columns | {c: pa.array([over[c][0].as_py()] * n, over.schema.field(c).type) for c in names})

    for nodes in rounds[-2::-1]:
        above = nodes.groupBy("g", _up(block)).cogroup(above.groupBy("g", "pos")).applyInArrow(run, "g string, pos long, sibs string" + (f", {keep}" if keep else ""))
    return above


def _proved(leaves: DataFrame, above: DataFrame, block: int) -> DataFrame:
    def run(key, rows, over):
        rows, levels = _block(rows, block)
        top = {c: over[c][0].as_py() for c in over.column_names}
        n, total = len(rows), rows["total"][0].as_py()
        proofs, roots = [], []
        for k, (pos, own, told) in enumerate(zip(rows["pos"].to_pylist(), rows["h"].to_pylist(), rows["told"].to_pylist(), strict=True)):
            inner = _siblings(levels, k) + top["sibs"]
            proofs.append(digest(inner + top["gsibs"]))
            roots.append(fold(fold(told or own, pos, total, inner), top["gpos"], top["gtotal"], top["gsibs"]))
        text = lambda xs: pa.array(xs, pa.string())
        return pa.table({
            "doc_id": rows["id"], "leaf": rows["h"], "subroot": text([top["subroot"]] * n), "root": text([top["root"]] * n), "proof_sha256": text(proofs),
            "folded_root": text(roots), "verified": pa.array([r == top["root"] for r in roots], pa.bool_()), "pos": rows["pos"], "total": rows["total"],
        })

    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, pos long, total long"
    return leaves.groupBy("g", _up(block)).cogroup(above.groupBy("g", "pos")).applyInArrow(run, out)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, claims: dict[str, Column] | None = None, where: Column | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, pos (rank in the group) and total of every row.

    ``claims`` replaces fields of the rows that match ``where``: what somebody says these rows are. ``folded_root`` is recomputed from the claim, or else
    the row itself, and the siblings; ``verified`` tells whether it is the root.

    Null and empty groups and values differ; a null id comes first. Rows that repeat an id are leaves of their own, ordered by their leaf; repeated
    rows are equal leaves, as often as they come. Very long texts are hashed whole, by Spark, and don't move. A table
    without rows gives none. Other columns, whatever their names, are ignored.
    """
    spark, told = docs.sparkSession, F.lit(None).cast("string")
    if claims:
        told = F.when(F.lit(True) if where is None else where, leaf([claims.get(c, _name(c)) for c in fields]))
    group = F.coalesce(F.concat(F.lit("="), _name(group_col).cast("string")), F.lit(""))
    rows = docs.select(group.alias("g"), _name(id_col).cast("long").alias("id"), F.unhex(leaf([_name(c) for c in fields])).alias("leaf"), F.unhex(told).alias("told"))
    rows = staged(rows.groupBy("g", "id", "leaf", "told").agg(F.count("*").alias("n")), "leaves")  # equal rows fold before they move
    keyed, width = _keyed(rows)
    placed = rank(keyed, "key", width, "leaf").drop("key")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy")
    placed = placed.select("*", copies).withColumn("pos", F.col("pos") + F.col("copy"))
    hexed = lambda c: F.lower(F.hex(c))
    leaves = staged(placed.select("g", "id", "pos", "total", hexed("leaf").alias("h"), hexed("told").alias("told")), "placed")
    largest = leaves.agg(F.max("total")).first()[0]
    if largest is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, pos long, total long")
    rounds = _reduced(leaves, largest, block)
    groups = ranks.running(rounds[-1].select("g", "h"), [], [F.col("g")], {})
    groups = staged(groups.select(F.lit("").alias("g"), (F.col("rank") - 1).alias("pos"), F.col("n").alias("total"), "h", F.col("g").alias("of")), "groups")
    tops = _reduced(groups, groups.count(), block)
    root = tops[-1].first()["h"]
    gsibs = _lowered(tops, tops[-1].select("g", "pos", F.lit("").alias("sibs")), "", block).select(F.col("pos").alias("gpos"), F.col("sibs").alias("gsibs"))
    above = groups.withColumnRenamed("pos", "gpos").join(gsibs, "gpos")
    above = above.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("sibs"), F.col("h").alias("subroot"), F.lit(root).alias("root"), "gpos", F.col("total").alias("gtotal"), "gsibs")
    return _proved(leaves, _lowered(rounds[1:], above, _TOP, block), block)


def op11_merkle(spark, sf_dir):
    odd = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    claim = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    return manifest(table(spark, sf_dir, "documents"), claims=claim, where=odd).drop("pos", "total")


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_SHA = lambda n_chars: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"

#: Levels by a recursive query that pairs neighbours; proofs gather a level's siblings along each leaf's path. CRC-32 goes bit by bit.
ORACLE = f"""
WITH RECURSIVE base AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS g, {_SHA("n_chars")} AS leaf, {_SHA("(n_chars + 1)")} AS claim,
    list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: list_transform(range(8), lambda b: (ascii(ch)::BIGINT >> b) & 1))),
      lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))) AS crc
  FROM documents),
leaves AS (SELECT doc_id, g, leaf, CASE WHEN xor(crc, 4294967295::BIGINT) % 7 = 0 THEN claim ELSE leaf END AS told,
    row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS total FROM base),
low(g, pos, total, lev, h) AS (
  SELECT g, pos, total, 0, leaf FROM leaves
  UNION ALL
  SELECT g, pos // 2, (any_value(total) + 1) // 2, any_value(lev) + 1, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE total > 1 GROUP BY g, pos // 2),
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS gpos, count(*) OVER () AS gtotal FROM low WHERE total = 1),
high(pos, total, lev, h) AS (
  SELECT gpos, gtotal, 0, subroot FROM subs
  UNION ALL
  SELECT pos // 2, (any_value(total) + 1) // 2, any_value(lev) + 1, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE total > 1 GROUP BY pos // 2),
top AS (SELECT h AS root FROM high WHERE total = 1),
steps AS (
  SELECT g, pos, total, lev FROM low WHERE total > 1),
lowsib AS (
  SELECT l.g, l.doc_id, l.pos AS leaf_pos, s.lev, o.h AS sib, (l.pos >> s.lev) & 1 AS odd
  FROM leaves l JOIN steps s ON s.g = l.g AND s.pos = l.pos >> s.lev LEFT JOIN low o ON o.g = l.g AND o.lev = s.lev AND o.pos = xor(l.pos >> s.lev, 1)),
highsib AS (
  SELECT u.g, s.lev, o.h AS sib, (u.gpos >> s.lev) & 1 AS odd
  FROM subs u JOIN high s ON s.total > 1 AND s.pos = u.gpos >> s.lev LEFT JOIN high o ON o.lev = s.lev AND o.pos = xor(u.gpos >> s.lev, 1)),
path AS (
  SELECT g, leaf_pos, lev, sib, odd FROM lowsib
  UNION ALL
  SELECT l.g, l.pos, 1000 + h.lev, h.sib, h.odd FROM leaves l JOIN highsib h ON h.g = l.g),
proofs AS (
  SELECT g, leaf_pos, list(struct_pack(sib := coalesce(sib, ''), odd := odd) ORDER BY lev) AS way FROM path GROUP BY g, leaf_pos)
SELECT l.doc_id, l.leaf, u.subroot, top.root, sha256(coalesce(list_aggregate(list_transform(p.way, lambda s: s.sib), 'string_agg', ''), '')) AS proof_sha256,
  list_reduce([struct_pack(sib := l.told, odd := 0::BIGINT)] || coalesce(p.way, []),
    lambda a, s: struct_pack(sib := sha256(CASE WHEN s.odd = 1 THEN s.sib || a.sib ELSE a.sib || s.sib END), odd := 0::BIGINT)).sib AS folded_root,
  folded_root = top.root AS verified
FROM leaves l JOIN subs u ON u.g = l.g CROSS JOIN top LEFT JOIN proofs p ON p.g = l.g AND p.leaf_pos = l.pos
"""
