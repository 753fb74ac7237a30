"""Ranked lexical search: the best documents for every item of a query set, by bucket scores in windows of documents.

1. *Postings.* Tasks cut every text into terms, hash them in numpy and keep those that some item asks for, after comparing their bytes: a
   document becomes its number of terms and its (term, count) pairs, written once.
2. *Statistics.* Documents, terms and the documents of each asked term are counted over all rows.
3. *Windows.* A task takes its documents in fixed windows of doc_id order. It turns a window's pairs into postings, sorted by term, and weighs each
   posting once. Every item then walks through the postings of its terms and adds their weights into an array with a slot a
   document, small enough for a core's cache; a bitset tells which slots are occupied. Occupied slots go to the item's heap and are cleared.
4. *Merge.* Tasks hand on an item's best ``top`` rows, of which the best ``top`` are the answer.

Items are the query set, and are taken in blocks of a bounded number of terms; each block passes over all documents. Documents don't move.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import frugal, staged, table
from pulsegrid.llm.wordhash import buffers, hash_words, slices

#: A term, in lower case of ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a window: 128 KB of scores.
WINDOW = 1 << 14
#: Terms of the items of a block, with repeats; an item by itself may have more.
BLOCK_TERMS = 1 << 20
#: Bytes of text hashed at once.
TEXT_BYTES = 2_000_000
TOP = 10

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PAIRS = "doc_id long, n long, terms array<int>, counts array<int>"
_FOUND = "item long, doc_id long, score long"


class Asked:
    """The distinct terms of a block's items, by hash: ``h`` ascending, ``words`` as bytes, and each item's places in them."""

    def __init__(self, items: dict[int, list[str]]):
        words = sorted({w for terms in items.values() for w in terms})
        h = hash_words(pa.array(words, pa.string()), between=_BETWEEN).h
        order = np.argsort(h, kind="stable")
        self.h, self.words = h[order], [words[k].encode() for k in order.tolist()]
        if len(self.h) > 1 and (self.h[1:] == self.h[:-1]).any():
            raise ValueError("two asked terms share a hash")
        place = {w.decode(): k for k, w in enumerate(self.words)}
        self.items = {i: np.array(sorted({place[w] for w in terms}), np.int64) for i, terms in items.items()}

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of terms of each text; and text, term and count of each asked term in it, by text and term."""
        words = hash_words(texts, True, _BETWEEN)
        n = np.diff(words.first)
        at = np.searchsorted(self.h, words.h)
        found = np.flatnonzero(self.h[np.minimum(at, len(self.h) - 1)] == words.h) if len(self.h) else np.zeros(0, np.int64)
        found = found[self._same(words, found, at[found])]
        key, counts = np.unique(words.text_of[found] * len(self.h) + at[found], return_counts=True)
        text, term = np.divmod(key, max(1, len(self.h)))
        return n, text, term, counts

    def _same(self, words, found: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Whether the words ``found`` hold the bytes of their terms."""
        flat = np.frombuffer(b"".join(self.words), np.uint8)
        size = np.array([len(w) for w in self.words], np.int64)
        first = np.cumsum(size) - size
        length = words.end[found] - words.start[found]
        ok = length == size[term] if len(found) else np.zeros(0, bool)
        for k in range(int(size.max()) if len(size) else 0):  # a byte of all words at a time
            live = np.flatnonzero(ok & (length > k))
            if not len(live):
                break
            mine = words.data[words.start[found[live]] + k]
            mine = mine + np.where((mine >= 65) & (mine <= 90), 32, 0).astype(np.uint8)
            ok[live] = mine == flat[first[term[live]] + k]
        return ok


def _postings(docs: DataFrame, asked: Asked) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), TEXT_BYTES):
                piece = batch.slice(a, b - a)
                n, text, term, counts = asked.pairs(piece.column(1))
                cuts = pa.array(np.searchsorted(text, np.arange(len(piece) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (term, counts)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(frugal(run), _PAIRS)


def weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


class Best:
    """An item's ``top`` best rows so far, as a heap whose least is the worst; a null id comes after all others."""

    def __init__(self, top: int):
        self.top, self.heap = top, []

    def offer(self, ids: list, scores: list[int]) -> None:
        for i, s in zip(ids, scores, strict=True):
            row = (s, i is not None, 0 if i is None else -i)
            if len(self.heap) < self.top:
                heapq.heappush(self.heap, row)
            elif row > self.heap[0]:
                heapq.heapreplace(self.heap, row)

    def floor(self) -> int:
        """A row with a lower score can't enter."""
        return self.heap[0][0] if len(self.heap) == self.top else 1


def _found(postings: DataFrame, asked: Asked, weights: np.ndarray, documents: int, terms: int, top: int) -> DataFrame:
    def window(ids: list, m: np.ndarray, cuts: np.ndarray, term: np.ndarray, count: np.ndarray, best: dict[int, Best]) -> None:
        """Scores a window's documents: ``cuts`` bounds each one's pairs."""
        slot = np.repeat(np.arange(len(ids)), np.diff(cuts))
        order = np.argsort(term, kind="stable")
        slot, tf = slot[order], count[order].astype(np.int64)
        first = np.searchsorted(term[order], np.arange(len(weights) + 1))
        value = np.repeat(weights, np.diff(first)) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[slot]))
        score, occupied = np.zeros(len(ids), np.int64), np.zeros(-(-len(ids) // 8) * 8, bool)
        for item, places in asked.items.items():
            for p in places.tolist():
                here = slot[first[p] : first[p + 1]]
                score[here] += value[first[p] : first[p + 1]]  # a document stands once among a term's postings
                occupied[here] = True
            found = np.flatnonzero(np.unpackbits(np.packbits(occupied)))
            good = found[score[found] >= best[item].floor()]
            if len(good) > top:
                good = np.sort(good[np.argsort(-score[good], kind="stable")[:top]])  # documents stand in the order of ids, so ties keep it
            best[item].offer([ids[k] for k in good.tolist()], score[good].tolist())
            score[found], occupied[found] = 0, False

    def windows(batches):
        """Batches of at most WINDOW documents; a batch that Spark made is in the order its file had."""
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < len(batch):
                take = min(len(batch) - at, WINDOW - n)
                held.append(batch.slice(at, take))
                at, n = at + take, n + take
                if n == WINDOW:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        best = {i: Best(top) for i in asked.items}
        for part in windows(batches):
            part = part.sort_by("doc_id").combine_chunks()  # nulls last
            term, count = (part[c].combine_chunks() for c in ("terms", "counts"))
            cuts = np.r_[0, np.cumsum(term.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            m = np.array([10 + (90 * n * documents) // terms if terms else 10 for n in part["n"].to_pylist()], np.int64)
            window(part["doc_id"].to_pylist(), m, cuts, term.flatten().to_numpy(), count.flatten().to_numpy(), best)
        rows = [(i, -neg if has else None, s) for i, b in best.items() for s, has, neg in b.heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item", "doc_id", "score"])

    return postings.mapInArrow(frugal(run), _FOUND)


def _terms(text) -> F.col:
    """Distinct terms of a text column."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0)))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``top`` best documents with a score above 0.

    An item's terms are those of all its rows, once each; null is an item of its own. Items without terms, or whose terms nobody
    has, have no rows. A null text has no terms and isn't counted. Rows that repeat an id are documents of
    their own and may both be ranked; a null id loses ties. Very long texts are read whole. Empty tables give no rows. Other columns,
    whatever their names, are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.explode(_terms(F.col(query_col))).alias("term")).distinct()
    sized = staged(asked.groupBy("item_id").agg(F.collect_list("term").alias("terms")), "items")
    out = []
    for block in _blocks(sized, block_terms):
        ask = Asked({k: terms for k, (_, terms) in enumerate(block)})
        postings = staged(_postings(rows, ask), "postings")
        documents, terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(ask.h), np.int64)
        for term, n in postings.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[term] = n
        weights = np.array([weight(documents, n) if n else 0 for n in df.tolist()], np.int64)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "item long, item_id long")
        order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = _found(postings, ask, weights, documents, terms, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        out.append(found.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    while len(out) > 1:
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2])] + out[len(out) // 2 * 2 :]  # noqa: B905
    return out[0]


def _blocks(sized: DataFrame, most: int):
    """Lists of (item, terms) with at most ``most`` terms, an item at least; the driver holds a block at a time."""
    block, n = [], 0
    for item, terms in sized.toLocalIterator():
        if block and n + len(terms) > most:
            yield block
            block, n = [], 0
        block.append((item, terms))
        n += len(terms)
    if block:
        yield block


def op13_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = rf"regexp_extract_all(translate({{}}, '{_UPPER}', '{_LOWER}'), '{TERM}')"
ORACLE = f"""
WITH words AS MATERIALIZED (SELECT doc_id, unnest({_SQL_TERMS.format("text")}) AS term FROM documents),
pairs AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM pairs GROUP BY doc_id),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
asked AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS.format("text")}) AS term FROM benchmark),
weighed AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM pairs, whole WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
sized AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM lengths, whole),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weighed USING (term) JOIN pairs USING (term) JOIN sized USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
