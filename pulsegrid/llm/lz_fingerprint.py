"""Fingerprints by Lempel-Ziv phrases, and likeness of neighbours in an order of documents.

A text is parsed into phrases, each the shortest piece that isn't in its dictionary yet, which it then enters. Texts that compress each other well
share phrases. The set of phrases is hashed, and a fingerprint is its minimum under each of ``SIZE`` hash functions; the share of
equal minima estimates the sets' Jaccard likeness. A dictionary starts anew every ``PERIOD`` code points, which bounds its memory
for texts of any length; phrases that it forgot stay in the set.

``neighbours`` compares every document with its edited text and with the next document. Documents are dealt once, by ranges of the order; a task
sees the next document as the next row, and parses the piece that text and edited text share once. What a task can't see, the
document after its last, is added in a second pass over one row a task.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import frugal, staged, table
from pulsegrid.llm.wordhash import mix64, span_hashes

#: Hash functions of a fingerprint, each of 16 bits.
SIZE = 128
#: Code points after which the dictionary starts anew.
PERIOD = 1 << 20
#: Code points fingerprinted at once.
SLICE = 1_000_000
#: Rows of one id and text are dealt to so many places in the order at most: a text that repeats very often needn't meet in one task.
SALT = 1024

_BASE = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = mix64(np.arange(1, SIZE + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


class Parser:
    """Phrases of a text that comes in pieces, in a tree of dictionaries by code point; a phrase without longer ones is 0."""

    def __init__(self):
        self.root: dict = {}
        self.node, self.at = self.root, 0

    def feed(self, piece: str, entered: list | None = None) -> list[int]:
        """Ends of the phrases that ``piece`` completes, in code points from the text's start; ``entered`` gets where they went."""
        ends, done = [], 0
        while done < len(piece):
            part = piece[done : done + PERIOD - self.at % PERIOD]
            self._feed(part, ends, entered)
            done += len(part)
            self.at += len(part)
            if self.at % PERIOD == 0:
                if self.node is not self.root:
                    ends.append(self.at)
                self.root = self.node = {}
        return ends

    def _feed(self, piece: str, ends: list[int], entered: list | None) -> None:
        root, node, put = self.root, self.node, ends.append
        for k, c in enumerate(piece, self.at + 1):
            further = node.get(c)
            if further:
                node = further
            elif further is None:
                node[c] = 0
                put(k)
                if entered is not None:
                    entered.append((node, c))
                node = root
            else:
                node[c] = node = {}
        self.node = node

    def tried(self, piece: str) -> list[int]:
        """As ``feed``, after which the parser is as it was."""
        was, entered = (self.root, self.node, self.at), []
        ends = self.feed(piece, entered)
        for node, c in reversed(entered):
            del node[c]
        self.root, self.node, self.at = was
        return ends


def edited(text: str, after: str) -> tuple[int, str]:
    """How many code points stay, and what follows them: a third at the end gives way to as many of ``after``."""
    gone = len(text) // 3
    return len(text) - gone, after[:gone]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _minima(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per set of hashes (``sizes`` of them in a row) its minimum under each function; an empty set has the largest value."""
    out = np.full((len(sizes), SIZE), np.iinfo(np.uint64).max, np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        first = (np.cumsum(sizes) - sizes)[some]
        for k, f in enumerate(_FACTORS):
            out[some, k] = np.minimum.reduceat(h * f, first)
    return out


def _short(minima: np.ndarray) -> np.ndarray:
    """The parts of the minima that a fingerprint keeps: 16 bits, of which unlike phrases seldom share all."""
    return (minima >> np.uint64(16)).astype(np.uint16)


def signatures(texts: list[str], after: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts and of their edited texts, a row each."""
    codes, starts, ends, sizes, at = [], [], [], [], 0

    def phrases(cuts: list[int], base: int) -> None:
        cut = np.array(cuts, np.int64) + base
        starts.append(cut[:-1])
        ends.append(cut[1:])
        sizes.append(len(cut) - 1)

    gc.disable()  # the trees hold no cycles
    for text, follows in zip(texts, after, strict=True):
        parser = Parser()
        keep, tail = edited(text, follows)
        common = [0, *parser.feed(text[:keep])]
        last = common[-1]
        own = [last, *parser.tried(text[keep:])]
        other = [last, *parser.feed(tail)]
        codes += [_codes(text), _codes(text[last:keep] + tail)]
        phrases(common, at)
        phrases(own, at)
        at += len(text)
        phrases(other, at - last)
        at += keep - last + len(tail)
    gc.enable()
    h = span_hashes(mix64(np.concatenate(codes).astype(np.uint64) + _BASE), np.concatenate(starts), np.concatenate(ends)) if codes else np.zeros(0, np.uint64)
    part = _minima(h, np.array(sizes, np.int64)).reshape(-1, 3, SIZE)
    return _short(np.minimum(part[:, 0], part[:, 1])), _short(np.minimum(part[:, 0], part[:, 2]))


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _record(rows: list, after: list[str], own: np.ndarray, other: np.ndarray, following: np.ndarray) -> pa.RecordBatch:
    """Finished rows (id, text), with the texts and fingerprints of those that follow them."""
    sha, n = [], []
    for (_, text), follows in zip(rows, after, strict=True):
        keep, tail = edited(text, follows)
        sha.append(hashlib.sha256((text[:keep] + tail).encode()).hexdigest())
        n.append(len(text))
    packed = lambda x: pa.array([r.astype("<u2").tobytes() for r in x], pa.binary())
    nothing = pa.nulls(len(rows), pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in rows], pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), packed(own), packed(other), pa.array(_alike(own, other)), pa.array(_alike(own, following)), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.string()), nothing],
        [*(c.split()[0] for c in _OUT.split(", ")), "task", "edge", "text"],
    )


def _edge(kind: str, task: int, row: tuple) -> pa.RecordBatch:
    empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *empty, pa.array([task], pa.int32()), pa.array([kind]), pa.array([row[1]])], [*(c.split()[0] for c in _OUT.split(", ")), "task", "edge", "text"])


def _along(batches, limit: int):
    """A task's rows in order: all but the last finished, and its first and last row as edges."""
    task = TaskContext.get().partitionId()
    rows, size, held, last = [], 0, None, None
    for batch in batches:
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if last is None:
                yield _edge("first", task, row)
            last = row
            rows.append(row)
            size += len(row[1])
            if size >= limit and len(rows) > 1:
                made, held = _slice(rows, held)
                yield from made
                rows, size = rows[-1:], len(row[1])
    if rows:
        made, held = _slice(rows, held)
        yield from made
        if held is not None:
            own, _ = signatures([last[1]], [""])
            yield _record(*held, own)
        yield _edge("last", task, last)


def _slice(rows: list, held):
    """Records of ``held``, the row before, and of all rows but the last two; and the last but one, whose next fingerprint isn't known."""
    if len(rows) < 2:
        return [], held
    done, after = rows[:-1], [t for _, t in rows[1:]]
    own, other = signatures([t for _, t in done], after)
    made = [] if held is None else [_record(*held, own[:1])]
    if len(done) > 1:
        made.append(_record(done[:-1], after[:-1], own[:-1], other[:-1], own[1:]))
    return made, (done[-1:], after[-1:], own[-1:], other[-1:])


def _pairs(batches):
    """Rows (id, text, the next row's text) by themselves."""
    for batch in batches:
        for i, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, other = signatures([text], [after])
            following, _ = signatures([after], [""])
            yield _record([(i, text)], [after], own, other, following)


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SLICE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The order is descending by id, a null id last, and the row after the last is the first; a row alone follows itself. Rows that repeat an id are ordered by a
    hash of their text, so equal rows follow each other in any order. The edited text has a third of the code points, at the end,
    replaced by the first as many of the next row. Null text counts as empty; empty texts are like each other (1) and unlike all others.
    Very long texts are parsed whole, at some 60 bytes of memory a code point. An empty table gives no rows. Other columns,
    whatever their names, are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).alias("salt"))
    order = [F.col("id").desc_nulls_last(), F.col("h"), F.col("salt")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    kinds = f"{_OUT}, task int, edge string, text string"
    done = staged(dealt.mapInArrow(frugal(lambda batches: _along(batches, limit)), kinds), "fingerprints")
    names = [c.split()[0] for c in _OUT.split(", ")]
    first, last = (done.where(F.col("edge") == e).select("task", "doc_id", "text") for e in ("first", "last"))
    # one row a task
    whole = W.orderBy("task")
    follows = first.select("task", F.coalesce(F.lead("task").over(whole), F.min("task").over(W.partitionBy())).alias("next"))
    after = first.select(F.col("task").alias("next"), F.col("text").alias("after"))
    edges = last.join(follows, "task").join(after, "next").select("doc_id", "text", "after").mapInArrow(frugal(_pairs), kinds)
    both = done.where("edge IS NULL").select(*names).unionByName(edges.select(*names))
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (hexadecimal) of every row, where it stands; null text counts as empty."""

    def run(batches):
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for a in range(0, len(ids), 64):
                own, _ = signatures(texts[a : a + 64], [""] * len(texts[a : a + 64]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 64], pa.int64()), pa.array([r.astype("<u2").tobytes().hex() for r in own], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(frugal(run), "doc_id long, fingerprint string")


def likeness(a, b):
    """Estimated Jaccard likeness of two columns of fingerprints."""
    same = F.filter(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda k: F.substr(a, k * 4 + 1, F.lit(4)) == F.substr(b, k * 4 + 1, F.lit(4)))
    return F.size(same) / F.lit(float(SIZE))


def op12_lz_fingerprints(spark, sf_dir):
    return neighbours(table(spark, sf_dir, "documents"))
