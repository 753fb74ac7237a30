"""Removal of word passages that occur earlier in the corpus, by level-wise doubling.

A passage counts from ``min_words`` words on. Windows of ``min_words`` words are
the unit: a word goes if a window that covers it starts earlier elsewhere. Levels
run over lengths that double up to ``min_words`` (10, 20): at a level below the
last a window stands for its rarest part, the length-L subwindow with the least
hash, and survives only if that part occurs again anywhere. Two equal windows
choose equal parts at equal places, so no repeat is lost, and neighbouring
windows share their choice, so a level asks about one position in six. Survivors
alone are extended to twice the length. At the last level whole windows are
compared and each learns whether its first occurrence is the corpus's first. No
candidates survive that, since longer repeats are unions of these windows.

Data flow. Documents are staged once in *blocks* of about two megabytes of text,
in files bucketed by block. Per level, each block asks about its distinct window
hashes: one packed row per (block, hash bucket), so a passage shared by a third
of all rows costs a block one entry. A bucket's task answers one bit an entry;
answers return by block and meet the text without moving it. Hashes have 64 bits
at the filtering levels, where a collision only costs work, and 96 at the last.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import staged, table, work_dir
from pulsegrid.llm.wordhash import Words, buffers, hash_words, slices, window_minimum

MIN_WORDS = 20
#: Bytes of text of a block; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20
#: Blocks whose entries one hash bucket holds about the tenth of.
BLOCKS_PER_BUCKET = 3
_NULL_ID = np.iinfo(np.int64).min


def levels(min_words: int) -> list[int]:
    """Window lengths, each half the next: ``min_words`` and its half, while that has six words or more."""
    out = [min_words]
    while math.ceil(out[0] / 2) >= 6:
        out.insert(0, math.ceil(out[0] / 2))
    return out


def _planes(x: np.ndarray) -> bytes:
    """Bytes of an integer array, most alike bytes side by side, for the shuffle's compression."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(first, stop) of each run of equal values."""
    if not len(x):
        return []
    cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return list(zip(cuts, cuts[1:], strict=False))


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        for a, b in slices(batch.column(1), BLOCK_BYTES):
            piece = batch.slice(a, b - a)
            block = (part << 32) + seq
            seq += 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(piece), block)), pa.array(np.arange(len(piece), dtype=np.int32)), piece.column(0), piece.column(1)], ["block", "pos", "doc_id", "text"])


class _Block:
    """A block's words, its windows still alive, and the answers to its questions."""

    def __init__(self, ids: pa.Array, texts: pa.Array, min_words: int):
        self.ids, self.texts, self.min_words = ids, texts, min_words
        self.order = np.asarray(ids.fill_null(int(_NULL_ID)).to_numpy(zero_copy_only=False), np.int64)
        self.words: Words = hash_words(texts)
        self.alive = np.flatnonzero(self.words.fits(min_words))

    def _keys(self, length: int, buckets: int):
        """Distinct keys in (bucket, key) order: windows' entry numbers, keys, bucket of each, and each entry's first window."""
        h = self.words.windows(length)
        if length < self.min_words:
            place = window_minimum(h, self.min_words - length + 1)[self.alive] if len(self.alive) else self.alive
            keys, seen, entry = np.unique(h[place], return_index=True, return_inverse=True)
            # a part that stands at two places of this very block is repeated, whatever other blocks hold
            again = np.zeros(len(keys), bool)
            again[entry[place != place[seen][entry]]] = True
            self.twice = again[entry]
            lead = None
        else:
            h, g = h[self.alive], self.words.windows(length, seed=1)[self.alive] & np.uint64(0xFFFFFFFF)
            doc = self.words.text_of[self.alive]
            # by key, then by the order that decides which occurrence is first
            by = np.lexsort((self.alive, self.order[doc], g, h))
            new = np.ones(len(by), bool)
            new[1:] = (h[by][1:] != h[by][:-1]) | (g[by][1:] != g[by][:-1])
            entry = np.empty(len(by), np.int64)
            entry[by] = np.cumsum(new) - 1
            keys, lead = h[by][new], by[new]
            self.g = g
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        rank = np.argsort(bucket, kind="stable")
        back = np.empty(len(rank), np.int64)
        back[rank] = np.arange(len(rank))
        return back[entry], keys[rank], bucket[rank], None if lead is None else lead[rank]

    def ask(self, length: int, buckets: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, packed entries) of the windows alive."""
        _, keys, bucket, lead = self._keys(length, buckets)
        for a, b in _runs(bucket):
            payload = _planes(keys[a:b])
            if lead is not None:
                at = self.alive[lead[a:b]]
                doc = self.words.text_of[at]
                start = (at - self.words.first[doc]).astype(np.uint32)
                payload += _planes(self.g[lead[a:b]].astype(np.uint32)) + _planes(self.order[doc]) + _planes(start)
            yield int(bucket[a]), payload

    def hear(self, length: int, buckets: int, answer: list[dict] | None) -> np.ndarray:
        """Per window alive: the answer's bit; at the last level only for an entry's own first window."""
        entry, keys, bucket, lead = self._keys(length, buckets)
        bits = np.zeros(len(keys), bool)
        given = {x["bucket"]: x["bits"] for x in answer or ()}
        for a, b in _runs(bucket):
            bits[a:b] = np.unpackbits(np.frombuffer(given[int(bucket[a])], np.uint8), count=b - a).astype(bool)
        if lead is None:
            return bits[entry] | self.twice
        doc = self.words.text_of[self.alive]
        start = self.alive - self.words.first[doc]
        lead_of = lead[entry]
        same = (self.order[doc] == self.order[doc[lead_of]]) & (start == start[lead_of])
        return bits[entry] & same

    def removed(self, first: np.ndarray) -> np.ndarray:
        """Mask of words that a window which is not the first of its kind covers."""
        m = len(self.words.h)
        change = np.zeros(m + 1, np.int64)
        gone = self.alive[~first]
        np.add.at(change, gone, 1)
        np.add.at(change, gone + self.min_words, -1)
        return np.cumsum(change[:m]) > 0


def _by_block(batches: Iterator[pa.RecordBatch], min_words: int):
    """(block, _Block, answers) of rows that arrive block after block; answers stand in a block's first row."""
    held: list[pa.RecordBatch] = []

    def done():
        t = pa.Table.from_batches(held).combine_chunks()
        answers = {n: next((x for x in t.column(n).to_pylist() if x), None) for n in t.column_names if n.startswith("answer")}
        return t.column("block")[0].as_py(), _Block(t.column("doc_id").combine_chunks(), t.column("text").combine_chunks(), min_words), answers

    for batch in batches:
        block = batch.column(0).to_numpy()
        for a, b in _runs(block):
            if held and held[0].column(0)[0].as_py() != block[a]:
                yield done()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield done()


def _asker(lengths: list[int], at: int, min_words: int, buckets: int):
    """Asks at level ``at`` after hearing the answers of those before."""

    def run(batches):
        for block, b, answers in _by_block(batches, min_words):
            for i, length in enumerate(lengths[:at]):
                b.alive = b.alive[b.hear(length, buckets, answers[f"answer{i}"])]
            rows = list(b.ask(lengths[at], buckets))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array([p for _, p in rows], pa.binary())], ["bucket", "block", "payload"])

    return run


def _answerer(last: bool):
    """One bucket's entries of all blocks to one bit each: repeated elsewhere, or at the last level first of its kind."""

    def run(key: tuple, asked: pa.Table) -> pa.Table:
        blocks, payloads = asked.column("block").to_pylist(), asked.column("payload").to_pylist()
        width = 24 if last else 8
        counts = [len(p) // width for p in payloads]
        part = lambda lo, hi, kind: np.concatenate([_unplanes(p[lo * n : hi * n], kind) for p, n in zip(payloads, counts, strict=True)])
        h = part(0, 8, np.uint64)
        if last:
            g, doc, start = part(8, 12, np.uint32), part(12, 20, np.int64), part(20, 24, np.uint32)
            by = np.lexsort((start, doc, g, h))
            hs, gs, ds, ss = h[by], g[by], doc[by], start[by]
            new = np.ones(len(by), bool)
            new[1:] = (hs[1:] != hs[:-1]) | (gs[1:] != gs[:-1])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            bit = np.empty(len(by), bool)
            bit[by] = (ds == ds[lead]) & (ss == ss[lead])
        else:
            by = np.argsort(h, kind="stable")
            hs = h[by]
            same = hs[1:] == hs[:-1]
            bit = np.zeros(len(by), bool)
            bit[by] = np.r_[same, False] | np.r_[False, same]
        ends = np.cumsum(counts)
        bits = [np.packbits(bit[e - n : e]).tobytes() for e, n in zip(ends, counts, strict=True)]
        return pa.Table.from_arrays([pa.array(blocks, pa.int64()), pa.array([key[0].as_py()] * len(blocks), pa.int64()), pa.array(bits, pa.binary())], ["block", "bucket", "bits"])

    return run


def _finisher(lengths: list[int], min_words: int, buckets: int):
    def run(batches):
        for _, b, answers in _by_block(batches, min_words):
            for i, length in enumerate(lengths[:-1]):
                b.alive = b.alive[b.hear(length, buckets, answers[f"answer{i}"])]
            gone = b.removed(b.hear(lengths[-1], buckets, answers[f"answer{len(lengths) - 1}"]))
            data, bounds = buffers(b.texts)
            raw, first = data.tobytes(), b.words.first
            texts, spans = [], []
            for d in range(len(b.ids)):
                mask = gone[first[d] : first[d + 1]]
                words = raw[bounds[d] : bounds[d + 1]].split()
                edge = np.flatnonzero(np.diff(np.r_[False, mask, False])).tolist() if mask.any() else []
                pairs = list(zip(edge[::2], edge[1::2], strict=True))
                if pairs:
                    kept, at = [], 0
                    for s, e in pairs:
                        kept += words[at:s]
                        at = e
                    words = kept + words[at:]
                texts.append(b" ".join(words))
                spans.append([{"start": s, "stop": e} for s, e in pairs])
            yield pa.RecordBatch.from_arrays(
                [b.ids, pa.array(np.diff(first), pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "removed", "kept_text"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_words, removed (array of word ranges), kept_text (kept words joined by one space).

    Null texts have no words. Rows order by (id, place); a null id comes before
    all others. Rows that repeat an id are one document for that order, so equal
    rows stay or go alike. Texts under ``min_words`` words keep all. An empty
    table gives no rows, and other columns are ignored.
    """
    spark = docs.sparkSession
    lengths = levels(min_words)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    name = f"pulsegrid_blocks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.mapInArrow(_cut_blocks, "block long, pos int, doc_id long, text string")
    blocks.write.format("parquet").option("compression", "zstd").option("path", f"{work_dir(spark)}/pulsegrid/{name}").bucketBy(parts, "block").saveAsTable(name)
    state = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the name was only needed to declare the buckets
    buckets = max(16, state.where("pos = 0").count() // BLOCKS_PER_BUCKET)
    for i, length in enumerate(lengths):
        asked = state.mapInArrow(_asker(lengths, i, min_words, buckets), "bucket long, block long, payload binary")
        answers = asked.groupBy("bucket").applyInArrow(_answerer(length == min_words), "block long, bucket long, bits binary")
        answers = staged(answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"answer{i}")), f"answers{i}")
        answers = answers.withColumnsRenamed({"block": f"block{i}"}).hint("shuffle_hash")
        state = state.join(answers, (F.col("block") == F.col(f"block{i}")) & (F.col("pos") == 0), "left").drop(f"block{i}")
    return state.mapInArrow(_finisher(lengths, min_words, buckets), "doc_id long, n_words long, removed array<struct<start:long,stop:long>>, kept_text string")


def op1_substring_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


_WINDOW = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER d" for k in range(1, MIN_WORDS))])
ORACLE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
k AS (SELECT *, md5({_WINDOW}) AS win FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS again FROM k),
g AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN s USING (doc_id)
"""
