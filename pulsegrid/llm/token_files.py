"""Token ids as binary shard files with Elias-Fano document boundaries.

A shard file is one concatenated id array, the boundaries of its documents and
their doc_ids; both of these never decrease, and both are Elias-Fano coded: of n
values up to u each keeps its low floor(log2(u / n)) bits verbatim and its high
part in unary, about 2 + log2(u / n) bits a value, so no 64-bit table stands
beside the ids. ``select`` finds the i-th unary one from a sampled place before
it, a count of ones by byte and a table of the ones in a byte; one document is
found by reading a few bytes of a file.

Layout, little-endian: b"EFT2", id width (u4), documents (u8), documents without
doc_id (u8, they come first), ids (u8), least doc_id (s8), then the two sequences,
boundaries and doc_ids less the least, as: values (u8), largest (u8), low bits
(u4), bytes of low parts, unary parts and samples (u8 each), those bytes, each
padded to 8; then the ids.

Tasks write files of their own under names no other attempt uses and return one
row a file, which is staged: readers open the files that those rows name, so what
a lost attempt left behind is never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.llm.common import frugal, opened, staged, table, trim, work_dir
from pulsegrid.llm.tokens import WORD_BPE, closed, encoder, public_path
from pulsegrid.llm.wordhash import slices

MAGIC, STEP = b"EFT2", 64
HEAD, PART = struct.Struct("<4sIQQQq"), struct.Struct("<QQIQQQ")
END_ID = 2
#: Ids of a shard, 8 MB, and its documents; a longer document is a shard of its own.
SHARD_IDS, SHARD_DOCS = 4 << 20, 1 << 18
TEXT_BYTES = 2 << 20
#: Place of the j-th one of each byte, first bit lowest.
_PLACE = np.array([(np.flatnonzero([b >> k & 1 for k in range(8)]).tolist() + [0] * 8)[:8] for b in range(256)])


def _padded(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


def ef_encode(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of integers from 0 on as its coded part of a file."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // max(1, n)).bit_length() - 1)
    x = values.astype(np.uint64)
    lows = np.empty((n, low), np.uint8)
    for k in range(low):
        lows[:, k] = (x >> np.uint64(k)) & np.uint64(1)
    ones = (x >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    parts = [np.packbits(lows.reshape(-1), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::STEP].astype("<u4").tobytes()]
    return _padded(PART.pack(n, top, low, *map(len, parts))) + b"".join(map(_padded, parts))


class Sequence:
    """Reads a coded sequence through ``read(offset, size)``; only the bytes that a question needs."""

    def __init__(self, read, at: int):
        self.read = read
        self.n, self.top, self.low, lows, high, samples = PART.unpack(read(at, PART.size))
        self.at_low = at + len(_padded(bytes(PART.size)))
        self.at_high = self.at_low + lows + -lows % 8
        self.at_samples = self.at_high + high + -high % 8
        self.high_bytes, self.samples = high, samples // 4
        self.end = self.at_samples + samples + -samples % 8

    def _sample(self, k: int) -> int:
        return struct.unpack("<I", self.read(self.at_samples + 4 * k, 4))[0]

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Places of the unary part's ones of these ranks (ascending): the bytes between two samples are counted."""
        first, last = int(ranks[0]) // STEP, int(ranks[-1]) // STEP + 1
        place = self._sample(first)
        lo, hi = place // 8, self._sample(last) // 8 + 1 if last < self.samples else self.high_bytes
        part = np.frombuffer(self.read(self.at_high + lo, hi - lo), np.uint8)
        count = np.bitwise_count(part).astype(np.int64)
        ahead = np.cumsum(count) - count + first * STEP - int(np.bitwise_count(part[0] & np.uint8((1 << place % 8) - 1)))
        byte = np.searchsorted(ahead, ranks, side="right") - 1  # the last of several: bytes without ones share the next one's rank
        return (lo + byte) * 8 + _PLACE[part[byte], ranks - ahead[byte]]

    def values(self, first: int, stop: int) -> np.ndarray:
        """The values of ranks [first, stop)."""
        if stop <= first:
            return np.zeros(0, np.uint64)
        ranks = np.arange(first, stop)
        out = (self.select(ranks) - ranks).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            lo, hi = first * self.low // 8, -(-stop * self.low // 8)
            bits = np.unpackbits(np.frombuffer(self.read(self.at_low + lo, hi - lo), np.uint8), bitorder="little")
            bits = bits[first * self.low - 8 * lo :][: (stop - first) * self.low].reshape(-1, self.low)
            for k in range(self.low):
                out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out


def pack_shard(ids: np.ndarray, bounds: np.ndarray, doc_ids: np.ndarray, nulls: int = 0) -> bytes:
    """A shard of documents' ids [bounds[i], bounds[i + 1]); ``nulls`` documents without a doc_id come first, ``doc_ids`` ascend."""
    least = int(doc_ids[0]) if len(doc_ids) else 0
    named = (doc_ids.astype(np.int64).view(np.uint64) - np.uint64(least & ((1 << 64) - 1))) if len(doc_ids) else np.zeros(0, np.uint64)
    head = HEAD.pack(MAGIC, ids.dtype.itemsize, len(bounds) - 1, nulls, len(ids), least)
    return b"".join([_padded(head), ef_encode(bounds - bounds[0]), ef_encode(named), ids.tobytes()])


class Shard:
    """Reads a shard through ``read(offset, size)``: ``bounds``, ``doc_ids`` and ``ids`` of a range of documents."""

    def __init__(self, read):
        magic, self.width, self.n, self.nulls, self.size, self.least = HEAD.unpack(read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.read = read
        self.ends = Sequence(read, len(_padded(bytes(HEAD.size))))
        self.named = Sequence(read, self.ends.end)
        self.at_ids = self.named.end

    @classmethod
    def of(cls, raw: bytes) -> Shard:
        return cls(lambda at, size: raw[at : at + size])

    def bounds(self, first: int = 0, stop: int | None = None) -> np.ndarray:
        """Boundaries of documents [first, stop), one more than there are."""
        return self.ends.values(first, (self.n if stop is None else stop) + 1).astype(np.int64)

    def doc_ids(self) -> pa.Array:
        named = (self.named.values(0, self.named.n) + np.uint64(self.least & ((1 << 64) - 1))).view(np.int64)
        return pa.concat_arrays([pa.nulls(self.nulls, pa.int64()), pa.array(named, pa.int64())])

    def doc(self, i: int) -> np.ndarray:
        a, b = self.bounds(i, i + 1).tolist()
        return np.frombuffer(self.read(self.at_ids + a * self.width, (b - a) * self.width), f"<u{self.width}")


def _writer(path: str, kind: str, end: int, folder: str):
    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        enc = encoder(path, kind)
        held, size = [], 0

        def flush():
            nonlocal held, size, seq
            ids, sizes = np.concatenate([x for x, _, _ in held]), np.concatenate([n for _, n, _ in held])
            docs = pa.concat_arrays([d for _, _, d in held])
            raw = pack_shard(ids, np.concatenate([[0], np.cumsum(sizes)]), docs.drop_null().to_numpy(), docs.null_count)
            name = f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.eft"
            with opened(name, "wb") as f:
                f.write(raw)
            out = pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, seq, name, len(docs), len(ids))], ["task", "seq", "file", "n_docs", "n_ids"])
            held, size, seq = [], 0, seq + 1
            return out

        for batch in batches:
            for a, b in slices(batch.column(1), TEXT_BYTES):
                piece = batch.slice(a, b - a)
                ids, bounds = closed(*enc.encode(piece.column(1)), end)
                a = 0
                while a < len(piece):  # as many documents as the shard has room for, one at least
                    b = min(int(np.searchsorted(bounds, bounds[a] + SHARD_IDS - size, side="right")) - 1, a + SHARD_DOCS - sum(len(d) for _, _, d in held))
                    b = max(b, a)
                    if b == a and held:
                        yield flush()
                        continue
                    b = max(b, a + 1)
                    held.append((ids[bounds[a] : bounds[b]], np.diff(bounds[a : b + 1]), piece.column(0).slice(a, b - a)))
                    size += int(bounds[b] - bounds[a])
                    a = b
                trim()
        if held:
            yield flush()

    return run


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, kind: str = "word", end: int = END_ID) -> DataFrame:
    """Shard files of all documents in ascending id order, in the shared folder; one row a file: task, seq, file, n_docs, n_ids.

    Files ascend by (task, seq). The range shuffle carries texts, not ids, as its
    sampling pass would tokenize everything again; a hash of the text parts rows that repeat an id.
    Very long texts are encoded whole, in windows, and stand in one file. Null texts are empty, null ids
    come first. Other columns, whatever their names, are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc(), F.col("text").asc_nulls_first()]
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    folder = f"{work_dir(docs.sparkSession)}/pulsegrid/shards-{uuid.uuid4().hex}"
    return staged(rows.mapInArrow(frugal(_writer(path or public_path(WORD_BPE), kind, end, folder), encodes=True), "task long, seq long, file string, n_docs long, n_ids long"), "shards")


def _reader(batches):
    for batch in batches:
        for base, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with opened(name, "rb") as f:
                raw = f.read()
            s = Shard.of(raw)
            b = s.bounds()
            at = b.tolist()
            wide = memoryview(np.frombuffer(raw, f"<u{s.width}", s.size, s.at_ids).astype("<u4")).cast("B")
            crc = [zlib.crc32(wide[4 * x : 4 * y]) for x, y in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([s.doc_ids(), *(pa.array(x, pa.int64()) for x in (base + b[:-1], np.diff(b), crc))], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files' own bytes: doc_id, start (ids before it), n_tokens, ids_crc32.

    Empty and null texts hold the end id alone. Null ids come first; rows that
    repeat an id follow one another, equal texts side by side. An empty table gives no rows.
    """
    # one row a task under the unpartitioned window
    tasks = shards.groupBy("task").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    tasks = tasks.select(F.col("task").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("ahead"))
    inside = W.partitionBy("task").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    based = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(inside), F.lit(0).cast("long"))).join(tasks, F.col("task") == F.col("of"))
    files = staged(based.select((F.col("base") + F.col("ahead")).alias("base"), "file"), "bases")
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(spread, "file").mapInArrow(frugal(_reader), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir):
    return read_shards(write_shards(table(spark, sf_dir, "documents")))
