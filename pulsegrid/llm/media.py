"""Media columns: byte payloads held losslessly as progressive JPEG, and RGB tensors read from them.

JPEG is lossy in samples and exact in quantised coefficients, so a payload's unit
is the coefficient: 64 bytes are the 64 coefficients of one block in scan
order. Byte b becomes b when it is 128 or more, else b - 255: all values have
eight bits, whose extra bits spell the byte. The image is 4:2:0; its first half or two thirds fill luma,
the rest blue and red chroma. Every plane comes in two spectral bands without its lowest bit, then a
successive-approximation pass adds that bit. A comment keeps the payload's size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import block_images, jpeg
from pulsegrid.llm.block_images import FLAT, PLANES, SCRIPT, UNIT, blocks_of, shape
from pulsegrid.llm.common import staged, table
from pulsegrid.llm.wordhash import slices

TEXT_BYTES = 2 << 20


def padded(raw: bytes) -> bytes:
    """``raw`` with zeros up to a positive multiple of ``UNIT``."""
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def to_jpeg(payload: bytes) -> bytes:
    """A payload whose size is a positive multiple of 64 as a progressive JPEG."""
    rows, cols = shape(len(payload))
    parts = [jpeg.Component(1, 2, 2, 0), jpeg.Component(2, 1, 1, 0), jpeg.Component(3, 1, 1, 0)]
    jpeg.layout(8 * cols, 8 * rows, parts)
    at = 0
    for part, n in zip(parts, blocks_of(rows, cols), strict=True):
        b = np.frombuffer(payload[at : at + UNIT * n].ljust(UNIT * n, b"\0"), np.uint8).astype(np.int32)
        part.coef[: part.rows, : part.cols] = np.where(b < 128, b - 255, b).reshape(part.rows, part.cols, UNIT)
        at += UNIT * n
    return jpeg.encode(jpeg.Image(8 * cols, 8 * rows, parts, FLAT, struct.pack(">Q", len(payload))), SCRIPT)


def from_jpeg(raw: bytes) -> tuple[bytes, np.ndarray]:
    """(payload, full-resolution RGB tensor) of a stored image."""
    image = jpeg.decode(raw)
    v = np.concatenate([c.coef[: c.rows, : c.cols].reshape(-1) for c in image.components])
    payload = np.where(v < 0, v + 255, v).astype(np.uint8).tobytes()
    return payload[: struct.unpack(">Q", image.comment)[0]], jpeg.to_rgb(image)


def _feature(width: int, height: int, totals: list[int], levels: np.ndarray) -> str:
    return f"{width}x{height};" + ",".join(str(t * 1000 // (width * height)) for t in totals) + ";" + format(zlib.crc32(levels.astype("<i8").tobytes()), "08x")


def feature(rgb: np.ndarray) -> str:
    """Size, mean colour in thousandths and a 16-level histogram digest of green of a tensor."""
    return _feature(rgb.shape[1], rgb.shape[0], rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist(), np.bincount((rgb[..., 1] >> 4).reshape(-1), minlength=16))


def payloads_and_features(raws: list[bytes]) -> tuple[list[bytes], list[str]]:
    """What stored images hold, for a batch at once; images of another make are read one by one."""
    found = block_images.read(raws)
    if found is None:
        both = [from_jpeg(raw) for raw in raws]
        return [p for p, _ in both], [feature(rgb) for _, rgb in both]
    coef, bounds, heads = found
    data = np.where(coef < 0, coef + 255, coef).astype(np.uint8).tobytes()
    payloads = [data[UNIT * a : UNIT * a + size] for a, (size, _, _) in zip(bounds[:-1:PLANES].tolist(), heads, strict=True)]
    pixels, image = block_images.rgb(coef, bounds, heads)
    first = np.searchsorted(image, np.arange(len(raws)))
    totals = np.add.reduceat(pixels.sum(axis=1, dtype=np.int64), first)
    levels = np.bincount((image[:, None] * 16 + (pixels[..., 1] >> 4)).reshape(-1), minlength=16 * len(raws)).reshape(-1, 16)
    return payloads, [_feature(8 * cols, 8 * rows, t, n) for (_, rows, cols), t, n in zip(heads, totals.tolist(), levels, strict=True)]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (unpadded) and media (JPEG bytes) of each row; null text is empty, and still one block.

    Rows that repeat an id, or have none, are rows of their own. A text is stored whole, whatever its length: beyond 1 MB its image has more block columns.
    An empty table gives no rows; other columns, whatever their names, are ignored.
    """

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), TEXT_BYTES):
                piece = batch.slice(a, b - a)
                raw = [t or b"" for t in piece.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(block_images.write([padded(t) for t in raw]), pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """What the stored bytes give back: payload digests, digests of the bytes themselves, and the tensor's feature.

    Equal texts have equal media and features; rows that repeat an id are rows of
    their own. A text is read whole: one of many megabytes is a batch by itself and
    takes about 20 bytes of memory for each of its own. An empty table gives no rows.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(2), TEXT_BYTES):
                piece = batch.slice(a, b - a)
                raws = piece.column(2).to_pylist()
                payloads, features = payloads_and_features(raws)
                digest = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                size = lambda xs: pa.array([len(x) for x in xs], pa.int64())
                tail = pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), size(payloads), digest(payloads), tail, size(raws), digest(raws), pa.array(features, pa.string())], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def tensors(media: DataFrame) -> DataFrame:
    """doc_id, height, width and rgb (row-major bytes, three a pixel) of stored images."""

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 64):
                piece = batch.slice(a, 64)
                rgb = [jpeg.to_rgb(jpeg.decode(raw)) for raw in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([x.shape[0] for x in rgb], pa.int32()), pa.array([x.shape[1] for x in rgb], pa.int32()), pa.array([x.tobytes() for x in rgb], pa.binary())], ["doc_id", "height", "width", "rgb"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, height int, width int, rgb binary")


def op6_media(spark, sf_dir):
    return read(staged(store(table(spark, sf_dir, "documents")), "media"))
