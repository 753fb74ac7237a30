"""Decoded frames to frame rows: the optional pixel stage before everything else.

Input rows hold recording_id, i, pixels (row-major RGB bytes), height, width and
a face struct<x, y, w, h> or null; ``measure_images`` takes image files and finds
the faces itself. Pixels are dropped here and never stored, unless a caller asks
for face crops.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.functions import scoring as sc
from pulsegrid.functions import vision_np as vi
from pulsegrid.sources import datasets
from pulsegrid.staging import staged

COMPRESSION_EVERY = 15
_RAW = (
    "recording_id long, i long, valid boolean, face double, r double, g double, b double, skin_fraction double, mean_luma double, clipped_fraction double, "
    "detail double, chroma_ratio double, blockiness double, openness double, cx double, cy double, face_width double"
)


def _measure(frame: np.ndarray, box: tuple | None, confidence: float, compressed: bool) -> dict:
    out = {"valid": False, "face": 0.0}
    if compressed:
        out |= {"chroma_ratio": vi.chroma_ratio(frame), "blockiness": vi.blockiness(frame)}
    if box is None:
        return out
    y, clipped = vi.exposure(frame, box)
    out |= {"face": confidence, "mean_luma": y, "clipped_fraction": clipped, "detail": vi.detail(frame, box), "openness": vi.eye_openness(frame, box)}
    out |= {"cx": box[0] + box[2] / 2, "cy": box[1] + box[3] / 2, "face_width": box[2]}
    if (found := vi.Faces(frame[None], [box]).colours()[0]) is not None:
        out |= {"valid": True, "skin_fraction": found["skin_fraction"]} | dict(zip("rgb", found["rgb"], strict=True))
    return out


def measure(images: DataFrame) -> DataFrame:
    """Raw measurements of each frame, before any neighbour is looked at."""
    names = [c.split()[0] for c in _RAW.split(", ")]

    def one(row):
        frame = np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width, 3)
        box = None if row.face is None else tuple(float(row.face[k]) for k in ("x", "y", "w", "h"))
        return {"recording_id": row.recording_id, "i": row.i} | _measure(frame, box, 1.0, row.i % COMPRESSION_EVERY == 0)

    def run(batches):
        for pdf in batches:
            rows = pd.DataFrame([one(r) for r in pdf.itertuples(index=False)], columns=names)
            yield rows.astype({"valid": bool})

    return images.select("recording_id", "i", "pixels", "height", "width", "face").mapInPandas(run, _RAW)


def _frame(row) -> np.ndarray:
    """RGB of a row of ``datasets.images``, whose bytes are grey, BGR or BGR with opacity."""
    px = np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width, row.channels)
    return np.repeat(px, 3, axis=2) if row.channels == 1 else np.ascontiguousarray(px[..., 2::-1])


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``i``, a frame's place in its recording: frame2 before frame10."""
    number = F.regexp_extract("path", r"(\d+)\.[^./]+$", 1).try_cast("long")
    order = W.partitionBy("recording_id").orderBy(number.asc_nulls_last(), "path")
    return rows.withColumn("i", (F.row_number().over(order) - 1).cast("long"))


def measure_images(images: DataFrame, detector: str = "skin") -> DataFrame:
    """Raw measurements of frames of ``datasets.images``, faces found by ``detector`` (``vision_np.find_face``).

    Pixels are measured by the task that reads them; only measurements are shuffled to number the frames. Compression is
    therefore measured on all frames and kept for every ``COMPRESSION_EVERY``-th.
    """
    schema = _RAW.replace("recording_id long, i long", "recording_id string, path string")
    names = [c.split()[0] for c in schema.split(", ")]

    def one(row):
        frame = _frame(row)
        box, sure = vi.find_face(frame, detector) or (None, 0.0)
        return {"recording_id": row.recording_id, "path": row.path} | _measure(frame, box, sure, True)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([one(r) for r in pdf.itertuples(index=False)], columns=names).astype({"valid": bool})

    rows = _numbered(images.select("recording_id", "path", "pixels", "height", "width", "channels").mapInPandas(run, schema))
    kept = {c: F.when(F.col("i") % COMPRESSION_EVERY == 0, F.col(c)) for c in ("chroma_ratio", "blockiness")}
    return rows.withColumns(kept).drop("path")


def crops(images: DataFrame, detector: str = "skin", size: int = 72) -> DataFrame:
    """(recording_id, i, crop): each frame's face as ``size`` x ``size`` RGB bytes; a frame without one repeats the crop before, black at first."""

    def one(row):
        frame = _frame(row)
        found = vi.find_face(frame, detector)
        return None if found is None else vi.face_crop(frame, found[0], size).tobytes()

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"recording_id": pdf["recording_id"], "path": pdf["path"], "crop": [one(r) for r in pdf.itertuples(index=False)]})

    cut = staged(images.select("recording_id", "path", "pixels", "height", "width", "channels").mapInPandas(run, "recording_id string, path string, crop binary"), "crops")
    # the window carries the place of the last face, and crops join it: no task sorts a recording's pixels
    before = W.partitionBy("recording_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    places = _numbered(cut.select("recording_id", "path", F.col("crop").isNotNull().alias("seen")))
    places = places.select("recording_id", "i", F.last(F.when(F.col("seen"), F.col("path")), ignorenulls=True).over(before).alias("path"))
    black = F.lit(bytes(3 * size * size))
    return places.join(cut, ["recording_id", "path"], "left").select("recording_id", "i", F.coalesce("crop", black).alias("crop"))


def trace(raw: DataFrame) -> DataFrame:
    """Frame rows with scores: compression carried forward, motion against the face before, none after a miss."""
    by = W.partitionBy("recording_id").orderBy("i")
    seen = by.rowsBetween(W.unboundedPreceding, 0)
    sampled = F.when(~F.isnan("chroma_ratio"), sc.compression(F.col("chroma_ratio"), F.col("blockiness")))
    step = F.sqrt(F.pow(F.col("cx") - F.lag("cx").over(by), F.lit(2.0)) + F.pow(F.col("cy") - F.lag("cy").over(by), F.lit(2.0)))
    out = raw.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("cx", "cy", "face_width", "mean_luma", "clipped_fraction", "detail", "openness", "skin_fraction", *"rgb")})
    out = out.withColumns({"compression": F.coalesce(F.last(sampled, ignorenulls=True).over(seen), F.lit(1.0)), "step": F.coalesce(step, F.lit(0.0))})
    return out.select(
        "recording_id", "i", *"rgb", "valid", "face", F.coalesce(sc.lighting(F.col("mean_luma"), F.col("clipped_fraction")), F.lit(0.0)).alias("lighting"),
        F.coalesce(sc.sharpness(F.col("detail")), F.lit(0.0)).alias("sharpness"), F.when(F.col("face_width").isNotNull(), sc.motion(F.col("step"), F.col("face_width"))).otherwise(F.lit(1.0)).alias("motion"),
        F.coalesce("skin_fraction", F.lit(0.0)).alias("skin_fraction"), "clipped_fraction", "compression", "openness",
    )


#: Recordings whose files are named to a reader at once.
NAMED = 500


def cached_traces(spark: SparkSession, root: str, cache: str, detector: str = "skin") -> DataFrame:
    """``trace`` of all image recordings under ``root``, kept in ``cache`` by recording; only new or changed ones are measured.

    A recording's key is a hash of its files' names, sizes and times, which a listing gives without opening a file. Recordings whose key isn't in the cache are
    measured and overwrite their own partition; those that are gone from ``root`` aren't returned. Pixels are never stored.
    """
    wanted = _keys(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(path) and any(f.getPath().getName().startswith("recording_id=") for f in files.listStatus(path)):
        held = spark.read.schema(_CACHED).parquet(cache).select("recording_id", "key").distinct()
        todo = wanted.join(held, ["recording_id", "key"], "left_anti")
    else:
        todo = wanted
    todo = staged(todo, "todo")
    batch = []
    for r in todo.toLocalIterator():
        batch.append(r.recording_id)
        if len(batch) == NAMED:
            _measured(spark, root, batch, todo, cache, detector)
            batch = []
    if batch:
        _measured(spark, root, batch, todo, cache, detector)
    if not todo.limit(1).count() and not wanted.limit(1).count():
        return spark.createDataFrame([], _CACHED).drop("key")
    rows = spark.read.schema(_CACHED).parquet(cache)
    return rows.join(wanted, ["recording_id", "key"], "left_semi").drop("key")


_CACHED = (
    "i long, r double, g double, b double, valid boolean, face double, lighting double, sharpness double, motion double, skin_fraction double, clipped_fraction double, compression double, openness double, "
    "key string, recording_id string"
)


def _keys(spark: SparkSession, root: str) -> DataFrame:
    """(recording_id, key) of the image files under ``root``, from their metadata alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,bmp,gif}").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime", "length")
    one = F.xxhash64("path", "modificationTime", "length")
    per = listed.groupBy(F.element_at(F.split("path", "/"), -2).alias("recording_id")).agg(F.count("*").alias("n"), F.bit_xor(one).alias("x"))
    return per.select("recording_id", F.concat_ws("-", "n", F.hex("x")).alias("key"))


def _measured(spark: SparkSession, root: str, names: list[str], todo: DataFrame, cache: str, detector: str) -> None:
    rows = trace(measure_images(datasets.images(spark, [f"{root.rstrip('/')}/{n}" for n in names]), detector))
    rows = rows.join(todo, "recording_id").select(*[c.split()[0] for c in _CACHED.split(", ")])
    rows.repartition("recording_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording_id").parquet(cache)
