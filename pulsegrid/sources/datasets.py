"""Registry of recording sources, and readers of text-based layouts.

A loader takes (spark, root) and returns (recordings, samples) DataFrames.
Video decoding is left to an upstream producer: these read what is text.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pulsegrid.operators import windows

_LOADERS: dict[str, Callable] = {}


def register(name: str):
    def wrap(f):
        _LOADERS[name] = f
        return f

    return wrap


def available(config: str | None = None) -> dict[str, str | None]:
    """Each source's root, or None where the JSON configuration leaves it empty."""
    roots = json.loads(Path(config).read_text()) if config else {}
    return {k: roots.get(k) or None for k in sorted(_LOADERS)}


def load(spark: SparkSession, name: str, root: str) -> tuple[DataFrame, DataFrame]:
    if name not in _LOADERS:
        raise ValueError(f"unknown source {name!r}; there are {sorted(_LOADERS)}")
    if not root:
        raise ValueError(f"{name} has no root configured")
    return _LOADERS[name](spark, root)


@register("three_row_text")
def three_row_text(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``<subject>/ground_truth.txt``: a row of waveform, one of rates and one of stamps."""
    lines = spark.read.text(f"{root}/*/ground_truth.txt", wholetext=True).withColumn("path", F.input_file_name())
    rows = lines.select(F.element_at(F.split("path", "/"), -2).alias("recording_id"), F.split(F.trim("value"), "\n").alias("l"))
    parts = [F.transform(F.split(F.trim(F.col("l")[k]), r"\s+"), lambda v: v.try_cast("double")) for k in (0, 1, 2)]
    s = rows.select("recording_id", F.posexplode(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("bvp", "hr", "t"), strict=True)])).alias("j", "v"))
    return with_rate(s.select("recording_id", "j", *[F.col("v")[n].alias(n) for n in ("bvp", "hr", "t")]))


@register("nested_json")
def nested_json(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``*.json`` with /FullPackage[].{Timestamp, Value.waveform, Value.pulseRate}, stamps in nanoseconds."""
    raw = spark.read.schema("`/FullPackage` array<struct<Timestamp:bigint,Value:struct<waveform:double,pulseRate:double>>>").json(f"{root}/*/*.json", multiLine=True)
    rows = raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("recording_id"), F.posexplode("`/FullPackage`").alias("j", "p"))
    return with_rate(rows.select("recording_id", "j", F.col("p.Value.waveform").alias("bvp"), F.col("p.Value.pulseRate").alias("hr"), (F.col("p.Timestamp") / 1e9).alias("t")))


@register("task_csv")
def task_csv(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``<subject>/bvp_<subject>_T<task>.csv``: one value a line at 64 Hz; both tasks of a subject share its id."""
    lines = spark.read.text(f"{root}/*/bvp_*.csv").select("value", F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("o"))
    name = F.regexp_extract("path", r"bvp_([^/]+)_(T\d)\.csv$", 1), F.regexp_extract("path", r"bvp_([^/]+)_(T\d)\.csv$", 2)
    rows = lines.select(F.concat_ws("_", *name).alias("recording_id"), name[0].alias("subject_id"), name[1].alias("task"), F.trim("value").try_cast("double").alias("bvp"), "o")
    rows = rows.withColumn("j", F.row_number().over(W.partitionBy("recording_id").orderBy("o")) - 1).withColumn("t", F.col("j") / 64.0)
    rec = rows.groupBy("recording_id", "subject_id", "task").agg(F.count("*").alias("n_samples"), F.lit(64.0).alias("fps"))
    return rec, rows.select("recording_id", "j", "bvp", "t")


@register("keyed_csv")
def keyed_csv(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``db.csv`` keyed (patient, camera, step) beside ``ppg/<patient>_<camera>_<step>.txt``; recordings without a trace stay.

    ``meta/<same name>.txt`` has a frame's number and its ISO time a line: they give samples their stamps t (seconds from the first) and recordings their measured ``fps``,
    null under ten stamps. Samples without a stamp have none; ``align.resampled`` brings them onto an even base.
    """
    meta = spark.read.csv(f"{root}/db.csv", header=True)
    lines = spark.read.text(f"{root}/ppg/*.txt").select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("recording_id"), F.monotonically_increasing_id().alias("o"))
    rows = lines.withColumn("j", F.row_number().over(W.partitionBy("recording_id").orderBy("o")) - 1).select("recording_id", "j", F.split(F.trim("value"), r"\s+")[0].try_cast("double").alias("bvp"))
    stamps = _stamps(spark, root)
    if stamps is None:
        rows = rows.withColumn("t", F.lit(None).cast("double"))
        rate = rows.select("recording_id").distinct().withColumn("fps", F.lit(None).cast("double"))
    else:
        rate = windows.measured_fps(stamps, ["recording_id"], "t").select("recording_id", "fps")
        first = stamps.groupBy("recording_id").agg(F.min("t").alias("t0"))
        rows = rows.join(stamps.join(first, "recording_id").select("recording_id", "j", (F.col("t") - F.col("t0")).alias("t")), ["recording_id", "j"], "left")
    per = rows.groupBy("recording_id").agg(F.count("*").alias("n_samples")).join(rate, "recording_id", "left")
    return meta.withColumn("recording_id", F.concat_ws("_", "patient", "camera", "step")).join(per, "recording_id", "left"), rows


def _stamps(spark: SparkSession, root: str) -> DataFrame | None:
    """(recording_id, j, t in seconds) of ``meta/*.txt``: lines of number and time, in the files' order; others drop out. None without such files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/meta")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    lines = spark.read.text(f"{root}/meta/*.txt").select(F.trim("value").alias("value"), F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("recording_id"), F.monotonically_increasing_id().alias("o"))
    at = F.regexp_extract("value", r"^\d+\s+(\S.*)$", 1).try_cast("timestamp")
    good = lines.select("recording_id", "o", (F.unix_micros(at) / F.lit(1e6)).alias("t")).where("t IS NOT NULL")
    return good.withColumn("j", F.row_number().over(W.partitionBy("recording_id").orderBy("o")) - 1).drop("o")


@register("oximeter_xmp")
def oximeter_xmp(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``<subject>/*.xmp``: CSV lines of stamp in milliseconds, rate, saturation and waveform; lines that aren't numbers drop out."""
    lines = spark.read.text(f"{root}/*/*.xmp").select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("recording_id"), F.split("value", ",").alias("v"))
    cell = lambda k: F.trim(F.get("v", k)).try_cast("double")
    rows = lines.select("recording_id", (cell(F.lit(0)) / 1000).alias("t"), cell(F.lit(1)).alias("hr"), cell(F.lit(2)).alias("spo2"), cell(F.lit(3)).alias("bvp")).where("t IS NOT NULL AND bvp IS NOT NULL")
    j = F.row_number().over(W.partitionBy("recording_id").orderBy("t")) - 1
    return with_rate(rows.withColumn("j", j).select("recording_id", "j", "bvp", "hr", "spo2", "t"))


def skin_conductance(spark: SparkSession, root: str, fps: float = 4.0) -> DataFrame:
    """``<subject>/eda_<subject>_T<task>.csv`` beside ``task_csv``: recording_id, subject_id, task, j, t and eda, one value a line."""
    lines = spark.read.text(f"{root}/*/eda_*.csv").select("value", F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("o"))
    name = [F.regexp_extract("path", r"eda_([^/]+)_(T\d)\.csv$", k) for k in (1, 2)]
    rows = lines.select(F.concat_ws("_", *name).alias("recording_id"), name[0].alias("subject_id"), name[1].alias("task"), F.trim("value").try_cast("double").alias("eda"), "o")
    rows = rows.withColumn("j", F.row_number().over(W.partitionBy("recording_id").orderBy("o")) - 1)
    return rows.withColumn("t", F.col("j") / F.lit(fps)).drop("o")


def image_sequence(spark: SparkSession, root: str, fps: float) -> DataFrame:
    """Frames kept as one image file each, ``<recording>/<name>``: recording_id, i (by name), t, path and content, read as binary files.

    Content is read only where it is selected; ``ingest.extract`` takes frames decoded from it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,ppm,pgm}").option("recursiveFileLookup", "true").load(root)
    rows = files.select(F.element_at(F.split("path", "/"), -2).alias("recording_id"), "path", "content", "length")
    number = F.regexp_extract("path", r"(\d+)\.[^./]+$", 1).try_cast("long")  # frame2 before frame10
    i = (F.row_number().over(W.partitionBy("recording_id").orderBy(number.asc_nulls_last(), "path")) - 1).cast("long")
    order = rows.select("recording_id", "path", i.alias("i"))  # places without contents in the sort
    return order.join(rows.select("path", "content", "length"), "path").select("recording_id", "i", (F.col("i") / F.lit(float(fps))).alias("t"), "path", "content", "length")


def images(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Frames kept as one image file each, ``<recording>/<name>``, decoded by Spark: recording_id, path, height, width, channels and pixels (rows of B, G, R bytes).

    Files that aren't images drop out. ``ingest.measure_images`` measures them where they are read.
    """
    read = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)
    path = F.col("image.origin")
    return read.select(F.element_at(F.split(path, "/"), -2).alias("recording_id"), path.alias("path"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("pixels"))


def with_rate(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recordings with fps = 1 / median positive interval, and the samples."""
    dt = samples.withColumn("dt", F.col("t") - F.lag("t").over(W.partitionBy("recording_id").orderBy("j")))
    rec = dt.groupBy("recording_id").agg(F.count("*").alias("n_samples"), (1.0 / F.nullif(F.median(F.when(F.col("dt") > 0, F.col("dt"))), F.lit(0.0))).alias("fps"))
    return rec, samples
