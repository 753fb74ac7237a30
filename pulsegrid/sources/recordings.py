"""Contact recordings as a data source: ``spark.read.format("recordings")``, and the same as a stream of recordings that arrive.

Options: ``path`` (the folder of recordings), ``layout`` (one of ``LAYOUTS``), ``chunk`` (bytes of a file that a partition takes, 4 MB). A partition is a stretch of
one file. Filters on ``recording_id`` (equal, in) choose files before any is opened, which also prunes partitions; filters on ``t`` are applied where a file
is read. Push-down needs ``spark.sql.python.filterPushdown.enabled``; without it results are the same.

As a stream a file is taken in once, by the time it was last changed and its path; ``maxFiles`` bounds a micro-batch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

SCHEMA = "recording_id string, j long, t double, bvp double, hr double"
_NAMES = ["recording_id", "j", "t", "bvp", "hr"]
CHUNK = 4 << 20


def _numbers(words: list[str]) -> np.ndarray:
    def one(w):
        try:
            return float(w)
        except ValueError:
            return np.nan

    return np.array([one(w) for w in words], float)


def _rows(text: str) -> dict[str, np.ndarray]:
    """A line of waveform, one of rates and one of stamps."""
    lines = [_numbers(line.split()) for line in text.strip().split("\n")[:3]]
    n = max(map(len, lines), default=0)
    lines = [np.pad(x, (0, n - len(x)), constant_values=np.nan) for x in [*lines, *[np.zeros(0)] * (3 - len(lines))]]
    return {"bvp": lines[0], "hr": lines[1], "t": lines[2]}


def _stamped(text: str) -> dict[str, np.ndarray]:
    """Lines of stamp in milliseconds, rate, saturation and waveform; lines that aren't numbers drop out."""
    cells = [line.split(",") for line in text.splitlines()]
    table = np.array([_numbers([c.strip() for c in row[:4]]) for row in cells if len(row) >= 4]).reshape(-1, 4)
    table = table[np.isfinite(table[:, [0, 3]]).all(axis=1)]
    table = table[np.argsort(table[:, 0], kind="stable")]
    return {"t": table[:, 0] / 1000, "hr": table[:, 1], "bvp": table[:, 3]}


def _even(text: str) -> dict[str, np.ndarray]:
    """A value a line at 64 Hz."""
    bvp = _numbers(text.split())
    return {"bvp": bvp, "t": np.arange(len(bvp)) / 64.0, "hr": np.full(len(bvp), np.nan)}


@dataclass(frozen=True)
class Layout:
    """Which files are recordings, by the end of their path (its first group names the recording), and how their text reads."""

    files: str
    parse: Callable[[str], dict[str, np.ndarray]]


LAYOUTS = {
    "three_row_text": Layout(r"([^/]+)/ground_truth\.txt$", _rows),
    "oximeter_xmp": Layout(r"([^/]+)/[^/]+\.xmp$", _stamped),
    "task_csv": Layout(r"bvp_([^/]+_T\d)\.csv$", _even),
}


@dataclass(frozen=True)
class Stretch(InputPartition):
    """Samples from ``part`` to ``part + 1`` of ``parts`` equal stretches of a file."""

    path: str
    recording: str
    part: int = 0
    parts: int = 1


@dataclass(frozen=True)
class File:
    path: str
    recording: str
    size: int
    changed: int


def _files(path: str, layout: Layout) -> list[File]:
    """Recordings under a folder, local or of any store that Arrow opens, by when they were changed."""
    from pyarrow import fs

    if ":" not in path.split("/", 1)[0] or path.startswith("file:"):
        store, root, prefix = fs.LocalFileSystem(), re.sub("^file:/*", "/", path), ""
    else:
        store, root = fs.FileSystem.from_uri(path)
        prefix = path[: len(path) - len(root)] if path.endswith(root) else path.split("://", 1)[0] + "://"
    found = store.get_file_info(fs.FileSelector(root.rstrip("/"), recursive=True))
    out = [File(prefix + f.path, m[1], f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and (m := re.search(layout.files, f.path))]
    return sorted(out, key=lambda f: (f.changed, f.path))


def _text(path: str) -> str:
    from pyarrow import fs

    store, at = (fs.LocalFileSystem(), path) if ":" not in path.split("/", 1)[0] else fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        return f.read().decode("utf-8", "replace")


def _layout(options: dict) -> Layout:
    name = options.get("layout", "three_row_text")
    if name not in LAYOUTS:
        raise ValueError(f"unknown layout {name!r}; there are {sorted(LAYOUTS)}")
    if "path" not in options:
        raise ValueError("the recordings source needs a path")
    return LAYOUTS[name]


class _Reading:
    """What both readers share: files to partitions, and a partition to batches."""

    def __init__(self, options: dict):
        self.path, self.layout, self.chunk = options.get("path", ""), _layout(options), int(options.get("chunk", CHUNK))
        self.low, self.high = -np.inf, np.inf

    def stretches(self, files: list[File]) -> list[Stretch]:
        parts = [(f, max(1, -(-f.size // self.chunk))) for f in files]
        return [Stretch(f.path, f.recording, k, n) for f, n in parts for k in range(n)]

    def batches(self, s: Stretch) -> Iterator[pa.RecordBatch]:
        columns = self.layout.parse(_text(s.path))
        n = len(columns["bvp"])
        here = np.arange(n * s.part // s.parts, n * (s.part + 1) // s.parts)
        t = columns["t"][here]
        here = here[~((t < self.low) | (t > self.high))]
        floats = [pa.array(columns[c][here], pa.float64(), from_pandas=True) for c in ("t", "bvp", "hr")]
        yield pa.RecordBatch.from_arrays([pa.array([s.recording] * len(here), pa.string()), pa.array(here, pa.int64()), *floats], _NAMES)


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.reading, self.only = _Reading(options), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes recordings by name; bounds of ``t`` narrow what is read and are checked again by Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("recording_id",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = names if self.only is None else self.only & names
                continue
            if getattr(f, "attribute", None) == ("t",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.reading.low = max(self.reading.low, float(f.value))
                if isinstance(f, (LessThan, LessThanOrEqual)):
                    self.reading.high = min(self.reading.high, float(f.value))
            yield f

    def partitions(self) -> list[Stretch]:
        files = _files(self.reading.path, self.reading.layout)
        return self.reading.stretches([f for f in files if self.only is None or f.recording in self.only])

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return self.reading.batches(partition) if isinstance(partition, Stretch) else iter(())  # without files Spark asks for nothing


class RecordingStream(DataSourceStreamReader):
    """Offsets are the last file taken in: when it was changed, and its path."""

    def __init__(self, options: dict):
        self.reading, self.most = _Reading(options), int(options.get("maxFiles", 1000))
        self.last = None

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def _after(self, offset: dict) -> list[File]:
        key = (offset["changed"], offset["path"])
        return [f for f in _files(self.reading.path, self.reading.layout) if (f.changed, f.path) > key]

    def latestOffset(self) -> dict:
        start = self.last or self.initialOffset()
        new = self._after(start)[: self.most]
        self.last = {"changed": new[-1].changed, "path": new[-1].path} if new else start
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        self.last = end if self.last is None or (end["changed"], end["path"]) > (self.last["changed"], self.last["path"]) else self.last
        key = (end["changed"], end["path"])
        return self.reading.stretches([f for f in self._after(start) if (f.changed, f.path) <= key])

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return self.reading.batches(partition)

    def commit(self, end: dict) -> None:
        json.dumps(end)  # nothing is held back


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RecordingReader:
        return RecordingReader(dict(self.options))

    def streamReader(self, schema: StructType) -> RecordingStream:
        return RecordingStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)
