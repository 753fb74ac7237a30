"""What the corpus operators share: the shared work folder, staged tables and word definitions."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.staging import shared_folder

#: Bytes of a batch that passes between Spark and Python.
BATCH_BYTES = 4 << 20
#: A word: a maximal run of characters other than space and the five ASCII white-space controls.
WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; on a cluster it must be set."""
    return shared_folder(spark)


def clean_up(spark: SparkSession) -> None:
    """Removes the tables and files that jobs staged in the shared folder; results that still read them become unreadable."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/pulsegrid")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def opened(name: str, mode: str):
    """A binary file of the shared folder, by path or URI; its folder is made if need be."""
    from pyarrow import fs

    if ":" not in name.split("/", 1)[0] or name.startswith("file:"):
        store, path = fs.LocalFileSystem(), re.sub("^file:/*", "/", name)
    else:
        store, path = fs.FileSystem.from_uri(name)
    if mode == "rb":
        return store.open_input_file(path)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path)


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back: later passes reread files instead of recomputing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/pulsegrid/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def every(df: DataFrame) -> list:
    """Columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text) -> F.col:
    """Words of a text column; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lean(docs: DataFrame) -> None:
    """Bounds the session's Arrow batches by ``BATCH_BYTES``: by rows alone, 10,000 long texts stand several times in executors and workers. A lower bound stays."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    had = re.fullmatch(r"(\d+)b?", conf.get(key, None) or "", re.IGNORECASE)
    if not had or not 0 < int(had[1]) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Hands freed memory back to the system: allocators keep what large arrays leave."""
    gc.collect()
    trim()


def trim() -> None:
    """As ``release``, without looking for cycles: quick enough after every slice of a batch."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def frugal(run, encodes: bool = False):
    """A task function over batches that ends with ``release``: workers live on between tasks and stages.

    Unless it ``encodes``, it first drops tokenizers and their memos, which an earlier stage's tasks left.
    """

    @functools.wraps(run)
    def wrapped(batches):
        tokens = sys.modules.get("pulsegrid.llm.tokens")
        if tokens is not None and tokens._encoders and not encodes:
            tokens._encoders.clear()
            release()
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
