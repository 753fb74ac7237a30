"""A corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``:

1. language identification drops what the classifier rejects;
2. exact dedup keeps one row of each distinct text;
3. the n-gram Jaccard join keeps the smallest id of each group of near copies, by five words and a similarity of 0.8;
4. mixing repeats, cuts or drops rows so that sources meet their target weights;
5. packing returns the pieces of the sequences.

Null, empty and blank texts have no language and go with the first stage, as do texts of unlearned languages. Very long texts pass whole. Of rows that repeat
id and text one stays; rows that repeat an id with other texts are documents of their own, as are rows without an id, of which equal
texts keep one. Other columns pass unchanged up to packing, whatever their names. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import exact_dedup, language_id, mixing, ngram_join, packing
from pulsegrid.llm.common import staged, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.fit(docs))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, n=5, threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify),
    ("exact_dedup", dedup_exact),
    ("ngram_join", dedup_near),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express the classifier or the tokenizer; tests compare stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's result on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
