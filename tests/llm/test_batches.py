"""Batches of long texts are bounded by bytes, not by rows alone."""

import pyarrow as pa
import pytest

import corpus_pipeline
from pulsegrid.llm import common, ngram_join, packing


def _largest(df):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    return max(r.n for r in df.mapInArrow(sizes, "n long").collect())


@pytest.mark.parametrize("run", [packing.pack, ngram_join.jaccard_components, lambda df: corpus_pipeline.identify(df.sparkSession, df, "")])
def test_long_texts_come_in_bounded_batches(spark, run):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    df = spark.range(0, 1200, 1, 1).selectExpr("id AS doc_id", "concat('w', id, ' ', repeat('of the and ', 1000)) AS text", "if(id % 2 = 0, 'en', 'xx') AS lang")
    assert _largest(df) > 2 * common.BATCH_BYTES
    run(df.where("doc_id < 20"))
    assert _largest(df) < 1.25 * common.BATCH_BYTES
    spark.conf.set(key, str(1 << 20))
    run(df.where("doc_id < 20"))
    assert int(spark.conf.get(key).rstrip("b")) == 1 << 20
    spark.conf.unset(key)
