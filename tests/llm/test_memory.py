"""What a task of the pipeline holds at once."""

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofmark.llm import common, packing

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "rows"])


@pytest.fixture
def limit(spark):
    """The session's own limit is as it was when the test ends."""
    before = spark.conf.get(LIMIT)
    yield before
    spark.conf.set(LIMIT, before)


def test_stages_take_small_batches(spark, limit, monkeypatch):
    """All rows come, in batches of few MB, though they lie in one partition."""
    monkeypatch.setattr(packing, "pack", lambda docs, *_: docs.select("text").mapInArrow(sizes, "size long, rows long"))
    docs = spark.range(0, 120, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 100_000).alias("text"))
    got = dict(corpus_pipeline.STAGES)["packing"](spark, docs, "").collect()
    assert sum(r["rows"] for r in got) == 120
    assert max(r["size"] for r in got) < common.BATCH_BYTES + 300_000


def test_lower_limit_stays(spark, limit):
    for given, then in (("1m", "1m"), ("64m", f"{common.BATCH_BYTES}b")):
        spark.conf.set(LIMIT, given)
        common.small_batches(spark)
        assert spark.conf.get(LIMIT) == then
