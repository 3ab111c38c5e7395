"""How much text goes to Python at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tunegrain import session
from tunegrain.llm import toxicity


@pytest.fixture
def usual_bound(spark):
    spark.conf.set(session.ARROW_BYTES, "64m")
    yield
    spark.conf.unset(session.ARROW_BYTES)


def test_texts_go_to_python_in_small_batches(spark, usual_bound):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    docs = spark.range(0, 6000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(" ")), 30).alias("text"))
    # Everything scores alike, below the cut.
    model = toxicity.Model(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), None, np.zeros(1), np.zeros(1))
    # The frame is written by someone else: what counts is the session's bound by then.
    kept = toxicity.keep_clean(docs, model)
    found = kept.mapInArrow(sizes, "n bigint, size bigint").agg(F.sum("n").alias("n"), F.max("size").alias("most")).first()
    assert found.n == 6000
    assert found.most <= session.BATCH_BYTES + 10_000


def test_a_lower_bound_stays(spark, usual_bound):
    spark.conf.set(session.ARROW_BYTES, "100k")
    session.bound_batches(spark.range(1))
    assert spark.conf.get(session.ARROW_BYTES) in ("100k", "102400b")
