"""The files that queries build from tables: as many as the tables' sizes ask for."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tunegrain import session
from tunegrain.plans import file_queries, stream_queries


@pytest.fixture
def built(spark, tmp_path, monkeypatch):
    """A folder with 600 documents of 40 texts and a tenth of their size as the size of a file; the files a query builds under a label."""
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.sha2((F.col("id") % 40).cast("string"), 256)).alias("text"), F.lit("en").alias("lang"))
    rows.repartition(24).write.parquet(str(tmp_path / "documents.parquet"))
    # A file costs a split at least, so that a small table has several, like a large one.
    monkeypatch.setattr(session, "FILE_BYTES", session.planned_bytes(spark.read.parquet(str(tmp_path / "documents.parquet"))) // 10)
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(key, "8000")
    for module in (file_queries, stream_queries):
        monkeypatch.setattr(module, "fresh_path", lambda _, label: str(tmp_path / label))
    yield str(tmp_path), lambda label: len([f for f in Path(tmp_path / label).iterdir() if f.name.startswith("part-")])
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


@pytest.mark.parametrize("name, label", [("text_reader", "texts"), ("json_reader", "json")])
def test_readers_files_grow_in_number(spark, built, name, label):
    folder, files = built
    rows = file_queries.QUERIES[name](spark, folder).collect()
    assert files(label) >= 10
    assert len(rows) == (40 if name == "text_reader" else 600)
    assert name != "text_reader" or {r.n for r in rows} == {15}


@pytest.mark.parametrize("name", ["stream_prepare", "stream_distinct"])
def test_arriving_files_grow_in_number(spark, built, name):
    folder, files = built
    rows = stream_queries.QUERIES[name](spark, folder).collect()
    assert files("arriving") >= 10
    assert len(rows) == (600 if name == "stream_prepare" else 40)
    batches = list(Path(folder, "measured" if name == "stream_prepare" else "distinct", "checkpoint", "commits").glob("[0-9]*"))
    assert len(batches) in (stream_queries.SLICES, stream_queries.SLICES + 1)
