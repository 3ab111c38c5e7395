"""Incremental preparation of newly arriving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tunegrain.operators import normalize as norm
from tunegrain.operators import validate
from tunegrain.schema import FieldMapping


def measured_stream(
    raw: DataFrame, mapping: FieldMapping, row_id: str = "row_id",
    max_seq_length: int = validate.DEFAULT_MAX_SEQ_LENGTH, keep: tuple[str, ...] = (),
) -> DataFrame:
    """The same row-local normalization and measuring as in batch."""
    return validate.measure(norm.normalize(raw, mapping, row_id, keep), max_seq_length)


def distinct_stream(measured: DataFrame, event_time: str | None = None, within: str | None = None) -> DataFrame:
    """Usable rows with a text not seen before.

    State holds one digest per distinct text and grows with them, unless ``event_time`` and
    ``within`` name a time column and a bound after which a text may be seen again.
    """
    rows = measured.where(F.col("drop_reason").isNull())
    if event_time and within:
        return rows.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["dup_key"])
    return rows.dropDuplicates(["dup_key"])


def append_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
