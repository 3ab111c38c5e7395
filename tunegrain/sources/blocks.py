"""Records of text files of any length, cut by many tasks at once.

A file is scanned in splits, like any text file, with a separator that is frequent in the format. What a split's first
byte means depends on all before it. So the splits of a long file are first summed up: each says what it does to the state
of the reader, for every state it may begin in. These sums are composed in the order of the splits, which
gives each split its true state, and a second scan cuts the records. Records that cross a
border are put together from their pieces; there are at most two pieces a split.

Files that can't have been split need no sums and are cut in one scan. A walker of a split is an object with
``feed(pieces)`` and ``end()``, which yield rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunegrain.sources.files import FileSet, file_id

#: A record, or a piece of one that begins before (HEAD) or goes on after (TAIL) its split; what stands around the records; a mark.
WHOLE, TAIL, HEAD, AROUND, MARK = range(5)
CUT = "kind int, fid bigint, block bigint, seq bigint, tag int, home bigint, spot bigint, text binary"
CUT_NAMES = ("kind", "fid", "block", "seq", "tag", "home", "spot", "text")
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

#: Numbers of a split's rows stay below this.
ROWS_AT_ONCE = 1 << 16


def splits(spark: SparkSession, files_: FileSet, separator: str, long: bool) -> DataFrame:
    """``fid, block, value``: pieces between separators in the order of each split, of files that may have been split or the others.

    Both passes over the long files plan the same splits, since they scan the same files.
    """
    least = min(int(_bytes(spark, "spark.sql.files.openCostInBytes")), int(_bytes(spark, "spark.sql.files.maxPartitionBytes")))
    size = F.col("_metadata.file_size")
    scan = spark.read.format("text").options(**files_.options(), lineSep=separator).load(list(files_.paths))
    scan = scan.where(size > least if long else size <= least)
    return scan.select(file_id(F.col("_metadata.file_path")).alias("fid"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _bytes(spark: SparkSession, key: str) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)))


@contextmanager
def same_splits(spark: SparkSession) -> Iterator[None]:
    """Files are split alike by every scan inside, even if executors come or go meanwhile."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def walked(scan: DataFrame, walker: Callable[[int, int, str | None], Any], schema: str = CUT, kinds: tuple = _KINDS, names: tuple = CUT_NAMES) -> DataFrame:
    """The rows that walkers give for all splits. ``scan`` may have a column ``start`` with the state of each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, walk, held = None, None, []

        def given() -> Iterator[pa.RecordBatch]:
            while held:
                part = held[:ROWS_AT_ONCE]
                del held[:ROWS_AT_ONCE]
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*part), kinds)], names=list(names))

        for batch in batches:
            fids, blocks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            values = batch.column(2).to_pylist()
            borders = [0, *((fids[1:] != fids[:-1]) | (blocks[1:] != blocks[:-1])).nonzero()[0] + 1, len(fids)] if len(fids) else []
            for low, high in zip(borders, borders[1:]):
                here = (int(fids[low]), int(blocks[low]))
                if here != at:
                    if walk is not None:
                        held.extend(walk.end())
                    start = batch.column(3)[int(low)].as_py() if batch.num_columns > 3 else None
                    if batch.num_columns > 3 and start is None and here[1] > 0:
                        raise RuntimeError("the files were split anew between two scans")
                    at, walk = here, walker(*here, start)
                held.extend(walk.feed(values[low:high]))
            yield from given()
        if walk is not None:
            held.extend(walk.end())
        yield from given()

    return scan.mapInArrow(run, schema)


def with_starts(scan: DataFrame, starts: DataFrame) -> DataFrame:
    """The scan with each split's state (``fid, block, start``); the first split of a file has none.

    Starts are one short row for each split beyond a file's first, so less than a millionth of the text: small
    enough to be sent to all tasks, which have to read a split's pieces in order.
    """
    return scan.join(F.broadcast(starts), ["fid", "block"], "left").select("fid", "block", "value", "start")


def whole_records(cut: DataFrame) -> DataFrame:
    """``fid, block, seq, tag, home, spot, text`` of all records: those within a split, and those put together over borders."""
    columns = ["fid", "block", "seq", "tag", "home", "spot", "text"]
    pieces = cut.where(F.col("kind").isin(TAIL, HEAD))
    # At most two pieces a split; a head belongs to the last tail before it.
    before = Window.partitionBy("fid").orderBy("block", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    tail = F.when(F.col("kind") == TAIL, F.struct("block", "seq", "tag", "home", "spot"))
    owned = pieces.select("fid", "block", "kind", "text", F.last(tail, ignorenulls=True).over(before).alias("own"))
    texts = F.sort_array(F.collect_list(F.struct("block", (-F.col("kind")).alias("order"), "text")))
    joined = owned.groupBy("fid", "own").agg(texts.alias("parts"))
    text = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["text"]))
    crossing = joined.where(F.col("own").isNotNull()).select("fid", "own.*", text.alias("text"))
    return cut.where(F.col("kind") == WHOLE).select(*columns).unionByName(crossing.select(*columns))


def around(cut: DataFrame) -> DataFrame:
    """``fid, text``: what stands around the records of each file, in order."""
    parts = cut.where(F.col("kind") == AROUND).groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "text"))).alias("parts"))
    return parts.select("fid", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["text"])).alias("text"))


def placed(records: DataFrame) -> DataFrame:
    """Records with the position columns of all readers."""
    return records.select(F.col("fid").alias("_file"), F.col("block").alias("_block"), F.col("seq").alias("_pos"), "tag", "home", "spot", "text")
