"""Keyed state kept as mergeable tables, one per micro-batch.

A batch is reduced on its own and written under its batch id, so a replay overwrites what
it wrote before. Reading merges the newest full table with the later batches; a full table
is written every ``compact_every`` batches. The reduction must give the same answer when
applied to its own results (last-N per key, value at the latest time).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunegrain.sources import files

Reduce = Callable[[DataFrame], DataFrame]


class MergedState:
    def __init__(self, path: str, schema: T.StructType, reduce: Reduce, compact_every: int = 50) -> None:
        self.path, self.schema, self.reduce, self.compact_every = path, schema, reduce, compact_every

    def _complete(self, spark: SparkSession, kind: str) -> list[int]:
        names = [n for n in files.children(spark, f"{self.path}/{kind}") if n.startswith("upto=")]
        return [int(n[5:]) for n in names if files.exists(spark, f"{self.path}/{kind}/{n}/_SUCCESS")]

    def read(self, spark: SparkSession) -> DataFrame:
        return self._merge(spark, max(self._complete(spark, "full"), default=-1), None)

    def _merge(self, spark: SparkSession, full: int, upto: int | None) -> DataFrame:
        later = [b for b in self._complete(spark, "batch") if b > full and (upto is None or b <= upto)]
        paths = [f"{self.path}/batch/upto={b}" for b in later]
        if full >= 0:
            paths.append(f"{self.path}/full/upto={full}")
        if not paths:
            return spark.createDataFrame([], self.schema)
        return self.reduce(spark.read.schema(self.schema).parquet(*paths))

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        spark = batch.sparkSession
        self.reduce(batch).write.mode("overwrite").parquet(f"{self.path}/batch/upto={batch_id}")
        if (batch_id + 1) % self.compact_every == 0:
            # A replayed batch must not read the full table it is about to replace.
            older = [b for b in self._complete(spark, "full") if b < batch_id]
            merged = self._merge(spark, max(older, default=-1), batch_id)
            merged.write.mode("overwrite").parquet(f"{self.path}/full/upto={batch_id}")
            self._clear(spark, max(older, default=-1))

    def _clear(self, spark: SparkSession, covered: int) -> None:
        """Remove what the full table before the newest covers; that one stays, for replays of the newest."""
        for kind, gone in (("batch", lambda b: b <= covered), ("full", lambda b: b < covered)):
            for b in filter(gone, self._complete(spark, kind)):
                files.remove_folder(spark, f"{self.path}/{kind}/upto={b}")


def latest_per_key(keys: list[str], order: list[str], values: list[str]) -> Reduce:
    """Reduction to each key's last known value of every column (nulls do not overwrite).

    The result keeps the time each value was set, so results can be reduced again.
    """

    def reduce(df: DataFrame) -> DataFrame:
        latest = [
            F.max_by(f"{v}", F.when(F.col(f"{v}.v").isNotNull(), F.struct(*[F.col(f"{v}.{o}") for o in order]))).alias(v)
            for v in values
        ]
        return df.groupBy(*keys).agg(*latest)

    return reduce
