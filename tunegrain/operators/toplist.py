"""Top rows per key that stay spread out when one key holds much of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICES = 1024
FEW = 20
MAP_SIDE_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, slices: int | None = None
) -> DataFrame:
    """The first ``n`` rows of each key under a total ``order``.

    Spark ranks on the map side first, so a task sends at most ``n`` rows per key. For a few
    rows that is enough even if one key fills every task. For a large ``n``, the tasks are
    bundled into slices and ranked per slice before the survivors of all slices (at most
    ``n * slices`` per key) meet. Any assignment of rows to slices gives the same result.
    """
    if n > int(df.sparkSession.conf.get(MAP_SIDE_LIMIT)):
        # Beyond this number (1000 by default) Spark would send every row to the reducers.
        df.sparkSession.conf.set(MAP_SIDE_LIMIT, str(n))
    slices = slices or (1 if n <= FEW else SLICES)
    if slices > 1:
        sliced = df.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(slices)))
        df = _first(sliced, [*keys, "_slice"], order, n).drop("_slice")
    return _first(df, keys, order, n)
