"""Seeded, exact train/eval split that does not depend on partitioning.

The order is that of ``md5(seed:row_id)``, so it is the same on any cluster. The held-out
part is cut at one key, found from a histogram of key prefixes: no global sort and no rows
on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tunegrain.session import materialize

# Share held out and seed used when none is given.
DEFAULT_EVAL_RATIO = 0.05
DEFAULT_SEED = 3407

PREFIX_DIGITS = 4
RANGES = 4096


def split_key(row_id: Column, seed: int = DEFAULT_SEED) -> Column:
    """Hex key that puts rows into a seeded pseudo-random order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string")))

#: So many ids are sorted by one task; more are cut into so many ranges. A number that is given isn't merged by adaptive execution.
FEW_IDS = 10_000
PIVOT_RANGES = 64


def holdout_size(n: Column, eval_ratio: float) -> Column:
    """``floor(n * ratio)`` in double arithmetic, leaving at least one row to train on."""
    if eval_ratio <= 0:
        return F.lit(0).cast("bigint")
    share = F.floor(n.cast("double") * F.lit(float(eval_ratio)))
    return F.least(share, F.greatest(n - 1, F.lit(0))).cast("bigint")


def holdout_count(n: int, eval_ratio: float) -> int:
    """``holdout_size`` for a known row count."""
    return min(int(n * eval_ratio), max(0, n - 1)) if eval_ratio > 0 else 0


def _cut(keyed: DataFrame, eval_ratio: float) -> DataFrame:
    """At most one row: the last (key, row_id) that is held out.

    ``keyed`` has ``bucket, key, row_id`` with buckets in key order. Only the bucket that
    holds the cut is ranked.
    """
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("c"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per bucket, at most 16 ** PREFIX_DIGITS of them.
    running = sizes.withColumns(
        {"before": F.sum("c").over(upto) - F.col("c"), "want": holdout_size(F.sum("c").over(everything), eval_ratio)}
    )
    edge = running.where((F.col("before") < F.col("want")) & (F.col("before") + F.col("c") >= F.col("want")))
    edge = edge.select("bucket", (F.col("want") - F.col("before")).alias("need"))
    # ``edge`` is one row, so it may be broadcast whatever the size of the data.
    ranked = keyed.join(F.broadcast(edge), "bucket").withColumn(
        "rank", F.row_number().over(Window.partitionBy("bucket").orderBy("key", "row_id"))
    )
    return ranked.where(F.col("rank") == F.col("need")).select(F.struct("key", "row_id").alias("cut"))


def _nth_lowest(rows: DataFrame, row_id: str, eval_ratio: float) -> int | None:
    """The last held-out row id when ids are taken in ascending order.

    Each round counts the ids in at most RANGES equal ranges and goes on inside the range
    that holds the cut; unique 64-bit ids need at most six rounds, however they are spread.
    """
    ids = rows.select(F.col(row_id).cast("bigint").alias("id"))
    low, high, n = ids.agg(F.min("id"), F.max("id"), F.count("id")).first()
    want = holdout_count(n, eval_ratio)
    while want:
        width = (high - low) // RANGES + 1
        inside = ids.where(F.col("id").between(low, high))
        sizes = inside.groupBy(F.expr(f"(CAST(id AS DECIMAL(20, 0)) - {low}BD) div {width}BD").alias("range")).count()
        for index, size in sorted(sizes.collect()):
            if want <= size:
                break
            want -= size
        low += index * width
        high = min(high, low + width - 1)
        if low == high:
            return low
    return None


def _nth_lowest_of_any(rows: DataFrame, row_id: str, eval_ratio: float) -> object:
    """The same for ids of any orderable type: rounds of ranges, until the range with the cut is small.

    A round cuts the ids at pivots that Spark samples, counts the ranges and goes on inside the one with the cut, so
    all but the first shuffle a small part. A range of one repeated id ends the search as well.
    """
    inside = rows.select(F.col(row_id).alias("id")).where("id is not null")
    size = inside.count()
    want = holdout_count(size, eval_ratio)
    while want:
        if size <= FEW_IDS:
            return inside.orderBy("id").offset(want - 1).first().id
        ranged = materialize(inside.repartitionByRange(PIVOT_RANGES, "id").withColumn("range", F.spark_partition_id()), "ids")
        for r in sorted(ranged.groupBy("range").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).collect()):
            if want <= r.n:
                break
            want -= r.n
        if r.low == r.high:
            return r.low
        inside = ranged.where(F.col("range") == r.range).select("id")
        if r.n == size:
            # One range after all: what is below its greatest id is set apart by that id itself.
            below = inside.where(F.col("id") < F.lit(r.high))
            n_below = below.count()
            if want > n_below:
                return r.high
            inside, size = below, n_below
        else:
            size = r.n
    return None


def _key(row_id: str, seed: int, shuffle: bool) -> Column:
    return split_key(F.col(row_id), seed) if shuffle else F.col(row_id)


def find_cut(
    rows: DataFrame, eval_ratio: float, seed: int = DEFAULT_SEED, shuffle: bool = True, row_id: str = "row_id"
) -> DataFrame:
    """At most one row with ``cut``: the (key, row_id) of the last held-out row."""
    if shuffle:
        keyed = rows.select(_key(row_id, seed, True).alias("key"), F.col(row_id).alias("row_id"))
        return _cut(keyed.withColumn("bucket", F.substring("key", 1, PREFIX_DIGITS)), eval_ratio)
    whole = isinstance(rows.schema[row_id].dataType, T.IntegralType)
    last = _nth_lowest(rows, row_id, eval_ratio) if whole else _nth_lowest_of_any(rows, row_id, eval_ratio)
    id_type = rows.schema[row_id].dataType.simpleString()
    found = [] if last is None else [((last, last),)]
    return rows.sparkSession.createDataFrame(found, f"cut struct<key: {id_type}, row_id: {id_type}>")


def mark(
    rows: DataFrame, cut: Column, seed: int = DEFAULT_SEED, shuffle: bool = True, row_id: str = "row_id"
) -> DataFrame:
    """``rows`` plus ``split_key`` and ``split``, given the cut (null when nothing is held out)."""
    key = _key(row_id, seed, shuffle)
    held_out = F.coalesce(F.struct(key.alias("key"), F.col(row_id).alias("row_id")) <= cut, F.lit(False))
    return rows.withColumns(
        {"split_key": key, "split": F.when(held_out, F.lit("eval")).otherwise(F.lit("train"))}
    )


def add_split(
    rows: DataFrame,
    eval_ratio: float = DEFAULT_EVAL_RATIO,
    seed: int = DEFAULT_SEED,
    shuffle: bool = True,
    row_id: str = "row_id",
) -> DataFrame:
    """``rows`` plus ``split_key`` and ``split`` ('train' or 'eval').

    Without ``shuffle`` the held-out rows are those with the lowest ids, of any orderable type.
    """
    return mark(rows, find_cut(rows, eval_ratio, seed, shuffle, row_id).scalar(), seed, shuffle, row_id)


def usable(measured: DataFrame) -> DataFrame:
    """Examples that go into training: parsed and with a real output."""
    return measured.where(~F.col("empty_output"))


def split_counts(split_rows: DataFrame, *others: Column) -> DataFrame:
    """One row: example, train and eval counts, and any other aggregates asked for."""
    return split_rows.agg(
        F.count("*").alias("n_examples"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "eval").alias("n_eval"),
        *others,
    )
