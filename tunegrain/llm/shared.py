"""Spark helpers of the subpackage: connected components, bounded membership filters, numbering without one big window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunegrain import session
from tunegrain.sources import files

#: A membership filter never has more words than this (16 bytes each when broadcast), whatever the input.
MOST_FILTER_WORDS = 1 << 20


#: Rows of an Arrow batch while tables are written: with texts of some kB, a few MB go to Python at once.
ARROW_ROWS = 2000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; Arrow batches are small meanwhile."""
    spark = df.sparkSession
    before = spark.conf.get(_ARROW)
    spark.conf.set(_ARROW, str(ARROW_ROWS))
    try:
        path = session.fresh_path(spark, label)
        df.write.parquet(path)
    finally:
        spark.conf.set(_ARROW, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def drop_tables(*stored: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again."""
    for df in stored:
        files.remove_folder(df.sparkSession, df.stored_at)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over, and the driver give back what their tasks reported.

    It does so when the driver has collected their plans, which on a large heap can take long; results are tables by then.
    """
    spark.sparkContext._jvm.System.gc()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node of distinct edges ``u`` > ``v`` either has one smaller neighbour and no larger one, or larger ones only."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    apart = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 and n > 1")
    return apart.agg(F.count("*")).first()[0] == 0


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """Columns ``node``, ``component`` (smallest node reachable) from undirected ``a``, ``b`` links.

    Alternating star contraction: each round joins on combined minima only, so a hub is never one
    group, and it ends after about log(n) rounds. Every round is a table in the shared folder, and
    what the round left on the driver goes before the next one.
    Nodes without links are not listed. Null ends and self links are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialize(edges, label)
    while not _all_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        # Every node hands its least neighbour to its larger ones. What repeats changes no minimum and goes at the round's end.
        large = edges.join(least, "v").select("u", F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # Then to its smaller ones, and takes it itself where that neighbour stands.
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, edges = edges, materialize(small.distinct(), label)
        drop_tables(last)
        release_shuffles(edges.sparkSession)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _word(column: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(words)).alias("_word")


def _pattern(column: Column) -> Column:
    h = F.xxhash64(column, F.lit(17))
    bits = [F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(3)]
    one = F.lit(1).cast("bigint")
    shifted = [F.call_function("shiftleft", one, b) for b in bits]
    return shifted[0].bitwiseOR(shifted[1]).bitwiseOR(shifted[2])


def split_by_membership(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that may be in ``ids``, rows that certainly are not), without shuffling ``rows``.

    ``ids`` has one column named ``key``. A blocked Bloom filter of at most MOST_FILTER_WORDS words is
    broadcast; beyond that size more rows count as "may be", which only costs work: callers join
    those exactly. Rows with a null key are certainly not members.
    """
    count = ids.count()
    words = 64
    while words * 4 < count and words < MOST_FILTER_WORDS:
        words *= 2
    key_col = F.col(key)
    bits = ids.groupBy(_word(key_col, words)).agg(F.bit_or(_pattern(key_col)).alias("_bits"))
    bits = bits.select(F.col("_word").alias(word := unused(rows, "word")), F.col("_bits").alias(held := unused(rows, "bits")))
    marked = rows.withColumn(word, _word(key_col, words)).join(F.broadcast(bits), word, "left")
    hit = F.coalesce(key_col.isNotNull() & (F.col(held).bitwiseAND(_pattern(key_col)) == _pattern(key_col)), F.lit(False))
    return marked.where(hit).select(*columns_of(rows)), marked.where(~hit).select(*columns_of(rows))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, buckets: int = 256) -> DataFrame:
    """Number the rows of each group from 0 in an arbitrary but fixed order, without one window per group.

    A group is cut into ``buckets`` parts by the hash of ``order`` (whose values should be unique);
    parts are numbered by a window each and shifted by the counts of the parts before.
    """
    cut = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = cut.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    ranked = cut.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(shifts, [*group, "_part"]).withColumn(name, F.col("_rank") + F.col("_shift")).drop("_part", "_rank", "_shift")
