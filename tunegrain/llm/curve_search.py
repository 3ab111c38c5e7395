"""Approximate nearest neighbours over shifted space-filling curves.

Vectors are projected by seeded rotations, a few dimensions at a time; each projection is shifted at random and
ordered along a Hilbert curve. Near vectors mostly lie near each other on some of the curves. Every
curve is one range-partitioned order, in which each vector gets its rank. A query looks at the
``window`` ranks on either side of its own, on every curve; what the windows find is merged and
ranked by true distances of the original vectors.

The window isn't guessed. For a bounded sample of queries the true neighbours are found by one pass over all vectors,
and the window is the least one that holds the stated share of them. On vectors with structure it is
short; on uniformly random ones of many dimensions no curve helps much, and the window grows with the table.

Equal vectors stand on the curves once, with the smallest of their ids: no more of them can be among a query's nearest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunegrain.llm.embedding_dups import usable
from tunegrain.llm.shared import drop_tables, materialize
from tunegrain.operators.toplist import first_per_key


@dataclass(frozen=True)
class Curves:
    """``count`` curves over ``dims`` projected dimensions of ``bits`` bits each.

    ``recall``: share of the true neighbours of the ``sample`` queries that the window must hold.
    ``least``: the window is never shorter. ``block``: ranks of a task, ``queries``: most queries of a task.
    """

    count: int = 8
    dims: int = 8
    bits: int = 7
    recall: float = 0.95
    sample: int = 256
    least: int = 512
    block: int = 4096
    queries: int = 4096
    seed: int = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of ``cells`` (whole numbers below 2 ** bits) on the Hilbert curve, as a whole number.

    The cells' bits are turned from the top down by the exchanges and inversions that the curve's sub-cubes
    undergo, then read as a Gray code.
    """
    axes = [column.copy() for column in cells.astype(np.int64).T]
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i, axis in enumerate(axes):
            high = (axis & bit) != 0
            if i == 0:
                axes[0] = np.where(high, axes[0] ^ below, axes[0])
            else:
                swap = (axes[0] ^ axis) & below
                axes[i] = np.where(high, axis, axis ^ swap)
                axes[0] = np.where(high, axes[0] ^ below, axes[0] ^ swap)
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(axes[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | (((axis ^ turn) >> level) & 1)
    return key


def _projections(width: int, curves: Curves) -> tuple[np.ndarray, np.ndarray]:
    """A matrix with ``dims`` columns for each curve, and the curves' shifts. Columns are orthogonal as far as the width allows."""
    rng = np.random.default_rng([curves.seed, width])
    wanted = curves.count * curves.dims
    parts: list[np.ndarray] = []
    while sum(p.shape[1] for p in parts) < wanted:
        parts.append(np.linalg.qr(rng.normal(size=(width, min(width, wanted))))[0])
    return np.concatenate(parts, axis=1)[:, :wanted], rng.uniform(size=wanted)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _by_width(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Width, rows and matrix of the vectors of each length in a batch."""
    column = batch.column(name)
    widths = np.asarray(column.value_lengths())
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        yield width, rows, _matrix(column.take(pa.array(rows)))


def _projected(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Projections in proportion for vectors of usual lengths, logarithmic for huge ones, so that nothing overflows."""
    return np.arcsinh((x / 1024) @ matrix)


def _moments(curves: Curves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per length of vectors: how many there are, and sums and sums of squares of their projections, of one task."""
        sums: dict[int, list] = {}
        for batch in batches:
            for width, _rows, x in _by_width(batch, "vector"):
                p = _projected(x, _projections(width, curves)[0])
                held = sums.setdefault(width, [0, 0.0, 0.0])
                held[0] += len(p)
                held[1] = held[1] + p.sum(axis=0)
                held[2] = held[2] + (p * p).sum(axis=0)
        yield pa.record_batch(
            [pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1] for s in sums.values()], pa.list_(pa.float64())), pa.array([s[2] for s in sums.values()], pa.list_(pa.float64()))],
            names=["width", "n", "one", "two"],
        )

    return run


def _spread(vectors: DataFrame, curves: Curves) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of each projection, for each length of vectors: over all vectors, a few numbers for each length."""
    found = vectors.select("vector").mapInArrow(_moments(curves), "width int, n bigint, one array<double>, two array<double>")
    each = found.select("width", "n", F.posexplode(F.arrays_zip("one", "two")).alias("at", "both"))
    summed = each.groupBy("width", "at").agg(F.sum("n").alias("n"), F.sum("both.one").alias("one"), F.sum("both.two").alias("two"))
    wide = summed.groupBy("width").agg(F.sort_array(F.collect_list(F.struct("at", "n", "one", "two"))).alias("all")).collect()
    out = {}
    for row in wide:
        n, one, two = (np.array([x[k] for x in row["all"]], dtype=np.float64) for k in ("n", "one", "two"))
        mean = one / n
        out[row["width"]] = mean, np.sqrt(np.maximum(two / n - mean * mean, 1e-300))
    return out


def _place(spread: dict[int, tuple[np.ndarray, np.ndarray]], curves: Curves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector once for each curve, with its key there."""
        for batch in batches:
            for width, rows, x in _by_width(batch, "vector"):
                matrix, shift = _projections(width, curves)
                mean, deviation = spread[width]
                # A squashed deviation fills half of the cube's side; the shift moves that half about.
                z = np.clip((_projected(x, matrix) - mean) / deviation, -40, 40)
                cells = ((1 / (1 + np.exp(-1.7 * z)) + shift) / 2 * (1 << curves.bits)).astype(np.int64)
                part = batch.take(pa.array(rows))
                for curve in range(curves.count):
                    own = cells[:, curve * curves.dims : (curve + 1) * curves.dims]
                    yield pa.record_batch(
                        [pa.array(np.full(len(rows), width * curves.count + curve)), pa.array(hilbert_keys(own, curves.bits)), *part.columns],
                        names=["curve", "key", *part.schema.names],
                    )

    return run


def _nearest(queries: np.ndarray, stock: np.ndarray, fits: np.ndarray | None, low_ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its ``k`` nearest rows of ``stock``, by true distance, then by id.

    A matrix product sorts out most rows; what may be among the nearest within the product's error is computed from differences.
    """
    # Divided by one power of two, so that squares don't overflow.
    power = 2.0 ** int(np.frexp(max(np.abs(queries).max(), np.abs(stock).max()))[1])
    scaled = stock / power
    squares = (scaled * scaled).sum(axis=1)
    for low in range(0, len(queries), 256):
        part = queries[low : low + 256]
        small = part / power
        own = (small * small).sum(axis=1)
        rough = own[:, None] + squares - 2 * (small @ scaled.T)
        if fits is not None:
            rough[~fits[low : low + 256]] = np.inf
        slack = 1e-12 * stock.shape[1] * (own[:, None] + squares) + 1e-290
        for i, row in enumerate(rough):
            if k < len(row):
                upper = np.partition(row + slack[i], k - 1)[k - 1]
                near = np.flatnonzero((row - slack[i] <= upper) & np.isfinite(row))
            else:
                near = np.flatnonzero(np.isfinite(row))
            gap = np.abs(stock[near] - part[i])
            unit = gap.max(axis=1, initial=0.0)
            unit[unit == 0] = 1.0
            unit = np.exp2(np.frexp(unit)[1].astype(np.float64))
            distance = np.sqrt(((gap / unit[:, None]) ** 2).sum(axis=1)) * unit
            best = np.lexsort((low_ids[near], distance))[:k]
            yield low + i, near[best], distance[best]


_FOUND = "asked bigint, rep bigint, first bigint, score double"


def _found(asked: list, reps: list, firsts: list, scores: list) -> pa.Table:
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
    return pa.table({"asked": join(asked, pa.int64()), "rep": join(reps, pa.int64()), "first": join(firsts, pa.int64()), "score": join(scores, pa.float64())})


def _windows(window: int, k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries (left) against the vectors of one block of a curve (right)."""
        out: tuple[list, list, list, list] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            asked, at = np.asarray(left.column("rep")), np.asarray(left.column("rank"))
            reps, ranks, firsts = (np.asarray(right.column(n)) for n in ("rep", "rank", "first"))
            fits = np.abs(at[:, None] - ranks) <= window
            for i, near, distance in _nearest(_matrix(left.column("vector")), _matrix(right.column("vector")), fits, firsts, k):
                for parts, values in zip(out, (np.full(len(near), asked[i]), reps[near], firsts[near], distance)):
                    parts.append(values)
        return _found(*out)

    return run


def _everywhere(sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sample's nearest among the vectors of each batch."""
        for batch in batches:
            for width, rows, x in _by_width(batch, "vector"):
                if width not in sample:
                    continue
                asked, queries = sample[width]
                reps, firsts = (np.asarray(batch.column(n))[rows] for n in ("rep", "first"))
                out: tuple[list, list, list, list] = ([], [], [], [])
                for i, near, distance in _nearest(queries, x, None, firsts, k):
                    for parts, values in zip(out, (np.full(len(near), asked[i]), reps[near], firsts[near], distance)):
                        parts.append(values)
                yield from _found(*out).to_batches()

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("asked").orderBy("score", "first", "rep")
    return found.distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def _window(placed: DataFrame, reps: DataFrame, asked: DataFrame, k: int, curves: Curves) -> int:
    """The least window that holds the wanted share of the true neighbours of a sample of the queries."""
    chosen = asked.orderBy(F.xxhash64("rep"), "rep").limit(curves.sample).join(reps, "rep").select("rep", "vector").collect()
    sample: dict[int, list] = {}
    for row in chosen:  # at most curves.sample rows
        sample.setdefault(len(row["vector"]), []).append((row["rep"], row["vector"]))
    held = {w: (np.array([r for r, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)) for w, rows in sample.items()}
    true = _best(reps.select("rep", "first", "vector").mapInArrow(_everywhere(held, k), _FOUND), k)
    pairs = true.where("asked <> rep").select("asked", "rep").collect()  # at most curves.sample * k rows
    if not pairs:
        return curves.least
    spark = placed.sparkSession
    pairs = spark.createDataFrame([(r["asked"], r["rep"]) for r in pairs], "asked bigint, rep bigint")
    ids = F.broadcast(pairs.select("rep").union(pairs.select("asked")).distinct())
    ranks = materialize(placed.select("curve", "rank", "rep").join(ids, "rep"), "sample-ranks")
    here = ranks.select("curve", F.col("rep").alias("asked"), F.col("rank").alias("own"))
    apart = pairs.join(ranks, "rep").join(here, ["asked", "curve"]).groupBy("asked", "rep").agg(F.min(F.abs(F.col("rank") - F.col("own"))).alias("apart"))
    apart = np.sort([r["apart"] for r in apart.collect()])
    drop_tables(ranks)
    return max(curves.least, int(apart[math.ceil(curves.recall * len(apart)) - 1]))


def search(embeddings: DataFrame, every: int = 100, k: int = 10, curves: Curves = Curves(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per query (id divisible by ``every``) the ``k`` nearest other rows found: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to smaller ids. Vectors
    that are null, empty or zero, or hold null or non-finite components, and rows with a null id, take no part. A
    query compares with vectors of its own length only. Rows that repeat an id are rows of their own: each is a query
    and a candidate of the others. An empty table gives an empty result. Other columns are ignored.
    """
    vector = F.col(vector_column)
    rows = embeddings.select(F.col(id_column).cast("bigint").alias("id"), vector.alias("vector"))
    rows = rows.where(usable(F.col("vector")) & F.col("id").isNotNull())
    # -0.0 is 0.0 here, so that equal vectors are equal keys.
    kind = rows.schema["vector"].dataType.elementType.simpleString()
    rows = rows.select("id", F.transform("vector", lambda x: (x + F.lit(0.0)).cast(kind)).alias("vector"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "curve-rows")
    # One of the members may be the query itself, hence one more than asked for.
    some = first_per_key(rows, ["vector"], [F.col("id"), F.col("row")], k + 1, slices=64)
    members = some.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("id", "row"))).alias("members"))
    reps = materialize(members.select("vector", "members", F.col("members")[0]["id"].alias("first"), F.monotonically_increasing_id().alias("rep")), "curve-vectors")
    queries = materialize(rows.where(F.col("id") % every == 0).join(reps.select("vector", "rep"), "vector").select(F.col("id").alias("query_id"), "row", "rep"), "curve-queries")
    asked = queries.select("rep").distinct()
    flagged = reps.select("rep", "first", "vector").join(asked.withColumn("asked", F.lit(True)), "rep", "left")
    keyed = flagged.mapInArrow(_place(_spread(reps, curves), curves), "curve bigint, key bigint, rep bigint, first bigint, vector array<" + kind + ">, asked boolean")
    ordered = keyed.repartitionByRange("curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
    ordered = materialize(ordered.select("curve", "rep", "first", "vector", "asked", F.monotonically_increasing_id().alias("place")), "curves")
    # A place is its partition and the row's number there: a rank is known from the counts before the partition.
    part = F.shiftright("place", 33).alias("part")
    counts = ordered.groupBy("curve", part).agg(F.min("place").alias("low"), F.count("*").alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("curve", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    # One row for each partition and each curve that begins in it: as many as there are shuffle partitions and curves.
    placed = ordered.withColumn("part", part).join(F.broadcast(shifts), ["curve", "part"]).withColumn("rank", F.col("place") + F.col("shift")).drop("part", "place", "shift")
    window = _window(placed, reps, asked, k + 1, curves)
    low, high = (F.floor((F.col("rank") + side) / curves.block) for side in (-window, window))
    reach = placed.where("asked").select("curve", "rank", "rep", "vector", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)).alias("block"))
    reach = materialize(reach, "curve-reach")
    keys = ["curve", "block", "chunk"]
    chunks = reach.groupBy("curve", "block").agg(F.ceil(F.count("*") / curves.queries).cast("int").alias("chunks"))
    dealt = reach.join(chunks, ["curve", "block"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    stock = placed.withColumn("block", F.floor(F.col("rank") / curves.block)).join(chunks, ["curve", "block"])
    stock = stock.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pairs = dealt.select(*keys, "rank", "rep", "vector").groupBy(*keys).cogroup(stock.select(*keys, "rank", "rep", "first", "vector").groupBy(*keys))
    found = materialize(_best(pairs.applyInArrow(_windows(window, k + 1), _FOUND), k + 1), "curve-found")
    # The vectors found stand for rows again; a query's own row goes.
    each = found.join(reps.select("rep", "members"), "rep").select("asked", "score", F.explode("members").alias("member"))
    each = each.select("asked", "score", F.col("member.id").alias("vec_id"), F.col("member.row").alias("found"))
    nearest = Window.partitionBy("asked").orderBy("score", "vec_id", "found")
    each = each.withColumn("at", F.row_number().over(nearest)).where(F.col("at") <= k + 1)
    out = queries.join(each, F.col("rep") == F.col("asked")).where(F.col("row") != F.col("found"))
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "row").orderBy("at"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
