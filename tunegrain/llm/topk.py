"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors are grouped by length (norm) into buckets of rising norm, and buckets into blocks. The k-th best score among
the longest vectors is a first threshold for each query. For a query q and a bucket whose longest vector is b, a candidate
can only reach the threshold t if its cosine with q reaches t / (|q| b): above 1, the bucket is skipped; if
that local threshold is high, candidates are pruned by one coordinate (the query's largest), whose value a high
cosine bounds; otherwise by their own length. The products of what is left are computed in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunegrain.llm.shared import materialize


#: Norms of one bucket differ by less than this factor.
RATIO = 1.1
#: Longest vectors that give the first thresholds; a fixed number.
SEEDS = 2048
#: Slices of a length whose longest vectors are found apart.
SLICES = 64
#: Local cosine threshold from which a coordinate prunes better than the length.
COORDINATE_FROM = 0.6


def usable(vector) -> F.Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = len(column[0]) if len(column) else 0
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), width)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where no sum can leave their exact range."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        pool = np.flatnonzero(scores >= edge)
    else:
        pool = np.arange(len(scores))
    return pool[np.lexsort((ids[pool], -scores[pool]))[:k]]


def pruned(query: np.ndarray, local: float, limit: float, unit: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Mask of a bucket's vectors that may reach the threshold. ``local``: cosine needed with the bucket's longest;
    ``limit``: length needed at cosine 1."""
    if local < COORDINATE_FROM:
        return norms >= limit * (1 - 1e-9)
    length = np.sqrt(float(query @ query))
    f = int(np.abs(query).argmax())
    x = float(query[f]) / length
    # cos >= local bounds the angle, and the angle the coordinate: x * local +- sqrt((1 - x^2)(1 - local^2)).
    spread = np.sqrt(max(0.0, 1 - x * x) * max(0.0, 1 - local * local)) + 1e-9
    return (unit[:, f] <= (x * local + spread if x < local else 1.0 + 1e-9)) & (unit[:, f] >= (x * local - spread if -x < local else -1.0 - 1e-9))


def _scan(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries (left) against one block of candidates (right)."""
        out_q, out_r, out_v, out_s = [], [], [], []
        if left.num_rows and right.num_rows:
            queries, vectors = _matrix(left.column("vector")), _matrix(right.column("vector"))
            query_ids, ids = np.asarray(left.column("id")), np.asarray(right.column("id"))
            query_rows, rows = np.asarray(left.column("row")), np.asarray(right.column("row"))
            floor = left.column("floor").to_pylist()
            norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
            unit = vectors / np.where(norms > 0, norms, 1)[:, None]
            top = float(norms.max())
            for n, query in enumerate(queries):
                mask = rows != query_rows[n]
                length = np.sqrt(float(query.astype(np.float64) @ query))
                t = floor[n]
                if t is not None and t > 0:
                    if length * top * (1 + 1e-9) < t:
                        continue
                    mask &= pruned(query.astype(np.float64), min(1.0, t / (length * top) * (1 - 1e-9)), t / length, unit, norms)
                at = np.flatnonzero(mask)
                if not len(at):
                    continue
                scores = _products(query[None, :], vectors[at])[0]
                if t is not None:
                    at, scores = at[scores >= t], scores[scores >= t]
                best = _best(scores, ids[at], k)
                out_q += [int(query_ids[n])] * len(best)
                out_r += [int(query_rows[n])] * len(best)
                out_v += ids[at][best].tolist()
                out_s += scores[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "row": pa.array(out_r, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.int64())})

    return run


def _floors(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries (left) of one length with the longest vectors of that length (right): the first thresholds."""
        floors: list[int | None] = []
        if left.num_rows and right.num_rows:
            queries, seeds = _matrix(left.column("vector")), _matrix(right.column("vector"))
            rows, seed_rows = np.asarray(left.column("row")), np.asarray(right.column("row"))
            for low in range(0, len(rows), 256):
                scores = _products(queries[low : low + 256], seeds)
                for i, row in enumerate(scores):
                    own = row[seed_rows != rows[low + i]]
                    floors.append(int(np.partition(own, len(own) - k)[len(own) - k]) if len(own) >= k else None)
        else:
            floors = [None] * left.num_rows
        return pa.table({"id": left.column("id"), "row": left.column("row"), "vector": left.column("vector"), "width": left.column("width"), "floor": pa.array(floors, pa.int64())})

    return run


def search(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block: int = 4096, queries_at_once: int = 4096, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per query (id divisible by ``every``) its ``k`` best other rows: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Components are floor(scale * x). Vectors that are null or hold null or non-finite components, and rows with a null
    id, take no part; a query compares with vectors of its own length only (the product of empty ones is 0). Rows that
    repeat an id are rows of their own: each is a query with a list of its own, and a candidate of the others. Ties go
    to smaller ids. A zero query scores 0 with all. An empty table gives an empty result. Other columns are ignored.
    """
    vector = F.col(vector_column).cast("array<double>")
    rows = embeddings.select(F.col(id_column).cast("bigint").alias("id"), vector.alias("vector")).where(usable(F.col("vector")) & F.col("id").isNotNull())
    rows = rows.select("id", F.transform("vector", lambda x: F.floor(x * scale).cast("bigint")).alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    bucket = F.when(norm > 0, F.floor(F.log(norm) / float(np.log(RATIO)))).otherwise(-(2**31)).cast("int")
    rows = rows.select("id", F.monotonically_increasing_id().alias("row"), "vector", F.size("vector").alias("width"), norm.alias("norm"), bucket.alias("bucket"))
    rows = materialize(rows, "top-vectors")
    queries = rows.where(F.col("id") % every == 0).select("id", "row", "vector", "width")
    # The longest of each length: of each of its slices first, then overall.
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(SLICES)))
    for groups in (["width", "slice"], ["width"]):
        longest = Window.partitionBy(*groups).orderBy(F.desc("norm"), "id", "row")
        sliced = sliced.withColumn("at", F.row_number().over(longest)).where(F.col("at") <= SEEDS)
    seeds = materialize(sliced.select("row", "vector", "width"), "top-seeds")
    # Queries of a length in chunks, each with the length's seeds.
    sizes = queries.groupBy("width").agg(F.ceil(F.count("*") / queries_at_once).cast("int").alias("chunks"))
    dealt = queries.join(sizes, "width").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
    stood = seeds.join(sizes, "width").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    keys = ["width", "chunk"]
    asked = dealt.select(*keys, "id", "row", "vector").groupBy(*keys).cogroup(stood.select(*keys, "row", "vector").groupBy(*keys))
    asked = asked.applyInArrow(_floors(k), "id bigint, row bigint, vector array<bigint>, width int, floor bigint")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    asked = materialize(asked.withColumn("length", length), "top-queries")
    chunks = max(1, -(-asked.count() // queries_at_once))
    # Buckets: as many as norms have magnitudes, a few hundred for each vector length.
    buckets = rows.groupBy("width", "bucket").agg(F.max("norm").alias("top"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    buckets = materialize(buckets, "top-buckets")
    reached = asked.join(buckets, "width").where(F.col("floor").isNull() | (F.col("floor") <= 0) | (F.col("length") * F.col("top") * (1 + 1e-9) >= F.col("floor")))
    reached = reached.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["width", "bucket", "block", "chunk"]
    # A block is copied only to the chunks whose queries reach its bucket.
    pairs = materialize(reached.select(*keys).distinct(), "top-pairs")
    reached = reached.select(*keys, "id", "row", "vector", "floor")
    stock = rows.join(buckets.select("width", "bucket", "blocks"), ["width", "bucket"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    stock = stock.join(pairs, ["width", "bucket", "block"]).select(*keys, "id", "row", "vector")
    found = reached.groupBy(*keys).cogroup(stock.groupBy(*keys)).applyInArrow(_scan(k), "query_id bigint, row bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
