"""Centroid clustering over a vector-approximation file.

Every vector is stored once in full and once as cells of a few bits for each dimension. A round reads the cells only:
for each centroid a look-up table gives the least and the greatest that a dimension's cell adds to the distance, and
their sums enclose the vector's distance. Where one centroid's greatest lies below all others' least, the vector is
assigned without being read. Full vectors are fetched, by a join on their numbers, only where the
intervals overlap, or where the cluster changes and the sums have to follow. The first round, which has no sums yet,
and the last assignment, which gives exact distances, read cells and vectors together, and compute only what the cells leave open.

Everything is whole numbers: results don't depend on partitions or the order of sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrain.llm.shared import drop_tables, materialize

#: Scaled components are smaller than this, so that squared distances of up to 128 components fit in a long.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Clustering:
    """``bits`` of a cell; ``scale``: components become floor(scale * x); ``salt`` of the starting order."""

    clusters: int = 16
    rounds: int = 3
    width: int = 64
    scale: int = 64
    bits: int = 6
    salt: int = 1


def _kept(embeddings: DataFrame, plan: Clustering, id_column: str, vector_column: str) -> DataFrame:
    vector = F.col(vector_column).cast("array<double>")
    rows = embeddings.select(F.col(id_column).cast("bigint").alias("id"), vector.alias("vector"))
    within: Column = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.floor(F.abs(x) * plan.scale) < LARGEST))
    rows = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") == plan.width)).where(within)
    return rows.select("id", F.transform("vector", lambda x: F.floor(x * plan.scale).cast("int")).alias("vector"))


def _edges(rows: DataFrame, plan: Clustering) -> np.ndarray:
    """Borders of each dimension's cells, from the least to one above the greatest value; inner ones near quantiles.

    All vectors are counted. The borders decide how much is fetched, never the result.
    """
    cells = 1 << plan.bits
    inner = F.percentile_approx("x", [i / cells for i in range(1, cells)], 1000)
    each = rows.select(F.posexplode("vector").alias("at", "x"))
    found = each.groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high"), inner.alias("inner")).collect()  # one row for each dimension
    edges = np.zeros((plan.width, cells + 1), dtype=np.int64)
    for row in found:
        edges[row["at"]] = [row["low"], *row["inner"], row["high"] + 1]
    return edges


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, width)


def _packed(cells: np.ndarray, bits: int) -> np.ndarray:
    """Cells of each row as bytes, two in a byte if they fit."""
    return cells if bits > 4 else (cells[:, ::2] << 4 | cells[:, 1::2])


def _unpacked(data: np.ndarray, bits: int) -> np.ndarray:
    if bits > 4:
        return data
    out = np.empty((len(data), data.shape[1] * 2), dtype=np.uint8)
    out[:, ::2], out[:, 1::2] = data >> 4, data & 15
    return out


def _approximate(edges: np.ndarray, plan: Clustering):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with their cells."""
        for batch in batches:
            x = _matrix(batch.column("vector"), plan.width)
            cells = np.empty(x.shape, dtype=np.uint8)
            for at in range(plan.width):
                # Equal borders leave cells empty; a value goes into the last cell that begins at or before it.
                cells[:, at] = np.clip(np.searchsorted(edges[at], x[:, at], side="right") - 1, 0, (1 << plan.bits) - 1)
            cells = _packed(np.pad(cells, ((0, 0), (0, plan.width % 2))), plan.bits)
            width = cells.shape[1]
            held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(cells))]).cast(pa.binary())
            yield pa.record_batch([batch.column("row"), batch.column("id"), held, batch.column("vector")], names=["row", "id", "cells", "vector"])

    return run


def look_up_tables(edges: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest share of each dimension's cells in the distance to each centroid: centroid, dimension, cell.

    Distances are counted from the squared distance to the centroids' middle m. All centroids of a vector have that in common, so
    it needn't be known: (x - c)² - (x - m)² = (m - c)(2x - c - m) is linear in x, and its interval far shorter.
    """
    low, high = edges[:, :-1], np.maximum(edges[:, 1:] - 1, edges[:, :-1])
    c, m = centroids[:, :, None], (centroids.sum(axis=0) // len(centroids))[:, None]
    ends = [(m - c) * (2 * x - c - m) for x in (low, high)]
    return np.minimum(*ends), np.maximum(*ends)


def enclosed(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which centroids may be the nearest of each row: rows by centroids, one true for rows that are settled."""
    least, greatest = tables
    dims = np.arange(least.shape[1])
    low, high = (np.stack([table[c][dims, cells].sum(axis=1) for c in range(len(table))], axis=1) for table in (least, greatest))
    return low <= high.min(axis=1)[:, None]


def _cells(batch: pa.RecordBatch, plan: Clustering) -> np.ndarray:
    column = batch.column("cells")
    width = (plan.width + plan.width % 2) // (2 if plan.bits <= 4 else 1)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(-1, width)
    return _unpacked(data, plan.bits)[:, : plan.width]


def _nearest(x: np.ndarray, may: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid among those that may be, and its distance; ties go to the smaller number."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    cluster = np.zeros(len(x), dtype=np.int32)
    for c, centroid in enumerate(centroids):
        rows = np.flatnonzero(may[:, c])
        gap = x[rows] - centroid
        distance = (gap * gap).sum(axis=1)
        better = distance < best[rows]
        best[rows[better]], cluster[rows[better]] = distance[better], c
    return cluster, best


class _Sums:
    """What a task's vectors change in the clusters' sums and counts."""

    def __init__(self, clusters: int, width: int):
        self.sums, self.counts = np.zeros((clusters, width), dtype=np.int64), np.zeros(clusters, dtype=np.int64)

    def add(self, x: np.ndarray, cluster: np.ndarray, sign: int) -> None:
        for c in np.unique(cluster).tolist():
            mine = cluster == c
            self.sums[c] += sign * x[mine].sum(axis=0)
            self.counts[c] += sign * int(mine.sum())

    def columns(self) -> list[pa.Array]:
        some = np.flatnonzero((self.counts != 0) | self.sums.any(axis=1))
        return [pa.array(some, pa.int32()), pa.array(self.counts[some], pa.int64()), pa.array(list(self.sums[some]), pa.list_(pa.int64()))]


_STEP = "row bigint, cells binary, cluster int, may int, count bigint, sums array<bigint>"


def _with_sums(batch_columns: dict, rows: int, sums: _Sums | None) -> pa.RecordBatch:
    kinds = {"row": pa.int64(), "cells": pa.binary(), "cluster": pa.int32(), "may": pa.int32(), "count": pa.int64(), "sums": pa.list_(pa.int64())}
    if sums is not None:
        cluster, count, total = sums.columns()
        batch_columns, rows = {"cluster": cluster, "count": count, "sums": total}, len(cluster)
    return pa.record_batch([batch_columns[n] if n in batch_columns else pa.nulls(rows, kind) for n, kind in kinds.items()], names=list(kinds))


def _first_round(edges: np.ndarray, centroids: np.ndarray, plan: Clustering):
    tables = look_up_tables(edges, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells and cluster of every vector; then the task's sums (rows without a number)."""
        sums = _Sums(len(centroids), plan.width)
        for batch in batches:
            x = _matrix(batch.column("vector"), plan.width)
            cluster, _ = _nearest(x, enclosed(_cells(batch, plan), tables), centroids)
            sums.add(x, cluster, 1)
            yield _with_sums({"row": batch.column("row"), "cells": batch.column("cells"), "cluster": pa.array(cluster)}, len(x), None)
        yield _with_sums({}, 0, sums)

    return run


def _by_cells(edges: np.ndarray, centroids: np.ndarray, plan: Clustering):
    tables = look_up_tables(edges, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which centroids may be nearest, as bits, from the cells alone."""
        bit = 1 << np.arange(len(centroids))
        for batch in batches:
            may = (enclosed(_cells(batch, plan), tables) @ bit).astype(np.int32)
            yield _with_sums({"row": batch.column("row"), "cells": batch.column("cells"), "cluster": batch.column("cluster"), "may": pa.array(may)}, len(batch), None)

    return run


def _settle(centroids: np.ndarray, plan: Clustering):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Clusters of the vectors that were fetched; then what the task's changes do to the sums."""
        bit = 1 << np.arange(len(centroids))
        sums = _Sums(len(centroids), plan.width)
        for batch in batches:
            x = _matrix(batch.column("vector"), plan.width)
            old = np.asarray(batch.column("cluster"))
            cluster, _ = _nearest(x, (np.asarray(batch.column("may"))[:, None] & bit) != 0, centroids)
            moved = cluster != old
            sums.add(x[moved], old[moved], -1)
            sums.add(x[moved], cluster[moved], 1)
            yield _with_sums({"row": batch.column("row"), "cells": batch.column("cells"), "cluster": pa.array(cluster)}, len(x), None)
        yield _with_sums({}, 0, sums)

    return run


def _last(edges: np.ndarray, centroids: np.ndarray, plan: Clustering):
    tables = look_up_tables(edges, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cluster and distance of every vector."""
        for batch in batches:
            cluster, distance = _nearest(_matrix(batch.column("vector"), plan.width), enclosed(_cells(batch, plan), tables), centroids)
            yield pa.record_batch([batch.column("id"), pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])

    return run


def _totals(step: DataFrame, clusters: int, width: int) -> tuple[list[int], list[list[int]]]:
    """Counts and sums of all tasks: a number for each cluster and dimension."""
    parts = step.where("row is null").select("cluster", "count", F.posexplode("sums").alias("at", "x"))
    added = parts.groupBy("cluster", "at").agg(F.sum("count").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    counts, sums = [0] * clusters, [[0] * width for _ in range(clusters)]
    for row in added.collect():  # clusters * width rows
        counts[row["cluster"]] = row["n"]
        sums[row["cluster"]][row["at"]] = int(row["x"])
    return counts, sums


def cluster(embeddings: DataFrame, plan: Clustering = Clustering(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per vector ``id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Only vectors of ``width`` components, none null or non-finite, take part, and only rows with an id; so do none
    with a component of 2 ** 27 or more after scaling, whose distances would not fit. The start is the vectors with the
    least hashes of their ids; among rows that repeat an id, the smaller vector comes first. With fewer vectors than
    clusters, there are as many clusters as vectors. Rows that repeat an id are vectors of their own. An empty table
    gives an empty result. Other columns are ignored.
    """
    if not 1 <= plan.clusters <= 31 or not 1 <= plan.width <= 128 or not 1 <= plan.bits <= 8:
        raise ValueError("up to 31 clusters, 128 components and 8 bits")
    rows = _kept(embeddings, plan, id_column, vector_column).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "va-vectors")
    hashed = F.sha2(F.concat_ws(":", F.lit(str(plan.salt)), F.col("id").cast("string")), 256)
    start = rows.select(hashed.alias("hash"), "vector").orderBy("hash", "vector").limit(plan.clusters).collect()
    facts = "id bigint, cluster int, distance bigint"
    if not start:
        empty = rows.sparkSession.createDataFrame([], facts + ", cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        return empty
    centroids = np.array([r["vector"] for r in start], dtype=np.int64)
    edges = _edges(rows, plan)
    file = materialize(rows.mapInArrow(_approximate(edges, plan), "row bigint, id bigint, cells binary, vector array<int>"), "va-file")
    drop_tables(rows)
    counts, sums = [0] * len(centroids), [[0] * plan.width for _ in centroids]
    state = None
    for turn in range(plan.rounds):
        if state is None:
            state = step = materialize(file.select("row", "cells", "vector").mapInArrow(_first_round(edges, centroids, plan), _STEP), "va-round")
            added = _totals(step, len(centroids), plan.width)
        else:
            judged = state.where("row is not null").select("row", "cells", "cluster").mapInArrow(_by_cells(edges, centroids, plan), _STEP)
            judged = materialize(judged, "va-judged")
            settled = F.col("may") == F.call_function("shiftleft", F.lit(1), F.col("cluster"))
            wanted = judged.where(~settled).select("row", "cells", "cluster", "may")
            fetched = wanted.join(file.select("row", "vector"), "row").mapInArrow(_settle(centroids, plan), _STEP)
            fetched = materialize(fetched, "va-fetched")
            added = _totals(fetched, len(centroids), plan.width)
            last, state = state, materialize(judged.where(settled).unionByName(fetched.where("row is not null")), "va-round")
            drop_tables(last, judged, fetched)
        counts = [a + b for a, b in zip(counts, added[0])]
        sums = [[x + y for x, y in zip(a, b)] for a, b in zip(sums, added[1])]
        centroids = np.array([[x // n for x in total] if n else old.tolist() for n, total, old in zip(counts, sums, centroids)], dtype=np.int64)
    if state is not None:
        drop_tables(state)
    final = materialize(file.select("id", "cells", "vector").mapInArrow(_last(edges, centroids, plan), facts), "va-clusters")
    drop_tables(file)
    # One row for each cluster.
    inertia = {r["cluster"]: int(r["x"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    said = [(c, str(x), str(sum(inertia.values())), digests[c]) for c, x in inertia.items()]
    spark = final.sparkSession
    said = spark.createDataFrame(said, "cluster int, own string, total string, centroid_sha256 string")
    # Sums beyond a long are null.
    said = said.select("cluster", F.expr("try_cast(own as bigint)").alias("cluster_inertia"), F.expr("try_cast(total as bigint)").alias("inertia"), "centroid_sha256")
    return final.join(F.broadcast(said), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
