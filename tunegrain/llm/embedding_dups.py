"""Near-duplicate embeddings: int8 tile products with per-vector error bounds, exact cosines only where they can matter.

Within a label, vectors are cut into blocks, and every pair of blocks is a tile. A unit vector x is held as
``scale * q`` with int8 q; the rest x - scale * q has a known length. For two vectors the product of the int8 parts
differs from the cosine by at most |a| |f| + |e|, where a and e are the first's int8 part and rest, and f the
second's rest. Only pairs whose product plus bound reaches the threshold are computed in double precision.

Equal vectors are compared once: a representative stands for all of them. A tile doesn't give out its
links, only each vector's number of links and a forest that connects what they connect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunegrain.llm.shared import connected_components, materialize

#: Rows multiplied at once within a tile.
STRIPE = 512
#: 127 * 127 * EXACT is below 2 ** 24.
EXACT = 1024


def usable(vector) -> F.Column:
    """A vector that has components, all finite, and isn't zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 parts (as floats), scales, lengths of the parts and of the rests."""
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None])
    part = q * scale[:, None]
    return q.astype(np.float32), scale, np.sqrt((part * part).sum(axis=1)), np.sqrt(((unit - part) ** 2).sum(axis=1))


def candidate_pairs(left: tuple, right: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose cosine may reach the threshold."""
    q, s, a, e = left
    r, t, _, f = right
    # Products of up to EXACT components are whole numbers that a float holds exactly; more are added up in doubles.
    product = sum((q[:, i : i + EXACT] @ r[:, i : i + EXACT].T).astype(np.float64) for i in range(0, q.shape[1], EXACT)) * s[:, None] * t
    bound = a[:, None] * f + e[:, None] + 1e-9
    return np.nonzero(product + bound >= threshold)


def _forest(i: np.ndarray, j: np.ndarray, nodes: int) -> np.ndarray:
    """Label of each node's component under the links (i, j): minima spread along links, with shortcuts."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _tile(threshold: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        first, second = key[1].as_py(), key[2].as_py()
        block = np.asarray(table.column("block"))
        order = np.lexsort((np.asarray(table.column("number")), block))
        block = block[order]
        number = np.asarray(table.column("number"))[order]
        times = np.asarray(table.column("times"))[order]
        values = table.column("vector").combine_chunks()
        width = len(values[0])
        x = np.asarray(values.flatten(), dtype=np.float64).reshape(-1, width)[order]
        # Divided by a power of two of its own, no vector's square overflows or vanishes; cosines stay the same.
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
        norm = np.sqrt((x * x).sum(axis=1))
        parts = quantised(x)
        at_left, at_right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        counts = np.zeros(len(number), dtype=np.int64)
        label = np.arange(len(number))
        other = tuple(p[at_right] for p in parts)
        for low in range(0, len(at_left), STRIPE):
            rows = at_left[low : low + STRIPE]
            i, j = candidate_pairs(tuple(p[rows] for p in parts), other, threshold)
            i, j = rows[i], at_right[j]
            if first == second:
                i, j = i[i < j], j[i < j]
            hit = np.zeros(len(i), dtype=bool)
            for k in range(0, len(i), 1 << 16):
                a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                hit[k : k + (1 << 16)] = (x[a] * x[b]).sum(axis=1) / (norm[a] * norm[b]) >= threshold
            i, j = i[hit], j[hit]
            counts += np.bincount(i, weights=times[j], minlength=len(number)).astype(np.int64)
            counts += np.bincount(j, weights=times[i], minlength=len(number)).astype(np.int64)
            if len(i):
                # The links of all stripes so far are those of node and label.
                label = _forest(np.concatenate([i, np.arange(len(number))]), np.concatenate([j, label]), len(number))
        some = counts > 0
        return pa.table({"number": pa.array(number[some]), "links": pa.array(counts[some]), "linked": pa.array(number[label[some]])})

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, block: int = 2048, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Per row ``id``, ``n_links``, ``component``, ``kept``: links join vectors of equal labels with cosine >= ``threshold``.

    Vectors that are null, empty or zero, or hold null or non-finite components, and those with a null label or id link
    with nothing; vectors of different lengths don't link. Their component is their own id. Equal
    vectors link with each other. Rows that repeat an id are vectors of their own: each has its own links and component,
    which is named after the smallest id in it. Components of any finite size count. An empty table gives an empty
    result. Other columns are ignored.
    """
    vector = F.col(vector_column).cast("array<double>")
    rows = embeddings.select(F.col(id_column).cast("bigint").alias("id"), F.col(label_column).cast("string").alias("label"), vector.alias("vector"))
    good = rows.where(usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    # -0.0 is 0.0 here, so that equal vectors are equal keys.
    good = good.select("id", "label", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector"))
    same = good.groupBy("label", "vector").agg(F.min("id").alias("low"), F.count("*").alias("times"))
    full = F.concat_ws(":", F.size("vector").cast("string"), "label").alias("label")
    # A group of equal vectors has a number of its own: one id may stand in several groups.
    same = materialize(same.select(full, "vector", "low", "times", F.monotonically_increasing_id().alias("number")), "vectors")
    blocks = same.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = same.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int"))
    # A vector stands in the tiles of its block with every block.
    tiles = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("label", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "number", "times", "vector")
    found = tiles.groupBy("label", "one", "two").applyInArrow(_tile(threshold), "number bigint, links bigint, linked bigint")
    found = materialize(found, "tile-links")
    links = found.groupBy("number").agg(F.sum("links").alias("links"))
    merged = connected_components(found.select(F.col("number").alias("a"), F.col("linked").alias("b")))
    groups = same.join(links, "number", "left").join(merged.withColumnRenamed("node", "number"), "number", "left")
    groups = groups.select(F.col("label").alias("full"), "vector", "times", "low", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "number").alias("top"))
    groups = materialize(groups, "vector-groups")
    lowest = groups.groupBy("top").agg(F.min("low").alias("component"))
    facts = groups.join(lowest, "top").select("full", "vector", "times", "links", "component")
    members = good.withColumn("full", F.concat_ws(":", F.size("vector").cast("string"), "label")).join(facts, ["full", "vector"])
    linked = members.select("id", (F.col("links") + F.col("times") - 1).alias("n_links"), "component")
    fits = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    alone = rows.where(~F.coalesce(fits, F.lit(False))).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))
