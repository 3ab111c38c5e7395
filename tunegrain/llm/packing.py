"""Packing documents into fixed-length training sequences: cutting stock with column generation.

A document's ids are cut into full sequences and one remainder. The remainders' lengths form a histogram, which never
has more than ``size - 1`` entries, whatever the input. Over it a linear program chooses patterns, multisets of lengths
that fit into one sequence. Patterns are generated: a knapsack dynamic program finds the one with the best price
under the current duals, until none helps. The solution is rounded down; what is left, a few pieces per
length at most, is filled greedily. Documents are ranked within their length, and the patterns are dealt
to ranks by arithmetic in a join with the (small) table of pattern slots.

Where lengths above half a sequence are too many to find partners, no pattern avoids padding. So before, the
longest pieces of the greedy patterns with the most padding are cut at half a sequence, until the pieces cut could
fill the padding that the other patterns have.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunegrain.llm.shared import materialize, numbered
from tunegrain.session import bound_batches
from tunegrain.llm.tokens import encoded

SIZE = 1024
END_ID = 0
#: Pricing ends when the program is this close to its lower bound, or after so many columns.
GAP = 1e-3
MOST_COLUMNS = 300


def padded(total: int, size: int = SIZE) -> int:
    """Length of a sequence with ``total`` ids: the full size, but for a power of two."""
    return total if total & (total - 1) == 0 else size


def _fill(left: np.ndarray, sizes: np.ndarray, size: int) -> dict[int, int]:
    """Greedy pattern: the largest length that still has demand, then again what fits. Index to count."""
    pattern: dict[int, int] = {}
    room = size
    for i in np.flatnonzero(left > 0)[::-1].tolist():
        k = int(min(room // sizes[i], np.ceil(left[i])))
        if k:
            pattern[i] = k
            room -= k * int(sizes[i])
        if not room:
            break
    return pattern


def _greedy(demand: np.ndarray, sizes: np.ndarray, size: int) -> list[tuple[dict[int, int], float, int]]:
    """Greedy patterns, how often each is used (in fractions), and the length (index) that it uses up."""
    left, found = demand.copy(), []
    while (left > 1e-9).any():
        pattern = _fill(left, sizes, size)
        times, i = min((left[i] / k, i) for i, k in pattern.items())
        for j, k in pattern.items():
            left[j] -= times * k
        left[i] = 0.0
        left[left < 1e-9] = 0.0
        found.append((pattern, times, i))
    return found


def _best_patterns(prices: np.ndarray, sizes: np.ndarray, size: int) -> tuple[float, dict[int, int]]:
    """The pattern with the largest (price of its pieces - its padded length / size): knapsack over exact sums."""
    value = np.full(size + 1, -np.inf)
    value[0] = 0.0
    last = np.zeros(size + 1, dtype=np.int64)
    for t in range(1, size + 1):
        n = int(np.searchsorted(sizes, t, side="right"))
        if n:
            options = value[t - sizes[:n]] + prices[:n]
            last[t] = k = int(options.argmax())
            value[t] = options[k]
    cost = np.array([padded(t, size) for t in range(size + 1)]) / size
    gain = value - cost
    gain[0] = -np.inf
    t = int(gain.argmax())
    best, pattern = float(gain[t]), {}
    while t:
        k = int(last[t])
        pattern[k] = pattern.get(k, 0) + 1
        t -= int(sizes[k])
    return best, pattern


def _program(sizes: np.ndarray, demand: np.ndarray, size: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """Patterns (index to count) and how often each is used, by column generation."""
    d = len(sizes)

    def cost(pattern: dict[int, int]) -> float:
        return padded(sum(int(sizes[i]) * k for i, k in pattern.items()), size) / size

    # A first basis: greedy patterns, each used until one of its lengths is used up. So each has a length that later
    # ones lack, and the matrix is triangular.
    greedy = _greedy(demand, sizes, size)
    used_up = [i for _, _, i in greedy]
    spare = sorted(set(range(d)) - set(used_up))  # used up together with another
    basis = [p for p, _, _ in greedy] + [{i: size // int(sizes[i])} for i in spare]
    x = np.array([t for _, t, _ in greedy] + [0.0] * len(spare))
    # Its inverse, by substitution; later columns lack the row that a column uses up.
    by_row: list[list[tuple[int, int]]] = [[] for _ in range(d)]
    inverse = np.zeros((d, d))
    for c, (pattern, i) in enumerate(zip(basis, used_up + spare, strict=True)):
        inverse[c, i] = 1.0
        for q, k in by_row[i]:
            inverse[c] -= k * inverse[q]
        inverse[c] /= pattern[i]
        for j, k in pattern.items():
            by_row[j].append((c, k))
    costs = np.array([cost(p) for p in basis])
    least = float((sizes * demand).sum()) / size
    prices = (costs[:, None] * inverse).sum(axis=0)
    for _ in range(MOST_COLUMNS):
        if float((costs * x).sum()) <= least * (1 + GAP):
            break
        gain, pattern = _best_patterns(prices, sizes, size)
        if gain <= 1e-6:
            break
        direction = sum(k * inverse[:, i] for i, k in pattern.items())
        ratios = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        step = ratios[out]
        x = np.maximum(x - step * direction, 0.0)
        x[out] = step
        pivot = inverse[out] / direction[out]
        prices -= gain * pivot
        inverse -= direction[:, None] * pivot
        inverse[out] = pivot
        basis[out], costs[out] = pattern, cost(pattern)
    return basis, x


def choose_cuts(histogram: dict[int, int], size: int = SIZE) -> dict[int, int]:
    """How many remainders of each length above half a sequence to cut there."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], dtype=np.float64)
    found = []
    for pattern, times, _ in _greedy(demand, sizes, size):
        total = sum(int(sizes[i]) * k for i, k in pattern.items())
        found.append((padded(total, size) - total, times, int(sizes[max(pattern)])))
    padding = sum(waste * times for waste, times, _ in found)
    cuts: dict[int, int] = {}
    moved = 0.0
    for waste, times, longest in sorted(found, reverse=True):
        if moved >= padding:
            break
        if longest <= size // 2 or not waste:
            continue
        n = int(min(np.ceil(times), np.ceil((padding - moved) / (longest + waste))))
        n = min(n, histogram[longest] - cuts.get(longest, 0))
        cuts[longest] = cuts.get(longest, 0) + n
        moved += n * longest
        padding -= n * waste
    return {s: n for s, n in cuts.items() if n}


def after_cuts(histogram: dict[int, int], cuts: dict[int, int], size: int = SIZE) -> dict[int, int]:
    out = dict(histogram)
    for length, n in cuts.items():
        for part, k in ((length, -n), (size // 2, n), (length - size // 2, n)):
            out[part] = out.get(part, 0) + k
    return {s: n for s, n in out.items() if n}


def solve(histogram: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Patterns (length to count) with how often each is used; together they hold exactly the histogram."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], dtype=np.float64)
    if not len(sizes):
        return []
    basis, x = _program(sizes, demand, size)
    left = demand.astype(np.int64)
    plan: list[tuple[dict[int, int], int]] = []
    for pattern, times in sorted(zip(basis, x, strict=True), key=lambda p: -p[1]):
        n = min([int(times + 1e-6), *(int(left[i]) // k for i, k in pattern.items())])
        if n > 0:
            plan.append((pattern, n))
            for i, k in pattern.items():
                left[i] -= n * k
    while left.any():
        pattern = _fill(left, sizes, size)
        n = min(int(left[i]) // k for i, k in pattern.items())
        plan.append((pattern, n))
        for i, k in pattern.items():
            left[i] -= n * k
    return [({int(sizes[i]): k for i, k in p.items()}, n) for p, n in plan]


def slots(plan: list[tuple[dict[int, int], int]]) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, ranks' end, first sequence, pieces per sequence, first offset), and the number of sequences."""
    rows, given, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for length, k in sorted(pattern.items(), reverse=True):
            first = given.get(length, 0)
            given[length] = first + k * times
            rows.append((length, first, given[length], sequence, k, offset))
            offset += length * k
        sequence += times
    return rows, sequence


_PIECES = "array<struct<start:bigint,length:bigint,ids_crc32:bigint>>"
_PIECE_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))


def _tokenize(json_path: str, ranks_path: str, size: int):
    """Per document its full pieces, its remainder (0 or 1 pieces), and the remainder's halves if it may be cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], dtype="<u4")

        def piece(own: np.ndarray, low: int, high: int) -> dict[str, int]:
            return {"start": low, "length": high - low, "ids_crc32": zlib.crc32(own[low:high].tobytes())}

        for batch in batches:
            for low, high, ids, first in encoded(batch, 1, json_path, ranks_path):
                counts, full, rest, halves = [], [], [], []
                for i in range(high - low):
                    own = np.concatenate([ids[first[i] : first[i + 1]], end]).astype("<u4")
                    n = len(own)
                    edge = n // size * size
                    middle = edge + size // 2
                    counts.append(n)
                    full.append([piece(own, k, k + size) for k in range(0, edge, size)])
                    rest.append([piece(own, edge, n)] if edge < n else [])
                    halves.append([piece(own, edge, middle), piece(own, middle, n)] if middle < n else [])
                yield pa.record_batch(
                    [batch.column(0).slice(low, high - low), pa.array(counts, pa.int64()), *(pa.array(x, _PIECE_TYPE) for x in (full, rest, halves))],
                    names=["doc_id", "doc_tokens", "full", "rest", "halves"],
                )

    return run


def _running(rows: DataFrame, amount: str, order: str, name: str, buckets: int) -> DataFrame:
    """Adds the sum of ``amount`` over the rows before, in a fixed order that is cut into ``buckets`` windows."""
    part = F.pmod(F.xxhash64(order), F.lit(buckets)).cast("int")
    cut = rows.withColumn("part", part)
    # One row per bucket, a fixed number.
    parts = cut.groupBy("part").agg(F.sum(amount).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return cut.withColumn("inner", inner).join(parts, "part").withColumn(name, F.col("before") + F.col("inner")).drop("part", "before", "inner")


def pack(documents: DataFrame, size: int = SIZE, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", buckets: int = 256) -> DataFrame:
    """Per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Every document ends with id 0, so a null or empty text has one id. Each row is a document, whether its id repeats
    or is null. Long texts give as many full sequences as they fill. An empty table gives an empty result. Other
    columns are ignored. ``tokenizer`` and ``ranks`` name files of one vocabulary.
    """
    spark: SparkSession = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    paths = public_tokenizers.path(tokenizer), public_tokenizers.path(ranks)
    schema = f"doc_id {kind}, doc_tokens bigint, full {_PIECES}, rest {_PIECES}, halves {_PIECES}"
    rows = bound_batches(documents.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(_tokenize(*paths, size), schema)
    rows = rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("left", F.col("doc_tokens") % size)
    rows = materialize(rows, "tokenized")
    counts = rows.where("left > 0").groupBy("left").agg(F.count("*").alias("n"))
    histogram = {r.left: r.n for r in counts.collect()}  # fewer than ``size`` rows
    cuts = choose_cuts(histogram, size)
    listed, sequences = slots(solve(after_cuts(histogram, cuts, size), size))

    # Remainders: as many of a length as are to be cut give two pieces each.
    table = spark.createDataFrame(list(cuts.items()) or [(0, 0)], "left bigint, cuts bigint")
    some = numbered(rows.where("left > 0").select("doc_id", "doc_tokens", "uid", "left", "rest", "halves"), ["left"], ["uid"], "turn", buckets)
    some = some.join(F.broadcast(table), "left", "left").withColumn("parts", F.when(F.col("turn") < F.col("cuts"), F.col("halves")).otherwise(F.col("rest")))
    some = some.select("doc_id", "doc_tokens", "uid", F.inline("parts"))
    some = numbered(some, ["length"], ["uid", "start"], "rank", buckets)
    slot = spark.createDataFrame(listed or [(0, 0, 0, 0, 1, 0)], "length bigint, rank_from bigint, rank_to bigint, base bigint, per bigint, shift bigint")
    some = some.join(F.broadcast(slot), "length").where("rank >= rank_from and rank < rank_to")
    turn = F.col("rank") - F.col("rank_from")
    some = some.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.floor(turn / F.col("per"))).cast("bigint").alias("sequence_id"),
        (F.col("shift") + (turn % F.col("per")) * F.col("length")).cast("bigint").alias("offset"),
    )
    long = rows.where(F.size("full") > 0).select("doc_id", "doc_tokens", "uid", "full", F.size("full").cast("bigint").alias("n_full"))
    long = _running(long, "n_full", "uid", "first", buckets).select("doc_id", "doc_tokens", "first", F.inline("full"))
    number = (F.col("first") + F.floor(F.col("start") / size) + sequences).cast("bigint")
    return some.unionByName(long.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
