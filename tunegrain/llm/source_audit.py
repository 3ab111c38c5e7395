"""How far the sources of a language stand apart: term shares of each against each, and against the whole language.

Term counts of a (language, source) group are arrays of term numbers and counts, sorted by number. For every unordered
pair of a language's sources the two groups' arrays are brought together and merged once: a galloping intersection
prices the terms that both have, then those of one side only, in both directions. Terms that neither has all
cost the same, so they are priced together from their number.

A vocabulary is cut by hash into slices of bounded size, and sources into blocks: a task co-groups one slice of two
blocks of sources and merges their pairs one by one. An array so travels once for each block, not once for each
pair. Values of slices are added up. All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunegrain.llm.shared import drop_tables, materialize
from tunegrain.operators.toplist import first_per_key

#: Shares are whole parts of this number.
PARTS = 10**9
#: Terms of a slice, about, and sources of a block: a task holds two blocks' arrays of one slice.
SLICE = 1 << 15
BLOCK = 32
#: Entries that a task counts before it hands them on.
HELD = 200_000
#: Bytes of a text that are split into terms at once.
PIECE = 1 << 20

#: A-Z become a-z, other ASCII signs a space; longer UTF-8 sequences stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text, in lists of about PIECE bytes; no term is cut."""
    low = 0
    while low < len(text):
        high = low + PIECE
        while high < len(text) and _FOLD[text[high]] != 32:
            high += 1
        yield text[low:high].translate(_FOLD).split()
        low = high


_COUNTS = "lang string, source string, term binary, n bigint, docs bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by group and term, and documents with the term; a row without a term says that the group occurs."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def given() -> pa.RecordBatch:
        rows = [(*group, term, n, docs[term]) for group, (counts, docs) in held.items() for term, n in counts.items()]
        rows += [(*group, None, 0, 0) for group in held]
        held.clear()
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=["lang", "source", "term", "n", "docs"])

    entries = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            entries -= len(counts)
            seen: set[bytes] = set()
            for terms in _terms(text.as_buffer().to_pybytes()):
                counts.update(terms)
                seen.update(terms)
            docs.update(seen)
            entries += len(counts)
            if entries > HELD:
                yield given()
                entries = 0
    if held:
        yield given()


def _shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(PARTS * (count + 1) / whole), by long division in three steps, exact for ``whole`` up to 9e15."""
    rest, out = counts + 1, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def _gaps(p: np.ndarray, q: np.ndarray) -> int:
    """Sum of floor((p - q) ** 2 / q)."""
    return int(((p - q) * (p - q) // q).sum())


def _gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where each of ``short`` would stand in ``long``, both sorted: doubling steps from a bound, then halving."""
    if not len(long):
        return np.zeros(len(short), dtype=np.int64)
    # Members of the short array lie about this far apart in the long one.
    stride = max(1, len(long) // max(1, len(short)))
    low = np.zeros(len(short), dtype=np.int64)
    step = np.full(len(short), stride, dtype=np.int64)
    going = np.arange(len(short))
    while len(going):
        reach = low[going] + step[going]
        go = (reach < len(long)) & (long[np.minimum(reach, len(long) - 1)] < short[going])
        going, reach = going[go], reach[go]
        low[going] = reach
        step[going] *= 2
    high = np.minimum(low + step, len(long))
    while (low < high).any():
        middle = (low + high) // 2
        below = (low < high) & (long[np.minimum(middle, len(long) - 1)] < short)
        low, high = np.where(below, middle + 1, low), np.where(below, high, np.minimum(high, middle))
    return low


def _meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in both arrays of the numbers that both have."""
    if len(a) > len(b):
        there, here = _meeting(b, a)
        return here, there
    at = _gallop(a, b)
    hit = np.flatnonzero((at < len(b)) & (b[np.minimum(at, max(0, len(b) - 1))] == a)) if len(b) else np.zeros(0, np.int64)
    return hit, at[hit]


def _sides(table: pa.Table) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """Source, total, term numbers and counts of each row; a source without terms in the slice has empty arrays."""
    out = []
    for i in range(table.num_rows):
        source, whole, terms, counts = (table.column(n)[i] for n in ("source", "whole", "terms", "counts"))
        arrays = (np.asarray(x.values, dtype=np.int64) if x.is_valid else np.zeros(0, np.int64) for x in (terms, counts))
        out.append((source.as_py(), whole.as_py(), *arrays))
    return out


_PRICED = "lang string, one string, two string, one_two decimal(38,0), two_one decimal(38,0), met bigint"


def _merged(one: tuple, two: tuple) -> tuple[int, int, int]:
    """What the terms of either group cost, in both directions, and how many they are."""
    (_, whole_a, ids_a, n_a), (_, whole_b, ids_b, n_b) = one, two
    none_a, none_b = (_shares(np.zeros(1, np.int64), w) for w in (whole_a, whole_b))
    p_a, p_b = _shares(n_a, whole_a), _shares(n_b, whole_b)
    i, j = _meeting(ids_a, ids_b)
    only_a, only_b = np.delete(p_a, i), np.delete(p_b, j)
    forth = _gaps(p_a[i], p_b[j]) + _gaps(only_a, none_b) + _gaps(none_a, only_b)
    back = _gaps(p_b[j], p_a[i]) + _gaps(only_b, none_a) + _gaps(none_b, only_a)
    return forth, back, len(ids_a) + len(ids_b) - len(i)


def _merge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """One slice of the pairs of two blocks of sources (right), or of one block with itself (left alone)."""
    mine, other = _sides(left), _sides(right)
    pairs = [(a, b) for a in mine for b in other] if key[2] != key[3] else [(a, b) for a in mine for b in mine if a[0] < b[0]]
    pairs = [(a, b) for a, b in pairs if len(a[2]) or len(b[2])]
    sums = [_merged(a, b) for a, b in pairs]
    return pa.table(
        {
            "lang": pa.array([key[0].as_py()] * len(pairs), pa.string()),
            "one": pa.array([a[0] for a, _ in pairs], pa.string()),
            "two": pa.array([b[0] for _, b in pairs], pa.string()),
            "one_two": pa.array([s[0] for s in sums], pa.decimal128(38, 0)),
            "two_one": pa.array([s[1] for s in sums], pa.decimal128(38, 0)),
            "met": pa.array([s[2] for s in sums], pa.int64()),
        }
    )


def _share(count: str, whole: str) -> str:
    """The same in SQL; the product may exceed a long."""
    return f"(1 + ({PARTS}BD * cast({count} + 1 as decimal(20, 0))) div cast(greatest({whole}, 1) as decimal(20, 0)))"


def _gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div ({q})"


def audit(documents: DataFrame, least: int = 3, top: int = 200, lang_column: str = "lang", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """Rows ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: what sets a source apart.

    Part ``pair`` has every other source of the language, part ``term`` the ``top`` terms that the source uses more
    than its language does. A language keeps the terms of at least ``least`` of its rows. Null lang, source and text
    count as empty; an empty text still makes its group occur. Rows that repeat an id count as documents each. Terms
    of any length and texts of any length are read whole; ties go to the item that comes first in UTF-8. A language
    without kept terms has pairs of value 0. An empty table gives an empty result. Other columns are ignored.
    """
    plain = documents.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    # Dealt out by term once: counts of a group, of the language, and the term's number all come from there.
    counted = plain.mapInArrow(_count, _COUNTS).repartition("lang", "term")
    counted = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = counted.withColumn("place", F.monotonically_increasing_id())
    term = Window.partitionBy("lang", "term")
    counted = counted.withColumns({"lang_n": F.sum("n").over(term), "lang_docs": F.sum("docs").over(term), "number": F.min("place").over(term)})
    uses = counted.where(F.col("term").isNull() | (F.col("lang_docs") >= least))
    uses = uses.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "lang_n", "number", (F.col("place") == F.col("number")).alias("leads"))
    uses = materialize(uses, "term-uses")
    kept = uses.where("term is not null")
    # One row of a term leads, so that terms are counted once.
    languages = kept.where("leads").groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_n"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = uses.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    v = F.coalesce("v", F.lit(0).cast("bigint"))
    position = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("position")
    groups = groups.select("lang", "source", v.alias("v"), (F.coalesce("n", F.lit(0)) + v).alias("whole"), (F.coalesce("lang_n", F.lit(0)) + v).alias("lang_whole"), position)
    groups = materialize(groups, "term-groups")
    return _leading_terms(kept, groups, top).unionByName(_pair_values(kept, groups))


#: Parts of a group's terms where they meet the group's total: one source may hold a third of all.
SALTS = 32


def _leading_terms(uses: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    salted = uses.withColumn("salt", F.pmod(F.xxhash64("term", F.lit(3)), F.lit(SALTS)))
    facts = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    priced = salted.join(facts, ["lang", "source", "salt"])
    priced = priced.withColumns({"p": F.expr(_share("n", "whole")), "q": F.expr(_share("lang_n", "lang_whole"))}).where("p > q")
    priced = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_gap("p", "q")).alias("value"))
    first = first_per_key(priced, ["lang", "source"], [F.desc("value"), F.col("item")], top, slices=SALTS)
    return _ranked(first)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))


def _pair_values(uses: DataFrame, groups: DataFrame) -> DataFrame:
    slices = -(-(groups.agg(F.max("v")).first()[0] or 1) // SLICE)
    cut = F.pmod(F.xxhash64("number"), F.lit(slices)).cast("int").alias("slice")
    arrays = uses.groupBy("lang", "source", cut).agg(F.sort_array(F.collect_list(F.struct("number", "n"))).alias("all"))
    arrays = materialize(arrays.select("lang", "source", "slice", F.col("all.number").alias("terms"), F.col("all.n").alias("counts")), "term-arrays")
    blocked = groups.where("v > 0").withColumn("block", F.floor(F.col("position") / BLOCK).cast("int"))
    blocks = blocked.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    blocked = blocked.select("lang", "source", "whole", "block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")).join(blocks, "lang")
    stood = materialize(blocked.join(arrays, ["lang", "source", "slice"], "left"), "term-blocks")
    drop_tables(arrays)
    keys = ["lang", "slice", "first", "second"]
    held = [*keys, "source", "whole", "terms", "counts"]
    left = stood.withColumn("first", F.col("block")).withColumn("second", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    right = stood.where("block > 0").withColumn("first", F.explode(F.sequence(F.lit(0), F.col("block") - 1))).withColumn("second", F.col("block"))
    right = right.select(*[F.col(c).alias(c) for c in held])
    merged = left.select(*held).groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_merge, _PRICED)
    merged = merged.groupBy("lang", "one", "two").agg(F.sum("one_two").alias("one_two"), F.sum("two_one").alias("two_one"), F.sum("met").alias("met"))
    merged = materialize(merged, "pair-values")
    drop_tables(stood)
    one = groups.select("lang", F.col("source").alias("one"), F.col("whole").alias("whole_one"), "v")
    two = groups.select("lang", F.col("source").alias("two"), F.col("whole").alias("whole_two"))
    # The result has a row for each direction of every pair of a language's sources.
    valued = one.join(two, "lang").where("one < two").join(merged, ["lang", "one", "two"], "left")
    absent, p, q = "(v - coalesce(met, 0))", _share("0L", "whole_one"), _share("0L", "whole_two")
    forth = F.expr(f"cast(coalesce(one_two, 0) + cast({absent} as decimal(20, 0)) * ({_gap(p, q)}) as bigint)")
    back = F.expr(f"cast(coalesce(two_one, 0) + cast({absent} as decimal(20, 0)) * ({_gap(q, p)}) as bigint)")
    valued = valued.select("lang", "one", "two", forth.alias("forth"), back.alias("back"))
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item"), F.col("forth").alias("value")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"), F.col("back").alias("value"))))
    rows = valued.select("lang", both.alias("row")).select("lang", "row.source", F.lit("pair").alias("part"), "row.item", "row.value")
    return _ranked(rows)
