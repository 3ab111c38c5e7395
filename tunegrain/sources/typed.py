"""JSON records of unknown shape to typed columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunegrain.functions import jsontext
from tunegrain.session import materialize

POSITION = ("_file", "_block", "_pos")
WRAPPED = "value"

#: Where a column is first seen: rank and path of the file, block and place of the row, place of the key.
Spot = tuple[int, str, int, int, int]

_TYPE_WORD = re.compile(r"`(?:[^`]|``)*`|\bOBJECT<|\bVOID\b(?!:)|\bDECIMAL\(\d+, ?\d+\)")


def _parsed(shape: str) -> T.StructType:
    """A VARIANT shape (``OBJECT<...>``) as a Spark type; unknown types stay void."""

    def spark_name(match: re.Match) -> str:
        word = match.group()
        return word if word.startswith("`") else {"O": "STRUCT<", "V": "VOID", "D": "DOUBLE"}[word[0]]

    return T.DataType.fromDDL(_TYPE_WORD.sub(spark_name, shape))


def _merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both; text where they do not agree."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        mine, other = {f.name: f.dataType for f in a}, {f.name: f.dataType for f in b}
        names = [*mine, *(n for n in other if n not in mine)]
        return T.StructType(
            [T.StructField(n, _merged(mine.get(n, T.NullType()), other.get(n, T.NullType()))) for n in names]
        )
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_merged(a.elementType, b.elementType))
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    return T.VariantType()


def _settled(dtype: T.DataType, top: bool = False) -> T.DataType:
    """Values that only ever were null are text; so is a column whose rows disagree on its type."""
    if isinstance(dtype, T.NullType) or (top and isinstance(dtype, T.VariantType)):
        return T.StringType()
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_settled(dtype.elementType))
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _settled(f.dataType, False)) for f in dtype])
    return dtype


def column_types(shapes: Iterable[str | None]) -> dict[str, T.DataType]:
    """Top-level columns over several merged shapes."""
    known = [_parsed(s) for s in shapes if s and s.startswith("OBJECT<") and s != "OBJECT<>"]
    merged = reduce(_merged, known) if known else T.StructType([])
    return {f.name: _settled(f.dataType, top=True) for f in merged}


def key_lists(rows: DataFrame, *more: F.Column) -> DataFrame:
    """Each file's distinct lists of ``keys`` with the first place (``spot``) of each; combined on the map side."""
    return rows.groupBy("_file", "keys").agg(F.min(F.struct("_block", "_pos")).alias("spot"), *more)


def first_seen(lists: DataFrame, places: DataFrame) -> dict[str, Spot]:
    """The first spot of every key of all rows. ``places``: ``_file, rank, file`` of the files, whose order counts first."""
    placed = lists.join(places, "_file").select("rank", "file", "spot._block", "spot._pos", F.posexplode("keys").alias("at", "name"))
    first = placed.groupBy("name").agg(F.min(F.struct("rank", "file", "_block", "_pos", "at")).alias("first"))
    return {r["name"]: tuple(r["first"]) for r in first.collect()}  # one row for each column


def by_spot(names: Iterable[str], seen: dict[str, Spot]) -> list[str]:
    """``names`` in the order in which they were seen; any others after them, by name."""
    return sorted(names, key=lambda n: (n not in seen, seen.get(n, ()), n))


def schema_ddl(types: dict[str, T.DataType], names: Sequence[str]) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` {types[name].simpleString()}" for name in names)


def spread(rows: DataFrame, names: Sequence[str], plain: F.Column | None) -> DataFrame:
    """Position, the fields of ``_typed``, and ``plain`` (text of values that are no objects) as ``value``."""
    columns = {name: F.col("_typed").getField(name) for name in names}
    if plain is not None:
        columns[WRAPPED] = F.coalesce(plain, columns[WRAPPED].cast("string")) if WRAPPED in columns else plain
    return rows.select(*POSITION, *[c.alias(name) for name, c in columns.items()])


def record_keys(v: F.Column, text: F.Column) -> F.Column:
    """The keys of a record as written; one that is no object counts as an object with the one key WRAPPED."""
    return F.when(jsontext.is_object(v), F.json_object_keys(text)).otherwise(F.array(F.lit(WRAPPED)))


def to_columns(records: DataFrame, places: DataFrame) -> tuple[DataFrame, dict[str, Spot]]:
    """Stored ``records`` (position columns, ``v``: VARIANT, ``keys``: names as written) to columns, and where each was first seen.

    Values that are not objects go to a column named ``value``.
    """
    wrapped = ~jsontext.is_object(F.col("v"))
    lists = key_lists(records, F.schema_of_variant_agg(F.when(~wrapped, F.col("v"))).alias("shape"), F.count_if(wrapped).alias("plain"))
    lists = materialize(lists, "key-lists")
    types = column_types(r["shape"] for r in lists.select("shape").distinct().toLocalIterator())
    seen = first_seen(lists, places)
    names = by_spot(types, seen)
    typed = records.withColumn("_typed", F.try_variant_get("v", "$", f"struct<{schema_ddl(types, names)}>")) if names else records
    plain = F.when(wrapped, F.try_variant_get("v", "$", "string")) if lists.where("plain > 0").limit(1).count() else None
    return spread(typed, names, plain), seen
