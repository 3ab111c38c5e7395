"""Scalar text and number expressions with Python's semantics."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 29 code points for which Python's str.isspace() is true.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# Last bytes of those code points in UTF-8; other characters may end in them as well.
_LAST_BYTES = sorted({ch.encode()[-1:] for ch in PY_WHITESPACE})

CHARS_PER_TOKEN = 4


def named(name: str) -> Column:
    """A column by its exact name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    """Python ``str.strip``.

    Trimming a given character set from the right makes Spark index every character of
    the string, so that step runs only when the last byte allows for white space.
    """
    last_byte = F.substring(c.cast("binary"), -1, 1)
    may_end_in_space = last_byte.isin(*[F.lit(b) for b in _LAST_BYTES])
    spaces = F.lit(PY_WHITESPACE)
    return F.ltrim(F.when(may_end_in_space, F.rtrim(c, spaces)).otherwise(c), spaces)


def strip_computed(c: Column) -> Column:
    """The same for a costly expression: slower per character, but evaluates ``c`` once."""
    return F.btrim(c, F.lit(PY_WHITESPACE))


def as_text(c: Column, dtype: T.DataType) -> Column:
    """Any value as a string: nested values as JSON, scalars by Spark's cast."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def clean(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Null becomes the empty string, everything else stripped text."""
    return F.coalesce(strip(as_text(c, dtype)), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def slugify(c: Column) -> Column:
    dashed = F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(blank_to_null(dashed), F.lit("dataset"))


def named_id(name: Column, suffix: Column | None = None) -> Column:
    """Slug of at most 40 characters, a dash and 8 hex digits (random unless ``suffix`` is given)."""
    if suffix is None:
        suffix = F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)
    return F.concat(F.substring(slugify(name), 1, 40), F.lit("-"), suffix)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and may be used many times."""
    return F.transform(F.array(value), body)[0]


def _halves(x: Column, then: Callable[[Column, Column], Column]) -> Column:
    """A double as the sum of two that have at most 26 significant bits each."""
    spread = x * F.lit(134217729.0)
    return let(spread - (spread - x), lambda high: then(high, x - high))


def _product_error(a: Column, b: Column, product: Column) -> Column:
    """Exact difference between ``a * b`` and its rounded value ``product``."""
    return _halves(
        a,
        lambda ah, al: _halves(b, lambda bh, bl: ((ah * bh - product) + ah * bl + al * bh) + al * bl),
    )


def py_round(c: Column, digits: int | Column) -> Column:
    """Python ``round(x, digits)`` for doubles of moderate size and 0 to 22 digits.

    ``bround`` rounds the shortest decimal text of a double; Python rounds its exact binary
    value, so 0.0125 gives 0.013 (the stored value lies just above the tie). The only hard
    case is a value equal to the double nearest the tie; there the sign of that double's own
    error decides, taken from an exact product.
    """
    scale = F.lit(float(10**digits)) if isinstance(digits, int) else F.pow(F.lit(10.0), digits)

    def tie_goes_up(tie: Column, below: Column, doubled: Column) -> Column:
        odd, product = below * 2 + 1, tie * doubled
        side = let((product - odd) + _product_error(tie, doubled, product), lambda s: F.signum(s))
        return F.coalesce(F.nullif(side, F.lit(0.0)) > 0, below % 2 == 1)

    def rounded(x: Column, s: Column, below: Column) -> Column:
        up = let(
            (below * 2 + 1) / (s * 2),
            lambda tie: F.when(x != tie, x > tie).otherwise(tie_goes_up(tie, below, s * 2)),
        )
        return (below + up.cast("double")) / s

    def magnitude(v: Column) -> Column:
        x, s = F.abs(v["x"]), v["s"]
        floor = let(F.floor(x * s).cast("double"), lambda f: F.when(f / s > x, f - 1).otherwise(f))
        return let(floor, lambda below: rounded(x, s, below) * F.when(v["x"] < 0, -1.0).otherwise(1.0))

    return let(F.struct(c.cast("double").alias("x"), scale.alias("s")), magnitude)


def significant(c: Column, digits: int) -> Column:
    """Rounded like Python's ``%e`` format with ``digits`` significant digits."""
    size = F.floor(F.log10(F.abs(F.nullif(c, F.lit(0.0)))))
    places = F.least(F.greatest(F.lit(digits - 1) - size, F.lit(0)), F.lit(22))
    return F.coalesce(py_round(c, places), c)


# Fixed value: what Python's float() accepts as finite or special text.
PY_FLOAT_PATTERN = (
    r"^[+-]?((\d+(_\d+)*)?\.\d+(_\d+)*|\d+(_\d+)*\.?)([eE][+-]?\d+(_\d+)*)?$|^[+-]?(?i:inf|infinity|nan)$"
)


def py_float(c: Column) -> Column:
    """Python ``float(text)``; null where that would raise."""
    text = strip(c)
    return F.when(text.rlike(PY_FLOAT_PATTERN), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def estimate_tokens(text: Column, tokenizer: Callable[[Column], Column] | None = None) -> Column:
    """About four characters per token, at least one; a tokenizer's non-null answer wins."""
    estimate = F.greatest(F.lit(1), F.bround(F.length(text) / F.lit(float(CHARS_PER_TOKEN))).cast("int"))
    return estimate if tokenizer is None else F.coalesce(tokenizer(text).cast("int"), estimate)


def or_none(call: Callable[..., object], rows: Iterable[tuple]) -> pd.Series:
    """``call`` on each row; a row for which it raises gets null."""

    def attempt(row: tuple):
        try:
            return None if any(v is None for v in row) else call(*row)
        except Exception:
            return None

    return pd.Series([attempt(row) for row in rows], dtype=object)


def token_counter(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """A tokenizer for ``estimate_tokens`` from a Python function; errors fall back to the estimate."""

    @F.pandas_udf(T.IntegerType())
    def counted(texts: pd.Series) -> pd.Series:
        return or_none(count, zip(texts))

    return counted
