"""JSON handling on VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunegrain.functions.text import let

# A private-use marker that closes the probe array in parse_strict.
_END = "end"

# Private-use characters that stand for parts of a text while it is rewritten.
_BACKSLASHES, _QUOTE = "\ue010", "\ue011"
_BARE = r"\b(NaN|Infinity)\b"


def quote_bare_numbers(text: Column) -> Column:
    """``NaN`` and ``Infinity`` outside strings as strings, which still cast to those numbers."""
    hidden = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASHES)), F.lit('\\"'), F.lit(_QUOTE))

    def outside(part: Column, at: Column) -> Column:
        return F.when(at % 2 == 0, F.regexp_replace(part, "-?" + _BARE, '"$0"')).otherwise(part)

    quoted = F.array_join(F.transform(F.split(hidden, '"'), outside), '"')
    return F.replace(F.replace(quoted, F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASHES), F.lit("\\\\"))


def with_quoted_numbers(text: Column) -> Column:
    """``text`` itself unless it holds such a token."""
    return F.when(text.rlike(_BARE), quote_bare_numbers(text)).otherwise(text)


def parse_strict(text: Column) -> Column:
    """``text`` as VARIANT when it is exactly one JSON value, else null.

    ``try_parse_json`` alone stops after the first value and ignores what follows
    (``[1] x``). Parsed as the first element of an array with a closing marker, trailing
    text or a second value breaks the array or moves the marker. Bare NaN and Infinity are
    read as JSON libraries do; of repeated keys the last counts where the session allows them
    (``session.build_session`` does).
    """

    def first_of(probe: Column) -> Column:
        whole = F.try_variant_get(probe, "$[1]", "string") == F.lit(_END)
        return F.when(whole, F.try_variant_get(probe, "$[0]", "variant"))

    def parsed(value: Column) -> Column:
        return let(F.try_parse_json(F.concat(F.lit("["), value, F.lit(f',"{_END}"]'))), first_of)

    # Only a text that failed and holds such a token is rewritten and parsed again.
    return F.coalesce(parsed(text), F.when(text.rlike(_BARE), parsed(quote_bare_numbers(text))))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, ... of a VARIANT (null for SQL null)."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def elements(v: Column) -> Column:
    """The items of a JSON list as ``array<variant>``; null for anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def truthy_text(v: Column, key: str) -> Column:
    """``v[key]`` as text when Python would call it true, else null.

    The empty string is false, and so are zero, false, [] and {} unless they are quoted.
    """
    path = f"$.{key}"
    text = F.try_variant_get(v, path, "string")
    quoted = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    looks_false = text.isin("false", "[]", "{}", "0", "-0", "0.0", "-0.0")
    return F.when((text != "") & (~looks_false | quoted), text)


def object_or_empty(text: Column) -> Column:
    """A JSON column of a ledger row; blank or broken text counts as ``{}``."""
    return F.coalesce(parse_strict(text), F.parse_json(F.lit("{}")))
