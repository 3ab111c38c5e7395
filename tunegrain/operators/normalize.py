"""Raw rows to examples, with a reason for every row that cannot become one.

The result has one row per input row: the row id, ``messages`` or ``text``, and
``drop_reason`` (null for usable rows). All of it is one projection, so it runs on batch
and streaming frames alike and never shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunegrain.functions import chat, jsontext
from tunegrain.functions.text import as_text, blank_to_null, clean, named, strip_computed
from tunegrain.schema import MESSAGES, FieldMapping, TaskFormat

# Drop reasons.
EMPTY_TEXT = "empty text"
EMPTY_INSTRUCTION = "empty instruction"
EMPTY_OUTPUT = "empty output"
NO_MESSAGES_FIELD = "no messages field configured"
NOT_JSON = "messages field is a non-JSON string"
NOT_A_LIST = "messages field is not a list"
TURN_NOT_OBJECT = "conversation turn is not an object"
NO_TURNS = "conversation has no turns"

# Keys that may hold a turn's speaker, and those that replace a missing content.
ROLE_KEYS = ("role", "from", "speaker")
CONTENT_KEY = "content"
OTHER_CONTENT_KEYS = ("value", "text", "message")

def _no_text() -> Column:
    return F.lit(None).cast("string")


def _no_messages() -> Column:
    return F.lit(None).cast(MESSAGES)


def _field(df: DataFrame, name: str | None) -> Column:
    """Cleaned text of an optional column; the empty string when it is not mapped or absent."""
    if not name or name not in df.columns:
        return F.lit("")
    return clean(named(name), df.schema[name].dataType)


def _system(df: DataFrame, mapping: FieldMapping) -> Column:
    fallback = F.lit(mapping.system_prompt or "")
    return F.coalesce(blank_to_null(_field(df, mapping.system_field)), fallback)


def _turn(role: Column, content: Column) -> Column:
    return chat.message(chat.canonical_role(role), clean(content))


def _turn_from_variant(t: Column) -> Column:
    role = F.coalesce(*[jsontext.truthy_text(t, key) for key in ROLE_KEYS])
    given = F.try_variant_get(t, f"$.{CONTENT_KEY}", "string")
    return _turn(role, F.coalesce(given, *[jsontext.truthy_text(t, key) for key in OTHER_CONTENT_KEYS]))


def _truthy(c: Column, dtype: T.DataType) -> Column:
    text = as_text(c, dtype)
    if isinstance(dtype, T.StringType):
        return blank_to_null(text)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, text)
    if isinstance(dtype, T.NumericType):
        return F.when(c != 0, text)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.when(F.size(c) > 0, text)
    return text


def _turn_from_native(t: Column, dtype: T.DataType) -> Column:
    nothing = _no_text()

    def value(key: str) -> tuple[Column, T.DataType] | None:
        if isinstance(dtype, T.MapType):
            return F.try_element_at(t, F.lit(key)), dtype.valueType
        return (t[key], dtype[key].dataType) if key in dtype.names else None

    def any_true(keys: Sequence[str]) -> list[Column]:
        return [_truthy(*found) for found in map(value, keys) if found]

    content = value(CONTENT_KEY)
    given = as_text(*content) if content else nothing
    return _turn(
        F.coalesce(nothing, *any_true(ROLE_KEYS)), F.coalesce(given, *any_true(OTHER_CONTENT_KEYS))
    )


def _list_reason(items: Column, is_turn: Callable[[Column], Column]) -> Column:
    """Why a conversation column is unusable; the first failing check names the reason."""
    return (
        F.when(items.isNull(), F.lit(NOT_A_LIST))
        .when(F.exists(items, lambda t: ~is_turn(t)), F.lit(TURN_NOT_OBJECT))
        .when(F.size(items) == 0, F.lit(NO_TURNS))
    )


def read_messages(df: DataFrame, name: str) -> DataFrame:
    """Add ``_turns`` and ``_reason`` for a conversation column: JSON text, VARIANT or a native array.

    Parsed values get columns of their own, so that a row is parsed once however often the
    checks look at it.
    """
    c, dtype = named(name), df.schema[name].dataType
    if isinstance(dtype, (T.StringType, T.VariantType)):
        if isinstance(dtype, T.StringType):
            quoted, parsed = c.isNotNull(), jsontext.parse_strict(c)
        else:
            quoted = F.coalesce(F.schema_of_variant(c) == "STRING", F.lit(False))
            parsed = F.when(quoted, jsontext.parse_strict(F.try_variant_get(c, "$", "string"))).otherwise(c)
        staged = df.withColumns({"_parsed": parsed, "_quoted": quoted})
        staged = staged.withColumns(
            {"_items": jsontext.elements(F.col("_parsed")), "_not_json": F.col("_quoted") & F.col("_parsed").isNull()}
        )
        reason = F.when(F.col("_not_json"), F.lit(NOT_JSON)).otherwise(_list_reason(F.col("_items"), jsontext.is_object))
        return staged.withColumns({"_turns": F.transform("_items", _turn_from_variant), "_reason": reason})
    element = dtype.elementType if isinstance(dtype, T.ArrayType) else None
    if isinstance(element, T.VariantType):
        return df.withColumns({"_turns": F.transform(c, _turn_from_variant), "_reason": _list_reason(c, jsontext.is_object)})
    if isinstance(element, (T.StructType, T.MapType)):
        turns = F.transform(c, lambda t: _turn_from_native(t, element))
        return df.withColumns({"_turns": turns, "_reason": _list_reason(c, lambda t: t.isNotNull())})
    reason = F.lit(NOT_A_LIST) if element is None else _list_reason(c, lambda t: F.lit(False))
    return df.withColumns({"_turns": _no_messages(), "_reason": reason})


def _completion(df: DataFrame, mapping: FieldMapping) -> DataFrame:
    staged = df.withColumn("_text", _field(df, mapping.text_field))
    return staged.withColumns(
        {"_turns": _no_messages(), "_reason": F.when(F.col("_text") == "", F.lit(EMPTY_TEXT))}
    )


def _chat(df: DataFrame, mapping: FieldMapping) -> DataFrame:
    if not mapping.messages_field:
        return df.withColumns({"_turns": _no_messages(), "_text": _no_text(), "_reason": F.lit(NO_MESSAGES_FIELD)})
    staged = read_messages(df, mapping.messages_field).withColumn("_system", _system(df, mapping))
    return staged.withColumns({"_turns": chat.with_system(F.col("_turns"), F.col("_system")), "_text": _no_text()})


def _instruction(df: DataFrame, mapping: FieldMapping) -> DataFrame:
    fields = {"_asked": mapping.instruction_field, "_extra": mapping.input_field, "_answer": mapping.output_field}
    staged = df.withColumns({name: _field(df, field) for name, field in fields.items()} | {"_system": _system(df, mapping)})
    asked, extra, answer, system = (F.col(c) for c in ("_asked", "_extra", "_answer", "_system"))
    values = {"instruction": asked, "input": extra}
    pieces = [
        part
        for literal, name in mapping.template_pieces()
        for part in (F.lit(literal), values[name] if name else F.lit(""))
    ]
    prompt = F.when(extra != "", strip_computed(F.concat(*pieces))).otherwise(asked)
    opening = F.when(system != "", chat.message(chat.SYSTEM, system))
    turns = F.array_compact(
        F.array(opening, chat.message(chat.USER, prompt), chat.message(chat.ASSISTANT, answer))
    )
    reason = F.when(asked == "", F.lit(EMPTY_INSTRUCTION)).when(answer == "", F.lit(EMPTY_OUTPUT))
    return staged.withColumns({"_turns": turns, "_text": _no_text(), "_reason": reason})


_BUILDERS = {
    TaskFormat.COMPLETION: _completion,
    TaskFormat.CHAT: _chat,
    TaskFormat.INSTRUCTION: _instruction,
}


def normalize(df: DataFrame, mapping: FieldMapping, row_id: str = "row_id", keep: Sequence[str] = ()) -> DataFrame:
    """``row_id, *keep, messages, text, drop_reason`` for every row of ``df``."""
    mapping.check_columns(df.columns)
    usable = F.col("_reason").isNull()
    return _BUILDERS[mapping.task_format](df, mapping).select(
        named(row_id).alias("row_id"),
        *keep,
        F.when(usable, F.col("_turns").cast(MESSAGES)).alias("messages"),
        F.when(usable, F.col("_text")).alias("text"),
        F.col("_reason").cast("string").alias("drop_reason"),
    )


def examples(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("drop_reason").isNull()).drop("drop_reason")


def dropped(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("drop_reason").isNotNull()).select("row_id", "drop_reason")


def drop_reason_counts(normalized: DataFrame) -> DataFrame:
    return dropped(normalized).groupBy("drop_reason").agg(F.count("*").alias("n_rows"))


def assemble_turns(
    turns: DataFrame, key: str, turn: str = "turn", role: str = "role", content: str = "text"
) -> DataFrame:
    """Flat one-row-per-turn table to one ``messages`` row per conversation, in turn order.

    A conversation is one record of the result, so its size is that of the record itself.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn), F.col(role).alias("role"), F.col(content).alias("content"))))
    plain = F.transform(ordered, lambda t: chat.message(t["role"], t["content"]))
    return turns.groupBy(key).agg(plain.alias("messages"))
