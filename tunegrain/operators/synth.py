"""Question/answer synthesis from text with a caller-supplied completion function."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunegrain.functions import jsontext
from tunegrain.functions.text import blank_to_null, or_none, strip_computed

SYSTEM_PROMPT = (
    "Turn passages into exercises for a language model. Ask only what the passage itself answers, and let every "
    "answer stand without the passage. Reply with a JSON list and nothing else."
)
PROMPT_HEAD = "Write %d different exercises about this passage.\n\n<passage>\n"
PROMPT_TAIL = '\n</passage>\n\nJSON list items: {"instruction": "the question", "output": "the answer"}'
# Fixed value: how much of a text a prompt quotes.
PROMPT_CHARS = 4000


def synth_prompt(text: Column, n: int = 3, head: str = PROMPT_HEAD, tail: str = PROMPT_TAIL) -> Column:
    """The prompt quotes the first 4000 characters, as the workflow defines it. ``head`` holds ``%d`` for the number."""
    return F.concat(F.lit(head % n), F.substring(text, 1, PROMPT_CHARS), F.lit(tail))


def completion(call: Callable[[str, str], str]) -> Callable[[Column, Column], Column]:
    """``complete`` for ``with_replies`` from a Python function; a failed call gives no reply."""

    @F.pandas_udf(T.StringType())
    def replies(systems: pd.Series, prompts: pd.Series) -> pd.Series:
        return or_none(call, zip(systems, prompts))

    return replies


def with_replies(chunks: DataFrame, complete: Callable[[Column, Column], Column], text: str = "text", n: int = 3) -> DataFrame:
    """Add ``reply``; ``complete(system, prompt)`` is usually a pandas UDF around a model."""
    return chunks.withColumn("reply", complete(F.lit(SYSTEM_PROMPT), synth_prompt(F.col(text), n)))


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def _balanced(text: str, opening: str) -> str | None:
    """The span from the first ``opening`` to its match, when that span is JSON."""
    closing = {"{": "}", "[": "]"}[opening]
    begin, depth = text.find(opening), 0
    if begin < 0:
        return None
    for mark in re.finditer(f"[{re.escape(opening + closing)}]", text[begin:]):
        depth += 1 if mark.group() == opening else -1
        if depth == 0:
            span = text[begin : begin + mark.end()]
            return span if _is_json(span) else None
    return None


def _embedded_json(text: str) -> str | None:
    present = sorted((o for o in "{[" if o in text), key=text.find)
    return next(filter(None, (_balanced(text, o) for o in present)), None)


@F.pandas_udf(T.StringType())
def _embedded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _embedded_json(t))


def unfenced(reply: Column) -> Column:
    """What stands inside the first code fence, or the whole reply; blank replies are null."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.+?)```", 1)
    inner = F.when(F.contains(reply, F.lit("```")) & (fenced != ""), fenced).otherwise(reply)
    return blank_to_null(strip_computed(inner))


def extract_json(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add ``parsed`` (VARIANT): the reply as JSON, or the first bracketed span that is.

    Whichever bracket opens first is tried first. Only replies that are not JSON as they
    stand reach Python.
    """
    whole = df.withColumn("_text", unfenced(F.col(reply))).withColumn("_whole", jsontext.parse_strict(F.col("_text")))
    rest = F.when(F.col("_whole").isNull(), F.col("_text"))
    return whole.withColumn("_span", _embedded(rest)).withColumn(
        "parsed", F.coalesce("_whole", F.try_parse_json("_span"))
    ).drop("_text", "_whole", "_span")


def reply_pairs(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """``*keep, pair, instruction, output`` for list items in which both are non-empty."""
    items = parsed.select(*keep, F.posexplode(jsontext.elements(F.col("parsed"))).alias("pair", "item"))
    both = items.where(jsontext.is_object(F.col("item"))).select(
        *keep,
        "pair",
        jsontext.truthy_text(F.col("item"), "instruction").alias("instruction"),
        jsontext.truthy_text(F.col("item"), "output").alias("output"),
    )
    return both.where(F.col("instruction").isNotNull() & F.col("output").isNotNull())
