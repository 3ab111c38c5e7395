"""Expressions over ``messages: array<struct<role, content>>`` and plain ``text``."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunegrain.functions.text import blank_to_null, clean

SYSTEM, USER, ASSISTANT = "system", "user", "assistant"

# Role names met in public chat data and the role each stands for.
ROLE_ALIASES = {
    "human": "user",
    "user": "user",
    "prompter": "user",
    "question": "user",
    "gpt": "assistant",
    "assistant": "assistant",
    "bot": "assistant",
    "answer": "assistant",
    "system": "system",
}

# Text that opens a user turn and an assistant turn, per template.
TURN_MARKERS = {
    "llama-3.1": (
        "<|start_header_id|>user<|end_header_id|>\n\n",
        "<|start_header_id|>assistant<|end_header_id|>\n\n",
    ),
    "llama-3": (
        "<|start_header_id|>user<|end_header_id|>\n\n",
        "<|start_header_id|>assistant<|end_header_id|>\n\n",
    ),
    "chatml": ("<|im_start|>user\n", "<|im_start|>assistant\n"),
    "qwen-2.5": ("<|im_start|>user\n", "<|im_start|>assistant\n"),
    "gemma2": ("<start_of_turn>user\n", "<start_of_turn>model\n"),
    "gemma": ("<start_of_turn>user\n", "<start_of_turn>model\n"),
    "mistral": ("[INST]", "[/INST]"),
    "phi-3": ("<|user|>\n", "<|assistant|>\n"),
}


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def canonical_role(role: Column) -> Column:
    """Alias resolved; unknown roles kept in lower case; nothing means user."""
    low = F.lower(clean(role))
    known = F.create_map(*[F.lit(part) for pair in ROLE_ALIASES.items() for part in pair])
    return F.coalesce(F.try_element_at(known, low), blank_to_null(low), F.lit(USER))


def with_system(messages: Column, system: Column) -> Column:
    """Put ``system`` first unless it is empty or the conversation brings its own."""
    has_own = F.exists(messages, lambda m: m["role"] == SYSTEM)
    led = F.concat(F.array(message(SYSTEM, system)), messages)
    return F.when((system != "") & ~has_own, led).otherwise(messages)


def system_text(messages: Column) -> Column:
    """Content of the first system turn, null without one."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == SYSTEM), F.lit(1))["content"]


def speaks_as_system(messages: Column) -> Column:
    """Is there a system turn with content?"""
    return F.exists(messages, lambda m: (m["role"] == SYSTEM) & (m["content"] != ""))


def last_assistant(messages: Column) -> Column:
    """Content of the last assistant turn, null without one."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == ASSISTANT), F.lit(-1))["content"]


def example_text(messages: Column, text: Column) -> Column:
    """All contents joined by a newline, or the completion text."""
    return F.coalesce(F.array_join(messages["content"], "\n"), text, F.lit(""))


def output_length(messages: Column, text: Column) -> Column:
    """Characters of the last assistant turn (0 without one), or of the completion text."""
    output = F.when(messages.isNotNull(), last_assistant(messages)).otherwise(text)
    return F.length(F.coalesce(output, F.lit("")))


def render_preview(messages: Column, text: Column, max_chars: int = 1200) -> Column:
    """Readable form, role tags in capitals, cut with an ellipsis beyond ``max_chars``."""
    blocks = F.transform(messages, lambda m: F.concat(F.lit("<"), F.upper(m["role"]), F.lit(">\n"), m["content"]))
    full = F.coalesce(F.array_join(blocks, "\n\n"), text, F.lit(""))
    return F.when(F.length(full) > max_chars, F.concat(F.substring(full, 1, max_chars), F.lit("…"))).otherwise(full)


@dataclass(frozen=True)
class ChatTemplate:
    """Opening text per role and closing text after each turn.

    ``suffixes`` (end-of-turn text) depends on the model and is the caller's to give.
    """

    name: str
    prefixes: Mapping[str, str]
    suffixes: Mapping[str, str]

    @classmethod
    def named(cls, name: str, suffix: str = "\n", system_prefix: str | None = None) -> ChatTemplate:
        user, assistant = TURN_MARKERS[name]
        system = user.replace(USER, SYSTEM) if system_prefix is None else system_prefix
        return cls(
            name,
            {SYSTEM: system, USER: user, ASSISTANT: assistant},
            {SYSTEM: suffix, USER: suffix, ASSISTANT: suffix},
        )

    def _by_role(self, role: Column, table: Mapping[str, str]) -> Column:
        # A role the template does not know is rendered as a user turn.
        chosen = F.lit(table[USER])
        for name, value in table.items():
            chosen = F.when(role == name, F.lit(value)).otherwise(chosen)
        return chosen

    def prefix(self, role: Column) -> Column:
        return self._by_role(role, self.prefixes)

    def suffix(self, role: Column) -> Column:
        return self._by_role(role, self.suffixes)

    def render(self, messages: Column) -> Column:
        turns = F.transform(
            messages, lambda m: F.concat(self.prefix(m["role"]), m["content"], self.suffix(m["role"]))
        )
        return F.array_join(turns, "")


def response_spans(messages: Column, text: Column, template: ChatTemplate | None) -> Column:
    """Character ranges ``[start, end)`` of the rendered text that count for the loss.

    With a template: content and closing text of each assistant turn. Without one, or for
    completion rows: the whole text.
    """
    whole = F.array(
        F.struct(F.lit(0).alias("start"), F.length(example_text(messages, text)).alias("end"))
    )
    if template is None:
        return whole
    start_type = "struct<at:int,spans:array<struct<start:int,end:int>>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(start_type)

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(template.prefix(m["role"]))
        end = begin + F.length(m["content"]) + F.length(template.suffix(m["role"]))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        grown = F.when(m["role"] == ASSISTANT, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(end.alias("at"), grown.alias("spans")).cast(start_type)

    return F.when(messages.isNotNull(), F.aggregate(messages, zero, step, lambda acc: acc["spans"])).otherwise(whole)


def history_prompt(history: Column, system: Column, new_message: Column) -> Column:
    """Messages for a reply: system, the usable user/assistant history, the new user turn."""
    usable = F.filter(history, lambda m: m["role"].isin(USER, ASSISTANT) & (m["content"] != ""))
    return F.concat(F.array(message(SYSTEM, system)), usable, F.array(message(USER, new_message)))


def plain_prompt(messages: Column) -> Column:
    """``role: content`` lines ending in an open assistant line."""
    lines = F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return F.concat(F.array_join(lines, "\n"), F.lit(f"\n{ASSISTANT}:"))


def prompt_for(prompt: Column) -> Column:
    """A bare string taken as a single user turn."""
    return F.array(message(USER, prompt))
