"""Data model: example type, column mapping, dataset metadata."""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)
META = T.MapType(T.StringType(), T.StringType())

#: One prepared example: exactly one of ``messages`` and ``text`` is set.
EXAMPLE = T.StructType(
    [T.StructField("messages", MESSAGES), T.StructField("text", T.StringType()), T.StructField("meta", META)]
)

EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

DEFAULT_INPUT_TEMPLATE = "{instruction}\n\n{input}"


class TaskFormat(str, Enum):
    INSTRUCTION = "instruction"
    CHAT = "chat"
    COMPLETION = "completion"


@dataclass(frozen=True)
class FieldMapping:
    """Which raw column plays which role, plus an optional static system prompt."""

    task_format: TaskFormat
    instruction_field: str | None = None
    input_field: str | None = None
    output_field: str | None = None
    system_field: str | None = None
    text_field: str | None = None
    messages_field: str | None = None
    system_prompt: str | None = None
    input_template: str = DEFAULT_INPUT_TEMPLATE

    def __post_init__(self) -> None:
        object.__setattr__(self, "task_format", TaskFormat(self.task_format))

    def required_fields(self) -> list[str]:
        wanted = {
            TaskFormat.INSTRUCTION: (self.instruction_field, self.output_field),
            TaskFormat.CHAT: (self.messages_field,),
            TaskFormat.COMPLETION: (self.text_field,),
        }[self.task_format]
        return [name for name in wanted if name]

    def check_columns(self, columns: Sequence[str]) -> None:
        """Fail before the job starts, not once per row, when a needed column is absent."""
        absent = [name for name in self.required_fields() if name not in columns]
        if absent:
            raise ValueError(f"mapping names columns that the data lacks: {absent}")

    def template_pieces(self) -> list[tuple[str, str | None]]:
        """``input_template`` cut into (literal, placeholder) pairs; anything fancier is refused."""
        pieces = []
        for literal, name, spec, conversion in string.Formatter().parse(self.input_template):
            if name is not None and (name not in ("instruction", "input") or spec or conversion):
                raise ValueError(f"unsupported placeholder in input template: {name!r}")
            pieces.append((literal, name))
        return pieces

    def to_dict(self) -> dict[str, Any]:
        return {**asdict(self), "task_format": self.task_format.value}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> FieldMapping:
        known = {k: v for k, v in d.items() if k in cls.__dataclass_fields__}
        return cls(**{"task_format": "instruction", **known})


@dataclass(frozen=True)
class DatasetInfo:
    """The metadata record stored next to a prepared dataset."""

    dataset_id: str
    name: str
    task_format: TaskFormat
    n_examples: int
    n_train: int
    n_eval: int
    has_system: bool
    source_columns: list[str]
    mapping: dict[str, Any]
    source_files: list[str] = field(default_factory=list)
    stats: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "task_format", TaskFormat(self.task_format))

    def to_dict(self) -> dict[str, Any]:
        return {**asdict(self), "task_format": self.task_format.value}

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> DatasetInfo:
        return cls(**{k: v for k, v in d.items() if k in cls.__dataclass_fields__})


# Column names that hint at a role, in order of preference.
COLUMN_HINTS = {
    "messages": ("messages", "conversation", "conversations", "dialog", "dialogue", "chat", "turns"),
    "instruction": ("instruction", "prompt", "question", "query", "task", "input_prompt"),
    "input": ("input", "context", "passage", "document", "source", "background"),
    "output": ("output", "response", "answer", "completion", "target", "label", "reply", "result"),
    "text": ("text", "content", "body", "document", "passage"),
    "system": ("system", "system_prompt", "system_message", "persona"),
}


def _column_for(role: str, columns: Sequence[str]) -> str | None:
    """Exact name first (hint order), then a hint contained in a column name (hint, then column order)."""
    # A later column whose folded name repeats an earlier one wins, keeping the earlier one's place.
    folded = {c.strip().lower(): c for c in columns}
    hints = COLUMN_HINTS[role]
    exact = (folded[h] for h in hints if h in folded)
    partial = (column for h in hints for low, column in folded.items() if h in low)
    return next(exact, None) or next(partial, None)


def guess_mapping(columns: Sequence[str]) -> FieldMapping:
    """Choose a task format and its columns from the column names alone."""
    found = {role: _column_for(role, columns) for role in COLUMN_HINTS}
    if found["messages"]:
        return FieldMapping(TaskFormat.CHAT, messages_field=found["messages"], system_field=found["system"])
    if found["instruction"] and found["output"]:
        named = {f"{role}_field": found[role] for role in ("instruction", "input", "output", "system")}
        return FieldMapping(TaskFormat.INSTRUCTION, **named)
    if found["text"]:
        return FieldMapping(TaskFormat.COMPLETION, text_field=found["text"])
    if len(columns) > 1:
        return FieldMapping(TaskFormat.INSTRUCTION, instruction_field=columns[0], output_field=columns[1])
    return FieldMapping(TaskFormat.COMPLETION, text_field=columns[0] if columns else None)
