import pytest

from tunegrain import DatasetInfo, FieldMapping, TaskFormat, guess_mapping


def test_alpaca_columns_are_instruction():
    m = guess_mapping(["instruction", "input", "output"])
    assert (m.task_format, m.instruction_field, m.input_field, m.output_field) == (
        TaskFormat.INSTRUCTION, "instruction", "input", "output",
    )


def test_messages_column_is_chat():
    m = guess_mapping(["messages"])
    assert m.task_format is TaskFormat.CHAT and m.messages_field == "messages"


def test_text_column_is_completion():
    assert guess_mapping(["text"]) == FieldMapping(TaskFormat.COMPLETION, text_field="text")


@pytest.mark.parametrize(
    ("columns", "expected"),
    [
        (["id", "Prompt ", "Answer"], FieldMapping("instruction", instruction_field="Prompt ", output_field="Answer")),
        (["a", "b", "c"], FieldMapping("instruction", instruction_field="a", output_field="b")),
        (["only"], FieldMapping("completion", text_field="only")),
        ([], FieldMapping("completion")),
        # A hint inside a longer name counts: "returns" holds "turns".
        (["text", "returns"], FieldMapping("chat", messages_field="returns")),
        (["system", "conversation"], FieldMapping("chat", messages_field="conversation", system_field="system")),
        # An exact name beats an earlier partial one; hint order beats column order.
        (["my_question", "prompt", "response"], FieldMapping("instruction", instruction_field="prompt", output_field="response")),
    ],
)
def test_guesses(columns, expected):
    assert guess_mapping(columns) == expected


def test_mapping_round_trip_and_required_fields():
    m = FieldMapping("instruction", instruction_field="q", output_field="a", system_prompt="s")
    assert FieldMapping.from_dict(m.to_dict()) == m
    assert m.required_fields() == ["q", "a"]
    with pytest.raises(ValueError, match="lacks"):
        m.check_columns(["q"])


@pytest.mark.parametrize("template", ["{other}", "{instruction!r}", "{input:>5}", "{}"])
def test_unusual_placeholders_are_refused_before_the_job(template):
    with pytest.raises(ValueError):
        FieldMapping("instruction", input_template=template).template_pieces()


def test_dataset_info_round_trip():
    info = DatasetInfo("d-1", "d", TaskFormat.CHAT, 3, 2, 1, False, ["m"], {}, ["f"], {"x": 1})
    assert DatasetInfo.from_dict(info.to_dict()) == info
