import json

import pytest
from pyspark.sql import functions as F

from tunegrain import FieldMapping
from tunegrain.functions import chat
from tunegrain.operators import normalize as norm

CHAT = FieldMapping("chat", messages_field="conv")


def rows(df):
    return {
        r.row_id: ([(m.role, m.content) for m in r.messages] if r.messages is not None else r.text, r.drop_reason)
        for r in df.collect()
    }


def test_instruction_with_input(spark):
    df = spark.createDataFrame([(0, "Summarize", "Long text", "Short")], "row_id long, q string, ctx string, a string")
    m = FieldMapping("instruction", instruction_field="q", input_field="ctx", output_field="a")
    assert rows(norm.normalize(df, m)) == {0: ([("user", "Summarize\n\nLong text"), ("assistant", "Short")], None)}


def test_instruction_reasons_and_system(spark):
    data = [(0, " ", "x", None), (1, "q", " ", None), (2, "q", "a", " own "), (3, "q", "a", ""), (4, None, None, None)]
    df = spark.createDataFrame(data, "row_id long, q string, a string, s string")
    m = FieldMapping("instruction", instruction_field="q", output_field="a", system_field="s", system_prompt=" static ")
    got = rows(norm.normalize(df, m))
    assert got[0] == (None, "empty instruction") and got[4] == (None, "empty instruction")
    assert got[1] == (None, "empty output")
    assert got[2][0][0] == ("system", "own")
    # The static prompt is used as it is, without stripping.
    assert got[3][0][0] == ("system", " static ")


def test_template_is_filled_and_stripped(spark):
    df = spark.createDataFrame([(0, "do", "in", "out"), (1, "do", "", "out")], "row_id long, i string, x string, o string")
    m = FieldMapping("instruction", "i", "x", "o", input_template="  {input} {{then}} {instruction}!\n")
    got = rows(norm.normalize(df, m))
    assert got[0][0][0] == ("user", "in {then} do!")
    assert got[1][0][0] == ("user", "do")


def test_completion(spark):
    df = spark.createDataFrame([(0, " a "), (1, "　"), (2, None)], "row_id long, t string")
    got = rows(norm.normalize(df, FieldMapping("completion", text_field="t")))
    assert got == {0: ("a", None), 1: (None, "empty text"), 2: (None, "empty text")}


CASES = {
    "share": ([{"from": "human", "value": "hi"}, {"from": "gpt", "value": "hello"}], [("user", "hi"), ("assistant", "hello")]),
    "openai": ([{"role": "User", "content": " hi "}], [("user", "hi")]),
    "unknown role": ([{"role": "Tool", "content": "x"}], [("tool", "x")]),
    "no role": ([{"content": "x"}], [("user", "x")]),
    "falsy role": ([{"role": "", "from": 0, "speaker": "bot", "content": "x"}], [("assistant", "x")]),
    "empty content kept": ([{"role": "user", "content": "", "value": "other"}], [("user", "")]),
    "null content": ([{"role": "user", "content": None, "value": "", "text": "t"}], [("user", "t")]),
    "nothing": ([{"role": "user"}], [("user", "")]),
    "nested content": ([{"role": "user", "content": [1, "a"]}], [("user", '[1,"a"]')]),
    "object": ({"role": "user"}, "messages field is not a list"),
    "string": ("abc", "messages field is not a list"),
    "number": (5, "messages field is not a list"),
    "null": (None, "messages field is not a list"),
    "mixed": ([{"role": "user", "content": "x"}, "y"], "conversation turn is not an object"),
    "empty": ([], "conversation has no turns"),
}


def expected(value):
    return (value, None) if isinstance(value, list) else (None, value)


def test_conversations_as_json_text(spark):
    data = [(i, json.dumps(raw)) for i, (raw, _) in enumerate(CASES.values())]
    data += [(100, "not json"), (101, None), (102, "[] trailing"), (103, "")]
    df = spark.createDataFrame(data, "row_id long, conv string")
    got = rows(norm.normalize(df, CHAT))
    for i, (name, (_, want)) in enumerate(CASES.items()):
        assert got[i] == expected(want), name
    assert got[100][1] == got[102][1] == got[103][1] == "messages field is a non-JSON string"
    assert got[101][1] == "messages field is not a list"


def test_conversations_as_variant_match_json_text(spark):
    data = [(i, json.dumps(raw)) for i, (raw, _) in enumerate(CASES.values())]
    data += [(50, json.dumps(json.dumps([{"role": "user", "content": "quoted"}])))]
    df = spark.createDataFrame(data, "row_id long, conv string").withColumn("conv", F.parse_json("conv"))
    got = rows(norm.normalize(df, CHAT))
    for i, (name, (raw, want)) in enumerate(CASES.items()):
        # A JSON string is itself parsed once more, and "abc" is no JSON.
        want = "messages field is a non-JSON string" if raw == "abc" else want
        assert got[i] == expected(want), name
    assert got[50] == ([("user", "quoted")], None)


@pytest.mark.parametrize(
    ("dtype", "value", "want"),
    [
        ("array<struct<from:string,value:string>>", [("human", "hi"), ("gpt", "yo")], [("user", "hi"), ("assistant", "yo")]),
        ("array<struct<role:string,content:string,value:string>>", [("", None, "v")], [("user", "v")]),
        ("array<struct<role:int,speaker:string,content:double>>", [(0, "gpt", 1.5)], [("assistant", "1.5")]),
        ("array<map<string,string>>", [{"role": "bot", "message": "m"}], [("assistant", "m")]),
        ("array<struct<role:string>>", [], "conversation has no turns"),
        ("array<struct<role:string>>", [None], "conversation turn is not an object"),
        ("array<struct<role:string>>", None, "messages field is not a list"),
        ("array<string>", ["x"], "conversation turn is not an object"),
        ("int", 3, "messages field is not a list"),
    ],
)
def test_native_columns(spark, dtype, value, want):
    df = spark.createDataFrame([(0, value)], f"row_id long, conv {dtype}")
    assert rows(norm.normalize(df, CHAT))[0] == expected(want)


def test_system_is_put_first_only_when_missing(spark):
    data = [
        (0, [("user", "x")], "mine"), (1, [("user", "x"), ("System", "own")], "mine"), (2, [("user", "x")], " "),
    ]
    df = spark.createDataFrame(data, "row_id long, conv array<struct<role:string,content:string>>, sys string")
    m = FieldMapping("chat", messages_field="conv", system_field="sys", system_prompt="static")
    got = rows(norm.normalize(df, m))
    assert got[0][0] == [("system", "mine"), ("user", "x")]
    assert got[1][0] == [("user", "x"), ("system", "own")]
    assert got[2][0] == [("system", "static"), ("user", "x")]


def test_chat_without_messages_field(spark):
    df = spark.createDataFrame([(0, "x")], "row_id long, t string")
    assert rows(norm.normalize(df, FieldMapping("chat")))[0] == (None, "no messages field configured")


def test_drop_log_and_profile(spark):
    df = spark.createDataFrame([(0, "a"), (1, ""), (2, " ")], "row_id long, t string")
    n = norm.normalize(df, FieldMapping("completion", text_field="t"))
    assert [r.row_id for r in norm.examples(n).collect()] == [0]
    assert {(r.row_id, r.drop_reason) for r in norm.dropped(n).collect()} == {(1, "empty text"), (2, "empty text")}
    assert [(r.drop_reason, r.n_rows) for r in norm.drop_reason_counts(n).collect()] == [("empty text", 2)]


def test_normalization_is_one_projection_without_shuffle(spark):
    df = spark.range(3).selectExpr("id as row_id", "'x' as t")
    plan = norm.normalize(df, FieldMapping("completion", text_field="t"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_spans_cover_the_assistant_turns(spark):
    template = chat.ChatTemplate.named("chatml", suffix="<|im_end|>\n")
    data = [(0, [("system", "s"), ("user", "héllo"), ("assistant", "wörld"), ("user", "q"), ("assistant", "")], None), (1, None, "plain")]
    df = spark.createDataFrame(data, "row_id long, messages array<struct<role:string,content:string>>, text string")
    got = df.select(
        template.render(F.col("messages")).alias("full"),
        chat.response_spans(F.col("messages"), F.col("text"), template).alias("spans"),
        chat.response_spans(F.col("messages"), F.col("text"), None).alias("whole"),
    ).collect()
    pieces = [got[0].full[s.start : s.end] for s in got[0].spans]
    assert pieces == ["wörld<|im_end|>\n", "<|im_end|>\n"]
    assert got[0].full.startswith("<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nhéllo")
    assert [(s.start, s.end) for s in got[1].spans] == [(0, 5)]


@pytest.mark.parametrize("n", [1199, 1200, 1201])
def test_preview_cut(spark, n):
    df = spark.createDataFrame([("x" * n,)], "text string").withColumn("messages", F.lit(None).cast("array<struct<role:string,content:string>>"))
    got = df.select(chat.render_preview(F.col("messages"), F.col("text")).alias("p")).first().p
    assert got == ("x" * n if n <= 1200 else "x" * 1200 + "…")
