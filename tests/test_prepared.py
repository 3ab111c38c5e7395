import json

import pytest
from pyspark.sql import functions as F

from tunegrain import FieldMapping
from tunegrain.functions.chat import ChatTemplate
from tunegrain.plans import prepare
from tunegrain.sources import prepared

MAPPING = FieldMapping("instruction", instruction_field="q", output_field="a", system_prompt="sys")


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("datasets"))
    raw = spark.createDataFrame(
        [(i, f"question {i}", "ok" if i % 10 == 0 else f"a longer answer {i} é") for i in range(60)] + [(60, "", "x")],
        "row_id long, q string, a string",
    )
    return root, prepare.prepare(raw, MAPPING, root, name="My Data!", eval_ratio=0.1)


def test_files_and_metadata(spark, done):
    root, ds = done
    info = ds.info
    assert info.dataset_id.startswith("my-data-")
    assert (info.n_examples, info.n_train, info.n_eval, info.has_system) == (54, 49, 5, True)
    assert info.source_columns == ["q", "a"] and info.mapping["system_prompt"] == "sys"
    assert info.stats["empty_output_count"] == 6 and set(info.stats["token_len"]) == {"min", "median", "mean", "p95", "max"}
    assert ds.report["n_examples"] == 60 and ds.report["n_valid"] == 54 and not ds.report["ok"]
    assert [i["code"] for i in ds.report["issues"]] == ["unparsed_rows", "empty_output"]
    assert ds.report["issues"][1]["rows"] == [0, 10, 20, 30, 40] and ds.report["issues"][1]["count"] == 6
    line = spark.read.text(prepared.split_folder(ds.directory, "train")).first().value
    record = json.loads(line)
    assert list(record) == ["messages"] and [m["role"] for m in record["messages"]] == ["system", "user", "assistant"]
    assert "é" in line


def test_reading_back(spark, done):
    root, ds = done
    train, held_out = ds.examples(spark, "train"), ds.examples(spark, "eval")
    questions = lambda df: {r.messages[1].content for r in df.collect()}
    assert len(questions(train)) == 49 and len(questions(held_out)) == 5
    assert not questions(train) & questions(held_out)
    assert ds.examples(spark, limit=3).count() == 3
    again = prepared.open_prepared(spark, ds.directory)
    assert again.info == ds.info and again.report == ds.report


def test_preview_shows_the_first_training_rows(spark, done):
    root, ds = done
    text = spark.read.text(f"{ds.directory}/preview.txt", wholetext=True).first().value
    assert text.startswith("===== Example 1 =====\n<SYSTEM>\nsys\n\n<USER>\nquestion ")
    assert text.count("=====") == 10
    first = ds.examples(spark).first().messages[1].content
    assert f"<USER>\n{first}\n" in text.split("===== Example 2")[0]


def test_catalog(spark, done):
    root, ds = done
    (row,) = prepared.catalog(spark, root).collect()
    assert row.dataset_id == ds.info.dataset_id and row.label == "My Data! · 49 train (instruction)"
    assert prepared.dataset_rows(prepared.catalog(spark, root)).first().n_eval == 5
    assert prepared.get_dataset(spark, root, ds.info.dataset_id).info == ds.info
    assert prepared.get_dataset(spark, root, "nope") is None
    assert prepared.catalog(spark, root + "/none").count() == 0


def test_training_frames(spark, done):
    root, ds = done
    template = ChatTemplate.named("gemma", suffix="<end_of_turn>\n")
    train, held_out = prepared.training_frames(spark, ds.directory, template)
    assert train.count() == 49 and held_out.count() == 5
    assert train.first().text.startswith("<start_of_turn>system\nsys<end_of_turn>\n<start_of_turn>user\nquestion")
    assert prepared.training_frames(spark, ds.directory, template, eval_strategy="no")[1] is None


def test_empty_eval_and_no_issues(spark, tmp_path):
    raw = spark.range(60).selectExpr("id as row_id", "concat('some text number ', id) as t")
    ds = prepare.prepare(raw, FieldMapping("completion", text_field="t"), str(tmp_path), name="?", eval_ratio=0.0)
    assert ds.info.dataset_id.startswith("dataset-") and ds.info.n_eval == 0 and not ds.info.has_system
    assert ds.report["ok"] and ds.report["issues"] == []
    assert prepared.training_frames(spark, ds.directory, ChatTemplate.named("chatml"))[1] is None


def test_same_split_again(spark, tmp_path):
    raw = spark.range(200).selectExpr("id as row_id", "concat('some text number ', id) as t")
    mapping = FieldMapping("completion", text_field="t")
    held_out = [
        {r.text for r in prepare.prepare(df, mapping, str(tmp_path / n), name="x").examples(spark, "eval").collect()}
        for n, df in (("a", raw), ("b", raw.repartition(7)))
    ]
    assert held_out[0] == held_out[1] and len(held_out[0]) == 10


def test_record_shape(spark, tmp_path):
    df = spark.createDataFrame(
        [(None, "t", {"k": "v"}), ([("user", "x")], None, {}), (None, None, None)],
        "messages array<struct<role:string,content:string>>, text string, meta map<string,string>",
    )
    path = str(tmp_path / "out")
    prepared.write_examples(df.coalesce(1), path)
    lines = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert lines == [{"text": "t", "meta": {"k": "v"}}, {"messages": [{"role": "user", "content": "x"}]}, {"text": ""}]
    both = str(tmp_path / "both")
    spark.createDataFrame([('{"messages":[],"text":"t"}',)], "value string").write.text(both)
    assert prepared.read_examples(spark, both).select(F.size("messages"), "text").first()[:] == (0, None)


def test_shuffle_off_keeps_input_order(spark, tmp_path):
    raw = spark.range(40).selectExpr("id as row_id", "concat('some text number ', id) as t").repartition(5)
    ds = prepare.prepare(raw, FieldMapping("completion", text_field="t"), str(tmp_path), name="o", eval_ratio=0.1, shuffle=False)
    assert {r.text for r in ds.examples(spark, "eval").collect()} == {f"some text number {i}" for i in range(4)}
    assert ds.examples(spark, "train").first().text == "some text number 4"


def test_reading_with_a_limit_opens_few_files(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "examples")
    rows = spark.range(100).selectExpr("id", "concat('text ', id) as text").repartitionByRange(10, "id").sortWithinPartitions("id")
    rows.select("text").write.json(path)
    opened = []
    reader = type(spark.read)
    monkeypatch.setattr(reader, "json", lambda self, at, real=reader.json: opened.append(at) or real(self, at))
    got = [r.text for r in prepared.read_examples(spark, path, 25).collect()]
    assert got == [f"text {i}" for i in range(25)]
    assert len(opened) <= 4
    opened.clear()
    assert prepared.preview_text(spark, path, 3).count("===== Example") == 3
    assert len(opened) == 1
    assert prepared.read_examples(spark, path, 1000).count() == 100
    assert prepared.read_examples(spark, path, 0).count() == 0
