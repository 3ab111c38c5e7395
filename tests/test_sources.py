import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tunegrain import FieldMapping
from tunegrain.operators import normalize as norm
from tunegrain.sources import files, load_file, load_paths
from tunegrain.sources.loading import LoadError, sniff_separator
from tunegrain.sources.office import docx_records, xlsx_records


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
    return str(path)


def records(raw):
    return [
        {k: v for k, v in r.asDict(recursive=True).items() if k != "row_id"} for r in raw.df.orderBy("row_id").collect()
    ]


def notes(raw):
    return {r.file.rsplit("/", 1)[-1]: r.reason for r in raw.notes.collect()}


def test_jsonl(spark, tmp_path):
    put(tmp_path, "a.jsonl", '{"b": 1, "a": "x"}\n\n  {"a": "y", "c": null, "b": 2.5} \n5\n"s"\n')
    put(tmp_path, "bad.NDJSON", '{"a": "kept?"}\n{"a": 1} trailing\n')
    raw = load_paths(spark, str(tmp_path))
    assert raw.columns == ["b", "a", "c", "value"]
    assert records(raw) == [
        {"b": 1.0, "a": "x", "c": None, "value": None},
        {"b": 2.5, "a": "y", "c": None, "value": None},
        {"b": None, "a": None, "c": None, "value": "5"},
        {"b": None, "a": None, "c": None, "value": "s"},
    ]
    assert notes(raw) == {"bad.NDJSON": "1 line(s) are not valid JSON"}
    assert [r.name for r in raw.files.collect()] == ["a.jsonl"]


def test_jsonl_conflicts_and_nested(spark, tmp_path):
    put(tmp_path, "a.jsonl", '{"k": 1, "m": [{"role": "user", "content": "x"}]}\n{"k": "two", "m": [{"from": "gpt", "value": "y"}]}\n')
    raw = load_paths(spark, str(tmp_path))
    assert [r["k"] for r in records(raw)] == ["1", "two"]
    n = norm.normalize(raw.df, FieldMapping("chat", messages_field="m"))
    assert [[(m.role, m.content) for m in r.messages] for r in n.orderBy("row_id").collect()] == [[("user", "x")], [("assistant", "y")]]


def test_jsonl_with_odd_column_names(spark, tmp_path):
    put(tmp_path, "a.jsonl", json.dumps({"a b": 1, "OBJECT": {"VOID": None}, "x`y": "q", "d.e": True}))
    row = records(load_paths(spark, str(tmp_path)))[0]
    assert row == {"a b": 1, "OBJECT": {"VOID": None}, "x`y": "q", "d.e": True}


@pytest.mark.parametrize(
    ("document", "want"),
    [
        ([{"z": 1, "a": 2}, {"z": 3}], [{"z": 1, "a": 2}, {"z": 3, "a": None}]),
        ({"data": [{"a": 1}]}, [{"a": 1}]),
        ({"data": "no list", "examples": [{"a": 1}]}, [{"a": 1}]),
        ({"items": [{"a": 1}], "rows": [{"a": 2}]}, [{"a": 2}]),
        ({"records": [7, {"a": 1}]}, [{"value": "7", "a": None}, {"value": None, "a": 1}]),
        ({"a": 1}, [{"a": 1}]),
    ],
)
def test_json_documents(spark, tmp_path, document, want):
    put(tmp_path, "d.json", json.dumps(document, indent=1))
    raw = load_paths(spark, str(tmp_path))
    assert records(raw) == want
    assert raw.columns == list(want[0])


def test_json_defects_are_notes(spark, tmp_path):
    put(tmp_path, "scalar.json", "5")
    put(tmp_path, "broken.json", "[1")
    put(tmp_path, "good.json", '[{"a": 1}]')
    raw = load_paths(spark, str(tmp_path))
    assert records(raw) == [{"a": 1}]
    assert set(notes(raw)) == {"scalar.json", "broken.json"}
    assert "unsupported top-level" in notes(raw)["scalar.json"]


def test_csv(spark, tmp_path):
    put(tmp_path, "semi.csv", 'id;text;note\n007;"two\nlines; ""quoted""";NA\n8;x;None\n9;y;z;extra\n')
    raw = load_paths(spark, str(tmp_path))
    assert records(raw) == [
        {"id": "007", "text": 'two\nlines; "quoted"', "note": None},
        {"id": "8", "text": "x", "note": None},
        {"id": "9", "text": "y", "note": "z"},
    ]
    assert "1 row(s)" in notes(raw)["semi.csv"]


def test_csv_files_with_different_headers_and_tsv(spark, tmp_path):
    put(tmp_path, "a.csv", "a,b\n1,2\n")
    put(tmp_path, "b.csv", "b,a\n3,4\n")
    put(tmp_path, "c.tsv", "a\tb,c\n5\t6\n")
    put(tmp_path, "blank.csv", "\n\n")
    raw = load_paths(spark, str(tmp_path))
    assert records(raw) == [
        {"a": "1", "b": "2", "b,c": None}, {"a": "4", "b": "3", "b,c": None}, {"a": "5", "b": None, "b,c": "6"},
    ]
    assert notes(raw) == {"blank.csv": "no columns to parse"}


def test_separator_of_a_single_column_header_is_a_comma():
    assert [sniff_separator(h) for h in ("text\n", "a;b\n", "a\tb\n", "a|b\n", "a,b\n")] == [",", ";", "\t", "|", ","]


def test_parquet_with_clashing_types_and_broken_file(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "k int, t string").coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([("two", [1])], "k string, l array<int>").coalesce(1).write.parquet(str(tmp_path / "two"))
    put(tmp_path, "bad.parquet", b"not parquet at all")
    raw = load_paths(spark, str(tmp_path))
    assert sorted((r["k"], r["t"], r["l"]) for r in records(raw)) == [("1", "x", None), ("two", None, [1])]
    assert list(notes(raw)) == ["bad.parquet"]


def test_text_paragraphs(spark, tmp_path):
    put(tmp_path, "a.txt", "one\r\n\r\n  two\nlines \n\n\n\nthree\n\n \n\n")
    put(tmp_path, "b.md", "# title\n\nbody")
    put(tmp_path, "c.txt", " \n\n ")
    put(tmp_path, "d.txt", b"caf\xe9")
    raw = load_paths(spark, str(tmp_path))
    assert [(r["text"], r["source"]) for r in records(raw)] == [
        ("one", "a.txt"), ("two\nlines", "a.txt"), ("three", "a.txt"), ("# title", "b.md"), ("body", "b.md"), ("caf�", "d.txt"),
    ]


def docx_bytes(path, paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r><w:r><w:tab/><w:t>.</w:t></w:r></w:p>" if p else "<w:p/>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')


def xlsx_bytes(path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="D1" t="s"><v>0</v></c></row>'
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c><c r="D2" t="b"><v>1</v></c></row>'
        '<row r="3"/><row r="4"><c r="B4"><v>1.5</v></c></row>'
    )
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId9" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>q</t></si><si><r><t>he</t></r><r><t>llo</t></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')


def test_office_documents(spark, tmp_path):
    docx_bytes(tmp_path / "d.docx", ["first", "", "second"])
    xlsx_bytes(tmp_path / "w.xlsx")
    put(tmp_path, "broken.docx", b"zip?")
    put(tmp_path, "old.xls", b"\xd0\xcf\x11\xe0")
    put(tmp_path, "p.pdf", b"%PDF-1.4")
    raw = load_paths(spark, str(tmp_path))
    got = records(raw)
    assert [(r["text"], r["source"]) for r in got[:2]] == [("first\t.", "d.docx"), ("second\t.", "d.docx")]
    assert [(r["q"], r["n"], r["q.1"]) for r in got[2:]] == [("hello", 7.0, True), (None, None, None), (None, 1.5, None)]
    assert set(notes(raw)) == {"broken.docx", "old.xls", "p.pdf"}


def test_office_decoders_name_columns(tmp_path):
    xlsx_bytes(tmp_path / "w.xlsx")
    first = next(iter(xlsx_records((tmp_path / "w.xlsx").read_bytes())))
    assert first == {"q": "hello", "n": 7, "Unnamed: 2": None, "q.1": True}
    docx_bytes(tmp_path / "d.docx", ["x"])
    assert list(docx_records((tmp_path / "d.docx").read_bytes())) == [{"text": "x\t."}]


def test_rows_are_numbered_by_file_and_place(spark, tmp_path):
    lines = [json.dumps({"n": i, "pad": "x" * 50}) for i in range(3000)]
    put(tmp_path, "b.jsonl", "\n".join(lines[:2000]))
    put(tmp_path, "c.jsonl", "\n".join(lines[2000:]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        split = load_paths(spark, str(tmp_path)).df.select("row_id", "n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = load_paths(spark, str(tmp_path)).df.select("row_id", "n").collect()
    assert sorted(split) == sorted(whole)
    assert [r.n for r in sorted(split)] == list(range(3000))
    assert [r.row_id for r in sorted(split)] == list(range(3000))


def test_preview_and_lists(spark, tmp_path):
    a = put(tmp_path, "sub/a.jsonl", '{"t": "x"}\n{"t": "y"}\n')
    raw = load_paths(spark, [a, str(tmp_path / "missing.csv"), put(tmp_path, "x.exe", "?")])
    shown = raw.preview(1)
    assert shown["columns"] == ["t"] and shown["n_records"] == 2 and shown["sample"] == [{"t": "x"}]
    assert len(shown["notes"]) == 2
    assert records(load_file(spark, a)) == records(load_paths(spark, a))
    part = put(tmp_path, "part-0.json", '{"t": "z"}\n{"t": "w"}\n')
    assert [r["t"] for r in records(load_paths(spark, part, fmt=".jsonl"))] == ["z", "w"]


def test_errors(spark, tmp_path):
    with pytest.raises(LoadError, match="not found"):
        load_file(spark, str(tmp_path / "no.csv"))
    with pytest.raises(LoadError, match="unsupported"):
        load_file(spark, put(tmp_path, "a.exe", ""))
    with pytest.raises(LoadError, match="no supported files"):
        load_paths(spark, str(tmp_path))
    with pytest.raises(LoadError, match="no records"):
        load_paths(spark, put(tmp_path, "a.jsonl", "{broken"))


def test_listing_reads_no_contents(spark, tmp_path):
    put(tmp_path, "a.bin", "abc")
    plan = files.list_files(spark, [str(tmp_path)])._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    assert files.list_files(spark, [str(tmp_path)]).select(F.sum("length")).first()[0] == 3


def test_files_keep_the_order_of_the_list(spark, tmp_path):
    put(tmp_path, "a.jsonl", '{"n": 1}\n{"n": 2}')
    put(tmp_path, "b.csv", "n\n3\n")
    put(tmp_path, "c.jsonl", '{"n": 4}')
    raw = load_paths(spark, [str(tmp_path / name) for name in ("c.jsonl", "b.csv", "a.jsonl")])
    assert [r["n"] for r in records(raw)] == ["4", "3", "1", "2"]


def test_headers_of_any_length_and_over_several_lines(spark, tmp_path):
    wide = [f"{'column':_<400}{i}" for i in range(200)]  # 80 kB
    put(tmp_path, "wide.csv", ",".join(wide) + "\n" + ",".join(str(i) for i in range(200)) + "\n")
    raw = load_paths(spark, str(tmp_path / "wide.csv"))
    assert raw.columns == wide and raw.df.select(wide[199]).first()[0] == "199"
    put(tmp_path, "lines.tsv", '"a\nb"\tc\n1\t2\n')
    raw = load_paths(spark, str(tmp_path / "lines.tsv"))
    assert records(raw) == [{"a\nb": "1", "c": "2"}]


def test_json_as_json_libraries_read_it(spark, tmp_path):
    put(tmp_path, "a.jsonl", '{"a": 1, "a": 2, "s": "NaN, \\"Infinity\\""}\n{"a": NaN, "s": "x"}')
    raw = load_paths(spark, str(tmp_path))
    assert notes(raw) == {}
    got = raw.df.orderBy("row_id").select("a", "s").collect()
    assert [r.a for r in got] == ["2", "NaN"]
    assert [r.s for r in got] == ['NaN, "Infinity"', "x"]


def test_dates_in_workbooks_are_iso_text(tmp_path):
    from tunegrain.sources.office import _iso_date

    assert [_iso_date(45292), _iso_date(45292.5)] == ["2024-01-01 00:00:00", "2024-01-01 12:00:00"]
