"""Files that are read in many small splits, against the same files read whole by Python."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tunegrain.sources import blocks, csvblocks, jsonblocks, load_paths
from tunegrain.sources.files import FileSet
from tunegrain.sources.loading import ROW_KEYS

SPLIT = 6000


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, str(SPLIT))
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
    return str(path)


def rows(raw):
    return [{k: v for k, v in r.asDict().items() if k != "row_id"} for r in raw.df.orderBy("row_id").collect()]


def notes(raw):
    return {r.file.rsplit("/", 1)[-1]: r.reason for r in raw.notes.collect()}


HARD = ['plain', 'a, b', 'say "x"', "back\\slash", '\\"', "]", "[{", "é, ü", "", ",", "tab\t", "line\nbreak", '{"data": [1, 2]}', "}{", "\\\\"]


def record(rng, i):
    return {"n": i, "s": "".join(rng.choice(HARD) for _ in range(rng.randint(0, 12))), "l": [[i, "x,y"], []], "o": {"data": [1], "k": rng.choice(HARD)}}


def flat(r):
    return {"n": r["n"], "s": r["s"]}


@pytest.mark.parametrize("indent", [None, 1])
def test_json_documents_over_many_splits(small_splits, tmp_path, indent):
    rng = random.Random(indent or 0)
    lists = {name: [record(rng, i) for i in range(low, low + 90)] for name, low in (("a", 0), ("b", 100), ("c", 200), ("d", 300), ("g", 400))}
    dump = lambda x: json.dumps(x, indent=indent, ensure_ascii=False)
    put(tmp_path, "a.json", dump(lists["a"]))
    put(tmp_path, "b.json", " \n" + dump({"meta": {"data": [7], "z": HARD}, "rows": lists["b"], "n": [1, 2]}) + "\n")
    # Two lists of records: the first key in the fixed order counts, wherever it stands.
    put(tmp_path, "c.json", dump({"items": lists["d"][:60], "data": lists["c"], "rows": 5}))
    put(tmp_path, "d.json", dump({"n": 999, "s": "one object", "more": lists["d"]}))
    put(tmp_path, "e.json", dump(lists["a"]) + " trailing")
    put(tmp_path, "f.json", dump(lists["a"])[:-40])
    put(tmp_path, "g.json", dump(lists["g"]).replace('"n": 417', '"n": 4 17', 1))
    put(tmp_path, "h.json", "[]")
    put(tmp_path, "i.json", dump({"data": []}))
    put(tmp_path, "j.json", "[" + "1, " * 500 + "]")
    raw = load_paths(small_splits, str(tmp_path))
    got = [{k: r[k] for k in ("n", "s")} for r in rows(raw)]
    assert got == [flat(r) for r in lists["a"] + lists["b"] + lists["c"]] + [{"n": 999, "s": "one object"}]
    assert raw.columns == ["n", "s", "l", "o", "more"]
    assert notes(raw) == {f"{x}.json": "invalid JSON" for x in "efgj"}


def test_long_files_use_many_tasks(small_splits, tmp_path):
    path = put(tmp_path, "a.json", json.dumps([{"n": i, "s": "x" * 50} for i in range(900)]))
    long = blocks.splits(small_splits, FileSet([path], ".json", recursive=False), ",", True)
    assert long.rdd.getNumPartitions() > 5 and long.select("block").distinct().count() > 5
    found = jsonblocks.cut(small_splits, FileSet([path], ".json", recursive=False), ROW_KEYS)
    # No row holds more than a record.
    assert found.agg(F.max(F.length("text"))).first()[0] < 80


def test_one_huge_record_over_many_splits(small_splits, tmp_path):
    put(tmp_path, "a.json", json.dumps([{"n": 1}, {"n": 2, "s": ", ".join(map(str, range(3000)))}, {"n": 3}]))
    assert [(r["n"], len(r["s"] or "")) for r in rows(load_paths(small_splits, str(tmp_path)))] == [(1, 0), (2, len(", ".join(map(str, range(3000))))), (3, 0)]


CELLS = ["a", "x y", '5" wide', '"q"', "l1\nl2", "\n\n", "", "a;b", "a,b", '""', 'é\n"é",', "long " * 60]


@pytest.mark.parametrize(("name", "sep"), [("a.csv", ","), ("a.csv", ";"), ("a.tsv", "\t")])
def test_delimited_files_over_many_splits(small_splits, tmp_path, name, sep):
    rng = random.Random(ord(sep))
    table = [[str(i), *(rng.choice(CELLS) for _ in range(3))] for i in range(400)]
    text = io.StringIO()
    csv.writer(text, delimiter=sep, lineterminator="\n").writerows([["id", "first\nname", "b", 'c "x"'], *table])
    put(tmp_path, name, text.getvalue())
    raw = load_paths(small_splits, str(tmp_path))
    assert raw.columns == ["id", "first\nname", "b", 'c "x"']
    assert [list(r.values()) for r in rows(raw)] == [[c if c != "" else None for c in r] for r in table]
    assert notes(raw) == {}


def test_a_stray_quote_stays_in_its_line(small_splits, tmp_path):
    lines = ['size 15",price', *[f'{i}" wide,{i}' for i in range(200)]]
    put(tmp_path, "a.csv", "\r\n".join(lines) + "\r\n")
    raw = load_paths(small_splits, str(tmp_path))
    assert raw.columns == ['size 15"', "price"]
    assert [list(r.values()) for r in rows(raw)] == [[f'{i}" wide', str(i)] for i in range(200)]


def test_quotes_open_at_the_start_of_cells_only():
    after = lambda line, inside=False: csvblocks.quoted_after(line.encode(), inside, b",")
    assert [after(x) for x in ('a,b', 'a "b,c', '"a', '"a""', '"a"",b', '"a",b', 'x,"', 'x,""', '"a"b,"c', '"a"b"')] == [False, False, True, True, True, False, True, False, True, False]
    assert [after(x, True) for x in ('a', 'a"', 'a"",b', 'a","b', '"', '""')] == [True, False, True, True, False, True]


def test_rows_with_many_more_cells_than_the_header(spark, tmp_path):
    put(tmp_path, "a.csv", "a,b\n1,2\n" + ",".join(["x"] * 5000) + "\n3\n")
    raw = load_paths(spark, str(tmp_path))
    assert rows(raw) == [{"a": "1", "b": "2"}, {"a": "x", "b": "x"}, {"a": "3", "b": None}]
    assert "differ in length" in notes(raw)["a.csv"]


def test_wide_headers_and_headers_without_rows(spark, tmp_path):
    wide = [f"column {i}" for i in range(300)]
    put(tmp_path, "wide.tsv", "\t".join(wide) + "\n" + "\t".join(map(str, range(300))))
    raw = load_paths(spark, str(tmp_path))
    assert raw.columns == wide
    assert raw.df.select("column 299").first()[0] == "299"


def test_paragraphs_over_many_splits(small_splits, tmp_path):
    rng = random.Random(5)
    parts = ["\n".join(rng.choice(["word ", "more\rwords", " é"]) * rng.randint(1, 20) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    text = "\n\n" + "".join(p + rng.choice(["\n\n", "\n\n\n", "\r\n\r\n", "\n \n\n", "\r\r"]) for p in parts)
    put(tmp_path, "a.txt", text)
    put(tmp_path, "b.txt", "one " * 2000)
    want = [c.strip() for c in text.replace("\r\n", "\n").replace("\r", "\n").split("\n\n")]
    got = rows(load_paths(small_splits, str(tmp_path)))
    assert [r["text"] for r in got] == [c for c in want if c] + [("one " * 2000).strip()]
    assert {r["source"] for r in got} == {"a.txt", "b.txt"}


def test_columns_are_in_the_order_first_seen(spark, tmp_path):
    put(tmp_path, "a.jsonl", '{"b": 1}\n' * 300 + '{"late": 2, "b": 1}\n')
    put(tmp_path, "b.jsonl", '{"z": 1, "a": 2}\n')
    put(tmp_path, "c.csv", "q,r\n1,2\n")
    put(tmp_path, "d.json", '[{"r": 1, "y": 2}, {"x": 3}]')
    assert load_paths(spark, str(tmp_path)).columns == ["b", "late", "z", "a", "q", "r", "y", "x"]
    listed = [str(tmp_path / n) for n in ("c.csv", "d.json", "b.jsonl", "a.jsonl")]
    assert load_paths(spark, listed).columns == ["q", "r", "y", "x", "z", "a", "b", "late"]


def test_parquet_files_are_grouped_by_halving(spark, tmp_path):
    for i in range(6):
        kind = "string" if i == 3 else "int"
        spark.createDataFrame([(i,)], "k int").select(F.col("k").cast(kind).alias("k")).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    put(tmp_path, "z.parquet", b"broken")
    raw = load_paths(spark, str(tmp_path))
    assert [r["k"] for r in rows(raw)] == ["0", "1", "2", "3", "4", "5"] and list(notes(raw)) == ["z.parquet"]
