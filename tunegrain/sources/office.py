"""Rows from office documents, extracted where the file bytes are.

Each document is opened by one task as a stream of the ``binaryFile`` scan; many documents
are spread over the cluster by the scan itself. The decoders yield one record at a time.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

# XML namespaces of the two formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

RESULT = "_file string, _pos bigint, record string, problem string"


def docx_records(content: bytes) -> Iterator[dict]:
    """One record per non-empty body paragraph."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{WORD}body")
    for paragraph in body.iterfind(f"{WORD}p") if body is not None else ():
        marks = {f"{WORD}t": None, f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
        pieces = (
            (node.text or "") if marks[node.tag] is None else marks[node.tag]
            for node in paragraph.iter()
            if node.tag in marks
        )
        text = "".join(pieces).strip()
        if text:
            yield {"text": text}


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match("[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - ord("A") + 1
    return index - 1


def _number(text: str) -> int | float:
    value = float(text)
    return int(value) if value.is_integer() else value


# Built-in number formats that show a date or a time.
DATE_FORMATS = frozenset((*range(14, 23), *range(45, 48)))


def _date_styles(package: zipfile.ZipFile) -> frozenset[int]:
    """Cell styles whose number format shows a date or a time."""
    if "xl/styles.xml" not in package.namelist():
        return frozenset()
    sheet = ElementTree.fromstring(package.read("xl/styles.xml"))
    dates = set(DATE_FORMATS)
    for fmt in sheet.iter(f"{SHEET}numFmt"):
        # Without quoted text, escaped signs, colours and conditions, these letters only mean parts of a date.
        bare = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", fmt.get("formatCode", ""))
        if re.search("[dmyhs]", bare, re.IGNORECASE):
            dates.add(int(fmt.get("numFmtId")))
    styles = sheet.find(f"{SHEET}cellXfs")
    return frozenset(i for i, xf in enumerate(styles if styles is not None else ()) if int(xf.get("numFmtId", 0)) in dates)


def _iso_date(serial: float) -> str:
    """A day number of the 1900 calendar as ISO text."""
    moment = datetime(1899, 12, 30) + timedelta(milliseconds=round(serial * 86_400_000))
    return moment.isoformat(sep=" ")


def _cell_value(cell, shared: list[str], dates: frozenset[int] = frozenset()):
    kind, raw = cell.get("t", "n"), cell.findtext(f"{SHEET}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return raw == "1"
    if kind == "n":
        return _iso_date(float(raw)) if int(cell.get("s", -1)) in dates else _number(raw)
    return raw


def _first_sheet(package: zipfile.ZipFile) -> str:
    """Part name of the first sheet of the workbook."""
    book = ElementTree.fromstring(package.read("xl/workbook.xml"))
    wanted = next(book.iter(f"{SHEET}sheet")).get(f"{RELATION}id")
    links = ElementTree.fromstring(package.read("xl/_rels/workbook.xml.rels"))
    target = next(link.get("Target") for link in links if link.get("Id") == wanted)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _header_names(values: dict[int, object]) -> dict[int, str]:
    """Column names as a spreadsheet reader gives them: blanks numbered, repeats suffixed."""
    names, used = {}, set()
    for index in range(max(values, default=-1) + 1):
        base = name = str(values[index]) if values.get(index) is not None else f"Unnamed: {index}"
        repeat = 0
        while name in used:
            repeat += 1
            name = f"{base}.{repeat}"
        used.add(name)
        names[index] = name
    return names


def xlsx_records(content: bytes) -> Iterator[dict]:
    """One record per row below the header row of the first sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in package.namelist():
            table = ElementTree.fromstring(package.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{SHEET}t")) for item in table.iter(f"{SHEET}si")]
        dates = _date_styles(package)
        names: dict[int, str] | None = None
        with package.open(_first_sheet(package)) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{SHEET}row":
                    continue
                cells = {
                    _column_index(c.get("r")) if c.get("r") else i: _cell_value(c, shared, dates)
                    for i, c in enumerate(row.iter(f"{SHEET}c"))
                }
                row.clear()
                if names is None:
                    names = _header_names(cells)
                else:  # a blank row is a record too
                    yield {name: cells.get(i) for i, name in names.items()}


def pdf_records(content: bytes) -> Iterator[dict]:
    """One record per page with text, numbered from 1."""
    try:
        from pypdf import PdfReader
    except ImportError as exc:
        raise RuntimeError("reading PDF needs the pypdf package") from exc
    for number, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
        text = (page.extract_text() or "").strip()
        if text:
            yield {"text": text, "page": number}


def xls_records(content: bytes) -> Iterator[dict]:
    raise RuntimeError("legacy .xls workbooks are not supported; save as .xlsx")


DECODERS: dict[str, Callable[[bytes], Iterable[dict]]] = {
    ".docx": docx_records,
    ".xlsx": xlsx_records,
    ".xls": xls_records,
    ".pdf": pdf_records,
}

FLUSH_ROWS = 4096


def _extract(decode: Callable[[bytes], Iterable[dict]]):
    columns = ["_file", "_pos", "record", "problem"]

    def rows_of(path: str, content: bytes) -> Iterator[tuple]:
        position = -1
        try:
            for position, record in enumerate(decode(content)):
                yield path, position, json.dumps(record, ensure_ascii=False), None
        except Exception as exc:  # any defect of one document is a note about that document
            yield path, position + 1, None, f"failed to parse ({exc})"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                for row in rows_of(path, content):
                    out.append(row)
                    if len(out) == FLUSH_ROWS:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
            yield pd.DataFrame(out, columns=columns)

    return run


def extract(documents: DataFrame, suffix: str) -> DataFrame:
    """``_file, _pos, record (JSON text), problem`` from a frame of ``path, content``."""
    return documents.select("path", "content").mapInPandas(_extract(DECODERS[suffix]), RESULT)
