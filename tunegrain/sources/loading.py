"""Raw files of many formats to one DataFrame.

Each reader returns rows with their place (``_file`` = number of the file, ``_block`` = offset of the
scanned split, ``_pos`` = order within it), notes about files it had to skip, and where each column was first
seen. A file with one unreadable record is skipped whole. ``load_paths`` unites the formats and numbers the rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from tunegrain.functions import jsontext
from tunegrain.functions.text import let, named, strip, strip_computed
from tunegrain.session import materialize
from tunegrain.sources import blocks, csvblocks, files, jsonblocks, office, textblocks
from tunegrain.sources.csvblocks import sniff_separator as sniff_separator
from tunegrain.sources.files import FileSet, file_id
from tunegrain.sources.typed import POSITION, Spot, by_spot, column_types, first_seen, key_lists, record_keys, schema_ddl, spread, to_columns

NOTES = "file string, reason string"

# Keys that may hold the rows of a JSON document, first match wins.
ROW_KEYS = ("data", "examples", "rows", "records", "items")

# Cell texts that count as missing in CSV and TSV files.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

RAGGED = "differ in length from the header; extra fields dropped"

#: Cells of a line that the parser makes room for, however few the header has.
MOST_CELLS = 1 << 18
ROW_ID = "row_id"
# A remark about a row that was read all the same; becomes a note about its file.
ROW_NOTE = "_note"


class LoadError(RuntimeError):
    """Nothing could be loaded, or the request itself is wrong."""


@dataclass(frozen=True)
class RawTable:
    """Loaded rows with a unique ``row_id``, and what was read and skipped."""

    df: DataFrame
    notes: DataFrame
    files: DataFrame

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW_ID]

    def sample(self, n: int = 5) -> DataFrame:
        return self.df.orderBy(ROW_ID).limit(n)

    def preview(self, n: int = 5, notes: int = 100) -> dict:
        """Columns, count, first ``n`` rows, the first ``notes`` notes by file, and how many notes there are."""
        return {
            "columns": self.columns,
            "n_records": self.df.count(),
            "sample": [r.asDict(recursive=True) for r in self.sample(n).drop(ROW_ID).collect()],
            "notes": [f"{r.file}: {r.reason}" for r in self.notes.orderBy("file").limit(notes).collect()],
            "n_notes": self.notes.count(),
        }


Loaded = tuple[DataFrame | None, DataFrame, dict[str, Spot]]


def _notes(spark: SparkSession, rows: Sequence[tuple[str, str]] = ()) -> DataFrame:
    return spark.createDataFrame(list(rows), NOTES)


def _scan(spark: SparkSession, files_: FileSet, fmt: str, **options: str) -> DataFrame:
    return spark.read.format(fmt).options(**files_.options(), **options).load(list(files_.paths))


def _whole_files_only(rows: DataFrame, defects: DataFrame) -> DataFrame:
    """Rows of files without a defect; ``defects`` has one row per bad file."""
    return rows.join(defects.select(file_id(F.col("file")).alias("_file")), "_file", "left_anti")


def _lines(scan: DataFrame) -> DataFrame:
    placed = scan.select(
        file_id(F.col("_metadata.file_path")).alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
        strip(F.col("value")).alias("line"),
    )
    return placed.where(F.col("line") != "")


def read_jsonl(spark: SparkSession, files_: FileSet) -> Loaded:
    """Two passes over the lines: findings per file and list of keys, then the typed rows."""
    lines = _lines(_scan(spark, files_, "text"))
    places = files_.places(spark)
    parsed = lines.withColumn("v", jsontext.parse_strict(F.col("line")))
    objects = jsontext.is_object(F.col("v"))
    parsed = parsed.withColumn("keys", F.when(F.col("v").isNotNull(), record_keys(F.col("v"), F.col("line"))))
    # The aggregate combines on the map side: one small row per file, list of keys and task is shuffled.
    findings = key_lists(
        parsed,
        F.count_if(F.col("v").isNull()).alias("bad"),
        F.count_if(F.col("v").isNotNull() & ~objects).alias("plain"),
        F.schema_of_variant_agg(F.when(objects, F.col("v"))).alias("shape"),
    )
    findings = materialize(findings, "jsonl")
    bad = findings.groupBy("_file").agg(F.sum("bad").alias("bad")).where("bad > 0")
    defects = bad.join(places, "_file").select("file", F.format_string("%d line(s) are not valid JSON", "bad").alias("reason"))
    good = _whole_files_only(findings, defects)
    n_good, n_plain = good.agg(F.count("*"), F.coalesce(F.sum("plain"), F.lit(0))).first()
    if not n_good:
        return None, defects, {}
    types = column_types(r.shape for r in good.select("shape").distinct().toLocalIterator())
    seen = first_seen(good, places)
    names = by_spot(types, seen)
    rows = _whole_files_only(lines, defects)
    if names:
        rows = rows.withColumn("_typed", F.from_json(jsontext.with_quoted_numbers(F.col("line")), schema_ddl(types, names)))
    plain = None
    if n_plain:
        v = jsontext.parse_strict(F.col("line"))
        plain = F.when(~F.startswith("line", F.lit("{")), F.try_variant_get(v, "$", "string"))
    return spread(rows, names, plain), defects, seen


def explode_document(rows: DataFrame, text: str) -> DataFrame:
    """Rows of JSON documents held in column ``text``.

    Adds ``_pos``, ``v`` (one record) and ``keys``; a text that is not a JSON list or object
    yields one row with ``problem`` set.
    """
    doc = rows.withColumn("_doc", jsontext.parse_strict(F.col(text)))
    top = jsontext.kind(F.col("_doc"))
    nested = F.coalesce(*[F.try_variant_get("_doc", f"$.{k}", "array<variant>") for k in ROW_KEYS])
    records = F.when(top == "ARRAY", jsontext.elements(F.col("_doc"))).when(
        top == "OBJECT", F.coalesce(nested, F.array("_doc"))
    )
    problem = F.when(F.col("_doc").isNull(), F.lit("invalid JSON")).when(
        records.isNull(), F.concat(F.lit("unsupported top-level JSON type "), F.lower(top))
    )
    # VARIANT objects sort their keys; the written order comes from the text of the first record.
    first = F.coalesce(
        F.get_json_object(text, "$[0]"), *[F.get_json_object(text, f"$.{k}[0]") for k in ROW_KEYS], F.col(text)
    )
    with_records = doc.withColumns({"problem": problem, "_records": records, "_first": first})
    placed = with_records.select(
        *rows.columns, "problem", "_first", F.posexplode_outer("_records").alias("_pos", "v")
    )
    return placed.withColumn("keys", F.when(F.col("_pos") == 0, F.json_object_keys("_first"))).drop("_first")


def read_json(spark: SparkSession, files_: FileSet) -> Loaded:
    """Documents of any length: the elements of their lists are cut out where they stand, and parsed one by one.

    What is parsed as one value is a single record, or what stands around the records of a file.
    """
    cut = jsonblocks.cut(spark, files_, ROW_KEYS)
    places = files_.places(spark)
    shells = blocks.around(cut).select(F.col("fid").alias("_file"), F.col("text").cast("string").alias("text"))
    shells = shells.withColumn("v", jsontext.parse_strict(F.col("text")))
    # Of several lists in a document the one under the first key counts; of a key that is repeated, the last.
    marks = cut.where(F.col("kind") == blocks.MARK).groupBy(F.col("fid").alias("_file"), "tag").agg(F.max(F.struct("home", "spot")).alias("list"))
    lists = materialize(cut.where(F.col("kind") == blocks.MARK).select(F.col("fid").alias("_file"), "home", "spot"), "json-lists")
    chosen = materialize(marks.groupBy("_file").agg(F.min(F.struct("tag", "list")).alias("first")).select("_file", "first.list.*"), "json-chosen")
    others = lists.join(chosen, ["_file", "home", "spot"], "left_anti")
    elements = blocks.placed(blocks.whole_records(cut)).join(others, ["_file", "home", "spot"], "left_anti")
    whole = shells.join(chosen, "_file", "left_anti").select("_file", F.lit(0).cast("bigint").alias("_block"), F.lit(0).cast("bigint").alias("_pos"), "text")
    texts = elements.select(*POSITION, F.col("text").cast("string").alias("text"))
    parsed = texts.withColumn("v", jsontext.parse_strict(F.col("text")))
    top = jsontext.kind(F.col("v"))
    problem = (
        F.when(F.col("v").isNull(), F.lit("invalid JSON"))
        .when(~top.isin("OBJECT", "ARRAY"), F.concat(F.lit("unsupported top-level JSON type "), F.lower(top)))
    )
    broken = parsed.where("v is null").select("_file").distinct().withColumn("problem", F.lit("invalid JSON"))
    found = shells.select("_file", problem.alias("problem")).where("problem is not null").unionByName(broken)
    # A file without any byte has nothing around its records.
    found = found.unionByName(places.select("_file").join(shells.select("_file"), "_file", "left_anti").withColumn("problem", F.lit("invalid JSON")))
    defects = materialize(found.groupBy("_file").agg(F.min("problem").alias("reason")).join(places, "_file").select("file", "reason"), "json-defects")
    records = _whole_files_only(texts.unionByName(whole), defects).withColumn("v", jsontext.parse_strict(F.col("text")))
    frame, seen = to_columns(records.withColumn("keys", record_keys(F.col("v"), F.col("text"))), places)
    return frame, defects, seen


def _read_delimited(spark: SparkSession, files_: FileSet, sep: str | None) -> Loaded:
    """Text columns; files are grouped by header so that each distinct layout is parsed as one."""
    cut = csvblocks.cut(spark, files_, sep)
    places = files_.places(spark)
    heads = cut.where(F.col("kind") == blocks.MARK).select(F.col("fid").alias("_file"), "tag", F.rtrim(F.col("text").cast("string"), F.lit("\r")).alias("header"))
    heads = materialize(heads, "headers")
    empty = places.join(heads, "_file", "left_anti").select("file", F.lit("no columns to parse").alias("reason"))
    first = F.min(F.struct("rank", "file")).alias("first")
    # One row for each distinct header.
    layouts = heads.join(places, "_file").groupBy("header", "tag").agg(first).orderBy("first").collect()
    records = blocks.placed(blocks.whole_records(cut))
    if len(layouts) > 1:
        records = records.join(heads.withColumnRenamed("tag", "code"), "_file")
    frames, seen = [], {}
    for layout in layouts:
        delimiter = chr(layout.tag)
        cells_of = csvblocks.header_cells(layout.header, delimiter)
        names = list(office._header_names(dict(enumerate(c if c != "" else None for c in cells_of))).values())
        for at, name in enumerate(names):
            spot = (*layout.first, 0, 0, at)
            seen[name] = min(seen.get(name, spot), spot)
        options = dict(sep=delimiter, quote='"', escape='"', maxColumns=str(max(MOST_CELLS, len(names) + 1)), maxCharsPerColumn="-1", mode="PERMISSIVE", columnNameOfCorruptRecord="_ragged", nullValue="", emptyValue="")
        mine = records.where((F.col("header") == layout.header) & (F.col("code") == layout.tag)) if len(layouts) > 1 else records
        line = F.rtrim(F.col("text").cast("string"), F.lit("\r"))
        rows = mine.select(*POSITION, F.from_csv(line, _ddl(names), options).alias("_cells"))
        cell = lambda n: F.col("_cells").getField(n)
        cells = [F.when(~cell(n).isin(*NA_TOKENS), cell(n)).alias(n) for n in names]
        note = F.when(cell("_ragged").isNotNull(), F.lit(RAGGED)).alias(ROW_NOTE)
        frames.append(rows.select(*POSITION, note, *cells))
    return (_unite(frames) if frames else None), empty, seen


def _ddl(names: Sequence[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, "_ragged"])


def read_csv(spark: SparkSession, files_: FileSet) -> Loaded:
    return _read_delimited(spark, files_, None)


def read_tsv(spark: SparkSession, files_: FileSet) -> Loaded:
    return _read_delimited(spark, files_, "\t")


def _same_footers(spark: SparkSession, paths: list[str]) -> list[tuple[list[str], DataFrame | str]]:
    """Paths grouped so that each group's schemas merge; a group whose one file can't be read has the reason.

    Spark reads and merges the footers of a group in a job of its own. Only a group that fails is
    halved, so a few odd files among many cost a few jobs.
    """
    try:
        return [(paths, spark.read.option("mergeSchema", "true").parquet(*paths))]
    except Exception as exc:
        if len(paths) == 1:
            return [(paths, f"failed to parse ({str(exc).splitlines()[0]})")]
    half = len(paths) // 2
    return _same_footers(spark, paths[:half]) + _same_footers(spark, paths[half:])


def read_parquet(spark: SparkSession, files_: FileSet) -> Loaded:
    place = (
        file_id(F.col("_metadata.file_path")).alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.row_index").alias("_pos"),
    )
    seen: dict[str, Spot] = {}
    ordered = files_.places(spark).orderBy("rank", "file")
    try:
        frames = [_scan(spark, files_, "parquet", mergeSchema="true")]
        firsts = [ordered.first()]
        bad = []
    except Exception:
        # Some footer is unreadable or types clash.
        places = ordered.collect()
        at = {r["file"]: r for r in places}
        groups = _same_footers(spark, [r["file"] for r in places])
        bad = [(paths[0], found) for paths, found in groups if isinstance(found, str)]
        frames = [found for _, found in groups if not isinstance(found, str)]
        firsts = [at[paths[0]] for paths, found in groups if not isinstance(found, str)]
    for frame, first in zip(frames, firsts):
        for i, name in enumerate(frame.columns):
            spot = (first["rank"], first["file"], 0, 0, i)
            seen[name] = min(seen.get(name, spot), spot)
    frames = [frame.select(*place, "*") for frame in frames]
    return (_unite(frames) if frames else None), _notes(spark, bad), seen


def split_paragraphs(text: Column, min_chars: int = 1) -> Column:
    """Stripped chunks between blank lines; the whole text if no chunk is long enough."""
    lines = F.regexp_replace(F.make_valid_utf8(text), "\r\n?", "\n")

    def chunks_of(all_lines: Column) -> Column:
        whole = strip_computed(all_lines)
        kept = F.filter(F.transform(F.split(all_lines, "\n\n"), strip), lambda c: F.length(c) >= min_chars)
        fallback = F.when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))
        return let(kept, lambda chunks: F.when(F.size(chunks) > 0, chunks).otherwise(fallback))

    return let(lines, chunks_of)


def read_text(spark: SparkSession, files_: FileSet) -> Loaded:
    """The paragraphs of text files of any length."""
    cut = textblocks.cut(spark, files_)
    places = materialize(files_.places(spark), "text-places")
    name = F.element_at(F.split("file", "/"), -1).alias("source")
    chunks = blocks.placed(blocks.whole_records(cut)).withColumn("text", strip(F.make_valid_utf8(F.col("text").cast("string")))).where("text <> ''")
    chunks = chunks.join(places.select("_file", name), "_file").select(*POSITION, "text", "source")
    first = places.orderBy("rank", "file").first()
    return chunks, _notes(spark), {n: (first["rank"], first["file"], 0, 0, i) for i, n in enumerate(("text", "source"))} if first else {}


def _read_office(spark: SparkSession, files_: FileSet, named: bool) -> Loaded:
    documents = _scan(spark, files_, "binaryFile").select(F.col("_metadata.file_path").alias("path"), "content")
    found = materialize(office.extract(documents, files_.fmt), "office")
    defects = found.where(F.col("problem").isNotNull()).select(
        F.col("_file").alias("file"), F.col("problem").alias("reason")
    )
    places = files_.places(spark)
    records = found.where(F.col("problem").isNull()).select(
        file_id(F.col("_file")).alias("_file"),
        F.lit(0).cast("bigint").alias("_block"),
        F.col("_pos").cast("bigint").alias("_pos"),
        F.try_parse_json("record").alias("v"),
        F.json_object_keys("record").alias("keys"),
    )
    rows, seen = to_columns(_whole_files_only(records, defects), places)
    if named and len(rows.columns) > len(POSITION):
        name = places.select("_file", F.element_at(F.split("file", "/"), -1).alias("source"))
        rows = rows.join(name, "_file").select(*rows.columns, "source")
        last = max(seen.values())
        seen["source"] = (*last[:4], last[4] + 1)
    return rows, defects, seen


def read_documents(spark: SparkSession, files_: FileSet) -> Loaded:
    return _read_office(spark, files_, named=True)


def read_workbooks(spark: SparkSession, files_: FileSet) -> Loaded:
    return _read_office(spark, files_, named=False)


READERS: dict[str, Callable[[SparkSession, FileSet], Loaded]] = {
    ".csv": read_csv,
    ".docx": read_documents,
    ".json": read_json,
    ".jsonl": read_jsonl,
    ".md": read_text,
    ".ndjson": read_jsonl,
    ".parquet": read_parquet,
    ".pdf": read_documents,
    ".tsv": read_tsv,
    ".txt": read_text,
    ".xls": read_workbooks,
    ".xlsx": read_workbooks,
}


def _unite(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column whose type differs between frames becomes text."""
    types: dict[str, set[str]] = {}
    for frame in frames:
        for f in frame.schema.fields:
            types.setdefault(f.name, set()).add(f.dataType.simpleString())
    clashing = {name for name, seen in types.items() if len(seen) > 1}

    def aligned(frame: DataFrame) -> DataFrame:
        def column(f: T.StructField) -> Column:
            c = named(f.name)
            if f.name not in clashing:
                return c
            nested = isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
            return (F.to_json(c) if nested else c.cast("string")).alias(f.name)

        return frame.select(*[column(f) for f in frame.schema.fields])

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(aligned, frames))


def _starts(placed: DataFrame, places: DataFrame) -> DataFrame:
    """``_file, _block, _low, _start``: the first row number of every scanned split.

    A running sum in two levels: the splits are cut into ranges, the ranges are summed up,
    and each range runs on from its own start. Only range totals meet in one task.
    """
    extents = placed.groupBy("_file", "_block").agg(
        F.min("_pos").alias("_low"), (F.max("_pos") - F.min("_pos") + 1).alias("_extent")
    )
    place = ["rank", "file", "_block"]
    ranged = extents.join(places, "_file").repartitionByRange(*place).withColumn("_range", F.spark_partition_id())
    # Stored, so that the number of a split's range is fixed from here on.
    splits = materialize(ranged, "splits")

    def before(window: WindowSpec, amount: str) -> Column:
        return F.coalesce(F.sum(amount).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    totals = splits.groupBy("_range").agg(F.sum("_extent").alias("_total"))
    offsets = totals.select("_range", before(Window.orderBy("_range"), "_total").alias("_offset"))
    inside = before(Window.partitionBy("_range").orderBy(*place), "_extent")
    return splits.withColumn("_inside", inside).join(offsets, "_range").select(
        "_file", "_block", "_low", (F.col("_offset") + F.col("_inside")).alias("_start")
    )


def number_rows(placed: DataFrame, places: DataFrame) -> DataFrame:
    """Replace the position columns by ``row_id``: ascending by file (by rank, then by name), then place in the file.

    ``placed`` must be stored, since ``_pos`` may only be read once. Rows are never sorted: each adds its place in its
    split to the split's first number. How the short table of splits is joined is left to Spark.
    """
    starts = materialize(_starts(placed, places), "starts")
    numbered = placed.join(starts, ["_file", "_block"]).withColumn(
        ROW_ID, F.col("_start") + F.col("_pos") - F.col("_low")
    )
    return numbered.select(ROW_ID, *[named(c) for c in placed.columns if c not in (*POSITION, ROW_NOTE)])


def _load(spark: SparkSession, sets: Sequence[FileSet], notes: list[tuple[str, str]]) -> RawTable:
    places = reduce(DataFrame.unionByName, [s.places(spark) for s in sets]) if sets else None
    if places is not None:
        places = materialize(places.distinct(), "places")
        if places.select("_file").distinct().count() < places.count():
            raise LoadError("two of the files have the same number; load them in two parts")
    loaded = [READERS[s.fmt](spark, s) for s in sets]
    frames = [frame for frame, _, _ in loaded if frame is not None and len(frame.columns) > len(POSITION)]
    all_notes = reduce(DataFrame.unionByName, [n for _, n, _ in loaded], _notes(spark, notes))
    stored = materialize(_unite(frames), "raw") if frames else None
    listings = reduce(DataFrame.unionByName, [s.listing(spark) for s in sets]) if sets else None
    if stored is None or stored.isEmpty():
        shown = all_notes.orderBy("file").limit(20).collect()
        reasons = " ".join(f"{r.file}: {r.reason}." for r in shown)
        more = all_notes.count() - len(shown)
        raise LoadError(f"no records could be loaded. {reasons}{f' And {more} more.' if more else ''}".strip())
    noted = all_notes.select(files.plain_uri(F.col("file")).alias("_uri"))
    read = listings.join(noted, files.plain_uri(F.col("file")) == F.col("_uri"), "left_anti")
    if ROW_NOTE in stored.columns:
        remarks = stored.where(F.col(ROW_NOTE).isNotNull()).groupBy("_file", ROW_NOTE)
        counted = remarks.agg(F.count("*").alias("n")).join(places, "_file")
        all_notes = all_notes.unionByName(
            counted.select("file", F.format_string("%d row(s) %s", "n", ROW_NOTE).alias("reason"))
        )
    # Columns in the order in which they are first seen over all files.
    seen: dict[str, Spot] = {}
    for _, _, spots in loaded:
        for name, spot in spots.items():
            seen[name] = min(seen.get(name, spot), spot)
    numbered = number_rows(stored, places)
    columns = by_spot([c for c in numbered.columns if c != ROW_ID], seen)
    return RawTable(numbered.select(ROW_ID, *[named(c) for c in columns]), all_notes, read)


def load_file(spark: SparkSession, path: str) -> RawTable:
    """Load one file; its extension names the format."""
    if not files.exists(spark, path):
        raise LoadError(f"file not found: {path}")
    suffix = _suffix(path)
    if suffix not in READERS:
        raise LoadError(f"unsupported file type {suffix!r}; supported: {sorted(READERS)}")
    return _load(spark, [FileSet([path], suffix, recursive=False)], [])


def _uri(path: str) -> str:
    """A qualified path, local ones with three slashes."""
    return re.sub("^file:/+", "file:///", path)


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name.lstrip(".") else ""


def load_paths(spark: SparkSession, paths: str | Iterable[str], fmt: str | None = None) -> RawTable:
    """Load a folder (searched recursively), one file or a list of files as one table.

    Files that cannot be read become notes; it is an error only if nothing could be loaded.
    ``fmt`` (such as ``".jsonl"``) reads every file as that format whatever its extension,
    for instance the part files of a Spark job.
    """
    if fmt is not None:
        if fmt not in READERS:
            raise LoadError(f"unsupported file type {fmt!r}; supported: {sorted(READERS)}")
        folder = isinstance(paths, str) and files.is_directory(spark, paths)
        found = [paths] if isinstance(paths, str) else list(paths)
        return _load(spark, [FileSet(found, fmt, recursive=folder, any_name=True)], [])
    if isinstance(paths, str) and files.is_directory(spark, paths):
        listing = files.list_files(spark, [paths], recursiveFileLookup="true")
        present = listing.select(files.suffix_of(F.col("path")).alias("suffix")).distinct()
        suffixes = sorted(r.suffix for r in present.where(F.col("suffix").isin(*READERS)).collect())
        if not suffixes:
            raise LoadError(f"no supported files found in {paths}")
        return _load(spark, [FileSet([paths], s, recursive=True) for s in suffixes], [])
    groups: dict[str, list[str]] = {}
    notes: list[tuple[str, str]] = []
    # A file that is named twice is read once.
    paths = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
    for path in paths:
        suffix = _suffix(path)
        if not files.exists(spark, path):
            notes.append((path, "file not found"))
        elif suffix not in READERS:
            notes.append((path, f"unsupported file type {suffix!r}"))
        else:
            groups.setdefault(suffix, []).append(path)
    given = {p for found in groups.values() for p in found}
    order = tuple(_uri(files.qualified(spark, p)) for p in paths if p in given)
    return _load(spark, [FileSet(found, s, recursive=False, order=order) for s, found in groups.items()], notes)
