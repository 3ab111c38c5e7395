"""Queries through files: tables written by Spark in raw formats and read back by the readers."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunegrain.functions import chat
from tunegrain.operators import normalize as norm
from tunegrain.operators import split
from tunegrain.plans import prepare
from tunegrain.plans.fixtures import CHAT_MAPPING, CHAT_SQL, TEXT_MAPPING, conversations, strip_sql, table
from tunegrain.plans.text_queries import ORACLES as TEXT_ORACLES
from tunegrain.schema import guess_mapping
from tunegrain.session import files_for, fresh_path
from tunegrain.sources import load_paths, office, prepared

CHATML = chat.ChatTemplate.named("chatml", suffix="<|im_end|>\n")


def jsonl_reader(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "jsonl")
    table(spark, folder, "documents").select("doc_id", "text", "lang").write.json(path)
    return load_paths(spark, path, fmt=".jsonl").df.select("doc_id", "text", "lang")


def _as_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of one task as the lines of one JSON document: a list, or an object that holds it between other members."""
    wrapped = TaskContext.get().partitionId() % 2
    begin, end = ('{"made": {"data": [1]}, "rows": [', '], "n": 2}') if wrapped else ("[", "]")
    for batch in batches:
        for text in batch.column(0).to_pylist():
            yield pa.record_batch([pa.array([begin + text])], names=["value"])
            begin = ","
    if begin != ",":
        yield pa.record_batch([pa.array([begin])], names=["value"])
    yield pa.record_batch([pa.array([end])], names=["value"])


def json_reader(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in a few long JSON documents, cut into records by many tasks."""
    path = fresh_path(spark, "json")
    record = F.to_json(F.struct("doc_id", "text", "lang", F.array(F.struct(F.lit("a, b").alias("k"))).alias("more")))
    docs = table(spark, folder, "documents")
    rows = docs.select(record.alias("value")).coalesce(files_for(docs, 4))
    rows.mapInArrow(_as_documents, "value string").write.text(path)
    return load_paths(spark, path, fmt=".json").df.select("doc_id", "text", "lang")


def tsv_reader(spark: SparkSession, folder: str) -> DataFrame:
    """Tab-separated parts whose names hold line breaks, tabs and quotes, in quoted cells and as stray quotes."""
    path = fresh_path(spark, "tsv")
    name = F.concat("p_name", F.lit("\n\n"), "p_brand", F.lit('\t5" "wide"'))
    parts = table(spark, folder, "part").select("p_partkey", name.alias("p_name"), "p_type", F.concat(F.col("p_size").cast("string"), F.lit('"')).alias("p_size"))
    parts.write.options(header="true", sep="\t", escape='"', escapeQuotes="false", lineSep="\n").csv(path)
    return load_paths(spark, path, fmt=".tsv").df.select("p_partkey", "p_name", "p_type", "p_size")


def text_reader(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a blank line after each, as long text files; back come their paragraphs."""
    path = fresh_path(spark, "texts")
    docs = table(spark, folder, "documents")
    docs.select(F.concat("text", F.lit("\n")).alias("value")).coalesce(files_for(docs, 3)).write.text(path)
    return load_paths(spark, path, fmt=".txt").df.groupBy("text").agg(F.count("*").alias("n"))


def head_of_files(spark: SparkSession, folder: str) -> DataFrame:
    """The first rows of a loaded folder, as a preview shows them, with the number of all."""
    path = fresh_path(spark, "head")
    rows = table(spark, folder, "documents").select("doc_id", "lang").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    rows.write.json(path)
    raw = load_paths(spark, path, fmt=".jsonl")
    shown = raw.preview(7)
    first = spark.createDataFrame([(r["doc_id"], r["lang"]) for r in shown["sample"]], "doc_id bigint, lang string")
    return first.withColumn("n_records", F.lit(shown["n_records"]).cast("bigint"))


def dataset_opened(spark: SparkSession, folder: str) -> DataFrame:
    """A prepared dataset opened again by its id: its facts, and its first training examples by a limit."""
    root = fresh_path(spark, "datasets")
    made = _prepared_chat(spark, folder, root)
    found = prepared.get_dataset(spark, root, made.info.dataset_id)
    examples = found.examples(spark, limit=10)
    facts = {"n_train": found.info.n_train, "n_eval": found.info.n_eval, "previewed": _previewed(spark, found.directory)}
    return examples.agg(F.count("*").alias("n_read"), *[F.lit(v).cast("bigint").alias(k) for k, v in facts.items()])


def _previewed(spark: SparkSession, directory: str) -> int:
    """How many examples the preview file of a dataset shows."""
    return spark.read.text(f"{directory}/{prepared.PREVIEW_FILE}").where("value like '===== Example %'").count()


def csv_reader(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as semicolon-separated files with a header; every value is text."""
    path = fresh_path(spark, "csv")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    parts.write.options(header="true", sep=";").csv(path)
    return load_paths(spark, path).df.select("p_partkey", "p_name", "p_brand", "p_size")


def mixed_folder(spark: SparkSession, folder: str) -> DataFrame:
    """One folder with CSV and Parquet files: a column whose type differs becomes text."""
    path = fresh_path(spark, "mixed")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    parts.write.option("header", "true").csv(f"{path}/parts")
    suppliers.write.parquet(f"{path}/suppliers")
    return load_paths(spark, path).df.select("id", "name", "nation")


def guessed_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Raw files to examples with the mapping guessed from the column names."""
    path = fresh_path(spark, "guessed")
    turns = conversations(spark, folder).select("conv_id", F.col("messages").alias("dialog"))
    turns.write.parquet(path)
    raw = load_paths(spark, path)
    examples = norm.examples(norm.normalize(raw.df, guess_mapping(raw.columns), keep=["conv_id"]))
    return examples.select("conv_id", F.size("messages").alias("n_turns"), chat.last_assistant(F.col("messages")).alias("last_reply"))


def _prepared_chat(spark: SparkSession, folder: str, root: str) -> prepared.PreparedDataset:
    return prepare.prepare(
        conversations(spark, folder), CHAT_MAPPING, root, name="Support Chats!", row_id="conv_id", eval_ratio=0.2
    )


def training_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A prepared chat dataset as the trainer reads it."""
    done = _prepared_chat(spark, folder, fresh_path(spark, "datasets"))
    train, held_out = prepared.training_frames(spark, done.directory, CHATML)
    frames = train.withColumn("split", F.lit("train"))
    if held_out is not None:
        frames = frames.unionByName(held_out.withColumn("split", F.lit("eval")))
    return frames.select("split", F.md5("text").alias("digest"))


def dataset_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Two prepared datasets, listed from their metadata files."""
    root = fresh_path(spark, "datasets")
    _prepared_chat(spark, folder, root)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    prepare.prepare(docs, TEXT_MAPPING, root, name="Docs", row_id="doc_id")
    return prepared.catalog(spark, root).select(
        "name", "task_format", "n_examples", "n_train", "n_eval", "has_system", "label",
        F.col("stats.token_len.median").alias("median_tokens"),
        F.col("stats.duplicate_count").alias("duplicates"),
        F.regexp_replace("dataset_id", "[0-9a-f]{8}$", "").alias("slug"),
    )


def _packed(parts: dict[str, str]) -> bytes:
    """An office document from its XML parts."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as package:
        for name, xml in parts.items():
            package.writestr(name, xml)
    return buffer.getvalue()


def _docx(text: str) -> bytes:
    """One paragraph per line of the text."""
    body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
    space = office.WORD.strip("{}")
    return _packed({"word/document.xml": f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>'})


def _xlsx(text: str) -> bytes:
    """A header row, then one row per line of the text: its number and the line."""
    main, relation = office.SHEET.strip("{}"), office.RELATION.strip("{}")
    rows = '<row><c t="inlineStr"><is><t>no</t></is></c><c t="inlineStr"><is><t>line</t></is></c></row>' + "".join(
        f'<row><c><v>{i}</v></c><c t="inlineStr"><is><t>{escape(line)}</t></is></c></row>'
        for i, line in enumerate(text.split("\n"))
    )
    return _packed(
        {
            "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{relation}"><sheets><sheet r:id="a"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="sheet.xml"/></Relationships>',
            "xl/sheet.xml": f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>',
        }
    )


def _as_office_files(spark: SparkSession, folder: str, build: Callable[[str], bytes]) -> DataFrame:
    """Every document as one office file: ``path`` (its number) and ``content``."""

    @F.pandas_udf(T.BinaryType())
    def content(texts: pd.Series) -> pd.Series:
        return texts.map(build)

    docs = table(spark, folder, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("path"), content("text").alias("content"))


def docx_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    found = office.extract(_as_office_files(spark, folder, _docx), ".docx")
    return found.select(
        F.col("_file").cast("bigint").alias("doc_id"), "_pos", F.get_json_object("record", "$.text").alias("text"), "problem"
    )


def xlsx_rows(spark: SparkSession, folder: str) -> DataFrame:
    found = office.extract(_as_office_files(spark, folder, _xlsx), ".xlsx")
    return found.select(
        F.col("_file").cast("bigint").alias("doc_id"),
        F.get_json_object("record", "$.no").cast("bigint").alias("no"),
        F.get_json_object("record", "$.line").alias("line"),
        "problem",
    )


QUERIES = {
    f.__name__: f
    for f in (
        jsonl_reader, json_reader, csv_reader, tsv_reader, text_reader, head_of_files, dataset_opened, mixed_folder, docx_paragraphs, xlsx_rows, guessed_mapping, training_texts, dataset_catalog,
    )
}

_CHAT_ROWS = f"""
    SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text,
           string_agg(content, chr(10) ORDER BY turn) AS body
    FROM ({CHAT_SQL}) GROUP BY conv_id
    HAVING length(coalesce(max_by(content, turn) FILTER (role = 'assistant'), '')) > 2
"""
_CHAT_SPLIT = f"""
    SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('{split.DEFAULT_SEED}:' || conv_id), conv_id)
                        <= least(floor(count(*) OVER () * 0.2::DOUBLE), greatest(count(*) OVER () - 1, 0))
                   THEN 'eval' ELSE 'train' END AS split FROM ({_CHAT_ROWS})
"""
_ALL_CHATS = f"""
    SELECT string_agg(content, chr(10) ORDER BY turn) AS body FROM ({CHAT_SQL}) GROUP BY conv_id
"""
_DOC_COUNTS = TEXT_ORACLES["split_membership"]

ORACLES = {
    "jsonl_reader": "SELECT doc_id, text, lang FROM documents",
    "json_reader": "SELECT doc_id, text, lang FROM documents",
    "tsv_reader": """
        SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name || chr(10) || chr(10) || p_brand || chr(9) || '5" "wide"' AS p_name, p_type,
               p_size || '"' AS p_size FROM part""",
    "text_reader": f"""
        SELECT text, count(*) AS n FROM (SELECT {strip_sql("unnest(string_split(text, chr(10) || chr(10)))")} AS text FROM documents)
        WHERE text <> '' GROUP BY text""",
    "head_of_files": """
        SELECT doc_id, lang, (SELECT count(*) FROM documents) AS n_records FROM documents ORDER BY doc_id LIMIT 7""",
    "dataset_opened": f"""
        SELECT least(10, count(*) FILTER (split = 'train')) AS n_read, count(*) FILTER (split = 'train') AS n_train,
               count(*) FILTER (split = 'eval') AS n_eval, least(5, count(*) FILTER (split = 'train')) AS previewed
        FROM ({_CHAT_SPLIT})""",
    "csv_reader": """
        SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part""",
    "mixed_folder": """
        SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, NULL::INTEGER AS nation FROM part
        UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, s_nationkey FROM supplier""",
    "docx_paragraphs": f"""
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS _pos, line AS text, NULL::VARCHAR AS problem
        FROM (SELECT doc_id, generate_subscripts(parts, 1) AS i, {strip_sql('unnest(parts)')} AS line
              FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE line <> ''""",
    "xlsx_rows": """
        SELECT doc_id, generate_subscripts(parts, 1) - 1 AS no, unnest(parts) AS line, NULL::VARCHAR AS problem
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)""",
    "guessed_mapping": f"""
        SELECT conv_id, count(*) AS n_turns, {strip_sql("max_by(text, turn) FILTER (role = 'assistant')")} AS last_reply
        FROM conversations GROUP BY conv_id""",
    "training_texts": f"SELECT split, md5(text) AS digest FROM ({_CHAT_SPLIT})",
    "dataset_catalog": f"""
        SELECT 'Support Chats!' AS name, 'chat' AS task_format, count(*) AS n_examples,
               count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'eval') AS n_eval,
               true AS has_system,
               'Support Chats! · ' || count(*) FILTER (split = 'train') || ' train (chat)' AS label,
               (SELECT CAST(floor(median(greatest(1, round_even(length(body) / 4, 0)))) AS BIGINT) FROM ({_ALL_CHATS})) AS median_tokens,
               (SELECT count(*) - count(DISTINCT {strip_sql('body')}) FROM ({_ALL_CHATS})) AS duplicates,
               'support-chats-' AS slug
        FROM ({_CHAT_SPLIT})
        UNION ALL
        SELECT 'Docs', 'completion', count(*), count(*) FILTER (split = 'train'), count(*) FILTER (split = 'eval'), false,
               'Docs · ' || count(*) FILTER (split = 'train') || ' train (completion)',
               (SELECT token_median FROM ({TEXT_ORACLES['token_stats']})),
               (SELECT count(*) FROM ({TEXT_ORACLES['duplicate_rows']})), 'docs-'
        FROM ({_DOC_COUNTS})""",
}
