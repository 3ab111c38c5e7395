"""Prepared datasets on storage.

Layout of one dataset folder: ``train/`` and ``eval/`` (JSON-lines part files, in order), and the small single files ``dataset_info.json``, ``validation.json`` and ``preview.txt``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegrain.functions import chat
from tunegrain.schema import EXAMPLE, DatasetInfo
from tunegrain.session import fit_shuffles
from tunegrain.sources import files

TRAIN, EVAL = "train", "eval"
#: Where both splits are written first; each folder then gets its name.
WRITING = "_writing"
INFO_FILE, VALIDATION_FILE, PREVIEW_FILE = "dataset_info.json", "validation.json", "preview.txt"
PREVIEW_EXAMPLES = 5

_STATS = (
    "struct<token_len: struct<min: bigint, median: bigint, mean: double, p95: bigint, max: bigint>, "
    "duplicate_count: bigint, empty_output_count: bigint>"
)
_MAPPING = (
    "struct<task_format: string, instruction_field: string, input_field: string, output_field: string, "
    "system_field: string, text_field: string, messages_field: string, system_prompt: string, input_template: string>"
)
INFO = (
    "dataset_id string, name string, task_format string, n_examples bigint, n_train bigint, n_eval bigint, "
    f"has_system boolean, source_columns array<string>, mapping {_MAPPING}, source_files array<string>, stats {_STATS}"
)


def record_columns(df: DataFrame) -> list[Column]:
    """The stored fields: ``messages`` or ``text``, and ``meta`` when it is not empty."""
    columns = [
        F.col("messages"),
        F.when(F.col("messages").isNull(), F.coalesce("text", F.lit(""))).alias("text"),
    ]
    if "meta" in df.columns:
        columns.append(F.when(F.size("meta") > 0, F.col("meta")).alias("meta"))
    return columns


def split_folder(directory: str, split: str) -> str:
    return f"{directory}/{split}"


def write_examples(df: DataFrame, path: str) -> None:
    """JSON lines, null fields left out."""
    df.select(*record_columns(df)).write.mode("overwrite").json(path)


def write_splits(df: DataFrame, directory: str) -> None:
    """All rows by ``split``, in the order of ``split_key``, from one scan and one shuffle.

    Held-out rows have the lowest keys, so only one task writes to both folders. The folders get their names when both
    are complete.
    """
    spark = df.sparkSession
    ranged = fit_shuffles(df).repartitionByRange("split_key").sortWithinPartitions("split", "split_key")
    records = ranged.select(*record_columns(df), "split")
    records.write.mode("overwrite").partitionBy("split").json(f"{directory}/{WRITING}")
    for split in (TRAIN, EVAL):
        files.replace_folder(spark, f"{directory}/{WRITING}/split={split}", split_folder(directory, split))
    files.remove_folder(spark, f"{directory}/{WRITING}")


def read_split(spark: SparkSession, directory: str, split: str, limit: int | None = None) -> DataFrame:
    """Stored examples of one split; none when nothing was written for it."""
    path = split_folder(directory, split)
    if not files.exists(spark, path):
        return spark.createDataFrame([], EXAMPLE)
    return read_examples(spark, path, limit)


def _examples(rows: DataFrame) -> DataFrame:
    """``messages`` wins over ``text`` when a record has both."""
    return rows.withColumn("text", F.when(F.col("messages").isNull(), F.col("text")))


def read_examples(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Stored examples, in stored order: that of the part files and the lines in them.

    With a ``limit`` the part files are opened one by one until there are enough lines; later ones are left alone.
    """
    if limit is None:
        return _examples(spark.read.schema(EXAMPLE).json(path))
    parts = [f"{path}/{name}" for name in files.children(spark, path) if name.startswith("part-")] if files.is_directory(spark, path) else [path]
    found, left = [], limit
    for part in parts:
        if left <= 0:
            break
        rows = spark.read.schema(EXAMPLE).json(part)
        n = rows.count()
        if n > left:
            # Only the last of the files is cut off.
            placed = rows.withColumn("_block", F.col("_metadata.file_block_start")).withColumn("_pos", F.monotonically_increasing_id())
            rows = placed.orderBy("_block", "_pos").limit(left).drop("_block", "_pos")
        found.append(rows)
        left -= n
    return _examples(reduce(DataFrame.unionByName, found)) if found else spark.createDataFrame([], EXAMPLE)


def training_text(rows: DataFrame, template: chat.ChatTemplate) -> DataFrame:
    """The ``text`` column a trainer reads: rendered conversations, or the text itself."""
    return rows.select(
        F.when(F.col("messages").isNotNull(), template.render(F.col("messages"))).otherwise(F.col("text")).alias("text")
    )


def training_frames(
    spark: SparkSession, directory: str, template: chat.ChatTemplate, eval_strategy: str = "steps"
) -> tuple[DataFrame, DataFrame | None]:
    """Train and eval texts; no eval frame when it is empty or evaluation is off."""
    train = training_text(read_split(spark, directory, TRAIN), template)
    if eval_strategy == "no":
        return train, None
    held_out = read_split(spark, directory, EVAL)
    return train, (None if held_out.isEmpty() else training_text(held_out, template))


def preview_text(spark: SparkSession, path: str, n: int = PREVIEW_EXAMPLES) -> str:
    """The first ``n`` stored examples in readable form.

    Part files are in order, so only the first ones are opened, one by one; the last of them is read whole.
    """
    head = read_examples(spark, path, n)
    shown = head.select(chat.render_preview(F.col("messages"), F.col("text")).alias("block"))
    blocks = [row.block for row in shown.collect()]  # n rows
    return "\n\n".join(f"===== Example {i} =====\n{block}" for i, block in enumerate(blocks, 1))


def write_json_file(spark: SparkSession, path: str, value: dict) -> None:
    files.write_small_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False))


@dataclass(frozen=True)
class PreparedDataset:
    directory: str
    info: DatasetInfo
    report: dict | None

    def examples(self, spark: SparkSession, split: str = TRAIN, limit: int | None = None) -> DataFrame:
        return read_split(spark, self.directory, split, limit)


def _read_json_file(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def open_prepared(spark: SparkSession, directory: str) -> PreparedDataset:
    """Metadata and full report of one dataset folder."""
    report = f"{directory}/{VALIDATION_FILE}"
    return PreparedDataset(
        directory,
        DatasetInfo.from_dict(_read_json_file(spark, f"{directory}/{INFO_FILE}")),
        _read_json_file(spark, report) if files.exists(spark, report) else None,
    )


def get_dataset(spark: SparkSession, root: str, dataset_id: str) -> PreparedDataset | None:
    directory = f"{root}/{dataset_id}"
    return open_prepared(spark, directory) if files.exists(spark, f"{directory}/{INFO_FILE}") else None


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """One row per readable dataset below ``root``, newest first, with a display ``label``."""
    if not any(files.exists(spark, f"{root}/{name}/{INFO_FILE}") for name in files.children(spark, root)):
        return spark.createDataFrame([], f"{INFO}, modified timestamp, label string")
    info = spark.read.schema(INFO).json(f"{root}/*/{INFO_FILE}", multiLine=True, mode="PERMISSIVE")
    label = F.concat(
        "name", F.lit(" · "), F.col("n_train").cast("string"), F.lit(" train ("), "task_format", F.lit(")")
    )
    placed = info.select("*", F.col("_metadata.file_modification_time").alias("modified"), label.alias("label"))
    return placed.where(F.col("dataset_id").isNotNull()).orderBy(F.desc("modified"), "dataset_id")


def dataset_rows(catalog_rows: DataFrame) -> DataFrame:
    """Display columns of the dataset list."""
    return catalog_rows.select("name", "task_format", "n_train", "n_eval", "dataset_id")
