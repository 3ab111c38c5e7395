"""File listings and small file access through the session's own file systems."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FileSet:
    """Files of one format: a folder searched with a name pattern, or explicit paths.

    ``fmt`` is the extension that names the format; ``any_name`` takes every file of the folder.
    """

    paths: Sequence[str]
    fmt: str
    recursive: bool
    any_name: bool = False
    #: URIs of files in the caller's order; other files follow by name.
    order: tuple[str, ...] = ()

    def options(self) -> dict[str, str]:
        if not self.recursive:
            return {}
        either_case = "".join(f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ch for ch in self.fmt)
        return {"recursiveFileLookup": "true", "pathGlobFilter": "*" if self.any_name else f"*{either_case}"}

    def listing(self, spark: SparkSession) -> DataFrame:
        """``file`` (its URI), ``path, name, length, modified``; contents are not read."""
        return list_files(spark, self.paths, **self.options())

    def places(self, spark: SparkSession) -> DataFrame:
        """``_file`` (its number), ``rank``, ``file``: where each file stands among all."""
        found = self.listing(spark).select(file_id(F.col("file")).alias("_file"), plain_uri(F.col("file")).alias("file"))
        if not self.order:
            return found.select("_file", F.lit(0).alias("rank"), "file")
        # As long as the caller's own list.
        ranks = spark.createDataFrame([(uri, i) for i, uri in enumerate(dict.fromkeys(self.order))], "file string, rank int")
        return found.join(ranks, "file", "left").select("_file", F.coalesce("rank", F.lit(len(self.order))).alias("rank"), "file")


def plain_uri(path: Column) -> Column:
    """Local files are reported with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def file_id(path: Column) -> Column:
    """A number that stands for a file in rows; ``loading`` makes sure that no two files of a load share one."""
    return F.xxhash64(plain_uri(path))


def list_files(spark: SparkSession, paths: Sequence[str], **options: str) -> DataFrame:
    found = spark.read.format("binaryFile").options(**options).load(list(paths))
    return found.select(
        F.col("_metadata.file_path").alias("file"),
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "length",
        F.col("modificationTime").alias("modified"),
    )


def suffix_of(path: F.Column) -> F.Column:
    """Lower-case extension with its dot; empty when the name has none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def qualified(spark: SparkSession, path: str) -> str:
    """Full URI of a path, as Spark reports it for scanned files."""
    fs, p = _hadoop(spark, path)
    return fs.makeQualified(p).toString()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder; none when it does not exist."""
    fs, p = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def replace_folder(spark: SparkSession, source: str, target: str) -> None:
    """Give a folder another name, in place of what had it; nothing happens when there is no such folder."""
    fs, old = _hadoop(spark, source)
    _, new = _hadoop(spark, target)
    fs.delete(new, True)
    if fs.exists(old):
        fs.mkdirs(new.getParent())
        fs.rename(old, new)


def write_small_text(spark: SparkSession, path: str, text: str) -> None:
    """One small metadata file (a few kilobytes), replacing an older one."""
    fs, p = _hadoop(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
