"""The records of delimited files: lines put together where a quoted cell goes on over a line's end."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunegrain.session import materialize
from tunegrain.sources import blocks
from tunegrain.sources.files import FileSet

QUOTE = b'"'
_MARK = b"\xef\xbb\xbf"


def sniff_separator(header: str) -> str:
    """Delimiter of a CSV header; a comma when none is evident."""
    try:
        found = csv.Sniffer().sniff(header).delimiter
    except csv.Error:
        return ","
    return "," if found.isalnum() or found in "_\"'\r\n" else found


def header_cells(header: str, sep: str) -> list[str]:
    csv.field_size_limit(max(csv.field_size_limit(), len(header) + 1))
    return next(csv.reader(io.StringIO(header.rstrip("\r\n"), newline=""), delimiter=sep), [])


def quoted_after(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted cell goes on after the line. A quote opens at a cell's start only, and two stand for one."""
    at = 0
    while True:
        if inside:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == QUOTE:
                at += 2
                continue
            inside = False
        elif line[at : at + 1] == QUOTE:
            inside = True
            at += 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _first_record(lines: list[bytes], sep: str | None) -> int:
    """How many of the lines make up the first record; 0 if it goes on after them."""
    by = (sep or sniff_separator(lines[0].decode("utf-8", "replace") + "\n")).encode() if lines else b""
    inside = False
    for n, line in enumerate(lines):
        inside = quoted_after(line, inside, by)
        if not inside:
            return n + 1
    return 0


class _Lines:
    """A walker over lines; of a file's first split it knows the header, and with it the separator."""

    def __init__(self, sep: str | None, fid: int, block: int, start: str | None):
        self.given, self.fid, self.block = sep, fid, block
        self.inside, self.sep = False, sep.encode() if sep else b""
        if start is not None:
            inside, code = start.split(",")
            self.inside, self.sep = inside == "1", chr(int(code)).encode()
        self.head: list[bytes] | None = [] if block == 0 else None
        self.seq = 0

    def _row(self, kind: int, text: bytes) -> tuple:
        self.seq += 1
        return kind, self.fid, self.block, self.seq - 1, ord(self.sep.decode() or "\0"), None, None, text

    def _headed(self, lines: list[bytes]) -> tuple[list[tuple], list[bytes]]:
        """The header as a mark, once it is whole, and the lines after it."""
        if not self.head:
            lines = [lines[0].removeprefix(_MARK), *lines[1:]] if self.seq == 0 and lines else lines
            skip = next((n for n, line in enumerate(lines) if line.strip()), len(lines))
            lines = lines[skip:]
        self.head += lines
        size = _first_record(self.head, self.given)
        if not size:
            return [], []
        header = b"\n".join(self.head[:size])
        self.sep = (self.given or sniff_separator(header.decode("utf-8", "replace") + "\n")).encode()
        rest, self.head = self.head[size:], None
        return [self._row(blocks.MARK, header)], rest


class Heads(_Lines):
    """The header of a file, from its first split."""

    def feed(self, lines: list[bytes]) -> Iterator[tuple]:
        if self.head is not None:
            yield from self._headed(lines)[0]

    def end(self) -> Iterator[tuple]:
        if self.head:
            yield self._row(blocks.MARK, b"\n".join(self.head))


class Ends(_Lines):
    """Whether a split ends within a quoted cell, if it begins outside of one, and if it begins inside of one."""

    NAMES = ("fid", "block", "from_out", "from_in")
    KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    SCHEMA = "fid bigint, block bigint, from_out int, from_in int"

    def __init__(self, fid: int, block: int, start: str | None):
        super().__init__(None, fid, block, start)
        self.states = [False, True]

    def feed(self, lines: list[bytes]) -> Iterator[tuple]:
        for line in lines:
            if QUOTE in line:
                self.states = [quoted_after(line, s, self.sep) for s in self.states]
        return iter(())

    def end(self) -> Iterator[tuple]:
        yield self.fid, self.block, *map(int, self.states)


class Cutter(_Lines):
    """Cuts the records of a split; the header is a mark."""

    def __init__(self, sep: str | None, fid: int, block: int, start: str | None):
        super().__init__(sep, fid, block, start)
        self.from_before, self.pending = self.inside, []

    def feed(self, lines: list[bytes]) -> Iterator[tuple]:
        if self.head is not None:
            marks, lines = self._headed(lines)
            yield from marks
        for line in lines:
            if self.inside or QUOTE in line:
                self.inside = quoted_after(line, self.inside, self.sep)
            self.pending.append(line)
            if not self.inside:
                yield from self._ended()

    def _ended(self) -> Iterator[tuple]:
        text = b"\n".join(self.pending)
        if self.from_before:
            # The line's end before it belongs to the cell.
            yield self._row(blocks.HEAD, b"\n" + text)
        elif text.strip(b"\r\n"):
            yield self._row(blocks.WHOLE, text)
        self.from_before, self.pending = False, []

    def end(self) -> Iterator[tuple]:
        if self.head:
            yield self._row(blocks.MARK, b"\n".join(self.head))
        if self.pending:
            text = b"\n".join(self.pending)
            yield self._row(blocks.HEAD, b"\n" + text) if self.from_before else self._row(blocks.TAIL, text)


def _starts(long: DataFrame, sep: str | None) -> DataFrame:
    """Whether each split of the long files begins within a quoted cell, and the file's separator."""
    heads = blocks.walked(long.where("block = 0"), lambda *split: Heads(sep, *split))
    # One row for each file that is long enough to be split.
    heads = materialize(heads.select("fid", F.col("tag").cast("string").alias("code")), "csv-heads")
    headed = long.join(F.broadcast(heads.select("fid", F.concat(F.lit("0,"), "code").alias("start"))), "fid")
    ends = blocks.walked(headed.select("fid", "block", "value", "start"), Ends, Ends.SCHEMA, Ends.KINDS, Ends.NAMES)
    ends = materialize(ends, "csv-ends").join(heads, "fid")
    # A split either settles the state, keeps it or turns it: what counts is the last that settles it, and the turns since.
    before = Window.partitionBy("fid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    turns = F.sum(F.when((F.col("from_out") == 1) & (F.col("from_in") == 0), 1).otherwise(0))
    counted = ends.withColumns({"turned": turns.over(upto), "turned_before": F.coalesce(turns.over(before), F.lit(0))})
    settled = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").alias("state"), F.col("turned").alias("turns")))
    counted = counted.withColumn("last", F.last(settled, ignorenulls=True).over(before))
    state = (F.coalesce(F.col("last.state"), F.lit(0)) + F.col("turned_before") - F.coalesce(F.col("last.turns"), F.lit(0))) % 2
    return materialize(counted.where("block > 0").select("fid", "block", F.concat_ws(",", state.cast("int"), "code").alias("start")), "csv-starts")


def cut(spark: SparkSession, files_: FileSet, sep: str | None) -> DataFrame:
    """Rows of ``blocks.CUT`` for all files, stored; headers are marks, and ``tag`` is the separator's code."""
    with blocks.same_splits(spark):
        long, short = (blocks.splits(spark, files_, "\n", which) for which in (True, False))
        known = blocks.with_starts(long, _starts(long, sep))
        cutter = lambda *split: Cutter(sep, *split)
        return materialize(blocks.walked(known, cutter).unionByName(blocks.walked(short, cutter)), "delimited")
