"""The paragraphs of text files, split at blank lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tunegrain.session import materialize
from tunegrain.sources import blocks
from tunegrain.sources.files import FileSet


class Cutter:
    """Cuts the paragraphs of a split.

    What a paragraph is doesn't depend on anything before it, so a split needs no state: what stands before its first
    blank line goes on from the split before, and what stands after its last one may go on, even if it is empty.
    """

    def __init__(self, fid: int, block: int, start: str | None):
        self.fid, self.block, self.seq = fid, block, 0
        self.from_before = block > 0
        self.pending: list[bytes] = []

    def _row(self, kind: int) -> tuple:
        self.seq += 1
        lead = b"\n" if kind == blocks.HEAD else b""
        text, self.pending = lead + b"\n".join(self.pending), []
        return kind, self.fid, self.block, self.seq - 1, None, None, None, text

    def feed(self, lines: list[bytes]) -> Iterator[tuple]:
        for piece in lines:
            # Line ends are \n, \r\n and \r.
            piece = piece.removesuffix(b"\r")
            for line in piece.split(b"\r") if b"\r" in piece else (piece,):
                if line:
                    self.pending.append(line)
                elif self.from_before:
                    self.from_before = False
                    yield self._row(blocks.HEAD)
                elif self.pending:
                    yield self._row(blocks.WHOLE)

    def end(self) -> Iterator[tuple]:
        yield self._row(blocks.HEAD if self.from_before else blocks.TAIL)


def cut(spark: SparkSession, files_: FileSet) -> DataFrame:
    """Rows of ``blocks.CUT`` for all files, stored."""
    with blocks.same_splits(spark):
        long, short = (blocks.splits(spark, files_, "\n", which) for which in (True, False))
        return materialize(blocks.walked(long, Cutter).unionByName(blocks.walked(short, Cutter)), "text")
