"""The records of JSON documents, found by a structural index of their bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunegrain.session import materialize
from tunegrain.sources import blocks
from tunegrain.sources.files import FileSet

#: Pieces of a scan end at commas: every document has many, and no escape crosses one.
SEPARATOR = b","

_QUOTE, _BACKSLASH, _COMMA, _OPEN_LIST, _CLOSE_LIST = b'"\\,[]'
_STEP = np.zeros(256, dtype=np.int64)
_STEP[list(b"[{")] = 1
_STEP[list(b"]}")] = -1
_STRUCTURAL = _STEP != 0
_STRUCTURAL[_COMMA] = True
_BLANK = b" \t\r\n"


def structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of brackets and commas, whether each is within a string, and whether the end is.

    ``inside``: whether the first byte is within a string. A quote after an odd run of backslashes is part of a string.
    """
    quote = data == _QUOTE
    slash = np.flatnonzero(data == _BACKSLASH)
    if len(slash):
        at = np.flatnonzero(quote)
        # How many backslashes stand right before each quote: the length of the run that ends there.
        ends = np.flatnonzero(np.concatenate([np.diff(slash) != 1, [True]]))
        starts = np.concatenate([[0], ends[:-1] + 1])
        run_end, run_size = slash[ends], ends - starts + 1
        run = np.searchsorted(run_end, at - 1)
        hit = (run < len(run_end)) & (run_end[np.minimum(run, len(run_end) - 1)] == at - 1)
        quote[at[hit & (run_size[np.minimum(run, len(run_end) - 1)] % 2 == 1)]] = False
    within = np.bitwise_xor.accumulate(quote.view(np.uint8)) ^ np.uint8(inside) if len(data) else quote.view(np.uint8)
    places = np.flatnonzero(_STRUCTURAL[data])
    return places, within[places] != 0, bool(within[-1]) if len(data) else inside


class _Pieces:
    """The bytes of a split, separators put back: each piece but a file's first has one before it."""

    def __init__(self, fid: int, block: int):
        self.fid, self.block = fid, block
        self.begun = block > 0

    def joined(self, pieces: list[bytes]) -> bytes:
        lead = SEPARATOR if self.begun else b""
        self.begun = True
        return lead + SEPARATOR.join(pieces)


class Sums(_Pieces):
    """What a split does to the depth, if it begins outside of a string and if it begins inside of one."""

    NAMES = ("fid", "block", "flips", "out_depth", "in_depth", "out_low", "in_low", "top")
    KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    SCHEMA = "fid bigint, block bigint, flips int, out_depth bigint, in_depth bigint, out_low bigint, in_low bigint, top string"

    def __init__(self, fid: int, block: int, start: str | None):
        super().__init__(fid, block)
        self.within, self.depth, self.low, self.top = False, [0, 0], [0, 0], None

    def feed(self, pieces: list[bytes]) -> Iterator[tuple]:
        text = self.joined(pieces)
        if self.top is None and (first := text.lstrip(_BLANK)[:1]):
            self.top = first.decode("latin-1")
        data = np.frombuffer(text, dtype=np.uint8)
        places, within, self.within = structure(data, self.within)
        step = _STEP[data[places]]
        for i, mine in enumerate((step * ~within, step * within)):
            if len(mine):
                depth = self.depth[i] + np.cumsum(mine)
                self.depth[i], self.low[i] = int(depth[-1]), min(self.low[i], int(depth.min()))
        return iter(())

    def end(self) -> Iterator[tuple]:
        yield self.fid, self.block, int(self.within), *self.depth, *self.low, self.top


class Cutter(_Pieces):
    """Cuts the elements of a document's lists of records.

    A list of records is the document itself, or one that stands under one of ``keys`` in the document. Of each list the
    elements are cut out, and a mark says where it begins; everything else is text around them.
    """

    def __init__(self, keys: tuple[str, ...], fid: int, block: int, start: str | None, only_lists: bool = False):
        super().__init__(fid, block)
        self.member = re.compile(rb'\s*"(' + "|".join(keys).encode() + rb')"\s*:\s*')
        self.keys = [k.encode() for k in keys]
        self.within, self.depth, self.top = False, 0, None
        self.list: tuple[int, int, int] | None = None  # key's place, block and offset of the list
        if start is not None:
            state = [int(x) if x else None for x in start.split(",")]
            self.within, self.depth, self.top = bool(state[0]), state[1], chr(state[2])
            self.list = tuple(state[3:6]) if state[3] is not None else None
        self.offset, self.seq = 0, 0
        self.pending: list[bytes] = []
        self.from_before, self.first = self.list is not None, False
        self.only_lists = only_lists

    def _row(self, kind: int, text: bytes) -> tuple:
        self.seq += 1
        tag, home, spot = self.list or (None, None, None)
        return kind, self.fid, self.block, self.seq - 1, tag, home, spot, text

    def _opens(self, text: bytes, places: np.ndarray, sign: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int]]:
        """Places of lists of records, and their keys' places (-1: the document itself)."""
        if self.top == "[":
            for i in np.flatnonzero((sign == _OPEN_LIST) & (before == 0)).tolist():
                yield int(places[i]), -1
        elif self.top == "{":
            for i in np.flatnonzero((sign == _OPEN_LIST) & (before == 1)).tolist():
                begin = int(places[i - 1]) + 1 if i else 0
                if found := self.member.fullmatch(text, begin, int(places[i])):
                    yield int(places[i]), self.keys.index(found[1])

    def feed(self, pieces: list[bytes]) -> Iterator[tuple]:
        text = self.joined(pieces)
        if self.top is None and (first := text.lstrip(_BLANK)[:1]):
            self.top = first.decode("latin-1")
        data = np.frombuffer(text, dtype=np.uint8)
        places, within, self.within = structure(data, self.within)
        places = places[~within]
        sign = data[places]
        after = self.depth + np.cumsum(_STEP[sign])
        opens = list(self._opens(text, places, sign, after - _STEP[sign]))
        at = 0
        while True:
            if self.list is None:
                begin, key = next(((p, k) for p, k in opens if p >= at), (None, None))
                if begin is None:
                    if not self.only_lists and at < len(text):
                        yield self._row(blocks.AROUND, text[at:])
                    break
                if not self.only_lists:
                    yield self._row(blocks.AROUND, text[at : begin + 1])
                self.list, self.first = (key, self.block, self.offset + begin), True
                yield self._row(blocks.MARK, None)
                at = begin + 1
            inner = 1 if self.list[0] < 0 else 2
            low = np.searchsorted(places, at)
            closing = np.flatnonzero((sign[low:] == _CLOSE_LIST) & (after[low:] == inner - 1))
            high = low + int(closing[0]) if len(closing) else len(places)
            if not self.only_lists:
                cuts = places[low:high][(sign[low:high] == _COMMA) & (after[low:high] == inner)].tolist()
                for cut in cuts:
                    yield self._element(text[at:cut])
                    at = cut + 1
                if high == len(places):
                    self.pending.append(text[at:])
                elif not self.first or self.pending or text[at : int(places[high])].strip(_BLANK):
                    yield self._element(text[at : int(places[high])])
            if high == len(places):
                break
            at, self.list = int(places[high]), None
        self.depth = int(after[-1]) if len(after) else self.depth
        self.offset += len(text)

    def _element(self, text: bytes) -> tuple:
        whole = b"".join([*self.pending, text])
        kind = blocks.HEAD if self.from_before else blocks.WHOLE
        self.pending, self.first, self.from_before = [], False, False
        return self._row(kind, whole)

    def end(self) -> Iterator[tuple]:
        if self.list is not None and not self.only_lists:
            yield self._row(blocks.HEAD if self.from_before else blocks.TAIL, b"".join(self.pending))
        elif self.list is not None:
            # The list that is still open where the split ends.
            yield self._row(blocks.TAIL, None)


def _starts(long: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The state in which each split of the long files begins, but for the first of a file."""
    sums = materialize(blocks.walked(long, Sums, Sums.SCHEMA, Sums.KINDS, Sums.NAMES), "json-sums")
    ordered = Window.partitionBy("fid").orderBy("block")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2
    sums = sums.withColumn("within", within)
    mine = lambda name: F.when(F.col("within") == 0, F.col(f"out_{name}")).otherwise(F.col(f"in_{name}"))
    sums = sums.withColumns({"change": mine("depth"), "least": mine("low")})
    sums = sums.withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    top = F.first("top", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    state = sums.select("fid", "block", "within", "depth", (F.col("depth") + F.col("least")).alias("lowest"), F.ascii(top).alias("top"))
    state = materialize(state, "json-states")
    plain = F.concat_ws(",", "within", "depth", "top")
    starts = state.where("block > 0").select("fid", "block", F.concat(plain, F.lit(",,,")).alias("start"))
    # Lists that are open where a split ends; a list in an object is left where the depth falls below two.
    lists = blocks.walked(blocks.with_starts(long, starts), lambda *split: Cutter(keys, *split, only_lists=True))
    lists = lists.where(F.col("kind") == blocks.TAIL).where("home = block").select("fid", "block", F.struct("tag", "home", "spot").alias("list"))
    marked = state.join(lists, ["fid", "block"], "left")
    none = F.struct(F.lit(None).cast("int").alias("tag"), F.lit(None).cast("bigint").alias("home"), F.lit(None).cast("bigint").alias("spot"))
    floor = F.when(F.chr(F.col("top")) == "[", 1).otherwise(2)
    marker = F.when(F.col("list").isNotNull(), F.col("list")).when(F.col("lowest") < floor, none)
    known = marked.withColumn("now", F.last(marker, ignorenulls=True).over(before)).where("block > 0")
    number = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    start = F.concat_ws(",", plain, number(F.col("now.tag")), number(F.col("now.home")), number(F.col("now.spot")))
    return materialize(known.select("fid", "block", start.alias("start")), "json-starts")


def cut(spark: SparkSession, files_: FileSet, keys: tuple[str, ...]) -> DataFrame:
    """Rows of ``blocks.CUT`` for all documents, stored."""
    comma = SEPARATOR.decode()
    with blocks.same_splits(spark):
        long, short = (blocks.splits(spark, files_, comma, which) for which in (True, False))
        known = blocks.with_starts(long, _starts(long, keys))
        cutter = lambda *split: Cutter(keys, *split)
        return materialize(blocks.walked(known, cutter).unionByName(blocks.walked(short, cutter)), "json")
