"""Exact removal of repeated byte strings, by column-wise construction of a collection's Burrows-Wheeler transform.

Every byte covered by a string of ``length`` bytes that also starts earlier (in a smaller document id, or
earlier in the same document) is removed. Overlaps count, and strings are judged on the input.

1. Anchors. Each window of ``length`` bytes names one GRAM-byte string inside it, the one with the least hash
   (the leftmost of equals). Equal windows name the same string at the same place, so windows can only repeat
   where an anchor repeats. Anchors (not texts) are shuffled by hash; one anchor stands for some 40 bytes.
2. Segments. Around each repeated anchor the bytes of its windows are cut out and dealt by the anchor, so all
   occurrences of a window meet in one task and all windows start within ``length`` bytes of the anchor.
   Windows of very frequent anchors are dealt one by one by their own hash instead.
3. Column-wise construction. A task lays its segments out in columns relative to the anchor and inserts one
   symbol of every segment per round, from the last column to the first. The symbols standing before the
   sorted suffixes are the round's block of the Burrows-Wheeler transform; a stable distribution by them gives
   the next order, and the next common prefixes are range minima of the old ones plus one. Columns are
   read from, and blocks written to, sequential temporary files. The segments of a construction, its order and
   its prefixes are held in memory (COLLECTION segments and the last anchor's group bound them, not the files);
   no later step reads the blocks, and they are deleted with the construction. As suffixes
   of different columns can't hold equal windows, each column is a block of its own, and a round needn't pass
   over earlier blocks: the work is linear in the segments' bytes instead of quadratic in their length.
4. Runs of suffixes whose common prefix is at least ``length`` are equal windows; all but the earliest go.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrain.llm import words as W
from tunegrain.llm.shared import columns_of, drop_tables, materialize, split_by_membership
from tunegrain.session import bound_batches

LENGTH = 100
GRAM = 24
#: Windows of an anchor with more occurrences than this are dealt one by one.
FREQUENT = 4096
#: Segments that one construction takes at once (whole groups of an anchor are never parted).
COLLECTION = 1 << 14
#: Bytes of a text whose anchors are found at once; pieces overlap by one window.
PIECE = 1 << 19
#: Bits of a hash that hold its place within a piece; the bits above rank the hashes.
PLACE = 20
#: Stands for a null id.
LOWEST = -(2**63)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place, by doubling."""
    with np.errstate(over="ignore"):
        h, have, out, used = W.EXACT[data], 1, None, 0
        while True:
            if size & have:
                out = h if out is None else out[: len(h) - used] * W.U64(0xD6E8FEB86659FD93) + h[used:][: len(out) - used]
                used += have
                if used == size:
                    return W.mix(out[: len(data) - size + 1])
            h = h[:-have] * W.U64(2 * have * 0x9E3779B1 + 1) + h[have:]
            have *= 2


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    have, low = 1, values
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return low if have == width else np.minimum(low[: len(values) - width + 1], low[width - have :][: len(values) - width + 1])


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: hash and place of each anchor, and the first and last window that names it."""
    found: list[tuple[np.ndarray, ...]] = []
    for low in range(0, max(1, len(data) - length + 1), PIECE):
        piece = data[low : low + PIECE + length - 1]
        if len(piece) < length:
            break
        hashes = gram_hashes(piece, GRAM)
        key = (hashes >> W.U64(PLACE) << W.U64(PLACE)) | np.arange(len(hashes), dtype=W.U64)
        named = (sliding_minimum(key, length - GRAM + 1) & W.U64((1 << PLACE) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]]))
        last = np.concatenate([new[1:], [len(named)]]) - 1
        found.append((hashes[named[new]], named[new] + low, new + low, last + low))
    if not found:
        return np.zeros(0, dtype=W.U64), *(np.zeros(0, dtype=np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def text_key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = W.utf8(batch.column(column))
    for i in range(len(batch)):
        yield i, data[offsets[i] : offsets[i + 1]]


def key_of(text: Column) -> Column:
    """The text's key: 64 bits of its MD5."""
    half = [F.conv(F.substring(F.md5(text.cast("binary")), at, 8), 16, 10).cast("bigint") for at in (1, 9)]
    return F.shiftleft(half[0], 32).bitwiseOR(half[1])


_FACTS = "id bigint, n_bytes bigint, key bigint, sha string"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [x.tobytes() for _, x in _texts(batch, 1)]
        yield pa.record_batch(
            [batch.column(0).cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), batch.column(2), pa.array([hashlib.sha256(x).hexdigest() for x in raw])],
            names=["id", "n_bytes", "key", "sha"],
        )


_ANCHORED = "deal bigint, hash bigint, key bigint, place bigint, times int"


def _anchor_rows(length: int):
    """Anchors of each distinct text of a task. Of an anchor that a batch holds several times, one row goes
    to the anchor's group with the number of times; the others, known to repeat, are dealt out at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def rows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            h, place, key = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            h, place, key = h[order], place[order], key[order]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            starts = np.flatnonzero(new)
            times = np.where(new, np.repeat(np.diff(np.append(starts, len(h))), np.diff(np.append(starts, len(h)))), 0)
            deal = np.where(new, W.signed(h), W.signed(W.mix(h + place.astype(W.U64) + key.view(W.U64))))
            return pa.record_batch([pa.array(deal), pa.array(W.signed(h)), pa.array(key), pa.array(place), pa.array(times.astype(np.int32))], names=["deal", "hash", "key", "place", "times"])

        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            keys = np.asarray(batch.column(1))
            for i, data in _texts(batch, 0):
                if len(data) < length or (key := int(keys[i])) in seen:
                    continue
                seen.add(key)
                h, place, _lo, _hi = anchors(data, length)
                parts.append((h, place, np.full(len(h), key, dtype=np.int64)))
                held += len(h)
                if held >= 1 << 17:
                    yield rows(parts)
                    parts, held = [], 0
        if parts:
            yield rows(parts)

    return run


def _repeated(limit: int):
    """Of rows sorted by (deal, hash): those that repeat; ``frequent`` is null where the group can't tell.

    A group is held back until it ends or has more than ``limit`` members, so few rows are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _groups(batches, limit)

    return run


def _groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    kept: list[tuple] = []  # arrays of the last group so far
    total = 0
    flowing = False

    def give(parts: list[tuple], times: int) -> pa.RecordBatch | None:
        hash_, key, place = (np.concatenate([p[i] for p in parts]) for i in range(3))
        if times < 2 and len(hash_) < 2:
            return None
        frequent = pa.array(np.full(len(hash_), times > limit))
        return pa.record_batch([pa.array(hash_), pa.array(key), pa.array(place), frequent], names=["hash", "key", "place", "frequent"])

    for batch in batches:
        deal, hash_, key, place, times = (np.asarray(batch.column(i)) for i in range(5))
        loose = times == 0
        if loose.any():
            n = int(loose.sum())
            yield pa.record_batch([pa.array(hash_[loose]), pa.array(key[loose]), pa.array(place[loose]), pa.nulls(n, pa.bool_())], names=["hash", "key", "place", "frequent"])
            hash_, key, place, times = hash_[~loose], key[~loose], place[~loose], times[~loose]
        if not len(hash_):
            continue
        # Equal texts of several tasks stand together: each (hash, key, place) is one row, but what the others of
        # their batch have dealt out counts for each.
        again = np.zeros(len(hash_), dtype=bool)
        again[1:] = (hash_[1:] == hash_[:-1]) & (key[1:] == key[:-1]) & (place[1:] == place[:-1])
        if kept and kept[-1][0][-1] == hash_[0] and kept[-1][1][-1] == key[0] and kept[-1][2][-1] == place[0]:
            again[0] = True
        heads = np.flatnonzero(np.concatenate([[True], hash_[1:] != hash_[:-1]]))
        sums = np.add.reduceat(times.astype(np.int64) - again, heads)
        sizes = np.add.reduceat((~again).astype(np.int64), heads)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        same = bool(kept) and kept[-1][0][-1] == hash_[0]
        hash_, key, place = hash_[~again], key[~again], place[~again]
        if kept and not same:
            if not flowing and (out := give(kept, total)) is not None:
                yield out
            kept, total, flowing = [], 0, False
        first_end = ends[0]
        if first_end:
            kept.append((hash_[:first_end], key[:first_end], place[:first_end]))
        total += int(sums[0])
        if total > limit and (first_end or not flowing):
            flowing = True
            yield give(kept, total)
            kept = [tuple(x[-1:] for x in kept[-1])]
        if len(starts) == 1:
            continue
        if not flowing and (out := give(kept, total)) is not None:
            yield out
        inner = slice(first_end, starts[-1])
        if len(sizes) > 2:
            count = np.repeat(sums[1:-1], sizes[1:-1])
            rows = np.repeat(sizes[1:-1], sizes[1:-1])
            pick = (count > 1) | (rows > 1)
            yield pa.record_batch([pa.array(hash_[inner][pick]), pa.array(key[inner][pick]), pa.array(place[inner][pick]), pa.array(count[pick] > limit)], names=["hash", "key", "place", "frequent"])
        tail = slice(starts[-1], None)
        kept, total, flowing = [(hash_[tail], key[tail], place[tail])], int(sums[-1]), False
    if kept and not flowing and (out := give(kept, total)) is not None:
        yield out


_SEGMENTS = "deal bigint, id bigint, key bigint, place bigint, low bigint, bytes binary, gone_first bigint, gone_last bigint"


def _segments(length: int):
    """Of (id, text, places, key): the bytes around each repeated anchor; with ``gone_first`` set, windows already
    known to repeat an earlier one of the same batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = np.asarray(batch.column(0)), np.asarray(batch.column(3))
            listed = batch.column(2)
            out: list[tuple] = []
            held: dict[tuple[int, int, bytes], int] = {}

            def put(deal: int, doc: int, key: int, place: int, low: int, cut: bytes) -> None:
                """Equal segments of a batch go on once, with their earliest place."""
                name = (deal, place - low, cut)
                at = held.setdefault(name, len(out))
                if at == len(out):
                    out.append((deal, doc, key, place, low, cut, None, None))
                    return
                one, other = (doc, key, place, low), out[at][1:5]
                first, later = (one, other) if one[:3] < other[:3] else (other, one)
                out[at] = (deal, *first, cut, None, None)
                if first[:3] != later[:3]:
                    out.append((None, *later[:2], None, None, None, later[3], later[3] + len(cut) - length))

            for i, data in _texts(batch, 1):
                marks = np.frombuffer(listed[i].as_buffer(), dtype=">i8").astype(np.int64)
                places, frequent = marks >> 1, (marks & 1).astype(bool)
                h, place, lo, hi = anchors(data, length)
                at = np.searchsorted(places, place)
                at[at == len(places)] = 0
                hit = np.flatnonzero(places[at] == place)
                raw = data.tobytes()
                doc, key = int(ids[i]), int(keys[i])
                for j in hit.tolist():
                    low, high, p = int(lo[j]), int(hi[j]), int(place[j])
                    if frequent[at[j]]:
                        for s in range(low, high + 1):
                            window = raw[s : s + length]
                            put(text_key(window), doc, key, s, s, window)
                    else:
                        put(int(W.signed(h[j : j + 1])[0]), doc, key, p, low, raw[low : high + length])
                if len(out) > 1 << 13:
                    yield _rows(out, _SEGMENTS)
                    out, held = [], {}
            if out:
                yield _rows(out, _SEGMENTS)

    return run


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def column_wise(segments: list[bytes], left: np.ndarray, rank: np.ndarray, length: int = LENGTH, blocks=None) -> tuple[np.ndarray, np.ndarray]:
    """(segment, columns left of its anchor) of each window that an earlier equal one precedes.

    ``left[i]`` bytes of segment i stand left of its anchor; ``rank`` orders the segments' places.
    ``blocks``: a binary file that gets each round's symbols and common prefixes, in sorted order.
    """
    m = len(segments)
    sizes = np.fromiter(map(len, segments), dtype=np.int64, count=m)
    reach_left, reach_right = int(left.max()), int((sizes - left).max())
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as own:
        blocks = blocks or own
        # The collection, column after column from the right: what the rounds read in sequence.
        flat = np.frombuffer(b"".join(segments), dtype=np.uint8)
        begin = np.cumsum(sizes) - sizes + left
        for column in range(reach_right - 1, -reach_left - 1, -1):
            there = (column >= -left) & (column < sizes - left)
            symbols = np.zeros(m, dtype=np.uint8)
            symbols[there] = flat[begin[there] + column]
            columns.write(symbols.tobytes())
        del flat
        columns.seek(0)
        order = np.arange(m)
        prefix = np.zeros(m, dtype=np.uint8)  # common prefix with the suffix sorted just before, at most 255
        most = min(length, 255)
        gone_segment, gone_column = [], []
        for column in range(reach_right - 1, -reach_left - 1, -1):
            symbols = np.frombuffer(columns.read(m), dtype=np.uint8)[order]
            blocks.write(symbols.tobytes())
            blocks.write(prefix.tobytes())
            to = np.argsort(symbols, kind="stable")
            prefix = _next_prefixes(symbols, prefix, to, most)
            order = order[to]
            if column > 0:
                continue
            # Windows that start in this column and belong to their segment's anchor.
            d = -column
            own_window = (left[order] >= d) & (sizes[order] - left[order] + d >= length)
            group = np.cumsum(prefix < length)[own_window]
            if len(group):
                rows = order[own_window]
                starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                width = np.diff(np.append(starts, len(group)))
                first = np.repeat(np.minimum.reduceat(rank[rows], starts), width)
                gone = rows[rank[rows] > first]
                gone_segment.append(gone)
                gone_column.append(np.full(len(gone), d))
    if not gone_segment:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(gone_segment), np.concatenate(gone_column)


def _next_prefixes(symbols: np.ndarray, prefix: np.ndarray, to: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes after one more symbol: for neighbours with equal symbols, one plus the least common
    prefix between their old places; otherwise 0."""
    new = np.zeros(len(to), dtype=np.uint8)
    same = np.flatnonzero(symbols[to[1:]] == symbols[to[:-1]]) + 1
    if not len(same):
        return new
    low, high = to[same - 1] + 1, to[same]  # least of prefix[low..high]
    span = high - low + 1
    least = np.empty(len(same), dtype=np.uint8)
    level, table = 0, prefix
    want = np.frexp(span.astype(np.float64))[1] - 1
    by_level = np.argsort(want, kind="stable")
    bounds = np.searchsorted(want[by_level], np.arange(int(want.max()) + 2))
    while True:
        pick = by_level[bounds[level] : bounds[level + 1]]
        if len(pick):
            least[pick] = np.minimum(table[low[pick]], table[high[pick] - (1 << level) + 1])
        if level + 2 >= len(bounds):
            break
        table = np.minimum(table[: -(1 << level)], table[1 << level :])
        level += 1
    new[same] = np.minimum(least, most - 1) + 1
    return new


_GONE = "id bigint, key bigint, gone_first bigint, gone_last bigint"


def _construct(length: int):
    def solve(rows: list[tuple]) -> pa.RecordBatch:
        doc = np.array([r[1] for r in rows])
        key = np.array([r[2] for r in rows])
        place = np.array([r[3] for r in rows])
        low = np.array([r[4] for r in rows])
        pair = np.lexsort((place, key, doc))
        rank = np.empty(len(rows), dtype=np.int64)
        changed = np.ones(len(rows), dtype=np.int64)
        changed[1:] = (doc[pair][1:] != doc[pair][:-1]) | (key[pair][1:] != key[pair][:-1]) | (place[pair][1:] != place[pair][:-1])
        rank[pair] = np.cumsum(changed)
        segment, column = column_wise([r[5] for r in rows], place - low, rank, length)
        start = place[segment] - column
        order = np.lexsort((start, key[segment], doc[segment]))
        start, ids, keys = start[order], doc[segment][order], key[segment][order]
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (start[1:] != start[:-1] + 1)]) if len(ids) else np.zeros(0, dtype=bool)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(ids)) - 1 if len(heads) else heads
        return pa.record_batch([pa.array(ids[heads]), pa.array(keys[heads]), pa.array(start[heads]), pa.array(start[tails])], names=["id", "key", "gone_first", "gone_last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            for row in zip(*cols, strict=True):
                if len(rows) >= COLLECTION and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solve(rows)

    return run


def _apply(length: int):
    """Of (id, text, gaps, key): what is left, and the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, data in _texts(batch, 1):
                pairs = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=">i8").astype(np.int64)
                first, last = pairs[0::2], pairs[1::2] + length
                edge = np.zeros(len(data) + 1, dtype=np.int32)
                np.add.at(edge, first, 1)
                np.add.at(edge, last, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                left = data[~gone].tobytes()
                # A character that is only partly covered stays in the readable text.
                lead = np.flatnonzero((data & 0xC0) != 0x80)
                whole = np.repeat(np.logical_and.reduceat(gone, lead), np.diff(np.append(lead, len(data)))) if len(lead) else gone
                rows.append((batch.column(0)[i].as_py(), batch.column(3)[i].as_py(), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), data[~whole].tobytes().decode("utf-8", "replace")))
            names = ["id", "key", "n_removed", "n_spans", "sha", "kept"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.nulls(0, k) for k in kinds], names=names)

    return run


def dedup(documents: DataFrame, length: int = LENGTH, frequent: int = FREQUENT, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(facts, changed).

    ``facts``: per row ``id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``sha`` (SHA-256 of the
    remaining bytes). ``changed``: ``id`` (the least bigint for null), ``key`` (of the text before) and ``kept`` text of the texts that lose some but not all bytes, and of exact
    later copies (empty). In ``kept`` a character that is only partly covered stays whole; ``sha`` is over bytes.

    A null text is empty. Texts shorter than ``length`` keep all. Rows with a null id come before all others. Different
    texts under one id, or without one, are judged each by itself, in the order of their keys; the same text under the
    same id counts as one. An empty table gives empty results.
    Other columns are ignored.
    """
    docs = documents.select(F.coalesce(F.col(id_column).cast("bigint"), F.lit(LOWEST)).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    docs = bound_batches(docs.withColumn("key", key_of(F.col("text"))))
    facts = materialize(docs.mapInArrow(_facts, _FACTS), "text-facts")
    firsts = facts.where(F.col("n_bytes") >= length).groupBy("key").agg(F.min("id").alias("first"))

    anchored = docs.select("text", "key").mapInArrow(_anchor_rows(length), _ANCHORED).repartition("deal")
    repeated = anchored.sortWithinPartitions("deal", "hash", "key", "place").mapInArrow(_repeated(frequent), "hash bigint, key bigint, place bigint, frequent boolean")
    repeated = materialize(repeated, "anchors")
    often = repeated.where("frequent").select("hash").distinct().withColumn("often", F.lit(True))
    told = repeated.where("frequent is not null").unionByName(
        repeated.where("frequent is null").drop("frequent").join(often, "hash", "left").select("hash", "key", "place", F.coalesce("often", F.lit(False)).alias("frequent"))
    )
    mark = F.col("place") * 2 + F.col("frequent").cast("int")
    # Big-endian 8-byte cells: a sorted array of longs as one binary.
    packed = told.groupBy("key").agg(F.array_sort(F.collect_set(mark)).alias("marks"))
    packed = packed.join(firsts, "key").select(F.col("first").alias("id"), "key", _packed("marks").alias("places"))
    packed = materialize(packed, "places")

    maybe, _ = split_by_membership(docs, packed.select("key"), "key")
    cut = maybe.dropDuplicates(["id", "key"]).join(packed, ["id", "key"]).select("id", "text", "places", "key").mapInArrow(_segments(length), _SEGMENTS)
    cut = materialize(cut, "segments")
    met = cut.where("deal is not null").select("deal", "id", "key", "place", "low", "bytes").repartition("deal").sortWithinPartitions("deal")
    gone = met.mapInArrow(_construct(length), _GONE).unionByName(cut.where("gone_first is not null").select("id", "key", "gone_first", "gone_last"))
    gaps = gone.groupBy("id", "key").agg(F.collect_list(F.struct("gone_first", "gone_last")).alias("gaps"))
    gaps = gaps.select("id", "key", _packed(F.flatten(F.transform("gaps", lambda g: F.array(g.gone_first, g.gone_last)))).alias("gaps"))
    gaps = materialize(gaps, "gaps")

    maybe, _ = split_by_membership(docs, gaps.select("key"), "key")
    schema = "id bigint, key bigint, n_removed bigint, n_spans bigint, sha string, kept string"
    partly = maybe.dropDuplicates(["id", "key"]).join(gaps, ["id", "key"]).select("id", "text", "gaps", "key").mapInArrow(_apply(length), schema)
    partly = materialize(partly, "kept")
    drop_tables(repeated, packed, cut, gaps)

    joined = facts.join(firsts, "key", "left").join(partly.select("id", "key", "n_removed", "n_spans", F.col("sha").alias("left_sha")), ["id", "key"], "left")
    copy = F.col("first").isNotNull() & (F.col("id") > F.col("first"))
    whole = F.when(F.col("id") == LOWEST, F.lit(None)).otherwise(F.col("id"))
    told = joined.select(
        whole.alias("id"), "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("left_sha", "sha")).alias("sha"),
    )
    copies = facts.join(firsts, "key").where("id > first").select("id", "key", F.lit("").alias("kept")).distinct()
    return told, partly.select("id", "key", "kept").unionByName(copies)


def _packed(column) -> F.Column:
    """An array of longs as one binary of big-endian 8-byte cells."""
    column = F.col(column) if isinstance(column, str) else column
    cells = F.transform(column, lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.unhex(F.array_join(cells, ""))


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated bytes taken out of ``text`` (and ``n_chars``, if there, following).

    Texts of which nothing is left go; texts that were empty before stay. Needs ``doc_id`` and ``text``.
    """
    _, changed = dedup(documents, length)
    changed = materialize(changed.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("kept").alias("__kept")), "changed")
    told = documents.withColumn("__id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST))).withColumn("__key", key_of(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    maybe, rest = split_by_membership(told, changed.select("__key"), "__key")
    joined = maybe.join(changed, ["__id", "__key"], "left").where("__kept is null or __kept <> ''")
    joined = joined.withColumn("text", F.coalesce("__kept", "text"))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        joined = joined.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return joined.select(*columns_of(documents)).unionByName(rest.select(*columns_of(documents)))
