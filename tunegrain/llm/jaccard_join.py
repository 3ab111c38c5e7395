"""Near-duplicate documents by word-shingle Jaccard similarity: prefix join with adaptive multi-match prefixes.

A global token order puts rare shingles first. A document whose set has n shingles keeps its first
``n - ceil(t n) + l`` shingles in that order, its prefix at level l. Two sets with Jaccard >= t share
at least l of their level-l prefixes, so with levels l and m they share min(l, m) of the longer
prefixes. Each document takes the level at which its estimated cost is least: every level more
posts one shingle more, and needs one match more, so fewer candidates reach verification.

The order comes from a counting sketch of fixed size over the shingles of all documents. Any order
gives the same result; a good one keeps common lines and passages out of the prefixes.

Only connectivity is asked for, so groups are not expanded into pairs. First every posting list is
compared with its smallest member only. What then still lies in different components is compared pair by pair, if
a bound on what two sets can share admits it: every set has a bitmap of the parities of its shingles' hashes,
and two sets differ in at least as many shingles as their bitmaps differ in bits. The bound stands in the join
itself, so pairs beyond it are never made. A pair that shares many lists is made in the first of them, and again only
where a run of shared shingles has been broken off. No link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunegrain.llm import words as W
from tunegrain.llm.shared import columns_of, connected_components, drop_tables, materialize, release_shuffles, split_by_membership
from tunegrain.session import bound_batches

#: The sketch has 2 ** SKETCH_BITS counters at every input size.
SKETCH_BITS = 20
SKETCH_SLICES = 64
#: Parts of a posting list that is known to be long.
SALTS = 64
#: Bits of a set's parity bitmap.
BITS = 512
#: Sets that meet a list, or a hub, in one task.
PART = 2048
#: Lists of a set before one, in the order of their shingles, that tell whether two sets have met earlier.
BEFORE = 3
#: Rounds in which neighbours of lists with at least so many sets are compared before all pairs.
ROUNDS = 1
MANY = 16


@dataclass(frozen=True)
class Settings:
    """``percent``: least similarity in hundredths.

    ``post_cost`` and ``verify_cost``: relative cost of one posted shingle and of one candidate.
    ``heavy``: a posting list is split if its counter is above this and above 8 times the mean.
    """

    percent: int = 80
    post_cost: float = 1.0
    verify_cost: float = 0.001
    heavy: int = 5000


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, distinct shingles and where each row's begin, for slices of (id, text)."""
    data, offsets = W.utf8(batch.column(1))
    for low, high in W.slices(offsets):
        part = offsets[low : high + 1]
        yield low, high, *W.shingle_sets(data[part[0] : part[-1]], part - part[0])


def _keys(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Two 64-bit keys of each set, as columns: from sums of its shingles, mixed in two ways, and its size."""
    size = np.diff(first)
    out = np.empty((len(size), 2), dtype=W.U64)
    with np.errstate(over="ignore"):
        for i, salt in enumerate((0x5DEECE66D, 0xD1342543DE82EF95)):
            out[:, i] = W.mix(W.sums_by_row(W.mix(tokens ^ W.U64(salt)), first) + W.mix(size.astype(W.U64)))
    return out


def _binary(keys: np.ndarray) -> pa.Array:
    """Both keys of each row as 16 bytes."""
    return W.binaries(np.ascontiguousarray(keys).ravel(), 2 * np.arange(len(keys) + 1))


def _bitmaps(tokens: np.ndarray, first: np.ndarray) -> pa.Array:
    """Per set, the parities of how many of its shingles fall on each of BITS places, as longs."""
    parts = []
    for low in range(0, len(first) - 1, 256):
        row = first[low : low + 257]
        place = np.repeat(np.arange(len(row) - 1), np.diff(row)) * BITS + (tokens[row[0] : row[-1]] & W.U64(BITS - 1)).astype(np.int64)
        odd = (np.bincount(place, minlength=(len(row) - 1) * BITS) & 1).astype(np.uint8)
        parts.append(np.packbits(odd, bitorder="little").view(np.int64))
    words = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(first)) * (BITS // 64), pa.int32()), pa.array(words))


_SCAN = "kind int, id bigint, size bigint, key binary, part int, counts binary"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's size and key (kind 0); at the end this task's sketch in slices (kind 1)."""
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    held: list[np.ndarray] = []
    names = ["kind", "id", "size", "key", "part", "counts"]
    for batch in batches:
        ids = batch.column(0)
        for low, high, tokens, first in _sets(batch):
            held.append((tokens >> W.U64(64 - SKETCH_BITS)).astype(np.int32))
            if sum(map(len, held)) > len(sketch):
                sketch += np.bincount(np.concatenate(held), minlength=len(sketch))
                held = []
            n = high - low
            columns = [pa.array(np.zeros(n, np.int32)), ids.slice(low, n).cast(pa.int64()), pa.array(np.diff(first)), _binary(_keys(tokens, first))]
            yield pa.record_batch([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    if held:
        sketch += np.bincount(np.concatenate(held), minlength=len(sketch))
    if sketch.any():
        parts = [x.tobytes() for x in np.split(sketch, SKETCH_SLICES)]
        n = len(parts)
        columns = [pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
        yield pa.record_batch([*columns, pa.array(np.arange(n, dtype=np.int32)), pa.array(parts, pa.binary())], names=names)


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), dtype=np.int64) for x in table.column("counts"))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _sketch(scanned: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches, added in two steps; its size doesn't depend on the input."""
    slices = scanned.where("kind = 1").select("part", F.pmod(F.spark_partition_id(), F.lit(256)).alias("salt"), "counts")
    schema = "part int, salt int, counts binary"
    added = slices.groupBy("part", "salt").applyInArrow(_add, schema).groupBy("part").applyInArrow(_add, schema)
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    width = len(sketch) // SKETCH_SLICES
    for row in added.collect():  # SKETCH_SLICES rows
        sketch[row.part * width : (row.part + 1) * width] = np.frombuffer(row.counts, dtype=np.int64)
    return sketch


def _levels(counts: np.ndarray, sizes: np.ndarray, least: np.ndarray, first: np.ndarray, settings: Settings) -> np.ndarray:
    """The cheapest level of each row. ``counts``: estimated list lengths in token order, rarest first.

    Levels rise by about a third each time, until posting alone costs more than the best level found.
    """
    sums = np.concatenate([[0], np.cumsum(counts - 1)])
    best = np.full(len(sizes), np.inf)
    level = np.ones(len(sizes), dtype=np.int64)
    tried = 1
    rows = np.flatnonzero(sizes > 0)
    while len(rows):
        length = sizes[rows] - least[rows] + tried
        rows, length = rows[(least[rows] >= tried)], length[least[rows] >= tried]
        # A candidate must match one list besides the l - 1 longest; the lists rise, so those are the last.
        reached = sums[first[rows] + length - tried + 1] - sums[first[rows]]
        cost = settings.post_cost * length + settings.verify_cost * reached / tried
        better = cost < best[rows]
        best[rows[better]], level[rows[better]] = cost[better], tried
        tried += max(1, tried // 3)
        rows = rows[settings.post_cost * (sizes[rows] - least[rows] + tried) < best[rows]]
    return level


def _prefixes(tokens: np.ndarray, first: np.ndarray, sketch: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all sets, in their order: owner, token and counter of each shingle of its prefix, and each set's level."""
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    counts = sketch[tokens >> W.U64(64 - SKETCH_BITS)].astype(np.int64)
    order = np.lexsort((tokens, counts, owner))
    tokens, counts = tokens[order], counts[order]
    least = -(-settings.percent * sizes // 100)
    level = _levels(counts, sizes, least, first, settings)
    keep = np.arange(len(tokens)) - first[owner] < (sizes - least + level)[owner]
    return owner[keep], tokens[keep], counts[keep], level


def _post(sketch: np.ndarray, settings: Settings):
    sketch = np.minimum(sketch, 2**31 - 1).astype(np.int32)
    heavy = max(settings.heavy, 8 * float(sketch.mean(dtype=np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # keys this task has posted: equal sets of one task post once
        for batch in batches:
            for _low, _high, tokens, first in _sets(batch):
                keys = W.signed(_keys(tokens, first))
                fresh = np.zeros(len(keys), dtype=bool)
                for i in np.flatnonzero(np.diff(first)).tolist():
                    if (k := (int(keys[i, 0]), int(keys[i, 1]))) not in seen:
                        seen.add(k)
                        fresh[i] = True
                owner, tokens, counts, level = _prefixes(tokens, first, sketch, settings)
                keep = fresh[owner]
                owner, tokens, counts = owner[keep], tokens[keep], counts[keep]
                if not len(tokens):
                    continue
                key = keys[owner]
                salt = np.where(counts > heavy, (key[:, 0] & (SALTS - 1)) + 1, 0)
                yield pa.record_batch(
                    [pa.array(W.signed(tokens)), pa.array(salt.astype(np.int16)), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(level[owner].astype(np.int32))],
                    names=["token", "salt", "key", "check", "level"],
                )

    return run


def _emit_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _low, _high, tokens, first in _sets(batch):
            yield pa.record_batch([_binary(_keys(tokens, first)), pa.array(np.diff(first)), _bitmaps(tokens, first)], names=["key", "size", "bits"])


_LISTED = "kind int, token bigint, key binary, level int, leader binary, leader_level int"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by (token, part, key): those of lists with two or more sets (kind 0), with the list's leader.

    Split lists give all their postings, and each part's leader (kind 1). Only the last row is kept between batches.
    """
    last = None  # token and salt, leader's keys, leader's level, last keys, whether the leader has been given out
    for batch in batches:
        if not len(batch):
            continue
        token, salt, key, check, level = (np.asarray(batch.column(i)) for i in range(5))
        both = np.stack([key, check], axis=1)
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        same = np.zeros(len(token), dtype=bool)
        same[1:] = ~new[1:] & (both[1:] == both[:-1]).all(axis=1)
        carried = last is not None and last[0] == (token[0], salt[0])
        if carried:
            new[0] = False
            same[0] = (last[3] == both[0]).all()
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1  # -1: the group carried over
        lead_key, lead_level = (both[starts], level[starts]) if len(starts) else (both[:1], level[:1])
        lead_key, lead_level = lead_key[np.maximum(group, 0)], lead_level[np.maximum(group, 0)]
        if carried:
            lead_key[group < 0], lead_level[group < 0] = last[1], last[2]
        member = ~new & ~same
        has = np.zeros(len(starts), dtype=bool)
        has[group[member & (group >= 0)]] = True
        leads = np.zeros(len(token), dtype=bool)
        leads[starts] = has | (salt[starts] > 0)
        cols = []
        for mask, kind in ((member | leads, 0), (new & (salt > 0), 1)):
            cols.append((np.full(mask.sum(), kind, np.int32), token[mask], both[mask], level[mask], lead_key[mask], lead_level[mask]))
        if carried and not last[4] and (member & (group < 0)).any():
            cols.append((np.zeros(1, np.int32), token[:1], last[1][None], np.array([last[2]], np.int32), last[1][None], np.array([last[2]], np.int32)))
            last = (*last[:4], True)
        kind, token_, key_, level_, leader, leader_level = (np.concatenate(x) for x in zip(*cols))
        yield pa.record_batch([pa.array(kind), pa.array(token_), _binary(key_), pa.array(level_), _binary(leader), pa.array(leader_level)], names=["kind", "token", "key", "level", "leader", "leader_level"])
        given = bool(leads[starts[group[-1]]]) if group[-1] >= 0 else last[4]
        last = ((token[-1], salt[-1]), lead_key[-1].copy(), lead_level[-1], both[-1].copy(), given)


def _emit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _low, _high, tokens, first in _sets(batch):
            yield pa.record_batch([_binary(_keys(tokens, first)), W.binaries(tokens, first)], names=["key", "tokens"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by hub and part: the hub's own set first (without a member), then the members' sets."""
        at, hub = None, None
        for batch in batches:
            hubs, parts, members, sets = batch.column("hub").to_pylist(), batch.column("part").to_pylist(), batch.column("member").to_pylist(), batch.column("tokens")
            hits: list[int] = []
            for i, member in enumerate(members):
                mine = np.frombuffer(sets[i].as_buffer(), dtype=W.U64)
                if member is None:
                    # A copy, so that the batch can go.
                    at, hub = (hubs[i], parts[i]), mine.copy()
                elif (hubs[i], parts[i]) == at and 100 * min(len(mine), len(hub)) >= percent * max(len(mine), len(hub)):
                    short, long = (mine, hub) if len(mine) <= len(hub) else (hub, mine)
                    place = np.searchsorted(long, short)
                    shared = int((long[np.minimum(place, len(long) - 1)] == short).sum()) if len(long) else 0
                    if 100 * shared >= percent * (len(mine) + len(hub) - shared):
                        hits.append(i)
            yield pa.record_batch([batch.column("member").take(pa.array(hits, pa.int64())), batch.column("hub").take(pa.array(hits, pa.int64()))], names=["a", "b"])

    return run


def _may_reach(percent: int) -> str:
    """Whether sets ``one`` and ``two`` can be similar enough, by their sizes and by the bits in which their bitmaps differ."""
    apart = " + ".join(f"bit_count(one.bits[{i}] ^ two.bits[{i}])" for i in range(BITS // 64))
    both = "(one.size + two.size)"
    return f"100 * least(one.size, two.size) >= {percent} * greatest(one.size, two.size) and {100 + percent} * ({both} - ({apart})) >= {2 * percent} * {both}"


def _neighbours(rest: DataFrame, members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that stand side by side in a list, and may be similar enough."""
    shuffled = F.xxhash64("key", F.lit(turn))
    now = rest.join(members.select("key", "component"), "key").withColumn("part", F.pmod(shuffled, F.col("parts")))
    fields = F.struct("key", "component", "size", "bits")
    beside = F.lag(fields).over(Window.partitionBy("token", "part").orderBy(shuffled, "key"))
    stood = now.select(fields.alias("one"), beside.alias("two")).where(f"two is not null and one.component <> two.component and {_may_reach(percent)}")
    return stood.select(F.least("one.key", "two.key").alias("a"), F.greatest("one.key", "two.key").alias("b")).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) of set keys whose sets are similar enough, by exact set intersection.

    A task takes a hub's set (b) once and passes the sets of its members (a) by it; a hub of many members has several parts.
    """
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = materialize(keys.join(reps, "key").select("id"), "wanted")
    maybe, _ = split_by_membership(docs, wanted, "id")
    sets = maybe.mapInArrow(_emit_sets, "key binary, tokens binary")
    sets = materialize(sets.groupBy("key").agg(F.first("tokens").alias("tokens")), "sets")
    drop_tables(wanted)
    hubs = materialize(pairs.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "hubs")
    heads = hubs.join(sets.withColumnRenamed("key", "hub"), "hub")
    heads = heads.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("member"), "tokens")
    members = pairs.select(F.col("a").alias("member"), F.col("b").alias("hub")).join(hubs, "hub")
    members = members.withColumn("part", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int"))
    members = members.join(sets.withColumnRenamed("key", "member"), "member").select("hub", "part", "member", "tokens")
    dealt = heads.unionByName(members).repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("member"))
    links = materialize(dealt.mapInArrow(_verify(settings.percent), "a binary, b binary"), "links")
    drop_tables(sets, hubs)
    release_shuffles(docs.sparkSession)
    return links


def join(documents: DataFrame, settings: Settings = Settings(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document ``id``, ``size`` (distinct shingles) and ``component`` (smallest id reachable by links).

    A null or wordless text has size 0 and is a component of its own; so is each row with a null id, whose
    component is null. Rows that repeat an id each get a row. Texts with fewer words than a shingle have one
    shingle of all their words. Very long texts are read whole. An empty table gives an empty result. Other
    columns are ignored.
    """
    docs = bound_batches(documents.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text")))
    scanned = materialize(docs.mapInArrow(_scan, _SCAN), "sets-scan")
    rows = scanned.where("kind = 0").select("id", "size", "key")
    reps = rows.where("size > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("size").alias("size")).where("id is not null")
    sketch = _sketch(scanned)
    posted = docs.where("id is not null").mapInArrow(_post(sketch, settings), "token bigint, salt smallint, key bigint, check bigint, level int")
    lists = posted.repartition("token", "salt").sortWithinPartitions("token", "salt", "key", "check")
    listed = materialize(lists.mapInArrow(_lists, _LISTED), "lists")
    release_shuffles(docs.sparkSession)

    postings = listed.where("kind = 0")
    stars = postings.where("key <> leader").select("key", "leader", F.least("level", "leader_level").alias("need"))
    parts = listed.where("kind = 1").select("token", "key", "level")
    tops = parts.groupBy("token").agg(F.min(F.struct("key", "level")).alias("top"))
    across = parts.join(tops, "token").where("key <> top.key").select("key", F.col("top.key").alias("leader"), F.least("level", "top.level").alias("need"))
    enough = F.count("*") >= F.max("need")
    pairs = stars.unionByName(across).groupBy("key", "leader").agg(enough.alias("enough")).where("enough")
    pairs = materialize(pairs.select(F.col("key").alias("a"), F.col("leader").alias("b")), "stars")
    links = _verified(pairs, docs, reps, settings)
    parents = materialize(connected_components(links), "merged")

    # What lies in one component by now needs no more comparison; lists that reach several do.
    labelled = postings.select("token", "key", "level").join(parents.withColumnRenamed("node", "key"), "key", "left")
    labelled = materialize(labelled.withColumn("component", F.coalesce("component", "key")), "labelled")
    mixed = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = materialize(mixed.select("token", "n", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "mixed-lists")
    light = labelled.join(mixed, "token").select("token", "n", "parts", "key", "component")
    members = materialize(light.select("key", "component").distinct().join(reps.select("key", "id"), "key"), "mixed-members")
    again, _ = split_by_membership(docs.where("id is not null"), members.select("id"), "id")
    bitmaps = again.mapInArrow(_emit_bitmaps, "key binary, size bigint, bits array<bigint>").join(members.select("key"), "key", "left_semi")
    bitmaps = bitmaps.dropDuplicates(["key"])
    # In any order of shingles that holds for all sets, a pair that shares several lists meets first in one of them.
    lists_of = Window.partitionBy("key").orderBy("token")
    before = F.array_compact(F.array(*[F.lag("token", i + 1).over(lists_of) for i in range(BEFORE)]))
    rest = light.select("key", "token", "n", "parts", before.alias("before")).join(bitmaps, "key")
    rest = materialize(rest, "mixed")
    drop_tables(listed, labelled)
    release_shuffles(docs.sparkSession)
    links_found = []
    for turn in range(ROUNDS):
        # Neighbours in an order that changes with the rounds: as many pairs as postings, which join what is dense.
        near = materialize(_neighbours(rest.where(F.col("n") >= MANY), members, turn, settings.percent).join(pairs, ["a", "b"], "left_anti"), "neighbours")
        links_found.append(_verified(near, docs, reps, settings))
        drop_tables(near)
        label = members.select("key", "component")
        contracted = links_found[-1].join(label.toDF("a", "ca"), "a").join(label.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = connected_components(contracted).withColumnRenamed("component", "top")
        before = members
        joined = members.join(merged, F.col("component") == F.col("node"), "left")
        members = materialize(joined.select("key", "id", F.coalesce("top", "component").alias("component")), "mixed-members")
        drop_tables(before)
    # What is still apart is compared in all pairs. Sets that share one of the lists right before have met there.
    now = rest.join(members.select("key", "component"), "key").select("token", "parts", "key", "component", "size", "before", "bits")
    fits = f"one.token = two.token and one.key < two.key and one.component <> two.component and {_may_reach(settings.percent)} and not arrays_overlap(one.before, two.before)"
    ends = (F.col("one.key").alias("a"), F.col("two.key").alias("b"))
    short = now.where("parts = 1").drop("parts")
    cross = short.alias("one").join(short.alias("two"), F.expr(fits)).select(*ends)
    # One side of a long list is dealt out, the other stands with each part.
    long = now.where("parts > 1")
    one = long.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).alias("one")
    two = long.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("two")
    cross = cross.unionByName(one.join(two, F.expr(f"one.part = two.part and {fits}")).select(*ends)).distinct()
    cross = materialize(cross.join(pairs, ["a", "b"], "left_anti"), "cross")
    release_shuffles(docs.sparkSession)
    more = _verified(cross, docs, reps, settings)
    # Only links between components are new, so the old components are contracted to their labels.
    parents_of = F.coalesce("component", "key").alias("label")
    found = parents
    contracted = (
        reduce(DataFrame.unionByName, links_found, more)
        .join(parents.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(parents.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    upper = connected_components(contracted).select(F.col("node").alias("label"), F.col("component").alias("top"))
    labels = reps.join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "id", parents_of)
    labels = labels.join(upper, "label", "left").select("key", "id", F.coalesce("top", "label").alias("label"))
    smallest = labels.groupBy("label").agg(F.min("id").alias("component"))
    components = materialize(labels.join(smallest, "label").select("key", "component"), "components")
    drop_tables(pairs, links, parents, mixed, members, rest, cross, more, *links_found)
    return rows.join(components, "key", "left").select(
        "id", "size", F.when(F.col("size") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id")).alias("component")
    )


def keep_first(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents, with one of each group of near duplicates: the smallest doc_id. Rows with a null doc_id stay."""
    found = join(documents, settings)
    gone = materialize(found.where("id <> component").select(F.col("id").alias("doc_id")).distinct(), "near-copies")
    maybe, rest = split_by_membership(documents, gone, "doc_id")
    return maybe.join(gone, "doc_id", "left_anti").select(*columns_of(documents)).unionByName(rest)
