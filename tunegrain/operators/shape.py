"""Sequence shaping: truncation, packing, length grouping, step planning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrain.functions.text import CHARS_PER_TOKEN
from tunegrain.operators.split import split_key

#: Hex digits of the split key that name a shard; 2 make 256 shards, so as many tasks can pack.
SHARD_DIGITS = 2


def truncate(text: Column, max_seq_length: int) -> Column:
    """Keep as many characters as ``max_seq_length`` estimated tokens cover."""
    return F.substring(text, 1, max_seq_length * CHARS_PER_TOKEN)


def length_bucket(tokens: Column) -> Column:
    """Power-of-two length class: 0 for one token, 1 for 2-3, 2 for 4-7, ..."""
    # Bit length of the number; exact, where log2 of a double is not.
    return F.length(F.bin(tokens.cast("bigint"))) - 1


def group_by_length(df: DataFrame, tokens: str = "tokens", row_id: str = "row_id", partitions: int | None = None) -> DataFrame:
    """Lay rows of like length next to each other.

    The range boundaries include the row id, so a length shared by many rows is still cut
    into several partitions.
    """
    keys = [F.col(tokens), F.col(row_id)]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def _pack_sorted(max_seq_length: int):
    """Greedy packing over batches that arrive in (shard, key) order; keeps one open pack."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, pack, filled = None, 0, 0
        for batch in batches:
            packs, starts = [], []
            for row_shard, size in zip(batch["shard"], batch["tokens"]):
                size = min(size, max_seq_length)
                if row_shard != shard:
                    shard, pack, filled = row_shard, 0, 0
                elif filled + size > max_seq_length:
                    pack, filled = pack + 1, 0
                packs.append(pack)
                starts.append(filled)
                filled += size
            yield batch.assign(pack=packs, start=starts)[["row_id", "tokens", "shard", "pack", "start"]]

    return run


def pack(rows: DataFrame, max_seq_length: int, digits: int = SHARD_DIGITS, seed: int = 3407) -> DataFrame:
    """Assign examples to sequences of at most ``max_seq_length`` tokens.

    ``rows`` has ``row_id, tokens``. Packs fill up in split-key order and never cross a
    shard (a prefix of the key). An example longer than the limit counts as truncated and
    has a pack to itself. Python sees only ids and token counts, streamed in sorted batches;
    a shard is never held in memory. Shards are uniform because the key is a hash of the
    unique row id. ``digits`` sets the number of shards, whatever the number of rows: a row's pack
    doesn't change when rows of other shards come or go. Take 3 or 4 on a large cluster.
    """
    key = split_key(F.col("row_id"), seed)
    keyed = rows.select("row_id", F.col("tokens").cast("int").alias("tokens"), key.alias("key"))
    sharded = keyed.withColumn("shard", F.substring("key", 1, digits))
    placed = sharded.repartition("shard").sortWithinPartitions("shard", "key", "row_id")
    id_type = rows.schema["row_id"].dataType.simpleString()
    return placed.select("row_id", "tokens", "shard").mapInPandas(
        _pack_sorted(max_seq_length), f"row_id {id_type}, tokens int, shard string, pack int, start int"
    )


def total_steps(
    n_examples: Column, batch_size: Column, accumulation: Column, epochs: Column, max_steps: Column
) -> Column:
    """Optimizer steps: ``max_steps`` when positive, else batches per epoch times epochs."""
    effective = F.greatest(F.lit(1), batch_size * accumulation)
    per_epoch = F.greatest(F.lit(1), F.ceil(n_examples / effective))
    planned = F.greatest(F.lit(1), F.floor(per_epoch * epochs)).cast("bigint")
    return F.when(max_steps > 0, max_steps.cast("bigint")).otherwise(planned)
