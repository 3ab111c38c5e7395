"""Live run telemetry: subscriptions, fan-out, bounded history and run snapshots."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tunegrain.functions.text import py_round
from tunegrain.operators import telemetry
from tunegrain.streaming.state import MergedState, latest_per_key

REFRESH = "2 seconds"
log = logging.getLogger(__name__)


def _start(writer: DataStreamWriter, checkpoint: str, once: bool, refresh: str = REFRESH) -> StreamingQuery:
    trigger = {"availableNow": True} if once else {"processingTime": refresh}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def event_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def subscribe(
    events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
    job_id: str | None = None, kinds: Iterable[str] | None = None, once: bool = False, since: datetime | None = None,
) -> StreamingQuery:
    """Hand each micro-batch of one job's events to ``handle``; stop the query to unsubscribe.

    Only events with a time from ``since`` on are handed over; without it, from this call on.
    """
    start = F.lit(since) if since is not None else F.lit(datetime.now(timezone.utc))
    chosen = telemetry.history(events, job_id, kinds).where(F.col("ts") >= start.cast(events.schema["ts"].dataType))
    return _start(chosen.writeStream.foreachBatch(handle), checkpoint, once)


def fan_out(
    events: DataFrame, handlers: Iterable[Callable[[DataFrame, int], None]], checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Deliver every event to all handlers; the source is read once per micro-batch.

    A handler that fails is logged and doesn't keep the batch from the others.
    """
    handlers = list(handlers)

    def deliver(batch: DataFrame, batch_id: int) -> None:
        stored = batch.persist()
        try:
            for handle in handlers:
                try:
                    handle(stored, batch_id)
                except Exception:
                    log.exception("a handler failed on batch %d", batch_id)
        finally:
            stored.unpersist()

    return _start(events.writeStream.foreachBatch(deliver), checkpoint, once)


def history_state(path: str, schema: T.StructType, n: int = telemetry.HISTORY_SIZE, compact_every: int = 50) -> MergedState:
    """The newest ``n`` events per job."""
    return MergedState(path, schema, lambda df: telemetry.last_events(df, n), compact_every)


def keep_history(events: DataFrame, state: MergedState, checkpoint: str, once: bool = False) -> StreamingQuery:
    return _start(events.writeStream.foreachBatch(state.absorb), checkpoint, once)


SNAPSHOT_VALUES = ("current_step", "current_epoch", "metrics", "status", "last_checkpoint")
_TYPES = {"current_step": "bigint", "current_epoch": "double", "metrics": "string", "status": "string", "last_checkpoint": "string"}
SNAPSHOT = "job_id string, " + ", ".join(
    f"{v} struct<v: {_TYPES[v]}, ts: timestamp, event_id: bigint>" for v in SNAPSHOT_VALUES
)


def snapshot_updates(events: DataFrame) -> DataFrame:
    """Each event as the run columns it sets (null for the others), tagged with its time."""
    payload = F.from_json("data", "step bigint, epoch double, status string, checkpoint string")
    kind = F.col("kind")
    kept = F.to_json(F.from_json("data", ", ".join(f"{k} double" for k in telemetry.KEPT_METRICS)))
    parsed = events.withColumn("p", payload)
    is_metric = kind == telemetry.METRIC
    sets: dict[str, Column] = {
        "current_step": F.when(is_metric, F.coalesce("p.step", F.lit(0))),
        "current_epoch": F.when(is_metric, py_round(F.coalesce("p.epoch", F.lit(0.0)), 3)),
        "metrics": F.when(is_metric, kept),
        "status": F.when(kind == telemetry.STATUS, F.col("p.status")),
        "last_checkpoint": F.col("p.checkpoint"),
    }
    return parsed.select(
        "job_id",
        *[F.struct(c.cast(_TYPES[v]).alias("v"), F.col("ts"), F.col("event_id")).alias(v) for v, c in sets.items()],
    )


def snapshot_state(path: str, compact_every: int = 50) -> MergedState:
    reduce = latest_per_key(["job_id"], ["ts", "event_id"], list(SNAPSHOT_VALUES))
    return MergedState(path, T.StructType.fromDDL(SNAPSHOT), reduce, compact_every)


def keep_snapshots(events: DataFrame, state: MergedState, checkpoint: str, once: bool = False) -> StreamingQuery:
    return _start(snapshot_updates(events).writeStream.foreachBatch(state.absorb), checkpoint, once)


def snapshots(state_rows: DataFrame) -> DataFrame:
    """Current run columns; a run is resumable once it has a checkpoint."""
    plain = state_rows.select("job_id", *[F.col(f"{v}.v").alias(v) for v in SNAPSHOT_VALUES])
    return plain.withColumn("resumable", F.coalesce(F.col("last_checkpoint") != "", F.lit(False)))
