"""Streaming queries run to completion over the tables; their twins are batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegrain.plans.fixtures import TEXT_MAPPING, as_events, table
from tunegrain.plans.run_queries import ORACLES as RUN_ORACLES
from tunegrain.plans.run_queries import RECENT
from tunegrain.plans.fixtures import EVENTS_SQL, py_round_sql
from tunegrain.plans.text_queries import ORACLES as TEXT_ORACLES
from tunegrain.schema import EVENT
from tunegrain.session import files_for, fresh_path
from tunegrain.streaming import prepare, runs

#: Micro-batches in which a table arrives.
SLICES = 4


def _arriving(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a file stream that arrives in several micro-batches."""
    source = fresh_path(spark, "arriving")
    rows = table(spark, folder, name)
    # Many files of bounded size make up a batch of a large table.
    at_once = -(-files_for(rows, SLICES) // SLICES)
    rows.repartition(SLICES * at_once).write.parquet(source)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", str(at_once)).parquet(source)


def _arriving_events(spark: SparkSession, folder: str) -> DataFrame:
    return as_events(_arriving(spark, folder, "events"))


def stream_last_n(spark: SparkSession, folder: str) -> DataFrame:
    home = fresh_path(spark, "history")
    state = runs.history_state(f"{home}/state", EVENT, RECENT, compact_every=3)
    runs.keep_history(_arriving_events(spark, folder), state, f"{home}/checkpoint", once=True).awaitTermination()
    return state.read(spark).select("job_id", "event_id", "kind")


def stream_job_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Where every run stands; some status events name a checkpoint."""
    home = fresh_path(spark, "snapshots")
    state = runs.snapshot_state(f"{home}/state", compact_every=3)
    arriving = _arriving(spark, folder, "events")
    step = F.get_json_object("props", "$.k").cast("bigint")
    saved = F.to_json(F.struct(F.get_json_object("data", "$.status").alias("status"), F.concat(F.lit("step-"), step.cast("string")).alias("checkpoint")))
    seen = as_events(arriving, "props")
    seen = seen.withColumn("data", F.when((F.col("kind") == "status") & (step % 40 == 0), saved).otherwise(F.col("data"))).drop("props")
    runs.keep_snapshots(seen, state, f"{home}/checkpoint", once=True).awaitTermination()
    return runs.snapshots(state.read(spark)).select(
        "job_id", "current_step", "current_epoch", "status",
        F.get_json_object("metrics", "$.loss").cast("double").alias("loss"), "last_checkpoint", "resumable",
    )


def live_subscription(spark: SparkSession, folder: str) -> DataFrame:
    """What a subscriber of one run's metrics gets from a moment on, that run being the first by name."""
    home = fresh_path(spark, "live")
    rows = table(spark, folder, "events")
    moment, job = rows.agg(F.timestamp_seconds(F.median(F.unix_timestamp(F.col("ts").cast("timestamp")))), F.min(F.col("user_id").cast("string"))).first()

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{home}/got/batch={batch_id}")

    stream = _arriving_events(spark, folder)
    runs.subscribe(stream, handle, f"{home}/checkpoint", job, ["metric"], once=True, since=moment).awaitTermination()
    return spark.read.schema(EVENT).parquet(f"{home}/got").select("job_id", "event_id", "kind")


def stream_subscription(spark: SparkSession, folder: str) -> DataFrame:
    """Two subscribers of one stream: one stores the log events, the other the metric events."""
    home = fresh_path(spark, "fan")

    def keep(kind: str):
        def handle(batch: DataFrame, batch_id: int) -> None:
            chosen = batch.where(F.col("kind") == kind)
            chosen.write.mode("overwrite").parquet(f"{home}/{kind}/batch={batch_id}")

        return handle

    stream = _arriving_events(spark, folder)
    runs.fan_out(stream, [keep("log"), keep("metric")], f"{home}/checkpoint", once=True).awaitTermination()
    got = [spark.read.schema(EVENT).parquet(f"{home}/{kind}") for kind in ("log", "metric")]
    return got[0].unionByName(got[1]).select("job_id", "event_id", "kind")


def stream_prepare(spark: SparkSession, folder: str) -> DataFrame:
    home = fresh_path(spark, "measured")
    rows = prepare.measured_stream(_arriving(spark, folder, "documents"), TEXT_MAPPING, "doc_id")
    prepare.append_stream(rows, f"{home}/rows", f"{home}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{home}/rows").select("row_id", "tokens", "output_len")


def stream_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct texts over all micro-batches (which copy arrives first is not fixed)."""
    home = fresh_path(spark, "distinct")
    rows = prepare.measured_stream(_arriving(spark, folder, "documents"), TEXT_MAPPING, "doc_id")
    unique = prepare.distinct_stream(rows).select("text", "tokens")
    prepare.append_stream(unique, f"{home}/rows", f"{home}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{home}/rows")


QUERIES = {
    f.__name__: f for f in (stream_last_n, stream_job_snapshot, stream_subscription, live_subscription, stream_prepare, stream_distinct)
}

_BEFORE = "ORDER BY ts, event_id"

ORACLES = {
    "stream_last_n": RUN_ORACLES["last_n_events"],
    "stream_job_snapshot": f"""
        WITH e AS ({EVENTS_SQL}),
        m AS (SELECT job_id, last(k {_BEFORE}) AS step, last(coalesce(CASE event_type WHEN 'click' THEN value / 64 END, 0) {_BEFORE}) AS epoch,
                     last(value {_BEFORE}) AS loss FROM e WHERE kind = 'metric' GROUP BY 1),
        s AS (SELECT job_id, last(CASE WHEN k % 2 = 0 THEN 'running' ELSE 'completed' END {_BEFORE}) AS status
              FROM e WHERE kind = 'status' GROUP BY 1),
        c AS (SELECT job_id, last('step-' || k {_BEFORE}) AS last_checkpoint FROM e WHERE kind = 'status' AND k % 40 = 0 GROUP BY 1)
        SELECT job_id, step AS current_step, {py_round_sql('epoch', 3)} AS current_epoch, status, loss, last_checkpoint,
               last_checkpoint IS NOT NULL AS resumable
        FROM (SELECT DISTINCT job_id FROM e) LEFT JOIN m USING (job_id) LEFT JOIN s USING (job_id) LEFT JOIN c USING (job_id)""",
    "live_subscription": f"""
        SELECT job_id, event_id, kind FROM ({EVENTS_SQL}) WHERE kind = 'metric' AND job_id = (SELECT min(CAST(user_id AS VARCHAR)) FROM events)
               AND ts >= (SELECT to_timestamp(median(epoch(date_trunc('second', ts)))) AT TIME ZONE 'UTC' FROM events)""",
    "stream_subscription": f"SELECT job_id, event_id, kind FROM ({EVENTS_SQL}) WHERE kind IN ('log', 'metric')",
    "stream_prepare": TEXT_ORACLES["token_estimate"],
    "stream_distinct": f"""
        SELECT text, any_value(tokens) AS tokens FROM ({TEXT_ORACLES['normalize_completion']})
        JOIN ({TEXT_ORACLES['token_estimate']}) USING (row_id) WHERE drop_reason IS NULL GROUP BY text""",
}
