"""Run telemetry over an event table ``event_id, job_id, kind, data (JSON text), ts``.

Events are ordered by ``(ts, event_id)``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegrain.functions.text import py_float, py_round, significant
from tunegrain.operators.toplist import first_per_key
from tunegrain.session import materialize
from tunegrain.sources import files

LOG, METRIC, STATUS, ERROR = "log", "metric", "status", "error"

# History bound, log tail, and the metrics that are kept.
HISTORY_SIZE = 5000
LOG_TAIL = 200
KEPT_METRICS = ("loss", "eval_loss", "learning_rate", "grad_norm", "mean_token_accuracy")


def newest_first() -> list[Column]:
    return [F.desc("ts"), F.desc("event_id")]


def _payload(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))


def log_data(message: Column, level: Column | None = None) -> Column:
    return _payload(message=message, level=F.lit("info") if level is None else level)


def metric_data(step: Column, **values: Column) -> Column:
    return _payload(step=step, **values)


def status_data(status: Column, detail: Column | None = None) -> Column:
    return _payload(status=status, detail=F.lit(None).cast("string") if detail is None else detail)


def error_data(message: Column) -> Column:
    return _payload(message=message)


#: Folders of an event store. Give another number to all calls for a store whose buckets should be smaller.
BUCKETS = 64


def event(event_id: Column, job_id: Column, kind: str | Column, data: Column, ts: Column) -> list[Column]:
    """The columns of an event row, for ``df.select(*event(...))``."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return [
        event_id.alias("event_id"), job_id.cast("string").alias("job_id"), kind.alias("kind"),
        data.alias("data"), ts.alias("ts"),
    ]


def _bucket(job_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(job_id), F.lit(buckets)).cast("int")


def append_events(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append to the event store, laid out by a bucket of the job id."""
    rows.withColumn("job_bucket", _bucket(F.col("job_id"), buckets)).write.mode("append").partitionBy("job_bucket").parquet(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of a store, without those that were cleared.

    A marker takes away what was written before it, by the clock of the storage; what a job writes
    after being cleared stays (where that clock counts seconds only, from the next second on).
    """
    events = spark.read.parquet(path)
    if not files.exists(spark, _markers(path)):
        return events
    markers = _cleared(spark, path).groupBy("job_id").agg(F.max("upto").alias("upto"))
    placed = events.select("*", F.col("_metadata.file_modification_time").alias("_written")).join(markers, "job_id", "left")
    return placed.where(F.col("upto").isNull() | (F.col("_written") > F.col("upto"))).select(*events.columns)


def _cleared(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MARKER).parquet(_markers(path)).select("*", F.col("_metadata.file_modification_time").alias("upto"))


_MARKER = "job_id string, job_bucket int"


def _markers(path: str) -> str:
    return f"{path.rstrip('/')}-cleared"


def history(events: DataFrame, job_id: str | None = None, kinds: Iterable[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Events of one job (or of all), optionally only some kinds. Order with ``in_order``.

    In a store laid out by ``append_events`` one job is read from its bucket only.
    """
    if job_id is not None:
        if "job_bucket" in events.columns:
            events = events.where(F.col("job_bucket") == _bucket(F.lit(job_id), buckets))
        events = events.where(F.col("job_id") == job_id)
    kinds = sorted(kinds or ())
    return events.where(F.col("kind").isin(kinds)) if kinds else events


def in_order(events: DataFrame) -> DataFrame:
    return events.orderBy("job_id", "ts", "event_id")


def last_events(events: DataFrame, n: int = HISTORY_SIZE) -> DataFrame:
    """The newest ``n`` events of every job."""
    return first_per_key(events, ["job_id"], newest_first(), n)


def bounded_history(events: DataFrame, kinds: Iterable[str] | None = None, n: int = HISTORY_SIZE) -> DataFrame:
    """What a store of ``n`` events per job would answer: evict first, then choose kinds."""
    return history(last_events(events, n), kinds=kinds)


def log_tail(events: DataFrame, n: int = LOG_TAIL) -> DataFrame:
    """The last ``n`` log messages of every job."""
    tail = last_events(history(events, kinds=[LOG]), n)
    message = F.coalesce(F.get_json_object("data", "$.message"), F.lit(""))
    return tail.select("job_id", "event_id", "ts", message.alias("message"))


def metrics_frame(events: DataFrame, keys: Sequence[str] = ("epoch", *KEPT_METRICS)) -> DataFrame:
    """Metric events with one column per key (null where an event lacks it)."""
    values = F.from_json("data", "step bigint, " + ", ".join(f"`{k}` double" for k in keys))
    return history(events, kinds=[METRIC]).select("job_id", "event_id", "ts", values.alias("v")).select(
        "job_id", "event_id", "ts", "v.*"
    )


def metric_series(frame: DataFrame, y: str) -> DataFrame:
    """``(step, y)`` points; events without ``y`` are left out, a missing step counts as 0."""
    return frame.where(F.col(y).isNotNull()).select(
        "job_id", "event_id", "ts", F.coalesce("step", F.lit(0)).alias("step"), y
    )


def latest_metrics(frame: DataFrame, keys: Sequence[str] = ("loss", "learning_rate")) -> DataFrame:
    """Values of the last metric event per job; a key that event lacks stays null."""
    newest = F.max_by(F.struct(*keys), F.struct("ts", "event_id"))
    return frame.groupBy("job_id").agg(newest.alias("v")).select("job_id", "v.*")


def tile_text(loss: Column, learning_rate: Column) -> list[Column]:
    """Display form of the latest values: four decimals, and two-digit scientific notation."""
    def shown(pattern: str, c: Column) -> Column:
        return F.when(c.isNotNull(), F.format_string(pattern, c)).otherwise(F.lit("—"))

    return [
        shown("%.4f", py_round(loss, 4)).alias("loss_text"),
        shown("%.2e", significant(learning_rate, 3)).alias("learning_rate_text"),
    ]


def select_metrics(logs: DataFrame, values: Column, keep: Sequence[str]) -> DataFrame:
    """Long form ``*keep, metric, value`` of the wanted entries of a ``map<string,string>``.

    Entries that Python's ``float`` would refuse are left out.
    """
    pairs = logs.select(*keep, F.explode(values).alias("metric", "text"))
    wanted = pairs.where(F.col("metric").isin(*KEPT_METRICS))
    numbers = wanted.select(*keep, "metric", py_float(F.col("text")).alias("value"))
    return numbers.where(F.col("value").isNotNull())


def rounded_epoch(epoch: Column) -> Column:
    return py_round(F.coalesce(epoch, F.lit(0.0)), 3)


def clear_history(spark: SparkSession, path: str, job_id: str, buckets: int = BUCKETS) -> None:
    """Clear one job's history: one short row beside the store, which reading applies. No event is rewritten.

    ``compact`` removes what is marked, bucket by bucket, when there is time for it.
    """
    marker = spark.range(1).select(F.lit(job_id).alias("job_id"), _bucket(F.lit(job_id), buckets).alias("job_bucket"))
    marker.coalesce(1).write.mode("append").parquet(_markers(path))


def compact(spark: SparkSession, path: str) -> None:
    """Rewrite the buckets that hold cleared jobs, each by itself, then forget the markers. Nothing may write meanwhile."""
    if not files.exists(spark, _markers(path)):
        return
    for (b,) in sorted(_cleared(spark, path).select("job_bucket").distinct().collect()):  # as many as there are buckets
        if not files.exists(spark, f"{path}/job_bucket={b}"):
            continue
        rest = materialize(read_events(spark, path).where(F.col("job_bucket") == b), "events")
        if rest.isEmpty():
            files.remove_folder(spark, f"{path}/job_bucket={b}")
        else:
            overwrite = rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            overwrite.partitionBy("job_bucket").parquet(path)
    files.remove_folder(spark, _markers(path))


def clear_job(events: DataFrame, job_id: str) -> DataFrame:
    """The events that remain once a job's history is cleared."""
    return events.where(F.col("job_id") != job_id)
