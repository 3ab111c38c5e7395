"""Run and model ledgers kept as append-only change logs.

A change row carries an id, an orderable ``version``, an ``op`` ('put' or 'delete') and
the columns it sets; columns it leaves alone are null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrain.functions import jsontext
from tunegrain.operators.toplist import first_per_key

# Status sets and the recovery message.
ACTIVE = ("preparing", "downloading", "running", "pausing")
TERMINAL = ("completed", "failed", "cancelled")
CONTINUABLE = ("paused", "resumable")
INTERRUPTED = "Interrupted before first checkpoint."

CHECKPOINT_PATTERN = r"checkpoint-(\d+)$"


def is_active(status: Column) -> Column:
    return status.isin(*ACTIVE)


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL)


def can_pause(status: Column) -> Column:
    return status == "running"


def can_resume(status: Column, last_checkpoint: Column) -> Column:
    return status.isin(*CONTINUABLE) & (F.coalesce(last_checkpoint, F.lit("")) != "")


def progress(step: Column, total: Column) -> Column:
    """Share done, at most 1; 0 while the total is unknown."""
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), step.cast("double") / F.nullif(total, F.lit(0))))


def percent(share: Column) -> Column:
    return (share * 100).cast("int")


def step_label(step: Column, total: Column) -> Column:
    return F.concat(step.cast("string"), F.lit("/"), F.when(total != 0, total.cast("string")).otherwise("?"))


def time_label(epoch_seconds: Column) -> Column:
    """Minutes precision in the session time zone; blank for an unset time."""
    text = F.date_format(F.timestamp_seconds(epoch_seconds), "yyyy-MM-dd HH:mm")
    return F.when(epoch_seconds != 0, text).otherwise("")


def tombstones(ids: DataFrame, key: str, version: Column) -> DataFrame:
    """Change rows that delete the given ids."""
    return ids.select(F.col(key), version.alias("version"), F.lit("delete").alias("op"))


def current_state(changes: DataFrame, key: str, columns: Sequence[str], version: str = "version") -> DataFrame:
    """Last written value of every column per id; ids whose last word is a delete are gone.

    A value set before the last delete does not come back: it counts only if its version is
    later. That makes it one aggregation, combined on the map side, so an id with very many
    changes is no hot spot.
    """
    deletes = F.col("op") == "delete"
    v = F.col(version)
    last = {
        c: F.max(F.when(~deletes & F.col(c).isNotNull(), F.struct(v.alias("at"), F.col(c).alias("value")))).alias(c)
        for c in columns
    }
    folded = changes.groupBy(key).agg(
        *last.values(),
        F.max(F.when(deletes, v)).alias("gone_at"),
        F.max(F.when(~deletes, v)).alias("updated_at"),
    )

    def after_delete(at: Column) -> Column:
        return F.col("gone_at").isNull() | (at > F.col("gone_at"))

    alive = folded.where(F.col("updated_at").isNotNull() & after_delete(F.col("updated_at")))
    values = [F.when(after_delete(F.col(f"{c}.at")), F.col(f"{c}.value")).alias(c) for c in columns]
    return alive.select(key, *values, "updated_at")


def register_models(records: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Whole-row upsert: the newest record per id, with the first registration time."""
    others = [c for c in records.columns if c not in (key, version)]
    newest = F.max_by(F.struct(*others), F.col(version)).alias("r")
    return records.groupBy(key).agg(
        newest, F.min(version).alias("created_at"), F.max(version).alias("updated_at")
    ).select(key, "r.*", "created_at", "updated_at")


def status_times(changes: DataFrame, key: str, at: str = "ts", status: str = "status") -> DataFrame:
    """When each run last started running and last reached an end."""
    return changes.groupBy(key).agg(
        F.max(F.when(F.col(status) == "running", F.col(at))).alias("started_at"),
        F.max(F.when(is_terminal(F.col(status)), F.col(at))).alias("finished_at"),
    )


def newest_first(rows: DataFrame, created: str = "created_at", key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(created), F.asc(key))


def find(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.where(F.col(key) == value)


def job_details(jobs: DataFrame) -> DataFrame:
    """Ledger rows with their JSON columns parsed; blank or broken JSON counts as {}."""
    parsed = {name: jsontext.object_or_empty(F.col(f"{name}_json")) for name in ("config", "metrics")}
    return jobs.withColumns(parsed).drop("config_json", "metrics_json")


def job_rows(jobs: DataFrame) -> DataFrame:
    """Display columns of the run list."""
    share = progress(F.col("current_step"), F.col("total_steps"))
    return newest_first(jobs).select(
        "id",
        F.coalesce(F.nullif("name", F.lit("")), F.lit("-")).alias("name"),
        "status",
        "base_model_key",
        step_label(F.col("current_step"), F.col("total_steps")).alias("step"),
        F.concat(percent(share).cast("string"), F.lit("%")).alias("progress"),
    )


def job_label(name: Column, job_id: Column, status: Column) -> Column:
    return F.concat(F.coalesce(F.nullif(name, F.lit("")), job_id), F.lit("  ·  "), status)


def checkpoint_label(name: Column, job_id: Column, step: Column, status: Column) -> Column:
    shown = F.coalesce(F.nullif(name, F.lit("")), job_id)
    return F.concat(shown, F.lit(" @ "), step.cast("string"), F.lit(" steps ["), status, F.lit("]"))


def runs_with_checkpoint(jobs: DataFrame) -> DataFrame:
    label = checkpoint_label(F.col("name"), F.col("id"), F.col("current_step"), F.col("status"))
    return newest_first(jobs).where(F.col("last_checkpoint") != "").select("id", label.alias("label"))


def model_rows(models: DataFrame) -> DataFrame:
    """Display columns of the model list, newest first."""
    return newest_first(models).select(
        "name", "base_model_key", "artifact_kind", "quantization", time_label(F.col("created_at")).alias("created"), "id"
    )


def model_label(name: Column, base_model_key: Column) -> Column:
    return F.concat(name, F.lit(" ("), base_model_key, F.lit(")"))


def overview(jobs: DataFrame, datasets: DataFrame, models: DataFrame) -> DataFrame:
    """One row: how many runs, active runs, prepared datasets and models."""
    return jobs.agg(
        F.count("*").alias("n_jobs"), F.count_if(is_active(F.col("status"))).alias("n_active")
    ).select(
        "n_jobs",
        "n_active",
        datasets.agg(F.count("*")).scalar().alias("n_datasets"),
        models.agg(F.count("*")).scalar().alias("n_models"),
    )


def checkpoint_step(path: Column) -> Column:
    """Number at the end of a checkpoint path; null for other paths."""
    return F.nullif(F.regexp_extract(path, CHECKPOINT_PATTERN, 1), F.lit("")).try_cast("bigint")


def latest_checkpoint(listing: DataFrame, key: str = "job_id", path: str = "path") -> DataFrame:
    """Per run the checkpoint with the highest step (as a number, not as text)."""
    steps = listing.withColumn("step", checkpoint_step(F.col(path))).where(F.col("step").isNotNull())
    return steps.groupBy(key).agg(
        F.max_by(F.col(path), F.col("step")).alias("last_checkpoint"), F.max("step").alias("last_step")
    )


def expired_checkpoints(checkpoints: DataFrame, keep: int, key: str = "job_id", step: str = "step") -> DataFrame:
    """Checkpoints beyond the newest ``keep`` of each run.

    Input rows are distinct by (run, step). The few kept ones are found first; the rest is
    an anti join on (run, step), which spreads a run with very many checkpoints.
    """
    kept = first_per_key(checkpoints.select(key, step), [key], [F.desc(step)], keep)
    return checkpoints.join(kept, [key, step], "left_anti")


def existing(rows: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose non-empty path is in a file listing (one row per path)."""
    return rows.where(F.col(path) != "").join(listing.select(path).distinct(), path, "left_semi")


def reconcile(jobs: DataFrame, listing: DataFrame, key: str = "id") -> DataFrame:
    """State after a restart: active runs become resumable or failed, others stay.

    ``listing`` has the distinct ``path`` of every checkpoint that exists. Runs that need no
    look-up (most, and often with the same blank path) get a key of their own that matches
    nothing, so they spread over the join.
    """
    active = is_active(F.col("status"))
    looks_up = active & (F.coalesce("last_checkpoint", F.lit("")) != "")
    seen = listing.select(F.col("path").alias("_path"), F.lit(True).alias("_found"))
    no_path = F.concat(F.lit("\x00"), F.col(key).cast("string"))
    keyed = jobs.withColumn("_path", F.when(looks_up, F.col("last_checkpoint")).otherwise(no_path))
    joined = keyed.join(seen, "_path", "left")
    found = F.coalesce(F.col("_found"), F.lit(False))
    return joined.withColumns(
        {
            "new_status": F.when(~active, F.col("status")).when(found, F.lit("resumable")).otherwise(F.lit("failed")),
            "new_error": F.when(active & ~found, F.lit(INTERRUPTED)).otherwise(F.lit("")),
        }
    ).drop("_path", "_found")


def lineage(models: DataFrame, jobs: DataFrame, datasets: DataFrame, on: Mapping[str, str] | None = None) -> DataFrame:
    """Models with the run and the dataset they came from (left joins on unique ids).

    No side is broadcast by hand: the planner does so when its size, estimated or measured
    at run time, is small, and splits skewed partitions otherwise.
    """
    keys = {"job": "job_id", "dataset": "dataset_id", **(on or {})}
    return models.join(jobs, keys["job"], "left").join(datasets, keys["dataset"], "left")
