"""Queries over run telemetry (``events``) and ledgers (``orders``, ``lineitem``, ``customer``)."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegrain.operators import ledger, telemetry
from tunegrain.plans.fixtures import CHECKPOINTS_SQL, EVENTS_SQL, JOBS_SQL, checkpoint_files, events, jobs, py_round_sql, table
from tunegrain.session import fresh_path

RECENT = 25
TAIL = 10
KEEP = 3


def kind_history(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.history(events(spark, folder), kinds=["log", "error"]).select("job_id", "event_id", "kind", "ts")


def job_history(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the run with the smallest id, read from its bucket of a written store."""
    path = fresh_path(spark, "event-store")
    telemetry.append_events(events(spark, folder), path)
    stored = telemetry.read_events(spark, path)
    job = stored.agg(F.min("job_id")).first()[0]
    return telemetry.history(stored, job).select("job_id", "event_id", "kind")


def last_n_events(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.last_events(events(spark, folder), RECENT).select("job_id", "event_id", "kind")


def bounded_history(spark: SparkSession, folder: str) -> DataFrame:
    """Status and error events among the newest ones of each run."""
    recent = telemetry.bounded_history(events(spark, folder), ["status", "error"], RECENT)
    return recent.select("job_id", "event_id", "kind")


def log_tail(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.log_tail(events(spark, folder), TAIL).select("job_id", "event_id", "message")


def metrics_frame(spark: SparkSession, folder: str) -> DataFrame:
    frame = telemetry.metrics_frame(events(spark, folder), ["epoch", "loss", "learning_rate"])
    return frame.select("job_id", "event_id", "step", "epoch", "loss", "learning_rate")


def metric_series(spark: SparkSession, folder: str) -> DataFrame:
    frame = telemetry.metrics_frame(events(spark, folder))
    return telemetry.metric_series(frame, "learning_rate").select("job_id", "event_id", "step", "learning_rate")


def latest_metric(spark: SparkSession, folder: str) -> DataFrame:
    """Last metric event per run; its learning rate is blank unless that event carried one."""
    return telemetry.latest_metrics(telemetry.metrics_frame(events(spark, folder)))


def metric_tiles(spark: SparkSession, folder: str) -> DataFrame:
    latest = telemetry.latest_metrics(telemetry.metrics_frame(events(spark, folder)))
    return latest.select("job_id", *telemetry.tile_text(F.col("loss"), F.col("learning_rate")))


def event_metric_cast(spark: SparkSession, folder: str) -> DataFrame:
    """Trainer log entries as text, some of them no numbers, to long form."""
    value = F.col("value").cast("decimal(20,2)").cast("string")
    logs = F.create_map(
        F.lit("loss"), value,
        F.lit("eval_loss"), F.concat(F.lit(" "), value, F.lit("\n")),
        F.lit("grad_norm"), F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.concat(value, F.lit("e-1"))),
        F.lit("learning_rate"), F.when(F.col("event_type") == "view", F.concat(value, F.lit("d"))).otherwise(value),
        F.lit("mean_token_accuracy"), F.when(F.col("event_type") == "click", F.lit("1_0.5")),
        F.lit("runtime"), value,
    )
    return telemetry.select_metrics(table(spark, folder, "events"), logs, ["event_id"])


def epoch_rounding(spark: SparkSession, folder: str) -> DataFrame:
    epoch = telemetry.rounded_epoch(F.col("value") / 64)
    return table(spark, folder, "events").select("event_id", epoch.alias("epoch"))


def cleared_history(spark: SparkSession, folder: str) -> DataFrame:
    """What a store still answers once run 7 and run 8 are cleared and run 8 has written on, counted by kind."""
    path = fresh_path(spark, "cleared")
    rows = events(spark, folder)
    telemetry.append_events(rows, path)
    for job in ("7", "8"):
        telemetry.clear_history(spark, path, job)
    time.sleep(1.1)  # storage clocks may count seconds only
    telemetry.append_events(rows.where("job_id = '8' and kind = 'log'"), path)
    return telemetry.read_events(spark, path).groupBy("job_id", "kind").agg(F.count("*").alias("n"))


def jobs_by_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = jobs(spark, folder)
    active = ledger.is_active(F.col("status"))
    terminal = ledger.is_terminal(F.col("status"))
    return rows.groupBy("status", active.alias("active"), terminal.alias("terminal"), ledger.can_pause(F.col("status")).alias("can_pause")).agg(
        F.count("*").alias("n")
    )


def job_progress(spark: SparkSession, folder: str) -> DataFrame:
    share = ledger.progress(F.col("current_step"), F.col("total_steps"))
    return jobs(spark, folder).select("id", share.alias("share"), ledger.percent(share).alias("pct"))


def job_table(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.job_rows(jobs(spark, folder))


def overview_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.overview(jobs(spark, folder), table(spark, folder, "customer"), table(spark, folder, "part"))


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as ledger changes: some set a status, some a step or a checkpoint, some delete."""
    item = table(spark, folder, "lineitem")
    version = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    return item.select(
        F.col("l_orderkey").alias("id"),
        version.alias("version"),
        F.when((F.col("l_partkey") % 11 == 0), F.lit("delete")).otherwise(F.lit("put")).alias("op"),
        F.when(line == "O", F.when(flag == "R", F.lit("failed")).otherwise(F.lit("running"))).alias("status"),
        F.when(flag != "A", F.col("l_partkey")).alias("current_step"),
        F.when(flag == "N", F.concat(F.lit("checkpoint-"), F.col("l_suppkey").cast("string"))).alias("last_checkpoint"),
    )


def ledger_current_state(spark: SparkSession, folder: str) -> DataFrame:
    state = ledger.current_state(_changes(spark, folder), "id", ["current_step", "last_checkpoint"])
    return state.select("id", "current_step", "last_checkpoint", F.col("updated_at.l_shipdate").alias("updated_at"))


def model_registry_state(spark: SparkSession, folder: str) -> DataFrame:
    """Whole-record registration: the newest record per supplier as model."""
    item = table(spark, folder, "lineitem")
    version = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    records = item.select(F.col("l_suppkey").alias("id"), version.alias("version"), "l_partkey", "l_quantity")
    return ledger.register_models(records).select(
        "id", "l_partkey", "l_quantity",
        F.col("created_at.l_shipdate").alias("created_at"), F.col("updated_at.l_shipdate").alias("updated_at"),
    )


def status_times(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("l_linestatus") == "O", F.lit("running")).when(F.col("l_returnflag") == "R", F.lit("failed")).otherwise("paused")
    changes = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("ts"), status.alias("status"))
    return ledger.status_times(changes, "id")


def _details(spark: SparkSession, folder: str) -> DataFrame:
    """Events as ledger rows whose JSON columns are good, blank or broken."""
    kind = F.col("event_type")
    config = F.when(kind == "error", F.lit("{broken")).when(kind == "view", F.lit("")).otherwise(F.col("props"))
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), config.alias("config_json"), F.col("props").alias("metrics_json")
    )


def job_details(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.job_details(_details(spark, folder)).select(
        "id",
        F.try_variant_get("config", "$.k", "bigint").alias("config_k"),
        F.try_variant_get("metrics", "$.k", "bigint").alias("metrics_k"),
        F.to_json("config").alias("config"),
    )


def latest_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.latest_checkpoint(checkpoint_files(spark, folder))


def _checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    listing = checkpoint_files(spark, folder).distinct()
    return listing.withColumn("step", ledger.checkpoint_step(F.col("path")))


def checkpoint_retention(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.expired_checkpoints(_checkpoints(spark, folder), KEEP).select("job_id", "step", "path")


def _jobs_with_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    """Runs that name checkpoint 100 as their last; whether it exists depends on the listing."""
    path = F.concat(F.lit("/runs/"), F.col("id"), F.lit("/checkpoint-100"))
    named = F.when(F.col("total_steps") % 5 == 0, F.lit("")).otherwise(path)
    return jobs(spark, folder).withColumn("last_checkpoint", named)


def recover_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    listing = checkpoint_files(spark, folder).select("path").distinct()
    return ledger.reconcile(_jobs_with_checkpoint(spark, folder), listing).select("id", "status", "new_status", "new_error")


def existing_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _jobs_with_checkpoint(spark, folder).withColumnRenamed("last_checkpoint", "path")
    return ledger.existing(rows, checkpoint_files(spark, folder)).select("id", "path")


def resumable_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = _jobs_with_checkpoint(spark, folder)
    ready = rows.where(ledger.can_resume(F.col("status"), F.col("last_checkpoint")))
    return ready.select("id", ledger.job_label(F.col("name"), F.col("id"), F.col("status")).alias("label"))


def runs_with_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.runs_with_checkpoint(_jobs_with_checkpoint(spark, folder))


def model_table(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as registered models."""
    rows = jobs(spark, folder).select(
        "id", "name", "base_model_key", "created_at", F.lit("lora").alias("artifact_kind"), F.lit("qlora").alias("quantization")
    )
    return ledger.model_rows(rows).withColumn("label", ledger.model_label(F.col("name"), F.col("base_model_key")))


def lineage_join(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as models, orders as their runs, customers as the data sets used."""
    models = table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("model_id"),
        F.concat(F.lit("job-"), F.col("l_orderkey").cast("string")).alias("job_id"),
        "l_quantity",
    )
    runs = jobs(spark, folder).select(F.col("id").alias("job_id"), "status", "dataset_id")
    sets = table(spark, folder, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_name").alias("dataset_name"))
    return ledger.lineage(models, runs, sets).select("model_id", "job_id", "l_quantity", "status", "dataset_id", "dataset_name")


QUERIES = {
    f.__name__: f
    for f in (
        kind_history, job_history, last_n_events, bounded_history, log_tail, metrics_frame, metric_series, latest_metric, metric_tiles,
        event_metric_cast, epoch_rounding, cleared_history, jobs_by_status, job_progress, job_table, overview_counts,
        ledger_current_state, model_registry_state, status_times, job_details, latest_checkpoint, checkpoint_retention,
        recover_reconcile, existing_artifacts, resumable_runs, runs_with_checkpoint, model_table, lineage_join,
    )
}

_METRICS = f"""
    SELECT job_id, event_id, ts, k AS step, CASE event_type WHEN 'click' THEN value / 64 END AS epoch, value AS loss,
           CASE event_type WHEN 'purchase' THEN value / 1000 END AS learning_rate
    FROM ({EVENTS_SQL}) WHERE kind = 'metric'
"""
_NEWEST = "row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC)"
_LATEST = f"SELECT job_id, loss, learning_rate FROM (SELECT *, {_NEWEST} AS i FROM ({_METRICS})) WHERE i = 1"
_CHANGES = """
    SELECT l_orderkey AS id, row(l_shipdate, l_linenumber, l_partkey, l_suppkey) AS version, l_shipdate,
           l_partkey % 11 = 0 AS deletes,
           CASE WHEN l_returnflag <> 'A' THEN l_partkey END AS current_step,
           CASE WHEN l_returnflag = 'N' THEN 'checkpoint-' || l_suppkey END AS last_checkpoint
    FROM lineitem
"""
_PROGRESS = f"""
    SELECT *, CASE WHEN total_steps <= 0 THEN 0.0::DOUBLE
                   ELSE least(1.0::DOUBLE, current_step::DOUBLE / nullif(total_steps, 0)) END AS share FROM ({JOBS_SQL})
"""
_NAMED = f"""
    SELECT *, CASE WHEN total_steps % 5 = 0 THEN '' ELSE '/runs/' || id || '/checkpoint-100' END AS last_checkpoint
    FROM ({JOBS_SQL})
"""
_MONEY = "CAST(CAST(value AS DECIMAL(20,2)) AS VARCHAR)"

ORACLES = {
    "kind_history": f"SELECT job_id, event_id, kind, ts FROM ({EVENTS_SQL}) WHERE kind IN ('log', 'error')",
    "job_history": f"""
        SELECT job_id, event_id, kind FROM ({EVENTS_SQL}) WHERE job_id = (SELECT min(job_id) FROM ({EVENTS_SQL}))""",
    "last_n_events": f"""
        SELECT job_id, event_id, kind FROM (SELECT *, {_NEWEST} AS i FROM ({EVENTS_SQL})) WHERE i <= {RECENT}""",
    "bounded_history": f"""
        SELECT job_id, event_id, kind FROM (SELECT *, {_NEWEST} AS i FROM ({EVENTS_SQL}))
        WHERE i <= {RECENT} AND kind IN ('status', 'error')""",
    "log_tail": f"""
        SELECT job_id, event_id, event_type || ' ' || props AS message
        FROM (SELECT *, {_NEWEST} AS i FROM ({EVENTS_SQL}) WHERE kind = 'log') WHERE i <= {TAIL}""",
    "metrics_frame": f"SELECT job_id, event_id, step, epoch, loss, learning_rate FROM ({_METRICS})",
    "metric_series": f"""
        SELECT job_id, event_id, coalesce(step, 0) AS step, learning_rate FROM ({_METRICS}) WHERE learning_rate IS NOT NULL""",
    "latest_metric": _LATEST,
    "metric_tiles": f"""
        SELECT job_id, coalesce(printf('%.4f', loss), '—') AS loss_text,
               coalesce(printf('%.2e', learning_rate), '—') AS learning_rate_text FROM ({_LATEST})""",
    "event_metric_cast": f"""
        SELECT event_id, 'loss' AS metric, {_MONEY}::DOUBLE AS value FROM events WHERE value IS NOT NULL
        UNION ALL SELECT event_id, 'eval_loss', {_MONEY}::DOUBLE FROM events WHERE value IS NOT NULL
        UNION ALL SELECT event_id, 'grad_norm', ({_MONEY} || 'e-1')::DOUBLE FROM events
                  WHERE event_type <> 'error' AND value IS NOT NULL
        UNION ALL SELECT event_id, 'learning_rate', {_MONEY}::DOUBLE FROM events
                  WHERE event_type <> 'view' AND value IS NOT NULL
        UNION ALL SELECT event_id, 'mean_token_accuracy', 10.5::DOUBLE FROM events WHERE event_type = 'click'""",
    "epoch_rounding": f"SELECT event_id, {py_round_sql('coalesce(value / 64, 0)', 3)} AS epoch FROM events",
    "cleared_history": f"""
        SELECT job_id, kind, count(*) AS n FROM ({EVENTS_SQL}) WHERE job_id NOT IN ('7', '8') OR job_id = '8' AND kind = 'log' GROUP BY ALL""",
    "jobs_by_status": f"""
        SELECT status, status = 'running' AS active, status = 'completed' AS terminal, status = 'running' AS can_pause,
               count(*) AS n FROM ({JOBS_SQL}) GROUP BY ALL""",
    "job_progress": f"SELECT id, share, CAST(trunc(share * 100) AS INTEGER) AS pct FROM ({_PROGRESS})",
    "job_table": f"""
        SELECT id, CASE name WHEN '' THEN '-' ELSE name END AS name, status, base_model_key,
               current_step || '/' || CASE total_steps WHEN 0 THEN '?' ELSE total_steps::VARCHAR END AS step,
               CAST(trunc(share * 100) AS INTEGER) || '%' AS progress FROM ({_PROGRESS})""",
    "overview_counts": f"""
        SELECT count(*) AS n_jobs, count(*) FILTER (status = 'running') AS n_active,
               (SELECT count(*) FROM customer) AS n_datasets, (SELECT count(*) FROM part) AS n_models FROM ({JOBS_SQL})""",
    "ledger_current_state": f"""
        WITH c AS ({_CHANGES}),
        gone AS (SELECT id, max(version) AS gone_at FROM c WHERE deletes GROUP BY id)
        SELECT id, arg_max(current_step, version) FILTER (current_step IS NOT NULL) AS current_step,
               arg_max(last_checkpoint, version) FILTER (last_checkpoint IS NOT NULL) AS last_checkpoint,
               arg_max(l_shipdate, version) AS updated_at
        FROM c LEFT JOIN gone USING (id) WHERE NOT deletes AND (gone_at IS NULL OR version > gone_at) GROUP BY id""",
    "model_registry_state": """
        SELECT l_suppkey AS id, arg_max(l_partkey, v) AS l_partkey, arg_max(l_quantity, v) AS l_quantity,
               min(l_shipdate) AS created_at, max(l_shipdate) AS updated_at
        FROM (SELECT *, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) AS v FROM lineitem) GROUP BY 1""",
    "status_times": """
        SELECT l_orderkey AS id, max(l_shipdate) FILTER (l_linestatus = 'O') AS started_at,
               max(l_shipdate) FILTER (l_linestatus <> 'O' AND l_returnflag = 'R') AS finished_at
        FROM lineitem GROUP BY 1""",
    "job_details": """
        SELECT event_id AS id, CASE WHEN event_type NOT IN ('error', 'view') THEN k END AS config_k, k AS metrics_k,
               CASE WHEN event_type NOT IN ('error', 'view') THEN replace(props, ' ', '') ELSE '{}' END AS config
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "latest_checkpoint": f"""
        SELECT job_id, arg_max(path, step) AS last_checkpoint, CAST(max(step) AS BIGINT) AS last_step
        FROM ({CHECKPOINTS_SQL}) GROUP BY 1""",
    "checkpoint_retention": f"""
        SELECT job_id, step, path
        FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY step DESC) AS i
              FROM (SELECT DISTINCT * FROM ({CHECKPOINTS_SQL}))) WHERE i > {KEEP}""",
    "recover_reconcile": f"""
        SELECT id, status,
               CASE WHEN status <> 'running' THEN status WHEN found THEN 'resumable' ELSE 'failed' END AS new_status,
               CASE WHEN status = 'running' AND NOT found THEN 'Interrupted before first checkpoint.' ELSE '' END AS new_error
        FROM (SELECT *, last_checkpoint IN (SELECT path FROM ({CHECKPOINTS_SQL})) AS found FROM ({_NAMED}))""",
    "existing_artifacts": f"""
        SELECT id, last_checkpoint AS path FROM ({_NAMED})
        WHERE last_checkpoint <> '' AND last_checkpoint IN (SELECT path FROM ({CHECKPOINTS_SQL}))""",
    "resumable_runs": f"""
        SELECT id, coalesce(nullif(name, ''), id) || '  ·  ' || status AS label FROM ({_NAMED})
        WHERE status IN ('paused', 'resumable') AND last_checkpoint <> ''""",
    "runs_with_checkpoint": f"""
        SELECT id, coalesce(nullif(name, ''), id) || ' @ ' || current_step || ' steps [' || status || ']' AS label
        FROM ({_NAMED}) WHERE last_checkpoint <> ''""",
    "model_table": f"""
        SELECT name, base_model_key, 'lora' AS artifact_kind, 'qlora' AS quantization,
               CASE WHEN created_at <> 0 THEN strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d %H:%M') ELSE '' END AS created,
               id, name || ' (' || base_model_key || ')' AS label FROM ({JOBS_SQL})""",
    "lineage_join": f"""
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS model_id, 'job-' || l_orderkey AS job_id,
               l_quantity, status, dataset_id, c_name AS dataset_name
        FROM lineitem LEFT JOIN ({JOBS_SQL}) j ON j.id = 'job-' || l_orderkey LEFT JOIN customer ON c_custkey = dataset_id""",
}
