"""The given tables in the shapes the operators work on, and SQL pieces for their twins.

All of it is plain projection or aggregation of the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunegrain.functions.text import PY_WHITESPACE
from tunegrain.operators import normalize as norm
from tunegrain.operators import telemetry, validate
from tunegrain.schema import FieldMapping, TaskFormat
from tunegrain.session import fit_shuffles

TEXT_MAPPING = FieldMapping(TaskFormat.COMPLETION, text_field="text")
CHAT_MAPPING = FieldMapping(TaskFormat.CHAT, messages_field="messages", system_prompt="You are a helpful assistant.")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return fit_shuffles(spark.read.parquet(f"{folder}/{name}.parquet"))


def normalized_documents(spark: SparkSession, folder: str) -> DataFrame:
    return norm.normalize(table(spark, folder, "documents"), TEXT_MAPPING, "doc_id")


def measured_documents(spark: SparkSession, folder: str) -> DataFrame:
    return validate.measure(normalized_documents(spark, folder))


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """``conv_id, messages`` with the roles as stored."""
    return norm.assemble_turns(table(spark, folder, "conversations"), "conv_id")


def normalized_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return norm.normalize(conversations(spark, folder), CHAT_MAPPING, "conv_id")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return as_events(table(spark, folder, "events"))


def as_events(rows: DataFrame, *more: str) -> DataFrame:
    """User as run; views log, clicks and purchases carry metrics, sign-ups set a status. ``more``: columns that stay."""
    number = F.get_json_object("props", "$.k").cast("bigint")
    value, source = F.col("value"), F.col("event_type")
    kind = (
        F.when(source == "view", telemetry.LOG)
        .when(source.isin("click", "purchase"), telemetry.METRIC)
        .when(source == "signup", telemetry.STATUS)
        .otherwise(telemetry.ERROR)
    )
    click = telemetry.metric_data(number, loss=value, epoch=value / 64)
    purchase = telemetry.metric_data(number, loss=value, learning_rate=value / 1000)
    status = telemetry.status_data(F.when(number % 2 == 0, F.lit("running")).otherwise("completed"))
    data = (
        F.when(source == "view", telemetry.log_data(F.concat_ws(" ", source, "props")))
        .when(source == "click", click)
        .when(source == "purchase", purchase)
        .when(source == "signup", status)
        .otherwise(telemetry.error_data(F.col("props")))
    )
    return rows.select(*telemetry.event(F.col("event_id"), F.col("user_id"), kind, data, F.col("ts")), *more)


EVENTS_SQL = """
    SELECT event_id, CAST(user_id AS VARCHAR) AS job_id, ts, value, props, event_type,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
           CASE event_type WHEN 'view' THEN 'log' WHEN 'click' THEN 'metric' WHEN 'purchase' THEN 'metric'
                           WHEN 'signup' THEN 'status' ELSE 'error' END AS kind
    FROM events
"""


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as runs: status, steps, a checkpoint path for those that have line items."""
    orders = table(spark, folder, "orders")
    status = F.col("o_orderstatus")
    return orders.select(
        F.concat(F.lit("job-"), F.col("o_orderkey").cast("string")).alias("id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("name"),
        F.when(status == "O", F.lit("running")).when(status == "F", F.lit("completed")).otherwise("paused").alias("status"),
        F.concat(F.lit("model-"), (F.col("o_custkey") % 7).cast("string")).alias("base_model_key"),
        F.floor(F.col("o_totalprice") / 1000).alias("current_step"),
        (F.col("o_custkey") % 500).alias("total_steps"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("created_at"),
        F.col("o_custkey").alias("dataset_id"),
    )


JOBS_SQL = """
    SELECT 'job-' || o_orderkey AS id,
           CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS name,
           CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'paused' END AS status,
           'model-' || (o_custkey % 7) AS base_model_key,
           CAST(floor(o_totalprice / 1000) AS BIGINT) AS current_step,
           o_custkey % 500 AS total_steps,
           CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS created_at,
           o_custkey AS dataset_id
    FROM orders
"""


def checkpoint_files(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as a listing of checkpoint paths (repeats kept)."""
    job = F.concat(F.lit("job-"), F.col("l_orderkey").cast("string"))
    path = F.concat(F.lit("/runs/"), job, F.lit("/checkpoint-"), (F.col("l_linenumber") * 50).cast("string"))
    return table(spark, folder, "lineitem").select(job.alias("job_id"), path.alias("path"))


CHECKPOINTS_SQL = """
    SELECT 'job-' || l_orderkey AS job_id, l_linenumber * 50 AS step,
           '/runs/job-' || l_orderkey || '/checkpoint-' || (l_linenumber * 50) AS path
    FROM lineitem
"""

SPACES_SQL = " || ".join(f"chr({ord(ch)})" for ch in PY_WHITESPACE)


def strip_sql(expr: str) -> str:
    return f"trim({expr}, {SPACES_SQL})"


def tokens_sql(expr: str) -> str:
    return f"greatest(1, CAST(round_even(length({expr}) / 4, 0) AS INTEGER))"


def py_round_sql(expr: str, digits: int) -> str:
    """Half-even on the exact binary value: scaled by 2**80, the double is a whole number."""
    scaled = f"(CAST(({expr}) * {2.0**80!r}::DOUBLE AS HUGEINT) * {10**digits})"
    whole, rest = f"({scaled} // {2**80})", f"({scaled} % {2**80})"
    up = f"CASE WHEN {rest} > {2**79} THEN 1 WHEN {rest} = {2**79} THEN {whole} % 2 ELSE 0 END"
    return f"(CAST({whole} + {up} AS DOUBLE) / {10**digits}.0::DOUBLE)"


DOCUMENTS_SQL = f"""
    SELECT doc_id AS row_id, t AS text, {tokens_sql('t')} AS tokens, length(t) AS output_len
    FROM (SELECT doc_id, coalesce({strip_sql('text')}, '') AS t FROM documents) WHERE t <> ''
"""

# Conversations with the default system turn put first where there is none (turn -1).
CHAT_SQL = f"""
    SELECT conv_id, turn, role, {strip_sql('text')} AS content FROM conversations
    UNION ALL
    SELECT conv_id, -1, 'system', 'You are a helpful assistant.' FROM conversations
    GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'system') = 0
"""
