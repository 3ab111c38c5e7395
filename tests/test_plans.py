"""Properties of physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from tunegrain.operators import ledger, split, telemetry, validate
from tunegrain.plans import chat_queries, run_queries, text_queries
from tunegrain.session import INITIAL_PARTITIONS, fit_shuffles

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    return {c for schema in re.findall(r"ReadSchema: struct<([^\n]*?)>\n?", plan_of(df)) for c in re.findall(r"(\w+):", schema)}


@pytest.mark.parametrize(
    ("query", "columns"),
    [
        (text_queries.token_estimate, {"doc_id", "text"}),
        (text_queries.split_membership, {"row_id", "empty_output"}),
        (text_queries.duplicate_rows, {"row_id", "drop_reason", "dup_key"}),
        (run_queries.last_n_events, {"event_id", "ts", "user_id", "event_type"}),
        (run_queries.latest_checkpoint, {"l_orderkey", "l_linenumber"}),
        (run_queries.jobs_by_status, {"o_orderstatus"}),
        (chat_queries.chat_accessors, {"conv_id", "turn", "role", "text"}),
    ],
)
def test_scans_read_only_what_they_need(spark, query, columns):
    assert scanned(query(spark, FOLDER)) == columns


@pytest.mark.parametrize(
    "query",
    [
        text_queries.normalize_completion, text_queries.token_estimate, text_queries.truncate_text, text_queries.slug_ids,
        text_queries.paragraph_split, text_queries.synth_pairs, run_queries.kind_history, run_queries.metric_series,
        run_queries.event_metric_cast, run_queries.job_progress,
    ],
)
def test_row_local_queries_do_not_shuffle(spark, query):
    assert "Exchange" not in plan_of(query(spark, FOLDER))


def test_kind_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "ev")
    telemetry.append_events(spark.range(9).selectExpr("id event_id", "string(id % 3) job_id", "'log' kind", "'{}' data", "now() ts"), path)
    plan = plan_of(telemetry.history(telemetry.read_events(spark, path), "1", ["log"]))
    assert "EqualTo(job_id,1)" in plan and "EqualTo(kind,log)" in plan


def test_duplicates_combine_before_the_shuffle_and_leave_the_text(spark):
    stored = spark.createDataFrame([(1, None, bytearray(b"k"))], "row_id long, drop_reason string, dup_key binary")
    plan = plan_of(validate.duplicate_rows(stored))
    assert plan.count("partial_min") == 1 and "HashAggregate" in plan and "SortAggregate" not in plan
    assert "Window" not in plan


def test_latest_rows_are_limited_on_the_map_side(spark):
    ev = spark.range(10**6).selectExpr("id event_id", "string(id) job_id", "'log' kind", "'{}' data", "now() ts")
    plan = plan_of(telemetry.last_events(ev, 5000))
    assert plan.count("WindowGroupLimit") == 4 and plan.count("Partial") >= 2


def test_split_broadcasts_one_row_only(spark):
    plan = plan_of(split.add_split(spark.range(100).withColumnRenamed("id", "row_id"), 0.1))
    assert "SinglePartition" in plan and "Sort [row_id" not in plan


def test_ledger_state_is_one_aggregation(spark):
    changes = spark.createDataFrame([(1, 1, "put", 1)], "id int, version int, op string, x int")
    plan = plan_of(ledger.current_state(changes, "id", ["x"]))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_shuffles_follow_the_input_size(spark):
    before = spark.conf.get(INITIAL_PARTITIONS, None)
    try:
        fit_shuffles(spark.range(10))
        assert spark.conf.get(INITIAL_PARTITIONS, None) == before
        # About 100 TB by the optimizer's estimate; nothing is executed.
        fit_shuffles(spark.range(12 * 10**12).select("id"))
        assert int(spark.conf.get(INITIAL_PARTITIONS)) == 65536
    finally:
        spark.conf.unset(INITIAL_PARTITIONS)
        if before:
            spark.conf.set(INITIAL_PARTITIONS, before)


def test_hot_run_is_spread_over_slices(spark):
    """A third of all events belong to one run; every reducer of the first step stays small."""
    ev = spark.range(0, 90_000, 1, 30).selectExpr(
        "id event_id", "if(id % 3 = 0, 'hot', string(id % 1000)) job_id", "'log' kind", "'{}' data", "timestamp_seconds(id) ts"
    )
    got = telemetry.last_events(ev, 50).where("job_id = 'hot'").agg(F.count("*"), F.min("event_id")).first()
    assert tuple(got) == (50, 90_000 - 150)
