import json
import time
from pathlib import Path
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunegrain.functions.text import estimate_tokens, token_counter
from tunegrain.operators import ledger, synth, telemetry
from tunegrain.schema import EVENT
from tunegrain.streaming import runs
from tunegrain.streaming.state import MergedState


def event_rows(spark, rows):
    """rows: (id, job, kind, payload)"""
    data = [(i, j, k, json.dumps(p), i) for i, j, k, p in rows]
    return spark.createDataFrame(data, "event_id long, job_id string, kind string, data string, s long").withColumn(
        "ts", F.timestamp_seconds(F.col("s"))
    ).drop("s")


def test_history_and_metrics(spark):
    ev = event_rows(spark, [
        (1, "job1", "log", {"message": "started", "level": "info"}),
        (2, "job1", "metric", {"step": 1, "loss": 2.0}),
        (3, "job1", "metric", {"step": 2, "loss": 1.5}),
        (4, "a", "log", {"message": "x"}),
        (5, "job1", "metric", {"learning_rate": 0.1}),
    ])
    logs = telemetry.history(ev, "job1", {"log"})
    assert [json.loads(r.data)["message"] for r in logs.collect()] == ["started"]
    frame = telemetry.metrics_frame(telemetry.history(ev, "job1"))
    assert [(r.step, r.loss) for r in frame.orderBy("ts").collect()] == [(1, 2.0), (2, 1.5), (None, None)]
    assert telemetry.history(ev, "b").count() == 0
    series = telemetry.metric_series(frame, "learning_rate").collect()
    assert [(r.step, r.learning_rate) for r in series] == [(0, 0.1)]
    latest = telemetry.latest_metrics(telemetry.metrics_frame(ev)).collect()
    assert [(r.job_id, r.loss, r.learning_rate) for r in latest] == [("job1", None, 0.1)]
    assert [r.job_id for r in telemetry.clear_job(ev, "job1").collect()] == ["a"]
    assert [r.event_id for r in telemetry.in_order(ev).collect()] == [4, 1, 2, 3, 5]


def test_event_constructors(spark, tmp_path):
    base = spark.range(1)
    rows = base.select(*telemetry.event(F.col("id"), F.lit("j"), "log", telemetry.log_data(F.lit("hi")), F.current_timestamp()))
    rows = rows.unionByName(base.select(*telemetry.event(F.col("id") + 1, F.lit("j"), "metric", telemetry.metric_data(F.lit(3), loss=F.lit(0.5)), F.current_timestamp())))
    rows = rows.unionByName(base.select(*telemetry.event(F.col("id") + 2, F.lit("j"), "status", telemetry.status_data(F.lit("running")), F.current_timestamp())))
    rows = rows.unionByName(base.select(*telemetry.event(F.col("id") + 3, F.lit("j"), "error", telemetry.error_data(F.lit("no")), F.current_timestamp())))
    telemetry.append_events(rows, str(tmp_path / "ev"))
    got = [json.loads(r.data) for r in telemetry.read_events(spark, str(tmp_path / "ev")).orderBy("event_id").collect()]
    assert got == [{"message": "hi", "level": "info"}, {"step": 3, "loss": 0.5}, {"status": "running"}, {"message": "no"}]


def test_clearing_one_job_in_the_store(spark, tmp_path):
    path = str(tmp_path / "ev")
    ev = event_rows(spark, [(i, f"j{i % 4}", "log", {}) for i in range(40)]).select(*EVENT.names)
    telemetry.append_events(ev, path, buckets=3)
    for job in ("j1", "j2", "j0"):
        telemetry.clear_history(spark, path, job, buckets=3)
    assert {r.job_id for r in telemetry.read_events(spark, path).collect()} == {"j3"}
    assert telemetry.read_events(spark, path).count() == 10
    stored = lambda: sum(1 for _ in Path(path).rglob("part-*"))
    before = stored()
    telemetry.compact(spark, path)
    assert stored() < before and not Path(f"{path}-cleared").exists()
    assert telemetry.read_events(spark, path).count() == spark.read.parquet(path).count() == 10
    telemetry.compact(spark, path)


def test_clearing_writes_one_row_and_spares_what_comes_later(spark, tmp_path):
    path = str(tmp_path / "ev")
    ev = event_rows(spark, [(i, f"j{i % 2}", "log", {}) for i in range(10)]).select(*EVENT.names)
    telemetry.append_events(ev, path)
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("part-*")}
    telemetry.clear_history(spark, path, "j1")
    assert {p: p.stat().st_mtime_ns for p in Path(path).rglob("part-*")} == before
    assert spark.read.parquet(f"{path}-cleared").count() == 1
    time.sleep(1.1)
    telemetry.append_events(ev.where("event_id = 3"), path)
    assert sorted(r.event_id for r in telemetry.read_events(spark, path).collect()) == [0, 2, 3, 4, 6, 8]
    telemetry.compact(spark, path)
    assert sorted(r.event_id for r in telemetry.read_events(spark, path).collect()) == [0, 2, 3, 4, 6, 8]


def test_python_hooks_fall_back_on_errors(spark):
    def count(text):
        if text == "bad":
            raise ValueError(text)
        return len(text.split())

    def reply(system, prompt):
        if "bad" in prompt:
            raise RuntimeError("no model")
        return '[{"instruction": "q", "output": "a"}]'

    df = spark.createDataFrame([(1, "one two three"), (2, "bad"), (3, "x" * 12)], "id int, text string")
    counted = df.select("id", estimate_tokens(F.col("text"), token_counter(count)).alias("n")).orderBy("id").collect()
    assert [r.n for r in counted] == [3, 1, 1]
    pairs = synth.reply_pairs(synth.extract_json(synth.with_replies(df, synth.completion(reply))), ["id"])
    assert sorted(r.id for r in pairs.collect()) == [1, 3]


def test_tombstones_delete(spark):
    puts = spark.createDataFrame([("a", 1, "put", 5), ("b", 1, "put", 6)], "id string, version int, op string, x int")
    gone = ledger.tombstones(puts.where("id = 'a'"), "id", F.lit(2))
    state = ledger.current_state(puts.unionByName(gone, allowMissingColumns=True), "id", ["x"])
    assert [(r.id, r.x) for r in state.collect()] == [("b", 6)]


def test_bounded_history_evicts_before_choosing_kinds(spark):
    ev = event_rows(spark, [(i, "j", "log" if i < 5 else "metric", {}) for i in range(10)])
    assert telemetry.bounded_history(ev, ["log"], 5).count() == 0
    assert sorted(r.event_id for r in telemetry.bounded_history(ev, ["log"], 7).collect()) == [3, 4]
    assert [r.message for r in telemetry.log_tail(ev, 2).collect()] == ["", ""]


def test_ledger_state_matches_a_loop(spark):
    rng = random.Random(4)
    log = [
        (i, f"j{rng.choice([0, 0, 0, rng.randint(0, 30)])}", "delete" if rng.random() < 0.05 else "put",
         rng.choice([None, "running", "paused"]), rng.choice([None, i]))
        for i in range(2000)
    ]
    state = {}
    for version, key, op, status, step in log:
        if op == "delete":
            state.pop(key, None)
            continue
        row = state.setdefault(key, {"status": None, "step": None})
        row.update({k: v for k, v in (("status", status), ("step", step)) if v is not None}, updated_at=version)
    df = spark.createDataFrame(log, "version long, id string, op string, status string, step long")
    got = {r.id: {"status": r.status, "step": r.step, "updated_at": r.updated_at} for r in ledger.current_state(df, "id", ["status", "step"]).collect()}
    assert got == state


def test_job_views(spark):
    jobs = spark.createDataFrame(
        [("a", "", "running", "m", 5, 0, 2, "", "{}", ""), ("b", "n", "paused", "m", 7, 9, 1, "c/checkpoint-7", "{bad", '{"x":1}'),
         ("c", "n", "resumable", "m", 30, 9, 3, "", "", None)],
        "id string, name string, status string, base_model_key string, current_step long, total_steps long, created_at long, "
        "last_checkpoint string, config_json string, metrics_json string",
    )
    rows = [tuple(r) for r in ledger.job_rows(jobs).collect()]
    assert rows == [("c", "n", "resumable", "m", "30/9", "100%"), ("a", "-", "running", "m", "5/?", "0%"), ("b", "n", "paused", "m", "7/9", "77%")]
    ready = jobs.where(ledger.can_resume(F.col("status"), F.col("last_checkpoint"))).collect()
    assert [r.id for r in ready] == ["b"]
    assert ledger.runs_with_checkpoint(jobs).first().label == "n @ 7 steps [paused]"
    details = ledger.find(ledger.job_details(jobs), "id", "b").select(F.to_json("config"), F.to_json("metrics")).first()
    assert tuple(details) == ("{}", '{"x":1}')
    counts = ledger.overview(jobs, jobs.limit(0), jobs.limit(2)).first()
    assert tuple(counts) == (3, 1, 0, 2)


def test_time_label(one):
    assert one([0, 1700000000], ledger.time_label, "bigint") == ["", "2023-11-14 22:13"]


def test_checkpoints(spark):
    listing = spark.createDataFrame(
        [("j", "r/checkpoint-9"), ("j", "r/checkpoint-100"), ("j", "r/checkpoint-x"), ("j", "r/checkpoint-7/sub"), ("k", "r/other")],
        "job_id string, path string",
    )
    assert [tuple(r) for r in ledger.latest_checkpoint(listing).collect()] == [("j", "r/checkpoint-100", 100)]
    steps = listing.withColumn("step", ledger.checkpoint_step(F.col("path"))).where("step is not null")
    assert [r.step for r in ledger.expired_checkpoints(steps, 1).collect()] == [9]


def test_reconcile(spark):
    jobs = spark.createDataFrame(
        [("a", "running", "p1"), ("b", "pausing", "gone"), ("c", "running", ""), ("d", "paused", "gone"), ("e", "completed", "p1")],
        "id string, status string, last_checkpoint string",
    )
    listing = spark.createDataFrame([("p1",), ("",)], "path string")
    got = {r.id: (r.new_status, r.new_error) for r in ledger.reconcile(jobs, listing).collect()}
    lost = ("failed", "Interrupted before first checkpoint.")
    assert got == {"a": ("resumable", ""), "b": lost, "c": lost, "d": ("paused", ""), "e": ("completed", "")}


@pytest.mark.parametrize(
    ("reply", "want"),
    [
        ('[{"a": 1}]', [{"a": 1}]),
        ('```json\n{"a": 1}\n``` and more', {"a": 1}),
        ("```\n[1, 2]\n```", [1, 2]),
        ('Sure: {"a": {"b": 1}} done', {"a": {"b": 1}}),
        ('Pairs: [{"a": 1}, {"a": 2}] ok', [{"a": 1}, {"a": 2}]),
        ('{broken] then [1]', [1]),
        ('[broken {"a": 1}', {"a": 1}),
        ("no json", None),
        ("", None),
        (None, None),
        ("  ", None),
        ("5", 5),
    ],
)
def test_json_in_replies(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "reply string")
    got = synth.extract_json(df).select(F.to_json("parsed").alias("p")).first().p
    assert (json.loads(got) if got is not None else None) == want


def test_reply_pairs(spark):
    reply = json.dumps([{"instruction": "q", "output": "a"}, "x", {"instruction": "", "output": "a"}, {"instruction": 5, "output": 0}, {"instruction": 1, "output": True}])
    df = spark.createDataFrame([(1, reply), (2, '{"instruction": "q", "output": "a"}')], "id int, reply string")
    got = synth.reply_pairs(synth.extract_json(df), ["id"]).collect()
    assert [tuple(r) for r in got] == [(1, 0, "q", "a"), (1, 4, "1", "true")]


def arriving(spark, df, path, files):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", "1").parquet(path)


def test_subscription_sees_only_its_job(spark, tmp_path):
    ev = event_rows(spark, [(i, f"j{i % 3}", "metric", {"step": i}) for i in range(30)]).select(*EVENT.names)
    stream = arriving(spark, ev, str(tmp_path / "in"), 3)
    seen = []
    query = runs.subscribe(stream, lambda batch, _: seen.extend(r.event_id for r in batch.collect()), str(tmp_path / "cp"), job_id="j1", once=True, since=datetime(1970, 1, 1))
    query.awaitTermination()
    assert sorted(seen) == [i for i in range(30) if i % 3 == 1]


def test_stream_state_equals_batch_also_after_a_replay(spark, tmp_path):
    ev = event_rows(spark, [(i, f"j{i % 2 if i % 5 else 0}", "log", {}) for i in range(200)]).select(*EVENT.names)
    stream = arriving(spark, ev, str(tmp_path / "in"), 5)
    state = runs.history_state(str(tmp_path / "state"), EVENT, 30, compact_every=2)
    runs.keep_history(stream, state, str(tmp_path / "cp"), once=True).awaitTermination()
    want = {r.event_id for r in telemetry.last_events(ev, 30).collect()}
    assert {r.event_id for r in state.read(spark).collect()} == want
    # The last batches delivered once more, as after a failure.
    for batch_id in (3, 4):
        state.absorb(spark.read.schema(EVENT).parquet(f"{tmp_path}/state/batch/upto={batch_id}"), batch_id)
    assert {r.event_id for r in state.read(spark).collect()} == want


def test_snapshots(spark, tmp_path):
    ev = event_rows(spark, [
        (1, "j", "status", {"status": "running"}), (2, "j", "metric", {"step": 10, "loss": 2.0, "epoch": 0.0125}),
        (3, "j", "log", {"message": "saved", "checkpoint": "r/checkpoint-10"}), (4, "j", "metric", {"step": 20, "loss": 1.0, "epoch": 0.5}),
        (5, "k", "log", {"message": "x"}),
    ]).select(*EVENT.names)
    state = runs.snapshot_state(str(tmp_path / "s"), compact_every=2)
    updates = runs.snapshot_updates(ev)
    for batch_id, ids in enumerate([(4,), (1, 2), (3, 5)]):
        state.absorb(runs.snapshot_updates(ev.where(F.col("event_id").isin(*ids))), batch_id)
    got = {r.job_id: r for r in runs.snapshots(state.read(spark)).collect()}
    j = got["j"]
    assert (j.current_step, j.current_epoch, j.status, j.last_checkpoint, j.resumable) == (20, 0.5, "running", "r/checkpoint-10", True)
    assert json.loads(j.metrics) == {"loss": 1.0}
    assert got["k"].current_step is None and not got["k"].resumable
    assert updates.schema.simpleString() == T.StructType.fromDDL(runs.SNAPSHOT).simpleString()


def test_empty_state(spark, tmp_path):
    state = MergedState(str(tmp_path / "none"), EVENT, lambda df: df)
    assert state.read(spark).count() == 0
