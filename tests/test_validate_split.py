import random
import statistics

import pytest
from pyspark.sql import functions as F

from tunegrain import FieldMapping
from tunegrain.operators import normalize as norm
from tunegrain.operators import shape, split, validate
from tunegrain.operators.toplist import first_per_key

MAPPING = FieldMapping("completion", text_field="t")


def measured(spark, texts, max_seq_length=2048):
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, t string")
    return validate.measure(norm.normalize(df, MAPPING), max_seq_length)


def plain_report(texts, limit):
    """The same report computed with plain loops."""
    kept = [(i, t.strip()) for i, t in enumerate(texts) if t and t.strip()]
    toks = sorted(max(1, round(len(t) / 4)) for _, t in kept)
    seen, dup = set(), []
    for i, t in kept:
        (dup.append(i) if t in seen else seen.add(t))
    rows = {
        "unparsed_rows": [i for i, t in enumerate(texts) if not (t and t.strip())],
        "empty_output": [i for i, t in kept if len(t) <= 2],
        "tiny_output": [i for i, t in kept if 2 < len(t) < 10],
        "exceeds_seq_len": [i for i, t in kept if max(1, round(len(t) / 4)) > limit],
        "duplicates": dup,
    }
    n = len(kept)
    stats = {
        "min": toks[0], "median": int(statistics.median(toks)), "mean": round(statistics.fmean(toks), 1),
        "p95": toks[min(n - 1, int(0.95 * n))], "max": toks[-1],
    }
    return n, stats, rows


@pytest.mark.parametrize("size", [1, 9, 10, 20, 49, 50, 400])
def test_report_matches_plain_loops(spark, size):
    rng = random.Random(size)
    pool = ["", "  ", "ab", "abcdef", "a longer answer", "b" * 200, "c" * 90]
    texts = [rng.choice(pool) + (str(i) if rng.random() < 0.5 else "") for i in range(size)] + ["end of the list"]
    n, stats, rows = plain_report(texts, 40)
    m = measured(spark, texts, 40)
    got = validate.verdict(validate.summarize(m), 40).first().asDict()
    assert {k: got[f"token_{k}"] for k in stats} == stats
    assert got["n_examples"] == n and got["n_valid"] == n - len(rows["empty_output"])
    assert got["duplicate_count"] == len(rows["duplicates"])
    found = {r.code: r for r in validate.issues(m, 40).collect()}
    for code, ids in rows.items():
        assert (code in found) == bool(ids), code
        if ids:
            assert found[code].n_rows == len(ids) and found[code].rows == ids[:5], code
    assert ("too_few" in found) == (n < 10) and ("small_dataset" in found) == (10 <= n < 50)
    assert got["has_errors"] == (n < 10 or bool(rows["empty_output"]))
    assert got["ok"] == (not got["has_errors"] and got["n_valid"] > 0)
    assert sorted(r.row_id for r in validate.duplicate_rows(m).collect()) == rows["duplicates"]


def test_nothing_usable(spark):
    m = measured(spark, ["", " "])
    got = validate.verdict(validate.summarize(m)).first()
    assert (got.n_examples, got.n_valid, got.ok, got.has_errors, got.token_min) == (0, 0, False, True, None)
    assert [r.code for r in validate.issues(m).orderBy("rank").collect()] == ["unparsed_rows", "no_examples"]
    text = validate.report_markdown(validate.verdict(validate.summarize(m)), validate.issues(m)).first().markdown
    assert text == (
        "**Examples:** 0 · **Usable:** 0\n\n**Findings:**\n"
        "- ⚠️ **unparsed_rows** ×2: 2 raw row(s) were skipped during structuring (empty/invalid). _(e.g. rows [0, 1])_\n"
        "- ❌ **no_examples**: No usable examples after structuring."
    )


def test_p95_is_one_above_the_discrete_percentile_at_multiples_of_20(spark):
    m = measured(spark, ["x" * (4 * (i + 1)) for i in range(20)])
    assert validate.summarize(m).first().token_p95 == 20


def test_chat_duplicates_ignore_roles_and_outer_space(spark):
    conv = [[("user", "a"), ("assistant", "b")], [("assistant", "a"), ("user", "b")], [("user", ""), ("user", "a"), ("assistant", "b")]]
    df = spark.createDataFrame(list(enumerate(conv)), "row_id long, m array<struct<role:string,content:string>>")
    m = validate.measure(norm.normalize(df, FieldMapping("chat", messages_field="m")))
    assert sorted(r.row_id for r in validate.duplicate_rows(m).collect()) == [1, 2]
    assert [r.output_len for r in m.orderBy("row_id").collect()] == [1, 1, 1]


def test_hot_text_is_deduplicated_to_its_first_row(spark):
    m = validate.measure(
        norm.normalize(
            spark.range(0, 30000, 1, 8).selectExpr("id as row_id", "if(id % 3 = 1, 'same text for all', concat('text ', id)) as t"),
            MAPPING,
        )
    )
    kept = validate.keep_first(m)
    assert kept.count() == 20001
    assert kept.where("text = 'same text for all'").first().row_id == 1
    assert validate.duplicate_rows(m).count() == 9999


@pytest.mark.parametrize(("n", "ratio"), [(100, 0.29), (100, 0.05), (1, 0.9), (7, 1.5), (50, 0.0), (1000, 0.333), (2, 0.5)])
def test_split_is_exact_and_complete(spark, n, ratio):
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    got = split.add_split(rows, ratio, seed=11).collect()
    want = min(int(n * ratio), max(0, n - 1)) if ratio > 0 else 0
    assert sum(r.split == "eval" for r in got) == want
    assert len(got) == n
    order = sorted(got, key=lambda r: (r.split_key, r.row_id))
    assert all(r.split == "eval" for r in order[:want])
    plain = split.add_split(rows, ratio, shuffle=False)
    assert sorted(r.row_id for r in plain.where("split = 'eval'").collect()) == list(range(want))


def test_split_does_not_depend_on_partitioning(spark):
    rows = spark.range(500).withColumnRenamed("id", "row_id")
    runs = [
        {r.row_id for r in split.add_split(rows.repartition(p), 0.2).where("split = 'eval'").collect()} for p in (1, 3, 16)
    ]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 100


def test_ordered_split_with_far_apart_ids(spark):
    ids = [-(2**62), 0, 1, 2, 3, 10**6, 10**6 + 1, 2**40, 2**62]
    rows = spark.createDataFrame([(i,) for i in ids], "row_id long")
    got = split.add_split(rows, 0.67, shuffle=False).where("split = 'eval'").collect()
    assert sorted(r.row_id for r in got) == ids[: int(9 * 0.67)]


def test_packs_match_a_plain_loop(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice([1, 3, 10, 40, 64, 90]) for i in range(600)}
    df = spark.createDataFrame(list(sizes.items()), "row_id long, tokens int").repartition(5)
    got = shape.pack(df, 64).collect()
    assert {r.row_id for r in got} == set(sizes) and len(got) == 600
    packs = {}
    for r in sorted(got, key=lambda r: (r.shard, r.pack, r.start)):
        packs.setdefault((r.shard, r.pack), []).append(r)
    for members in packs.values():
        filled = 0
        for r in members:
            assert r.start == filled
            filled += min(r.tokens, 64)
        assert filled <= 64
    # Greedy: the first row of the next pack did not fit into the one before.
    for (shard, pack), members in packs.items():
        following = packs.get((shard, pack + 1))
        if following:
            assert sum(min(r.tokens, 64) for r in members) + min(following[0].tokens, 64) > 64


def test_packs_do_not_depend_on_other_shards(spark):
    rows = spark.range(500).selectExpr("id AS row_id", "CAST(id % 90 + 1 AS INT) AS tokens")
    all_rows = {r.row_id: (r.shard, r.pack, r.start) for r in shape.pack(rows, 100, 1).collect()}
    some = {i for i, (shard, _, _) in all_rows.items() if shard in "0123"}
    part = shape.pack(rows.where(F.col("row_id").isin(sorted(some))), 100, 1).collect()
    assert {r.row_id: (r.shard, r.pack, r.start) for r in part} == {i: all_rows[i] for i in some}


def test_split_in_order_of_text_ids(spark):
    rows = spark.range(40).selectExpr("format_string('r%03d', id) AS row_id")
    marked = {r.row_id: r.split for r in split.add_split(rows, 0.25, shuffle=False).collect()}
    assert sorted(i for i, s in marked.items() if s == "eval") == [f"r{i:03d}" for i in range(10)]



def test_steps(spark):
    def steps(n, batch, acc, epochs, cap):
        cols = [F.lit(v) for v in (n, batch, acc, epochs, cap)]
        return spark.range(1).select(shape.total_steps(*cols).alias("s")).first().s

    assert steps(1000, 2, 8, 2.0, -1) == 126
    assert steps(0, 2, 8, 0.1, -1) == 1
    assert steps(1000, 2, 8, 2.0, 60) == 60


def test_length_buckets(one):
    assert one([1, 2, 3, 4, 7, 8, 2**40], shape.length_bucket, "bigint") == [0, 1, 1, 2, 2, 3, 40]


def test_top_list_is_the_same_with_and_without_slices(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("id", "if(id % 3 > 0, 0, id % 50) as k", "(id * 7919) % 10007 as v")
    order = [F.desc("v"), F.asc("id")]
    plain = {(r.k, r.id) for r in first_per_key(df, ["k"], order, 30, slices=1).collect()}
    sliced = {(r.k, r.id) for r in first_per_key(df, ["k"], order, 30, slices=4).collect()}
    assert plain == sliced and len([1 for k, _ in plain if k == 0]) == 30


@pytest.mark.parametrize("few", [2, 10_000])
def test_lowest_of_repeated_and_skewed_ids(spark, few, monkeypatch):
    """The search ends in a small range, in a range of one id, or at the greatest id of a range that can't be cut."""
    monkeypatch.setattr(split, "FEW_IDS", few)
    ids = [f"k{i:04d}" for i in range(90)] + ["hot"] * 200 + ["zz"] * 3 + ["a", "b"]
    df = spark.createDataFrame([(i,) for i in ids], "row_id string")
    for ratio in (0.003, 0.3, 0.68, 0.99):
        want = int(len(ids) * ratio)
        assert split._nth_lowest_of_any(df, "row_id", ratio) == (sorted(ids)[want - 1] if want else None)


def test_selection_of_text_ids_sorts_no_large_range(spark, monkeypatch):
    """Only ranges of at most FEW_IDS ids are sorted."""
    monkeypatch.setattr(split, "FEW_IDS", 50)
    offsets = []
    cls = type(spark.range(1))
    monkeypatch.setattr(cls, "offset", lambda self, n, real=cls.offset: offsets.append(n) or real(self, n))
    df = spark.range(5000).selectExpr("concat('id', cast(id * 7919 % 5000 as string)) as row_id")
    want = sorted(r.row_id for r in df.collect())
    assert split._nth_lowest_of_any(df, "row_id", 0.37) == want[int(5000 * 0.37) - 1]
    assert all(n < 50 for n in offsets)
