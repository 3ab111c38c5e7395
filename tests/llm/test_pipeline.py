"""The corpus pipeline, stage by stage, against brute-force versions on a small corpus."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest

import __spark_entry__ as registered
import corpus_pipeline
from tunegrain.llm import mixing, packing

WORDS = ["ba", "lo", "mi", "ter", "son", "qu"]
RUDE = ["idiot", "moron", "scum", "you"]


def prose(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the rows of every stage, by doc_id (the last one: a list)."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(5, 90)) for _ in range(120)]
    passage = prose(rng, 60)
    for i in range(0, 120, 4):
        words = texts[i].split(" ")
        texts[i] = " ".join(w if rng.random() > 0.25 else rng.choice(RUDE) for w in words) + " idiot moron"
    texts += [texts[i] for i in (1, 2, 3)] + [texts[5] + " more"] + [prose(rng, 20) + " " + passage + " " + prose(rng, 5) for _ in range(6)] + [None, ""]
    rows = [(i, t, "en" if i % 3 else "fr", f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 4 == 0)) for i in range(120)]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {"input": {r.doc_id: r for r in docs.collect()}}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert k == 0 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found = docs.collect()
        out[name] = found if name == "packing" else {r.doc_id: r for r in found}
        assert len(out[name]) == len(found)
    out["folder"] = folder
    return out


def test_toxic_documents_go_and_clean_ones_stay(stages):
    kept = stages["toxicity"]
    assert {i for i in range(120) if i % 4} | {126, 127, 128, 129, 130} <= kept.keys()
    assert len([i for i in range(0, 120, 4) if i in kept]) <= 2


def test_one_of_each_near_group_stays(stages):
    def shingles(text):
        w = (text or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows = stages["toxicity"]
    sets = {i: shingles(r.text) for i, r in rows.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    assert stages["ngram_jaccard"].keys() == {i for i, r in root.items() if i == r}


def test_repeated_bytes_go(stages):
    seen, want = set(), {}
    for i, r in sorted(stages["ngram_jaccard"].items()):
        text = r.text or ""
        gone = bytearray(len(text))
        for s in range(len(text) - 99):
            if text[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(text[s : s + 100])
        left = "".join(c for c, g in zip(text, gone, strict=True) if not g)
        if left or not text:
            want[i] = left
    assert {i: r.text or "" for i, r in stages["suffix_dedup"].items()} == want
    assert all(r.n_chars == len(r.text or "") for r in stages["suffix_dedup"].values())


def test_sources_are_mixed_by_prefixes(spark, stages):
    plan = corpus_pipeline.MIX
    leaves = collections.defaultdict(list)
    for i, r in stages["suffix_dedup"].items():
        domain = next((d for d, p in plan.domains.items() if re.search(p, r.source)), "other")
        leaves[domain, r.lang, r.source].append((hashlib.md5(f"{plan.seed}:{i}".encode()).hexdigest(), len((r.text or "").split()), i))
    table = spark.createDataFrame([(*k, sum(t for _, t, _ in v)) for k, v in leaves.items()], "domain string, lang string, source string, tokens bigint")
    budget = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(table, plan).collect()}
    want = set()
    for leaf, members in leaves.items():
        upto = 0
        for _, t, i in sorted(members):
            upto += t
            if upto <= budget[leaf]:
                want.add(i)
    assert stages["mixing"].keys() == want
    assert sum(budget.values()) <= sum(t for v in leaves.values() for _, t, _ in v) * plan.percent // 100


def test_everything_left_is_packed(stages):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in stages["packing"]:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == stages["mixing"].keys()
    for pieces in by_doc.values():
        assert sum(r.length for r in pieces) == pieces[0].doc_tokens
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE


def test_run_applies_the_stages(spark, stages):
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in registered.queries()["pipeline"](spark, stages["folder"]).collect())
    assert got == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in stages["packing"])
