"""Each operator against a brute-force version, and on nulls, empty texts, repeats, empty tables and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tunegrain.llm import (
    embedding_dups, jaccard_join, language_id, license_scan, mixing, packing, suffix_dedup, tokens, topk, toxicity, url_filter, words,
)
from tunegrain.llm.shared import connected_components, numbered, split_by_membership

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key string, size string, component string, score string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ba", "lo", "mi", "ter", "son", "qu", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Prose, exact and near copies, shared passages, short, empty, null and very long texts."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(3, 160)) for _ in range(40)]
    passage = prose(rng, 40)
    out = [*base, *base[:6], base[3], base[3]]
    for t in base[6:16]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w).title())
    out += [prose(rng, 30) + " " + passage + " " + prose(rng, rng.randint(0, 20)) for _ in range(12)]
    out += [None, "", "  \n\t", "a", "One two", "one two", "x" * 250, "y" * 90 + "z" + "y" * 130, "Ünïcödé " * 30, passage * 40, "\u4e2d\u6587" * 80]
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def documents(spark, texts):
    rows = [(i, t, None if i % 9 == 0 else ("en", "fr")[i % 2], f"src{i % 3}" if i % 7 else None, 0, "q", "k", "s", "c", "z") for i, t in texts.items()]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("settings", [jaccard_join.Settings(), jaccard_join.Settings(percent=50, heavy=1), jaccard_join.Settings(verify_cost=200.0), jaccard_join.Settings(post_cost=1000.0)])
def test_jaccard_join(documents, texts, settings):
    sets = {i: shingles(t) for i, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= settings.percent * len(sets[a] | sets[b])]
    root = roots(pairs, sets)
    got = {r.id: (r.size, r.component) for r in jaccard_join.join(documents, settings).collect()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}


def test_jaccard_join_splits_long_lists(spark):
    """Near copies with one change each, and lists that are split because their counters are high."""
    rng = random.Random(3)
    base = prose(rng, 60).split(" ")
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(60)] = f"change{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = roots(pairs, sets)
    got = {r.id: r.component for r in jaccard_join.join(df, jaccard_join.Settings(heavy=1)).collect()}
    assert got == root


def regular_words():
    """Two words of 2,048 letters, each the other's with letters exchanged, in which sums of powers of many bases agree."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_regular_words_stay_apart(spark):
    one, two = regular_words()
    rows = [(1, one), (2, two), (3, f"{one} x y"), (4, f"{two} x y"), (5, one)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.id: r.component for r in jaccard_join.join(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    data, offsets = words.utf8(pa.array([one, two, one[:64], two[:64], one[:7], two[:7], one[:8], one[:9]]))
    assert len(set(words.word_hashes(data, offsets)[0].tolist())) == 8


def test_jaccard_join_of_many_that_share_much_and_link_with_none(spark, monkeypatch):
    """Texts that each share nine tenths with one text that isn't there: their lists are long, and none links."""
    monkeypatch.setattr(jaccard_join, "PART", 100)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(2000):
        w = list(base)
        for k, at in enumerate(rng.sample(range(0, 395, 5), 12)):
            w[at] = f"own{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(5000, rows[7][1] + " end"), (5001, rows[9][1])]
    found = {r.id: r.component for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = {i: shingles(rows[i][1]) for i in range(30)}
    assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in sets for b in sets if a < b)
    assert found == {i: i for i in range(2000)} | {5000: 7, 5001: 9}


def test_parity_bitmaps_bound_what_sets_share():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, size=400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, size=n)) for n in (0, 1, 5, 90, 200, 380, 380)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    maps = [np.array(x, dtype=np.int64).view(np.uint8) for x in jaccard_join._bitmaps(np.concatenate(sets), first).to_pylist()]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            apart = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
            bits = int(np.unpackbits(maps[i] ^ maps[j]).sum())
            assert bits <= apart and (i != j or bits == 0)


def test_levels_end_where_posting_costs_more():
    sizes = np.array([0, 1, 100, 3000])
    first = np.concatenate([[0], np.cumsum(sizes)])
    least = -(-80 * sizes // 100)
    rare, common = np.ones(3101, dtype=np.int64), np.full(3101, 10**6)
    assert jaccard_join._levels(rare, sizes, least, first, jaccard_join.Settings()).tolist() == [1, 1, 1, 1]
    high = jaccard_join._levels(common, sizes, least, first, jaccard_join.Settings())
    assert high[1] == 1 and high[2] > 4 and high[3] > 100 and (high <= np.maximum(least, 1)).all()


def test_jaccard_join_edges(spark, nothing):
    assert jaccard_join.join(nothing).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id bigint, text string")
    assert sorted((r.id or 0, r.size, r.component or 0) for r in jaccard_join.join(df).collect()) == [(0, 2, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1)]
    kept = jaccard_join.keep_first(df).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 1]


def repeats(texts, length=100):
    seen, out = {}, {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.setdefault(raw[s : s + length], i)
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("frequent", [1, 4096])
def test_suffix_dedup(documents, texts, frequent):
    facts, _ = suffix_dedup.dedup(documents, frequent=frequent)
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in facts.collect()} == repeats(texts)


def test_suffix_dedup_edges(spark, nothing):
    facts, changed = suffix_dedup.dedup(nothing)
    assert facts.collect() == [] and changed.collect() == []
    a = "abcdefghij" * 9 + "0123456789"
    rows = [(5, a + "tail", 104), (None, a, 100), (7, a, 100), (8, None, None), (9, "é" * 40 + a, 140)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    got = {r.id: r.n_removed for r in suffix_dedup.dedup(df)[0].collect()}
    assert got == {None: 0, 5: 100, 7: 100, 8: 0, 9: 100}
    left = {r.doc_id: (r.text, r.n_chars) for r in suffix_dedup.remove_repeats(df).collect()}
    assert left == {None: (a, 100), 5: ("tail", 4), 8: (None, None), 9: ("é" * 40, 40)}


@pytest.mark.parametrize("size", [1, 2, 3, 100])
@pytest.mark.parametrize("flip", [1, -1])
def test_suffix_anchors_count_what_any_copy_stands_for(size, flip):
    # (hash, key, place, times): of equal rows of several tasks, one stands for a loose row as well.
    groups = [[(1, 5, 0, 1), (1, 5, 0, 1)], [(2, 5, 7, 2), (2, 5, 7, 1)], [(3, 5, 9, 1), (3, 6, 2, 1), (3, 6, 2, 4)], [(4, 5, 11, 1)], [(5, 5, 13, 3), (5, 5, 13, 1)]]
    rows = [(h, *r) for g in groups for h, *r in sorted(g, key=lambda r: (r[:3], flip * r[3]))]
    batches = [pa.record_batch([pa.array(c) for c in zip(*[(h, h, k, p, t) for h, k, p, t in rows[i : i + size]], strict=True)], names=["deal", "hash", "key", "place", "times"]) for i in range(0, len(rows), size)]
    got = {tuple(r.values()) for b in suffix_dedup._groups(iter(batches), 4) for r in b.to_pylist()}
    assert got == {(2, 5, 7, False), (3, 5, 9, True), (3, 6, 2, True), (5, 5, 13, False)}


def test_suffix_dedup_of_a_text_copied_in_another_task(spark):
    rng = random.Random(21)
    here, there = [], []
    for n in range(0, 120, 3):
        a, shared = prose(rng, 60), prose(rng, 60)
        one, other = (here, there) if n % 2 else (there, here)
        one += [(n, a + shared), (n + 1, prose(rng, 30) + shared)]
        other.append((n + 2, a + shared))
    rows = spark.createDataFrame(spark.sparkContext.parallelize([here, there], 2).flatMap(lambda x: x), "doc_id bigint, text string")
    facts, _ = suffix_dedup.dedup(rows)
    want = repeats(dict(here + there))
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in facts.collect()} == want


def test_suffix_dedup_of_different_texts_under_one_id(spark):
    rng = random.Random(22)
    shared, x, y, z = (prose(rng, 60) for _ in range(4))
    # Under 7 and under null: an exact copy or a text with a repeat, and one that nothing repeats.
    rows = [(1, x), (7, x), (7, y), (8, y), (None, shared + "A"), (None, z), (9, "b" + shared), (None, "c" + shared), (7, "d" + shared)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text"))
    left = [(r.doc_id, r.text) for r in suffix_dedup.remove_repeats(df).collect()]
    assert [t for i, t in left if i == 1] == [x]
    assert sorted(t for i, t in left if i == 7) == sorted([y, "d"]) and not [t for i, t in left if i == 8]
    of_null = sorted(t for i, t in left if i is None)
    assert z in of_null and sorted(t for t in of_null if t != z) in (sorted([shared + "A", "c"]), sorted(["A", "c" + shared]))
    assert [t for i, t in left if i == 9] == ["b"]
    facts = suffix_dedup.dedup(df)[0].collect()
    assert sorted(r.n_removed for r in facts if r.id == 7) == sorted([0, len(x.encode()), len(shared.encode())])


def test_column_wise_blocks_hold_every_column():
    import io

    segments = [b"banana", b"ananas", b"banana"]
    blocks = io.BytesIO()
    gone, at = suffix_dedup.column_wise(segments, np.array([2, 2, 2]), np.array([1, 2, 3]), 3, blocks)
    assert sorted(zip(gone.tolist(), at.tolist(), strict=True)) == [(2, 0), (2, 1), (2, 2)]
    assert len(blocks.getvalue()) == 2 * 3 * 6  # a symbol and a prefix for each segment and column


def test_tokens_are_the_library_s(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import pyarrow as pa

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rng = random.Random(1)
    bits = ["'", "s", "t", "re", "ve", "ll", " ", "  ", "\n", "a", "Z", "é", "1", "½", ".", "_", "\x85", "\x1c", "<|endoftext|>", "中", "\u2003", "'s", "\r", "ʼ", "word"]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(1500)] + ["", None]
    data, offsets = words.utf8(pa.array(cases))
    by = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = []
    for low, high in words.slices(offsets, 3000):
        part = offsets[low : high + 1]
        ids, first = by.encode(data[part[0] : part[-1]], part - part[0])
        got += [ids[first[i] : first[i + 1]].tolist() for i in range(high - low)]
    assert got == [library.encode(c or "", add_special_tokens=False).ids for c in cases]


def test_tokens_of_regular_words():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    one, two = regular_words()
    for text in (one, two, f"{two} {one}", one):
        ids, _ = by.encode(*words.utf8(pa.array([text])))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing(documents, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rows = packing.pack(documents).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE


def test_packing_edges(spark, nothing):
    assert packing.pack(nothing).collect() == []
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id bigint, text string")
    rows = packing.pack(df).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (1, 2), (1, 2)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3


@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_the_histogram(seed):
    rng = random.Random(seed)
    histogram = {s: rng.randint(1, 60) for s in rng.sample(range(1, 1024), rng.choice([1, 5, 60, 200]))}
    cut = packing.after_cuts(histogram, packing.choose_cuts(histogram))
    assert sum(s * n for s, n in cut.items()) == sum(s * n for s, n in histogram.items())
    held = collections.Counter()
    for pattern, times in packing.solve(cut):
        assert sum(s * k for s, k in pattern.items()) <= 1024
        for s, k in pattern.items():
            held[s] += k * times
    assert held == collections.Counter(cut)


def test_mixing_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(0, 30)), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src12", "other", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    plan = mixing.Plan(percent=70, epochs=2)
    domain = lambda s: next((d for d, p in plan.domains.items() if re.search(p, s)), "other")
    leaves = collections.defaultdict(list)
    for i, text, lang, source in rows:
        leaves[domain(source or ""), lang or "", source or ""].append((hashlib.md5(f"mix-1:{i}".encode()).hexdigest(), len(text.split()), i))

    def deal(budget, children):  # name -> (most, weight)
        share, order = {}, sorted(children, key=lambda c: (children[c][0] / children[c][1], c))
        weights = sum(w for _, w in children.values())
        for k, c in enumerate(order):
            most, w = children[c]
            if most * weights > budget * w:
                return share | {c: budget * children[c][1] // weights for c in order[k:]}
            share[c], budget, weights = most, budget - most, weights - w
        return share

    most = {k: 2 * sum(t for _, t, _ in v) for k, v in leaves.items()}
    total = sum(most.values()) // 2 * 70 // 100
    top = deal(total, {d: (sum(m for k, m in most.items() if k[0] == d), plan.domain_weights.get(d, 1)) for d in {k[0] for k in most}})
    want = {}
    for d, budget in top.items():
        langs = {k[1] for k in most if k[0] == d}
        for lang, b in deal(budget, {x: (sum(m for k, m in most.items() if k[:2] == (d, x)), plan.language_weights.get(x, 1)) for x in langs}).items():
            for source, c in deal(b, {k[2]: (m, 1) for k, m in most.items() if k[:2] == (d, lang)}).items():
                members = sorted(leaves[d, lang, source])
                tokens_ = sum(t for _, t, _ in members)
                whole, spare, upto = (c // tokens_, c % tokens_, 0) if tokens_ else (0, 0, 0)
                for _, t, i in members:
                    upto += t
                    want[i] = min(2, whole + (upto <= spare))
    got = {r.doc_id: r.times for r in mixing.select(df, plan).collect()}
    assert got == {i: n for i, n in want.items() if n}
    taken = collections.Counter(r.doc_id for r in mixing.take(df, plan).collect())
    assert taken == collections.Counter(got)


def test_mixing_edges(spark, nothing, documents):
    assert mixing.select(nothing).collect() == [] and mixing.take(nothing, mixing.Plan()).collect() == []
    assert mixing.take(documents, mixing.Plan(epochs=1)).columns == documents.columns


def labelled(spark, n=600):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 1
        w = prose(rng, rng.randint(20, 80)).split(" ")
        if toxic:
            for _ in range(max(2, len(w) // 12)):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "zorp", "you", "m0ron"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_on_held_out_rows(spark, nothing):
    docs, labels = labelled(spark)
    model = toxicity.learn(docs, labels, F.col("doc_id") % 4 != 0)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("doc_id % 4 = 0").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns
    assert clean.count() == toxicity.score(docs, model).where(F.col("score") < model.cut).count()
    assert toxicity.score(nothing, model).collect() == []


def test_toxicity_shows_in_stems(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(600):
        w = prose(rng, rng.randint(20, 80)).split(" ")
        if i % 5 == 1:
            for _ in range(3):
                w[rng.randrange(len(w))] = "zzvexi" + rng.choice("abcdefghij") + rng.choice("klmnop") * rng.randint(1, 5)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 1)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels, F.col("doc_id") % 4 != 0)
    got = toxicity.score(docs, model).join(labels, "doc_id").where("doc_id % 4 = 0").collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95


def test_toxicity_sample_bounds_rows(spark, monkeypatch):
    docs, labels = labelled(spark, 100)
    docs = docs.union(spark.range(3000).select(F.lit(11).alias("doc_id"), F.lit("again and again").alias("text")))
    seen = []
    monkeypatch.setattr(toxicity.Trees, "fit", lambda self, x, y, fit=toxicity.Trees.fit: seen.append(len(y)) or fit(self, x, y))
    toxicity.learn(docs, labels, F.lit(True), toxicity.Settings(sample=60))
    assert max(seen) <= 60


def test_a_filter_s_cut_meets_its_aim_or_spares_clean_rows():
    score, y = np.array([0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9]), np.array([0, 0, 0, 1, 0, 1, 1, 1])
    assert toxicity.chosen_cut(score, y, recall=1.0, lose=0.3) == 0.4
    assert toxicity.chosen_cut(score, y, recall=0.75, lose=0.3) == 0.5
    assert 0.3 < toxicity.chosen_cut(np.minimum(score, 0.45), y, recall=1.0, lose=0.0) <= 0.5


def test_toxicity_features_by_hand():
    """Densities of words, stems, second persons near them, capitals, signs and disguises."""
    text = "You IDIOT! you are zorpish, 1d1ot? clean words he-re you"
    stem = words.span_hashes(np.frombuffer(b"zorpi", np.uint8), np.array([0]), np.array([5]), words.FOLDED, seed=5)
    row = dict(zip(toxicity.FEATURES, toxicity.features(*words.utf8(pa.array([text])), toxicity._hash_words(["idiot"]), stem)[0]))
    runs = re.findall("[A-Za-z]+", text)
    n, size, letters = len(runs), len(text), sum(map(str.isalpha, text))
    assert row["insults"] == pytest.approx(1 / n) and row["learnt"] == pytest.approx(1 / n) and row["hits"] == pytest.approx(math.log(3))
    assert row["near_you"] == pytest.approx(2 / n) and row["you"] == pytest.approx(3 / n)
    assert row["capitals"] == pytest.approx(6 / letters) and row["shouted"] == pytest.approx(1 / n)
    assert row["exclaimed"] == pytest.approx(2 / size) and row["punctuation"] == pytest.approx(sum(not c.isalnum() and c != " " for c in text) / size)
    assert row["disguised"] == pytest.approx(1 / n) and row["signs_in_words"] == pytest.approx(1 / n) and row["length"] == pytest.approx(math.log(1 + n))


def test_trees_against_a_loop():
    """Scores of boosted trees, recomputed tree by tree and row by row."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    trees = toxicity.Trees(toxicity.Settings(trees=8)).fit(x, y)
    raw = trees.raw(x)
    for i in range(0, 300, 37):
        total = trees.start
        for feature, cut, leaf in trees.trees:
            node = 0
            for level in range(trees.settings.depth):
                at = 2**level - 1 + node
                node = node * 2 + int(x[i, feature[at]] > cut[at])
            total += leaf[node]
        assert raw[i] == pytest.approx(total)
    assert ((raw > 0) == (y > 0)).mean() > 0.85


def test_toxicity_without_labels(spark, documents):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int")
    got = toxicity.score(documents, toxicity.learn(documents, none, F.lit(True))).collect()
    assert len(got) == documents.count() and {r.score for r in got} == {0.0}


def test_isotonic_rises():
    at, to = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(to) >= 0).all() and (np.diff(at) > 0).all()


def test_language_id(spark, nothing):
    rng = random.Random(2)
    parts = {"aa": ["the", "ing", "tion", "and"], "bb": ["ein", "sch", "ung", "der"], "cc": ["éau", "ment", "que", "les"]}
    rows = [(i, " ".join("".join(rng.choices(parts[x], k=rng.randint(1, 3))) for _ in range(rng.randint(4, 40))).capitalize(), x) for i in range(300) for x in [list(parts)[i % 3]]]
    rows += [(1000, None, "aa"), (1001, "123 !?", "aa"), (1002, "", None), (1003, "\u4e2d", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(df, language_id.learn(df, F.col("doc_id") % 2 == 0)).collect()}
    assert np.mean([got[i].lang_pred == x for i, _, x in rows if i % 2 and i < 1000]) > 0.95
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.predict(nothing, language_id.learn(nothing, F.lit(True))).collect() == []


def test_language_grams_by_hand():
    import pyarrow as pa

    data, offsets = words.utf8(pa.array(["Ab, c", "", None, "ab"]))
    row, gram, count = language_id.grams(data, offsets)
    # a b c; _a ab b_ _c c_; _ab ab_ _c_
    assert count[row == 0].sum() == 11
    assert count[row == 3].sum() == 2 + 3 + 2
    assert set(gram[row == 3]) <= set(gram[row == 0])


def vectors(rng, n):
    out = [rng.normal(size=8).astype("float32").tolist() for _ in range(n)]
    for i in range(0, n, 3):
        out[i] = (np.array(out[(i * 7) % n]) + rng.normal(size=8) * 0.02).astype("float32").tolist()
    out[5] = out[6] = out[7]
    return out + [None, [], [0.0] * 8, [math.nan] * 8, [math.inf] + [1.0] * 7, [None] + [1.0] * 7, [1.0] * 4, [1.0] * 4]


def test_rows_that_repeat_an_id_are_vectors_of_their_own(spark):
    rows = [(5, "A", [1.0, 0.0]), (5, "B", [1.0, 0.0]), (5, "C", [0.0, 1.0]), (7, "A", [1.0, 0.001]), (9, "B", [1.0, 0.002]), (11, "C", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<double>")
    got = sorted((r.id, r.n_links, r.component) for r in embedding_dups.near_duplicates(df).collect())
    assert got == [(5, 0, 5), (5, 1, 5), (5, 1, 5), (7, 1, 5), (9, 1, 5), (11, 0, 11)]


def test_embeddings_of_extreme_numbers_and_many_components(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=4099)
    rows = [(1, (base * 1e200).tolist()), (2, (base * 1e-200).tolist()), (3, (base + 0.1 * rng.normal(size=4099)).tolist()), (4, rng.normal(size=4099).tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, label int")
    assert sorted((r.id, r.n_links, r.component) for r in embedding_dups.near_duplicates(df).collect()) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_top_k_of_rows_that_repeat_an_id(spark):
    rows = [(10, [1.0, 2.0]), (10, [3.0, 1.0]), (11, [1.0, 1.0]), (12, [0.0, 5.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), every=10).collect())
    s = lambda a, b: int(np.dot(np.floor(256 * np.array(a)), np.floor(256 * np.array(b))))
    want = []
    for n, (i, v) in enumerate(rows[:2]):
        ranked = sorted((-s(v, w), j) for m, (j, w) in enumerate(rows) if m != n)
        want += [(i, r + 1, j, -x) for r, (x, j) in enumerate(ranked)]
    assert got == sorted(want)


def test_embedding_near_duplicates(spark):
    x = vectors(np.random.default_rng(1), 240)
    rows = [(i, v, None if i % 50 == 49 else i % 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("rep", F.lit(1))
    good = lambda v: bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)
    ok = {i: np.array(v) for i, v, label in rows if good(v) and label is not None}
    pairs = [
        (a, b) for a in ok for b in ok
        if a < b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / math.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.98
    ]
    links = collections.Counter(n for p in pairs for n in p)
    root = roots(pairs, range(len(rows)))
    for block in (2048, 16):
        got = {r.id: (r.n_links, r.component, r.kept) for r in embedding_dups.near_duplicates(df, block=block).collect()}
        assert got == {i: (links[i], root[i], root[i] == i) for i in range(len(rows))}
    assert embedding_dups.near_duplicates(df.limit(0)).collect() == []


def test_quantisation_bound_holds():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 16))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    parts = embedding_dups.quantised(x)
    i, j = embedding_dups.candidate_pairs(parts, parts, 0.5)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    assert all((a, b) in found for a, b in zip(*np.nonzero(unit @ unit.T >= 0.5), strict=True))


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = [(v * rng.choice([0.01, 1, 30])).astype("float32").tolist() for v in rng.normal(size=(400, 8))]
    x[10] = x[20] = x[30]
    x[40], x[50], x[60], x[70] = None, [math.nan] * 8, [0.0] * 8, [1.0] * 3
    rows = list(enumerate(x))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(1))
    ok = {i: np.floor(256 * np.array(v, dtype=float)).astype(np.int64) for i, v in rows if v and all(map(math.isfinite, v))}
    want = {}
    for q in ok:
        if q % 10 == 0:
            scored = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))[:5]
            for n, (s, i) in enumerate(scored):
                want[q, n + 1] = (i, -s)
    for block, at_once in ((4096, 4096), (32, 8)):
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.search(df, every=10, block=block, queries_at_once=at_once).collect()}
        assert got == want
    assert topk.search(df.limit(0)).collect() == []


def test_top_k_of_more_than_a_thousand_lengths(spark):
    rows = [(2 * w + i, [1.0 + i] * w) for w in range(1, 1012) for i in (0, 1)]
    found = topk.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), every=674).collect()
    assert {(r.query_id, r.vec_id, r.score) for r in found} == {(q, q + 1, 2 * 256 * 256 * (q // 2)) for q in range(674, 2023, 674)}


def test_pruning_by_a_coordinate_is_safe():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 6))
    norms = np.linalg.norm(v, axis=1)
    for q in rng.normal(size=(20, 6)):
        for local in (0.6, 0.8, 0.99):
            kept = topk.pruned(q, local, 0.0, v / norms[:, None], norms)
            assert kept[(v @ q) / norms / np.linalg.norm(q) >= local].all()


def test_url_filter(spark):
    urls = [
        "http://Sub.Example.ORG/es/1?x", "https://example.org/en/12#t", "https://a.com/fr/", "http://com/de/x", "http://cheap-pills.example.net/en/1", "http://news.example.net/en/1",
        None, "no scheme", "x://y://z/p", "ftp://h.net", "http://casinowin.example.net?/fr/", "http://notexample.org/es/",
    ]
    urls += [f"http://site{i}.example.net/en/{i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert [(got[i].host, got[i].path) for i in (0, 1, 6, 7, 8, 9, 10)] == [
        ("sub.example.org", "/es/1"), ("example.org", "/en/12"), ("", ""), ("", ""), ("y:", "//z/p"), ("h.net", ""), ("casinowin.example.net", ""),
    ]
    assert [(got[i].rule, got[i].verdict) for i in (0, 1, 2, 3, 11)] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("org/", "allow"),
    ]
    assert [got[i].verdict for i in (4, 5, 6, 10)] == ["block", "allow", "allow", "block"]
    assert url_filter.judge(df.limit(0)).collect() == []


def test_url_filter_holds_every_word_and_token(spark):
    rng = random.Random(5)
    names = [prose(rng, 1).replace("é", "e") + f"q{chr(97 + i)}" for i in range(12)]
    urls = [f"http://{rng.choice(names)}.{rng.choice(names)}{rng.choice(names)}-{rng.choice(['casino', 'farm', 'zz'])}.net/{rng.choice(names)}/{i % 7}" for i in range(150)]
    # A token of few hosts, all of them blocked, among more frequent ones.
    urls += [f"http://casino{i}.net/rare" for i in range(4)] + ["http://plain.net/rare", "file:///rare", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    want = {r.page_id: r for r in url_filter.judge(df, ()).collect()}
    got = {r.page_id: r for r in url_filter.judge(df, (), most_words=2, most_tokens=3).collect()}
    assert want == got and len(got) == len(urls)


def test_names_are_split_into_words():
    model = url_filter.Model({w: math.log(1 / 100) for w in ("casino", "win", "free", "farm")}, 100.0)
    assert model.split("casinowinfarm") == ["casino", "win", "farm"] and model.split("") == []
    assert model.split("qqfree") == ["qq", "free"]


def test_license_scan(spark, nothing):
    texts = [
        license_scan.MIT, "Copyright (c) 2020 A. Author\n\n" + license_scan.MIT.upper().replace(",", ";"), license_scan.MIT + " more", "Released under the MIT Licence!\nsome text",
        "some\n  licensed under the apache license - version 2.0\nreleased under the MIT license", None, "", "...",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("digest", F.lit("x"))
    got = {r.id: (r.license, r.line_licenses) for r in license_scan.scan(df).collect()}
    assert [got[i][0] for i in range(8)] == ["MIT", "MIT", None, None, None, None, None, None]
    assert got[3][1] == "MIT" and got[4][1] == "Apache-2.0,MIT" and got[6][1] == ""
    assert license_scan.scan(nothing).collect() == []


def test_whole_licences_and_neighbouring_spellings(spark):
    bsd = license_scan._bsd(3, "BSD 3-Clause License\n\nCopyright (c) 2020, Somebody\n\n", True).replace("without specific", "without\nspecific")
    rows = [
        (1, bsd), (2, bsd.replace("3. ", "- ").replace("2. ", "- ").replace("1. ", "- ").upper()), (3, "   " + license_scan.ZLIB.replace(". ", ".\n")),
        (4, license_scan.UNLICENSE + "\n"), (5, bsd + " and more"), (6, license_scan._bsd(2, "", True)),
        (7, "licence licence licence per cent per cent version 2 0 version 2 0"), (8, "license license license percent percent v2 v2"),
    ]
    got = {r.id: (r.digest, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i][1] for i in range(1, 9)] == ["BSD-3-Clause", "BSD-3-Clause", "Zlib", "Unlicense", None, "BSD-2-Clause", None, None]
    assert got[7][0] == got[8][0]


def test_components_and_numbers(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500, k) for k in range(600, 700)]
    df = spark.createDataFrame(pairs + [(400, 400), (None, 3)], "a bigint, b bigint")
    root = roots(pairs, {n for p in pairs for n in p})
    got = {r.node: r.component for r in connected_components(df).collect()}
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: root[n] for n in linked}
    assert connected_components(df.limit(0)).collect() == []
    ranks = collections.defaultdict(list)
    for r in numbered(spark.range(500).selectExpr("id", "id % 3 AS g"), ["g"], ["id"], "n", 7).collect():
        ranks[r.g].append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


def test_membership_filter_loses_none(spark):
    rows = spark.range(2000).withColumn("word", F.lit("w"))
    maybe, rest = split_by_membership(rows, spark.range(0, 2000, 7), "id")
    assert {r.id for r in maybe.collect()} >= set(range(0, 2000, 7)) and maybe.count() < 600
    assert maybe.columns == rows.columns and maybe.count() + rest.count() == 2000
