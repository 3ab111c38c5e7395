"""Curve search, source audit and vector-approximation clusters against brute force, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tunegrain.llm import curve_search, source_audit, va_clusters

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, row string, rep string, rank string, cluster string, cells string"


@pytest.fixture(scope="module")
def clumps():
    """Vectors around some middles, copies of one vector, and rows that take no part."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 64))
    x = (middles[rng.integers(12, size=900)] + 0.2 * rng.normal(size=(900, 64))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    common = [float(c) for c in x[5]]
    rows += [(1000 + i, common) for i in range(400)]
    nan, inf = float("nan"), float("inf")
    odd = [(2000, None), (2100, []), (2200, [0.0] * 64), (2300, [nan] + common[1:]), (2400, [inf] + common[1:]), (2500, [None] + common[1:])]
    odd += [(None, common), (2600, [1.0, 2.0]), (2700, [1.0, 2.5]), (100, common), (100, [c + 0.5 for c in common])]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x", "x", "x", "x") for i, v in rows], VECTORS)


def part_of(rows, least=0.0):
    return [(n, i, np.array(v, dtype=np.float32).astype(np.float64)) for n, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]


def test_hilbert_neighbours_differ_in_one_step():
    for dims, bits in ((1, 6), (2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = curve_search.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


@pytest.mark.parametrize("curves", [curve_search.Curves(), curve_search.Curves(least=8, block=64, queries=3, sample=20, recall=0.99)])
def test_curve_search_finds_the_nearest(spark, clumps, curves):
    got = collections.defaultdict(list)
    for r in curve_search.search(frame(spark, clumps), every=50, k=10, curves=curves).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    stock = part_of(clumps)
    hits = total = 0
    want_ids = collections.Counter(i for _n, i, _v in stock if i % 50 == 0)
    assert set(got) == {i for i, _ in want_ids.items() if i not in (2600, 2700)} | {2600, 2700}
    for n, i, v in stock:
        if i % 50:
            continue
        all_ = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for m, j, w in stock if m != n and len(w) == len(v))
        mine = sorted(got[i])
        assert collections.Counter(r for r, _, _ in mine) == {r: want_ids[i] for r in range(1, min(10, len(all_)) + 1)}
        if want_ids[i] > 1:
            continue
        true = {(round(d, 9), j) for d, j in all_}
        assert all((round(s, 9), j) in true for _, j, s in mine)
        assert [(s, j) for _, j, s in mine] == sorted((s, j) for _, j, s in mine)
        hits += len({(round(d, 9), j) for d, j in all_[:10]} & {(round(s, 9), j) for _, j, s in mine})
        total += len(all_[:10])
    assert hits >= 0.95 * total


def test_curve_search_lists_smallest_ids_among_copies(spark, clumps):
    rows = [r for r in clumps if r[0] is not None and r[0] >= 1000 and r[0] < 1400]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in curve_search.search(frame(spark, rows), every=100, k=5, curves=curve_search.Curves(least=2)).collect()]
    assert sorted(got) == [(q, i + 1, j, 0.0) for q in (1000, 1100, 1200, 1300) for i, j in enumerate([j for j in range(1000, 1007) if j != q][:5])]


def test_curve_search_of_extreme_numbers(spark):
    rows = [(0, [1e200, 1.0]), (1, [-1e200, 1.0]), (2, [1e-200, 0.0]), (100, [2e-200, 0.0]), (3, [-0.0, 1e-200]), (4, [0.0, 1e-200])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in curve_search.search(df, every=100, k=3).collect()}
    assert got[100, 1] == (2, pytest.approx(1e-200, rel=1e-12))
    assert got[100, 2][0] == 3 and got[100, 3][0] == 4
    assert got[0, 3][0] == 4 and got[0, 3][1] == pytest.approx(1e200)


def test_curve_search_of_nothing(spark):
    assert curve_search.search(spark.createDataFrame([], VECTORS)).count() == 0
    assert curve_search.search(frame(spark, [(1, [1.0]), (3, [2.0])])).count() == 0
    assert curve_search.search(frame(spark, [(100, [1.0])])).count() == 0


def audited(rows, least=3, top=200):
    """The audit by loops over dictionaries."""
    docs = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = [(l, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower))) for l, s, t in docs]
    out = []
    for lang in {l for l, _, _ in split}:
        mine = [(s, w) for l, s, w in split if l == lang]
        seen = collections.Counter(t for _, w in mine for t in set(w))
        kept = [t for t, n in seen.items() if n >= least]
        sums = collections.defaultdict(collections.Counter)
        for s, w in mine:
            sums[s].update(t for t in w if seen[t] >= least)
        whole = collections.Counter()
        for c in sums.values():
            whole.update(c)

        def shares(c):
            n = sum(c.values()) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // n for t in kept}

        p = {s: shares(c) for s, c in sums.items()}
        q = shares(whole)
        for s in sums:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sums if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if sums[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked[:limit])]
    return sorted(out)


AUDIT = "doc_id bigint, text string, lang string, source string, term string, n string, slice string, number string, v string, one string, two string, docs string"


def audit_rows():
    rng = random.Random(4)
    pool = ["alpha", "Beta", "GAMMA", "été", "naïve", "x", "日本", "Ünder", "\U0001F600", "i"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(6)]
    rows = []
    for lang in ("en", "de", None):
        for s in range(5):
            for _ in range(rng.randint(1, 9)):
                words = [rng.choice(pool[: 20 + 15 * s]) for _ in range(rng.randint(0, 60))]
                rows.append((lang, f"s{s}" if s else None, rng.choice(["-", " ", "7", "\n", "_"]).join(words)))
    rows += [("en", "none", None), ("en", "blank", ""), ("fr", "a", "une fois"), ("fr", "b", "deux"), ("it", "only", "solo solo " * 3)] + [("it", "only", "solo")] * 3
    rows += [("en", "s1", "Alpha " * 5000 + "z" * 3000)] * 3
    return rows


def audit_frame(spark, rows):
    return spark.createDataFrame([(i, t, l, s, *["x"] * 8) for i, (l, s, t) in enumerate(rows)], AUDIT)


@pytest.mark.parametrize("size, block", [(1 << 15, 32), (7, 2)])
def test_source_audit(spark, size, block, monkeypatch):
    monkeypatch.setattr(source_audit, "SLICE", size)
    monkeypatch.setattr(source_audit, "BLOCK", block)
    rows = audit_rows()
    got = sorted(tuple(r) for r in source_audit.audit(audit_frame(spark, rows), top=9).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == audited(rows, top=9)


def test_source_audit_of_nothing(spark):
    assert source_audit.audit(spark.createDataFrame([], AUDIT)).count() == 0
    assert source_audit.audit(audit_frame(spark, [("en", "a", None)])).collect() == []


def test_terms_of_long_texts_are_whole(monkeypatch):
    monkeypatch.setattr(source_audit, "PIECE", 10)
    text = ("Ab" * 30 + " c" + "é" * 20 + "9") * 5
    got = [t for part in source_audit._terms(text.encode()) for t in part]
    assert got == [t.encode() for t in re.findall("[a-zé]+", text.lower())]


def test_tasks_hand_counts_on_when_they_hold_many(monkeypatch):
    monkeypatch.setattr(source_audit, "HELD", 5)
    rows = [("en", f"s{i % 2}", f"a b{chr(97 + i)} c{chr(97 + i % 3)}".encode()) for i in range(20)]
    batch = pa.record_batch([pa.array(x) for x in zip(*rows)], names=["lang", "source", "text"])
    out = list(source_audit._count(iter([batch])))
    assert len(out) > 3
    total = collections.Counter()
    for b in out:
        for r in b.to_pylist():
            if r["term"]:
                total[r["source"], r["term"]] += r["n"]
    assert total["s0", b"a"] == total["s1", b"a"] == 10 and sum(total.values()) == 60


def test_gallop_is_a_search():
    rng = np.random.default_rng(1)
    for n, m in ((0, 0), (0, 5), (5, 0), (1, 1), (3, 1000), (1000, 3), (200, 220)):
        a, b = (np.sort(rng.choice(3000, size=k, replace=False)).astype(np.int64) for k in (n, m))
        i, j = source_audit._meeting(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_shares_are_exact_for_huge_counts():
    counts = np.array([0, 5, 10**12, 3 * 10**14], dtype=np.int64)
    whole = 10**15 + 7
    assert source_audit._shares(counts, whole).tolist() == [1 + 10**9 * (c + 1) // whole for c in counts.tolist()]


def clustered(rows, clusters=16, rounds=3):
    x = [(i, [math.floor(64 * c) for c in v]) for _n, i, v in part_of([r for r in rows if r[1] and len(r[1]) == 64])]
    x += [(i, [0] * 64) for i, v in rows if v == [0.0] * 64]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in x)[:clusters]
    c = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, k)), n) for n, k in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in x]
        c = [[sum(col) // len(col) for col in zip(*m)] if (m := [v for (_, v), o in zip(x, own) if o == n]) else k for n, k in enumerate(c)]
    last = [(i, *near(v)) for i, v in x]
    inertia = collections.Counter()
    for _, d, n in last:
        inertia[n] += d
    sha = [hashlib.sha256(",".join(map(str, k)).encode()).hexdigest() for k in c]
    return sorted((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, d, n in last)


@pytest.mark.parametrize("bits", [2, 4, 6])
def test_va_clusters(spark, clumps, bits):
    got = va_clusters.cluster(frame(spark, clumps), va_clusters.Clustering(bits=bits))
    assert sorted(map(tuple, got.collect())) == clustered(clumps)


def test_va_clusters_of_few_rows(spark):
    assert va_clusters.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    rng = np.random.default_rng(2)
    rows = [(i % 3, [float(c) for c in np.float32(rng.normal(size=64))]) for i in range(5)]
    rows += [(9, rows[0][1]), (10, rows[0][1])]
    huge = [(11, [3e30] + [0.0] * 63)]
    assert sorted(map(tuple, va_clusters.cluster(frame(spark, rows + huge)).collect())) == clustered(rows)


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_cells_enclose_distances(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(-40, 40, size=(300, 64))
    centroids = rng.integers(-10, 10, size=(7, 64))
    edges = np.sort(np.concatenate([x.min(axis=0)[:, None], rng.integers(-40, 40, size=(64, (1 << bits) - 1)).clip(x.min(axis=0)[:, None], x.max(axis=0)[:, None]), x.max(axis=0)[:, None] + 1], axis=1), axis=1)
    cells = np.stack([np.clip(np.searchsorted(edges[d], x[:, d], side="right") - 1, 0, (1 << bits) - 1) for d in range(64)], axis=1)
    may = va_clusters.enclosed(cells, va_clusters.look_up_tables(edges, centroids))
    gaps = ((x[:, None, :] - centroids) ** 2).sum(axis=2)
    assert may[gaps == gaps.min(axis=1)[:, None]].all()
