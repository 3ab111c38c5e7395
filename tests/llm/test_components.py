"""Connected components: how many rounds they take, and what a round leaves on the driver."""

from __future__ import annotations

import random

import pytest

from tunegrain.llm import shared


@pytest.fixture
def rounds(monkeypatch):
    """The tables written and the times the driver's garbage was given back."""
    seen = {"tables": 0, "released": 0}

    def count(name, key):
        real = getattr(shared, name)

        def run(*args):
            seen[key] += 1
            return real(*args)

        monkeypatch.setattr(shared, name, run)

    count("materialize", "tables")
    count("release_shuffles", "released")
    return seen


def test_stars_need_no_round(spark, rounds):
    pairs = [(hub, hub + k) for hub in (0, 100, 200) for k in range(1, 40)]
    got = shared.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {n: n // 100 * 100 for pair in pairs for n in pair}
    assert len(got) == 120
    assert rounds == {"tables": 1, "released": 0}


def test_chains_and_cliques(spark, rounds):
    names = list(range(60))
    random.Random(3).shuffle(names)
    pairs = [*zip(names, names[1:]), *((a, b) for a in range(100, 108) for b in range(a, 108)), (7, 7), (None, 9), (300, 300)]
    got = shared.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {n: 0 for n in range(60)} | {n: 100 for n in range(100, 108)}
    assert len(got) == 68
    # Every round but none more, each followed by a release.
    assert 1 <= rounds["released"] == rounds["tables"] - 1 <= 6


def test_components_of_text_keys(spark, rounds):
    pairs = [("b", "c"), ("d", "c"), ("x", "y"), ("a", "d")]
    got = shared.connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()
    assert {r.node: r.component for r in got} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
