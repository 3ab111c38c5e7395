import json
import random

from pyspark.sql import functions as F

from tunegrain.functions import jsontext, text


def test_strip_matches_python(one):
    rng = random.Random(1)
    alphabet = list(text.PY_WHITESPACE) + ["a", "é", "😀", "​", "﻿", "à", "م", "Š"]
    values = ["".join(rng.choices(alphabet, k=rng.randint(0, 8))) for _ in range(2000)]
    assert len(text.PY_WHITESPACE) == 29
    assert one(values, text.strip) == [v.strip() for v in values]
    assert one(values, text.strip_computed) == [v.strip() for v in values]


def test_clean_turns_null_into_empty_text(one):
    assert one([None, " x ", "007"], text.clean) == ["", "x", "007"]


def test_token_estimate_rounds_half_even(one):
    values = ["x" * n for n in range(0, 40)]
    assert one(values, text.estimate_tokens) == [max(1, round(n / 4)) for n in range(0, 40)]
    assert one(["é😀a" * 2], text.estimate_tokens) == [2]


def test_tokenizer_wins_unless_it_gives_null(one):
    tokenizer = lambda c: F.when(c != "bad", F.lit(7))
    assert one(["good", "bad"], lambda c: text.estimate_tokens(c, tokenizer)) == [7, 1]


def test_round_matches_python(one):
    rng = random.Random(2)
    ties = [k / 2000 for k in range(-400, 400)] + [(2 * k + 1) / 20 for k in range(200)]
    values = ties + [rng.uniform(0, 5000) for _ in range(2000)] + [0.0, 602.5, 1e-9, 2.5, 0.0125]
    for digits in (0, 1, 3, 4, 7):
        got = one(values, lambda c, d=digits: text.py_round(c, d), "double")
        assert got == [round(v, digits) for v in values]


def test_significant_digits_match_format(one):
    rng = random.Random(3)
    values = [rng.uniform(1, 10) * 10 ** rng.randint(-9, 2) for _ in range(2000)] + [0.06935, 9.996e-5, 0.0, 2e-4, 1e-3]
    got = one(values, lambda c: F.format_string("%.2e", text.significant(c, 3)), "double")
    assert got == [f"{v:.2e}" for v in values]


def test_float_parsing_matches_python(one):
    values = ["1", " 2.5\n", "1e-5", "1_000", "_1", "1_", "1__0", "1.0d", "2f", "nan", "-Infinity", "inf", "0x10", "", ".", "5.", ".5", "n/a", "+3", "1e5_0"]

    def python(v):
        try:
            return float(v)
        except ValueError:
            return None

    assert [repr(x) for x in one(values, text.py_float)] == [repr(python(v)) for v in values]


def test_slugs(one):
    names = ["My Data Set!", "--a--b--", "Émile", "???", "a" * 60]
    assert one(names, text.slugify) == ["my-data-set", "a-b", "mile", "dataset", "a" * 60]
    made = one(["My Data", "x" * 60], text.named_id)
    assert made[0].startswith("my-data-") and len(made[0]) == len("my-data-") + 8
    assert made[1].startswith("x" * 40 + "-") and len(made[1]) == 49
    assert int(made[0][-8:], 16) >= 0


def test_strict_parse_accepts_exactly_one_value(one):
    values = ['[1]', ' {"a": "x"} ', '"s"', "null", "5", "", " ", "[1] x", '{"a":1}}', "1, 2", "[1,]", "{'a':1}", "[01]", "]", '"a" "b"', "[[1]] , [[2]]"]

    def python(v):
        try:
            json.loads(v)
            return True
        except ValueError:
            return False

    got = one(values, lambda c: jsontext.parse_strict(c).isNotNull())
    assert got == [python(v) for v in values]


def test_truthiness_of_json_values(one):
    values = ['{"k": ""}', '{"k": 0}', '{"k": "0"}', '{"k": false}', '{"k": "false"}', '{"k": []}', '{"k": {}}', '{"k": "[]"}', '{"k": null}', "{}", '{"k": 3}', '{"k": true}']
    got = one(values, lambda c: jsontext.truthy_text(F.try_parse_json(c), "k"))
    assert got == [None, None, "0", None, "false", None, None, "[]", None, None, "3", "true"]
