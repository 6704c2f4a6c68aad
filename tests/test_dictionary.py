"""Masking by a dictionary against nested replaces, both ways."""

import time

import numpy as np
import pytest

from piitrace.operators import dictionary

VALUES = [("email", "a@b.co"), ("username", "ann"), ("username", "anna"), ("token", "anna-secret-1"), ("ip", "10.0.0.1"),
          ("ip", "10.0.0.11"), ("username", "x"), ("token", "ann"), ("email", ""), ("email", None), (None, "kept"),
          ("username", "日本"), ("phone", "+1-555"), ("token", "IP")]
TEXTS = ["anna-secret-1 of anna, not ann", "10.0.0.11 10.0.0.1", None, "", "kept", "x" * 9, "日本語 ann@anna",
         "a@b.co" * 3, "IP 10.0.0.1", "an na", "+1-555-123"]


def plain(text, values):
    kinds = {}
    for kind, v in values:
        if v and kind:
            kinds[v] = min(kind, kinds.get(v, kind))
    if text is None:
        return None
    for v in sorted((v for v in kinds if v in text), key=lambda v: (-len(v), v)):
        text = text.replace(v, f"[{kinds[v].upper()}]")
    return text


@pytest.mark.parametrize("bound", [0, 1000])
def test_against_nested_replaces(spark, bound):
    rng = np.random.default_rng(7)
    words = ["ann", "anna", "10.0.0.1", "10.0.0.11", "a@b.co", "x", " ", "-secret-1", "日本", "IP", "]", "zz"]
    texts = TEXTS + ["".join(rng.choice(words, 12)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, line string").repartition(4)
    values = spark.createDataFrame(VALUES, "pii_type string, value string")
    got = dictionary.mask_dictionary(df, values, "id", automaton_values=bound).collect()
    assert {r.id: r.masked for r in got} == {i: plain(t, VALUES) for i, t in enumerate(texts)}
    none = dictionary.mask_dictionary(df, values.limit(0), "id", automaton_values=bound - 1).collect()
    assert {r.id: r.masked for r in none} == dict(enumerate(texts))


def test_every_value_has_a_rare_anchor(spark):
    rows = [("u", f"common-{i:03d}") for i in range(50)] + [("u", "ab")]
    got = {r.value: r.gram for r in dictionary.anchors(spark.createDataFrame(rows, "pii_type string, value string")
                                                       ).collect()}
    assert set(got) == {v for _, v in rows} and got["ab"] == "ab"
    assert all(g in v for v, g in got.items()) and "commo" not in got.values()


def test_no_value_meets_every_line(spark):
    df = spark.range(5).selectExpr("id", "'ann' AS line")
    values = spark.createDataFrame(VALUES, "pii_type string, value string")
    for bound in (0, 1000):
        plan = dictionary.mask_dictionary(df, values, "id", automaton_values=bound)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_grams_of_a_long_text_take_one_pass():
    """Every anchor is met, also across stretches, in time that follows the length of the text."""
    text = "日本 x " * 200_000 + "needle-1" + "z" * 300_000
    bits = np.zeros(dictionary.POSITIONS // 32, np.uint32)
    across = text[dictionary.STRETCH - 2:dictionary.STRETCH + 3]
    for gram in ("eedle", across, "本 x"):
        at = int(dictionary._places(dictionary._letters(gram), len(gram))[0])
        bits[at >> 5] |= np.uint32(1 << (at & 31))
    begin = time.process_time()
    got = dictionary._anchor_grams(text, [3, 5], bits)
    assert {"eedle", across, "本 x"} <= got and time.process_time() - begin < 10
