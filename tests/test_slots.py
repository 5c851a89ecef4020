"""Slots see each distinct input once, and an ordered judge isn't transitive."""

import pandas as pd

from tessera.operators import slots


def test_a_model_sees_each_input_once(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "i int, t string").repartition(3)
    found = slots.once_for_each(rows, ["t"], lambda b: pd.Series([f"{len(b)}" for _ in range(len(b))]), "n", "string")
    assert {r["i"] for r in found.collect()} == {1, 2, 3, 4}


def test_the_first_label_that_is_judged_the_same(spark):
    labels = ["ab", "bc", "cd", "AB"]
    rows = spark.createDataFrame([("s", "t", x, i) for i, x in enumerate(labels)], "source string, target string, relationship string, ord int")
    got = slots.judged_labels(rows, lambda s, t, a, b: bool(set(a) & set(b))).orderBy("ord").collect()
    assert [r["label"] for r in got] == ["ab", "ab", "cd", "ab"]


def test_confirmed_pairs(spark):
    e = spark.createDataFrame([("1", "x", ""), ("2", "x.", ""), ("3", "y", "")], "id string, name string, description string")
    p = spark.createDataFrame([("1", "2"), ("1", "3")], "a string, b string")
    same = slots.confirmed_pairs(p, e, lambda b: b["name_a"].str[0] == b["name_b"].str[0])
    assert [(r["a"], r["b"]) for r in same.collect()] == [("1", "2")]
    assert slots.confirmed_pairs(p, e).count() == 2
