"""Linked vectors against brute force."""

import math
import random

import numpy as np

from tessera.llm import embeddings


def brute(rows, least=0.93):
    def fine(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = {i: set() for i, _, _ in rows}
    for k, (i, v, label) in enumerate(rows):
        for j, w, other in rows[k + 1 :]:
            if label is not None and label == other and fine(v) and fine(w) and len(v) == len(w):
                a, b = np.asarray(v, float), np.asarray(w, float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    links[i].add(j)
                    links[j].add(i)
    label = {}
    for i in sorted(links):
        if i not in label:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = i
                    todo += links[x]
    return {i: (len(links[i]), label[i], label[i] == i) for i in links}


def test_links(spark):
    r = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(40):
        base = r.standard_normal(64)
        for _ in range(random.Random(n).randint(1, 8)):
            rows.append((n, [float(np.float32(x)) for x in base + 0.17 * r.standard_normal(64)], int(n % 3)))
            n += 1
    copies = [(n + i, rows[5][1], rows[5][2]) for i in range(6)]
    bad = [(900, None, 1), (901, [], 1), (902, [0.0] * 64, 1), (903, [1.0, None] + [0.0] * 62, 1), (904, [float("nan")] * 64, 1), (905, [float("inf")] * 64, 1), (906, rows[5][1], None), (907, rows[5][1][:32], rows[5][2]), (908, rows[5][1][:32], rows[5][2])]
    every = rows + copies + bad
    df = spark.createDataFrame(every, "vec_id long, embedding array<float>, label int").repartition(4)
    want = brute(every)
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embeddings.near_duplicates(df).collect()}
    assert set(got) == set(want)
    found, there = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.97 * there
    assert all(got[i] == want[i] for i, _, _ in copies + bad)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(none).count() == 0
    one = spark.createDataFrame([(None, [1.0, 0.0], 1, "x"), (3, [1.0, 0.0], 1, "y"), (4, [2.0, 0.0], 1, "z")], "vec_id long, embedding array<float>, label int, kept string")
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in embeddings.near_duplicates(one).collect()}
    assert got == {None: (0, None, None), 3: (1, 3, True), 4: (1, 3, False)}


def test_rotation_is_orthonormal():
    x = np.random.default_rng(0).standard_normal((500, 64))
    r = embeddings.learn_rotation(x, 64)
    assert np.allclose(r.T @ r, np.eye(64), atol=1e-8)
    assert embeddings.learn_rotation(x[:, :10], 64).shape == (10, 64)


def test_tables_reach_the_threshold():
    """Recall by cosine of the tables, which are the same for a label of any number of vectors."""
    r = np.random.default_rng(4)
    keys = embeddings.substrings()
    for cosine in (0.93, 0.94, 0.95):
        x, y = r.standard_normal((2, 20_000, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = cosine * x + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        apart = (x >= 0) != (y >= 0)
        met = np.any([apart[:, a : a + n].sum(axis=1) <= 1 for a, n in keys], axis=0)
        print(cosine, met.mean())
        assert met.mean() >= 0.99
