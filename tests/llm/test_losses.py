"""Nothing is lost: rows that share a doc_id, shards under changed file splits, training rows."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import sharding, simhash, toxicity


def test_rows_that_share_a_doc_id_are_judged_each_for_itself(spark, data):
    r = random.Random(3)
    say = lambda: " ".join(f"{r.choice('abcdefgh')}{r.randrange(90)}" for _ in range(80))
    a, b, c = say(), say(), say()
    rows = [(3, a), (5, a + " more"), (5, b), (9, b + " more"), (9, b + " more"), (9, c), (11, a), (None, b), (4, c + " x"), (4, c)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component int").repartition(3)
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_copies_go(spark, docs, data).collect())
    assert kept[:2] == [(0, b), (3, a)] and kept[-1] == (5, b)
    assert len(kept) == 4 and kept[2][0] == 4 and kept[2][1] in (c, c + " x")
    found = simhash.similar(docs).collect()
    assert len({r["component"] for r in found}) == 3 and Counter(r["component_id"] for r in found) == {3: 3, 4: 3, 5: 3}


def test_shards_are_exact_under_other_file_splits(spark):
    rows = spark.range(20_000).selectExpr("id as doc_id", "repeat(cast(id as string), 40) as x").repartition(3)
    name = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(name)
    found = sharding.shard(rows, 8, block_rows=500)
    try:
        spark.conf.set(name, "60000")
        first = found.collect()
        spark.conf.set(name, "100m")
        again = sharding.shard(rows, 8, block_rows=500).collect()
    finally:
        spark.conf.set(name, was)
    for got in (first, again):
        per = {}
        for r in got:
            per.setdefault(r["shard"], []).append(r["slot"])
        assert sorted(map(len, per.values())) == [2500] * 8 and all(sorted(s) == list(range(2500)) for s in per.values())
        assert len({r["doc_id"] for r in got}) == 20_000


def test_draws_of_any_size_follow_their_law():
    rng = np.random.default_rng(1)
    for good, bad, n in ((23, 9, 11), (6, 31, 17), (40, 40, 3)):
        own = Counter(sharding.hypergeometric(good, bad, n, rng, most=3) for _ in range(6000))
        other = Counter(rng.hypergeometric(good, bad, n, 6000).tolist())
        assert all(abs(own[k] - other[k]) < 6 * (own[k] + other[k] + 20) ** 0.5 for k in own | other)
    big = [sharding.hypergeometric(3 * 10**11, 10**11, 4 * 10**10, rng) for _ in range(50)]
    assert np.mean(big) == pytest.approx(3 * 10**10, rel=1e-5) and all(0 <= x <= 4 * 10**10 for x in big)
    assert sharding.draw(np.asarray([5 * 10**10, 5 * 10**10, 7]), 10**11, rng).sum() == 10**11


def test_training_rows_fall_by_near_copies_only(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = docs.join(labels.select("doc_id", "toxic").where("toxic is not null"), "doc_id").where("length(trim(text)) > 0").select("doc_id", "toxic", "text").collect()
    sets = {r["doc_id"]: set(simhash.shingles(r["text"], 5).tolist()) for r in rows}
    by_shingle = {}
    for i, own in sets.items():
        for h in own:
            by_shingle.setdefault(h, set()).add(i)
    near = sum(any(len(sets[j] & sets[i]) >= 0.25 * len(sets[j] | sets[i]) for h in sets[i] for j in by_shingle[h] if j < i) for i in sets)
    kept = toxicity.once_each(spark.createDataFrame(rows).select("toxic", "text")).collect()
    assert len(rows) - near <= len(kept) <= len(rows)
    texts = {r["text"]: r["toxic"] for r in rows}
    assert all(texts[r["text"]] == r["toxic"] or list(texts).count(r["text"]) for r in kept)
