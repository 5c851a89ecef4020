"""The delta store: batches touch their own buckets, replays and readers see the same rows, keys are enforced and found."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors
from tessera.plans.engine import Engine
from tessera.sources.deltas import DeltaStore, RepeatedKeys, WriteConflict
from tessera.sources.store import ChangeSet


def files(path: Path) -> set[str]:
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet") if p.is_file()}


def change(spark, ids, run="r", extra=""):
    entities = spark.createDataFrame([(f"e{i}", f"name {i}{extra}", "T") for i in ids], "id string, name string, type string")
    edges = spark.createDataFrame([(f"r{i}", f"e{i}", f"e{i + 1}", "NEXT") for i in ids], "id string, source_id string, target_id string, relationship string")
    return ChangeSet(run, entities, edges)


def rows(store, name, **how):
    return sorted(map(str, store.read(name, **how).drop("created_at").collect()))


def test_a_batch_touches_its_own_buckets(spark, tmp_path):
    s = DeltaStore(spark, str(tmp_path), 32)
    s.apply(change(spark, range(3000)))
    assert s.compact(["entities", "relationships", "names"]) == 2
    before = files(tmp_path)
    batch = change(spark, range(100, 110), "r2", " anew")
    s.apply(batch)
    new = {f for f in files(tmp_path) - before if f.startswith("entities/")}
    own = spark.createDataFrame([(f"e{i}",) for i in range(100, 110)], "id string").select(s._bucket("entities").alias("b"))
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in new} == {r["b"] for r in own.collect()} and len(new) <= 10
    assert before <= files(tmp_path)  # nothing was rewritten
    assert s.read("entities").count() == 3000 and s.read("entities").where("name like '% anew'").count() == 10
    assert batch.entity_count() == batch.relationship_count() == 10 and s.state().totals == {"entities": 3000, "relationships": 2999}
    touched = {f for f in files(tmp_path) if f.startswith("entities/")}
    s.compact(["entities"])
    rewritten = {f for f in files(tmp_path) - touched if f.startswith("entities/")}
    assert {f.split("bucket=")[1].split("/")[0] for f in rewritten} == {f.split("bucket=")[1].split("/")[0] for f in new}
    assert s.read("entities").count() == 3000 and s.read("entities").where("name like '% anew'").count() == 10


def test_replays_and_readers_see_the_same_rows(spark, tmp_path):
    s = DeltaStore(spark, str(tmp_path), 4)
    s.apply(change(spark, range(20), "a"))
    old, reading = rows(s, "entities"), s.read("entities")
    s.apply(change(spark, range(10, 30), "b", "!"))
    now = {n: rows(s, n) for n in ("entities", "relationships", "names")}
    assert sorted(map(str, reading.drop("created_at").collect())) == old == rows(s, "entities", version=1)
    for _ in range(2):
        s.apply(change(spark, range(10, 30), "b", "!"))
        assert {n: rows(s, n) for n in now} == now and s.state().totals == {"entities": 30, "relationships": 29}
    s.compact()
    assert {n: rows(s, n) for n in now} == now and len(s.vacuum()) == 12 and {n: rows(s, n) for n in now} == now
    # a writer that fails before its version is there leaves nothing that is read
    s._put_files("entities", "lost", s.read("entities").limit(3).withColumn("name", F.lit("lost")).withColumn("_gone", F.lit(False)))
    assert rows(s, "entities") == now["entities"] and s.vacuum() == ["entities/commit=lost"]


def test_one_of_two_writers_fails(spark, tmp_path, monkeypatch):
    a, b = DeltaStore(spark, str(tmp_path)), DeltaStore(spark, str(tmp_path))
    a.upsert_entities(spark.createDataFrame([("x", "X")], "id string, name string"))
    last = b.state()
    a.upsert_entities(spark.createDataFrame([("y", "Y")], "id string, name string"))
    monkeypatch.setattr(b, "state", lambda version=None: last)
    with pytest.raises(WriteConflict):
        b.upsert_entities(spark.createDataFrame([("z", "Z")], "id string, name string"))
    assert {r["id"] for r in a.read("entities").collect()} == {"x", "y"} and a.version() == 2


def test_keys_are_enforced_and_found(spark, tmp_path):
    s = DeltaStore(spark, str(tmp_path), 64)
    twice = spark.createDataFrame([("a", "A"), ("a", "B"), ("b", "C")], "id string, name string")
    with pytest.raises(RepeatedKeys):
        s.apply(ChangeSet("r", entities=twice), refuse=True)
    assert s.version() == 0 and s.read("entities").count() == 0
    s.apply(ChangeSet("r", entities=twice))
    assert {r["id"]: r["name"] for r in s.read("entities").collect()} == {"a": "B", "b": "C"}
    s.apply(change(spark, range(5000)))
    found = s.lookup("entities", [f"e{i}" for i in range(0, 5000, 500)] + ["none"])
    assert found.count() == 10
    read = s.lookup("entities", ["e7", "e8"])
    read.collect()
    plan = read._jdf.queryExecution().executedPlan()
    scans = [p for p in _leaves(plan) if p.nodeName().startswith("Scan parquet")]
    assert scans and sum(p.metrics().get("numFiles").get().value() for p in scans) <= 4 < len(files(tmp_path / "entities"))
    assert [r["id"] for r in s.lookup("relationships", [("e5", "r5", "e6"), ("e5", "r6", "e6")]).collect()] == ["r5"]


def _leaves(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _leaves(plan.executedPlan())
    if plan.nodeName().endswith("QueryStage"):
        return _leaves(plan.plan())
    below = [plan.children().apply(i) for i in range(plan.children().size())]
    return [x for b in below for x in _leaves(b)] if below else [plan]


def test_ends_puts_and_tables_written_anew(spark, tmp_path):
    s = DeltaStore(spark, str(tmp_path), 8)
    s.upsert_entities(spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string"))
    s.upsert_relationships(spark.createDataFrame([("r", "a", "b", "R"), ("r2", "a", "none", "R")], "id string, source_id string, target_id string, relationship string"))
    assert [r["id"] for r in s.read("relationships").collect()] == ["r"]
    parts = "community_id string, members array<string>, title string"
    s.replace_communities(spark.createDataFrame([("c", ["a", "b", "zz"], "t"), ("gone", ["a"], "u")], parts))
    s.replace_communities(spark.createDataFrame([("c", ["a", "b", "zz"], "t"), ("d", ["b"], "v")], parts))
    assert {r["community_id"]: r["entity_count"] for r in s.read("communities").collect()} == {"c": 3, "d": 1}
    assert {(r["entity_id"], r["community_id"]) for r in s.read("belongs_to").collect()} == {("a", "c"), ("b", "c"), ("b", "d")}
    last = s.state().deltas["communities"][-1]
    assert s._scan("communities", [(last[1], None)]).count() == 2  # the new one and the one that went, not the one that stayed
    s.store_embeddings(spark.createDataFrame([("a", [1.0]), ("nobody", [2.0])], "key string, vector array<float>"))
    assert {r["id"]: r["embedding"] for r in s.read("entities").collect()} == {"a": [1.0], "b": None}
    assert s.snapshot() == 1 and s.snapshot() == 2 and [tuple(r)[:3] for r in s.read("snapshots").orderBy("version").collect()] == [(1, 2, 1), (2, 2, 1)]
    assert s.query("select count(*) as n from entities where name = :n", n="B").first()["n"] == 1
    s.clear()
    assert s.read("entities").count() == s.read("relationships").count() == 0 and s.state().totals["entities"] == 0


DOCS = [("d1", "p", "Alice Smith met Bob Jones in Paris.\nBob Jones and Carol White work.\nCarol White met Alice Smith."), ("d2", "p", "Dan Brown wrote to Eve Black.\nEve Black met Dan Brown and Fay Green.\nFay Green knows Dan Brown. Weight 12 kg.")]
KIND = "id string, path string, text string"


def test_an_engine_on_deltas(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def model(texts):
        for t in texts:
            (seen / f"{abs(hash(t))}-{os.urandom(4).hex()}").write_text(t)
        return vectors.hashed_words(texts)

    def asked():
        found = sorted(p.read_text() for p in seen.iterdir())
        for p in seen.iterdir():
            p.unlink()
        return found

    engine = Engine(spark, DeltaStore(spark, str(tmp_path / "g"), 8), separator="\n", model=model, incremental=True)
    report = engine.ingest(spark.createDataFrame(DOCS, KIND), "r1")
    texts = asked()
    assert report["entities"] == report["changed_entities"] >= 6 and report["communities"] >= 2 and len(texts) == len(set(texts)) == report["embedded_texts"]
    edges = engine.store.read("relationships")
    assert edges.where("embedding is null").count() == 0 == engine.store.read("entities").where("embedding is null").count()
    tables = ("entities", "relationships", "attributes", "events", "names", "vectors")
    before = [rows(engine.store, t) for t in tables] + [engine.store.read("changes").count()]
    assert engine.ingest(spark.createDataFrame(DOCS, KIND), "r1")["embedded_texts"] == 0 and asked() == []
    assert before == [rows(engine.store, t) for t in tables] + [engine.store.read("changes").count()]
    was = {r["community_id"]: sorted(r["members"]) for r in engine.store.read("communities").collect()}
    # one more relation changes one entity's neighbours and no other text
    more = engine.ingest(spark.createDataFrame([("d3", "p", "Gil Gray met Alice Smith.")], KIND), "r2")
    assert more["changed_entities"] == 2 and more["changed_relationships"] == 1 and more["embedded_texts"] == len(asked()) == 2
    assert more["entities"] == report["entities"] + 1 and engine.store.state().totals["entities"] == more["entities"]
    # what the batch didn't touch is in the communities that it was in
    now = {r["community_id"]: sorted(r["members"]) for r in engine.store.read("communities").collect()}
    assert sum(was.get(c) == m for c, m in now.items()) >= len(was) - 1
    steps = engine.plan("What is the history of Alice Smith?")
    assert [s.action for s in steps][-2:] == ["timeline", "context_consistency"]
    found = engine.answer("What is the history of Alice Smith?", steps=steps)
    assert [s["step"] for s in found["steps"]] == [s.action for s in steps] and found["timeline"][-1]["entity_count"] == engine.store.read("entities").count()
    short = engine.answer("What is the history of Alice Smith?", steps=[steps[3], steps[0]])
    assert [s["step"] for s in short["steps"]] == ["vector_retrieve", "entity_lookup"] and short["evidence"] == [] and short["neighbours"]
    with pytest.raises(ValueError):
        engine.execute([type(steps[0])("answer", "", {})], "x")
    gone = engine.store.read("entities").where("name = 'Gil Gray'").select("id")
    engine.store.commit({}, gone={"entities": gone})
    assert engine.evict_vectors() == 1 and engine.evict_vectors() == 0


def test_settings_and_templates_are_read_by_the_engine(spark, tmp_path):
    settings = {"chunking": {"max_chars": 60, "min_chars": 10, "overlap_chars": 0}, "scoring": {"relation_weights": {"RELATED_TO": 0.25}}, "extraction": {"rate_limit": 0.001, "max_workers": 2}, "retry_settings": {"enable_retry": True, "max_retries": 1, "retry_delay": 0}}
    engine = Engine.configured(spark, DeltaStore(spark, str(tmp_path / "a"), 4), settings, separator="\n")
    assert engine.ingest(spark.createDataFrame(DOCS, KIND), "r1")["segments"] > 2 and engine.calls == {"rate": 1000.0, "tasks": 2, "retries": 1, "delay": 0.0}
    question = "Who is the partner of Alice Smith?"
    first = engine.answer(question)
    assert first["template"] == "partner_direct" and first["evidence"][0]["score"] >= 1.25
    templates = [{"intent": "relation", "name": "partner_direct", "priority": 9, "weight": 3}, {"intent": "relation", "name": "partner_fuzzy", "priority": 1, "weight": 2}, {"intent": "fallback", "name": "generic_neighbors"}]
    other = Engine.configured(spark, engine.store, {}, templates)
    found = other.answer(question)
    assert found["template"] == "partner_fuzzy" and found["evidence"][0]["score"] >= 2 and [p.name for p in other.patterns["relation"]] == ["partner_direct", "partner_fuzzy"]
    many = other.answer_all(spark.createDataFrame([("q", question)], "question_id string, text string")).first()
    assert many["template"] == "partner_fuzzy"
