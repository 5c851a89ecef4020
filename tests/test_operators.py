"""Small cases of single operators, with results derived by hand."""

import json
import uuid

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, extract, graph, metrics, resolve, retrieval, vectors
from tessera.plans.engine import Engine
from tessera.sources import corpus, store
from tessera.streaming.ingest import ingest_stream, windowed_counts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_greedy_packing_keeps_an_overlap():
    assert chunking.chunk_text("a" * 10 + "\n\n" + "b" * 10, 20, 8, 5) == ["a" * 10, "aaaaa\n\n" + "b" * 10]


def test_overlap_may_repeat_the_next_beginning():
    assert chunking.chunk_text("abc\n\n" + "d" * 18, 20, 0, 7) == ["abc", "abc\n\ndd\n\n" + "d" * 18]


def test_merging_short_chunks():
    assert chunking.merged(["short", "x" * 18], 20, 8) == ["short\n\n" + "x" * 18, "x" * 18]
    assert chunking.merged(["x" * 10, "tiny"], 20, 8) == ["x" * 10 + "\n\ntiny"]


def test_headings():
    assert chunking.chunk_text("# A\n## B") == ["# A\n## B"]
    assert chunking.chunk_text("# A\nbody") == ["body"]
    assert chunking.chunk_text(None) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n", max_size=30), max_size=8))
def test_every_paragraph_is_in_a_chunk(paragraphs):
    whole = [p.strip() for p in paragraphs if p.strip() and "\n\n" not in p and "\n \n" not in p and "\n  " not in p]
    found = chunking.chunk_text("\n\n".join(whole), 25, 10, 4)
    assert all(any(p in c for c in found) for p in whole)


def test_names_and_ids(spark):
    assert one(spark, T.normalize_name(F.lit("  Foo Bar "))) == "foobar"
    assert one(spark, T.normalize_name(F.lit("Foo\tBar"))) == "foo\tbar"
    assert one(spark, T.normalize_name(F.lit(" \t　a  "))) == "a"
    assert one(spark, T.relationship_id(F.lit("a"), F.lit("战略合作"), F.lit("b"))) == "rel::a::-::b"
    assert one(spark, T.relationship_id(F.lit("a"), F.lit("Works With!"), F.lit("b"))) == "rel::a::works-with-::b"


def test_canonical_entity_of_two_records(spark):
    rows = spark.createDataFrame([(1, "X", "T1", "", None), (2, "x ", "T2", "longer description", None)], "ord int, name string, type string, description string, aliases array<string>")
    found = resolve.canonical_entities(rows).collect()
    assert [(r["name"], r["type"], r["description"], r["aliases"]) for r in found] == [("X", "T1", "longer description", ["X", "x"])]


def test_first_equal_label_wins(spark):
    rows = spark.createDataFrame([("a", "b", "Works With", 1), ("a", "b", "workswith", 2), ("a", "b", "other", 3)], "source string, target string, relationship string, ord int")
    assert [r["label"] for r in resolve.equivalent_labels(rows).orderBy("ord").collect()] == ["Works With", "Works With", "other"]


def test_relationships_need_two_of_the_segments_entities(spark):
    e = spark.createDataFrame([("s", "A"), ("s", "B")], "segment_id string, name string")
    r = spark.createDataFrame([("s", "A", "B", ""), ("s", "A", "A", ""), ("s", "A", "C", "")], "segment_id string, source string, target string, relationship string")
    assert [(x["source"], x["target"], x["relationship"]) for x in resolve.clean_relationships(r, e).collect()] == [("A", "B", "RELATED_TO")]


def test_merge_and_remap(spark):
    e = spark.createDataFrame([(i, f"e{i}", f"n{i}", "T", "d" * i, []) for i in range(4)], "ord int, id string, name string, type string, description string, aliases array<string>")
    edges = spark.createDataFrame([("e1", "e2"), ("e2", "e3")], "u string, v string")
    merged = resolve.merge_entities(e, graph.connected_components(edges))
    rows = {r["id"]: r for r in merged.collect()}
    assert set(rows) == {"e0", "e1"} and rows["e1"]["description"] == "ddd" and rows["e1"]["aliases"] == ["n1", "n2", "n3"]
    moved = resolve.remap_edges(spark.createDataFrame([("e3", "e0")], "source_id string, target_id string"), merged).first()
    assert (moved["source_id"], moved["target_id"]) == ("e1", "e0")


def test_similar_pairs_are_all_found(spark):
    import itertools
    import random

    r = random.Random(5)
    names = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(120)})
    rows = spark.createDataFrame([(n, "T", n) for n in names], "id string, type string, norm string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(a, b) for a, b in itertools.combinations(names, 2) if distance(a, b) <= 2 and abs(len(a) - len(b)) <= 0.7 * max(len(a), len(b))}
    assert {(x["a"], x["b"]) for x in resolve.similar_pairs(rows).collect()} == want


def test_components_and_communities(spark):
    pairs = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(50, 50)]
    edges = spark.createDataFrame(pairs, "u int, v int")
    for n in (1, 3, 17):
        found = {r["node"]: r["component"] for r in graph.connected_components(edges.repartition(n)).collect()}
        assert found == {i: i // 10 * 10 for i in range(40)}
    clique = [(a, b) for k in (0, 10) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(4, 10)]
    got = {r["node"]: r["community"] for r in graph.louvain(spark.createDataFrame(clique, "u int, v int")).collect()}
    assert got == {**{i: 0 for i in range(5)}, **{i: 10 for i in range(10, 15)}}


def test_evolution(spark):
    before = spark.createDataFrame([("c0", ["a", "b", "c"])], "community_id string, members array<string>")
    after = spark.createDataFrame([("c0", ["a", "d", "e", "f"]), ("c1", ["z"])], "community_id string, members array<string>")
    rows = {r["community_id"]: r for r in graph.community_evolution(before, after).collect()}
    assert (rows["c0"]["delta_size"], rows["c0"]["added"], rows["c0"]["removed"], rows["c0"]["alert"]) == (1, ["d", "e", "f"], ["b", "c"], True)
    assert rows["c1"]["change"] == "new" and not rows["c1"]["alert"]


def test_scores_and_reviews(spark):
    score = T.evidence_score(F.lit(0.5), F.lit("合作"), F.lit("A"), F.lit("B"), F.array(F.lit("a")), F.lit(2), None, {"合作": 0.3})
    assert one(spark, score) == 1.1
    assert one(spark, T.intent(F.lit("Why is the partner late"))) == "relation"
    assert not one(spark, T.is_read_only(F.lit("MATCH (n) RETURN n.created_at"))) and one(spark, T.is_read_only(F.lit("CALL dbms.x()")))
    row = spark.range(1).select(*metrics.review(F.lit("答案"), F.lit(1), F.lit(1), F.lit(0), F.lit("ok"))).first()
    assert (row["concerns"], row["approved"], row["confidence"]) == (["answer_too_short"], False, "medium")
    assert one(spark, metrics.health(F.lit(2.5), F.lit(True), F.lit(1), F.lit(0.42))) == 0.7
    assert one(spark, metrics.health(F.lit(0.0), F.lit(False), F.lit(0), F.lit(None).cast("double"))) == 0.27


def test_a_row_for_each_term(spark):
    edges = spark.createDataFrame([("ab", "R", "t", "")], "source string, relationship string, target string, description string")
    assert retrieval.term_search(edges, ["a", "b"]).count() == 2


def test_mentions_by_words_are_those_inside_word_bounds(spark):
    q = spark.createDataFrame([("q", "Is New York in the USA?")], "question_id string, text string")
    a = spark.createDataFrame([("new york", "e1"), ("usa", "e2"), ("york i", "e3"), ("", "e4")], "alias string, entity_id string")
    assert {r["entity_id"] for r in retrieval.mentions(q, a, words=True).collect()} == {"e1", "e2"}
    assert {r["entity_id"] for r in retrieval.mentions(q, a).collect()} == {"e1", "e2", "e3"}


def test_vectors(spark):
    rows = spark.createDataFrame([("a", [0.31, 0.9507]), ("b", [0.30, 0.954]), ("c", [0.29, 0.957]), ("d", [0.9, 0.436]), ("z", [0.0, 0.0])], "key string, vector array<double>")
    assert [r["key"] for r in vectors.top_then_threshold(rows, [1.0, 0.0]).collect()] == ["d", "a"]
    assert vectors.top_k(rows, [1.0, 0.0], 10).count() == 4
    cached = vectors.embed(spark.createDataFrame([("k", "x y")], "id string, t string"), "id", F.col("t"))
    again = vectors.embed(spark.createDataFrame([("k", "changed"), ("n", "new")], "id string, t string"), "id", F.col("t"), cached=cached)
    assert {r["key"]: list(r["vector"]) for r in again.collect()}["k"] == list(cached.first()["vector"])


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "One Ü.MD").write_text("# T\r\nbody", "utf-8")
    (tmp_path / "two.txt").write_text("x", "utf-8")
    (tmp_path / "no.csv").write_text("x", "utf-8")
    assert {(r["id"], r["text"]) for r in corpus.read_documents(spark, str(tmp_path)).collect()} == {("One Ü", "# T\nbody"), ("two", "x")}
    (tmp_path / "alias.yaml").write_text("X:\n  - x1\n  - x2\n", "utf-8")
    known = corpus.read_alias_dictionary(spark, str(tmp_path / "alias.yaml"))
    assert {r["variant"] for r in corpus.alias_rows(known).collect()} == {"x1", "x2"}
    assert corpus.read_alias_dictionary(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "s.yaml").write_text("chunk: {max: 10}\nname: n\n", "utf-8")
    assert corpus.read_settings(spark, str(tmp_path / "s.yaml"), {"chunk": {"max": 1, "min": 2}, "other": 3}) == {"chunk": {"max": 10, "min": 2}, "other": 3, "name": "n"}
    assert corpus.read_settings(spark, str(tmp_path / "none.yaml"), {"a": 1}) == {"a": 1}
    assert corpus.write_alias_dictionary(known, str(tmp_path / "out"), None) and not corpus.write_alias_dictionary(known, str(tmp_path / "out"), known)
    found = retrieval.patterns_of([{"intent": "relation", "name": "partner_fuzzy", "priority": 0, "weight": 2}, {"intent": "relation", "name": "partner_direct"}])
    assert [(p.name, p.weight) for p in sorted(found["relation"], key=lambda p: p.priority)] == [("partner_fuzzy", 2.0), ("partner_direct", 1.0)]
    (tmp_path / "e.json").write_text(json.dumps({"model_name": "m", "embeddings": {"k": [1.0, 2.0]}}))
    assert corpus.read_map_embeddings(spark, str(tmp_path / "e.json")).first()["vector"] == [1.0, 2.0]


def test_store_upserts(spark, tmp_path):
    s = store.GraphStore(spark, str(tmp_path / "g"))
    s.upsert_entities(spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string"))
    s.upsert_relationships(spark.createDataFrame([("r", "a", "b", "R"), ("r2", "a", "none", "R")], "id string, source_id string, target_id string, relationship string"))
    s.upsert_entities(spark.createDataFrame([("a", "A2")], "id string, name string"))
    assert {r["id"]: r["name"] for r in s.read("entities").collect()} == {"a": "A2", "b": "B"}
    assert [r["id"] for r in s.read("relationships").collect()] == ["r"]
    assert s.version("entities") == 2 and s.snapshot() == 1 and s.snapshot() == 2
    assert s.query("select count(*) as n from entities where name = :n", n="B").first()["n"] == 1
    with pytest.raises(ValueError):
        s.query("drop table entities")
    s.clear()
    assert s.read("entities").count() == 0


DOCS = [("d1", "p", "Alice Smith met Bob Jones in Paris.\nBob Jones and Carol White work.\nCarol White met Alice Smith."), ("d2", "p", "Dan Brown wrote to Eve Black.\nEve Black met Dan Brown and Fay Green.\nFay Green knows Dan Brown. Weight 12 kg.")]


def test_ingest_and_answer(spark, tmp_path):
    engine = Engine(spark, store.GraphStore(spark, str(tmp_path / "g")), separator="\n")
    report = engine.ingest(spark.createDataFrame(DOCS, "id string, path string, text string"))
    assert report["documents"] == 2 and report["entities"] >= 6 and report["relationships"] > 3 and report["communities"] >= 2 and report["snapshot_version"] == 1
    assert report["attributes"] == 1 and 0 < report["health_score"] <= 1
    answer = engine.answer("Who is the partner of Alice Smith?")
    assert answer["intent"] == "relation" and answer["evidence"] and answer["neighbours"] and answer["template"] == "partner_direct"
    assert {"Alice Smith"} <= {e["source_name"] for e in answer["evidence"]}
    before = engine.store.read("entities").select("id", "name").collect()
    again = engine.ingest(spark.createDataFrame(DOCS, "id string, path string, text string"))
    assert sorted(engine.store.read("entities").select("id", "name").collect()) == sorted(before) and again["snapshot_version"] == 2


def test_stream_ingest(spark, tmp_path):
    spark.createDataFrame(DOCS, "id string, path string, text string").write.parquet(str(tmp_path / "in"))
    engine = Engine(spark, store.GraphStore(spark, str(tmp_path / "g")), separator="\n")
    stream = spark.readStream.schema("id string, path string, text string").parquet(str(tmp_path / "in"))
    ingest_stream(engine, stream, str(tmp_path / "c")).awaitTermination(240)
    assert engine.store.read("entities").count() >= 6


def test_windowed_counts(spark, data, tmp_path):
    spark.read.parquet(f"{data}/events.parquet").write.parquet(str(tmp_path / "events"))
    schema = spark.read.parquet(str(tmp_path / "events")).schema.simpleString().removeprefix("struct<").removesuffix(">")
    found = windowed_counts(spark, str(tmp_path / "events"), schema.replace(":", " "))
    q = found.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) s from w").first()["s"] == spark.read.parquet(f"{data}/events.parquet").count()


def test_a_failing_extractor_gives_nothing(spark):
    segs = spark.createDataFrame([("s", "d", 0, "boom"), ("s2", "d", 1, "Ann met Bo Li"), ("s3", "d", 2, "  ")], "id string, document_id string, position int, text string")

    def bad(t):
        if t == "boom":
            raise ValueError
        return extract.rule_extractor(t)

    found = extract.answers(segs, bad)
    assert {x["segment_id"] for x in extract.records(found, "entities").collect()} == {"s2"} and extract.records(found, "relationships").count() == 1
    assert [x["segment_id"] for x in found.where("failed").collect()] == ["s"]


def test_the_extractor_is_asked_once_and_may_answer_in_json(spark, tmp_path):
    segs = spark.createDataFrame([(f"s{i}", "d", i, f"text {i}") for i in range(4)], "id string, document_id string, position int, text string")

    def model(t):
        (tmp_path / f"{t}-{uuid.uuid4().hex}").write_text("")
        return ['{"entities": [{"name": "A", "type": 3}], "events": [{"title": "T", "participants": ["A"], "context": "c"}]}', "{}", "no json", '{"entities": null}'][int(t[-1])]

    found = graph.checkpointed(extract.answers(segs, model))
    entities, events = extract.records(found, "entities").collect(), resolve.event_records(extract.records(found, "events")).collect()
    assert [(r["name"], r["type"], r["ord"]) for r in entities] == [("A", "3", 0)] and [(r["id"], r["label"]) for r in events] == [("event_d_s0_0", "T")]
    assert len(list(tmp_path.iterdir())) == 4
    log = extract.provenance(found, "run").orderBy("segment_id").collect()
    assert [(r["entities"], r["events"], r["failed"]) for r in log] == [(1, 1, False), (0, 0, False), (0, 0, True), (0, 0, False)] and log[0]["metadata"]["schema_version"] == "1"


def test_slots_of_an_answer(spark, tmp_path):
    def summarise(b):
        return pd.DataFrame({"title": ["t " + x for x in b["community_id"]], "summary": None, "keywords": None}, index=b.index)

    engine = Engine(
        spark, store.GraphStore(spark, str(tmp_path / "g")), separator="\n", classify=lambda q: "temporal", analyse=lambda q: ["Alice Smith"], summarise=summarise, write_answer=lambda q, lines: f"{len(lines)} lines about it, five words",
        write_queries=lambda q, aliases, terms: ["select 1 as create_x", "select name as source, 'IS' as relationship, type as target, '' as description from entities where name = 'Fay Green'"],
    )
    engine.ingest(spark.createDataFrame(DOCS, "id string, path string, text string"), "r1")
    steps = engine.plan("who?")
    assert [s.action for s in steps] == ["entity_lookup", "community_context", "graph_retrieve", "vector_retrieve", "timeline", "context_consistency"] and steps[3].arguments == {"top_k": 3}
    found = engine.answer("who?")
    assert found["intent"] == "temporal" and len(found["focus_ids"]) == 1 and found["communities"] and found["communities"][0]["title"].startswith("t ") and found["answer"].endswith("five words")
    engine.analyse = None
    found = engine.answer("zzz?")
    assert found["template"] == "written_query" and [e["source_name"] for e in found["evidence"]] == ["Fay Green"]


def test_a_replayed_batch_leaves_the_same_rows(spark, tmp_path):
    docs = [*DOCS, ("d3", "p", "Alice Smith moved to Paris in 1931.\nWeight 12 kg, Weight 12 kg.")]
    engine = Engine(spark, store.GraphStore(spark, str(tmp_path / "g")), separator="\n")
    kept = []
    for run in ("r1", "r2"):
        report = engine.ingest(spark.createDataFrame(docs, "id string, path string, text string"), run)
        assert report["events"] == 1 and report["failed_segments"] == 0
        tables = ("entities", "relationships", "attributes", "events", "communities")
        kept.append([sorted(map(str, engine.store.read(t).drop("created_at").collect())) for t in tables])
    assert kept[0] == kept[1] and engine.store.read("changes").count() == 6
    event = engine.store.read("events").first()
    assert event["timestamp"] == "1931" and event["participants"] == ["Alice Smith", "Paris"]
