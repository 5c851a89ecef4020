"""The stages after each other, each on what the one before it kept."""

import itertools

import corpus_pipeline
from tessera.llm import pii, simhash, toxicity
from tessera.llm.common import written


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    columns, model = docs.columns, toxicity.train(docs, labels)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, data))
        if name != "packing":
            assert docs.columns == columns
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score(before, model).where("predicted = 1").select("doc_id").collect()}
            assert bad and {r["doc_id"] for r in before.select("doc_id").collect()} - bad == {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "line_dedup":
            assert docs.count() == before.count()
        if name == "simhash":
            sets = {r["doc_id"]: set(simhash.shingles(r["text"], 5).tolist()) for r in before.collect()}
            holders = {}
            for i, own in sets.items():
                for h in own:
                    holders.setdefault(h, []).append(i)
            linked = {(min(p), max(p)) for own in holders.values() if len(own) < 200 for p in itertools.combinations(own, 2)}
            linked = {(a, b) for a, b in linked if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
            kept = {r["doc_id"] for r in docs.collect()}
            both = {p for p in linked if p[0] in kept and p[1] in kept}
            assert linked and len(both) <= 0.02 * len(linked)  # near copies go
            assert set(sets) - {i for p in linked for i in p} <= kept | {i for i, own in sets.items() if not own}  # and nothing else
        if name == "pii":
            assert docs.count() == before.count() and pii.spans_of(docs).where("spans <> ''").count() == 0 < pii.spans_of(before).where("spans <> ''").count()
    assert docs.columns[0] == "doc_id" and docs.select("doc_id").distinct().count() == before.count()


def test_rows_without_ids_stay(spark, data):
    docs = spark.createDataFrame([(None, "one two three four five", "en", "s", 23), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "x y", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, data))
        # the null and the empty text have one fingerprint
        assert docs.count() == (4 if name in ("toxicity", "line_dedup") else 3)


def test_clashing_columns_and_repeated_rows_pass_every_stage(spark, data):
    passage = " ".join(f"word{i} and more" for i in range(40))
    rows = [(1, f"one begins. {passage}", 5), (2, f"two goes on. {passage} and ends otherwise here", 6), (7, "same text twice here", 7), (7, "same text twice here", 7), (None, "no id", 8), (3, None, 9), (4, "x" * 200_000, 1), (5, "1234 5678 " * 20_000, 1)]
    docs = spark.createDataFrame([(i, t, n, n, n, n, n, n) for i, t, n in rows], "doc_id long, text string, doc int, th int, score int, part int, id int, n_chars int")
    for name, stage in corpus_pipeline.STAGES:
        columns, docs = docs.columns, written(stage(spark, docs, data))
        if name != "packing":
            assert docs.columns == columns
        if name != "packing":
            assert docs.where("doc_id = 7").count() == (2 if name in ("toxicity", "line_dedup") else 1)
            assert docs.where("doc_id is null").count() == 1
    empty = spark.createDataFrame([], "doc_id long, text string, doc int")
    for name, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, data))
        assert empty.count() == 0
