"""The engine: documents into a stored graph, questions into ranked evidence, and the graph's health."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, extract, graph, metrics, resolve, retrieval, slots, vectors
from ..sources.corpus import documents_or_scan
from ..sources.store import ChangeSet, GraphStore
from . import batch


#: The actions that a step may have.
ACTIONS = ("entity_lookup", "community_context", "graph_retrieve", "vector_retrieve", "timeline", "context_consistency")


@dataclass(frozen=True)
class Step:
    """A step of an answer's plan."""

    action: str
    description: str
    arguments: dict = field(default_factory=dict)


@dataclass
class Engine:
    """Slots, each with an offline default: an extractor of segments, an embedding model, weights of relations; of a
    question its class, its key entities, queries to try and the answer's text; of a community its title and summary.
    """

    spark: SparkSession
    store: GraphStore
    folder: str = "documents"
    extractor: Callable[[str], dict | str] = extract.rule_extractor
    model: object = vectors.hashed_words
    relation_weights: dict[str, float] = field(default_factory=dict)
    merge_similar: bool = False
    separator: str = r"\n\s*\n"
    classify: Callable[[str], str] | None = None
    analyse: Callable[[str], list[str]] | None = None
    summarise: Callable[[pd.DataFrame], pd.DataFrame] | None = None
    write_queries: Callable[[str, list[str], list[str]], list[str]] | None = None
    write_answer: Callable[[str, list[str]], str] | None = None
    #: Graph patterns by bucket, in place of those of the library.
    patterns: dict[str, list[retrieval.Pattern]] | None = None
    #: Greatest and least characters of a segment, and those that it repeats of the one before.
    chunks: tuple[int, int, int] = (chunking.MAX_CHARS, chunking.MIN_CHARS, chunking.OVERLAP)
    #: Calls of the extractor: `rate`, `tasks`, `retries`, `delay`, as `extract.answers` takes them.
    calls: dict = field(default_factory=dict)
    #: The embedding model's name in the store's cache of vectors.
    model_name: str = "default"
    #: Communities begin with the stored ones, and only what a batch touches moves at first.
    incremental: bool = False

    @classmethod
    def configured(cls, spark: SparkSession, store: GraphStore, settings: dict, templates: list[dict] | None = None, **slots_) -> Engine:
        """An engine of settings as `corpus.read_settings` gives them (chunking, extraction, retry_settings, scoring) and of pattern templates (intent, name, priority, weight)."""
        cut, said, again = (settings.get(k) or {} for k in ("chunking", "extraction", "retry_settings"))
        calls = {}
        if said.get("rate_limit"):
            calls = {"rate": 1 / float(said["rate_limit"]), "tasks": int(said.get("max_workers", 4))}
        if again.get("enable_retry"):
            calls |= {"retries": int(again.get("max_retries", 3)), "delay": float(again.get("retry_delay", 1))}
        weights = {str(k).lower(): float(v) for k, v in ((settings.get("scoring") or {}).get("relation_weights") or {}).items()}
        sizes = tuple(int(cut.get(k, d)) for k, d in (("max_chars", chunking.MAX_CHARS), ("min_chars", chunking.MIN_CHARS), ("overlap_chars", chunking.OVERLAP)))
        return cls(spark, store, relation_weights=weights, chunks=sizes, calls=calls, patterns=retrieval.patterns_of(templates) if templates else None, **slots_)

    def change_set(self, documents: DataFrame, run_id: str = "") -> tuple[ChangeSet, DataFrame]:
        """What the documents say as rows to put, and the extractor's answers, which are asked for once."""
        most, least, overlap = self.chunks
        segments = graph.checkpointed(chunking.segments(documents, most, least, overlap, self.separator))
        answered = graph.checkpointed(extract.answers(segments, self.extractor, **self.calls))
        clean = resolve.clean_entities(extract.records(answered, "entities"))
        related = resolve.clean_relationships(extract.records(answered, "relationships"), clean)
        # documents in the order of their hashes, then places in them: an order that no partitioning changes
        place = F.xxhash64("document_id").cast("decimal(38,0)") * F.lit(1 << 40).cast("decimal(18,0)") + F.col("ord")
        entities = resolve.canonical_entities(clean.withColumn("ord", place.cast("decimal(38,0)")))
        relations = resolve.aggregate_relationships(resolve.relationships_between(related, entities))
        ids = entities.select("name", "id")
        aliases = graph.checkpointed(resolve.alias_lookup(entities.withColumn("ord", F.col("norm"))))
        if self.merge_similar:
            pairs = resolve.similar_pairs(entities)
            groups = graph.connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
            entities = resolve.merge_entities(entities.withColumn("ord", F.xxhash64("id")), groups)
        known = resolve.change_set_ids(entities.withColumn("ord", F.lit(0)), self.store.known_ids(entities))
        entities = graph.checkpointed(entities.drop("id").join(known, "name"))
        ends = resolve.relationship_ends(relations.withColumn("source_id", F.lit(None).cast("string")).withColumn("target_id", F.lit(None).cast("string")), known if not self.merge_similar else ids)
        found = resolve.attribute_records(extract.records(answered, "attributes"))
        change = ChangeSet(
            run_id,
            entities.select("id", "name", "type", "description", "aliases"),
            ends.select("id", "source_id", "target_id", "source", "target", "relationship", "description"),
            resolve.attributed(found, aliases, known),
            resolve.resolve_participants(resolve.event_records(extract.records(answered, "events")), aliases),
            extract.provenance(answered, run_id),
        )
        return change, answered

    def embed_changed(self) -> int:
        """Embeds entities and relationships that have no embedding, texts that were embedded before from the cache; how many texts were new."""
        new = 0
        of = {"entities": T.entity_text("name", "type", "description"), "relationships": T.relationship_text("relationship", "description")}
        for name, text in of.items():
            left = self.store.read(name).where("embedding is null")
            every, fresh = vectors.embed_changed(left, "id", text, self.store.read("vectors"), self.model, self.model_name)
            every = graph.checkpointed(every.select("key", "vector").dropDuplicates(["key"]))
            if count := fresh.count():
                self.store.put("vectors", fresh)
                new += count
            if not every.isEmpty():
                self.store.store_embeddings(every, name)
        return new

    def evict_vectors(self) -> int:
        """Takes the cached vectors away whose text no stored entity or relationship has."""
        entities, edges = self.store.read("entities"), self.store.read("relationships")
        texts = entities.select(T.entity_text("name", "type", "description").alias("text")).union(edges.select(T.relationship_text("relationship", "description")))
        gone = graph.checkpointed(vectors.unused(self.store.read("vectors"), texts, self.model_name))
        if n := gone.count():
            self.store.forget("vectors", gone)
        return n

    def communities(self, edges: DataFrame, change: ChangeSet) -> DataFrame:
        """(node, community) of the stored graph. With `incremental`, from the stored communities on."""
        if not self.incremental:
            return graph.louvain(graph.simple_edges(edges))
        start = self.store.read("belongs_to").groupBy(F.col("entity_id").alias("node")).agg(F.min("community_id").alias("community"))
        touched = change.entities.select(F.col("id").alias("node")).union(change.relationships.select(F.explode(F.array("source_id", "target_id"))))
        return graph.louvain(graph.simple_edges(edges), start=start, touched=touched.distinct())

    def ingest(self, corpus: DataFrame | None = None, run_id: str = "") -> dict:
        """Chunks, extracts, resolves and stores; then communities, embeddings, their change, and a report.

        A batch that runs again under its run_id leaves the same rows in every table, the history too: all are put by their keys. With
        `incremental`, a batch that runs again may move communities closer to the best.
        """
        before = graph.checkpointed(self.store.read("communities").select("community_id", "members"))
        documents = documents_or_scan(self.spark, corpus, self.folder)
        change, answered = self.change_set(documents, run_id)
        self.store.apply(change)
        stored, edges = self.store.read("entities"), self.store.read("relationships")
        membership = graph.checkpointed(self.communities(edges, change))
        profiles = graph.checkpointed(slots.summaries(graph.profiles(stored, edges, membership), self.summarise))
        self.store.replace_communities(profiles)
        embedded = self.embed_changed()
        moved = graph.community_evolution(before, self.store.read("communities").select("community_id", "members"))
        version = self.store.snapshot()
        counts = {name: self.store.read(name).count() for name in ("entities", "relationships", "communities", "attributes", "events")}
        mine = {"changed_entities": change.entity_count(), "changed_relationships": change.relationship_count(), "embedded_texts": embedded}
        said = answered.agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failed")).first()
        return {"documents": documents.count(), "segments": said["n"], "failed_segments": said["failed"], "snapshot_version": version, **counts, **mine, "community_alerts": moved.where("alert").count(), **self.health()}

    def health(self) -> dict:
        stored, edges = self.store.read("entities"), self.store.read("relationships")
        membership = self.store.read("belongs_to").select(F.col("entity_id").alias("node"), F.col("community_id").alias("community"))
        shape = graph.community_metrics(graph.simple_edges(edges), membership)
        return metrics.health_report(metrics.snapshot_metrics(stored, edges), self.store.read("attributes"), shape).first().asDict()

    def focus(self, question: str) -> tuple[str, list[str], dict]:
        """(class, focus ids, what the patterns may be given) of a question."""
        entities = self.store.read("entities")
        asked = self.spark.createDataFrame([("q", question)], "question_id string, text string")
        row = asked.select(T.intent("text").alias("intent"), T.context_terms("text").alias("terms"), T.search_terms("text").alias("search")).first()
        kind = self.classify(question) if self.classify else row["intent"]
        kind = kind if kind in T.INTENT_BUCKETS else "descriptive"
        # the slot's key entities stand for the question where it gives some
        text = " ; ".join(keys) if self.analyse and (keys := self.analyse(question)) else question
        asked = self.spark.createDataFrame([("q", text)], "question_id string, text string")
        names = entities.select(F.col("name").alias("alias"), F.col("id").alias("entity_id"), F.xxhash64("id").alias("pos"))
        aliases = entities.select(F.explode("aliases").alias("alias"), F.col("id").alias("entity_id"), F.xxhash64("id").alias("pos"))
        found = retrieval.focus_entities(asked, aliases, names).first()
        focus = found["focus_ids"] if found else []
        named = entities.where(F.col("id").isin(focus)).select("id", "name", "aliases").collect()
        terms = sorted({x.lower() for r in named for x in [r["name"], *(r["aliases"] or [])] if x})
        given = {"focus_ids": focus[:1] if T.INTENT_BUCKETS[kind] == "comparative" else focus, "secondary_ids": focus[1:], "all_aliases": terms, "context_terms": row["terms"], "relationship_keywords": [], "search_terms": row["search"]}
        return kind, focus, given

    def plan(self, question: str, limit: int = 10) -> list[Step]:
        """The steps of an answer: which entities, their communities, the graph patterns in their order, neighbours by embedding, the check."""
        kind, focus, given = self.focus(question)
        bucket = T.INTENT_BUCKETS[kind]
        patterns = retrieval.chain_for(bucket, self.patterns) if focus else []
        steps = [
            Step("entity_lookup", "which entities the question is about", {"intent": kind, "focus_ids": focus}),
            Step("community_context", "what their communities are", {}),
            Step("graph_retrieve", "relations by patterns, then by terms, then by written queries", {"bucket": bucket, "patterns": [p.name for p in patterns], "limit": limit, "given": given}),
            Step("vector_retrieve", "entities of near texts", {"top_k": 3 if kind in ("temporal", "attribute") else 5}),
            Step("context_consistency", "whether there is evidence", {}),
        ]
        if kind == "temporal":  # what the store held when
            steps.insert(-1, Step("timeline", "the versions of the graph", {"limit": limit}))
        return steps

    def _graph_evidence(self, question: str, arguments: dict, strict_chain: bool) -> tuple[DataFrame, str]:
        """The first pattern with rows, else a search by terms, else the rows of queries that the slot writes and that only read."""
        entities, edges, given = self.store.read("entities"), self.store.read("relationships"), arguments["given"]
        patterns = {p.name: p for group in (self.patterns or retrieval.PATTERNS).values() for p in group}

        def scored(rows: DataFrame, name: str, weight: float) -> DataFrame:
            return retrieval.normalized(rows, name, weight, given["all_aliases"], None, self.relation_weights)

        for p in map(patterns.__getitem__, arguments["patterns"]):
            if strict_chain and any(not given[n] for n in p.needs):
                continue
            rows = p.rows(entities, edges, **given)
            if strict_chain and "source_name" not in rows.columns:
                if not rows.isEmpty():
                    break
                continue
            found = scored(rows, p.name, p.weight)
            if not found.isEmpty():
                return found, p.name
        found = scored(retrieval.term_search(edges, given["search_terms"]), "term_search", 0.5)
        if self.write_queries and found.isEmpty():
            for sql in self.write_queries(question, given["all_aliases"], given["context_terms"])[:3]:
                if self.spark.createDataFrame([(sql,)], "q string").select(T.is_read_only("q").alias("ok")).first()["ok"]:
                    rows = scored(self.store.query(sql), "written_query", 0.6)
                    if not rows.isEmpty():
                        return rows, "written_query"
        return found, "term_search"

    # The steps of a plan: each reads what the ones before it found, and adds its own.
    def _entity_lookup(self, question: str, arguments: dict, found: dict) -> dict:
        return {"intent": arguments["intent"], "focus_ids": arguments["focus_ids"]}

    def _community_context(self, question: str, arguments: dict, found: dict) -> dict:
        matched = self.spark.createDataFrame([(x, i) for i, x in enumerate(found.get("focus_ids", []))], "id string, pos int")
        member = self.store.read("communities").select("community_id", "title", "summary", F.explode("members").alias("id"))
        rows = matched.join(member, "id").groupBy("community_id", "title", "summary").agg(F.min("pos").alias("pos")).orderBy("pos", "community_id")
        return {"communities": [r.asDict() for r in rows.collect()]}

    def _graph_retrieve(self, question: str, arguments: dict, found: dict) -> dict:
        rows, template = self._graph_evidence(question, arguments, arguments.get("strict_chain", False))
        best = [r.asDict(True) for r in retrieval.ranked(rows, arguments["limit"]).collect()]
        return {"template": template, "evidence": best, "lines": [r["line"] for r in retrieval.evidence_lines(rows).orderBy("place").collect()]}

    def _vector_retrieve(self, question: str, arguments: dict, found: dict) -> dict:
        stored = self.store.read("entities").select(F.col("id").alias("key"), F.col("embedding").alias("vector")).where("vector is not null")
        vector = list(map(float, self.model(pd.Series([question]))[0]))
        return {"neighbours": [r.asDict() for r in vectors.top_k(stored, vector, arguments["top_k"]).collect()]}

    def _timeline(self, question: str, arguments: dict, found: dict) -> dict:
        last = self.store.read("snapshots").orderBy(F.desc("version")).limit(arguments["limit"])
        return {"timeline": [r.asDict(True) for r in last.orderBy("version").collect()]}

    def _context_consistency(self, question: str, arguments: dict, found: dict) -> dict:
        hits = self.spark.createDataFrame([(len(found.get("evidence", [])), len(found.get("neighbours", [])))], "g int, v int")
        return {"verdict": hits.select(metrics.consistency(F.col("g"), F.col("v")).alias("v")).first()["v"]}

    def execute(self, steps: list[Step], question: str) -> dict:
        """What the steps find, in their order: any plan of known actions, each as often as it stands there; an unknown action is an error."""
        found: dict = {"steps": []}
        for step in steps:
            if (run := getattr(self, f"_{step.action}", None)) is None or step.action not in ACTIONS:
                raise ValueError(f"no such step: {step.action}")
            own = run(question, step.arguments, found)
            found["steps"].append({"step": step.action, **own})
            found |= own
        return found

    def answer(self, question: str, limit: int = 10, strict_chain: bool = False, steps: list[Step] | None = None) -> dict:
        """What the plan's steps find, the answer's text and its review.

        strict_chain=True drops rows of patterns that don't name a source and a target, and patterns with empty parameters.
        steps: a plan of one's own in place of `plan`.
        """
        steps = self.plan(question, limit) if steps is None else steps
        found = self.execute([Step(s.action, s.description, s.arguments | {"strict_chain": strict_chain}) if s.action == "graph_retrieve" else s for s in steps], question)
        lines, focus, best, near = (found.get(k, []) for k in ("lines", "focus_ids", "evidence", "neighbours"))
        text = self.write_answer(question, lines) if self.write_answer else "\n".join(lines)
        checked = self.spark.createDataFrame([(text, len(focus), len(best), len(near), found.get("verdict", "ok"))], "a string, e int, g int, v int, c string")
        judged = checked.select(*metrics.review(F.col("a"), F.col("e"), F.col("g"), F.col("v"), F.col("c"))).first().asDict()
        out = {"question": question, "intent": found.get("intent"), "template": found.get("template"), "focus_ids": focus, "communities": found.get("communities", []), "evidence": best, "neighbours": near, "answer": text, "review": judged, "steps": found["steps"]}
        return out | ({"timeline": found["timeline"]} if "timeline" in found else {})

    def answer_all(self, questions: DataFrame, limit: int = 10) -> DataFrame:
        """A row for each question (question_id, text) with what `answer` finds, all of them in one dataflow; the slots for single questions aren't asked."""
        read = self.store.read
        return batch.answers(questions, read("entities"), read("relationships"), read("communities"), self.model, self.patterns, limit, self.relation_weights)
