"""Plans of many questions at once: each graph pattern is one join over all the questions that are still without evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics, retrieval, vectors
from ..operators.containment import contained, first_of_each
from ..operators.graph import checkpointed

EVIDENCE = ["question_id", "template", "weight", "source_name", "target_name", "relationship", "description", "path_details"]
ORDER = ["source_name", "target_name", "relationship", "description"]
STRINGS = "array<string>"
#: Patterns whose rows name no target, so that none of them is evidence.
WITHOUT_EVIDENCE = ("attribute_projection",)


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join whose sides both grow with the questions or the graph. Both are sorted: Spark takes a written table for as small as its
    file, and would send one to every task, by way of the driver, that is many times that.
    """
    return left.hint("merge").join(right, on, how)


def with_name(rows: DataFrame, entities: DataFrame, key: str, out: str) -> DataFrame:
    """As `retrieval.named`, of many rows and many entities."""
    return meet(rows, entities.select(F.col("id").alias(key), F.col("name").alias(out)), key)


def asked(questions: DataFrame, entities: DataFrame, focus: DataFrame) -> DataFrame:
    """(question_id, text, intent, bucket, focus_ids, hop_ids, secondary_ids, all_aliases, context_terms, search_terms) of questions (question_id, text).

    focus: (question_id, focus_ids). A comparison goes from the first focus entity to the others, other questions from all of them.
    all_aliases: the names and aliases of the focus entities in lower case, sorted.
    """
    one = meet(focus.select("question_id", F.explode("focus_ids").alias("id")), entities.select("id", "name", "aliases"), "id")
    spelled = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast(STRINGS)))
    terms = one.select("question_id", F.explode(F.transform(spelled, F.lower)).alias("t")).where("t <> ''").groupBy("question_id").agg(F.array_sort(F.collect_set("t")).alias("all_aliases"))
    rows = questions.select("question_id", "text", T.intent("text").alias("intent"), T.context_terms("text").alias("context_terms"), T.search_terms("text").alias("search_terms"))
    rows = rows.join(focus, "question_id", "left").join(terms, "question_id", "left")
    rows = rows.withColumn("focus_ids", F.coalesce("focus_ids", F.array().cast(STRINGS))).withColumn("all_aliases", F.coalesce("all_aliases", F.array().cast(STRINGS))).withColumn("bucket", T.intent_bucket("intent"))
    first = F.when(F.col("bucket") == "comparative", F.slice("focus_ids", 1, 1)).otherwise(F.col("focus_ids"))
    return rows.withColumn("hop_ids", first).withColumn("secondary_ids", F.slice("focus_ids", 2, 100))


class Patterns:
    """The graph patterns as joins: a method takes questions as `asked` gives them and returns (question_id, source_name, target_name, relationship, description, path_details)."""

    def __init__(self, entities: DataFrame, relations: DataFrame):
        self.entities, self.relations = entities, relations
        # ends that aren't known have no name, and so no rows
        self.near = retrieval.either_end(relations)

    def _named(self, rows: DataFrame, **ends: str) -> DataFrame:
        """Rows with the names of their ends: a column for each, of the entity whose id another column has."""
        for out, key in ends.items():
            rows = with_name(rows, self.entities, key, out)
        return rows

    def _rows(self, rows: DataFrame, source: str, target: str, relationship: str | None = "relationship", description: str | None = "description", path: str | None = None) -> DataFrame:
        text = lambda c: F.coalesce(F.col(c), F.lit("")) if c else F.lit("")
        return rows.select("question_id", F.col(source).alias("source_name"), F.col(target).alias("target_name"), text(relationship).alias("relationship"), text(description).alias("description"), (F.col(path) if path else F.lit(None)).cast(retrieval.PATH).alias("path_details"))

    def _focus(self, q: DataFrame, out: str) -> DataFrame:
        return q.select("question_id", F.explode("hop_ids").alias(out))

    def _one_hop(self, q: DataFrame) -> DataFrame:
        met = meet(self._focus(q, "focus_id"), self.near, "focus_id")
        return self._rows(self._named(met, s="focus_id", t="other_id"), "s", "t")

    partner_direct = generic_neighbors = _one_hop

    def partner_fuzzy(self, q: DataFrame) -> DataFrame:
        """Relations one of whose ends contains an alias of the question, or whose label contains one of its terms."""
        edges = self.near.withColumn("_e", F.struct("focus_id", "other_id", "relationship", "description"))
        alias = q.select("question_id", F.explode("all_aliases").alias("pattern"))
        names = contained(self.entities.select(F.col("id").alias("text_id"), F.col("name").alias("text")), alias.select("pattern"))
        by_name = meet(names, alias, "pattern").select("question_id", F.col("text_id").alias("id")).distinct()
        term = q.select("question_id", F.explode("context_terms").alias("pattern"))
        labels = self.relations.select(F.col("relationship").alias("text_id"), F.col("relationship").alias("text")).distinct()
        by_label = meet(contained(labels, term.select("pattern")), term, "pattern").select("question_id", F.col("text_id").alias("relationship")).distinct()
        met = [meet(edges, by_name.withColumnRenamed("id", end), end).select("question_id", "_e") for end in ("focus_id", "other_id")]
        every = met[0].union(met[1]).union(meet(edges, by_label, "relationship").select("question_id", "_e")).distinct().select("question_id", "_e.*")
        return self._rows(self._named(every, s="focus_id", t="other_id"), "s", "t")

    def _two_hops(self, q: DataFrame, some: bool) -> DataFrame:
        """Directed paths of two different relations; with `some`, those one of whose labels contains a term of the question."""
        edges = self.relations.withColumn("_id", F.xxhash64("source_id", "relationship", "target_id", "description"))
        ends = q.select("question_id", "context_terms", F.explode("hop_ids").alias("source_id"))
        a, b = meet(ends, edges, "source_id").alias("a"), edges.alias("b")
        paths = meet(a, b, F.expr("a.target_id = b.source_id and a._id <> b._id")).select("question_id", "context_terms", "a.source_id", F.col("a.target_id").alias("mid_id"), F.col("b.target_id").alias("target_id"), F.col("a.relationship").alias("rel1"), F.col("b.relationship").alias("rel2"))
        if some:
            paths = paths.where(F.exists("context_terms", lambda t: F.contains(F.lower("rel1"), t) | F.contains(F.lower("rel2"), t)))
        paths = self._named(paths, s="source_id", mid="mid_id", t="target_id")
        gathered = paths.groupBy("question_id", "source_id", "s", "target_id", "t").agg(F.array_sort(F.collect_list(F.struct("mid", "rel1", "rel2"))).alias("p"))
        return self._rows(gathered, "s", "t", None, None, "p")

    def partner_two_hop(self, q: DataFrame) -> DataFrame:
        return self._two_hops(q, False)

    def causal_two_hop(self, q: DataFrame) -> DataFrame:
        return self._two_hops(q, True)

    def timeline_events(self, q: DataFrame) -> DataFrame:
        edges = self.relations.where("relationship = 'RELATED_TO'").select(F.col("source_id").alias("focus_id"), F.col("target_id").alias("_e"))
        events = self.entities.where("type = 'EVENT'").select(F.col("id").alias("_e"), F.col("name").alias("t"), F.col("description").alias("d"))
        met = meet(meet(self._focus(q, "focus_id"), edges, "focus_id"), events, "_e")
        return self._rows(self._named(met, s="focus_id"), "s", "t", None, "d")

    def comparative_relationships(self, q: DataFrame) -> DataFrame:
        pairs = q.select("question_id", F.explode("hop_ids").alias("source_id"), "secondary_ids").select("question_id", "source_id", F.explode("secondary_ids").alias("target_id"))
        met = meet(pairs, self.relations.select("source_id", "target_id", "relationship", "description"), ["source_id", "target_id"])
        return self._rows(self._named(met, s="source_id", t="target_id"), "s", "t")

    def term_search(self, q: DataFrame) -> DataFrame:
        """A row for each term that an end or the label of a relation (with source and target names) contains."""
        term = q.select("question_id", F.explode("search_terms").alias("pattern")).withColumn("pattern", F.lower("pattern"))
        edges = self.relations.select("source", "relationship", "target", "description").withColumn("_e", F.struct("source", "relationship", "target", "description"))
        texts = edges.select(F.explode(F.array("source", "target", "relationship")).alias("text")).distinct()
        hits = contained(texts.select(F.col("text").alias("text_id"), "text"), term.select("pattern"))
        met = [meet(edges, hits, F.col(c) == F.col("text_id")).select("pattern", "_e") for c in ("source", "target", "relationship")]
        every = meet(met[0].union(met[1]).union(met[2]).distinct(), term, "pattern").select("question_id", "_e.*")
        return self._rows(every, "source", "target")


def evidence(rows: DataFrame, entities: DataFrame, relations: DataFrame, patterns: dict[str, list[retrieval.Pattern]] | None = None, limit: int = 10, relation_weights: dict[str, float] | None = None) -> DataFrame:
    """(question_id, place, template, score, source_name, target_name, relationship, description, path_details): the `limit` best of each question.

    rows: as `asked`. A pattern is tried for all questions at once that try it next and have no evidence yet, the searched terms
    for those left at the end: the first pattern with rows is a question's, and none is asked about one by one. Relations that are equal in
    all columns count once.
    """
    tried, known = Patterns(entities, relations), patterns or retrieval.PATTERNS
    chains = {bucket: retrieval.chain_for(bucket, known) for bucket in T.INTENT_BUCKETS.values()}
    open_, found = checkpointed(rows), None
    # a place in the order of trying after the other, each pattern at it once for all its buckets
    steps = max(map(len, chains.values()))
    for i in range(steps + 1):
        tries: dict[tuple[str, float], list[str]] = {}
        for bucket, chain in chains.items():
            if i < len(chain):
                tries.setdefault((chain[i].name, chain[i].weight), []).append(bucket)
        parts = []
        for (name, weight), buckets in tries.items():
            if name in WITHOUT_EVIDENCE:
                continue
            own = open_.where(F.col("bucket").isin(buckets) & (F.size("focus_ids") > 0))
            parts.append(getattr(tried, name)(own).select("question_id", F.lit(name).alias("template"), F.lit(float(weight)).alias("weight"), *EVIDENCE[3:]))
        if i == steps:
            parts = [tried.term_search(open_).select("question_id", F.lit("term_search").alias("template"), F.lit(0.5).alias("weight"), *EVIDENCE[3:])]
        if not parts:
            continue
        new = parts[0]
        for part in parts[1:]:
            new = new.unionByName(part)
        new = checkpointed(new.where("source_name <> '' and target_name <> ''"))
        found = new if found is None else found.unionByName(new)
        if i < steps:
            open_ = checkpointed(meet(open_, new.select("question_id").distinct(), "question_id", "left_anti"))
    hops = F.when(F.size("path_details") > 0, F.size("path_details")).otherwise(0)
    named = meet(found, rows.select("question_id", "all_aliases"), "question_id")
    score = T.evidence_score(F.col("weight"), "relationship", "source_name", "target_name", "all_aliases", hops, None, relation_weights)
    described = F.when((F.col("description") == "") & (hops > 0), T.hop_text("path_details")).otherwise(F.col("description"))
    scored = named.withColumn("score", score).withColumn("description", described).select("question_id", "template", "score", *ORDER, "path_details")
    return first_of_each(scored, ["question_id"], [F.desc("score"), *map(F.col, ORDER)], limit)


def listed(rows: DataFrame, order: str, fields: list[str | Column], out: str) -> DataFrame:
    """(question_id, out): the rows of each question as an array in their order; they must be few."""
    one = F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("_x"))
    return rows.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["_x"]).alias(out))


def answers(questions: DataFrame, entities: DataFrame, relations: DataFrame, communities: DataFrame, model=vectors.hashed_words, patterns: dict[str, list[retrieval.Pattern]] | None = None, limit: int = 10, relation_weights: dict[str, float] | None = None) -> DataFrame:
    """A row for each question (question_id, text): intent, focus_ids, communities, template, evidence, neighbours, answer, concerns, approved, confidence.

    Everything that `Engine.answer` gives one question, for all of them in one dataflow: question_ids must be distinct.
    entities: stored ones, with aliases and embedding; communities: (community_id, members, title, summary).
    """
    pos = F.xxhash64("id").alias("pos")
    names = entities.select(F.col("name").alias("alias"), F.col("id").alias("entity_id"), pos)
    aliases = entities.select(F.explode("aliases").alias("alias"), F.col("id").alias("entity_id"), pos)
    rows = checkpointed(asked(questions, entities, retrieval.focus_entities(questions, aliases, names)))
    found = checkpointed(evidence(rows, entities, relations, patterns, limit, relation_weights))
    line = T.evidence_line("place", "source_name", "relationship", "target_name", "score", "description")
    best = listed(found, "place", ["template", *ORDER, "score"], "evidence").join(found.groupBy("question_id").agg(F.first("template").alias("template")), "question_id")
    texts = listed(found.where("place <= 5"), "place", [line.alias("line")], "lines").select("question_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("answer"))
    member = communities.select("community_id", "title", "summary", F.explode("members").alias("id"))
    met = rows.select("question_id", F.posexplode("focus_ids").alias("at", "id")).join(member, "id").groupBy("question_id", "community_id", "title", "summary").agg(F.min("at").alias("at"))
    near_by = listed(met.withColumn("at", F.struct("at", "community_id")), "at", ["community_id", "title", "summary"], "communities")
    asked_vectors = vectors.embed(rows, "question_id", F.col("text"), model).where(F.exists("vector", lambda x: x != 0))
    stored = entities.select(F.col("id").alias("key"), F.col("embedding").alias("vector")).where("vector is not null")
    close = vectors.batch_top_k(asked_vectors.select(F.col("key").alias("query"), "vector"), stored, 5).withColumnRenamed("query", "question_id").join(rows.select("question_id", "intent"), "question_id")
    close = close.where(F.col("place") <= F.when(F.col("intent").isin("temporal", "attribute"), 3).otherwise(5))
    neighbours = listed(close, "place", ["key", "score"], "neighbours")
    out = rows.select("question_id", "text", "intent", "focus_ids")
    for part in (near_by, best, neighbours, texts):
        out = out.join(part, "question_id", "left")
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    out = out.withColumn("answer", F.coalesce("answer", F.lit(""))).withColumn("template", F.coalesce("template", F.lit("term_search")))
    verdict = metrics.consistency(size("evidence"), size("neighbours"))
    return out.select("*", *metrics.review(F.col("answer"), size("focus_ids"), size("evidence"), size("neighbours"), verdict))
