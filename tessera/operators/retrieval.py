"""Questions against the graph: focus entities, graph patterns, term search, communities and ranked evidence."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .containment import contained, first_of_each
from .graph import checkpointed

PATH = "array<struct<mid:string,rel1:string,rel2:string>>"


def either_end(relations: DataFrame) -> DataFrame:
    """(focus_id, other_id, relationship, description): each relation from either end, a loop once."""
    out = relations.select(F.col("source_id").alias("focus_id"), F.col("target_id").alias("other_id"), "relationship", "description")
    back = relations.where("source_id <> target_id").select(F.col("target_id").alias("focus_id"), F.col("source_id").alias("other_id"), "relationship", "description")
    return out.union(back)


def neighbours(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """The relations from `either_end` whose ends are both known."""
    known = entities.select("id")
    return either_end(relations).join(known.withColumnRenamed("id", "focus_id"), "focus_id", "left_semi").join(known.withColumnRenamed("id", "other_id"), "other_id", "left_semi")


def named(rows: DataFrame, entities: DataFrame, key: str, out: str) -> DataFrame:
    return rows.join(entities.select(F.col("id").alias(key), F.col("name").alias(out)), key)


def one_hop(entities: DataFrame, relations: DataFrame, focus: list[str], other: str = "partner", keywords: list[str] | None = None) -> DataFrame:
    """Relations of the focus entities seen from them; an empty keyword list keeps all."""
    # a branch for each end, so that each filter goes below the joins that relations may be made of
    begins, ends = F.col("source_id").isin(focus), F.col("target_id").isin(focus)
    touching = relations.where(begins).unionByName(relations.where(ends & ~F.coalesce(begins, F.lit(False))))
    near = neighbours(entities, touching).where(F.col("focus_id").isin(focus))
    if keywords:
        near = near.where(T.contains_any(F.lower("relationship"), keywords))
    both = named(named(near, entities, "focus_id", "focus_name"), entities, "other_id", "other_name")
    return both.select("focus_id", "focus_name", F.col("other_id").alias(f"{other}_id"), F.col("other_name").alias(f"{other}_name"), "relationship", "description")


def partner_direct(entities, relations, focus_ids, relationship_keywords=None, **_) -> DataFrame:
    return one_hop(entities, relations, focus_ids, "partner", relationship_keywords).withColumn("relationship_type", F.lit("RELATIONSHIP"))


def partner_fuzzy(entities, relations, all_aliases, context_terms, **_) -> DataFrame:
    """Relations one of whose ends contains an alias, or whose label contains a term, seen from either end."""
    near = named(named(neighbours(entities, relations), entities, "focus_id", "focus_name"), entities, "other_id", "partner_name")
    met = T.contains_any(F.lower("focus_name"), all_aliases) | T.contains_any(F.lower("partner_name"), all_aliases) | T.contains_any(F.lower("relationship"), context_terms)
    return near.where(met).select("focus_id", "focus_name", F.col("other_id").alias("partner_id"), "partner_name", "relationship", "description", F.lit("RELATIONSHIP").alias("relationship_type"))


def attribute_projection(entities, relations, focus_ids, **_) -> DataFrame:
    """One row for each property of a focus entity that isn't null, besides id, name and description."""
    columns = [c for c in entities.columns if c not in ("id", "name", "description")]
    texts = [F.to_json(c).alias(c) if entities.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c).cast("string").alias(c) for c in columns]
    rows = entities.where(F.col("id").isin(focus_ids)).select(F.col("id").alias("focus_id"), F.col("name").alias("focus_name"), *texts)
    return rows.unpivot(["focus_id", "focus_name"], columns, "attribute_key", "attribute_value").where("attribute_value is not null")


def two_hops(entities: DataFrame, relations: DataFrame, focus: list[str], condition: Column | None) -> DataFrame:
    """Directed paths of two different relations from a focus entity, the middle ones gathered by their two ends."""
    edges = relations.withColumn("_id", F.xxhash64("source_id", "relationship", "target_id", "description"))
    a, b = edges.where(F.col("source_id").isin(focus)).alias("a"), edges.alias("b")
    paths = a.join(b, F.expr("a.target_id = b.source_id and a._id <> b._id")).select("a.source_id", F.col("a.target_id").alias("mid_id"), F.col("b.target_id").alias("target_id"), F.col("a.relationship").alias("rel1"), F.col("b.relationship").alias("rel2"))
    if condition is not None:
        paths = paths.where(condition)
    all_named = named(named(named(paths, entities, "source_id", "source_name"), entities, "mid_id", "mid"), entities, "target_id", "target_name")
    return all_named.groupBy("source_id", "source_name", "target_id", "target_name").agg(F.array_sort(F.collect_list(F.struct("mid", "rel1", "rel2"))).alias("path_details"))


def causal_two_hop(entities, relations, focus_ids, context_terms, **_) -> DataFrame:
    return two_hops(entities, relations, focus_ids, T.contains_any(F.lower("rel1"), context_terms) | T.contains_any(F.lower("rel2"), context_terms))


def partner_two_hop(entities, relations, focus_ids, relationship_keywords=None, **_) -> DataFrame:
    some = T.contains_any(F.lower("rel1"), relationship_keywords) | T.contains_any(F.lower("rel2"), relationship_keywords) if relationship_keywords else None
    return two_hops(entities, relations, focus_ids, some).withColumn("relation_mode", F.lit("two_hop"))


def timeline_events(entities, relations, focus_ids, edge_label: str = "RELATED_TO", **_) -> DataFrame:
    """Events that a focus entity is related to, by time, those without one last. entities: with a `timestamp`."""
    if "timestamp" not in entities.columns:
        entities = entities.withColumn("timestamp", F.lit(None).cast("string"))
    edges = relations.where((F.col("relationship") == edge_label) & F.col("source_id").isin(focus_ids)).select(F.col("source_id").alias("focus_id"), F.col("target_id").alias("_e"))
    events = entities.where("type = 'EVENT'").select(F.col("id").alias("_e"), F.col("name").alias("event_name"), F.col("description").alias("event_description"), F.col("timestamp").alias("event_time"))
    return named(edges.join(events, "_e"), entities, "focus_id", "focus_name").select("focus_id", "focus_name", "event_name", "event_description", "event_time").orderBy(F.asc_nulls_last("event_time"), "event_name")


def comparative_relationships(entities, relations, focus_ids, secondary_ids, **_) -> DataFrame:
    edges = relations.where(F.col("source_id").isin(focus_ids) & F.col("target_id").isin(secondary_ids))
    return named(named(edges, entities, "source_id", "source_name"), entities, "target_id", "target_name").select("source_id", "source_name", "target_id", "target_name", "relationship", "description")


def generic_neighbors(entities, relations, focus_ids, **_) -> DataFrame:
    return one_hop(entities, relations, focus_ids, "neighbor")


@dataclass(frozen=True)
class Pattern:
    """A graph pattern: its rows, its place in the order of trying, and its weight in scores."""

    name: str
    rows: Callable[..., DataFrame]
    priority: int = 100
    weight: float = 1.0
    needs: tuple[str, ...] = ()


PATTERNS: dict[str, list[Pattern]] = {
    "relation": [Pattern("partner_direct", partner_direct, 1, 1.0, ("focus_ids", "relationship_keywords")), Pattern("partner_fuzzy", partner_fuzzy, 2, 0.8, ("all_aliases", "context_terms"))],
    "attribute": [Pattern("attribute_projection", attribute_projection, 1, 1.0, ("focus_ids",))],
    "causal": [Pattern("causal_two_hop", causal_two_hop, 1, 1.0, ("focus_ids", "context_terms"))],
    "timeline": [Pattern("timeline_events", timeline_events, 1, 1.0, ("focus_ids",))],
    "comparative": [Pattern("comparative_relationships", comparative_relationships, 1, 1.0, ("focus_ids", "secondary_ids"))],
    "fallback": [Pattern("partner_two_hop", partner_two_hop, 3, 0.7, ("focus_ids", "relationship_keywords")), Pattern("generic_neighbors", generic_neighbors, 99, 0.5, ("focus_ids",))],
}


def patterns_of(settings: list[dict]) -> dict[str, list[Pattern]]:
    """Patterns by bucket from settings (intent, name, priority, weight), as a template file lists them; a name without rows of its own is an error."""
    known, out = {p.name: p for group in PATTERNS.values() for p in group}, {}
    for row in settings:
        own = known[row["name"]]
        out.setdefault(row["intent"], []).append(Pattern(own.name, own.rows, int(row.get("priority", own.priority)), float(row.get("weight", own.weight)), own.needs))
    return out


def patterns_for(bucket: str, patterns: dict[str, list[Pattern]] | None = None) -> list[Pattern]:
    """The bucket's patterns in the order of trying; those of the fallback where it has none."""
    known = patterns or PATTERNS
    return sorted(known.get(bucket) or known.get("fallback", []), key=lambda p: p.priority)


def chain_for(bucket: str, patterns: dict[str, list[Pattern]] | None = None) -> list[Pattern]:
    """All patterns that a question of a bucket tries, in their order: the bucket's, then those of the fallback."""
    return [*patterns_for(bucket, patterns), *(patterns_for("fallback", patterns) if bucket != "fallback" else [])]


def term_search(relations: DataFrame, terms: list[str]) -> DataFrame:
    """(term, source, relationship, target, description): a row for each term that an end or the label contains, so rows repeat.

    relations: with source and target names.
    """
    rows = relations.withColumn("term", F.explode(F.array(*map(F.lit, terms)).cast("array<string>")))
    met = F.contains(F.lower("source"), F.lower("term")) | F.contains(F.lower("target"), F.lower("term")) | F.contains(F.lower("relationship"), F.lower("term"))
    return rows.where(met).select("term", "source", "relationship", "target", "description")


def word_grams(text: str | Column, most_words: int) -> Column:
    """All runs of one to `most_words` words of a text in lower case."""
    words = F.filter(F.split(F.lower(T.col(text)), "[^\\p{L}\\p{N}#]+"), lambda w: w != "")

    def runs(n: int) -> Column:
        of = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
        return F.when(F.size(words) >= n, of).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(n) for n in range(1, most_words + 1)]))


def _mentions(questions: DataFrame, aliases: DataFrame, words: bool, most_words: int) -> DataFrame:
    """question_id and the columns of aliases, the alias in lower case, as `mentions`. Both sides may be large, so they are sorted."""
    q = questions.select("question_id", F.lower("text").alias("_q"))
    a = aliases.withColumn("alias", F.lower("alias")).where("alias <> ''")
    if words:
        found = q.select("question_id", F.explode(word_grams("_q", most_words)).alias("alias"))
    else:
        met = contained(q.select(F.col("question_id").alias("text_id"), F.col("_q").alias("text")), a.select(F.col("alias").alias("pattern")))
        found = met.select(F.col("text_id").alias("question_id"), F.col("pattern").alias("alias"))
    return found.hint("merge").join(a, "alias").select("question_id", *aliases.columns)


def mentions(questions: DataFrame, aliases: DataFrame, words: bool = False, most_words: int = 4) -> DataFrame:
    """(question_id, alias, entity_id) of each alias that a question contains; empty aliases are in none.

    words=False: anywhere, also inside words, by an index of rare grams (`containment.contained`). words=True: whole
    words, by an equi-join on runs of words.
    """
    return _mentions(questions, aliases.select("alias", "entity_id"), words, most_words)


def focus_entities(questions: DataFrame, aliases: DataFrame, names: DataFrame, most: int = 3, words: bool = False) -> DataFrame:
    """(question_id, focus_ids): up to `most` entities, by the first place of an alias, or of a name where no alias is met.

    aliases, names: (alias, entity_id, pos), pos the order of looking. The same frame given twice is looked through once.
    """

    def met(index: DataFrame, asked: DataFrame) -> DataFrame:
        return _mentions(asked, index.where("entity_id is not null").select("alias", "entity_id", "pos"), words, 4).groupBy("question_id", "entity_id").agg(F.min("pos").alias("pos"))

    by_alias = met(aliases, questions)
    every = by_alias
    if names is not aliases:
        rest = questions.join(by_alias.select("question_id").distinct(), "question_id", "left_anti")
        every = by_alias.union(met(names, rest))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("pos", "entity_id"))
    kept = every.withColumn("place", place).where(F.col("place") <= most)
    return kept.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "entity_id"))), lambda x: x["entity_id"]).alias("focus_ids"))


def search_entities(entities: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Entities whose name or description contains the query, in any case; all score 1."""
    q = F.lit(query.lower())
    return entities.where(F.contains(F.lower("name"), q) | F.contains(F.lower(F.coalesce("description", F.lit(""))), q)).select("id", "name", "type", "description", F.lit(1.0).alias("score")).orderBy("id").limit(limit)


def entity_neighbourhood(entities: DataFrame, relations: DataFrame, entity: str, limit: int = 20) -> DataFrame:
    """(direction, relationship, description, other_id, other_name, other_type) of one entity's relations."""
    out = relations.where(F.col("source_id") == entity).select(F.lit("outgoing").alias("direction"), "relationship", "description", F.col("target_id").alias("other_id"))
    into = relations.where(F.col("target_id") == entity).select(F.lit("incoming").alias("direction"), "relationship", "description", F.col("source_id").alias("other_id"))
    others = entities.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("type").alias("other_type"))
    rows = out.unionByName(into).join(others, "other_id").distinct()
    return rows.select("direction", "relationship", "description", "other_id", "other_name", "other_type").orderBy("direction", "relationship", "other_id").limit(limit)


def normalized(rows: DataFrame, pattern: str, weight: float, aliases: list[str], keywords: list[str] | None = None, relation_weights: dict[str, float] | None = None) -> DataFrame:
    """Rows of any pattern as evidence (template, source_name, target_name, relationship, description, path_details, score).

    focus_* stand for the source, partner_* and neighbor_* for the target where there is no other; rows without both ends are dropped.
    """

    def first(*names: str) -> Column:
        found = [F.when(F.col(n) != "", F.col(n)) for n in names if n in rows.columns]
        return F.coalesce(*found, F.lit(None).cast("string")) if found else F.lit(None).cast("string")

    path = F.col("path_details") if "path_details" in rows.columns else F.lit(None).cast(PATH)
    kept = rows.select(
        F.lit(pattern).alias("template"), first("source_name", "source", "focus_name").alias("source_name"), first("target_name", "target", "partner_name", "neighbor_name", "event_name").alias("target_name"),
        F.coalesce(first("relationship", "relationship_type"), F.lit("")).alias("relationship"), F.coalesce(first("description", "event_description"), F.lit("")).alias("description"), path.alias("path_details"),
    ).where("source_name is not null and target_name is not null")
    hops = F.when(F.size("path_details") > 0, F.size("path_details")).otherwise(0)
    alias_list = F.array(*map(F.lit, aliases)).cast("array<string>")
    score = T.evidence_score(F.lit(weight), "relationship", "source_name", "target_name", alias_list, hops, keywords, relation_weights)
    described = F.when((F.col("description") == "") & (hops > 0), T.hop_text("path_details")).otherwise(F.col("description"))
    return kept.withColumn("score", score).withColumn("description", described)


def ranked(evidence: DataFrame, limit: int = 10) -> DataFrame:
    return evidence.orderBy(F.desc("score"), "source_name", "target_name", "relationship", "description").limit(limit)


def evidence_lines(evidence: DataFrame, most: int = 5) -> DataFrame:
    """(place, line) of the best evidence."""
    best = ranked(evidence, most)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "source_name", "target_name", "relationship", "description"))
    return best.withColumn("place", place).select("place", T.evidence_line("place", "source_name", "relationship", "target_name", "score", "description").alias("line"))


def community_context(matched: DataFrame, profiles: DataFrame) -> DataFrame:
    """One short profile for each community of the matched entities (id, pos), in the order of their first mention; the last profile of a member wins."""
    member = profiles.select(F.explode("members").alias("id"), "community_id").groupBy("id").agg(F.max("community_id").alias("community_id"))
    first = matched.join(member, "id").groupBy("community_id").agg(F.min("pos").alias("pos"))
    return profiles.join(first, "community_id").select("pos", "community_id", "title", "summary", "keywords", F.slice("member_names", 1, 10).alias("members"), F.slice("top_entities", 1, 5).alias("top_entities"), F.slice("bridge_entities", 1, 5).alias("bridge_entities"))


def qa_context(found: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, line): the found entities (id, name, type, description) and the relations that touch them."""
    lines = found.select(F.lit("entity").alias("kind"), F.concat(F.col("name"), F.lit(" ("), F.col("type"), F.lit("): "), F.coalesce("description", F.lit(""))).alias("line"))
    ids = found.select("id")
    touching = relations.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").unionByName(relations.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")).distinct()
    return lines.union(touching.select(F.lit("relation"), F.concat("source", F.lit(" -"), "relationship", F.lit("-> "), "target")))


def answer_questions(questions: DataFrame, aliases: DataFrame, names: DataFrame, entities: DataFrame, relations: DataFrame, weight: float = 0.5, limit: int = 10, words: bool = False) -> DataFrame:
    """(question_id, place, source_name, relationship, target_name, description, score): the best relations of each question's focus entities.

    All questions at once: focus entities by alias or name, their relations from either end, scores with the focus names as
    aliases, and the `limit` best of each question. Relations of one focus entity differ in score only by whether the other end
    is named like a focus entity of the question. So a question's best are among the first `limit` of each of its entities and
    the first `limit` of each of them and each focus name of the other end. Those are found once for an entity, and only they
    meet the questions.
    """
    focus = focus_entities(questions, aliases, names, words=words)
    one = checkpointed(named(focus.select("question_id", F.explode("focus_ids").alias("focus_id")), entities, "focus_id", "focus_name").distinct())
    asked, pairs = one.select("focus_id", "focus_name").distinct(), one.select("question_id", "focus_id").distinct()
    lower = one.select("question_id", F.lower("focus_name").alias("alias")).where("alias is not null").distinct()
    order = ["target_name", "relationship", "description"]
    near = named(either_end(relations).join(asked, "focus_id"), entities, "other_id", "target_name").select("focus_id", "focus_name", F.lower("target_name").alias("alias"), *order)
    near = near.distinct()
    ordered = [F.col(c) for c in order]
    firsts = first_of_each(near, ["focus_id", "focus_name"], ordered, limit)
    alike = first_of_each(near.join(lower.select("alias").distinct(), "alias", "left_semi"), ["focus_id", "focus_name", "alias"], ordered, limit)
    met = pairs.hint("merge").join(firsts, "focus_id").select("question_id", "focus_name", *order)
    wanted = pairs.hint("merge").join(lower, "question_id")
    met = met.union(wanted.hint("merge").join(alike, ["focus_id", "alias"]).select("question_id", "focus_name", *order))
    rows = met.distinct().join(one.groupBy("question_id").agg(F.collect_set(F.lower("focus_name")).alias("aliases")), "question_id")
    score = T.evidence_score(F.lit(weight), "relationship", "focus_name", "target_name", "aliases", F.lit(0))
    rows = rows.select("question_id", F.col("focus_name").alias("source_name"), "relationship", "target_name", "description", score.alias("score"))
    return first_of_each(rows, ["question_id"], [F.desc("score"), *map(F.col, ("source_name", "target_name", "relationship", "description"))], limit)
