"""From extracted records to canonical entities and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alias_variants, entity_id, label_key, normalize_name, relationship_id, strip


def clean_entities(raw: DataFrame) -> DataFrame:
    """Stripped names that aren't empty, the first of each name in its segment, with defaults for type and description."""
    named = raw.withColumn("name", strip("name")).where("name is not null and name <> ''")
    first = Window.partitionBy("segment_id", "name").orderBy("ord")
    kept = named.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    some = lambda c: F.when(strip(c) != "", strip(c))
    return kept.withColumn("type", F.coalesce(some("type"), F.lit("CONCEPT"))).withColumn("description", F.coalesce(some("description"), F.concat("name", F.lit("实体"))))


def clean_relationships(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships between two different names of their own segment's entities; the default label is RELATED_TO."""
    names = entities.select("segment_id", "name").distinct()
    kept = raw.withColumn("source", strip("source")).withColumn("target", strip("target")).where("source <> target")
    for end in ("source", "target"):
        kept = kept.join(names.withColumnRenamed("name", end), ["segment_id", end], "left_semi")
    return kept.select(*raw.columns).withColumn("relationship", F.coalesce(F.when(strip("relationship") != "", strip("relationship")), F.lit("RELATED_TO")))


def attribute_records(raw: DataFrame) -> DataFrame:
    """Records with an entity, an attribute and a value; evidence is the segment's first 200 characters if absent, not if empty."""
    some = raw.where("entity <> '' and attribute <> '' and value <> ''")
    return some.select("document_id", "segment_id", F.col("entity").alias("entity_candidate"), "attribute", F.col("value").cast("string").alias("value"), "unit", F.coalesce("evidence", F.left(strip("text"), F.lit(200))).alias("context"), F.coalesce("attribute_type", F.lit("ATTRIBUTE")).alias("attribute_type"))


def attributed(attributes: DataFrame, aliases: DataFrame, ids: DataFrame) -> DataFrame:
    """Attributes with their candidate's canonical name, by `with_alias`, and that one's id of (name, id), null if there is none."""
    named = with_alias(attributes, "entity_candidate", aliases, "_name").withColumn("entity_candidate", F.col("_name")).drop("_name")
    return named.join(ids.select(F.col("name").alias("_n"), F.col("id").alias("entity_id")), F.col("entity_candidate") == F.col("_n"), "left").drop("_n")


def event_records(raw: DataFrame) -> DataFrame:
    """Events with a label and a context; the default id counts all events of the segment, also those passed over."""
    place = F.row_number().over(Window.partitionBy("document_id", "segment_id").orderBy("ord")) - 1
    labelled = raw.withColumn("label", F.coalesce("label", "title")).withColumn("_i", place).where("label <> '' and context <> ''")
    made = F.concat_ws("_", F.lit("event"), "document_id", "segment_id", F.col("_i").cast("string"))
    return labelled.select(F.coalesce("id", made).alias("id"), F.coalesce("type", F.lit("EVENT")).alias("type"), "label", "participants", "document_id", "segment_id", "context", "timestamp")


def with_alias(rows: DataFrame, column: str, aliases: DataFrame, out: str) -> DataFrame:
    """`out`: the canonical name of a raw name, else of its normal form, else the name; '' for null.

    aliases: (alias, canonical), one row for an alias. It isn't broadcast by hint: Spark does so where it is small.
    """
    raw, norm = aliases.select(F.col("alias").alias("_a"), F.col("canonical").alias("_ca")), aliases.select(F.col("alias").alias("_b"), F.col("canonical").alias("_cb"))
    both = rows.join(raw, F.col(column) == F.col("_a"), "left").join(norm, normalize_name(column) == F.col("_b"), "left")
    return both.withColumn(out, F.coalesce("_ca", "_cb", F.col(column), F.lit(""))).drop("_a", "_ca", "_b", "_cb")


def alias_lookup(entities: DataFrame) -> DataFrame:
    """(alias, canonical): names and aliases, raw and in normal form, of all entities; the first (by ord) wins."""
    rows = entities.select("ord", F.col("name").alias("canonical"), F.explode(alias_variants("name", "aliases")).alias("v"))
    both = rows.select("ord", "canonical", F.explode(F.array("v", normalize_name("v"))).alias("alias"))
    return both.where("alias <> ''").groupBy("alias").agg(F.min_by("canonical", "ord").alias("canonical"))


def longest(text: str | Column, order: str = "ord") -> Column:
    """Aggregate: the longest text, the first of several."""
    return F.max_by(text, F.struct(F.length(text), -F.col(order)))


def canonical_entities(raw: DataFrame) -> DataFrame:
    """One entity for each normal form: first name and type, longest description, all raw spellings as aliases.

    raw: (ord, name, type, description, aliases). The first record alone gets '{name} 实体' for an empty description.
    """
    rows = raw.withColumn("norm", normalize_name("name")).where("norm <> ''").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
    first = F.min("ord").over(Window.partitionBy("norm"))
    described = rows.withColumn("_d", F.when((F.coalesce("description", F.lit("")) == "") & (F.col("ord") == first), F.concat(strip("name"), F.lit(" 实体"))).otherwise(F.coalesce("description", F.lit(""))))
    grouped = described.groupBy("norm").agg(
        F.min_by(F.struct(strip("name").alias("name"), F.coalesce("type", F.lit("CONCEPT")).alias("type")), "ord").alias("first"),
        longest("_d").alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(alias_variants("name", "aliases"))))).alias("aliases"),
    )
    return grouped.select(entity_id("norm").alias("id"), "norm", "first.name", "first.type", "description", "aliases")


def relationships_between(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships whose two ends, by normal form, are entities, with the entities' names and ids."""
    ends = entities.select("norm", "name", "id")

    def end(side: str) -> DataFrame:
        return ends.select(F.col("norm").alias(f"_{side}"), F.col("name").alias(f"{side}_name"), F.col("id").alias(f"{side}_id"))

    rows = raw.withColumn("_source", normalize_name("source")).withColumn("_target", normalize_name("target"))
    both = rows.join(end("source"), "_source").join(end("target"), "_target")
    return both.withColumn("source", F.col("source_name")).withColumn("target", F.col("target_name")).drop("_source", "_target", "source_name", "target_name")


def equivalent_labels(raw: DataFrame) -> DataFrame:
    """`label`: the first label (by ord) of the same source, target and key; keys are lower case without white space."""
    first = Window.partitionBy("source", "target", label_key("relationship")).orderBy("ord")
    return raw.withColumn("label", F.first("relationship").over(first))


def aggregate_relationships(raw: DataFrame) -> DataFrame:
    """One relationship for each (source, label, target): longest description, segments, and how many statements."""
    # a label has one key, so the key's groups are the label's
    rows = raw.withColumn("description", F.coalesce("description", F.lit(""))).withColumn("_key", label_key("relationship"))
    grouped = rows.groupBy("source", "_key", "target").agg(F.min_by("relationship", "ord").alias("relationship"), longest("description").alias("description"), F.array_sort(F.collect_set("segment_id")).alias("segments"), F.count(F.lit(1)).alias("statements"))
    return grouped.select("source", "relationship", "target", "description", "segments", "statements").withColumn("id", relationship_id("source", "relationship", "target"))


def repeated_relationships(aggregated: DataFrame) -> DataFrame:
    """(key, segments) of relationships stated in more than one segment."""
    return aggregated.where(F.size("segments") > 1).select(F.concat("source", F.lit("->"), "relationship", F.lit("->"), "target").alias("key"), "segments")


def repeats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Values of the keys found in more than one segment."""
    return rows.groupBy(*keys).agg(F.count_distinct("segment_id").alias("n_segments")).where("n_segments > 1")


def flagged_segments(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Segments that share an entity (name, type) or a relationship with another."""
    out = None
    for rows, keys in ((entities, ["name", "type"]), (relationships, ["source", "target", "relationship"])):
        found = rows.join(repeats(rows, keys), keys, "left_semi").select("segment_id")
        out = found if out is None else out.union(found)
    return out.distinct()


def resolve_participants(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """events with each participant's canonical name, in order, repeats kept."""
    one = events.select("id", F.posexplode("participants").alias("_p", "_name"))
    named = with_alias(one, "_name", aliases, "_canonical")
    lists = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_canonical"))), lambda x: x["_canonical"]).alias("_all"))
    return events.join(lists, "id", "left").withColumn("participants", F.coalesce("_all", F.array().cast("array<string>"))).drop("_all")


def change_set_ids(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """(name, id) of a batch: the stored id of the name, else the first own id, else the name."""
    first = incoming.groupBy("name").agg(F.min_by("id", "ord").alias("_own"))
    return first.join(stored.select("name", F.col("id").alias("_old")), "name", "left").select("name", F.coalesce("_old", "_own", "name").alias("id"))


def relationship_ends(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """source_id and target_id: their own, else by name, else the name; id: its own, else source::type::target."""
    for end in ("source", "target"):
        found = ids.select(F.col("name").alias(end), F.col("id").alias("_id"))
        rows = rows.join(found, end, "left").withColumn(f"{end}_id", F.coalesce(f"{end}_id", "_id", end)).drop("_id")
    return rows.withColumn("id", F.coalesce("id", F.concat_ws("::", "source_id", "relationship", "target_id")))


def unique_ids(rows: DataFrame, order: str = "ord") -> DataFrame:
    """Second and later rows of an id get _1, _2 and so on."""
    n = F.row_number().over(Window.partitionBy("id").orderBy(order)) - 1
    return rows.withColumn("_n", n).withColumn("id", F.when(F.col("_n") == 0, F.col("id")).otherwise(F.concat_ws("_", "id", F.col("_n").cast("string")))).drop("_n")


def similar_pairs(entities: DataFrame, most_edits: int = 2) -> DataFrame:
    """(a, b) of one type, different normal forms within `most_edits` edits, and lengths not over 70 % apart.

    Within an edit distance k, cutting a name into k + 1 pieces leaves one whole, shifted by k at most: pairs
    are found by type, piece and place, so that a large type isn't compared with itself pair by pair.
    """
    k = most_edits
    rows = entities.select("id", "type", "norm", F.length("norm").alias("n"))
    # the pieces of a name of length n begin at i * n div (k + 1)
    begin = lambda i, n: F.floor(F.lit(i) * n / (k + 1))
    piece = F.array(*[F.struct(F.lit(i).alias("i"), F.col("n").alias("of"), F.substring(F.col("norm"), (begin(i, F.col("n")) + 1).cast("int"), (begin(i + 1, F.col("n")) - begin(i, F.col("n"))).cast("int")).alias("s")) for i in range(k + 1)])
    own = rows.select("*", F.explode(piece).alias("p")).select("id", "type", "norm", "n", "p.*")
    # what may be found in the other: for each length that it may have, the pieces' places moved by -k .. k
    shift = F.explode(F.expr(f"flatten(transform(sequence(greatest(n - {k}, 1), n + {k}), m -> flatten(transform(sequence(0, {k}), i -> transform(sequence(-{k}, {k}), d -> named_struct('i', i, 'of', m, 's', substring(norm, greatest(cast(floor(i * m / {k + 1}) as int) + d, 0) + 1, cast(floor((i + 1) * m / {k + 1}) as int) - cast(floor(i * m / {k + 1}) as int))))))))"))
    probes = rows.select("*", shift.alias("p")).select("id", "type", "norm", "n", "p.*").distinct()
    a, b = own.alias("a"), probes.alias("b")
    met = F.expr("a.type = b.type and a.i = b.i and a.of = b.of and a.s = b.s and a.id <> b.id and a.norm <> b.norm")
    close = F.expr(f"levenshtein(a.norm, b.norm) <= {k} and abs(a.n - b.n) <= 0.7 * greatest(a.n, b.n)")
    return a.join(b, met & close).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def merge_entities(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """Entities (ord, id, name, type, description, aliases) with each group of (node, component) put as its first by ord."""
    rows = entities.join(groups, F.col("id") == F.col("node"), "left").withColumn("_g", F.coalesce("component", "id"))
    every = F.flatten(F.collect_list(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    out = rows.groupBy("_g").agg(F.min("ord").alias("ord"), F.min_by(F.struct("id", "name", "type"), "ord").alias("first"), longest(F.coalesce("description", F.lit(""))).alias("description"), F.array_sort(F.array_distinct(every)).alias("aliases"), F.collect_set("id").alias("merged_ids"))
    return out.select("ord", "first.*", "description", "aliases", "merged_ids")


def remap_edges(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges whose ends were merged away, on the entity that stays."""
    to = merged.select(F.explode("merged_ids").alias("_old"), F.col("id").alias("_new"))
    for end in ("source_id", "target_id"):
        edges = edges.join(to, F.col(end) == F.col("_old"), "left").withColumn(end, F.coalesce("_new", end)).drop("_old", "_new")
    return edges
