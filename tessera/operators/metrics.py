"""Profiles of the schema, graph statistics, health, feedback and the review of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import checkpointed


def schema_profile(rows: DataFrame, kind: str, type_column: str, example: str, version: int = 1) -> DataFrame:
    """(version, kind, type, examples, count): UNKNOWN stands for no type."""
    typed = rows.withColumn("_t", F.coalesce(type_column, F.lit("UNKNOWN")))
    out = typed.groupBy(F.col("_t").alias("type")).agg(F.array_sort(F.collect_set(example)).alias("examples"), F.count(F.lit(1)).alias("count"))
    return out.select(F.lit(version).alias("version"), F.lit(kind).alias("kind"), "type", "examples", "count")


def snapshot_metrics(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of counts; no type counts as a type; relations for an entity, to 2 places."""
    none = F.lit("∅")
    e = entities.agg(F.count(F.lit(1)).alias("entity_count"), F.count_distinct(F.coalesce("type", none)).alias("entity_types"))
    r = relations.agg(F.count(F.lit(1)).alias("relationship_count"), F.count_distinct(F.coalesce("relationship", none)).alias("relationship_types"))
    return e.join(r).withColumn("avg_relationship_degree", F.bround(F.col("relationship_count") / F.greatest(F.col("entity_count"), F.lit(1)), 2))


def graph_statistics(entities: DataFrame, relations: DataFrame, membership: DataFrame) -> DataFrame:
    """(statistic, key, value): totals, and counts by entity type and by relation."""
    n_communities = membership.agg(F.count_distinct("community").alias("c"), F.count(F.lit(1)).alias("m"))
    totals = entities.agg(F.count(F.lit(1)).alias("e")).join(relations.agg(F.count(F.lit(1)).alias("r"))).join(n_communities)
    stack = "stack(4, 'total_nodes', e + c, 'entities', e, 'total_relationships', r + m, 'communities', c) as (statistic, value)"
    types = entities.groupBy(F.col("type").alias("key")).count().select(F.lit("entity_type").alias("statistic"), "key", F.col("count").alias("value"))
    labels = relations.groupBy(F.col("relationship").alias("key")).count().select(F.lit("relationship_type").alias("statistic"), "key", F.col("count").alias("value"))
    return totals.selectExpr(stack).select("statistic", F.lit("").alias("key"), "value").union(types).union(labels)


def health(density: Column, has_details: Column, communities: Column, mean_density: Column) -> Column:
    """min(1, half of the density up to 5, .3 of the coverage, .2 of the community factor), 2 places."""
    coverage = F.when(has_details, 1.0).otherwise(0.5)
    factor = F.when(communities > 0, F.least(F.lit(1.0), F.lit(0.6) + F.lit(0.4) * F.coalesce(mean_density, F.lit(0.0)))).otherwise(0.6)
    return F.bround(F.least(F.lit(1.0), F.lit(0.5) * F.least(F.lit(1.0), density / 5) + F.lit(0.3) * coverage + F.lit(0.2) * factor), 2)


def health_report(metrics: DataFrame, details: DataFrame, community_metrics: DataFrame) -> DataFrame:
    """One row: density, coverage, community density and the health score."""
    some = details.limit(1).agg(F.count(F.lit(1)).alias("d"))
    shape = community_metrics.agg(F.count(F.lit(1)).alias("communities"), F.avg("density").alias("m"))
    row = metrics.join(some).join(shape)
    score = health(F.col("avg_relationship_degree"), F.col("d") > 0, F.col("communities"), F.col("m"))
    return row.select("entity_count", "relationship_count", "avg_relationship_degree", F.when(F.col("d") > 0, 1.0).otherwise(0.5).alias("coverage"), "communities", F.bround(F.coalesce("m", F.lit(0.0)), 3).alias("community_density"), score.alias("health_score"))


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """(type, n, messages) of feedback (type, ord, message), messages in order."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("ord", "message"))), lambda x: x["message"])
    return feedback.groupBy("type").agg(F.count(F.lit(1)).alias("n"), lists.alias("messages"))


def consistency(graph_hits: Column, vector_hits: Column) -> Column:
    """insufficient without any evidence, else ok."""
    return F.when((graph_hits == 0) & (vector_hits == 0), "insufficient").otherwise("ok")


def review(answer: Column, n_entities: Column, graph_hits: Column, vector_hits: Column, verdict: Column) -> list[Column]:
    """concerns, approved and confidence of an answer."""
    words = F.size(F.filter(F.split(answer, "(?U)\\s+"), lambda w: w != ""))
    flags = F.array(
        F.when(answer == "", "empty_answer"), F.when(words < 5, "answer_too_short"), F.when(n_entities == 0, "no_entities"),
        F.when((graph_hits == 0) & (vector_hits == 0), "no_evidence"), F.when(verdict == "insufficient", "insufficient_context"),
    )
    concerns = F.filter(flags, lambda x: x.isNotNull())
    approved = F.size(concerns) == 0
    confidence = F.when(approved, "high").when(F.array_contains(concerns, "no_evidence"), "low").otherwise("medium")
    return [concerns.alias("concerns"), approved.alias("approved"), confidence.alias("confidence")]


def document_counts(entities: DataFrame, relations: DataFrame, membership: DataFrame) -> DataFrame:
    """(document_id, entities, relationships, communities) of each document that has entities.

    entities: (document_id, entity_id); relations: (document_id, relation_id); membership: (entity_id, community_id).
    """
    own = entities.distinct()
    e = own.groupBy("document_id").agg(F.count(F.lit(1)).alias("entities"))
    r = relations.groupBy("document_id").agg(F.count_distinct("relation_id").alias("relationships"))
    c = own.join(membership, "entity_id").groupBy("document_id").agg(F.count_distinct("community_id").alias("communities"))
    out = e.join(r, "document_id", "left").join(c, "document_id", "left")
    return out.na.fill(0, ["relationships", "communities"]).select("document_id", "entities", "relationships", "communities")


def timeline(log: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's entries in their order, from place 1; `latest` marks the last. Ties are in the order of the other columns.

    Rows are cut into ranges of (key, order), which are numbered each for itself; how many of a key stand in the ranges before is added. So
    a key may have any share of the rows. Null keys are a key.
    """
    columns = [order, *[c for c in log.columns if c not in (key, order)]]
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = checkpointed(log.repartitionByRange(n, key, *columns).withColumn("_p", F.spark_partition_id()))
    own = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_p", key).orderBy(*columns)))
    parts = rows.groupBy(key, "_p").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(key)
    before = F.coalesce(F.sum("_n").over(by_key.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col(key).alias("_key"), F.col("_p").alias("_q"), before.alias("_before"), F.sum("_n").over(by_key).alias("_all"))
    placed = own.join(parts, (F.col("_p") == F.col("_q")) & F.col(key).eqNullSafe(F.col("_key")))
    place = (F.col("_k") + F.col("_before")).cast("int")
    return placed.select(*log.columns, place.alias("place"), (place == F.col("_all")).alias("latest"))


def as_of(rows: DataFrame, log: DataFrame, keys: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """rows with the values of the last entry of the log with the same keys whose `since` isn't after `at`; null if there is none.

    One sort of both together by key and time, no join of ranges. Of entries of one time the greatest by their values counts. A
    key is put in order by one task.
    """
    rest = [c for c in rows.columns if c not in keys]
    entry = F.struct(*values)
    left = rows.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*rest).alias("_row"), F.lit(None).cast(log.select(entry.alias("e")).schema["e"].dataType).alias("_entry"))
    last = log.groupBy(*keys, F.col(since).alias("_t")).agg(F.max(entry).alias("_entry"))
    right = last.select(*keys, "_t", F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), "_entry")
    before = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("_last", F.last("_entry", ignorenulls=True).over(before)).where("_side = 1")
    return found.select(*keys, "_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])
