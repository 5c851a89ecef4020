"""Slots for outside models: each is called once for a distinct input, by whole batches, and has an offline default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_key


def once_for_each(rows: DataFrame, keys: list[str], model: Callable[[pd.DataFrame], pd.Series], out: str, kind: str) -> DataFrame:
    """rows with `out`, what the model gives for their keys; it sees each distinct combination once. Null keys are equal."""
    inputs = rows.select(*keys).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: model(b)})

    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in inputs.schema.fields), f"{out} {kind}"])
    found = inputs.mapInPandas(run, fields)
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    return rows.alias("l").join(found.alias("r"), on).select("l.*", f"r.{out}")


def canonical_labels(relations: DataFrame, lexicon: DataFrame | None = None, model: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """`canonical`: the model's label, else that of a lexicon (label, canonical) by key, else the label itself."""
    if model is not None:
        return once_for_each(relations, ["source", "target", "relationship", "description"], model, "_c", "string").withColumn("canonical", F.coalesce("_c", "relationship")).drop("_c")
    if lexicon is None:
        return relations.withColumn("canonical", F.col("relationship"))
    by_key = lexicon.groupBy(label_key("label").alias("_k")).agg(F.min("canonical").alias("_c"))
    return relations.join(by_key, label_key("relationship") == F.col("_k"), "left").withColumn("canonical", F.coalesce("_c", "relationship")).drop("_k", "_c")


def judged_labels(relations: DataFrame, same: Callable[[str, str, str, str], bool]) -> DataFrame:
    """`label`: the first of the pair's labels so far that the judge finds the same, in order; not transitive.

    Statements of one key are one label. The labels of a (source, target) come in their order through one task, which keeps
    those that none before was the same as, and no others: a pair may have any number of statements and of labels. Null ends are equal.
    """
    firsts = relations.groupBy("source", "target", label_key("relationship").alias("key")).agg(F.min_by("relationship", "ord").alias("first"), F.min("ord").alias("ord"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen = None, []
        for b in batches:
            labels = []
            for source, target, label in zip(b["source"], b["target"], b["first"], strict=True):
                if (source, target) != now:
                    now, seen = (source, target), []
                found = next((x for x in seen if same(source, target, x, label)), None)
                if found is None:
                    seen.append(label)
                labels.append(found or label)
            yield b[["source", "target", "key"]].assign(label=labels)

    ordered = firsts.repartition("source", "target").sortWithinPartitions("source", "target", "ord", "key")
    judged = ordered.mapInPandas(fold, "source string, target string, key string, label string")
    keyed = relations.withColumn("key", label_key("relationship"))
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in ("source", "target", "key")]
    return keyed.alias("l").join(judged.alias("r"), on, "left").select(*[f"l.{c}" for c in relations.columns], F.coalesce("r.label", "l.relationship").alias("label"))


def confirmed_pairs(pairs: DataFrame, entities: DataFrame, model: Callable[[pd.DataFrame], pd.Series] | None = None) -> DataFrame:
    """(a, b) of candidate pairs that the model confirms from both names and descriptions; all without a model."""
    if model is None:
        return pairs.select("a", "b")
    for side in ("a", "b"):
        pairs = pairs.join(entities.select(F.col("id").alias(side), F.col("name").alias(f"name_{side}"), F.col("description").alias(f"description_{side}")), side)
    return once_for_each(pairs, ["name_a", "description_a", "name_b", "description_b"], model, "same", "boolean").where("same").select("a", "b")


def relation_weights(relations: DataFrame, base: float = 0.2) -> DataFrame:
    """(relationship, weight): the rarer a label, the higher, from `base` for the most frequent one up to twice that."""
    counts = relations.groupBy(F.lower("relationship").alias("relationship")).agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n").alias("most"))
    return counts.join(most).select("relationship", (F.lit(base) * (F.lit(2.0) - F.col("n") / F.col("most"))).alias("weight"))


def summaries(profiles: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame] | None = None) -> DataFrame:
    """profiles with the model's title, summary and keywords, where it gives some; it sees community_id, member_names and keywords, by batches."""
    if model is None:
        return profiles

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = model(b)
            yield pd.DataFrame({"community_id": b["community_id"], "_t": found.get("title"), "_s": found.get("summary"), "_k": found.get("keywords")})

    kind = profiles.schema["community_id"].dataType.simpleString()
    given = profiles.select("community_id", "member_names", "keywords").mapInPandas(run, f"community_id {kind}, _t string, _s string, _k array<string>")
    out = profiles.join(given, "community_id", "left")
    for own, new in (("title", "_t"), ("summary", "_s"), ("keywords", "_k")):
        out = out.withColumn(own, F.coalesce(new, own))
    return out.select(*profiles.columns)
