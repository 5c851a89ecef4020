"""A training corpus from documents: toxicity, line dedup, SimHash near-dedup, PII, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import line_dedup, packing, pii, simhash, toxicity
from tessera.llm.common import table, written
from tessera.llm.tokens import vocabulary

#: A document is left to the near-dedup stage where what it repeats all comes from one other document, and is this share of both.
COPY_SHARE = 0.9


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of docs, n_chars anew where there is one."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted to the labels of these documents, doesn't reject; all their columns.

    Null and empty texts have no hits and stay, and so do rows without a doc_id, which are scored like others; each row is judged for itself,
    repeated ones alike; no rows give none. Columns beginning with `_tox_` are refused.
    """
    return toxicity.accepted(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def repeated_passages_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that stand earlier; what is a copy of one other document stays whole for the next stage.

    Null, empty and short texts and rows without a doc_id stay as they are; n_chars follows the text; other columns stay; no rows give none.
    Columns beginning with `_ld_` are refused.
    """
    return _like(docs, line_dedup.dedup(docs, copy_share=COPY_SHARE))


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: of its smallest doc_id, there of one text, and of its rows the one of the least text.

    Rows of different texts that share a doc_id are judged each for itself. Rows without a doc_id stay, as do all other columns; null and
    empty texts are copies of each other; no rows give none.
    """
    found = written(simhash.similar(docs).select("doc_id", "digest", "component", "component_id").distinct())
    kept = found.where("doc_id = component_id").groupBy("component", "doc_id").agg(F.min("digest").alias("digest"))
    texts = found.groupBy("doc_id").agg(F.count_distinct("digest").alias("n"))
    kept = written(kept.join(texts, "doc_id").select(F.col("doc_id").alias("_cp_id"), "digest", "n"))
    same = F.col("doc_id") == F.col("_cp_id")
    # where all rows of a doc_id have one text the doc_id says it all, else the text's digest is needed
    plain = docs.join(kept.where("n = 1").select("_cp_id"), same, "left_semi").withColumn("_sim_digest", F.lit(b""))
    mixed = kept.where("n > 1")
    several = simhash.digested(docs.join(mixed.select("_cp_id").distinct(), same, "left_semi"))
    several = several.join(mixed, same & (F.col("_sim_digest") == F.col("digest")), "left_semi")
    mine = plain.unionByName(several).withColumn("_cp_row", F.struct(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    first = Window.partitionBy("doc_id", "_sim_digest").orderBy("_cp_row")
    one = mine.withColumn("_cp_n", F.row_number().over(first)).where("_cp_n = 1").select(*docs.columns)
    return one.unionByName(docs.where("doc_id is null"))


def personal_data_goes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the found spans of personal data put by their kinds; null and empty texts stay, n_chars follows the text; no rows give none."""
    return _like(docs, pii.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence; null and empty texts are their end id alone, rows without a doc_id and repeated ones are packed like others; no rows give none."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", toxic_documents_go),
    ("line_dedup", repeated_passages_go),
    ("simhash", near_copies_go),
    ("pii", personal_data_goes),
    ("packing", packed),
]

#: No stage is expressible in SQL; the tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one returns is written and read as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
