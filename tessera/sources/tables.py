"""A property graph read out of the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(kind: str, c: str):
    return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, type, description): regions, nations, customers, suppliers and parts."""

    def of(kind: str, k: str, name: str, description):
        return table(spark, sf_dir, kind).select(key(kind, k).alias("id"), F.col(name).alias("name"), F.lit(kind.upper()).alias("type"), description.alias("description"))

    return (
        of("region", "r_regionkey", "r_name", F.concat(F.lit("region "), F.col("r_name")))
        .union(of("nation", "n_nationkey", "n_name", F.concat(F.lit("nation "), F.col("n_name"))))
        .union(of("customer", "c_custkey", "c_name", F.concat(F.lit("customer in "), F.col("c_mktsegment"))))
        .union(of("supplier", "s_suppkey", "s_name", F.concat(F.lit("supplier "), F.col("s_name"))))
        .union(of("part", "p_partkey", "p_name", F.concat_ws(" ", "p_brand", "p_type")))
    )


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, target_id, relationship, description) of who lies where."""

    def of(kind: str, k: str, to: str, t: str):
        return table(spark, sf_dir, kind).select(key(kind, k).alias("source_id"), key(to, t).alias("target_id"), F.lit("LOCATED_IN").alias("relationship"), F.lit(f"{kind} in {to}").alias("description"))

    return of("nation", "n_nationkey", "region", "n_regionkey").union(of("customer", "c_custkey", "nation", "c_nationkey")).union(of("supplier", "s_suppkey", "nation", "s_nationkey"))


def traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct supplier -> part and customer -> part edges of the line items."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")

    def edges(pairs: DataFrame, kind: str, own: str, label: str, description: str) -> DataFrame:
        # numbers are made distinct before they become names
        return pairs.distinct().select(key(kind, own).alias("source_id"), key("part", "l_partkey").alias("target_id"), F.lit(label).alias("relationship"), F.lit(description).alias("description"))

    supplies = edges(items.select("l_suppkey", "l_partkey"), "supplier", "l_suppkey", "SUPPLIES", "supplies part")
    ordered = edges(items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey"), "customer", "o_custkey", "ORDERED", "ordered part")
    return supplies.union(ordered)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark, sf_dir).union(traded(spark, sf_dir))


def raw_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as extracted statements (document_id, segment_id, ord, source, target, relationship, description), labels written in several ways."""
    label = F.when(F.col("l_returnflag") == "A", "Supplies Part").when(F.col("l_returnflag") == "N", "suppliespart").otherwise("ships")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("document_id"),
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.lit("0")).alias("segment_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        key("supplier", "l_suppkey").alias("source"),
        key("part", "l_partkey").alias("target"),
        label.alias("relationship"),
        F.concat(F.lit("status "), F.col("l_linestatus")).alias("description"),
    )


def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as extracted entities (document_id, segment_id, ord, name, type, description, aliases); names repeat."""
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("doc"), (F.col("p_partkey") % 50).cast("string")).alias("document_id"),
        F.concat(F.lit("doc"), (F.col("p_partkey") % 50).cast("string"), F.lit("_"), (F.col("p_partkey") % 7).cast("string")).alias("segment_id"),
        F.col("p_partkey").alias("ord"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("p_size") > 5, F.col("p_type")).alias("type"),
        F.when(F.col("p_partkey") % 5 != 0, F.concat_ws(" ", "p_brand", "p_type")).otherwise("").alias("description"),
        F.array("p_brand").alias("aliases"),
    )
