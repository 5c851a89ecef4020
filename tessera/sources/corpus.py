"""Text files, lookup files and embedding files."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, path, text) of all .md and .txt files at any depth, suffixes in any case; id is the name without suffix."""
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"))
    found = files.where(F.lower("file").rlike("\\.(md|txt)$"))
    text = F.regexp_replace("value", "\\r\\n?", "\n")
    return found.select(F.regexp_extract(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "(.+)\\.[^.]+$", 1).alias("id"), "path", text.alias("text"))


def documents_or_scan(spark: SparkSession, corpus: DataFrame | None, folder: str) -> DataFrame:
    """The given documents, with made-up ids where they have none; the folder's where there are none."""
    if corpus is None or corpus.isEmpty():
        return read_documents(spark, folder)
    return corpus.withColumn("id", F.coalesce(F.col("id").cast("string"), F.uuid()))


def read_yaml(spark: SparkSession, path: str):
    """What a YAML file on any file system that Spark reads holds; None, and a warning, if it is absent."""
    import yaml

    try:
        text = spark.read.text(path, wholetext=True).first()
    except AnalysisException:
        warnings.warn(f"no file {path}", stacklevel=2)
        return None
    return yaml.safe_load(text["value"]) if text else None


def read_settings(spark: SparkSession, path: str, defaults: dict | None = None) -> dict:
    """Settings of a YAML file over the defaults, section by section."""
    found = read_yaml(spark, path) or {}
    out = {**(defaults or {}), **found}
    for name, section in (defaults or {}).items():
        if isinstance(section, dict) and isinstance(found.get(name), dict):
            out[name] = {**section, **found[name]}
    return out


def read_alias_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(canonical, variants) of a YAML lookup file; none if it is absent."""
    rows = read_yaml(spark, path)
    return spark.createDataFrame([(k, list(v or [])) for k, v in (rows or {}).items()], "canonical string, variants array<string>")


def merge_alias_dictionary(known: DataFrame, entities: DataFrame) -> DataFrame:
    """The dictionary with the aliases of (name, aliases) added, sorted; unchanged rows stay equal."""
    fresh = entities.select(F.col("name").alias("canonical"), F.filter("aliases", lambda a: a != F.col("name")).alias("variants")).where(F.size("variants") > 0)
    both = known.unionByName(fresh)
    return both.groupBy("canonical").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("variants")))).alias("variants"))


def write_alias_dictionary(dictionary: DataFrame, path: str, known: DataFrame | None = None) -> bool:
    """Writes (canonical, variants) as JSON lines, which are YAML too, one name a line; False, and nothing written, if it is as `known`."""
    if known is not None and dictionary.exceptAll(known).isEmpty() and known.exceptAll(dictionary).isEmpty():
        return False
    dictionary.select(F.to_json(F.create_map("canonical", "variants"))).write.mode("overwrite").text(path)
    return True


def alias_rows(dictionary: DataFrame) -> DataFrame:
    """(variant, canonical), one row for a variant: the least canonical name wins."""
    return dictionary.select(F.explode("variants").alias("variant"), "canonical").groupBy("variant").agg(F.min("canonical").alias("canonical"))


def write_embeddings(vectors: DataFrame, path: str, model: str = "hashed-words") -> None:
    vectors.withColumn("model_name", F.lit(model)).withColumn("dim", F.size("vector")).write.mode("overwrite").json(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, vector array<float>, model_name string, dim int").json(path).select("key", "vector")


def read_map_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(key, vector) of a JSON file with one object of embeddings by key."""
    whole = spark.read.schema("embeddings map<string,array<float>>").json(path, multiLine=True)
    return whole.select(F.explode("embeddings").alias("key", "vector"))


def write_knowledge_graph(entities: DataFrame, relationships: DataFrame, path: str) -> None:
    """A folder of JSON lines, each one object with a list of entities or of relationships, as `read_knowledge_graph` reads."""
    rows = entities.select(F.to_json(F.struct(F.array(F.struct(*entities.columns)).alias("entities"))).alias("value"))
    rows.union(relationships.select(F.to_json(F.struct(F.array(F.struct(*relationships.columns)).alias("relationships"))).alias("value"))).write.mode("overwrite").text(path)


def read_knowledge_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of a JSON file with a list of each, or of a folder of JSON lines with some of them."""
    entity = "struct<id:string,name:string,type:string,description:string,aliases:array<string>>"
    relation = "struct<id:string,source_id:string,target_id:string,source:string,target:string,relationship:string,description:string>"
    lines = spark.read.text(path, wholetext=False).limit(1).where("value like '{%}'").count() == 1
    whole = spark.read.schema(f"entities array<{entity}>, relationships array<{relation}>").json(path, multiLine=not lines)
    return tuple(whole.select(F.explode(c).alias("x")).select("x.*") for c in ("entities", "relationships"))
