"""A property graph at rest: every write of a table is a new parquet version, and a small pointer names the last one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "entities": "id string, name string, type string, description string, domain string, aliases array<string>, created_at string, embedding array<float>",
    "relationships": "id string, source_id string, target_id string, source string, target string, relationship string, description string, type string, created_at string, embedding array<float>",
    "communities": "community_id string, members array<string>, title string, summary string, entity_count int, created_at string",
    "belongs_to": "entity_id string, community_id string",
    "events": "id string, type string, label string, participants array<string>, document_id string, segment_id string, context string, timestamp string",
    "attributes": "document_id string, segment_id string, entity_candidate string, entity_id string, attribute string, value string, unit string, context string, attribute_type string",
    "changes": "run_id string, change_type string, document_id string, segment_id string, source_path string, extractor string, metadata map<string,string>, entities int, relationships int, attributes int, events int, failed boolean",
    "snapshots": "version int, entity_count long, relationship_count long, metadata map<string,string>",
    "vectors": "model string, text_sha256 string, vector array<float>",
}
KEYS = {"entities": ["id"], "relationships": ["source_id", "id", "target_id"], "communities": ["community_id"], "belongs_to": ["entity_id", "community_id"], "events": ["id"], "attributes": ["document_id", "segment_id", "entity_candidate", "attribute", "value"], "changes": ["run_id", "document_id", "segment_id"], "snapshots": ["version"], "vectors": ["model", "text_sha256"]}


@dataclass
class ChangeSet:
    """What a batch of documents says: rows of each table, counted as they came, and who made it."""

    run_id: str
    entities: DataFrame | None = None
    relationships: DataFrame | None = None
    attributes: DataFrame | None = None
    events: DataFrame | None = None
    changes: DataFrame | None = None
    annotation: dict[str, str] = field(default_factory=dict)

    def rows(self, name: str) -> DataFrame | None:
        return getattr(self, name)

    def entity_count(self) -> int:
        return self.entities.count() if self.entities is not None else 0

    def relationship_count(self) -> int:
        return self.relationships.count() if self.relationships is not None else 0


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old ones whose key has none. The new rows must hold each key once."""
    return new.select(*old.columns).unionByName(old.join(new.select(*keys), keys, "left_anti").select(*old.columns))


def keep_first_created(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As `upsert`, but a key that was there keeps its created_at."""
    was = old.select(*keys, F.col("created_at").alias("_was"))
    return upsert(old, new.join(was, keys, "left").withColumn("created_at", F.coalesce("_was", "created_at")).drop("_was"), keys)


def one_a_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, the same on every run: the greatest by its columns, maps as text. Null keys are keys."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    order = F.struct(*[F.to_json(c) if "map<" in rows.schema[c].dataType.simpleString() else F.col(c) for c in rest])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def with_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations both of whose ends are entities."""
    ids = entities.select("id").distinct()
    for end in ("source_id", "target_id"):
        relations = relations.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return relations


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once: what a uniqueness constraint would refuse."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def exported(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, id, payload): nodes and edges with all their properties as JSON."""
    nodes = entities.select(F.lit("node").alias("kind"), "id", F.to_json(F.struct(*entities.columns)).alias("payload"))
    edges = relations.select(F.lit("edge").alias("kind"), F.concat_ws("->", "source_id", "target_id").alias("id"), F.to_json(F.struct(*relations.columns)).alias("payload"))
    return nodes.unionByName(edges)


def elements(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, id, label, type, source_id, target_id, properties) of nodes and edges: what a graph says of itself, properties that aren't null as JSON.

    The label of a node is Entity and its type its own; an edge's type is RELATIONSHIP unless it has one.
    """
    none = F.lit(None).cast("string")
    own = lambda df, *without: F.to_json(F.struct(*[c for c in df.columns if c not in without]))
    nodes = entities.select(F.lit("node").alias("kind"), "id", F.lit("Entity").alias("label"), "type", none.alias("source_id"), none.alias("target_id"), own(entities, "id", "type").alias("properties"))
    kind = F.coalesce(F.col("type") if "type" in relations.columns else none, F.lit("RELATIONSHIP"))
    name = F.col("id") if "id" in relations.columns else F.concat_ws("::", "source_id", "relationship", "target_id")
    edges = relations.select(F.lit("edge").alias("kind"), name.alias("id"), none.alias("label"), kind.alias("type"), "source_id", "target_id", own(relations, "id", "type", "source_id", "target_id").alias("properties"))
    return nodes.unionByName(edges)


class GraphStore:
    """The tables of a graph under one folder, which may be on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def version(self, name: str) -> int:
        """The last whole version, 0 if there is none: those without Spark's _SUCCESS file don't count."""
        folder = self._hadoop(f"{self.path}/{name}")
        if not self._fs.exists(folder):
            return 0
        found = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(x[1:]) for x in found if x[1:].isdigit() and self._fs.exists(self._hadoop(f"{self.path}/{name}/{x}/_SUCCESS"))), default=0)

    def read(self, name: str) -> DataFrame:
        schema = StructType.fromDDL(SCHEMAS[name])
        if not (v := self.version(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/v{v}")

    def write(self, name: str, rows: DataFrame) -> int:
        v = self.version(name) + 1
        rows.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(SCHEMAS[name])]).write.mode("overwrite").parquet(f"{self.path}/{name}/v{v}")
        return v

    def _filled(self, name: str, rows: DataFrame, **defaults: Column) -> DataFrame:
        for f in StructType.fromDDL(SCHEMAS[name]):
            own = F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType)
            rows = rows.withColumn(f.name, F.coalesce(own, defaults[f.name]) if f.name in defaults else own)
        return rows

    def upsert_entities(self, rows: DataFrame) -> int:
        """Whole rows replace those of the same id; embeddings are null again unless given."""
        new = self._filled("entities", rows, id=F.uuid(), type=F.lit("UNKNOWN"), domain=F.lit("unknown"), aliases=F.array().cast("array<string>"), created_at=now())
        return self.write("entities", upsert(self.read("entities"), one_a_key(new, KEYS["entities"]), KEYS["entities"]))

    def upsert_relationships(self, rows: DataFrame) -> int:
        new = self._filled("relationships", with_ends(rows, self.read("entities")), type=F.lit("RELATIONSHIP"), created_at=now())
        return self.write("relationships", upsert(self.read("relationships"), one_a_key(new, KEYS["relationships"]), KEYS["relationships"]))

    def replace_communities(self, profiles: DataFrame) -> int:
        """All communities anew; a known one keeps its created_at; members that are entities belong to it."""
        was = self.read("communities").select("community_id", F.col("created_at").alias("_was"))
        new = self._filled("communities", profiles.join(was, "community_id", "left").withColumn("created_at", F.coalesce("_was", now())).withColumn("entity_count", F.size("members")))
        ids = self.read("entities").select(F.col("id").alias("entity_id"))
        self.write("belongs_to", new.select(F.explode("members").alias("entity_id"), "community_id").join(ids, "entity_id", "left_semi"))
        return self.write("communities", new)

    def store_embeddings(self, vectors: DataFrame, name: str = "entities") -> int:
        """Embeddings (key, vector) of rows that are there; others keep theirs."""
        rows = self.read(name).join(vectors.select(F.col("key").alias("id"), "vector"), "id", "left")
        return self.write(name, rows.withColumn("embedding", F.coalesce("vector", "embedding")).drop("vector"))

    def put(self, name: str, rows: DataFrame) -> int:
        """Rows of a table by its keys: those of a batch that runs again replace themselves."""
        keys = KEYS[name]
        new = one_a_key(self._filled(name, rows).select(*self.read(name).columns).na.fill("", keys), keys)
        return self.write(name, upsert(self.read(name), new, keys))

    def apply(self, change: ChangeSet) -> int:
        """A change set, table by table; applied again it leaves the same rows but for created_at. The last version of the provenance is returned."""
        if change.entities is not None:
            self.upsert_entities(change.entities)
        if change.relationships is not None:
            self.upsert_relationships(change.relationships)
        for name in ("attributes", "events", "changes"):
            if (rows := change.rows(name)) is not None:
                self.put(name, rows)
        return self.version("changes")

    def forget(self, name: str, keyed: DataFrame) -> int:
        """Takes rows away by their keys."""
        keys = KEYS[name]
        return self.write(name, self.read(name).join(keyed.select(*keys), keys, "left_anti"))

    def known_ids(self, names: DataFrame) -> DataFrame:
        """(name, id) of the stored entities among these names."""
        return self.read("entities").select("name", "id").join(names.select("name").distinct(), "name", "left_semi")

    def append(self, name: str, rows: DataFrame) -> int:
        return self.write(name, self.read(name).unionByName(self._filled(name, rows).select(*self.read(name).columns)))

    def snapshot(self, metadata: dict[str, str] | None = None) -> int:
        """A line of the store's history; its version is the last one's and one more."""
        log = self.read("snapshots")
        last = log.agg(F.max("version")).first()[0] or 0
        row = self.spark.createDataFrame([(last + 1, self.read("entities").count(), self.read("relationships").count(), metadata or {})], SCHEMAS["snapshots"])
        self.write("snapshots", log.union(row))
        return last + 1

    def clear(self) -> None:
        for name in SCHEMAS:
            self.write(name, self.spark.createDataFrame([], StructType.fromDDL(SCHEMAS[name])))

    def query(self, sql: str, **args) -> DataFrame:
        """Parameterised SQL over the tables as views; writing statements are refused."""
        if not sql.lstrip().lower().startswith(("select", "with", "values")):
            raise ValueError("only queries that read")
        for name in SCHEMAS:
            self.read(name).createOrReplaceTempView(name)
        return self.spark.sql(sql, args=args)

    def export(self, path: str) -> None:
        exported(self.read("entities"), self.read("relationships")).write.mode("overwrite").json(path)


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
