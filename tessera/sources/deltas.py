"""A graph store that takes change sets as deltas: a batch writes its own rows only, readers put them over the base by key.

Layout under the store's folder, all of it plain parquet and small JSON files:

    <table>/commit=<id>/bucket=<n>/*.parquet   rows of one commit, in the buckets that their keys hash to
    _commits/<version>.json                    which commits make up a version, created only if it isn't there

A commit names its rows in every table at once, so readers see a change set whole or not at all. Compaction rewrites the
buckets that have deltas and no others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.graph import checkpointed as fixed
from . import store
from .store import ChangeSet, GraphStore, now, one_a_key, repeated_keys, with_ends

SCHEMAS = store.SCHEMAS | {"names": "name string, entity_id string"}
KEYS = store.KEYS | {"names": ["name"]}
BUCKETS = 64


class RepeatedKeys(ValueError):
    """A change set holds a key more than once."""


class WriteConflict(RuntimeError):
    """Another writer took the version."""


@dataclass
class State:
    """The files of a version: of each table the base's commit by bucket, and the later deltas (version, commit, buckets), oldest first."""

    version: int
    base: dict[str, dict[int, str]]
    deltas: dict[str, list[tuple[int, str, list[int]]]]
    totals: dict[str, int]
    runs: set[str]


class DeltaStore(GraphStore):
    """As GraphStore, but every write is a delta. Rows are read back the same after any replay: the last commit of a key wins."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        super().__init__(spark, path)
        self.buckets = buckets

    # Commits.
    def _text(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _manifests(self) -> list[dict]:
        """All whole manifests, oldest first. One that its writer left empty took a version and says nothing."""
        folder = self._hadoop(f"{self.path}/_commits")
        if not self._fs.exists(folder):
            return []
        found = sorted((s.getPath().getName(), s.getPath()) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        return [json.loads(text) for _, path in found if (text := self._text(path).strip())]

    def state(self, version: int | None = None) -> State:
        out = State(0, {}, {}, {}, set())
        for m in self._manifests():
            if version is not None and m["version"] > version:
                break
            out.version = m["version"]
            out.totals = {n: v for n, v in (out.totals | m.get("totals", {})).items() if v is not None}
            if m["kind"] == "base":
                for name, commits in m["tables"].items():
                    out.base[name] = {int(b): c for b, c in commits.items()}
                    out.deltas[name] = [d for d in out.deltas.get(name, []) if d[0] > m["upto"]]
                continue
            out.runs.add(m["run_id"])
            for name, own in m["tables"].items():
                out.deltas.setdefault(name, []).append((m["version"], m["commit"], own))
        return out

    def version(self, name: str = "") -> int:
        """The last version of the whole store: all tables share it."""
        return self.state().version

    def _publish(self, manifest: dict) -> int:
        text = bytearray(json.dumps(manifest).encode())
        try:
            out = self._fs.create(self._hadoop(f"{self.path}/_commits/{manifest['version']:010d}.json"), False)
        except Exception as e:
            raise WriteConflict(f"version {manifest['version']} is there already") from e
        out.write(text, 0, len(text))
        out.close()
        return manifest["version"]

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*KEYS[name]), F.lit(self.buckets)).cast("int")

    def _put_files(self, name: str, commit: str, rows: DataFrame) -> list[int]:
        """Rows in files by bucket, sorted by key and with a Bloom filter of its first column; the buckets that got some."""
        keys, root = KEYS[name], f"{self.path}/{name}/commit={commit}"
        dealt = rows.withColumn("bucket", self._bucket(name)).repartition("bucket").sortWithinPartitions("bucket", *keys)
        writer = dealt.write.partitionBy("bucket").option(f"parquet.bloom.filter.enabled#{keys[0]}", "true")
        writer.parquet(root)
        return sorted(int(s.getPath().getName()[7:]) for s in self._fs.listStatus(self._hadoop(root)) if s.getPath().getName().startswith("bucket="))

    def commit(self, tables: dict[str, DataFrame], run_id: str = "", gone: dict[str, DataFrame] | None = None, refuse: bool = False, totals: dict[str, int] | None = None) -> int:
        """One version of rows put and of keys taken away. refuse: a key that stands twice is an error, else one of its rows is kept."""
        last, commit, written = self.state().version, uuid.uuid4().hex, {}
        for name in sorted({*tables, *(gone or {})}):
            keys, schema = KEYS[name], StructType.fromDDL(SCHEMAS[name])
            parts = []
            if name in tables:
                rows = tables[name].select(*[F.col(f.name).cast(f.dataType) for f in schema]).na.fill("", keys)
                if refuse and (twice := repeated_keys(rows, keys).limit(5).collect()):
                    raise RepeatedKeys(f"{name}: {[r.asDict() for r in twice]}")
                parts.append((rows if refuse else one_a_key(rows, keys)).withColumn("_gone", F.lit(False)))
            if gone and name in gone:
                parts.append(gone[name].select(*[(F.col(f.name) if f.name in keys else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema], F.lit(True).alias("_gone")))
            written[name] = self._put_files(name, commit, parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
        # a total that isn't given isn't known any more
        known = dict.fromkeys(written) | (totals or {})
        return self._publish({"version": last + 1, "kind": "delta", "run_id": run_id, "commit": commit, "tables": {n: b for n, b in written.items() if b}, "totals": known})

    # Reading.
    def _scan(self, name: str, commits: Iterable[tuple[str, Iterable[int] | None]]) -> DataFrame | None:
        """Rows of the commits' buckets (None: all of them) in one scan, with `commit` and `bucket`."""
        root = f"{self.path}/{name}"
        paths = [p for c, own in commits for p in ([f"{root}/commit={c}"] if own is None else [f"{root}/commit={c}/bucket={b}" for b in own])]
        schema = StructType.fromDDL(f"{SCHEMAS[name]}, _gone boolean, commit string, bucket int")
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths) if paths else None

    def read(self, name: str, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a table as of a version: of each key those of the last commit that holds it.

        The base isn't shuffled where the deltas' keys are few enough to be broadcast, which Spark sees by itself.
        buckets: only rows of these; no others are listed or read.
        """
        state, keys, schema = self.state(version), KEYS[name], StructType.fromDDL(SCHEMAS[name])
        some = None if buckets is None else set(buckets)
        base = self._scan(name, [(c, [b]) for b, c in sorted(state.base.get(name, {}).items()) if some is None or b in some])
        deltas = state.deltas.get(name, [])
        later = self._scan(name, [(c, None if some is None else [b for b in own if b in some]) for _, c, own in deltas])
        columns = [f.name for f in schema]
        if later is None:
            return self.spark.createDataFrame([], schema) if base is None else base.select(*columns)
        number = F.create_map(*[F.lit(x) for v, c, _ in deltas for x in (c, v)])
        rest = [*[c for c in columns if c not in keys], "_gone"]
        last = later.withColumn("_v", number[F.col("commit")]) if len(deltas) > 1 else later
        if len(deltas) > 1:
            last = last.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_v").alias("_r")).select(*keys, "_r.*")
        rows = last.where("not _gone").select(*columns)
        return rows if base is None else base.join(last.select(*keys), keys, "left_anti").select(*columns).unionByName(rows)

    def near(self, name: str, keyed: DataFrame) -> DataFrame:
        """The rows of a table in the buckets of these keys; the buckets' numbers, of which there are self.buckets, go to the driver."""
        found = keyed.select(*KEYS[name]).select(self._bucket(name).alias("b")).distinct().collect()
        return self.read(name, buckets=[r["b"] for r in found])

    def lookup(self, name: str, keys: list) -> DataFrame:
        """Rows by their whole key (a value, or a tuple of them): reads the keys' buckets, in these the files and row groups that may hold them."""
        fields = [f for f in StructType.fromDDL(SCHEMAS[name]) if f.name in KEYS[name]]
        asked = self.spark.createDataFrame([k if isinstance(k, tuple) else (k,) for k in keys], StructType(sorted(fields, key=lambda f: KEYS[name].index(f.name))))
        rows = self.near(name, asked)
        if len(fields) == 1:
            return rows.where(F.col(KEYS[name][0]).isin(keys))
        return rows.join(asked, KEYS[name], "left_semi")

    # Writing, as GraphStore does.
    def _own(self, name: str, rows: DataFrame, **defaults: Column) -> DataFrame:
        for f in StructType.fromDDL(SCHEMAS[name]):
            given = F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType)
            rows = rows.withColumn(f.name, F.coalesce(given, defaults[f.name]) if f.name in defaults else given)
        return rows.select(*[f.name for f in StructType.fromDDL(SCHEMAS[name])])

    def _entities(self, rows: DataFrame) -> DataFrame:
        return self._own("entities", rows, id=F.uuid(), type=F.lit("UNKNOWN"), domain=F.lit("unknown"), aliases=F.array().cast("array<string>"), created_at=now())

    def _relationships(self, rows: DataFrame, new: DataFrame | None) -> DataFrame:
        """Those both of whose ends are stored, or come in the same change set; only the ends' buckets are read."""
        ends = rows.select(F.explode(F.array("source_id", "target_id")).alias("id")).where("id is not null").distinct()
        known = self.near("entities", ends).select("id")
        return self._own("relationships", with_ends(rows, known if new is None else known.union(new.select("id"))), type=F.lit("RELATIONSHIP"), created_at=now())

    def _grown(self, name: str, rows: DataFrame) -> int:
        """The table's rows after these: the last total, and the keys that aren't there yet, looked for in their buckets."""
        keys, state = KEYS[name], self.state()
        was = state.totals[name] if name in state.totals else self.read(name).count()
        return was + rows.select(*keys).distinct().join(self.near(name, rows).select(*keys), keys, "left_anti").count()

    def apply(self, change: ChangeSet, refuse: bool = False) -> int:
        """A change set as one version. Applied again it leaves every table's rows as they are, but for created_at.

        Entities replace those of their id whole; relationships without both ends go; attributes, events and provenance
        are put by their keys. Entity and relationship totals are kept with the version, so that no count reads the store.
        """
        tables, totals = {}, {}
        if change.entities is not None:
            tables["entities"] = fixed(self._entities(change.entities))  # ids made here must be the same in all tables
            tables["names"] = tables["entities"].where("name is not null").groupBy("name").agg(F.min("id").alias("entity_id"))
            totals["entities"] = self._grown("entities", tables["entities"])
        if change.relationships is not None:
            tables["relationships"] = fixed(self._relationships(change.relationships, tables.get("entities")))
            totals["relationships"] = self._grown("relationships", tables["relationships"].na.fill("", KEYS["relationships"]))
        for name in ("attributes", "events", "changes"):
            if (rows := change.rows(name)) is not None:
                tables[name] = self._own(name, rows)
        return self.commit(tables, change.run_id, refuse=refuse, totals=totals)

    def upsert_entities(self, rows: DataFrame) -> int:
        return self.apply(ChangeSet("", entities=rows))

    def upsert_relationships(self, rows: DataFrame) -> int:
        return self.apply(ChangeSet("", relationships=rows))

    def put(self, name: str, rows: DataFrame) -> int:
        return self.commit({name: self._own(name, rows)})

    append = put

    def forget(self, name: str, keyed: DataFrame) -> int:
        return self.commit({}, gone={name: keyed})

    def write(self, name: str, rows: DataFrame) -> int:
        """The table is these rows from now on; those that are there and the same aren't written again."""
        keys = KEYS[name]
        new = fixed(one_a_key(self._own(name, rows).na.fill("", keys), keys))
        old = self.read(name)
        rest = [c for c in new.columns if c not in keys]
        same = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0).cast("long")
        both = new.withColumn("_h", same).join(old.select(*keys, same.alias("_o")), keys, "left")
        gone = old.select(*keys).join(new.select(*keys), keys, "left_anti")
        return self.commit({name: both.where("_o is null or _h <> _o").select(*new.columns)}, gone={name: gone}, totals={name: new.count()})

    def store_embeddings(self, vectors: DataFrame, name: str = "entities") -> int:
        """Embeddings (key, vector) of rows that are there: these rows anew, no others."""
        given = fixed(vectors.select(F.col("key").alias("id"), "vector"))
        rows = (self.near(name, given) if KEYS[name] == ["id"] else self.read(name)).join(given, "id").withColumn("embedding", F.col("vector")).drop("vector")
        total = self.state().totals.get(name)
        return self.commit({name: rows}, totals={name: total} if total is not None else None)

    def known_ids(self, names: DataFrame) -> DataFrame:
        """(name, id) of the stored entities among these names; only the names' buckets are read."""
        return self.near("names", names).join(names.select("name").distinct(), "name", "left_semi").select("name", F.col("entity_id").alias("id"))

    def snapshot(self, metadata: dict[str, str] | None = None) -> int:
        totals = self.state().totals
        last = self.read("snapshots").agg(F.max("version")).first()[0] or 0
        counts = [totals[n] if n in totals else self.read(n).count() for n in ("entities", "relationships")]
        self.put("snapshots", self.spark.createDataFrame([(last + 1, *counts, metadata or {})], SCHEMAS["snapshots"]))
        return last + 1

    def clear(self) -> None:
        self.commit({}, gone={name: self.read(name).select(*KEYS[name]) for name in SCHEMAS}, totals=dict.fromkeys(SCHEMAS, 0))

    # Upkeep.
    def compact(self, names: Iterable[str] = tuple(SCHEMAS)) -> int:
        """Deltas into the base: each bucket that has some is read, merged and written once, the others stay as they are.

        A writer that is faster makes this fail, and nothing has changed then.
        """
        state, commit, tables = self.state(), uuid.uuid4().hex, {}
        for name in names:
            if not (deltas := state.deltas.get(name)):
                continue
            touched = sorted({b for _, _, own in deltas for b in own})
            rows = self.read(name, state.version, touched).withColumn("_gone", F.lit(False))
            full = self._put_files(name, commit, rows)
            kept = {b: c for b, c in state.base.get(name, {}).items() if b not in touched}
            tables[name] = kept | dict.fromkeys(full, commit)
        return self._publish({"version": state.version + 1, "kind": "base", "upto": state.version, "tables": tables}) if tables else state.version

    def vacuum(self) -> list[str]:
        """Deletes the commits' folders that the last version doesn't need, those of writes that failed too; not for use while others read or write."""
        state, gone = self.state(), []
        for name in SCHEMAS:
            used = {*state.base.get(name, {}).values(), *(c for _, c, _ in state.deltas.get(name, []))}
            folder = self._hadoop(f"{self.path}/{name}")
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if (own := s.getPath().getName()).startswith("commit=") and own[7:] not in used:
                    self._fs.delete(s.getPath(), True)
                    gone.append(f"{name}/{own}")
        return gone

    def export(self, path: str) -> None:
        store.exported(self.read("entities"), self.read("relationships")).write.mode("overwrite").json(path)
