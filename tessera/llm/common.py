"""Shared helpers: reading tables, cutting lineage, dealing rows out in order, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges of a partition of `components`, about.
EDGES = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one of our own if there is one machine only, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.own.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.own.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows written once to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fixed(df: DataFrame) -> DataFrame:
    """checkpoint(): lineage is cut, and the rows keep their partition and their place in it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], every: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back to the system after each batch (of small ones after `every` so many, and at the end): Arrow's pool and the C library keep what is freed, in every idle worker too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        n = 0
        for out in work(batches):
            yield out
            del out
            n += 1
            if n % every == 0:
                pa.default_memory_pool().release_unused()
                if trim:
                    trim(0)
        if n % every:
            pa.default_memory_pool().release_unused()
            if trim:
                trim(0)

    return run


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with a function made once a task; batches are bounded by Spark's Arrow settings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(tidied(run), schema)


def splits(df: DataFrame, column: str, n: int) -> list[float]:
    """At most n - 1 ascending bounds that cut the column into ranges of about the same number of rows.

    Only this column is read. The bounds go to the driver; their number is the number of partitions.
    """
    if n <= 1:
        return []
    found = df.select(F.col(column).cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], min(0.01, 0.2 / n))
    return sorted(set(found))


def bucket(column: str, bounds: list[float]) -> Column:
    """The range of `splits` that holds a value, the number of bounds below it: 0 for nulls. A binary search of comparisons."""
    x = F.col(column).cast("double")

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x > F.lit(float(bounds[mid])), search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(bounds)).cast("int")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Connected components of edges (a, b), as (node, component), component the smallest node of each.

    Large star and small star in turn, until the edges stay as they are; every minimum is partially
    aggregated before its shuffle, so a hub's links aren't gathered in one task. A round's edges are kept in
    partitions of about EDGES, so few edges don't make many tasks. Nulls are ignored; no edges give no rows.
    """
    now = fixed(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()

    seen = mark(now)
    for _ in range(limit):
        if not seen[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = fixed(small.coalesce(8 + seen[0] // EDGES))
        last, seen = seen, mark(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
