"""Embeddings of texts, exact top-k search and similarity statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, doubles, dot, norm, similarity
from .graph import checkpointed

DIM = 64
#: Rows of a block of vectors.
BLOCK = 2048


def hashed_words(texts: pd.Series, dim: int = DIM) -> list[np.ndarray]:
    """The default, offline embedding: words hashed to signed places, with unit length."""
    import xxhash

    out = []
    for t in texts:
        v = np.zeros(dim, np.float32)
        for w in (t or "").lower().split():
            h = xxhash.xxh64_intdigest(w.encode())
            v[h % dim] += 1 - 2 * (h >> 63)
        n = float(np.linalg.norm(v))
        out.append(v / n if n else v)
    return out


def embed(rows: DataFrame, key: str, text: Column, model=hashed_words, cached: DataFrame | None = None) -> DataFrame:
    """(key, vector) of each row by a model of (Series of texts) -> vectors; keys in `cached` keep theirs and aren't embedded again."""
    todo = rows.select(F.col(key).alias("key"), text.alias("text"))
    if cached is not None:
        todo = todo.join(cached.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "vector": model(b["text"])})

    fresh = todo.mapInPandas(run, "key string, vector array<float>")
    return fresh if cached is None else fresh.unionByName(cached.select("key", "vector"))


def embed_changed(rows: DataFrame, key: str, text: Column, cache: DataFrame, model=hashed_words, name: str = "default") -> tuple[DataFrame, DataFrame]:
    """((key, text_sha256, vector) of each row, (model, text_sha256, vector) of the texts that the cache doesn't have yet).

    cache: (model, text_sha256, vector). A text is embedded once for a model, however many rows have it and whatever their keys, and not
    at all if its digest is there; the model sees distinct new texts only. Null texts are empty ones.
    """
    given = rows.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    known = cache.where(F.col("model") == name).select("text_sha256", "vector")
    todo = given.select("text_sha256", "text").dropDuplicates(["text_sha256"]).join(known, "text_sha256", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"text_sha256": b["text_sha256"], "vector": model(b["text"])})

    fresh = checkpointed(todo.mapInPandas(run, "text_sha256 string, vector array<float>"))  # the model is asked once
    every = given.select("key", "text_sha256").join(known.unionByName(fresh), "text_sha256").select("key", "text_sha256", "vector")
    return every, fresh.select(F.lit(name).alias("model"), "text_sha256", "vector")


def unused(cache: DataFrame, texts: DataFrame, name: str = "default") -> DataFrame:
    """(model, text_sha256) of the model's cached vectors whose text is none of the texts (text) any more."""
    used = texts.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")).distinct()
    return cache.where(F.col("model") == name).select("model", "text_sha256").join(used, "text_sha256", "left_anti").select("model", "text_sha256")


def top_k(vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """(key, score): the k vectors of the highest cosine; those of zero norm are passed over; ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("key", cosine(F.col("vector"), q).alias("score")).where("score is not null")
    return scored.orderBy(F.desc("score"), "key").limit(k)


def most_similar(vectors: DataFrame, query: list[float], k: int = 5, threshold: float = 0.0, metric: str = "cosine") -> DataFrame:
    """(key, score): at or above the threshold first, then the k best."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("key", similarity(F.col("vector"), q, metric).alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), "key").limit(k)


def top_then_threshold(vectors: DataFrame, query: list[float], k: int = 3, above: float = 0.3) -> DataFrame:
    """(key, score): the k best first, then those over the threshold."""
    return top_k(vectors, query, k).where(F.col("score") > above)


def packed(rows: DataFrame, key: str, most: int, out: str) -> DataFrame:
    """One row for about `most` rows of (key, vector), by a hash of the key: their keys and vectors in the column `out`."""
    n = max(1, -(-rows.count() // most))
    one = F.struct(F.col(key).alias("key"), doubles("vector").alias("vector"))
    return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias(f"{out}_n")).agg(F.collect_list(one).alias(out)).select(out)


def batch_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query, key, score, place): the k best of all vectors for each query.

    Queries and vectors are put into blocks of about `block` rows; each block of queries meets each block of vectors as one
    product of matrices, of which k a query go on. Nothing is collected; no task holds more than two blocks.
    Vectors of zero norm are passed over, queries of zero norm score 0; ties by key.
    """

    def unit(lists: pa.ListScalar) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        keys, rows = lists.values.field("key"), lists.values.field("vector")
        m = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return keys, np.divide(m, size, out=np.zeros_like(m), where=size > 0), size[:, 0] > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                names, m, _ = unit(b.column(0)[i])
                keys, v, some = unit(b.column(1)[i])
                keys, v = keys.filter(pa.array(some)), v[some]
                if not len(v):
                    continue
                s = m @ v.T
                best = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                # ties at the k-th score must all stay: the window below decides by key
                floor = np.take_along_axis(s, best, 1).min(axis=1)
                q, at = np.nonzero(s >= floor[:, None])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), keys.take(pa.array(at)), pa.array(s[q, at])], names=["query", "key", "score"])

    kinds = queries.schema["query"].dataType.simpleString(), vectors.schema["key"].dataType.simpleString()
    pairs = packed(vectors.select("key", "vector"), "key", block, "v").crossJoin(packed(queries.select("query", "vector"), "query", block, "q"))
    found = pairs.select("q", "v").mapInArrow(run, f"query {kinds[0]}, key {kinds[1]}, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def pairwise_mean(vectors: DataFrame) -> DataFrame:
    """(pairs, mean_similarity) over all pairs of unit vectors: from their sum, since |sum|^2 holds every pair's dot product twice."""
    unit = vectors.select(doubles("vector").alias("v")).withColumn("n", norm(F.col("v"))).where("n > 0")
    rows = unit.select(F.posexplode(F.transform("v", lambda x: x / F.col("n"))).alias("i", "x"))
    sums = rows.groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("own"), F.count(F.lit(1)).alias("n"))
    whole = sums.agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("own").alias("own"), F.max("n").alias("n"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return whole.select(pairs.cast("long").alias("pairs"), ((F.col("all") - F.col("own")) / 2 / pairs).alias("mean_similarity"))


__all__ = ["DIM", "batch_top_k", "dot", "embed", "embed_changed", "hashed_words", "most_similar", "pairwise_mean", "top_k", "top_then_threshold", "unused"]
