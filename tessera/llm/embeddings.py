"""Embedding near-dedup: balanced binary codes by iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, fixed, map_arrow, table, written

COSINE = 0.93
#: The rotation is learned from at most so many vectors, those with the smallest hashed ids; all vectors are coded.
SAMPLE = 20_000
ROUNDS = 50
SEED = 7
#: Candidates may differ in this share of the code's bits; random directions differ in half of them, those of cosine 0.93
#: in 0.12, with a deviation of 0.04.
FAR_SHARE = 0.36
#: Tables of the codes' substrings.
TABLES = 6


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """dim x bits: principal directions turned so that the signs are the nearest balanced codes.

    Fewer dimensions than bits: several differently turned copies side by side.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    _, _, directions = np.linalg.svd(sample.T @ sample)
    out = []
    while sum(x.shape[1] for x in out) < bits:
        k = min(dim, bits - sum(x.shape[1] for x in out))
        base = directions[:k].T
        v = sample @ base
        r = np.linalg.qr(rng.standard_normal((k, k)))[0]
        for _ in range(rounds if len(sample) else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        out.append(base @ r)
    return np.hstack(out)


def substrings(bits: int = 64) -> list[tuple[int, int]]:
    """(first bit, length) of the tables' keys, the same for every input: codes within 2 * TABLES - 1 bits meet in one."""
    at = [round(i * bits / TABLES) for i in range(TABLES + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def valid_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, label, v): v of doubles; only rows with a label and a finite vector without nulls that isn't zero."""
    v = F.expr("transform(embedding, x -> cast(x as double) + 0d)")
    fine = "label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    return df.select("vec_id", "label", v.alias("v")).where(fine)


def link_pairs(points: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, far_share: float | None = FAR_SHARE) -> DataFrame:
    """(a, b) with a < b: pairs of points (id, label, v) of one label and length whose cosine is `cosine` or more.

    Each vector is a 64-bit code and lies in a table for every substring of it. A pair is looked for where a
    substring differs in one bit at most: each point stands in its own cells and, for each of a substring's zero
    bits, in the cell with that bit set. A pair that meets several times is taken at its first table; codes
    that differ in over FAR_SHARE of the bits go no further; the original vectors decide.
    """
    spark = points.sparkSession
    dim = points.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return spark.createDataFrame([], f"a {points.schema['id'].dataType.simpleString()}, b {points.schema['id'].dataType.simpleString()}")
    drawn = points.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"]
    x = np.zeros((len(drawn), dim))
    for i, v in enumerate(drawn):
        x[i, : len(v)] = np.asarray(v) / np.linalg.norm(v)
    rotation = learn_rotation(x, 64)
    keys = substrings()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(2)
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            m = np.zeros((batch.num_rows, dim))
            m[np.arange(dim)[None, :] < lengths[:, None]] = flat
            scale = np.abs(m).max(axis=1, keepdims=True)
            m /= scale
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            code = np.packbits(m @ rotation >= 0, axis=1, bitorder="little").view("<i8")[:, 0]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths.astype(np.int32)), pa.array(code)], names=["id", "label", "dim", "code"])

        return work

    ids, labels = points.schema["id"].dataType.simpleString(), points.schema["label"].dataType.simpleString()
    coded = written(map_arrow(points.select("id", "label", "v"), make, f"id {ids}, label {labels}, dim int, code long"))
    part = [f"(shiftrightunsigned(code, {at}) & {(1 << n) - 1}L)" for at, n in keys]
    own = F.expr("array(" + ", ".join(f"named_struct('t', {t}, 'key', {k})" for t, k in enumerate(part)) + ")")
    near = F.expr("concat(" + ", ".join(f"transform(filter(sequence(0, {n - 1}), i -> ({k} & shiftleft(1L, i)) = 0), i -> named_struct('t', {t}, 'key', {k} | shiftleft(1L, i)))" for t, (k, (_, n)) in enumerate(zip(part, keys, strict=True))) + ")")
    cells = coded.select("*", F.explode(own).alias("c")).select("id", "label", "dim", "code", "c.t", "c.key")
    probes = cells.withColumn("own", F.lit(True)).unionByName(coded.select("*", F.explode(near).alias("c")).select("id", "label", "dim", "code", "c.t", "c.key", F.lit(False).alias("own")))

    def apart(t: int) -> str:
        at, n = keys[t]
        return f"bit_count((shiftrightunsigned(a.code, {at}) ^ shiftrightunsigned(b.code, {at})) & {(1 << n) - 1}L)"

    first = "case a.t " + " ".join(f"when {t} then " + (" and ".join(f"{apart(u)} > 1" for u in range(t)) or "true") for t in range(len(keys))) + " end"
    met = f"a.label = b.label and a.dim = b.dim and a.t = b.t and a.key = b.key and (a.id < b.id or (not b.own and a.id <> b.id)) and bit_count(a.code ^ b.code) <= {64 if far_share is None else int(64 * far_share)} and {first}"
    pairs = cells.alias("a").join(probes.alias("b"), F.expr(met)).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
    v = points.select("id", "v")
    both = pairs.join(v.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(v.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0d, (s, x) -> s + x)"
    return both.where(F.expr(f"{dot.format('va', 'vb')} / (sqrt({dot.format('va', 'va')}) * sqrt({dot.format('vb', 'vb')})) >= {cosine}d")).select("a", "b")


def near_duplicates(df: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Rows of one label with the same vector are one point: they link with each other and share their links, so
    copies aren't expanded. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    with a null label, link with nothing; vectors of different lengths don't link. Rows with a null vec_id link
    with nothing and keep a null component; a repeated vec_id counts once for each row. No rows give none.
    """
    valid = written(valid_vectors(df.where("vec_id is not null")))
    classes = written(valid.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    member = valid.join(classes, ["label", "v"]).select("vec_id", "id").distinct()
    pairs = fixed(link_pairs(classes.select("id", "label", "v"), cosine, sample))
    copies = classes.select("id", "copies")
    both = pairs.union(pairs.select("b", "a"))
    links = both.join(copies.select(F.col("id").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    whole = components(pairs)
    of_class = copies.join(links, F.col("id") == F.col("a"), "left").join(whole, F.col("id") == F.col("node"), "left").select("id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    of_row = member.join(of_class, "id").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    found = df.select("vec_id").join(of_row, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
