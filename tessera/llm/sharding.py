"""Sharding: a uniform shuffle into shards of exact sizes by hypergeometric communication counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import table, written

SHARDS = 8
SEED = 20_260_101
#: Rows that one task permutes in the second round; a shard is cut into blocks of about so many.
BLOCK_ROWS = 10_000


#: Of monotonically_increasing_id the bits that hold a row's place in its partition.
PLACE_BITS = 33
#: numpy draws from fewer balls of a colour than this.
MOST_BALLS = 1_000_000_000


def hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator, most: int = MOST_BALLS) -> int:
    """How many of n balls drawn from good + bad ones are good, for any number of balls.

    Below numpy's bound by numpy. Above, the balls get random places between 0 and 1, and the n first ones are drawn: the place of the middle
    one of the more frequent colour has a beta distribution, and how many of the others lie before it a binomial one; what is
    left is a draw from one side of it. So each step halves the larger number.
    """
    if max(good, bad) < most:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    if good < bad:
        return n - hypergeometric(bad, good, n, rng, most)
    middle = good // 2 + 1
    before = int(rng.binomial(bad, rng.beta(middle, good - middle + 1)))
    if middle + before > n:
        return hypergeometric(middle - 1, before, n, rng, most)
    return middle + hypergeometric(good - middle, bad - before, n - middle - before, rng, most)


def draw(sizes: np.ndarray, rows: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `rows` drawn without replacement fall on each destination of these sizes."""
    out, left = np.zeros(len(sizes), np.int64), int(sizes.sum())
    for i, size in enumerate(sizes.tolist()):
        if not rows:
            break
        left -= size
        out[i] = hypergeometric(size, left, rows, rng) if left else rows
        rows -= int(out[i])
    return out


def communication(partition_rows: list[int], sizes: np.ndarray, partition: int, seed: int) -> np.ndarray:
    """The partition's row of the communication matrix.

    The partitions are halved again and again; at each halving a hypergeometric draw, seeded by the halving's
    place, deals what is left of each destination to the two sides. Any task can so draw its own row, in
    log2(partitions) draws, and all rows together have the exact joint distribution.
    """
    sums = np.concatenate([[0], np.cumsum(partition_rows)])
    low, high = 0, len(partition_rows)
    while high - low > 1:
        mid = (low + high) // 2
        left = draw(sizes, int(sums[mid] - sums[low]), np.random.default_rng([seed, 1, low, high]))
        low, high, sizes = (low, mid, left) if partition < mid else (mid, high, sizes - left)
    return sizes


def shard(df: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows of df and their shard, 0 to shards - 1, and slot in it, gapless from 0.

    Counts differ by one at most; every assignment of rows to places is equally likely. Whole rows move. (1) They are
    written once, each with the partition that wrote it and its place there; the partitions' counts go to the driver. (2) For
    each partition it is drawn how many of its rows go to each block of each shard, and which: by the written numbers, so that it
    doesn't matter how the files are cut when they are read. (3) Rows are exchanged by block and ordered in it by a random
    number drawn with them, the second permutation. Values are never looked at: nulls, ties, copies and hot values change
    nothing. No rows give none. Columns of df named shard, slot or beginning with `_sh_` are refused.
    """
    if clash := [c for c in df.columns if c in ("shard", "slot") or c.startswith("_sh_")]:
        raise ValueError(f"columns {clash} are in the way")
    held = written(df.select(F.monotonically_increasing_id().alias("_sh_id"), "*"))
    counts = {r["p"]: r["n"] for r in held.groupBy(F.shiftright("_sh_id", PLACE_BITS).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [counts.get(p, 0) for p in range(max(counts, default=-1) + 1)]
    total = sum(rows)
    whole = [total // shards + (s < total % shards) for s in range(shards)]
    blocks = max(1, -(-max(whole) // block_rows))
    sizes = np.asarray([n // blocks + (b < n % blocks) for n in whole for b in range(blocks)], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, to, keys = -1, np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            parts, places = ids >> PLACE_BITS, ids & ((1 << PLACE_BITS) - 1)
            block, key = np.empty(len(ids), np.int32), np.empty(len(ids), np.int64)
            for own in np.unique(parts).tolist():
                if own != now:  # drawn anew from its seed wherever rows of the partition are read
                    rng = np.random.default_rng([seed, 2, own])
                    to = rng.permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), communication(rows, sizes, own, seed)))
                    now, keys = own, rng.integers(-(1 << 63), 1 << 63, rows[own])
                mine = parts == own
                block[mine], key[mine] = to[places[mine]], keys[places[mine]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block), pa.array(key)], names=[*batch.schema.names, "_sh_block", "_sh_key"])

    kind = StructType([*held.schema.fields]).add("_sh_block", IntegerType()).add("_sh_key", LongType())
    dealt = held.mapInArrow(deal, kind)
    within = Window.partitionBy("_sh_block").orderBy("_sh_key", "_sh_id")
    # the blocks of shard s: the first `whole[s] % blocks` hold one row more than the others
    s_, b_ = F.expr(f"_sh_block div {blocks}"), F.expr(f"_sh_block % {blocks}")
    size, more = F.when(s_ < total % shards, whole[0]).otherwise(whole[-1]), F.lit(blocks)
    begin = b_ * F.floor(size / more) + F.least(b_, size % more)
    return dealt.withColumn("_sh_rank", F.row_number().over(within)).select(*df.columns, s_.cast("int").alias("shard"), (begin + F.col("_sh_rank") - 1).cast("long").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, texts and all, in 8 shards by the law `rows`; odd rows as in `shard`. The digests are of the moved texts."""
    found = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    size, crc = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return found.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
