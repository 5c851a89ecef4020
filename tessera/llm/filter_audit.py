"""Filter interaction audit: what each filter removes, alone and after others, for every order of the filters."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_parts, table, written

FILTERS = "ABCDE"
#: The bit of each filter in a failure mask. E, copies, is found by sorting; the others look at one text.
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
COPY = BIT["E"]

UPPER = bytes(range(0x41, 0x5B))
#: Bytes that continue a UTF-8 character.
CONTINUE = bytes(range(0x80, 0xC0))
ODD_CHARACTERS = re.compile(rb"[#$%&*|]")

FOUND = "doc_id long, part string, mask int, run long, p int, fp long, head binary, least long"
KIND = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("run", pa.int64()), ("p", pa.int32()), ("fp", pa.int64()), ("head", pa.binary()), ("least", pa.int64())])


def failures(text: bytes) -> int:
    """The mask of the filters A to D that a whole text fails. Words are cut at ASCII white space, as bytes.split() does."""
    words = text.split()
    upper = len(text) - len(text.translate(None, UPPER))
    points = len(text.translate(None, CONTINUE))
    failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * upper > 2 * points, "D": ODD_CHARACTERS.search(text) is not None}
    return sum(BIT[f] for f, yes in failed.items() if yes)


def sorted_partition(batches: Iterator[pa.RecordBatch], failed: Callable[[bytes], int] = failures) -> Iterator[pa.RecordBatch]:
    """Masks of a partition's rows (doc_id, part, text, fp, p), which come sorted by fp, text and doc_id.

    A run is the rows of one text. Its rows over its smallest doc_id fail E. The partition's first fingerprint may have
    begun in an earlier partition: rows there that don't fail name their run, to be looked at again. The runs of the first
    and of the last fingerprint are given besides, as rows without a mask: head is the run's text, least its smallest doc_id.
    """
    first = now = text = least = None
    run, mask, p, runs = -1, 0, 0, {}

    def edges() -> pa.RecordBatch:
        rows = [{"run": r, "p": p, "fp": now, "head": head, "least": low} for r, (head, low) in runs.items() if low is not None]
        return pa.RecordBatch.from_pylist(rows, schema=KIND)

    for batch in batches:
        ids, parts, texts, fps, ps = (c.to_pylist() for c in batch.columns)
        masks, again, p = [], [], ps[0] if ps else p
        for i, t, fp in zip(ids, texts, fps, strict=True):
            if fp != now:
                if runs and now == first:
                    yield edges()
                first, now, text, runs = fp if now is None else first, fp, None, {}
            if t != text:
                text, mask, least, run = t, failed(t), None, run + 1
                runs[run] = (t, None)
            if least is None and i is not None:
                least = i
                runs[run] = (t, i)
            copy = i is not None and i > least
            masks.append(mask | COPY if copy else mask)
            again.append(run if fp == first and i is not None and not copy else None)
        n = len(ids)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(again, pa.int64()), pa.array(ps, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], schema=KIND)
    if runs:
        yield edges()


def masks(docs: DataFrame, part: str = "source", text: str = "text", failed: Callable[[bytes], int] = failures) -> DataFrame:
    """(doc_id, part, mask) of every row of docs: bit i of mask is 1 if the row fails the i-th filter.

    Rows are range-sorted by fingerprint, full text and doc_id; the ranges are cut by fingerprint and doc_id, so that a
    large group of copies is dealt over many. Each row is compared with the one before it; what goes on over a boundary
    is put right from the runs at the boundaries, of which there are a few for each partition. Null texts are
    empty texts, null parts the part ''. Only a smaller doc_id makes a copy: rows that share doc_id and text don't fail for
    each other, a null doc_id is neither smaller nor larger than any. Other columns are ignored; no rows give none.
    """
    n = max(1, n_parts(docs.sparkSession))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("fp", F.xxhash64("text")).repartitionByRange(n, "fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    found = written(rows.withColumn("p", F.spark_partition_id()).mapInArrow(lambda batches: sorted_partition(batches, failed), FOUND))
    earlier = Window.partitionBy("fp", "head").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    edges = found.where("mask is null").groupBy("fp", "head", "p", "run").agg(F.min("least").alias("least"))
    before = edges.withColumn("before", F.min("least").over(earlier)).where("before is not null").select("p", "run", "before")
    whole = found.where("mask is not null")
    again = whole.where("run is not null").join(before, ["p", "run"], "left")
    mended = again.withColumn("mask", F.when(F.col("before") < F.col("doc_id"), F.col("mask").bitwiseOR(COPY)).otherwise(F.col("mask")))
    return whole.where("run is null").select("doc_id", "part", "mask").union(mended.select("doc_id", "part", "mask"))


def counters(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): additive counts of the rows of each failure mask, at most 32 masks a part.

    A doc_id is good if a row of labels says quality 1, toxic if one says toxic 1; rows without labels are neither.
    """
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = masked.join(said.where("good + toxic > 0"), "doc_id").select("part", "mask", F.lit(0).alias("n"), "good", "toxic")
    every = masked.select("part", "mask", F.lit(1).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("toxic")).union(known)
    return every.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def audit(counted: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: all from the part's counters, the rows of docs aren't met again."""
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("c"))
    orders = list(permutations(FILTERS))
    # a generator's rows, so that what a step stands for is worked out once and not in each of the sums below
    every = [{"filter_order": "".join(o), "step": i + 1, "own": BIT[f], "earlier": sum(BIT[x] for x in o[:i])} for o in orders for i, f in enumerate(o)]
    steps = parts.select("part", "c", F.inline(F.from_json(F.lit(json.dumps(every)), "array<struct<filter_order:string,step:int,own:int,earlier:int>>")))

    def total(where: Callable[[Column], Column], value: Callable[[Column], Column] = lambda x: x["n"]) -> Column:
        return F.aggregate(F.filter("c", lambda x: where(x["mask"])), F.lit(0).cast("long"), lambda a, x: a + value(x).cast("long"))

    fails, went = (lambda m: m.bitwiseAND(F.col("own")) != 0), (lambda m: m.bitwiseAND(F.col("earlier")) != 0)
    removed = lambda m: fails(m) & ~went(m)
    return steps.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~went(m)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m) & went(m)).alias("redundant"),
        total(lambda m: m == F.col("own")).alias("unique_fails"),
        total(removed, lambda x: x["good"]).alias("good_lost"),
        total(removed, lambda x: x["toxic"]).alias("toxic_lost"),
        # of all orders, a filter comes first among k failed ones in one of k
        total(fails, lambda x: x["n"] * F.lit(len(orders)) / F.bit_count(x["mask"])).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source", text: str = "text") -> DataFrame:
    """The audit of all rows of docs; odd rows as in `masks` and `counters`; no rows give none."""
    return audit(counters(masks(docs, part, text), labels))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
m as (
  select doc_id, part,
    (case when len(w) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 4 else 0 end) + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
    + (case when min(doc_id) over (partition by t) < doc_id then 16 else 0 end) as mask
  from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
c as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from m left join l using (doc_id) group by part, mask),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as l, unnest([1, 2, 4, 8, 16]) as b),
o as (
  select a.l || b.l || c.l || d.l || e.l as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits
  from f a, f b, f c, f d, f e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s as (select filter_order, step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::bigint as earlier from o, unnest([1, 2, 3, 4, 5]) as u(step))
select part, filter_order, step,
  sum(case when mask & (own | earlier) = 0 then n else 0 end)::bigint as kept,
  sum(case when mask & own <> 0 and mask & earlier = 0 then n else 0 end)::bigint as removed,
  sum(case when mask & own <> 0 and mask & earlier <> 0 then n else 0 end)::bigint as redundant,
  sum(case when mask = own then n else 0 end)::bigint as unique_fails,
  sum(case when mask & own <> 0 and mask & earlier = 0 then good else 0 end)::bigint as good_lost,
  sum(case when mask & own <> 0 and mask & earlier = 0 then toxic else 0 end)::bigint as toxic_lost,
  sum(case when mask & own <> 0 then n * 120 // bit_count(mask) else 0 end)::bigint as shapley
from c, s group by part, filter_order, step
"""
