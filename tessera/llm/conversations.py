"""Conversation prefix trie: the shared beginnings of conversations, by dictionary tries of hash-partitioned subtries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_parts, table, written

#: Turns of a subtrie that one task takes; larger ones are parted by their next turn.
SUBTRIE = 20_000
#: Turns of the subtries that are built in one call, about.
BUCKET = 50_000
NONE_SHA = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, pg binary"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, t, bytes): the turns of each conversation in order, from 1 on; t is a digest of role and text.

    Null roles and texts are empty; null turns come first; turns of one number are in the order of their digests, repeated rows stay.
    Rows without a conv_id are left out. A conversation is ranked in blocks of 1024 turn numbers, so that a very long one isn't
    sorted by one task; texts aren't moved.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.substring(F.unhex(F.sha2(said, 256)), 1, 16).alias("t"), F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.withColumn("block", F.coalesce(F.shiftright("turn", 10), F.lit(-(1 << 62))))
    within = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "t")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = rows.withColumn("k", F.row_number().over(within)).join(blocks, ["conv_id", "block"])
    return ranked.select("conv_id", (F.col("k") + F.col("before")).alias("i"), "t", "bytes")


def rebuilt(said: DataFrame, shift: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, t, bytes) of the rebuilt conversations' turns, and (conv_id) of all of them, also those without turns.

    Conversation c begins with the first h turns of c - c % shift (% as in SQL: of c's sign), h = crc32 of c's digits modulo
    `most`, and goes on with its own turns after its first h.
    """
    sizes = said.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % shift).alias("base"))
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base")), "base", "left")
    head = said.where(F.col("i") < most).withColumnRenamed("conv_id", "base").join(convs, "base").where("i <= h").select("conv_id", F.col("i").alias("pos"), "t", "bytes")
    own = said.join(convs, "conv_id").where("i > h").select("conv_id", (F.least("h", F.coalesce("of_base", F.lit(0))) + F.col("i") - F.col("h")).alias("pos"), "t", "bytes")
    return head.union(own), sizes.select("conv_id")


def hashed_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, sha) of sorted rows (cls, block, ids): SHA-256 of a class's ids, row by row, none of them kept."""
    cls = sha = None
    for batch in batches:
        done = []
        for c, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if c != cls:
                if sha:
                    done.append((cls, sha.hexdigest()))
                cls, sha = c, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["cls", "sha"])
    if sha:
        yield pa.RecordBatch.from_arrays([pa.array([cls], pa.int64()), pa.array([sha.hexdigest()])], names=["cls", "sha"])


def classes(turned: DataFrame, convs: DataFrame) -> DataFrame:
    """(cls, n, w, sha): the distinct conversations, cls the smallest conv_id of each, its turns, copies, and the digest of the copies' conv_ids.

    Copies are put as one before any trie is built. Two conversations are the same if two 64-bit sums over their turns'
    digests with their places are. The ids of many copies are joined in blocks and hashed as a stream.
    """
    keyed = turned.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("pos", "t")).alias("k1"), F.bit_xor(F.xxhash64("t", "pos", F.lit(1))).alias("k2"))
    zero = {"n": 0, "k1": 0, "k2": 0}
    keyed = written(convs.join(keyed, "conv_id", "left").na.fill(zero))
    found = keyed.groupBy("n", "k1", "k2").agg(F.min("conv_id").alias("cls"), F.count(F.lit(1)).alias("w"))
    many = keyed.join(found.where("w > 1"), ["n", "k1", "k2"])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    joined = many.groupBy("cls", F.shiftright("conv_id", 16).alias("block")).agg(ids.alias("ids"))
    parts = n_parts(turned.sparkSession)
    shas = joined.repartition(parts, "cls").sortWithinPartitions("cls", "block").mapInArrow(hashed_members, "cls long, sha string")
    one = F.when(F.col("w") == 1, F.sha2(F.col("cls").cast("string"), 256))
    return found.join(shas, "cls", "left").select("cls", "n", "w", F.coalesce("sha", one).alias("sha"))


def trie(depth: int):
    """A function of pandas rows (g, pg, up, cls, pos, t, bytes, w, sha): the nodes of their subtries, whose tops have this depth."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cls", "pos"])
        tops: dict[bytes, int] = {}
        below: list[dict[bytes, int]] = []
        conv, deep, parent, convs, size, sha, up, pg = ([] for _ in range(8))
        node = -1
        for g, of, above, cls, pos, t, n, w, end in zip(*(rows[c] for c in ("g", "pg", "up", "cls", "pos", "t", "bytes", "w", "sha")), strict=True):
            where, key = (tops, g) if pos == depth else (below[node], t)
            if key not in where:
                where[key] = len(conv)
                below.append({})
                conv.append(cls)  # classes come in order, the first is the smallest
                deep.append(pos)
                parent.append(node if pos > depth else -1)
                convs.append(0)
                size.append(n)
                sha.append(None)
                up.append(above if pos == depth else conv[node])
                pg.append(of if pos == depth else None)
            node = where[key]
            convs[node] += w
            if end is not None:
                sha[node] = end
        leaves, saved = [0] * len(conv), [0] * len(conv)
        waiting = [(top, False) for top in tops.values()]
        while waiting:
            node, done = waiting.pop()
            if not done:
                waiting.append((node, True))
                waiting.extend((child, False) for child in below[node].values())
                continue
            leaves[node] = leaves[node] or 1
            saved[node] += (convs[node] - 1) * size[node]
            if (over := parent[node]) >= 0:
                leaves[over] += leaves[node]
                saved[over] += saved[node]
        return pd.DataFrame({"conv_id": conv, "depth": deep, "parent_conv_id": up, "n_convs": convs, "n_children": [len(x) for x in below], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": sha, "pg": pg})

    return build


def chains(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of oversized subtries that are one distinct conversation: a chain, by sums over blocks of its turns."""
    rows = rows.withColumn("block", F.shiftright("pos", 14)).withColumn("own", (F.col("w") - 1) * F.col("bytes"))
    after = Window.partitionBy("g").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("g", "block").agg(F.sum("own").alias("s")).withColumn("later", F.coalesce(F.sum("s").over(after), F.lit(0))).drop("s")
    here = Window.partitionBy("g", "block").orderBy(F.desc("pos"))
    top = F.col("pos") == depth
    rest = rows.withColumn("s", F.sum("own").over(here)).join(blocks, ["g", "block"])
    return rest.select(
        F.col("cls").alias("conv_id"), F.col("pos").cast("long").alias("depth"), F.when(top, F.col("up")).otherwise(F.col("cls")).alias("parent_conv_id"), F.col("w").alias("n_convs"),
        F.when(F.col("sha").isNull(), 1).otherwise(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), (F.col("s") + F.col("later")).alias("saved_tokens"), F.col("sha").alias("ends_sha256"), F.when(top, F.col("pg")).alias("pg"),
    )


def prefix_trie(turned: DataFrame, convs: DataFrame, subtrie: int = SUBTRIE, bucket: int = BUCKET) -> DataFrame:
    """All nodes of the trie of rebuilt conversations, as `op11_conversation_trie` returns them; no conversations give no rows.

    Subtries are named by a digest of their top's path, at first the first turn's, and dealt out by its hash; each bucket of whole
    subtries is built in one call. Those of more than `subtrie` turns are parted by their next turn, again and again; their tops
    are summed up from the parts, deepest first. One conversation alone, however long, is a chain of sums.
    """
    spark = turned.sparkSession
    known = written(classes(turned, convs))
    named = known.select("cls", F.col("n").alias("_n"), "w", "sha")
    live = turned.join(named, turned["conv_id"] == named["cls"]).select("cls", "pos", "t", "bytes", "w", F.when(F.col("pos") == F.col("_n"), F.col("sha")).alias("sha"))
    root = known.agg(F.min("cls").alias("least"), F.sum("w").alias("convs"), F.max(F.when(F.col("n") == 0, F.col("sha"))).alias("end")).where("least is not null")
    root = root.select(F.lit(b"").alias("g"), F.lit(None).cast("binary").alias("pg"), F.lit(None).cast("long").alias("up"), "least", "convs", F.lit(0).cast("long").alias("size"), "end")
    first = known.agg(F.min("cls")).first()[0]
    live = live.withColumn("pg", F.lit(b"")).withColumn("up", F.lit(first).cast("long"))
    split, built, depth = [root], [], 0
    while True:
        depth += 1
        path = F.col("t") if depth == 1 else F.substring(F.unhex(F.sha2(F.concat("pg", "t"), 256)), 1, 16)
        heads = live.where(F.col("pos") == depth).select("cls", path.alias("g"))
        keyed = written(live.join(heads, "cls"))
        n = keyed.count()
        if not n:
            break
        top = F.col("pos") == depth
        of_top = lambda c, f: f(F.when(top, F.col(c)))
        sizes = keyed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(top, 1)).alias("n_cls"), F.first("pg").alias("pg"), F.first("up").alias("up"), of_top("cls", F.min).alias("least"), of_top("w", F.sum).alias("convs"), of_top("bytes", F.max).alias("size"), of_top("sha", F.max).alias("end"))
        large = written(sizes.where(F.col("n") > subtrie))
        n_large = large.count()
        small = keyed if not n_large else keyed.join(large, "g", "left_anti")
        buckets = max(n_parts(spark), -(-n // bucket))
        dealt = small.withColumn("_b", F.pmod(F.xxhash64("g"), F.lit(buckets)))
        nodes = dealt.groupBy("_b").applyInPandas(trie(depth), NODE)
        if not n_large:
            built.append(written(nodes))
            break
        alone = keyed.join(large.where("n_cls = 1").select("g"), "g", "left_semi")
        built.append(written(nodes.unionByName(chains(alone, depth))))
        large = large.where("n_cls > 1")
        split.append(large.select(*root.columns))
        next_up = large.select("g", F.col("least").alias("_up"))
        live = keyed.where(F.col("pos") > depth).join(next_up, "g").select("cls", "pos", "t", "bytes", "w", "sha", F.col("g").alias("pg"), F.col("_up").alias("up"))
    out, tops = built, None
    for d in reversed(range(len(split))):
        # what lies a level deeper: subtries built whole, and parted ones that are summed up already
        lower = [built[d].where("pg is not null")] if d < len(built) else []
        lower = reduce(DataFrame.unionByName, [*lower, *([tops] if tops is not None else [])]) if lower or tops is not None else None
        own = (F.col("convs") - 1) * F.col("size")
        up = split[d]
        if lower is not None:
            sums = lower.groupBy(F.col("pg").alias("_g")).agg(F.count(F.lit(1)).alias("_c"), F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
            up = up.join(sums, F.col("g") == F.col("_g"), "left")
        else:
            up = up.select("*", *[F.lit(None).cast("long").alias(c) for c in ("_c", "_l", "_s")])
        tops = up.select(
            F.col("least").alias("conv_id"), F.lit(d).cast("long").alias("depth"), F.col("up").alias("parent_conv_id"), F.col("convs").alias("n_convs"), F.coalesce("_c", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("_l", F.lit(1)).cast("long").alias("n_leaves"), (F.coalesce("_s", F.lit(0)) + own).cast("long").alias("saved_tokens"), F.col("end").alias("ends_sha256"), "pg",
        )
        tops = written(tops)
        out = [*out, tops]
    return reduce(DataFrame.unionByName, out).drop("pg").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NONE_SHA)))


def conversation_trie(conversations: DataFrame, subtrie: int = SUBTRIE, bucket: int = BUCKET) -> DataFrame:
    """The trie of the rebuilt conversations; odd rows as in `turns`."""
    turned, convs = rebuilt(written(turns(conversations)))
    return prefix_trie(written(turned), convs, subtrie, bucket)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
with c as (
  select conv_id, conv_id - conv_id % 5 as base,
    xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::ubigint),
      lambda s, b: list_reduce(range(8)::ubigint[], lambda k, z: case when k & 1 = 1 then xor(k >> 1, 3988292384::ubigint) else k >> 1 end, xor(s, b)), 4294967295::ubigint), 4294967295::ubigint) % 9 as h
  from (select distinct conv_id from conversations where conv_id is not null)),
o as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(role)::varchar || ':' || role || text)) as i, role, text
  from (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)),
n as (select conv_id, count(*) as n from o group by conv_id),
r as (
  select c.conv_id as conv_id, i as pos, role, text from c join o on o.conv_id = c.base where i <= h
  union all
  select c.conv_id, least(h, coalesce(n, 0))::bigint + i - h::bigint, role, text from c join o on o.conv_id = c.conv_id left join n on n.conv_id = c.base where i > h),
p as (
  select conv_id, pos, text, list({'r': role, 't': text}) over (partition by conv_id order by pos) as path from r
  union all select conv_id, 0, '', [] from c),
node as (select pos, path, min(conv_id) as least, count(*) as n_convs, (count(*) - 1) * strlen(any_value(text)) as own from p group by pos, path),
m as (select conv_id, p.pos as pos, least, n_convs, own from p join node on p.pos = node.pos and p.path = node.path),
up as (select m.least as conv_id, m.pos as depth, any_value(b.least) as parent, any_value(m.n_convs) as n_convs, any_value(m.own) as own from m left join m b on b.conv_id = m.conv_id and b.pos = m.pos - 1 group by m.least, m.pos),
kids as (select parent, depth - 1 as depth, count(*) as n_children from up where parent is not null group by parent, depth),
full_node as (select up.*, coalesce(n_children, 0) as n_children from up left join kids on kids.parent = up.conv_id and kids.depth = up.depth),
own as (
  select m.conv_id, m.pos, m.least, sum(coalesce(f.own, 0)) over w as saved, sum(case when f.n_children = 0 then 1 else 0 end) over w as leaves, lead(m.pos) over (partition by m.conv_id order by m.pos) is null as ends
  from m left join full_node f on f.conv_id = m.conv_id and f.depth = m.pos window w as (partition by m.conv_id order by m.pos desc)),
s as (select least, pos, sum(saved) as saved, sum(leaves) as leaves, coalesce(string_agg(case when ends then conv_id::varchar end, ',' order by conv_id), '') as ids from own group by least, pos)
select f.conv_id as conv_id, f.depth::bigint as depth, f.parent as parent_conv_id, f.n_convs::bigint as n_convs, f.n_children::bigint as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(ids) as ends_sha256
from full_node f join s on s.least = f.conv_id and s.pos = f.depth
"""
