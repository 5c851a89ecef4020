"""SimHash near-dedup: fingerprints of word shingles, linked by a grid range-join of segment bit counts."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .common import components, map_arrow, n_parts, table, written

SHINGLE = 4
BITS = 4
SEED = 42
#: Bits of a segment. Its bit count is one coordinate of the embedding.
SEGMENT = 2
#: Shingles hashed at a time, which bounds memory for very long texts.
CHUNK = 1 << 16
#: Pairs that one fingerprint may meet by chance in the grid's cells, on average. Comparing two fingerprints in the join
#: costs about a hundredth of a row more to shuffle, and one more group means twenty rows more or so.
CHANCE = 500


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits as an unsigned integer: a bit is 1 if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest as h

    words = text.encode().lower().split() if text else []  # bytes: only A-Z are lowered, and ASCII white space cuts
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    lasts = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        s, e = starts[at : min(n, at + CHUNK)].tolist(), lasts[at : at + CHUNK].tolist()
        hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(s, e, strict=True)), "<u8", len(s))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long, for every row; null and empty texts have 0."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.asarray([fingerprint(x.as_py(), shingle) for x in batch.column(1)], "<u8").view("<i8")
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

        return work

    return map_arrow(docs.select(F.col("doc_id").cast("long"), text), make, "doc_id long, fp long")


def bounds(groups: int, segment: int = SEGMENT) -> list[tuple[int, int]]:
    """The bits of each group: whole segments, about equally many."""
    n = 64 // segment
    at = [round(i * n / groups) * segment for i in range(groups + 1)]
    return list(zip(at, at[1:], strict=False))


def groups_for(n: int, bits: int = BITS, segment: int = SEGMENT) -> int:
    """The least number of groups by which n evenly spread fingerprints meet at most CHANCE others by chance."""
    of_segment = [math.comb(segment, k) / 2**segment for k in range(segment + 1)]
    same = -math.log2(sum(p * p for p in of_segment)) / segment  # bits of a cell for a bit of the fingerprint
    for g in range(bits + 2, 2 * bits + 8):
        if n * math.comb(g, bits) / 2 ** (same * 64 * (g - bits) / g) <= CHANCE:
            return g
    return 2 * bits + 8


def embedding(fp: str) -> str:
    """SQL of the embedding: each 2-bit segment's bit count in unary, 00, 01 or 11. The Manhattan distance of two embeddings is the number of bits that differ in these."""
    odd = "6148914691236517205L"  # 0101...
    return f"((({fp} | shiftrightunsigned({fp}, 1)) & {odd}) | shiftleft({fp} & shiftrightunsigned({fp}, 1) & {odd}, 1))"


def counts_of(emb: str, low: int, high: int) -> str:
    """SQL of the bit counts of the segments in bits low .. high - 1."""
    return f"(shiftrightunsigned({emb}, {low}) & {(1 << (high - low)) - 1}L)"


def near_pairs(points: DataFrame, bits: int = BITS, groups: int | None = None) -> DataFrame:
    """(a, b) with a < b: all pairs of distinct fingerprints of different `part` at `bits` differing bits or fewer.

    Each fingerprint is embedded as the bit counts of its 2-bit segments; the Manhattan distance of two
    embeddings is at most their number of differing bits. The segments lie in groups; within distance `bits`
    at most `bits` groups differ, so the pair shares the grid's cell of some choice of the other groups. Cells
    whose points are all of one part hold nothing to find and are dropped before the join; in the others the
    points of the part with the least number are met only by those of other parts. Pairs whose Manhattan distance
    is over `bits` go no further; of the others the exact bits decide.
    """
    n = points.count()
    g = groups or groups_for(n, bits)
    cut = bounds(g)
    keys = []
    for i, chosen in enumerate(combinations(range(g), g - bits)):
        keys.append(f"xxhash64({i}, {', '.join(counts_of('emb', *cut[j]) for j in chosen)})")
    cells = points.withColumn("emb", F.expr(embedding("fp"))).select("fp", "part", F.explode(F.expr(f"array({', '.join(keys)})")).alias("cell"))
    mixed = cells.groupBy("cell").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first < last")
    inside = cells.join(mixed, "cell").select("cell", "fp", "part", "first")
    a, b = inside.where("part > first").alias("a"), inside.alias("b")
    apart = f"bit_count({embedding('a.fp')} ^ {embedding('b.fp')})"  # the lower bound
    close = F.expr(f"a.cell = b.cell and a.part > b.part and {apart} <= {bits} and bit_count(a.fp ^ b.fp) <= {bits}")
    return a.join(b, close).select(F.least("a.fp", "b.fp").alias("a"), F.greatest("a.fp", "b.fp").alias("b")).distinct()


def stars(points: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links, found without pairs, of fingerprints that differ within one block of `bits` bits only.

    All fingerprints that agree outside a block are within `bits` of each other, so each is linked to the least.
    """
    blocks = [~(((1 << bits) - 1) << at) for at in range(0, 64, bits)] if bits else [-1]
    signed = [m & ((1 << 64) - 1) for m in blocks]
    signed = [m - (1 << 64) if m >> 63 else m for m in signed]
    cells = points.select("fp", F.posexplode(F.expr("array(" + ", ".join(f"fp & ({m}L)" for m in signed) + ")")).alias("block", "rest"))
    return cells.groupBy("block", "rest").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").join(cells, ["block", "rest"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs: component_id is the smallest doc_id that links reach.

    Rows of equal fingerprints are one point, whatever their number; points are linked at `bits` differing bits
    or fewer. Points are joined first where no pairs are needed (`stars`), then by pairs of different parts only,
    so a crowd of near copies is never expanded into all its pairs. Null and empty texts have fingerprint 0;
    rows with a null doc_id keep it, and count as larger than any; other columns are ignored; no rows give none.
    """
    marked = written(fingerprints(docs, text, shingle))
    points = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = components(stars(points, bits))
    part = points.join(joined, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("part"), "least")
    part = written(part)
    pairs = near_pairs(part, bits)
    label = part.select("fp", "part")
    linked = pairs.join(label.select(F.col("fp").alias("a"), F.col("part").alias("u")), "a").join(label.select(F.col("fp").alias("b"), F.col("part").alias("v")), "b")
    merged = components(linked.select(F.col("u").alias("a"), F.col("v").alias("b")))
    whole = part.join(merged, F.col("part") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "part").alias("whole"))
    named = whole.groupBy("whole").agg(F.min("least").alias("component_id"))
    of_fp = whole.join(named, "whole").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


# Near copies of a wider radius: by similarity of the shingle sets, at least 0.8 of five words unless told otherwise.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a wide fingerprint.
WIDE = 4
#: Share of the pairs just at the threshold that the cells of sampled segments may miss.
MISS = 0.01
#: A cell takes the counts of so many segments at least; more where there are more texts, so that about MEET others share a cell by chance.
LEAST_SEGMENTS, MEET = 8, 300
#: Bits of the filter that says which doc_ids are in a pair, whatever the input; a false hit makes one more set and changes no result.
MET_BITS = 1 << 25
#: Bits of a page of it, those of bitmap_bucket_number.
PAGE = 1 << 15


def plan(n: int, similarity: float = SIMILARITY) -> tuple[int, int, list[int]]:
    """(segments of a cell, grids, differing bits at most of a fingerprint's first words, for each number of them) for n texts.

    Two sets of Jaccard similarity s have a cosine of 2s / (1 + s), and a share of arccos / pi of the bits
    differs. The grids grow with the segments of a cell, so that the expected recall is the same for every n: of
    the segments a binomial number has other counts, and a grid samples none of these by a hypergeometric law.
    """
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n_segments = 64 * WIDE // SEGMENT
    # both of a segment's bits stay, or they are swapped
    same, chance = (1 - apart) ** 2 + apart**2 / 2, sum((math.comb(SEGMENT, k) / 2**SEGMENT) ** 2 for k in range(SEGMENT + 1))
    key = min(n_segments // 4, max(LEAST_SEGMENTS, math.ceil(math.log(max(1, n / MEET)) / -math.log(chance))))
    law = [(math.comb(n_segments, d) * (1 - same) ** d * same ** (n_segments - d), math.comb(n_segments - d, key) / math.comb(n_segments, key)) for d in range(n_segments + 1)]
    low, high = 0, 1
    missed = lambda grids: sum(p * (1 - hit) ** grids for p, hit in law)
    while missed(high) > MISS:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if missed(mid) > MISS else (low, mid)
    bits = range(64, 64 * WIDE + 1, 64)
    return key, high, [math.floor(n * apart + 4 * math.sqrt(n * apart * (1 - apart))) for n in bits]


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def embedded_apart(a: Column, b: Column) -> Column:
    """The Manhattan distance of the embeddings of two fingerprint words."""
    odd = F.lit(0x5555555555555555)
    one, two = ([(x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(odd), x.bitwiseAND(F.shiftrightunsigned(x, 1)).bitwiseAND(odd)] for x in (a, b))
    return F.bit_count(one[0].bitwiseXOR(two[0])) + F.bit_count(one[1].bitwiseXOR(two[1]))


def grid(key: int, grids: int) -> np.ndarray:
    """The segments of each grid's coordinates; the first of a longer cell are those of a shorter one."""
    return np.random.default_rng(SEED).permuted(np.tile(np.arange(64 * WIDE // SEGMENT), (grids, 1)), axis=1)[:, :key]


def grid_cells(fps: list[bytes], sampled: np.ndarray) -> np.ndarray:
    """(n, grids) cells of wide fingerprints: the bit counts of each grid's segments, and the grid."""
    grids, key = sampled.shape
    raw = np.frombuffer(b"".join(fps), np.uint8).reshape(-1, 8 * WIDE)
    counts = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(raw), -1, SEGMENT).sum(axis=2, dtype=np.int64)
    weights = np.power(SEGMENT + 1, np.arange(key, dtype=np.int64))
    return np.stack([counts[:, s] @ weights + t * (SEGMENT + 1) ** key for t, s in enumerate(sampled)], axis=1)


def within(words: list[tuple[str, str]], most: list[int]) -> str:
    """SQL: of these pairs of words of two fingerprints the first is at most most[0] bits apart, the first two most[1], and so on: first by the Manhattan distance of their embeddings, a lower bound."""
    low, exact = [f"bit_count({embedding(a)} ^ {embedding(b)})" for a, b in words], [f"bit_count({a} ^ {b})" for a, b in words]
    return " and ".join(f"({' + '.join(x[: i + 1])}) <= {most[i]}" for i in range(len(words)) for x in (low, exact))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text's words in lower case; of all its words if they are fewer."""
    from xxhash import xxh64_intdigest as h

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts, lasts = np.concatenate([[0], ends[:-1] + 1]), (ends[size - 1 :] if len(words) >= size else ends[-1:])
    return np.unique(np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[: len(lasts)].tolist(), lasts.tolist(), strict=True)), "<u8", len(lasts)))


def wide_bits(hashes: np.ndarray) -> np.ndarray:
    """64 * WIDE bits of a set of hashes: a bit is 1 if it is set in over half of them, each word by its own mixing."""
    counts = np.zeros((WIDE, 64), np.int64)
    for at in range(0, len(hashes), CHUNK):
        h = hashes[at : at + CHUNK]
        for w in range(WIDE):
            mixed = (h + np.uint64(w)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            counts[w] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return (2 * counts > len(hashes)).reshape(-1)


def similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, text: str = "text") -> DataFrame:
    """(doc_id, digest, component, component_id) of every row of docs with a doc_id: texts whose sets of shingles have a Jaccard similarity of `similarity` or more are linked.

    Rows of equal shingle sets are one point, null and empty texts (no shingles) one too; `digest` names it, also where
    rows of different texts share a doc_id. `component` numbers what is linked. Each point has a fingerprint
    of 64 * WIDE bits. As in `near_pairs` its embedding is the bit counts of their 2-bit segments; each grid samples some of
    these, since choices of groups that hold every pair of so wide a radius would be too many, and points with equal counts there
    share the grid's cell. Links are looked for without all pairs of a cell: first of each point with its
    cells' least, then between points of different parts. Pairs go no further whose first words, then whole fingerprints, have a
    Manhattan distance, then differing bits, over what `plan` says (four deviations over what is expected at the threshold); of
    the others the exact similarity of the shingle sets decides. component_id is the smallest doc_id that links
    reach; other columns are ignored; no rows give none.
    """
    key, grids, most = plan(docs.count(), similarity)
    sampled = grid(key, grids)

    def make():
        from xxhash import xxh3_128_digest

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            digests, fps = [], []
            for x in batch.column(1):
                hashes = shingles(x.as_py(), shingle)
                digests.append(xxh3_128_digest(hashes.tobytes()))
                fps.append(np.packbits(wide_bits(hashes), bitorder="little").tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(fps, pa.binary())], names=["doc_id", "digest", "fp"])

        return work

    def cells():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = batch.column(2).to_pylist()
            first = np.frombuffer(b"".join(x[:16] for x in fps), "<i8").reshape(-1, 2)
            own = [np.repeat(x, grids) for x in (batch.column(0).to_numpy(), batch.column(1).to_numpy(), first[:, 0], first[:, 1])]
            found = grid_cells(fps, sampled)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, found.reshape(-1))], names=["id", "part", "word", "next", "cell"])

        return work

    def celled(points: DataFrame) -> DataFrame:
        """(id, part, word, next, cell) of points (id, part, fp): a row for each grid, with the fingerprint's first two words."""
        small = points.select("id", "part", "fp").repartition(max(1, n_parts(docs.sparkSession)))
        return map_arrow(small, cells, "id long, part long, word long, next long, cell long").repartition("cell")

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t"))

    def sets(bits: bytes):
        from xxhash import xxh3_128_digest

        filter_ = np.frombuffer(bits, np.uint8)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.column(2).to_numpy()
            met = (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            own = batch.filter(pa.array(met.astype(bool)))
            found = [shingles(x.as_py(), shingle) for x in own.column(1)]
            digests = [xxh3_128_digest(x.tobytes()) for x in found]
            return pa.RecordBatch.from_arrays([own.column(0), pa.array(digests, pa.binary()), pa.array([x.view("<i8") for x in found], pa.list_(pa.int64()))], names=["doc_id", "digest", "s"])

        return work

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of point ids whose shingle sets are similar enough."""
        manhattan, apart = (F.aggregate(F.zip_with("fa", "fb", d), F.lit(0), lambda n, x: n + x) for d in (embedded_apart, bits_apart))
        words = points.select("id", F.array(*[F.expr(f"cast(conv(hex(substring(fp, {8 * i + 1}, 8)), 16, -10) as long)") for i in range(WIDE)]).alias("f"))
        near = pairs.distinct().join(words.select(F.col("id").alias("a"), F.col("f").alias("fa")), "a").join(words.select(F.col("id").alias("b"), F.col("f").alias("fb")), "b")
        pairs = written(near.where((manhattan <= most[-1]) & (apart <= most[-1])).select("a", "b"))
        met = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        # the texts of the points' smallest doc_ids, of which those count whose set is the point's
        names = written(points.join(met, "id", "left_semi").select("id", F.col("least").alias("doc_id"), "digest"))
        bit = F.pmod(F.xxhash64("doc_id"), F.lit(MET_BITS))
        pages = names.select(bit.alias("x")).groupBy(F.bitmap_bucket_number(F.col("x") + 1).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("x") + 1)).alias("bits"))
        filter_ = bytearray(MET_BITS // 8)
        for r in pages.collect():  # pages are numbered from 1
            filter_[(r["page"] - 1) * PAGE // 8 : r["page"] * PAGE // 8] = r["bits"]
        known = docs.sparkSession.sparkContext.broadcast(bytes(filter_))
        own = map_arrow(texts.select("doc_id", "t", bit.alias("x")), lambda: sets(known.value), "doc_id long, digest binary, s array<long>")
        one = own.join(names, ["doc_id", "digest"]).dropDuplicates(["id"]).select("id", "s")
        both = pairs.join(one.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(one.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        shared = "size(array_intersect(sa, sb))"
        return both.where(F.expr(f"{shared} >= {similarity}d * (size(sa) + size(sb) - {shared})")).select("a", "b").distinct()

    marked = written(map_arrow(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text), make, "doc_id long, digest binary, fp binary"))
    points = written(marked.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")).withColumn("id", F.monotonically_increasing_id()))
    by_id = Window.partitionBy("cell").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    first = celled(points.withColumn("part", F.col("id"))).withColumn("f", F.first(F.struct("id", "word", "next")).over(by_id))
    joined = components(verified(first.where((F.col("id") > F.col("f.id")) & F.expr(within([("word", "f.word"), ("next", "f.next")], most))).select(F.col("id").alias("a"), F.col("f.id").alias("b"))))
    parted = points.join(joined, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("part"), "fp")
    whole = Window.partitionBy("cell")
    mixed = celled(parted).withColumn("first", F.min("part").over(whole)).withColumn("last", F.max("part").over(whole)).where("first < last")
    a, b = mixed.where("part > first").alias("a"), mixed.alias("b")
    pairs = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.part") > F.col("b.part")) & F.expr(within([("a.word", "b.word"), ("a.next", "b.next")], most))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    links = verified(pairs)
    merged = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))
    whole = points.select("digest", "id", "least").join(merged, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("component"), "least")
    named = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    of_point = whole.join(named, "component").select("digest", "component", "component_id")
    return marked.select("doc_id", "digest").join(of_point, "digest").select("doc_id", "digest", "component", "component_id")


def digested(docs: DataFrame, shingle: int = WIDE_SHINGLE, text: str = "text") -> DataFrame:
    """docs with `_sim_digest`, the digest of a row's set of shingles that `similar` gives; columns of that name are refused."""
    if "_sim_digest" in docs.columns:
        raise ValueError("column _sim_digest is in the way")
    at = docs.columns.index(text)

    def make():
        from xxhash import xxh3_128_digest

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [xxh3_128_digest(shingles(x.as_py(), shingle).tobytes()) for x in batch.column(at)]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "_sim_digest"])

        return work

    return map_arrow(docs, make, StructType([*docs.schema.fields]).add("_sim_digest", BinaryType()))


def as_hex(fp: str | Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")
