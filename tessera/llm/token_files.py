"""Token-id files: Simple-8b word-aligned coding of ids, in ascending doc_id order."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, n_parts, shared_dir, splits, table
from .tokens import encoder, vocabulary

END_ID = 2
#: Ids of a block; a document is never split, so a long one makes a longer block.
BLOCK_IDS = 1 << 16
#: Every so many ids the coding starts at a word of its own, whose place is kept.
STRIDE = 4096
#: Bytes of ids given back at a time.
OUT_BYTES = 4 << 20

# Fixed values of the format: selector -> (ids in a word, bits of each). 15 is the escape: the next word is one id of 64 bits.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 0)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 64)
ONE = 15  # the escape takes one id and two words

BLOCK_SCHEMA = "part int, block long, before long, doc_ids binary, doc_nulls binary, lengths binary, palette binary, offsets binary, words binary, n_ids long"


def encode_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned 64-bit values -> (words, the place of the first word of every STRIDE values)."""
    v = values.astype("<u8")
    n = len(v)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, "<u4")
    place = np.arange(n, dtype=np.int32)
    border = np.minimum((place // STRIDE + 1) * STRIDE, n).astype(np.int32)
    choice = np.full(n, ONE, dtype=np.int8)
    most = int(v.max())
    for s in range(ONE - 1, -1, -1):  # from the fewest ids to the most
        if most >> BITS[s]:
            run = np.where(v >> np.uint64(BITS[s]) > 0, place, border)
            run = np.minimum(np.minimum.accumulate(run[::-1])[::-1], border) - place
        else:
            run = border - place
        fits = run >= COUNTS[s]
        if not fits.any():
            break  # more ids of fewer bits fit nowhere either
        choice[fits] = s
    step = np.asarray((*COUNTS[:ONE], 1))[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    begin = np.asarray(starts, dtype=np.int64)
    chosen = choice[begin]
    width = np.where(chosen == ONE, 2, 1)
    where = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), "<u8")
    for s in np.unique(chosen).tolist():
        own, to = begin[chosen == s], where[chosen == s]
        word = np.full(len(own), s << 60, "<u8")
        for j in range(COUNTS[s] if BITS[s] else 0):
            word |= v[own + j] << np.uint64(j * BITS[s])
        out[to] = word
        if s == ONE:
            out[to + 1] = v[own]
    return out, where[np.flatnonzero(begin % STRIDE == 0)].astype("<u4")


def decode_words(words: np.ndarray, offsets: np.ndarray, n: int, low: int = 0, high: int | None = None) -> np.ndarray:
    """The values low .. high - 1 of the n that `encode_words` coded; only the strides that hold them are decoded, all at once."""
    high = n if high is None else min(high, n)
    if low >= high:
        return np.zeros(0, "<u8")
    first, last = low // STRIDE, -(-high // STRIDE)
    begin = int(offsets[first])
    own = words[begin : int(offsets[last]) if last < len(offsets) else len(words)]
    selector = (own >> np.uint64(60)).astype(np.int64)
    marked = selector == ONE
    heads = np.arange(len(own))
    if marked.any():
        # of marked words that follow each other the first, the third, ... are escapes: what follows an escape is a plain id
        start = np.maximum.accumulate(np.where(marked & ~np.concatenate([[False], marked[:-1]]), heads, 0))
        escapes = heads[marked & ((heads - start) % 2 == 0)]
        heads = np.delete(heads, escapes + 1)
    chosen = selector[heads]
    count = np.asarray((*COUNTS[:ONE], 1))[chosen]
    to = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), "<u8")
    for s in np.unique(chosen):
        mine, at = heads[chosen == s], to[chosen == s]
        if s == ONE:
            out[at] = own[mine + 1]
        elif BITS[s]:
            mask, packed = np.uint64((1 << BITS[s]) - 1), own[mine]
            for j in range(COUNTS[s]):
                out[at + j] = (packed >> np.uint64(j * BITS[s])) & mask
    if len(out) != min(n, last * STRIDE) - first * STRIDE or not np.array_equal(to[np.searchsorted(heads, offsets[first:last].astype(np.int64) - begin)], np.arange(last - first) * STRIDE):
        raise ValueError("a block is damaged: its strides don't begin where they should")
    return out[low - first * STRIDE : high - first * STRIDE]


def encode_block(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """ids -> palette (the block's distinct ids, the most frequent first), offsets, words of places in the palette."""
    counts = np.bincount(ids)
    distinct = np.flatnonzero(counts)
    palette = distinct[np.argsort(-counts[distinct], kind="stable")]
    rank = np.zeros(len(counts), np.int64)
    rank[palette] = np.arange(len(palette))
    words, offsets = encode_words(rank[ids])
    return palette.astype("<u4").tobytes(), offsets.tobytes(), words.tobytes()


def decode_block(palette: bytes, offsets: bytes, words: bytes, n: int, low: int = 0, high: int | None = None) -> np.ndarray:
    """The ids low .. high - 1 of a block of n."""
    places = decode_words(np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<u4"), n, low, high)
    return np.frombuffer(palette, "<u4")[places.astype(np.int64)]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = END_ID, block_ids: int = BLOCK_IDS, text: str = "text") -> None:
    """Writes the ids of all documents in ascending doc_id order, as rows that are each a coded block.

    Texts are encoded where they are read; only their ids (16 bits each where the vocabulary fits) are dealt
    out, by ranges of doc_id. File `part` holds the part-th range. Null doc_ids come first; rows with the
    same doc_id follow each other by their ids; null texts are `end_id` alone; no rows give an empty folder.
    """
    spark = docs.sparkSession
    bounds = splits(docs, "doc_id", n_parts(spark))
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = encoder(tokenizer_path).texts
        for batch in batches:
            small, packed, size, begin = [], [], 0, 0
            for i, raw in texts(batch.column(2)):
                ids = np.frombuffer(raw + end, "<u4")
                small.append(not len(ids) or int(ids.max()) < 1 << 16)
                packed.append((ids.astype("<u2") if small[-1] else ids).tobytes())
                size += len(packed[-1])
                if size >= OUT_BYTES or i + 1 == batch.num_rows:
                    own = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(small), pa.array(packed, pa.binary())], names=["part", "doc_id", "small", "ids"])
                    small, packed, size, begin = [], [], 0, i + 1

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n, block, before = 0, 0, 0

        def row() -> pa.RecordBatch:
            ids = np.concatenate([x[2] for x in held])
            palette, offsets, words = encode_block(ids)
            doc_ids = np.asarray([x[1] or 0 for x in held], "<i8").tobytes()
            nulls = np.packbits([x[1] is None for x in held]).tobytes()
            lengths = np.asarray([len(x[2]) for x in held], "<u4").tobytes()
            values = [held[0][0], block, before, doc_ids, nulls, lengths, palette, offsets, words, len(ids)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            for part, doc, small, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append((part, doc, np.frombuffer(ids, "<u2" if small else "<u4")))
                n += len(held[-1][2])
                if n >= block_ids:
                    yield row()
                    held, n, block, before = [], 0, block + 1, before + n
        if held:
            yield row()

    coded = docs.select(bucket("doc_id", bounds).alias("part"), F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(encode, "part int, doc_id long, small boolean, ids binary")
    (coded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("doc_id", "ids").mapInArrow(blocks, BLOCK_SCHEMA).write.mode("overwrite").option("compression", "zstd").parquet(path))


def read_token_files(spark: SparkSession, path: str, tokens: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, and its token_ids if asked for, from the files.

    start counts the ids of all documents before it: what the files before hold (one number a file, on the
    driver) and what the blocks before in the same file hold, which each block says. Blocks aren't shuffled.
    Documents with null doc_ids, texts without ids and repeated rows are read as they were written; an empty folder gives no rows.
    """
    files = spark.read.schema(BLOCK_SCHEMA).parquet(path)

    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    base, total = {}, 0
    for r in sizes:
        base[r["part"]], total = total, total + r["n"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<int>" * tokens

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (x for i in range(batch.num_rows) for x in batch.slice(i, 1).to_pylist()):
                ids = decode_block(r["palette"], r["offsets"], r["words"], r["n_ids"])
                lengths = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                nulls = np.unpackbits(np.frombuffer(r["doc_nulls"], np.uint8))[: len(lengths)].astype(bool)
                begin = np.cumsum(lengths) - lengths
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), lengths.tolist(), strict=True)]
                out = [pa.array(np.frombuffer(r["doc_ids"], "<i8"), pa.int64(), mask=nulls), pa.array(base[r["part"]] + r["before"] + begin), pa.array(lengths), pa.array(crc, pa.int64())]
                if tokens:
                    out.append(pa.array([ids[b : b + n].astype("int32") for b, n in zip(begin.tolist(), lengths.tolist(), strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in schema.split(", ")])

    return files.mapInArrow(decode, schema)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary())
    return read_token_files(spark, path)
