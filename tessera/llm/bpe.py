"""Byte-level BPE: ranked merges folded over the bytes of distinct words, and decoding by concatenated pieces.

Words are whole-corpus statistics: the most frequent white-space chunks are cut by the vocabulary's pattern and
their distinct words encoded by Spark's higher-order functions, against a literal rank map. Their ids, of
proven size, go to every worker; there the remaining, rarer words take the same fold, once a worker.
Bytes stand as strings of the 256 characters of ISO-8859-1 where map keys must be strings.
"""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .merges import KEPT, Kept, Merges, by_bytes, spread
from .tokens import vocabulary

BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
#: Chunks whose words are encoded ahead: at most so many, each of at most so many bytes (16 MB in all).
AHEAD_CHUNKS = 1 << 18
AHEAD_BYTES = 64
#: Rank maps are cut into so many parts by hash, since a map is searched from its start.
PARTS = 1 << 13
# What stands for the ids of a chunk that isn't encoded by itself; no rank is so high.
_MARK = 0xFFFFFFFF
_ODD = _MARK.to_bytes(4, "little")


@functools.lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _literal(value, kind: str) -> str:
    """SQL of a constant array or map, folded into a literal when the plan is optimised."""
    text = json.dumps(value, separators=(",", ":")).replace("\\", "\\\\").replace("'", "\\'")
    return f"from_json('{text}', '{kind}')"


def rank_map_sql(ranks: dict[bytes, int], parts: int = PARTS) -> str:
    """SQL of array<map<bytes, rank>>; a key lies in the part of its xxhash64."""
    import xxhash

    cut: list[dict[str, int]] = [{} for _ in range(parts)]
    for token, rank in ranks.items():
        key = token.decode("latin-1")
        signed = (h := xxhash.xxh64_intdigest(key.encode(), 42)) - (h >> 63 << 64)
        cut[signed % parts][key] = rank
    return _literal(cut, "array<map<string,int>>")


def fold_words(words: DataFrame, ranks: dict[bytes, int], parts: int = PARTS) -> DataFrame:
    """(word) -> (word, ids): starting from single bytes, the adjacent pair of lowest rank, leftmost first, is merged until none is left.

    Null words give null ids, empty ones an empty array; every single byte must have a rank.
    """
    sql = rank_map_sql(ranks, parts)

    def rank(x: str) -> str:
        return f"element_at(element_at({sql}, cast(pmod(xxhash64({x}), {parts}) as int) + 1), {x})"

    none = 2147483647
    of = lambda x: f"coalesce({rank(x)}, {none})"
    # p: the pieces; r: the rank of each with the next; a merge at i makes one piece of two, and two ranks anew
    made = "concat(element_at(a.p, b.i), element_at(a.p, b.i + 1))"
    head = f"if(b.i > 1, array({of('concat(element_at(a.p, greatest(b.i - 1, 1)), c.q)')}), cast(array() as array<int>))"
    tail = f"if(b.i + 1 < size(a.p), array({of('concat(c.q, element_at(a.p, least(b.i + 2, size(a.p))))')}), cast(array() as array<int>))"
    merged = f"""named_struct('p', concat(slice(a.p, 1, b.i - 1), array(c.q), slice(a.p, b.i + 2, size(a.p))),
      'r', concat(slice(a.r, 1, greatest(b.i - 2, 0)), {head}, {tail}, slice(a.r, b.i + 2, size(a.r))))"""
    at = f"named_struct('i', cast(array_position(a.r, array_min(a.r)) as int))"
    step = f"case when coalesce(array_min(a.r), {none}) = {none} then a else transform(array({at}), b -> transform(array(named_struct('q', {made})), c -> {merged})[0])[0] end"
    start = f"transform(array(transform(sequence(1, length(bytes)), i -> substr(bytes, i, 1))), p -> named_struct('p', p, 'r', transform(filter(sequence(1, size(p)), i -> i < size(p)), i -> {of('concat(element_at(p, i), element_at(p, i + 1))')})))[0]"
    fold = f"aggregate(sequence(1, length(bytes)), {start}, (a, _) -> {step}, a -> a.p)"
    known = words.withColumn("bytes", F.expr("decode(encode(word, 'UTF-8'), 'ISO-8859-1')")).withColumn("whole", F.expr(rank("bytes")))
    pieces = known.withColumn("pieces", F.expr(f"case when bytes is null then null when bytes = '' then cast(array() as array<string>) when whole is not null then array(bytes) else {fold} end"))
    return pieces.select("word", F.expr(f"transform(pieces, x -> {rank('x')})").alias("ids"))


def pattern_sql(pattern: str) -> str:
    """The vocabulary's pattern as a Java pattern with Unicode classes, in an SQL string."""
    return "'(?U)" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def frequent_chunks(docs: DataFrame, text: str, most: int = AHEAD_CHUNKS) -> DataFrame:
    """The most frequent space-separated chunks of all texts, `most` at most; none of several equally frequent ones if not all fit."""
    counts = docs.select(F.explode(F.split(text, " ", -1)).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.where(f"n > 1 and octet_length(chunk) between 1 and {AHEAD_BYTES}"))
    least, total = 2, 0
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).toLocalIterator():
        total += r["k"]
        if total > most:
            least = r["n"] + 1
            break
    return counts.where(F.col("n") >= least).select("chunk")


def pairs_of(ranks: dict[bytes, int]) -> Merges:
    """Every pair of pieces that makes a piece, with that one's rank: the order of merging."""
    left, right, made = [], [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                left.append(a)
                right.append(b)
                made.append(rank)
    return Merges(*(np.asarray(x, np.int64) for x in (left, right, made, made)), max(ranks[bytes([b])] for b in range(256)) + 1)


class Encoder:
    """Texts -> their ids: those of words that were folded ahead, and of other words by the same fold, many at once; chunks and theirs are kept."""

    def __init__(self, path: str, pattern: str, ahead: dict[str, bytes]):
        import regex

        self.ranks, self.find, self.ahead = load_ranks(path), regex.compile(pattern).findall, ahead
        self.merges, self.kept, self.kept_words = pairs_of(self.ranks), Kept(), Kept(KEPT // 4)
        self.first = np.asarray([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words."""
        found = [*map(self.ahead.get, words)]
        rest = [w.encode() for w, ids in zip(words, found, strict=True) if ids is None]
        whole = [*map(self.ranks.get, rest)]
        merged = iter(self.merges.many([w for w, rank in zip(rest, whole, strict=True) if rank is None], self.first))
        new = iter([next(merged) if rank is None else rank.to_bytes(4, "little") for rank in whole])
        return [next(new) if ids is None else ids for ids in found]

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks with the space before them; _ODD for those with white space at their ends, whose text must be cut as a whole."""
        odd = [not (c := x.removeprefix(" ")) or c[0].isspace() or c[-1].isspace() for x in chunks]
        cut = [() if o else self.find(x) for x, o in zip(chunks, odd, strict=True)]
        distinct = list(set().union(*cut))
        ids = dict(zip(distinct, self.words(distinct), strict=True))
        return [_ODD if o else ids[own[0]] if len(own) == 1 else b"".join([ids[w] for w in own]) for own, o in zip(cut, odd, strict=True)]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, the ids of all).

        A space between two characters that aren't white space begins a match of the pattern, so a text can be cut there.
        """
        cut = pc.split_pattern(texts, " ")
        offsets, flat = np.asarray(cut.offsets), cut.flatten()
        before = np.ones(len(flat), np.int8)
        before[offsets[:-1]] = 0
        spaces = pa.DictionaryArray.from_arrays(pa.array(before), pa.array(["", " "], flat.type)).cast(flat.type)
        keyed = pc.binary_join_element_wise(spaces, flat, pa.scalar("", flat.type)).dictionary_encode()
        counts, ids = spread(*self.kept.ids(keyed.dictionary, self.chunks), keyed.indices.to_numpy(), offsets)
        ends = np.cumsum(counts)
        whole = np.unique(np.searchsorted(ends, np.flatnonzero(ids == _MARK), side="right"))
        if not len(whole):
            return counts, ids
        found = [self.find(t) for t in texts.take(pa.array(whole)).to_pylist()]
        words = pa.array([w for own in found for w in own], texts.type).dictionary_encode()
        again, new = spread(*self.kept_words.ids(words.dictionary, self.words), words.indices.to_numpy(), np.concatenate([[0], np.cumsum([len(x) for x in found])]))
        parts, fresh = np.split(ids, ends[:-1]), np.split(new, np.cumsum(again)[:-1])
        for i, x in zip(whole.tolist(), fresh, strict=True):
            parts[i] = x
        return np.asarray([len(x) for x in parts]), np.concatenate(parts)


_kept: dict = {}


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", most: int = AHEAD_CHUNKS) -> DataFrame:
    """(doc_id, token_ids) of each row of docs, as encode_ordinary of the tiktoken library gives them.

    Null and empty texts give an empty array; every row is encoded for itself, so ties, repeated rows and null
    doc_ids stay as they are; other columns are ignored; no rows give none. Texts aren't shuffled.
    """
    spark = docs.sparkSession
    chunks = frequent_chunks(docs, text, most)
    words = chunks.select(F.explode(F.expr(f"regexp_extract_all(concat(' ', chunk), {pattern_sql(pattern)}, 0)")).alias("word")).where(f"octet_length(word) <= {AHEAD_BYTES + 1}").distinct()
    folded = fold_words(words.repartition(max(2, spark.sparkContext.defaultParallelism)), load_ranks(path))
    ahead = spark.sparkContext.broadcast({r["word"]: np.asarray(r["ids"], "<u4").tobytes() for r in folded.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, pattern, ahead.id if hasattr(ahead, "id") else id(ahead.value))
        if key not in _kept:
            _kept.clear()
            _kept[key] = Encoder(path, pattern, ahead.value)
        for batch in batches:
            for begin, texts in by_bytes(batch.column(1)):
                counts, ids = _kept[key].column(texts.fill_null(""))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.ListArray.from_arrays(offsets, pa.array(ids.view("<i4")))], names=["doc_id", "token_ids"])

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, token_ids array<int>")


def decode(ids: str, ranks: dict[bytes, int]) -> Column:
    """The bytes of a column of ids: their pieces, from a literal array, concatenated. Null gives null; an unknown id fails."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    return F.expr(f"unhex(array_join(transform({ids}, i -> element_at({_literal(pieces, 'array<string>')}, i + 1)), ''))")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = vocabulary(BYTE_BPE)
    found = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return found.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(decode("token_ids", load_ranks(path)), 256).alias("decoded_sha256"))
