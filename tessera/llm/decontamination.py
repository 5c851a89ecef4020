"""Benchmark decontamination: an FM-index of each training shard, searched backwards for the benchmark's windows of words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

WINDOW = 10
#: Symbols of a training shard: what one index holds, whatever the number and length of texts.
SHARD = 1 << 19
#: Every so many positions of a shard one suffix position is kept.
SAMPLE = 16
#: Texts of a task that wait for their shard's index, at most.
WAITING = 50_000
#: Bytes of benchmark words that go out to the tasks at a time; more of them are searched for in more passes.
BLOCK_BYTES = 2_000_000
#: Windows of a benchmark item that are one record; a longer item is cut into overlapping pieces with the same windows.
PIECE = 1000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What isn't 0-9, a-z or beyond ASCII becomes a space; A-Z become a-z.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
CONTINUE = bytes(range(0x80, 0xC0))

SPAN = "struct<first:long,last:long,start:long,end:long>"
FOUND = f"n_words long, n_hit long, spans array<{SPAN}>, items array<long>"


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """The positions of keys in the order of their suffixes, by prefix doubling. The last key must be unique."""
    rank, step, n = np.unique(keys, return_inverse=True)[1].astype(np.int64), 1, len(keys)
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        pair = rank * (n + 1) + after
        order = np.argsort(pair, kind="stable")
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(pair[order]) != 0)])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit of the symbols at each level, stably parted by the bit for the next."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels = []
        for b in reversed(range(bits)):
            ones = (sequence >> b) & 1
            self.levels.append((b, int(len(ones) - ones.sum()), np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)))
            sequence = np.concatenate([sequence[ones == 0], sequence[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        low = np.zeros_like(at)
        for b, zeros, ones in self.levels:
            one = (symbol >> b) & 1 == 1
            low, at = (np.where(one, zeros + ones[x], x - ones[x]) for x in (low, at))
        return at - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out = np.zeros_like(at)
        for b, zeros, ones in self.levels:
            one = ones[at + 1] > ones[at]
            out |= one.astype(out.dtype) << b
            at = np.where(one, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Of runs of symbols from 1 on. After each run stands a separator, 0, which no pattern holds; in the order of suffixes each is one of its own."""

    def __init__(self, runs: list[np.ndarray], symbols: int):
        text = np.concatenate([x for r in runs for x in (r, np.zeros(1, r.dtype))]).astype(np.int64)
        ends = np.flatnonzero(text == 0)
        keys = text + len(ends) - 1
        keys[ends] = np.arange(len(ends))
        order = suffix_array(keys)
        last = text[order - 1]  # the text ends with a separator, so that one stands before its begin
        self.ranks = WaveletMatrix(last, max(1, int(symbols).bit_length()))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        kept = (order % SAMPLE == 0) | (last == 0)  # no walk goes back over a separator
        self.rows, self.places = np.flatnonzero(kept), order[kept]

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of rows of each pattern, a row of symbols, by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.below[-1], np.int64)
        for column in patterns.T[::-1]:
            low, high = self.below[column] + self.ranks.rank(column, low), self.below[column] + self.ranks.rank(column, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position in the text of each row's suffix: back to the next sampled one."""
        out, left, back = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(left):
            at = np.minimum(np.searchsorted(self.rows, rows), len(self.rows) - 1)
            there = self.rows[at] == rows
            out[left[there]] = self.places[at[there]] + back
            left, rows, back = left[~there], rows[~there], back + 1
            symbol = self.ranks.symbol(rows)
            rows = self.below[symbol] + self.ranks.rank(symbol, rows)
        return out


@dataclass
class Phrases:
    """The windows of a block of benchmark items: `windows` by their length, and of the i-th of all the items `items[i]`."""

    words: dict[bytes, int]
    windows: dict[int, np.ndarray]
    items: list[list[int]]
    lengths: np.ndarray

    @classmethod
    def of(cls, pieces: list[tuple[int | None, list[str]]]) -> Phrases:
        words: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, piece in pieces:
            ids = np.asarray([words.setdefault(w.encode(), len(words) + 1) for w in piece], np.int32)
            own = by_length.setdefault(min(WINDOW, len(ids)), {})
            for window in map(tuple, sliding_window_view(ids, min(WINDOW, len(ids))).tolist()):
                own.setdefault(window, set()).update(() if item is None else (item,))
        windows = {n: np.asarray(list(own), np.int64) for n, own in sorted(by_length.items())}
        return cls(words, windows, [sorted(x) for n in windows for x in by_length[n].values()], np.repeat(list(windows), [len(w) for w in windows.values()]).astype(np.int64))


def occurrences(runs: list[np.ndarray], phrases: Phrases, shard: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(run, place in it, window) of each occurrence, from one index for each `shard` symbols. Longer runs are cut with an overlap."""
    longest = max(phrases.windows)
    pieces = [(i, at, r[at : at + shard + longest - 1]) for i, r in enumerate(runs) for at in range(0, max(1, len(r) - longest + 1), shard)]
    while pieces:
        sizes = np.cumsum([len(p[2]) + 1 for p in pieces])
        n = max(1, int(np.searchsorted(sizes, shard, "right")))
        own, pieces = pieces[:n], pieces[n:]
        index, first, begins = FMIndex([p[2] for p in own], len(phrases.words)), 0, np.concatenate([[0], sizes[: n - 1]])
        for windows in phrases.windows.values():
            low, high = index.find(windows)
            which = np.repeat(np.arange(len(windows)), high - low)
            places = index.locate(np.arange(len(which)) - np.repeat(np.cumsum(high - low) - high, high - low))
            piece = np.searchsorted(begins, places, "right") - 1
            yield np.asarray([p[0] for p in own])[piece], places - begins[piece] + np.asarray([p[1] for p in own])[piece], which + first
            first += len(windows)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that overlap or touch, as one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ends) - 1]])]


def character_spans(text: bytes, starts: np.ndarray, ends: np.ndarray) -> list[dict[str, int]]:
    """Ranges of words with the code points from their first word's begin to their last word's end."""
    words = [m.span() for m in WORD.finditer(text.translate(TABLE))]
    out, at, points = [], 0, 0
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        bounds = []
        for to in (words[a][0], words[b - 1][1]):
            at, points = to, points + len(text[at:to].translate(None, CONTINUE))
            bounds.append(points)
        out.append({"first": a, "last": b, "start": bounds[0], "end": bounds[1]})
    return out


class Scanner:
    """A task's texts: those that hold enough benchmark words in a row wait until there are enough of them for an index."""

    def __init__(self, phrases: Phrases, key: pa.Field, shard: int):
        self.phrases, self.shard, self.shortest = phrases, shard, min(phrases.windows, default=0)
        self.schema = pa.schema([key, ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")]))), ("items", pa.list_(pa.int64()))])
        self.clear()

    def clear(self) -> None:
        self.keys, self.counts, self.texts, self.runs, self.of, self.starts, self.symbols = [], [], [], [], [], [], 0

    def take(self, keys: list, texts: list[bytes]) -> pa.RecordBatch:
        """Rows of the texts that can't hold a window; the others are kept."""
        get, found = self.phrases.words.get, []
        for t in texts:
            words = t.translate(TABLE).split()
            found.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        # all texts in a row, a zero before and after each; what lies between zeros is a run of benchmark words
        line = np.concatenate([x for f in found for x in (np.zeros(1, np.int32), f)] + [np.zeros(1, np.int32)])
        begins = np.cumsum([0, *[len(f) + 1 for f in found]]) + 1
        zeros = np.flatnonzero(line == 0)
        long = np.flatnonzero(np.diff(zeros) > self.shortest) if self.shortest else zeros[:0]
        waiting: dict[int, int] = {}
        for a, b in zip((zeros[long] + 1).tolist(), zeros[long + 1].tolist(), strict=True):
            i = int(np.searchsorted(begins, a, "right")) - 1
            if i not in waiting:
                waiting[i] = len(self.keys)
                self.keys.append(keys[i])
                self.counts.append(len(found[i]))
                self.texts.append(texts[i])
            self.runs.append(line[a:b].copy())
            self.of.append(waiting[i])
            self.starts.append(a - int(begins[i]))
            self.symbols += b - a + 1
        rest = [i for i in range(len(keys)) if i not in waiting]
        return self.rows([keys[i] for i in rest], [len(found[i]) for i in rest], {}, {})

    def rows(self, keys: list, counts: list[int], spans: dict, items: dict) -> pa.RecordBatch:
        own = [spans.get(i, []) for i in range(len(keys))]
        columns = [keys, counts, [sum(s["last"] - s["first"] for s in x) for x in own], own, [items.get(i, []) for i in range(len(keys))]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)

    def searched(self) -> pa.RecordBatch:
        """Rows of the texts that waited."""
        base, of, starts = np.cumsum([0, *[n + 1 for n in self.counts]]), np.asarray(self.of, np.int64), np.asarray(self.starts, np.int64)
        begins, windows = [], []
        for run, place, window in occurrences(self.runs, self.phrases, self.shard) if self.runs else ():
            begins.append(base[of[run]] + starts[run] + place)
            windows.append(window)
        spans, items = {}, {}
        if sum(map(len, begins)):
            begin, window = np.concatenate(begins), np.concatenate(windows)
            low, high = merged(begin, begin + self.phrases.lengths[window])
            doc = np.searchsorted(base, low, "right") - 1
            cut = np.flatnonzero(np.diff(doc, prepend=-1))
            for i, a, b in zip(doc[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(doc)], strict=True):
                spans[i] = character_spans(self.texts[i], low[a:b] - base[i], high[a:b] - base[i])
            n = len(self.phrases.items)
            for pair in np.unique((np.searchsorted(base, begin, "right") - 1) * n + window).tolist():
                items.setdefault(pair // n, set()).update(self.phrases.items[pair % n])
        out = self.rows(self.keys, self.counts, spans, {i: sorted(x) for i, x in items.items()})
        self.clear()
        return out


def scanned(docs: DataFrame, phrases: Phrases, key: str, text: str, shard: int) -> DataFrame:
    """(key, n_words, n_hit, spans, items) of every row of docs for one block of phrases."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)  # at most BLOCK_BYTES of words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = None
        for batch in batches:
            scanner = scanner or Scanner(sent.value, batch.schema.field(0), shard)
            yield scanner.take(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if scanner.symbols >= shard or len(scanner.keys) >= WAITING:
                yield scanner.searched()
        if scanner and scanner.keys:
            yield scanner.searched()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_dc_text")).mapInArrow(run, f"`{key}` {kind}, {FOUND}")


def pieces(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """(item, words, bytes): the words of each item that has some, cut into pieces with an overlap so that each window is in one."""
    words = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    rows = benchmark.select(F.col(item).cast("long").alias("item"), words.alias("w")).where("size(w) > 0")
    cut = F.expr(f"transform(sequence(0, greatest(size(w) - {WINDOW}, 0), {PIECE}), i -> slice(w, i + 1, {PIECE + WINDOW - 1}))")
    return rows.select("item", F.explode(cut).alias("words")).withColumn("bytes", F.octet_length(F.array_join("words", " ")))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", shard: int = SHARD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) of every row of docs.

    spans: the merged ranges to remove, as words [first, last) and as code points [start, end) of the text; n_hit counts
    their words; items: the sorted distinct item_ids with a window that occurs. A window is WINDOW consecutive words of an item, or
    all words of one with fewer. Only words of the benchmark can be in a window, so a shard's index holds the runs of such
    words that are long enough, and separators. The benchmark is searched for in blocks of at most about `block_bytes`, a pass each.
    Null and empty texts have no words. Items that share an item_id count once; windows of an item without an
    id hit words, but it is in no list. Rows that share a doc_id each have their own row. Other columns are ignored.
    """
    cut = written(pieces(benchmark, item_id, text))
    total = cut.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    part = F.pmod(F.xxhash64("item", "words"), F.lit(blocks))
    phrases = lambda b: Phrases.of([(r["item"], r["words"]) for r in cut.where(part == b).collect()])
    if blocks == 1:
        return scanned(docs, phrases(0), doc_id, text, shard)
    keyed = written(docs.select(F.monotonically_increasing_id().alias("_dc_row"), doc_id, text))
    found = reduce(DataFrame.union, [scanned(keyed, phrases(b), "_dc_row", text, shard) for b in range(blocks)])
    spans = F.aggregate(F.array_sort(F.flatten(F.collect_list("spans"))), F.array().cast(f"array<{SPAN}>"), joined)
    whole = found.groupBy("_dc_row").agg(F.max("n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return keyed.select("_dc_row", doc_id).join(whole, "_dc_row").select(doc_id, "n_words", n_hit.alias("n_hit"), "spans", "items")


def joined(spans: Column, s: Column) -> Column:
    """Sorted spans and one more, which the last takes in if it overlaps or touches."""
    last = F.element_at(spans, -1)
    more = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
    return F.when((F.size(spans) > 0) & (s["first"] <= F.try_element_at(spans, F.lit(-1))["last"]), F.concat(F.slice(spans, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(spans, F.array(s)))


def without(text: str | Column, spans: str | Column) -> Column:
    """The text without the code points of its spans."""
    return F.aggregate(F.reverse(spans), text if isinstance(text, Column) else F.col(text), lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"].cast("int")), F.substring(t, (s["end"] + 1).cast("int"), F.length(t))))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP13_SQL = r"""
with iw as (
  select item_id, w, len(w) as n
  from (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark) where len(w) > 0),
win as (
  select distinct item_id, least(n, 10) as k, array_to_string(w[i:i + least(n, 10) - 1], ' ') as g
  from (select *, unnest(range(1, greatest(n - 10, 0) + 2)) as i from iw)),
dw as (
  select doc_id, w, len(w) as n
  from (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents)),
dg as (
  select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g
  from (select doc_id, w, k, unnest(range(1, greatest(n - k + 2, 1))) as i from dw, (select distinct k from win))),
hit as (select doc_id, i, dg.k as k, item_id from dg join win on dg.k = win.k and dg.g = win.g),
spot as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as names from (select distinct doc_id, item_id::varchar as s from hit where item_id is not null) group by doc_id)
select dw.doc_id as doc_id, n::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join spot on dw.doc_id = spot.doc_id left join it on dw.doc_id = it.doc_id
"""
