"""Line dedup: runs of words that stand earlier, met by content-defined anchors, are removed after byte comparison."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import table, tidied, written

#: Every run of so many words that stands earlier is cut, with what its neighbours add to it; shorter ones repeat by chance.
MIN_WORDS = 25
#: Words of an anchor. In each window of MIN_WORDS words the anchor of the smallest hash is taken, so that equal windows
#: hold an equal anchor, wherever they stand.
ANCHOR = 10
#: Occurrences of an anchor from which on they are dealt out, and anchors at most for which that is done, the most frequent ones.
HOT_ROWS, HOT_CHUNKS = 1_000, 50_000
#: Bits of the filter that says which hashes may repeat: what goes to every worker, whatever the input. A hash that isn't
#: in it stands once; a false hit makes more rows to compare and changes no result.
FILTER_BITS = 1 << 27
#: Bits of the filter in a row.
PAGE = 1 << 15
#: Bytes of a text worked on at a time.
SLICE = 1 << 20
SPACE = b" \t\n\r\x0b\x0c"
#: A word: a CJK character (U+3000 to U+9FFF), or other bytes without white space.
WORD = re.compile(rb"[\xe3-\xe9]..|[^\s\xe3-\xe9]+", re.DOTALL)
_BASE = 0x9E3779B97F4A7C15
# 1: line break, 2: mark, 4: blank, 8: other white space
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("\n")] = 1
_CLASS[list(b".!?,;:")] = 2
_CLASS[list(b" \t")] = 4
_CLASS[list(b"\r\x0b\x0c")] = 8
# 0: white space, 1: part of a word, 3: the same and the first byte of a wide character
_SOLID = bytes((_CLASS[i] & 13 == 0) * (3 if 0xE3 <= i <= 0xE9 else 1) for i in range(256))
#: The low bytes of 8 that a word of so many has.
_LOW = np.asarray([(1 << 8 * min(n, 8)) - 1 for n in range(17)], "<u8")


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, "<u8")
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _ranges(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each range of values that depends on its values alone, from the differences of one running sum."""
    size = 1 << max(10, int(len(values)).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(values) + 1, "<u8")
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return _mix((sums[stops] - sums[starts]) * inverse[starts])


def _lines(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, np.uint8)
    kind = _CLASS[b]
    after = kind == 1
    after[:-1] |= (kind[:-1] == 2) & (kind[1:] == 4)
    cuts = np.flatnonzero(after) + 1
    begins, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(b)]])
    solid = np.flatnonzero(kind & 13 == 0)
    first, last = np.searchsorted(solid, begins), np.searchsorted(solid, stops)
    some = first < last
    starts, ends = solid[first[some]], solid[last[some] - 1] + 1
    return starts, ends, _ranges(b.astype("<u8") + np.uint64(1), starts, ends)


def lines(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the lines of UTF-8 bytes without white space around them; empty ones are left out.

    A line ends at a line break, or after a mark before a blank: prose often has no line breaks.
    """
    found, at = [], 0
    while at < len(raw):
        size = SLICE
        stop = len(raw)
        while at + size < len(raw):  # slices end where lines do
            stop = max(raw.rfind(b"\n", at, at + size), raw.rfind(b". ", at, at + size)) + 1
            if stop > at:
                break
            size *= 2
            stop = len(raw)
        s, e, h = _lines(raw[at:stop])
        found.append((s + at, e + at, h))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, "<u8"))


def _bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = np.frombuffer(raw.translate(_SOLID), np.uint8)
    solid = kind > 0
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    wide = kind == 3
    if wide.any():
        b = np.frombuffer(raw, np.uint8)
        begin |= wide
        begin[3:] |= wide[:-3] & solid[3:] & (b[3:] & 0xC0 != 0x80)
    final = solid.copy()
    final[:-1] &= ~solid[1:] | begin[1:]
    return np.flatnonzero(begin), np.flatnonzero(final) + 1


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = _bounds(raw)
    if not len(starts):
        return starts, ends, np.zeros(0, "<u8")
    size = ends - starts
    eight = np.ascontiguousarray(np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,)))  # the 8 bytes from each place on
    # up to 16 bytes are known by the first 8, the last 8 and their number
    tail = np.where(size > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0))
    h = _mix((eight[starts] & _LOW[np.minimum(size, 16)]) * np.uint64(_BASE) + tail * np.uint64(0xC2B2AE3D27D4EB4F) + size.astype("<u8"))
    if len(long := np.flatnonzero(size > 16)):
        to = np.cumsum(size[long])
        own = np.frombuffer(raw, np.uint8)[np.arange(to[-1]) + np.repeat(starts[long] - to + size[long], size[long])]
        h[long] = _ranges(own.astype("<u8") + np.uint64(1), to - size[long], to)
    return starts, ends, h


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of UTF-8 bytes."""
    found, at = [], 0
    while at < len(raw):
        size = SLICE
        stop = len(raw)
        while at + size < len(raw):  # slices end where words do
            stop = max(raw.rfind(b"\n", at, at + size), raw.rfind(b" ", at, at + size)) + 1
            if stop > at:
                break
            size *= 2
            stop = len(raw)
        s, e, h = _words(raw[at:stop])
        found.append((s + at, e + at, h))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, "<u8"))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each `width` values that follow each other, the first of equal ones."""
    at, step = np.arange(len(h)), 1

    def better(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(h[y] < h[x], y, x)

    while 2 * step <= width:
        at = better(at[:-step], at[step:])
        step *= 2
    return better(at[: len(at) - (width - step)], at[width - step :]) if width > step else at


def chunks(texts: list[bytes]) -> list[list[tuple[np.ndarray, ...]]]:
    """For each text: (hashes, lows, highs) of its anchors and (starts, ends) of its words.

    Anchors are runs of ANCHOR words; a window of MIN_WORDS words belongs to the one in it with the smallest hash. The
    windows of an anchor begin with the words low .. high - MIN_WORDS, so each window is in one anchor's words only.
    Texts are put together for the arithmetic; words end where texts do.
    """
    starts, ends, hashes = words(b"\n".join(texts))
    sizes = np.asarray([len(t) + 1 for t in texts])
    offsets = np.cumsum(sizes) - sizes
    of_text = np.searchsorted(starts, [*offsets, offsets[-1] + sizes[-1]])  # a text's first word, and the end
    low = high = np.zeros(0, np.int64)
    h = np.zeros(0, "<u8")
    if len(starts) >= MIN_WORDS:
        first = np.arange(len(starts) - ANCHOR + 1)
        h = _ranges(hashes, first, first + ANCHOR)
        anchor = _least(h, MIN_WORDS - ANCHOR + 1)
        last = np.repeat(of_text[1:], np.diff(of_text))[: len(anchor)]
        windows = np.flatnonzero(np.arange(len(anchor)) + MIN_WORDS <= last)  # the others go on in the next text
        if len(windows):
            change = np.flatnonzero(np.diff(anchor[windows])) + 1
            low, high = windows[np.concatenate([[0], change])], windows[np.concatenate([change - 1, [-1]])] + MIN_WORDS
            h = h[anchor[low]]
    parts = np.searchsorted(low, of_text)
    out: list[list] = []
    for at, a, b, c, d in zip(offsets.tolist(), of_text.tolist(), of_text[1:].tolist(), parts.tolist(), parts[1:].tolist(), strict=False):
        out.append([(h[c:d].view("<i8"), low[c:d] - a, high[c:d] - a), (starts[a:b] - at, ends[a:b] - at)])
    return out


def windows(texts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
    """Where the windows of MIN_WORDS words begin and end in each text."""
    if not texts:
        return [], []
    starts, ends = _bounds(b"\n".join(texts))
    sizes = np.asarray([len(t) + 1 for t in texts])
    offsets = np.cumsum(sizes) - sizes
    of_text = np.searchsorted(starts, [*offsets, offsets[-1] + sizes[-1]])
    move = np.repeat(offsets, np.diff(of_text))
    low, high, bounds = (starts - move).tolist(), (ends - move).tolist(), of_text.tolist()
    more = MIN_WORDS - 1
    return [low[a : max(a, b - more)] for a, b in zip(bounds, bounds[1:], strict=False)], [high[min(a + more, b) : b] for a, b in zip(bounds, bounds[1:], strict=False)]


def groups(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows (doc, th, text) of a batch, some MB of texts at a time, and the texts' bytes."""
    held, begin, total = [], 0, 0
    for i in range(batch.num_rows):
        held.append(batch.column(2)[i].as_py().encode("utf-8", "surrogatepass"))
        total += len(held[-1])
        if total >= size or i + 1 == batch.num_rows:
            yield batch.slice(begin, i + 1 - begin), held
            held, begin, total = [], i + 1, 0


def shared_runs(texts: list[bytes], group: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, a, b, row of the first, a there) of the runs of windows that stand in an earlier text of the same group, as far as each goes on in the same one, and the groups this can't tell.

    Windows meet by a hash of their words, and each run's bytes are compared. A group can't be told where those
    differ, where hashes of two groups are equal, or where a text repeats a window of its own.
    """
    raw = b"\n".join(texts)
    starts, ends, hashes = words(raw)
    sizes = np.asarray([len(t) + 1 for t in texts])
    offsets = np.cumsum(sizes) - sizes
    of_text = np.searchsorted(starts, [*offsets, offsets[-1] + sizes[-1]])
    n_words = np.diff(of_text)
    word = np.flatnonzero(np.arange(MIN_WORDS, len(starts) + MIN_WORDS) <= np.repeat(of_text[1:], n_words))  # where windows begin
    row = np.repeat(np.arange(len(texts)), n_words)[word]
    keys = _mix(_ranges(hashes, word, word + MIN_WORDS) ^ (group[row].astype("<u8") * np.uint64(_BASE)))
    _, at, which = np.unique(keys, return_index=True, return_inverse=True)
    first = at[which]
    again = np.flatnonzero(first != np.arange(len(word)))
    was = first[again]
    unsure = group[row[again][(group[row[was]] != group[row[again]]) | (row[was] == row[again])]]
    if not len(again):
        return (again,) * 5 + (unsure,)
    breaks = np.flatnonzero((np.diff(word[again]) != 1) | (np.diff(word[was]) != 1))
    begin, last = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(again) - 1]])
    a, b, a0 = starts[word[again[begin]]], ends[word[again[last]] + MIN_WORDS - 1], starts[word[was[begin]]]
    row, row0 = row[again[begin]], row[was[begin]]
    same = np.asarray([raw[x:y] == raw[z : z + y - x] for x, y, z in zip(a.tolist(), b.tolist(), a0.tolist(), strict=True)])
    return row, a - offsets[row], b - offsets[row], row0, a0 - offsets[row0], np.unique(np.concatenate([unsure, group[row[~same]]]))


class Windows:
    """The windows of MIN_WORDS words met so far, by key, with the place of the first; what is given next comes later in the order of (doc, th, a)."""

    def __init__(self, origins: bool) -> None:
        self.origins = origins  # spans of different origins stay apart
        self.whole: dict[bytes, tuple] = {}
        self.first: dict[bytes, tuple] = {}
        self.held: tuple | None = None

    def spans(self, doc: int, th: int, size: int, a: int, text: bytes, lows: list[int], highs: list[int], local: bool = True) -> tuple[list[tuple], list[tuple]]:
        """The spans (a, b) of text, which begins at byte a of a document, that stand earlier, with (doc, th, size, a) of where; and (window, place) of those that are new. lows, highs: where its windows lie in it."""
        own = (doc, th, size, a)
        was = self.whole.setdefault(text, own)
        if was[:2] != own[:2]:
            return [(a, a + len(text), *was)], []
        if not local and was is own and len(self.whole) == 1 and not repeats_itself(text):
            self.held = (*own, text, lows, highs)  # its windows matter only if a text comes that isn't the same
            return [], []
        if self.held:
            held, self.held = self.held, None
            self._windows(*held)
        return self._windows(*own, text, lows, highs)

    def _windows(self, doc: int, th: int, size: int, a: int, text: bytes, lows: list[int], highs: list[int]) -> tuple[list[tuple], list[tuple]]:
        spans: list[list] = []
        new = []
        seen = self.first.setdefault
        for low, high in zip(lows, highs, strict=True):
            key, here = text[low:high], (doc, th, size, a + low)
            was = seen(key, here)
            if was is here:
                new.append((key, here))
            elif span := later(*here, a + high, was):
                if spans and span[0] <= spans[-1][1] and (not self.origins or spans[-1][2:5] == span[2:5] and spans[-1][0] - spans[-1][5] == span[0] - span[5]):
                    spans[-1][1] = max(spans[-1][1], span[1])
                else:
                    spans.append(list(span))
        return [tuple(x) for x in spans], new


def repeats_itself(text: bytes) -> bool:
    """Whether two windows of a text of one anchor may be the same. The anchor is in both, so they are at most MIN_WORDS - ANCHOR words apart and hold no more distinct words than that."""
    found = text.split()
    return max(text) >= 0xE3 or len(found) < MIN_WORDS or len(set(found)) <= len(found) - ANCHOR


def later(doc: int, th: int, size: int, a: int, b: int, was: tuple) -> tuple | None:
    """(a, b, doc, th, size, a of the first) of an occurrence as far as it lies after the first; None if it is the first or inside it."""
    if was[:2] == (doc, th):
        low = max(a, was[3] + b - a)
        return (low, b, *was[:3], was[3] + low - a) if low < b and a != was[3] else None
    return (a, b, *was)


def copied(spans: list[tuple], doc: int, th: int, size: int, share: float) -> bool:
    """Whether a document of size bytes is a copy of one other document: all spans (a, b, doc, th, size, a there) come from that, and make up `share` of both texts."""

    def covered(ranges: list[tuple[int, int]]) -> int:
        total = end = 0
        for a, b in sorted(ranges):
            total += max(0, b - max(a, end))
            end = max(end, b)
        return total

    origin = {x[2:5] for x in spans}
    if len(origin) != 1:
        return False
    ((other, its_th, its_size),) = origin
    here, there = covered([x[:2] for x in spans]), covered([(x[5], x[5] + x[1] - x[0]) for x in spans])
    return (other, its_th) != (doc, th) and here >= share * size and there >= share * its_size


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans of its UTF-8 bytes, each with the white space after it; and the spans as cut, in code points."""
    raw = text.encode("utf-8", "surrogatepass")
    joined: list[list[int]] = []
    for a, b in sorted(spans):
        while b < len(raw) and raw[b] in SPACE:
            b += 1
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    out, away, at, place = [], [], 0, 0
    for a, b in joined:
        kept, gone = raw[at:a].decode("utf-8", "surrogatepass"), raw[a:b].decode("utf-8", "surrogatepass")
        out.append(kept)
        place += len(kept)
        away.append((place, place + len(gone)))
        place, at = place + len(gone), b
    return "".join(out) + raw[at:].decode("utf-8", "surrogatepass"), away


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


OCCURRENCE = "h long, salt int, doc long, th int, size int, a int, bytes binary, local boolean"
#: A span that stands earlier, and where; or a window, by its digest (d, e), that is the first of its part.
FOUND = "d long, e long, doc long, th int, size int, a int, b int, doc0 long, th0 int, size0 int, a0 int, again boolean"


def same_texts(batch: pa.RecordBatch, h: np.ndarray, salt: np.ndarray, doc: np.ndarray, th: np.ndarray, own: bool) -> tuple[np.ndarray, ...]:
    """(each row's group (h, salt), first row of the same text in it, whether the row stands earlier whole, whether nothing of its group is to be met by others, whether `shared_runs` may have it).

    A row stands earlier whole where the first row of its text is in another document or, with `own`, lies before it in the same
    one. The first group may have begun in a batch before, so its rows are each their own first; the last may go on. Nothing else
    is to be met in groups that lie in the batch, are not hot, and are one text that doesn't repeat itself, but for rows that stand
    earlier whole; `shared_runs` may have those that lie in the batch, are not hot, and hold each document once but for such rows.
    """
    n = len(h)
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])])
    begins = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    text = batch.column(6).dictionary_encode().indices.to_numpy().astype(np.int64)
    _, at, which = np.unique(of * n + text, return_index=True, return_inverse=True)
    first = at[which]
    first[of == 0] = np.flatnonzero(of == 0)
    whole = (doc != doc[first]) | (th != th[first])
    if own:
        a, length = batch.column(5).to_numpy(), pc.binary_length(batch.column(6)).to_numpy()
        whole |= (first < np.arange(n)) & (a >= a[first] + length)
    rest = np.flatnonzero(~whole)
    twice = rest[1:][(of[rest[1:]] == of[rest[:-1]]) & (doc[rest[1:]] == doc[rest[:-1]]) & (th[rest[1:]] == th[rest[:-1]])]
    once = (np.bincount(of, batch.column(7).to_numpy(zero_copy_only=False), len(begins)) == 0) & (np.bincount(of[twice], minlength=len(begins)) == 0)
    once[[0, -1]] = False
    alike = once & (np.bincount(of[rest], minlength=len(begins)) == 1)
    many = np.diff(np.concatenate([begins, [n]])) > 1
    texts = batch.column(6).take(pa.array(begins[alike & many])).to_pylist()
    alike[np.flatnonzero(alike & many)] = [not repeats_itself(t) for t in texts]
    return of, first, whole, alike[of], once[of]


def repeated(rows: DataFrame) -> tuple[bytes, dict[int, int]]:
    """What a worker must know of the anchors of (doc, th, text): the filter of hashes that repeat, and the hot ones' numbers of salts.

    Both have a fixed greatest size. Counts are partially aggregated, so a hot anchor is a row a task.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for _, texts in groups(whole):
                found = np.concatenate([hashes for (hashes, _, _), _ in chunks(texts)])
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found)], names=["h"])

    counts = rows.mapInArrow(tidied(find, 8), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = written(counts)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            bit = np.sort(batch.column(0).to_numpy() % FILTER_BITS)
            pages, starts = np.unique(bit // PAGE, return_index=True)
            for page, own in zip(pages.tolist(), np.split(bit % PAGE, starts[1:]), strict=True):
                np.bitwise_or.at(held.setdefault(page, np.zeros(PAGE // 32, "<u4")), own >> 5, np.uint32(1) << (own & 31).astype("<u4"))
        if held:
            yield _batch([(page, x.tobytes()) for page, x in held.items()], "page long, bits binary")

    table_ = bytearray(max(FILTER_BITS, PAGE) // 8)
    by_page = counts.select("h").repartition(F.floor(F.pmod("h", F.lit(FILTER_BITS)) / PAGE))
    for r in by_page.mapInArrow(tidied(fill), "page long, bits binary").toLocalIterator():
        table_[r["page"] * PAGE // 8 : (r["page"] + 1) * PAGE // 8] = r["bits"]
    hot = counts.where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), "h").limit(HOT_CHUNKS).collect()
    return bytes(table_), {r["h"]: 1 + r["n"] // HOT_ROWS for r in hot}


def dedup(docs: DataFrame, copy_share: float | None = None, text: str = "text") -> DataFrame:
    """docs with every run of MIN_WORDS words or more that stands earlier by (doc_id, place) cut out of its text, whole.

    Adds _ld_spans, array of (a, b), what was cut, in code points. Every cut is byte for byte in a document before, or
    earlier in the same one. Null, empty and short texts stay; so do rows with a null doc_id, which count for
    nothing; rows of the same doc_id and text are one document; ties are broken by the text's hash; columns of docs
    beginning with `_ld_` are refused; no rows give none. With copy_share, texts that are copies of one other
    document (`copied`) stay whole, for the removal of whole documents to judge.

    Texts are read twice where they are, first for the hashes of their anchors, then for the anchors that may repeat,
    each with the words of its windows. Those meet by hash, in the order of (doc_id, place), and the
    windows' bytes are compared as a stream, each with all before it; the occurrences of a hot anchor are dealt
    out, and the first windows of each part meet again by a digest of 128 bits. What is to be cut goes to the texts,
    which are dealt out once, by doc_id.
    """
    if clash := [c for c in docs.columns if c.startswith("_ld_")]:
        raise ValueError(f"columns {clash} are in the way")
    spark = docs.sparkSession
    columns = docs.columns
    at = columns.index(text)
    keyed = docs.withColumn("_ld_doc", F.col("doc_id").cast("long")).withColumn("_ld_th", F.hash(text))
    rows = keyed.where(F.col("_ld_doc").isNotNull() & F.col(text).isNotNull()).select("_ld_doc", "_ld_th", text)
    known = spark.sparkContext.broadcast(repeated(rows))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hot = known.value
        filter_ = np.frombuffer(bits, "<u4")
        hot_keys = np.asarray(sorted(hot), np.int64)
        hot_salts = np.asarray([hot[h] for h in hot_keys.tolist()], np.int32)
        for whole in batches:
            for part, texts in groups(whole):
                keys, begins, own, of_row = [], [], [], []
                for i, (raw, ((hashes, lows, highs), (starts, ends))) in enumerate(zip(texts, chunks(texts), strict=True)):
                    bit = hashes % FILTER_BITS
                    may = (filter_[bit >> 5] >> (bit & 31).astype("<u4") & 1).astype(bool)
                    low, high = starts[lows[may]], ends[highs[may] - 1]
                    keys.append(hashes[may])
                    begins.append(low)
                    own += [raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                    of_row.append(np.full(len(low), i))
                if own:
                    h, row = np.concatenate(keys), np.concatenate(of_row)
                    doc, th = (part.column(i).to_numpy()[row] for i in (0, 1))
                    salts = np.ones(len(h), np.int32)
                    if len(hot_keys):
                        at = np.minimum(np.searchsorted(hot_keys, h), len(hot_keys) - 1)
                        salts = np.where(hot_keys[at] == h, hot_salts[at], salts)
                    size = np.asarray([len(x) for x in texts], np.int32)[row]
                    columns = [h, ((doc ^ th) % salts).astype(np.int32), doc, th, size, np.concatenate(begins).astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(own, pa.binary()), pa.array(salts > 1)], names=[x.split()[0] for x in OCCURRENCE.split(", ")])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of (h, salt, doc, th, a): the spans that stand earlier in the part, and of hot anchors the part's first windows."""
        key = met = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, salt, doc, th, size, a = (batch.column(i).to_numpy() for i in range(6))
            of, first, earlier, alike, once = same_texts(batch, h, salt, doc, th, copy_share is None)
            rows = np.flatnonzero(earlier)
            length = pc.binary_length(batch.column(6)).to_numpy()[rows]
            found = [(rows, a[rows], a[rows] + length, first[rows], a[first[rows]])]  # what stands earlier whole
            others = ~alike & ~earlier
            at = np.flatnonzero(others & once)
            if len(at):
                row, low, high, row0, low0, unsure = shared_runs(batch.column(6).take(pa.array(at)).to_pylist(), of[at])
                sure = ~np.isin(of, unsure)
                row, row0 = at[row], at[row0]
                found.append(tuple(x[sure[row]] for x in (row, a[row] + low, a[row] + high, row0, a[row0] + low0)))
                others &= ~(once & sure)
            rows, low, high, rows0, low0 = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(rows):
                zero = np.zeros(len(rows), np.int64)
                columns = [zero, zero, doc[rows], th[rows], size[rows], low.astype(np.int32), high.astype(np.int32), doc[rows0], th[rows0], size[rows0], low0.astype(np.int32), np.zeros(len(rows), bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in FOUND.split(", ")])
            out = []
            others = np.flatnonzero(others)
            part = batch.take(pa.array(others))
            columns = [*(part.column(i).to_numpy().tolist() for i in range(6)), part.column(6).to_pylist(), part.column(7).to_numpy(zero_copy_only=False).tolist()]
            for h_, salt_, doc_, th_, size_, a_, own, local, lows, highs in zip(*columns, *windows(columns[6]), strict=True):
                if key != (h_, salt_):
                    key, met = (h_, salt_), Windows(copy_share is not None)
                spans, new = met.spans(doc_, th_, size_, a_, own, lows, highs, local)
                out += [(0, 0, doc_, th_, size_, *x, False) for x in spans]
                for window, place in new if local else ():
                    d, e = np.frombuffer(hashlib.blake2b(window, digest_size=16).digest(), "<i8").tolist()
                    out.append((d, e, *place, place[3] + len(window), 0, 0, 0, 0, True))
                if len(out) >= 20_000:
                    yield _batch(out, FOUND)
                    out = []
            if out:
                yield _batch(out, FOUND)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of (d, e, doc, th, a): all but the first window of each digest."""
        key = was = None
        for batch in batches:
            out = []
            for d, e, doc, th, size, a, b in zip(*(c.to_pylist() for c in batch.columns[:7]), strict=True):
                if key != (d, e):
                    key, was = (d, e), (doc, th, size, a)
                elif span := later(doc, th, size, a, b, was):
                    out.append((0, 0, doc, th, size, *span, False))
            if out:
                yield _batch(out, FOUND)

    place = ["doc", "th", "a"]
    first = rows.mapInArrow(tidied(occurrences, 8), OCCURRENCE).repartition("h", "salt").sortWithinPartitions("h", "salt", *place).mapInArrow(tidied(compare), FOUND)
    first = written(first)
    again = first.where("again").repartition("d", "e").sortWithinPartitions("d", "e", *place).mapInArrow(tidied(firsts), FOUND)
    found = first.where("not again").union(again)
    spans = found.groupBy("doc", "th").agg(F.collect_set(F.struct("a", "b", *(() if copy_share is None else ("doc0", "th0", "size0", "a0")))).alias("_ld_found"))
    spans = spans.select(F.col("doc").alias("_ld_d"), F.col("th").alias("_ld_t"), "_ld_found")
    marked = keyed.join(spans, (F.col("_ld_doc") == F.col("_ld_d")) & (F.col("_ld_th") == F.col("_ld_t")), "left").select(*docs.columns, "_ld_found", "_ld_doc", "_ld_th")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                part = whole.slice(lo, 500)
                texts, lists = part.column(at), part.column(len(columns))
                new, gone = [], []
                cuts = pc.greater(pc.fill_null(pc.list_value_length(lists), 0), 0)  # the others stay as they are
                for t, found, doc, th in zip(*(x.filter(cuts).to_pylist() for x in (texts, lists, *part.columns[len(columns) + 1 :])), strict=True):
                    spans, away = [tuple(x.values()) for x in found], []
                    if not (copy_share is not None and copied(spans, doc, th, len(t.encode("utf-8", "surrogatepass")), copy_share)):
                        t, away = cut(t, [x[:2] for x in spans])
                    new.append(t)
                    gone.append([{"a": a, "b": b} for a, b in away])
                kept, kind = list(part.columns[: len(columns)]), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
                kept[at] = pc.replace_with_mask(texts, cuts, pa.array(new, texts.type))
                which = np.where(cuts.to_numpy(zero_copy_only=False), np.cumsum(cuts.to_numpy(zero_copy_only=False)), 0)
                yield pa.RecordBatch.from_arrays([*kept, pa.array([[], *gone], kind).take(pa.array(which))], names=[*columns, "_ld_spans"])

    span = StructType().add("a", "integer").add("b", "integer")
    schema = StructType([*docs.schema.fields]).add("_ld_spans", ArrayType(span))
    return marked.mapInArrow(tidied(remove), schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = dedup(docs)
    removed = F.expr("aggregate(_ld_spans, 0L, (s, x) -> s + x.b - x.a)")
    spans = F.array_join(F.transform("_ld_spans", lambda x: F.concat_ws(":", x["a"].cast("string"), x["b"].cast("string"))), ",")
    return found.select("doc_id", F.size("_ld_spans").cast("long").alias("n_removed"), removed.alias("removed_chars"), spans.alias("spans"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
