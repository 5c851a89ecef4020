"""Ranked merges of many words at once, and kept words, as arithmetic on arrays: what both byte-pair vocabularies share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.iinfo(np.int32).max
#: Words of at most so many first pieces are merged together in a matrix; longer ones one by one.
LONGEST = 48
#: Cells of such a matrix at most.
CELLS = 1 << 19
#: A worker keeps so many distinct chunks, of at most so many bytes, and their ids: about 40 bytes each, 80 MB in all. With one more it begins anew.
KEPT, KEPT_BYTES = 2_000_000, 64
#: Bytes of texts whose ids are held at a time.
GROUP_BYTES = 2 << 20


class Merges:
    """Pairs (left, right) of pieces with their rank, 0 first, and the piece that each rank makes.

    Pieces below `n_first` are those that words begin with; their pairs stand in a dense table, all others in a
    sorted one.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, rank: np.ndarray, n_first: int):
        self.n_first, self.most = n_first, int(max(left.max(), right.max(), made.max(), n_first)) + 1
        key = left.astype(np.int64) * self.most + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = np.append(key[order], np.iinfo(np.int64).max), np.append(rank[order], NONE).astype(np.int32), np.full(int(rank.max()) + 1, -1, np.int32)
        self.made[rank] = made
        self.dense = None
        if n_first <= 1024:
            self.dense = np.full((n_first, n_first), NONE, np.int32)
            both = (left < n_first) & (right < n_first)
            self.dense[left[both], right[both]] = rank[both]
        self.pairs: dict[int, int] | None = None

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, NONE where there is none; pieces below 0 are in none."""
        key = left.astype(np.int64) * self.most + right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def matrix(self, pieces: np.ndarray) -> np.ndarray:
        """Rows of first pieces, -1 after the last, merged: in every row the pair of the lowest rank, the leftmost of equal ones, until it has none."""
        out = np.full(pieces.shape, -1, np.int32)
        rows, now = np.arange(len(pieces)), pieces.astype(np.int32)
        ranks = (self.find if self.dense is None else lambda a, b: self.dense[a, b])(now[:, :-1], now[:, 1:]) if now.shape[1] > 1 else np.zeros((len(now), 0), np.int32)
        ranks[now[:, 1:] < 0] = NONE
        while len(rows) and now.shape[1] > 1:
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            ended = best == NONE
            if ended.any():
                out[rows[ended], : now.shape[1]] = now[ended]
                go = ~ended
                rows, now, ranks, at, best = rows[go], now[go], ranks[go], at[go], best[go]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            now[each, at] = self.made[best]
            column = np.arange(now.shape[1] - 1)
            now = np.take_along_axis(now, column + (column > at[:, None]), 1)
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), 1) if now.shape[1] > 1 else ranks[:, :0]
            for side in (at - 1, at):  # the pairs that the new piece is in
                some = np.flatnonzero((side >= 0) & (side < now.shape[1] - 1))
                ranks[some, side[some]] = self.find(now[some, side[some]], now[some, side[some] + 1])
        if len(rows):
            out[rows, : now.shape[1]] = now
        return out

    def one(self, pieces: list[int]) -> list[int]:
        """The same for one word of any length: a heap of the pairs and links between the pieces left."""
        import heapq

        if self.pairs is None:
            self.pairs = dict(zip(self.keys[:-1].tolist(), self.ranks[:-1].tolist(), strict=True))
        get, most = self.pairs.get, self.most
        n, now = len(pieces), list(pieces)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(now, now[1:], strict=False)) if (r := get(a * most + b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if now[i] != a or j >= n or now[j] != b:
                continue  # one of the two is merged already
            now[i], now[j] = int(self.made[rank]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(now[i] * most + now[k])) is not None:
                    heapq.heappush(heap, (r, i, now[i], now[k]))
            if (h := before[i]) >= 0 and (r := get(now[h] * most + now[i])) is not None:
                heapq.heappush(heap, (r, h, now[h], now[i]))
        return [x for x in now if x >= 0]

    def many(self, words: list[bytes], first: np.ndarray, last: np.ndarray | None = None) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers: first[byte] are the pieces it begins with, last[byte] that of its last byte."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.asarray([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        ends = first if last is None else last
        at = int(np.searchsorted(sizes[order], 1))
        while at < len(words):
            size = int(sizes[order[at]])
            if size > LONGEST:
                w = words[order[at]]
                pieces = [*first[np.frombuffer(w[:-1], np.uint8)].tolist(), int(ends[w[-1]])]
                out[order[at]] = np.asarray(self.one(pieces), "<u4").tobytes()
                at += 1
                continue
            # words of up to a quarter more bytes share a matrix
            wide = min(LONGEST, size + size // 4)
            stop = min(int(np.searchsorted(sizes[order], wide, side="right")), at + max(1, CELLS // wide))
            own = order[at:stop]
            length = sizes[own]
            flat = np.frombuffer(b"".join([words[i] for i in own.tolist()]), np.uint8)
            m = np.full((len(own), int(length.max())), -1, np.int32)
            inside = np.arange(m.shape[1]) < length[:, None]
            m[inside] = first[flat]
            close = np.cumsum(length) - 1
            m[np.arange(len(own)), length - 1] = ends[flat[close]]
            found = self.matrix(m)
            kept = found >= 0
            ids = found[kept].astype("<u4").tobytes()
            stops = np.cumsum(kept.sum(axis=1) * 4).tolist()
            begin = 0
            for i, end in zip(own.tolist(), stops, strict=True):
                out[i] = ids[begin:end]
                begin = end
            at = stop
        return out


def by_bytes(column: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of a string column, some `most` bytes at a time; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, column.slice(at, stop - at)
        at, before = stop, int(ends[stop - 1])


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, places of the bounds in them) of a string column without nulls."""
    _, places, data = strings.buffers()
    if not len(strings) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(strings) + 1, np.int64)
    places = np.frombuffer(places, np.int64 if pa.types.is_large_string(strings.type) else np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


class Kept:
    """Distinct short strings and their ids, found by a hash of 128 bits, a random multiplier for each byte's place."""

    def __init__(self, most: int = KEPT):
        self.most = most
        self.factors = np.random.default_rng(5).integers(0, 1 << 64, (2, KEPT_BYTES), dtype=np.uint64) | np.uint64(1)
        self.clear()

    def clear(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, "<u4")

    def hashes(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, places = raw(strings)
        sizes = np.diff(places)
        at = np.minimum(np.arange(len(data)) - np.repeat(places[:-1], sizes), KEPT_BYTES - 1)
        out = []
        for f in self.factors:
            sums = np.zeros(len(strings), np.uint64)
            some = sizes > 0
            if some.any():
                sums[some] = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * f[at], places[:-1][some])
            sums = (sums ^ (sums >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            out.append(sums ^ (sums >> np.uint64(32)))
        return out[0], out[1]

    def ids(self, strings: pa.Array, fresh: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, begin, size): where in the pool the ids of each of the distinct strings lie; `fresh` encodes those that aren't kept."""
        key, check = self.hashes(strings)
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        hit = (self.key[at] == key) & (self.check[at] == check) if len(self.key) else np.zeros(len(key), bool)
        short = np.diff(raw(strings)[1]) <= KEPT_BYTES
        hit &= short
        begin, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int32)
        begin[hit], size[hit] = self.begin[at[hit]], self.size[at[hit]]
        new = np.flatnonzero(~hit)
        if not len(new):
            return self.pool, begin, size
        found = fresh(strings.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist())
        own = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.concatenate([self.pool, np.frombuffer(b"".join(found), "<u4")])
        begin[new], size[new] = len(self.pool) + np.cumsum(own) - own, own
        if len(self.key) + len(new) > self.most:
            self.clear()
        else:
            keep = new[short[new]]
            keep = keep[np.argsort(key[keep], kind="stable")]
            to = np.searchsorted(self.key, key[keep])
            self.key, self.check = np.insert(self.key, to, key[keep]), np.insert(self.check, to, check[keep])
            self.begin, self.size = np.insert(self.begin, to, begin[keep]), np.insert(self.size, to, size[keep])
            self.pool = pool
        return pool, begin, size


def spread(pool: np.ndarray, begin: np.ndarray, size: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of each text, all ids) of texts whose strings `at[offsets[i] : offsets[i + 1]]` have the ids pool[begin : begin + size]."""
    own = size[at].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(own)])
    ids = pool[np.repeat(begin[at] - ends[:-1], own) + np.arange(ends[-1])]
    return np.diff(ends[offsets]), ids
