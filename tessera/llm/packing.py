"""Packing: sum-of-squares online packing of documents into windows of at most 2048 tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidied
from .tokens import encoder, vocabulary

WINDOW = 2048
#: Tokens of a level: windows lie in one of WINDOW / GRAIN fill levels, the last of which is full.
GRAIN = 128
#: Partially filled windows that a task holds at most.
MAX_OPEN = 1024
END_ID = 1
#: Rows given back at a time.
OUT_ROWS = 5_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """The packer of one task.

    A piece takes as many levels as `grain` goes into its tokens, rounded up, and levels[h] counts the open windows filled
    to level h. A document's remainder (its full windows are cut off first) goes to the level, or to a new window, that
    makes the sum of squares of levels[1:n_levels] least; ties go to the fullest. A window of the last level is full but
    for what its pieces were rounded by, which is cut from a document kept for that; if there is none, the next remainder becomes it. When more
    than `max_open` are open, the emptiest is cut up to fill the fullest. At the end the same leaves one window at
    most, which is cut at its powers of two, so that nothing is padded. by_rule and by_cut count the windows of both kinds.
    """

    def __init__(self, first_sequence: int, window: int = WINDOW, max_open: int = MAX_OPEN, grain: int = GRAIN):
        self.window, self.max_open, self.grain, self.next_id = window, max_open, grain, first_sequence
        self.n_levels = -(-window // grain)
        self.levels = [0] * (self.n_levels + 1)
        self.open: list[list[tuple[int, list]]] = [[] for _ in self.levels]  # level -> windows (tokens, pieces)
        self.n_open = self.by_rule = self.by_cut = 0
        self.waiting: list[tuple[int, list]] = []  # windows of the last level that aren't full to the token
        self.filler: tuple | None = None
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, at))
            at += len(ids) // 4
        self.next_id += 1

    def add(self, doc, ids: bytes) -> None:
        total, w = len(ids) // 4, self.window
        for at in range(0, total - total % w, w):
            self._close([(doc, at, ids[4 * at : 4 * (at + w)], total)])
        if size := total % w:
            piece = (doc, total - size, ids[4 * (total - size) :], total)
            if self.waiting:
                self.filler = piece
                self._fill()
            else:
                self._place(piece, size)
            if self.n_open > self.max_open:
                self._merge()

    def _place(self, piece: tuple, size: int) -> None:
        n, last = self.levels, self.n_levels
        own = -(-size // self.grain)
        best, least = 0, 2 * n[own] + 1 if own < last else 0
        for h in range(1, last - own + 1):
            if n[h]:
                change = 1 - 2 * n[h] + (2 * n[h + own] + 1 if h + own < last else 0)
                if change <= least:
                    best, least = h, change
        tokens, pieces = self._take(best) if best else (0, [])
        pieces.append(piece)
        self._put(best + own, tokens + size, pieces, True)

    def _take(self, level: int) -> tuple[int, list]:
        self.levels[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _put(self, level: int, tokens: int, pieces: list, by_rule: bool) -> None:
        if by_rule and level == self.n_levels:
            self.by_rule += 1
            self.waiting.append((tokens, pieces))
            self._fill()
        elif tokens == self.window:
            self.by_cut += 1
            self._close(pieces)
        elif pieces:
            self.open[level].append((tokens, pieces))
            self.levels[level] += 1
            self.n_open += 1

    def _fill(self) -> None:
        """Fills waiting windows from the filler, as far as it reaches."""
        while self.waiting:
            tokens, pieces = self.waiting.pop()
            if gap := self.window - tokens:
                if self.filler is None:
                    self.waiting.append((tokens, pieces))
                    return
                doc, start, ids, total = self.filler
                cut, rest = ids[: 4 * gap], ids[4 * gap :]
                self.filler = (doc, start + gap, rest, total) if rest else None
                pieces.append((doc, start, cut, total))
                if len(cut) < 4 * gap:
                    self.waiting.append((tokens + len(cut) // 4, pieces))
                    continue
            self._close(pieces)

    def _merge(self) -> None:
        """Fills the fullest open window with ids cut from the emptiest."""
        used = [h for h, n in enumerate(self.levels) if n]
        target = self._take(used[-1])
        source = self._take(next(h for h in used if self.levels[h]))
        (high, pieces), (low, more) = sorted((target, source), key=lambda x: -x[0])
        while more and high < self.window:
            doc, start, ids, total = more.pop()
            gap = 4 * (self.window - high)
            pieces.append((doc, start, ids[:gap], total))
            high, low = high + len(ids[:gap]) // 4, low - len(ids[:gap]) // 4
            if ids[gap:]:
                more.append((doc, start + gap // 4, ids[gap:], total))
        self._put(-(-high // self.grain), high, pieces, False)
        if more:
            self._put(-(-low // self.grain), low, more, False)

    def finish(self) -> None:
        for tokens, pieces in self.waiting:  # nothing came to fill them
            self._put(-(-tokens // self.grain), tokens, pieces, False)
        self.waiting = []
        if self.filler:
            tokens = len(self.filler[2]) // 4
            self._put(-(-tokens // self.grain), tokens, [self.filler], False)
            self.filler = None
        while self.n_open > 1:
            self._merge()
        if self.n_open:
            tokens, pieces = self._take(next(h for h, n in enumerate(self.levels) if n))
            pieces = pieces[::-1]
            for bit in reversed(range(self.window.bit_length())):
                if tokens & (size := 1 << bit):
                    cut, room = [], size
                    while room:
                        doc, start, ids, total = pieces.pop()
                        cut.append((doc, start, ids[: 4 * room], total))
                        if ids[4 * room :]:
                            pieces.append((doc, start + room, ids[4 * room :], total))
                        room -= len(cut[-1][2]) // 4
                    self._close(cut)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int | None = END_ID, max_open: int = MAX_OPEN, text: str = "text") -> DataFrame:
    """Pieces of all documents of (doc_id, text): which ids of which document lie where in which sequence.

    Each task packs the rows of its own partition, in their order, with no shuffle; a sequence never spans
    tasks, and its id holds the partition's number in the high bits, so a task that runs again gives the
    same rows. A null or empty text is `end_id` alone, and no row if there is none; a null doc_id is kept as
    such; repeated rows and ids are packed each for itself; other columns are ignored; no rows give none.
    """
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        texts, packer = encoder(tokenizer_path).texts, SumOfSquares(TaskContext.get().partitionId() << 36, window, max_open)

        def out() -> pa.RecordBatch:
            rows, packer.done = packer.done, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            docs_ = batch.column(0).to_pylist()
            for i, ids in texts(batch.column(1)):
                packer.add(docs_[i], ids + end)
                if len(packer.done) >= OUT_ROWS:
                    yield out()
        packer.finish()
        if packer.done:
            yield out()

    return docs.select("doc_id", text).mapInArrow(tidied(run), SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pack` of all documents by the word vocabulary; odd rows as there."""
    return pack(table(spark, sf_dir, "documents"), vocabulary())
