"""Documents into segments, as ranges: paragraphs into chunks by their running lengths, chunks into segments likewise."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, MIN_CHARS, OVERLAP = 2000, 800, 200
BLANK = "\n\n"
_TITLE = re.compile(r"#+\s")


class Joined:
    """Texts that are put together with a blank line between them, known by their lengths."""

    def __init__(self, texts: list[str]):
        self.texts, self.ends = texts, [0, *accumulate(len(t) + len(BLANK) for t in texts)]

    def size(self, first: int, stop: int) -> int:
        return self.ends[stop] - self.ends[first] - len(BLANK)

    def reach(self, first: int, most: int) -> int:
        """The last stop by which texts first .. stop - 1 take at most `most` characters; one text at least."""
        return max(first + 1, bisect_right(self.ends, most + len(BLANK) + self.ends[first]) - 1)

    def text(self, first: int, stop: int) -> str:
        return BLANK.join(self.texts[first:stop])


def paragraphs(text: str, separator: str) -> Iterator[list[str]]:
    """The paragraphs of each section: titles part sections and are no text, unless there is nothing else."""
    marked = [(bool(_TITLE.match(line)), line) for line in text.splitlines()]
    bodies = ["\n".join(line for _, line in lines) for is_title, lines in groupby(marked, key=lambda x: x[0]) if not is_title]
    for body in bodies or [text]:
        yield [p for part in re.split(separator, body.strip()) if (p := part.strip())]


def seed(chunk: str, following: str, overlap: int) -> str:
    """What a chunk repeats of the one before: of its last `overlap` characters those after the first blank line in them, filled up to as many from the paragraph that follows."""
    if overlap <= 0:
        return ""
    tail = chunk[len(chunk) - overlap if len(chunk) > overlap else 0 :]
    at = tail.find(BLANK)
    own = tail if at < 0 else tail[at + len(BLANK) :]
    return f"{own}{BLANK}{following}".strip()[:overlap]


def packed(section: list[str], most: int, overlap: int) -> Iterator[str]:
    """Chunks of as many paragraphs as fit; a paragraph longer than `most` isn't split, and the first one after a seed always fits."""
    whole, at, before = Joined(section), 0, ""
    while at < len(section):
        room = most - (len(before) + len(BLANK) if before else 0)
        stop = whole.reach(at, room)
        chunk = BLANK.join(filter(None, (before, whole.text(at, stop))))
        yield chunk
        if stop < len(section):
            before = seed(chunk, section[stop], overlap)
        at = stop


def ranges(chunks: Joined, most: int, least: int) -> list[list[tuple[int, int]]]:
    """The chunks of each segment, as ranges: a short one takes in those after it while they fit.

    If the next one doesn't fit it is taken in all the same, and stands again at the head of the segment after. What is
    left at the end and short goes to the segment before it.
    """
    n, first, out = len(chunks.texts), 0, []
    while first < n:
        long = next((e for e in range(first + 1, n) if chunks.size(first, e) >= least), n)  # stops are kept below n: the last range is what is left
        fits = chunks.reach(first, most)
        if n <= min(long, max(fits, first + 1)):
            if out and chunks.size(first, n) < least:
                out[-1].append((first, n))
            else:
                out.append([(first, n)])
            break
        if long <= fits or long == first + 1:
            out.append([(first, long)])
            first = long
        else:
            out.append([(first, fits + 1)])
            first = fits
    return out


def merged(chunks: list[str], most: int, least: int) -> list[str]:
    whole = Joined(chunks)
    return [BLANK.join(whole.text(*r) for r in parts) for parts in ranges(whole, most, least)]


def chunk_text(text: str | None, most: int = MAX_CHARS, least: int = MIN_CHARS, overlap: int = OVERLAP, separator: str = r"\n\s*\n") -> list[str]:
    """The segments of a text; null and blank ones have none."""
    chunks = [c for section in paragraphs((text or "").replace("\r\n", "\n"), separator) for c in packed(section, most, overlap)]
    return merged(chunks, most, least)


def segments(documents: DataFrame, most: int = MAX_CHARS, least: int = MIN_CHARS, overlap: int = OVERLAP, separator: str = r"\n\s*\n") -> DataFrame:
    """(id, document_id, source_path, position, text) of (id, path, text): each row's segments, with no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f"{d}_{i}", d, p or "", i, c) for d, p, t in zip(batch["id"], batch["path"], batch["text"], strict=True) for i, c in enumerate(chunk_text(t, most, least, overlap, separator))]
            yield pd.DataFrame(rows, columns=["id", "document_id", "source_path", "position", "text"])

    return documents.selectExpr("cast(id as string) id", "path", "text").mapInPandas(run, "id string, document_id string, source_path string, position int, text string")


def tasks(segments: DataFrame) -> DataFrame:
    """(document_id, source_path, segments, n_segments, chars) of each document with segments: what is to be extracted from it, in order."""
    one = F.struct("position", F.col("id").alias("segment_id"), F.length("text").alias("chars"))
    found = segments.groupBy("document_id", "source_path").agg(F.array_sort(F.collect_list(one)).alias("segments"))
    return found.select("document_id", "source_path", "segments", F.size("segments").alias("n_segments"), F.aggregate("segments", F.lit(0).cast("long"), lambda n, x: n + x["chars"]).alias("chars"))
