"""Document fingerprints: threshold-scaled sketches of character shingles, and their containment."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket, n_parts, splits, table

#: Code points of a shingle; a shorter text that isn't empty is one shingle.
SHINGLE = 16
#: A shingle's 32-bit hash is kept if it is below 2**32 / SCALE.
SCALE = 16
#: Shingles hashed at a time, which bounds memory for very long texts.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15


@functools.cache
def _powers(n: int) -> np.ndarray:
    return np.asarray([pow(_BASE, i, 1 << 64) for i in range(n)], "<u8")


def sketch(points: np.ndarray, shingle: int = SHINGLE, scale: int = SCALE) -> np.ndarray:
    """Code points -> the sorted distinct hashes below the threshold.

    If none is below it, the smallest hash stands alone, so that only an empty text has an empty sketch.
    """
    if not len(points):
        return np.zeros(0, "<u4")
    k = min(shingle, len(points))
    powers, limit, kept, least = _powers(k), np.uint32((1 << 32) // scale - 1), [], None
    for at in range(0, len(points) - k + 1, CHUNK):
        part = points[at : at + CHUNK + k - 1].astype("<u8") + np.uint64(1)
        m = len(part) - k + 1
        h, have, done = np.zeros(m, "<u8"), part, 0
        # windows of length 1, 2, 4, ... by doubling; the set bits of k put them together
        size = 1
        while size <= k:
            if k & size:
                h += have[done : done + m] * powers[done]
                done += size
            if size * 2 <= k:
                have = have[: len(have) - size] + have[size:] * powers[size]
            size *= 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h = (h >> np.uint64(32)).astype("<u4")
        kept.append(h[h <= limit])
        least = min(int(h.min()), least if least is not None else 1 << 32)
    found = np.unique(np.concatenate(kept))
    return found if len(found) else np.asarray([least], "<u4")


def as_text(hashes: np.ndarray) -> str:
    """A sketch as a string: base64 of its hashes, ascending, as little-endian unsigned 32-bit integers."""
    return base64.b64encode(hashes.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    return np.union1d(a, b)


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(containment of the smaller sketch in the other, Jaccard similarity); both 1 for two empty ones, 0 if one is."""
    if not len(a) or not len(b):
        same = float(len(a) == len(b))
        return same, same
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / min(len(a), len(b)), shared / (len(a) + len(b) - shared)


def points_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"


def compare_with_next(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """Each document's sketch, that of its edited text, and their likeness to it and to the next document.

    The edited text has its last floor(n / 4) code points replaced by the first as many of the next document in
    ascending doc_id order (after the last: the first). Texts are dealt out once, by ranges of doc_id; the first
    document of each range also goes to the range before it. Null texts are empty; null doc_ids come first; rows
    of one doc_id follow each other by text; other columns are ignored; no rows give none; a single row is its own next.
    """
    bounds = splits(docs, "doc_id", n_parts(docs.sparkSession))
    n = len(bounds) + 1
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(text, F.lit("")).alias("text"), bucket("doc_id", bounds).alias("range"))
    firsts = {r["range"]: r["least"] for r in docs.select(F.col("doc_id").cast("long"), bucket("doc_id", bounds).alias("range")).groupBy("range").agg(F.min("doc_id").alias("least")).collect()}
    if not firsts:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    filled = sorted(firsts)
    before = {r: filled[i - 1] for i, r in enumerate(filled)}
    nulls = bool(docs.where("doc_id is null").limit(1).count())  # they are the first of range 0

    keys = F.create_map(*[F.lit(x) for r in filled for x in (r, before[r])])
    least = F.create_map(*[F.lit(x) for r in filled for x in (r, firsts[r])])
    first = F.when(F.lit(nulls) & (F.col("range") == 0), F.col("doc_id").isNull()).otherwise(F.col("doc_id") == F.element_at(least, F.col("range")))
    own = F.struct(F.col("range").alias("to"), F.lit(False).alias("last"))
    copy = F.struct(F.element_at(keys, F.col("range")).alias("to"), F.lit(True).alias("last"))
    dealt = rows.select("doc_id", "text", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))).alias("d")).select("doc_id", "text", "d.to", "d.last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ended = None, False
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch, out = whole.slice(at, 500), []
                for doc, string, last in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if ended:
                        break
                    points = points_of(string)
                    now = (doc, points, sketch(points, shingle, scale))
                    if held is not None:
                        id_, old, own = held
                        cut = min(len(old) // 4, len(points))
                        part = old[: len(old) - len(old) // 4]
                        edited = np.concatenate([part, points[:cut]])
                        other = sketch(edited, shingle, scale)
                        digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
                        (c1, j1), (c2, j2) = likeness(own, other), likeness(own, now[2])
                        out.append((id_, len(old), digest, as_text(own), as_text(other), c1, c2, j1, j2))
                    held, ended = now, last
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return dealt.repartitionById(n, "to").sortWithinPartitions("last", "doc_id", "text").select("doc_id", "text", "to", "last").mapInArrow(run, SCHEMA)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
