"""Segments against a search over all ways to put texts together."""

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import chunking

TEXTS = st.lists(st.text("ab", min_size=1, max_size=14), max_size=9)


def longest(texts, before, most):
    """How many of the texts the longest chunk that begins with `before` takes: every number is tried."""
    fits = [n for n in range(1, len(texts) + 1) if len("\n\n".join([*before, *texts[:n]])) <= most]
    return max(fits, default=1)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 30), st.integers(0, 9))
def test_chunks_are_as_long_as_they_can_be(texts, most, overlap):
    rest, before = list(texts), []
    for chunk in chunking.packed(texts, most, overlap):
        n = longest(rest, before, most)
        assert chunk == "\n\n".join([*before, *rest[:n]])
        rest = rest[n:]
        if rest:
            tail = chunk[-overlap:] if overlap else ""
            kept = tail.split("\n\n", 1)[1] if "\n\n" in tail else tail
            before = [(kept + "\n\n" + rest[0]).strip()[:overlap]] if overlap else []
    assert not rest


def by_recursion(chunks, most, least):
    """(segments, whether the last one may take in a short rest): the first segment by trying each length, then the others."""
    for n in range(1, len(chunks) + 1):
        own = "\n\n".join(chunks[:n])
        if n == len(chunks):
            return [own]
        if len(own) >= least and (n == 1 or len(own) <= most):
            return [own, *by_recursion(chunks[n:], most, least)]
        if len("\n\n".join(chunks[: n + 1])) > most and len(own) < least:
            return ["\n\n".join(chunks[: n + 1]), *by_recursion(chunks[n:], most, least)]
    return []


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(5, 30), st.integers(0, 12))
def test_segments_are_those_found_by_trying(texts, most, least):
    want = by_recursion(texts, most, least)
    if len(want) > 1 and len(want[-1]) < least:
        want[-2:] = ["\n\n".join(want[-2:])]
    assert chunking.merged(texts, most, least) == want


def test_titles_part_sections():
    assert list(chunking.paragraphs("a\n# T\n## U\nb\n\nc\n#no title\n# ", r"\n\s*\n")) == [["a"], ["b", "c\n#no title"]]
    assert chunking.chunk_text("\r\n \r\n") == [] and chunking.chunk_text("a\r\n\r\nb") == ["a\n\nb"]


def test_every_document_keeps_its_paragraphs(data):
    for (text,) in duckdb.sql(f"select text from '{data}/documents.parquet'").fetchall():
        found = chunking.chunk_text(text, separator="\n")
        lines = [x for line in text.split("\n") if (x := line.strip())]
        at = 0
        for line in lines:  # in their order, none left out
            at = next(i for i in range(at, len(found)) if line in found[i])
        assert sum(map(len, found)) >= sum(map(len, lines))
