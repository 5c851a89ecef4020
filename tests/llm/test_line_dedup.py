"""Runs of words that stand earlier: found at any length over MIN_WORDS, cut whole."""

import random

import numpy as np

from tessera.llm import line_dedup

WORDS = [a + b for a in ("th", "er", "on", "qu", "li", "ma", "St", "ñe") for b in ("an", "ion", "o", "é", "ust", "e")]


def run(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n))


def kept(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {x["doc_id"]: x["text"] for x in line_dedup.dedup(docs, **more).collect()}


def test_passages_without_line_ends_are_found(spark):
    r = random.Random(11)
    passages = [run(r, n) for n in range(51, 71)]
    hosts = [(f"{run(r, 40)} x{i}", f"y{i} {run(r, 40)}") for i in range(60)]
    got = kept(spark, [(i, f"{a} {passages[i % 20]} {b}") for i, (a, b) in enumerate(hosts)])
    assert all(passages[i] in got[i] for i in range(20))
    assert [got[i] for i in range(20, 60)] == [f"{a} {b}" for a, b in hosts[20:]]


def test_passages_go_whole_next_to_others(spark):
    """a is followed by another passage in every document, and goes to its last word whatever stands next to it."""
    r = random.Random(12)
    a, b, c = (run(r, n) + "." for n in (150, 60, 400))
    hosts = [run(r, 30) for _ in range(4)]
    got = kept(spark, [(0, f"{hosts[0]} {a} {hosts[1]}"), (1, f"{b} {hosts[2]}"), (2, f"{a} {b}"), (3, f"{c}"), (4, f"{hosts[3]} {c} {b} {a}")])
    assert got[2] == "" and got[4] == hosts[3] + " "
    assert got[0] == f"{hosts[0]} {a} {hosts[1]}" and got[3] == c


def test_the_filter_changes_no_result(spark, monkeypatch):
    r = random.Random(13)
    passages = [run(r, 80) for _ in range(5)]
    rows = [(i, f"{run(r, 50)} {passages[i % 5]} {run(r, 50)}") for i in range(40)]
    whole = kept(spark, rows)
    monkeypatch.setattr(line_dedup, "FILTER_BITS", 64)
    assert kept(spark, rows) == whole


def test_each_white_space_variant_has_its_own_first(spark):
    r = random.Random(14)
    w = run(r, 60).split(" ")
    variants = [" ".join(w), "\r\n".join(w), "\n\n".join(w)]
    hosts = [run(r, 20) for _ in range(9)]
    got = kept(spark, [(i, f"{h} {variants[i % 3]}") for i, h in enumerate(hosts)])
    assert [got[i] for i in range(3)] == [f"{hosts[i]} {variants[i]}" for i in range(3)]
    assert [got[i] for i in range(3, 9)] == [h + " " for h in hosts[3:]]


def test_only_copies_of_one_document_stay_whole(spark):
    r = random.Random(15)
    a, b, long = run(r, 80), run(r, 80), run(r, 400)
    own = [run(r, 30) for _ in range(4)]
    near = long.replace(long[:10], "changed", 1)
    rows = [(0, f"{own[0]} {a}"), (1, f"{own[1]} {b}"), (2, f"{a} {b} {own[2]}"), (3, " ".join([long] * 5)), (4, f"{a} {own[3]}"), (5, near + " " + own[0]), (10, run(r, 500)), (11, None)]
    rows[-1] = (11, rows[-2][1] + " at the end")
    got = kept(spark, rows, copy_share=0.9)
    assert got[2] == own[2] and got[4] == own[3]  # passages of two documents; one passage and little else
    assert got[3].strip() == long  # repeats inside itself
    assert got[5] != rows[5][1]  # holds what another repeats five times, and isn't a copy of that
    assert got[11] == rows[-1][1]  # a near copy of one document


def by_all_windows(rows):
    """The texts without what stands earlier: every window of 25 words against all before it, in the order of the documents and of their bytes."""
    first, out = {}, {}
    for doc, text in sorted(rows):
        raw = text.encode()
        words = [m.span() for m in line_dedup.WORD.finditer(raw)]
        gone = bytearray(len(raw) + 1)
        for (low, _), (_, high) in zip(words, words[line_dedup.MIN_WORDS - 1 :], strict=False):
            was = first.setdefault(raw[low:high], (doc, low))
            if was != (doc, low):
                begin = low if was[0] != doc else max(low, was[1] + high - low)  # in one document only what lies after the first
                gone[begin:high] = b"\1" * (high - begin)
        for i in range(len(raw)):  # with the white space after each
            if gone[i - 1] and i and raw[i] in line_dedup.SPACE:
                gone[i] = 1
        out[doc] = bytes(c for c, away in zip(raw, gone, strict=False) if not away).decode()
    return out


def test_cuts_are_those_of_all_windows(spark):
    for seed in range(3):
        r = random.Random(seed)
        passages = [run(r, r.choice((20, 24, 25, 26, 40, 90))) for _ in range(8)]
        rows = []
        for i in range(60):
            parts = [r.choice((run(r, r.randint(1, 40)), r.choice(passages), "tick tock " * r.randint(1, 30), "日本語の文" * r.randint(1, 8))) for _ in range(r.randint(1, 5))]
            rows.append((i, r.choice((" ", "\n", " \n ")).join(parts)))
        rows += [(i, rows[i - 60][1]) for i in range(60, 70)]
        want = by_all_windows(rows)
        assert kept(spark, rows) == want


def test_runs_of_windows_against_all_windows():
    """Runs found in columns are those of one window after the other; texts that white space or repeats make unsure are told."""
    r = random.Random(21)
    least = line_dedup.MIN_WORDS
    texts, group = [], []
    for g in range(60):
        middle, other = run(r, r.choice((20, 30, 45))), run(r, 30)
        for _ in range(r.randint(2, 6)):
            parts = [run(r, r.randint(0, 9)), r.choice((middle, middle, other)), run(r, r.randint(0, 30))]
            texts.append(" ".join(parts).strip().encode())
            group.append(g)
    for g, own in ((60, [run(r, 30)] * 3), (61, ["日本語の文をここに書く試験のための長い文章である。" * 2, "前置日本語の文をここに書く試験のための長い文章である。"])):
        texts += [x.encode() for x in own]
        group += [g] * len(own)
    line = run(r, 40)
    for g, own in ((62, [line, line.replace(" ", "\n")]), (63, [run(r, 10), "tick tock " * 20]), (64, ["w" * 70 + " " + line, "v" * 70 + " " + line])):
        texts += [x.strip().encode() for x in own]
        group += [g] * len(own)
    row, low, high, row0, low0, unsure = (x.tolist() for x in line_dedup.shared_runs(texts, np.asarray(group)))
    assert {62, 63} <= set(unsure) <= {61, 62, 63}
    met, want = {}, set()
    for i, (g, text) in enumerate(zip(group, texts, strict=True)):
        spans = [m.span() for m in line_dedup.WORD.finditer(text)]
        for (a, _), (_, b) in zip(spans, spans[least - 1 :], strict=False):
            was = met.setdefault((g, text[a:b]), (i, a))
            if was[0] != i and g not in unsure:
                want.add((i, a, b, *was))
    got = set()
    for i, a, b, i0, a0 in zip(row, low, high, row0, low0, strict=True):
        if group[i] not in unsure:
            assert group[i0] == group[i] and i0 < i and texts[i][a:b] == texts[i0][a0 : a0 + b - a]
            spans = [m.span() for m in line_dedup.WORD.finditer(texts[i]) if a <= m.start() and m.end() <= b]
            got |= {(i, x, y, i0, a0 + x - a) for (x, _), (_, y) in zip(spans, spans[least - 1 :], strict=False)}
    assert got == want and want
