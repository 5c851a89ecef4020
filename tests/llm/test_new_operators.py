"""Prefix tries, the filter audit and decontamination against brute force, on odd rows, and with limits so small that every path is taken."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest

from tessera.llm import conversations, decontamination, filter_audit

TURNS = "conv_id long, turn long, role string, text string, bytes string, w int"


def chats(seed: int, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    starts = [("system", "be kind"), ("user", "hé"), ("user", ""), (None, "x")]
    rows = []
    for c in range(n):
        if c % 11 == 3:
            continue
        copy = r.random() < 0.3
        for t in range(r.randrange(1, 7)):
            role, text = starts[(t * 7 + (0 if copy else r.randrange(3))) % 4]
            rows.append((c, None if t == 0 and c % 9 == 0 else t, role, text, "clash", 1))
    rows += [(3, 1, "user", "twice", "", 0)] * 2 + [(None, 1, "user", "no id", "", 0), (7, None, "a", None, "", 0), (-7, 2, "user", "below", "", 0)]
    rows += [(1005, t, "user", f"long {t % 3}", "", 0) for t in range(0, 4000, 40)]
    return rows


def brute_trie(rows: list[tuple]) -> dict:
    said = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            said.setdefault(c, []).append(((turn is not None, turn or 0), key, (role, text)))
    said = {c: [x[2] for x in sorted(own)] for c, own in said.items()}
    whole = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(said.get(base, [])[:h] + said[c][h:])
    members, ends = {}, {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved, out = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = kids.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) or 1
        saved[path] = sum(saved[k] for k in below) + (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        out[min(members[path]), len(path)] = (min(members[path[:-1]]) if path else None, len(members[path]), len(below), leaves[path], saved[path], digest)
    return out


@pytest.mark.parametrize(("subtrie", "bucket"), [(20_000, 50_000), (12, 9), (2, 5)])
def test_trie_against_brute_force(spark, subtrie, bucket):
    rows = chats(subtrie)
    found = conversations.conversation_trie(spark.createDataFrame(rows, TURNS), subtrie, bucket).collect()
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in found}
    assert len(got) == len(found) and got == brute_trie(rows)


def test_trie_of_one_long_conversation_and_of_none(spark):
    rows = [(c, t, "u", f"t{t}", "", 0) for c in (0, 5, 10) for t in range(60)]
    found = conversations.conversation_trie(spark.createDataFrame(rows, TURNS), 20, 30).collect()
    got = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in found}
    assert got == brute_trie(rows) and len(got) == 61
    assert conversations.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    # conversation 3 has no turns of its own left and no conversation 0 to begin with: the root alone
    alone = conversations.conversation_trie(spark.createDataFrame([(3, 0, "u", "t", "", 0)], TURNS)).collect()
    h = zlib.crc32(b"3") % 9
    assert len(alone) == (1 if h else 2) and alone[-1]["depth"] == 0 and alone[-1]["n_leaves"] == 1


DOCS = "doc_id long, text string, source string, mask int, fp long, n int, items string"
LABELS = "doc_id long, quality int, toxic int, part string"


def texts(seed: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["the", "Über", "a#b", "ONE", "two", "x y", "\x1c", "é"]
    own = [" ".join(r.choice(words) for _ in range(r.choice((0, 1, 5, 199, 200, 250)))) + r.choice(("", "\n", "\t")) for _ in range(25)]
    rows = [(r.randrange(60) if r.random() < 0.95 else None, r.choice([*own, None, "same"]), r.choice(["s", "t", None]), 1, 2, 3, "c") for _ in range(300)]
    return rows + [(61, "Z" * 300_000, "s", 0, 0, 0, ""), (61, "Z" * 300_000, "s", 0, 0, 0, "")] + [(62 + i, "same", "hot", 0, 0, 0, "") for i in range(200)]


def brute_masks(rows: list[tuple]) -> list[tuple]:
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, source, *_ in rows:
        t = t or ""
        w = t.encode().split()
        up = sum("A" <= c <= "Z" for c in t)
        mask = (len(w) < 200) + 2 * (100 * len(set(w)) < 50 * len(w)) + 4 * (100 * up > 2 * len(t)) + 8 * any(c in "#$%&*|" for c in t)
        out.append((i, source or "", mask + 16 * (i is not None and i > least[t])))
    return out


@pytest.mark.parametrize("parts", ["1", "7", "40"])
def test_audit_against_brute_force(spark, parts):
    rows = texts(int(parts))
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        docs = spark.createDataFrame(rows, DOCS).repartition(5)
        masked = filter_audit.masks(docs)
        key = lambda r: (r[0] is None, *map(lambda v: v if v is not None else 0, r))
        assert sorted((tuple(r) for r in masked.collect()), key=key) == sorted(brute_masks(rows), key=key)
        labels = [(i, i % 3 == 0, i % 4 == 0, "") for i in range(0, 60, 2)] + [(4, 1, None, ""), (4, 0, 0, ""), (None, 1, 1, "")]
        labels = [(i, None if q is None else int(q), None if t is None else int(t), p) for i, q, t, p in labels]
        found = {(r["part"], r["filter_order"], r["step"]): r.asDict() for r in filter_audit.filter_audit(docs, spark.createDataFrame(labels, LABELS)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    good, toxic = {i for i, q, _, _ in labels if q == 1 and i is not None}, {i for i, _, t, _ in labels if t == 1 and i is not None}
    by_part = {}
    for i, p, m in brute_masks(rows):
        by_part.setdefault(p, []).append((i, m))
    assert len(found) == len(by_part) * 600
    for p, own in by_part.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                now = {n for n, (_, m) in enumerate(own) if m & bit}
                r = found[p, "".join(order), step]
                removed = now - gone
                assert r["removed"] == len(removed) and r["redundant"] == len(now & gone) and r["unique_fails"] == sum(m == bit for _, m in own)
                assert r["good_lost"] == sum(own[n][0] in good for n in removed) and r["toxic_lost"] == sum(own[n][0] in toxic for n in removed)
                gone |= now
                assert r["kept"] == len(own) - len(gone)
                total[f] += len(removed)
        assert all(r["shapley"] == total[o[s - 1]] for (q, o, s), r in found.items() if q == p)


def test_audit_of_no_rows(spark):
    assert filter_audit.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


ITEMS = "item_id long, text string, words string"


def benchmark_case(seed: int, short: bool):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünder", "日本", "é😀"]
    say = lambda n: " ".join(r.choice(vocabulary) + r.choice(("", "", ",", "!")) for _ in range(n))
    items = [(i, say(r.randrange(10, 60)), "clash") for i in range(12)]
    items += [(1, items[2][1], ""), (None, say(14), ""), (90, None, ""), (91, "...", "")]
    if short:
        items += [(100, "w1 w2 w3", ""), (7, "only", ""), (101, "W1-w1", "")]
    rows = []
    for d in range(150):
        parts = [say(r.randrange(0, 30))]
        for _ in range(r.randrange(3)):
            text = (r.choice(items)[1] or "").split()
            a = r.randrange(len(text) + 1)
            parts += [" ".join(text[a : a + r.randrange(5, 25)]).upper().replace("É", "é").replace("Ü", "Ü"), "zz " * r.randrange(2), say(r.randrange(4))]
        rows.append((d if d % 10 else d // 2, " ; ".join(parts), "s", 0, 0, 0, "c"))
    whole = " ".join(items[4][1].split())
    rows += [(900, None, None, 0, 0, 0, ""), (901, "", "", 0, 0, 0, ""), (902, (whole + " ") * 400, "", 0, 0, 0, ""), (None, whole, "", 0, 0, 0, ""), (903, "only", "", 0, 0, 0, "")]
    return items, rows


def words_of(text: str | None) -> list[str]:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text).split(" ")


def brute_hits(items: list[tuple], rows: list[tuple]) -> list[tuple]:
    windows = {}
    for i, t, _ in items:
        w = [x for x in words_of(t) if x]
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(k, {}).setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for d, t, *_ in rows:
        w, hit, met = [x for x in words_of(t) if x], set(), set()
        for k, own in windows.items():
            for a in range(len(w) - k + 1):
                if (found := own.get(tuple(w[a : a + k]))) is not None:
                    hit |= set(range(a, a + k))
                    met |= found
        out.append((-1 if d is None else d, len(w), len(hit), sorted(met - {None})))
    return sorted(out)


@pytest.mark.parametrize(("short", "shard", "block"), [(False, 1 << 19, 2_000_000), (True, 1 << 19, 2_000_000), (True, 64, 2_000_000), (False, 300, 700), (True, 1 << 19, 400)])
def test_contamination_against_brute_force(spark, short, shard, block):
    items, rows = benchmark_case(shard + block, short)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = decontamination.contamination(docs, spark.createDataFrame(items, ITEMS), shard=shard, block_bytes=block).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found) == brute_hits(items, rows)
    assert any(r["n_hit"] for r in found)
    for r in found:
        for a, b in zip(r["spans"], r["spans"][1:], strict=False):
            assert a["last"] < b["first"] and a["end"] < b["start"]


def test_spans_are_cut_out_of_the_text(spark):
    items = [(1, "one two three four five six seven eight nine ten", "")]
    text = "Étude: 😀 One two-three four five six seven eight, nine TEN. After"
    docs = spark.createDataFrame([(1, text, "", 0, 0, 0, ""), (2, "clean 😀", "", 0, 0, 0, "")], DOCS)
    found = decontamination.contamination(docs, spark.createDataFrame(items, ITEMS))
    cut = docs.join(found, "doc_id").select("doc_id", decontamination.without("text", "spans").alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in cut} == {1: "Étude: 😀 . After", 2: "clean 😀"}


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b", "", 0, 0, 0, "")], DOCS)
    none = spark.createDataFrame([], ITEMS)
    assert [tuple(r) for r in decontamination.contamination(docs, none).collect()] == [(1, 2, 0, [], [])]
    assert decontamination.contamination(docs.where("false"), spark.createDataFrame([(1, "a b", "")], ITEMS)).count() == 0


def test_index_ranks_and_places():
    r = np.random.default_rng(5)
    runs = [r.integers(1, 5, n).astype(np.int32) for n in (1, 7, 40, 3, 200)]
    index = decontamination.FMIndex(runs, 4)
    text = np.concatenate([x for own in runs for x in (own, [0])])
    for k in (1, 2, 3, 5):
        patterns = np.unique(r.integers(1, 5, (60, k)), axis=0)
        low, high = index.find(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text) - k + 1) if (text[i : i + k] == p).all()]
