"""Toxicity: Levenshtein automata intersected with a lexicon trie, and scores of each hit's context window."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .common import map_arrow, table, tidied, written
from .simhash import shingles

#: The classifier and its lexicon are fitted on at most so many labelled rows, those with the smallest hashed ids.
MAX_TRAIN = 20_000
#: A term is in at least so many toxic training texts, and its log odds are at least so high. So the lexicon, which goes to
#: every worker, grows with the bounded training rows only.
MIN_TEXTS, MIN_ODDS = 5, 4.0
STEMS = (4, 5, 6)
#: Whole terms of at least so many letters also match at one edit.
FUZZY_FROM = 5
#: Words on either side of a hit that make up its context.
WINDOW = 8
#: A task keeps what so many chunks meet, of at most CACHE_CHARS characters, and so many steps of the automaton: about 35 MB and 20 MB.
CACHE_ENTRIES, CACHE_CHARS, MAX_STEPS = 200_000, 48, 200_000

# Words of context in four languages: who is spoken to, and who is reported.
ADDRESS = frozenset("you your you're u tu te toi vous du dich dir sie tú usted eres es".split())
REPORT = frozenset("said says wrote called quote quoted quoting reported dit écrit appelé sagte schrieb nannte dijo escribió llamó".split())
OPEN_QUOTES, CLOSE_QUOTES = "\"“„«‹‘'", "\"”“»›’'"
FEATURES = ("exact", "stem", "fuzzy", "quoted", "addressed", "density")


def word_of(chunk: str) -> str:
    """A white-space chunk in lower case without marks at its ends."""
    return chunk.lower().strip(".,;:!?\"'()[]{}<>«»‹›“”„‘’…-*_")


@dataclass
class Lexicon:
    """Terms in a trie, and the lazily determinised union of their Levenshtein automata.

    A state of the automaton is a set of (trie node, edits so far); a step on a letter keeps the nodes that
    the letter, or one edit, can reach, so only words near some term go on. Stems match the beginning of a
    word without edits; terms of FUZZY_FROM letters or more match whole words at `edits` edits.
    """

    terms: list[str]
    stems: list[str]
    edits: int = 1
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: dict[int, str] = field(default_factory=dict)
    begins: set[int] = field(default_factory=set)
    longest: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self):
        for word, stem in [*((t, False) for t in self.terms), *((s, True) for s in self.stems)]:
            at = 0
            for c in word:
                self.longest[at] = max(self.longest[at], 0 if stem else len(word))
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.longest.append(0)
                at = self.children[at][c]
            self.longest[at] = max(self.longest[at], 0 if stem else len(word))
            if stem:
                self.begins.add(at)
            else:
                self.ends[at] = word
        self.states: list[frozenset] = []
        self.index: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.n_steps = 0
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """Closed under leaving out letters of a term; nodes that begin no term long enough for edits keep none."""
        todo = list(nodes.items())
        best = dict(nodes)
        while todo:
            node, edits = todo.pop()
            if edits < self.edits:
                for child in self.children[node].values():
                    if self.longest[child] >= FUZZY_FROM and edits + 1 < best.get(child, 99):
                        best[child] = edits + 1
                        todo.append((child, edits + 1))
        key = frozenset(best.items())
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.index[key]

    def step(self, state: int, letter: str) -> int:
        """The next state, -1 if no term is near any more."""
        if (to := self.steps[state].get(letter)) is None:
            best: dict[int, int] = {}
            for node, edits in self.states[state]:
                if (child := self.children[node].get(letter)) is not None and edits < best.get(child, 99):
                    best[child] = edits
                if edits < self.edits:
                    if self.longest[node] >= FUZZY_FROM and edits + 1 < best.get(node, 99):
                        best[node] = edits + 1  # a letter too many
                    for child in self.children[node].values():  # another letter
                        if self.longest[child] >= FUZZY_FROM and edits + 1 < best.get(child, 99):
                            best[child] = edits + 1
            to = self._state(best) if best else -1
            if self.n_steps < MAX_STEPS:
                self.steps[state][letter] = to
                self.n_steps += 1
        return to

    def match(self, word: str) -> str | None:
        """exact, stem or fuzzy: how the word meets the lexicon at best."""
        state, stem = self.start, False
        for c in word:
            state = self.step(state, c)
            if state < 0:
                break
            stem = stem or any(edits == 0 and node in self.begins for node, edits in self.states[state])
        found = [edits for node, edits in self.states[state] if node in self.ends and (edits == 0 or len(self.ends[node]) >= FUZZY_FROM)] if state >= 0 else []
        if found and min(found) == 0:
            return "exact"
        return "stem" if stem else "fuzzy" if found else None


def opens(chunk: str) -> bool:
    """A quotation begins with this chunk: a mark before a letter, or one on its own that isn't straight."""
    return chunk[0] in OPEN_QUOTES and (len(chunk) > 1 or chunk not in "\"'")


def closes(chunk: str) -> bool:
    """A quotation ends with this chunk: a mark after a letter, full stops and the like aside, or a mark on its own that only closes."""
    end = chunk.rstrip(".,;:!?")
    return bool(end) and end[-1] in CLOSE_QUOTES and (len(end) > 1 or end not in OPEN_QUOTES)


def quoted(chunks: list[str], at: int, window: int = WINDOW) -> bool:
    """A quotation mark opens at or before the hit, none closes in between, and one closes at or after it; or a reporting word stands in the window.

    Straight marks on their own, which may open or close, count for neither.
    """
    low, high = max(0, at - window), min(len(chunks), at + window + 1)
    for i in range(at, low - 1, -1):
        if i < at and closes(chunks[i]):
            break
        if opens(chunks[i]):
            if any(map(closes, chunks[at:high])):
                return True
            break
    return any(word_of(c) in REPORT for c in chunks[low:high])


class Scorer:
    """Features of texts by a lexicon; what a chunk meets is kept, for so many chunks at most."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.kept = lexicon, {}

    def hit(self, chunk: str) -> str | None:
        found = self.lexicon.match(word_of(chunk))
        if len(self.kept) < CACHE_ENTRIES and len(chunk) <= CACHE_CHARS:
            self.kept[chunk] = found
        return found

    def features(self, text: str | None) -> list[float]:
        chunks = (text or "").split()
        kept, hits = self.kept, []
        for i, c in enumerate(chunks):
            if (kind := kept[c] if c in kept else self.hit(c)) is not None:
                hits.append((i, kind))
        n = dict.fromkeys(FEATURES, 0.0)
        for i, kind in hits:
            if quoted(chunks, i):
                n["quoted"] += 1
                continue
            n[kind] += 1
            n["addressed"] += any(word_of(c) in ADDRESS for c in chunks[max(0, i - WINDOW) : i + WINDOW + 1])
        n["density"] = 100.0 * (n["exact"] + n["stem"] + n["fuzzy"]) / max(20, len(chunks))
        return [math.log1p(n[f]) for f in FEATURES]


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def once_each(rows: DataFrame) -> DataFrame:
    """Near copies in the training rows would make terms of the words that they alone share, so those of one label count once.

    Rows (toxic, text) of one label are near copies where they agree in the smallest two hashes of their five-word shingles (of all words,
    where there are fewer), by one of two pairs of hash functions: texts of a similarity of 0.8 do in seven of eight cases, of 0.3
    in one of six, unrelated ones don't. Which row stays depends on its text alone, labels aren't weighed against each other.
    """

    def make():
        salts = np.random.default_rng(5).integers(1, 1 << 63, (4, 2), dtype=np.uint64) | np.uint64(1)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            least = np.zeros((batch.num_rows, 4), np.int64)
            for i, x in enumerate(batch.column(1)):
                if len(h := shingles(x.as_py(), 5)):
                    least[i] = [((h ^ a) * b).min().view(np.int64) for a, b in salts]
            return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, np.ascontiguousarray(least.T))], names=["toxic", "text", "h0", "h1", "h2", "h3"])

        return work

    kind = f"toxic {rows.schema['toxic'].dataType.simpleString()}, text string, h0 long, h1 long, h2 long, h3 long"
    kept = map_arrow(rows.select("toxic", "text"), make, kind)
    for a, b in (("h0", "h1"), ("h2", "h3")):
        one = F.min_by(F.struct("text", *[c for c in ("h0", "h1", "h2", "h3") if c not in (a, b)]), F.struct(F.xxhash64("text"), F.col("text")))
        kept = kept.groupBy("toxic", a, b).agg(one.alias("r")).select("toxic", a, b, "r.*")
    return kept.select("toxic", "text")


def learn_terms(train: DataFrame) -> Lexicon:
    """Words, and beginnings of words, whose share of the toxic texts is far above that of the others.

    Counted by Spark over the training rows; only the terms leave it. A word is no term where a
    beginning of it already is one.
    """
    words = F.array_distinct(F.expr(r"filter(transform(regexp_extract_all(lower(text), '(?U)[\\w]+', 0), w -> w), w -> length(w) >= 3)"))
    parts = ", ".join(f"transform(filter(w, x -> length(x) >= {k}), x -> concat('{k}|', substring(x, 1, {k})))" for k in STEMS)
    terms = train.select("toxic", words.alias("w")).select("toxic", F.explode(F.expr(f"array_distinct(concat(transform(w, x -> concat('0|', x)), {parts}))")).alias("term"))
    size = train.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    bad, good = size["bad"], size["n"] - size["bad"]
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("t") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (good + 1))
    best = counts.where(f"t >= {MIN_TEXTS}").withColumn("odds", odds).where(f"odds >= {MIN_ODDS}").orderBy(F.desc(F.col("odds") * F.sqrt("t")), "term").collect()
    stems: list[str] = []
    whole = [r["term"].split("|", 1) for r in best]
    texts = {r["term"]: r["t"] for r in best}
    for k in STEMS:
        for kind, x in whole:
            # a beginning stands for several words: its texts are more than those of any of them
            if kind == str(k) and not any(x.startswith(s) for s in stems) and texts.get(f"0|{x}", 0) < texts[f"{k}|{x}"] and sum(w.startswith(x) for o, w in whole if o == "0") != 1:
                stems.append(x)
    return Lexicon(sorted(x for kind, x in whole if kind == "0" and not any(x.startswith(s) for s in stems)), sorted(stems))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 200) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept. Without both labels only that is set."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = -4.0 if not len(y) or y[0] == 0 else 4.0
        return w
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + penalty * w / 10
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(penalty / 10 + 1e-6)
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def features(docs: DataFrame, lexicon: Lexicon, text: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """docs with a last column of the features of its whole texts, or with weights of their score.

    The column is called _tox_features or _tox_score; columns of docs beginning with `_tox_` are refused. Null and
    empty texts have the features of a text without hits; every row is read for itself; no rows give none. A
    text goes to Python once, with its row.
    """
    if clash := [c for c in docs.columns if c.startswith("_tox_")]:
        raise ValueError(f"columns {clash} are in the way")
    at = docs.columns.index(text)
    out = ("_tox_features", ArrayType(DoubleType())) if weights is None else ("_tox_score", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for whole in batches:
            for begin in range(0, whole.num_rows, 1000):
                batch = whole.slice(begin, 1000)
                found = [scorer.features(t.as_py()) for t in batch.column(at)]
                if weights is None:
                    own = pa.array(found, pa.list_(pa.float64()))
                else:
                    own = pa.array(1 / (1 + np.exp(-np.clip(np.asarray(found) @ weights[:-1] + weights[-1], -30, 30))))
                yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, out[0]])

    return docs.mapInArrow(tidied(run), StructType([*docs.schema.fields]).add(*out))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Learns lexicon and weights from labelled documents that aren't held out, `most` of them at most.

    Labels that are null or not 0 or 1 are passed over; a document with several labels counts as toxic if one is 1.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded by `most`, so it may be broadcast
    rows = written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").select("toxic", "text"))
    lexicon = learn_terms(written(once_each(rows)))
    found = features(rows, lexicon).select("toxic", "_tox_features").toPandas()
    x = np.asarray(found["_tox_features"].tolist(), float).reshape(-1, len(FEATURES))
    return Model(lexicon, fit(x, found["toxic"].to_numpy(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    The score depends on the text alone; null and empty texts have the score of a text without hits. Every row
    is scored for itself: ties, repeated rows and null doc_ids (held_out is null) stay; other columns are
    ignored; no rows give none.
    """
    found = features(docs.select(F.col("doc_id").cast("long"), "text"), model.lexicon, weights=model.weights)
    score_ = F.col("_tox_score")
    return found.select("doc_id", held_out().alias("held_out"), score_.alias("score"), (score_ >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text the model doesn't predict to be toxic, with the columns of docs, whatever their names.

    Null and empty texts have no hits and stay; every row is judged by its own text, so copies, repeated rows and null
    doc_ids go or stay each by itself; columns beginning with `_tox_` are refused; no rows give none.
    """
    return features(docs, model.lexicon, weights=model.weights).where("_tox_score < 0.5").drop("_tox_score")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`score` of all documents by a model of those that aren't held out; odd rows as there."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
