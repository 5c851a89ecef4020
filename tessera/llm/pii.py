"""PII: patterns, and a semi-Markov conditional random field over the spans that they leave open.

The patterns fix the base spans. Around everything else that looks like personal data stand candidate spans of
four types; features of a whole span score it, and so does the move from one type to the next where two spans are
neighbours; dynamic programming over spans of bounded length chooses boundaries and types together. The field is
trained here, on lattices written from templates.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidied

KINDS = ("email", "ip", "card", "phone")
#: Code points of an entity at most, for spans that the field adds.
MAX_ENTITY = 64
#: Two spans that lie nearer than so many code points are neighbours: the move from one type to the other has a score.
NEAR = 16
#: Templates written out for training, and the seed of their choices.
TRAIN_LINES, SEED, EPOCHS = 1500, 11, 40

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches, found from their @ signs, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans that the patterns fix, by kind, then start; failing matches are dropped whole."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# Loose shapes of candidates, by type; each is tried at every place, so that candidates may overlap.
_LOOSE = {
    "email": re.compile(r"(?=(?<![\w.%+-])([\w][\w.%+-]{0,30} ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,25}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,10}){1,3})(?![\w@]))", re.I),
    "ip": re.compile(r"(?=(?<![\w.])([0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3})(?![\w]))"),
    "card": re.compile(r"(?=(?<![0-9+])([0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,4})(?![0-9]))"),
    "phone": re.compile(r"(?=(?<![\w.+])((?:\+|00)[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9]))"),
}
_LONGER = {"phone": re.compile(r"(?=(?<![\w.+])((?:\+|00)[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){3})(?![0-9]))")}
#: A text without a match of these holds no candidate of that type: each is part of the type's shapes, so nothing else in a text matters.
_NEEDS = {
    "email": re.compile(r"@|[(\[]at[)\]]| at ?[A-Za-z0-9-]{1,25} ?(?:\.|\(dot\)|\[dot\]| dot )", re.I),
    "ip": re.compile(r"[0-9] ?(?:\.|\[\.\]|\(\.\)) ?[0-9]"),
    "card": re.compile(r"[0-9]{4}[ .-]?[0-9]{4}[ .-]?[0-9]{4}"),
    "phone": re.compile(r"[0-9](?:[ .()-]{0,2}[0-9]){6}"),
}
_CUES = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "pay", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "llam", "appel", "ruf"),
}


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the loose shapes, at most MAX_ENTITY long, that don't touch the taken ones."""
    shapes = [(k, x) for k, x in (*_LOOSE.items(), *_LONGER.items()) if _NEEDS[k].search(text)]
    if not shapes:
        return []
    starts, ends = [], []  # the taken spans, overlapping ones as one
    for x, y in sorted(taken):
        if ends and x < ends[-1]:
            ends[-1] = max(ends[-1], y)
        else:
            starts.append(x)
            ends.append(y)
    out = []
    for kind, shape in shapes:
        for m in shape.finditer(text):
            a, b = m.span(1)
            i = bisect.bisect_left(ends, a + 1)  # the first taken span that ends after a
            if b - a <= MAX_ENTITY and (i == len(ends) or starts[i] >= b):
                out.append((kind, a, b))
    return out


def span_features(text: str, kind: str, a: int, b: int) -> list[str]:
    """Features of a whole span and its type."""
    s, before = text[a:b], text[max(0, a - 24) : a].lower()
    d = _digits(s)
    out = [kind, f"{kind}:digits={min(len(d), 20)}", f"{kind}:cue={any(c in before for c in _CUES[kind])}", f"{kind}:other={any(c in before for k in KINDS if k != kind for c in _CUES[k])}"]
    left, right = text[a - 1 : a] if a else "", text[b : b + 1]
    out += [f"{kind}:left={'edge' if not left or left.isspace() else 'letter' if left.isalpha() else 'mark'}", f"{kind}:right={'edge' if not right or right.isspace() or right in '.,;:!?)' else 'letter' if right.isalpha() else 'mark'}"]
    if kind == "card":
        out += [f"card:luhn={luhn(d)}", f"card:even={len({len(x) for x in re.split('[ .-]', s)}) <= 2}"]
    elif kind == "ip":
        out += [f"ip:parts={all(int(x) <= 255 for x in re.findall('[0-9]+', s))}", f"ip:plain={'[' not in s and '(' not in s and ' ' not in s}"]
    elif kind == "phone":
        out += [f"phone:intl={s[0] == '+' or s[:2] == '00'}", f"phone:parens={'(' in s}", f"phone:marks={len(re.findall('[ .-]', s))}"]
    else:
        out += [f"email:at={'sign' if '@' in s else 'bracket' if re.search(r'[(\[]at', s, re.I) else 'word'}", f"email:dot={'sign' if '.' in s.rpartition('@')[2] else 'word'}", f"email:words={min(4, len(s.split()))}"]
    return out


def lattice(text: str, spans: list[tuple[str, int, int]]) -> list[list[tuple[str, int, int]]]:
    """Spans cut into islands at least NEAR code points from each other, each sorted by end."""
    out: list[list] = []
    last = 0
    for span in sorted(spans, key=lambda x: (x[1], x[2])):
        if out and span[1] < last + NEAR:
            out[-1].append(span)
        else:
            out.append([span])
        last = max(last, span[2])
    return [sorted(x, key=lambda s: (s[2], s[1], s[0])) for x in out]


def move(before: str | None, kind: str) -> str:
    """The feature of two spans that follow each other within NEAR code points, or of a span with none so near before it."""
    return f"{before or 'none'}>{kind}"


def viterbi(island: list[tuple[str, int, int]], scores: list[float], moves: dict[str, float] | None = None) -> list[tuple[str, int, int]]:
    """The segmentation of the highest score: spans without overlap, their scores and those of the moves between neighbours.

    What no span covers scores 0. The state after a span is its type and its end; only the best of each is kept, so
    a span looks at most at NEAR ends and their types, and time is linear in the number of spans.
    """
    get = (moves or {}).get
    ends: list[int] = []  # distinct ends so far; for each the best segmentation up to it, and the best by the type that ends there
    upto: list[tuple[float, int]] = []
    by_type: list[dict[str, tuple[float, int]]] = []
    back: list[int] = []
    for i, (kind, a, b) in enumerate(island):
        far = bisect.bisect_right(ends, a - NEAR)
        value, at = upto[far - 1] if far else (0.0, -1)
        best, back_to = value + get(move(None, kind), 0.0), at
        for j in range(far, bisect.bisect_right(ends, a)):
            for before, (value, at) in by_type[j].items():
                if (value := value + get(move(before, kind), 0.0)) > best:
                    best, back_to = value, at
        best += scores[i]
        back.append(back_to)
        if not ends or ends[-1] != b:
            ends.append(b)
            upto.append(upto[-1] if upto else (0.0, -1))
            by_type.append({})
        if best > by_type[-1].get(kind, (-np.inf, 0))[0]:
            by_type[-1][kind] = (best, i)
        if best > upto[-1][0]:
            upto[-1] = (best, i)
    out, i = [], upto[-1][1] if upto else -1
    while i >= 0:
        out.append(island[i])
        i = back[i]
    return out[::-1]


def follows(island: list[tuple[str, int, int]]) -> list[tuple[int, int, str]]:
    """(i, j, move) of each span j that may come next after i; i = -1 is the beginning."""
    out = [(-1, j, move(None, kind)) for j, (kind, _, _) in enumerate(island)]
    for j, (kind, a, _) in enumerate(island):
        out += [(i, j, move(before if b > a - NEAR else None, kind)) for i, (before, _, b) in enumerate(island[:j]) if b <= a]
    return out


def marginals(island: list[tuple[str, int, int]], scores: list[float], moves: dict[str, float] | None = None) -> tuple[np.ndarray, list[float]]:
    """The probabilities of each span, and of each pair of `follows`, by the forward and backward sums over all segmentations."""
    get, n, pairs = (moves or {}).get, len(island), follows(island)
    into: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    onto: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, m in pairs:
        into[j].append((i, get(m, 0.0)))
        if i >= 0:
            onto[i].append((j, get(m, 0.0)))

    def total(values: list[float]) -> float:
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    forward, backward = [0.0] * n, [0.0] * n
    for j in range(n):
        forward[j] = scores[j] + total([(forward[i] if i >= 0 else 0.0) + m for i, m in into[j]])
    for i in range(n - 1, -1, -1):
        backward[i] = total([0.0, *(m + scores[j] + backward[j] for j, m in onto[i])])
    z = total([0.0, *forward])
    of_pair = [math.exp((forward[i] if i >= 0 else 0.0) + get(m, 0.0) + scores[j] + backward[j] - z) for i, j, m in pairs]
    return np.asarray([math.exp(f + b - z) for f, b in zip(forward, backward, strict=True)]), of_pair


def training_lines(n: int = TRAIN_LINES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Lines with spans of known types, and lines with numbers and words that are none."""
    r = random.Random(seed)

    def number(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + number(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def words(k: int) -> str:
        return " ".join("".join(r.choice("aeionrstldu") for _ in range(r.randint(2, 8))) for _ in range(k))

    def name() -> str:
        return words(1) + r.choice((".", "_", "")) + r.choice((words(1), number(2)))

    def entity(kind: str) -> str:
        if kind == "email":
            at = r.choice(("@", "@", " at ", "(at)", " [at] ", " (at) "))
            dot = "." if at == "@" else r.choice((".", " dot ", "(dot)", " [dot] "))
            return f"{name()}{at}{words(1)}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr'))}"
        if kind == "ip":
            return r.choice((".", ".", "[.]", "(.)")).join(str(r.randint(0, 255)) for _ in range(4))
        if kind == "card":
            c, mark = card(), r.choice(("", " ", "-", "."))
            return mark.join(c[i : i + 4] for i in range(0, 16, 4))
        country, a, b, c = r.choice(("+1", "+44", "+49", "0033", "001")), number(3), number(3), number(4)
        return r.choice((f"{country} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{country} {a} {b} {c}", f"{a}.{b}.{c}"))

    def other() -> tuple[str, str]:
        wrong = card()[:-1]
        return r.choice(
            (
                ("", f"{number(4)}-{number(2)}-{number(2)} {number(2)}:{number(2)}"), ("", f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(256, 999)}"),
                ("", wrong + next(x for x in "0123456789" if not luhn(wrong + x))), ("", number(12)), ("", number(14)), ("", f"{words(1)} at {words(1)} dot"), ("", f"v{number(1)}.{number(1)}.{number(2)}"),
                ("isbn ", f"{number(3)}-{number(1)}-{number(4)}-{number(4)}-{number(1)}"), ("", f"{number(4)} {number(4)} {number(4)}"), ("", f"{words(1)}={number(6)}a{number(9)}"), ("", f"{words(1)} meets at {words(1)}.{words(1)} there"),
            )
        )

    out = []
    for _ in range(n):
        text, spans = words(r.randint(1, 6)) + " ", []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.6:
                kind = r.choice(KINDS)
                text += (r.choice(_CUES[kind]) + r.choice((": ", " "))) if r.random() < 0.4 else ""
                e = entity(kind)
                spans.append((kind, len(text), len(text) + len(e)))
                text += e
            else:
                cue, x = other()
                text += cue + x
            text += r.choice((" ", ", ", ". ")) + words(r.randint(1, 4)) + " "
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=2)
def train(lines: int = TRAIN_LINES, seed: int = SEED, epochs: int = EPOCHS) -> dict[str, float]:
    """Weights of the features, by gradient ascent on the likelihood of the true segmentations. The same on every run."""
    names: dict[str, int] = {}
    data = []
    for text, truth in training_lines(lines, seed):
        for island in lattice(text, candidates(text, [])):
            gold = np.asarray([float(x in truth) for x in island])
            chosen = [i for i, x in enumerate(gold) if x]
            steps = set(zip([-1, *chosen], chosen, strict=False))
            pairs = [(names.setdefault(m, len(names)), float((i, j) in steps)) for i, j, m in follows(island)]
            data.append((island, [[names.setdefault(f, len(names)) for f in span_features(text, *x)] for x in island], gold, pairs))
    moves = [x for x in names if ">" in x and ":" not in x]
    w, step = np.zeros(len(names)), np.full(len(names), 1e-6)
    for _ in range(epochs):
        g = -1e-3 * w * len(data)
        now = {m: float(w[names[m]]) for m in moves}
        for island, rows, gold, pairs in data:
            p, q = marginals(island, [float(w[f].sum()) for f in rows], now)
            for f, x in zip(rows, gold - p, strict=True):
                g[f] += x
            for (f, is_step), x in zip(pairs, q, strict=True):
                g[f] += is_step - x
        step += g * g
        w += 0.5 * g / np.sqrt(step)
    return dict(zip(names, w.tolist(), strict=True))


def find_spans(text: str | None, weights: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind, then start; ends are exclusive, in code points."""
    if not text:
        return [], []
    base = base_spans(text)
    taken = [(a, b) for _, a, b in base]
    more = []
    for island in lattice(text, candidates(text, taken)):
        more += viterbi(island, [sum(weights.get(f, 0.0) for f in span_features(text, *x)) for x in island], weights)
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + more, key=lambda x: (order[x[0]], x[1], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, put as the first one's type in angle brackets."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _batches(docs: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                yield work(whole.slice(at, 1000))

    return docs.select(*columns).mapInArrow(tidied(run), schema)


def spans_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row of docs.

    The counts and base_sha256 are of the base spans; n_added counts the field's. Null and empty texts have no
    spans; every row is read for itself, so ties, repeated rows and null doc_ids stay; other columns are
    ignored; no rows give none. Texts are read whole, in time about linear in their length.
    """
    weights = train()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in batch.column(1):
            base, every = find_spans(t.as_py(), weights)
            kinds = [k for k, _, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    bare = docs.selectExpr("cast(doc_id as long) as doc_id", f"`{text}` as text")
    return _batches(bare, ["doc_id", "text"], work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its text put as its type; null texts stay null, all other columns as they are, whatever their names.

    Empty texts have no spans; each row is read for itself, so copies, repeated rows and null doc_ids stay; no rows give none.
    """
    weights = train()
    at = docs.columns.index(text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [None if t is None else redact(t, find_spans(t, weights)[1]) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array(new, columns[at].type)
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return _batches(docs, docs.columns, work, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`spans_of` all documents; odd rows as there."""
    return spans_of(table(spark, sf_dir, "documents"))
