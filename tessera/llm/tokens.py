"""Token ids of whole texts by the vocabulary of the tokenizers library, each white-space chunk encoded once a worker.

The normaliser and the splitter of the word vocabulary act within white-space chunks (white space is
dropped, no match crosses it), so a text's ids are its chunks' ids in order. Chunks of Latin-1 characters are
lowered, split and merged here, many at once; the library encodes all others.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .merges import Kept, Merges, by_bytes, raw, spread

WORD_BPE = "word_bpe_49k.json"
#: str.split() cuts at these, the vocabulary's splitter does not.
_ODD = re.compile("[\x1c-\x1f]")
#: Chunks of these are as they are when normalised, but for their case. Special tokens begin with "<|".
_LATIN = re.compile("[!-~\xa1-\xff]+")


class Encoder:
    """Texts -> their ids; white-space chunks and theirs are kept."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), Kept()
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, suffix = whole["model"], whole["model"].get("end_of_word_suffix") or ""
        split = next(x for x in whole["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.units = regex.compile(split["pattern"]["Regex"]).findall
        vocab = model["vocab"]
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.first = np.asarray([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.asarray([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left, right = (np.asarray([vocab[p[i]] for p in pairs], np.int32) for i in (0, 1))
        made = np.asarray([vocab[a + b] for a, b in pairs], np.int32)
        self.merges = Merges(left, right, made, np.arange(len(pairs)), int(max(self.first.max(), self.last.max())) + 1)

    def library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def fresh(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks, as little-endian unsigned 32-bit integers."""
        fast = [c for c in chunks if _LATIN.fullmatch(c) and "<|" not in c]
        words, mixed = [c for c in fast if c.isalpha()], [c for c in fast if not c.isalpha()]
        lower, units = [*map(str.lower, words)], [self.units(c.lower()) for c in mixed]
        distinct = list(set(lower).union(*units))
        ids = dict(zip(distinct, self.merges.many([*map(str.encode, distinct)], self.first, self.last), strict=True))
        out = dict(zip(words, map(ids.__getitem__, lower), strict=True))
        for c, own in zip(mixed, units, strict=True):
            out[c] = b"".join([ids[u] for u in own])
        return [out[c] if c in out else self.library(c) for c in chunks]

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, the ids of all); null and empty texts have none."""
        texts = texts.fill_null("")
        whole: dict[int, bytes] = {}
        if (raw(texts)[0] - np.uint8(0x1C) < 4).any():
            plain = texts.to_pylist()
            whole = {i: self.library(t) for i, t in enumerate(plain) if _ODD.search(t)}
            texts = pa.array(["" if i in whole else t for i, t in enumerate(plain)], texts.type)
        cut = pc.utf8_split_whitespace(texts)
        chunks = cut.flatten().dictionary_encode()
        counts, ids = spread(*self.kept.ids(chunks.dictionary, self.fresh), chunks.indices.to_numpy(), np.asarray(cut.offsets))
        if whole:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            parts = [np.frombuffer(whole[i], "<u4") if i in whole else x for i, x in enumerate(parts)]
            return np.asarray([len(x) for x in parts]), np.concatenate(parts)
        return counts, ids

    def texts(self, column: pa.Array) -> Iterator[tuple[int, bytes]]:
        """(row, its ids as bytes) of each text, some MB of them at a time."""
        for begin, part in by_bytes(column):
            counts, ids = self.column(part)
            packed, at = ids.tobytes(), 0
            for i, n in enumerate(counts.tolist()):
                yield begin + i, packed[at : at + 4 * n]
                at += 4 * n


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One a worker for a vocabulary file."""
    return Encoder(path)


def vocabulary(name: str = WORD_BPE) -> str:
    """The place of a public vocabulary file; callers may give any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)
