"""Token counts of byte-level BPE, by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch are held as one flat array of symbols with the sequence
each belongs to. In a step every sequence applies its own lowest-ranked pair, at
all its places at once; sequences without a known pair are done. What survives
is counted. Counts of short pre-tokens are kept in a bounded table per task.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from quarry.llm.shared import per_text

NO_RANK = np.iinfo(np.int32).max
#: Pre-tokens of up to so many characters are remembered, so many at most.
REMEMBER_CHARS, REMEMBER = 48, 400_000
#: A text of so many characters yields its pre-tokens in parts of AT_A_TIME.
LONG_TEXT, AT_A_TIME = 2_000_000, 200_000
#: The pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable
    Latin-1 stands for itself, the others follow from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Merges:
    """Merge table of a byte-level BPE file as sorted numpy arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.base = len(vocab) + len(self.specials) + 1
        self.first = np.array([vocab.get(c, self.base - 1) for c in byte_letters()], dtype=np.int64)
        key = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key)
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count(self, pieces: Iterable[str]) -> list[int]:
        """Symbols that remain of each pre-token."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        size = np.array([len(b) for b in raw], dtype=np.int64)
        out, alive = size.copy(), np.flatnonzero(size > 1)
        sym = self.first[np.frombuffer(b"".join(raw[i] for i in alive), dtype=np.uint8)]
        size = size[alive]
        while len(alive):
            seq = np.repeat(np.arange(len(alive)), size)
            start = np.cumsum(size) - size
            ranks = np.full(len(sym), NO_RANK, dtype=np.int32)
            ranks[:-1] = self.rank(sym[:-1], sym[1:])
            ranks[start + size - 1] = NO_RANK
            low = np.minimum.reduceat(ranks, start)
            hit = (ranks == low[seq]) & (ranks != NO_RANK)
            # of pairs that overlap (aaa), every other one from the left
            place = np.arange(len(sym))
            run = np.maximum.accumulate(np.where(hit, -1, place))
            at = np.flatnonzero(hit & ((place - run) % 2 == 1))
            sym[at] = self.made[ranks[at]]
            stay = np.ones(len(sym), dtype=bool)
            stay[at + 1] = False
            size = size - np.bincount(seq[at], minlength=len(alive))
            out[alive] = size
            on = (low != NO_RANK) & (size > 1)
            sym = sym[stay & on[seq]]
            alive, size = alive[on], size[on]
        return out.tolist()


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Counts of whole texts; special strings in a text are one token each."""

    def __init__(self, path: str):
        self.table, self.known = merges(path), {}
        self.pieces = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, self.table.specials))) if self.table.specials else None

    def batch(self, texts: list[str]) -> list[int]:
        """Token counts of texts. Pre-tokens of many short texts are counted
        together, as the merging steps cost the same for few as for many."""
        out, held, chars = [], [], 0
        for t in texts:
            parts = self.special.split(t) if self.special else [t]
            extra = len(parts) - 1
            if len(t) >= LONG_TEXT:
                held.append((extra + sum(self.long(p) for p in parts), []))
            else:
                held.append((extra, [x for p in parts for x in self.pieces.findall(p)] if extra else self.pieces.findall(t)))
                chars += len(t)
            if chars >= LONG_TEXT:
                out += self.flush(held)
                held, chars = [], 0
        return out + self.flush(held)

    def flush(self, held: list[tuple[int, list[str]]]) -> list[int]:
        long = self.learn(set().union(*(p for _, p in held)))
        if long:
            return [n + sum(self.known[p] if p in self.known else long[p] for p in pieces) for n, pieces in held]
        return [n + sum(map(self.known.__getitem__, pieces)) for n, pieces in held]

    def long(self, text: str) -> int:
        found, total = (m.group() for m in self.pieces.finditer(text)), 0
        while some := list(itertools.islice(found, AT_A_TIME)):
            total += self.flush([(0, some)])[0]
        return total

    def learn(self, pieces: set[str]) -> dict[str, int]:
        """Count the pre-tokens not known yet; returns those too long to be kept."""
        new = list(pieces.difference(self.known))
        if len(self.known) > REMEMBER:
            self.known.clear()
            new = list(pieces)
        got = dict(zip(new, self.table.count(new), strict=True))
        self.known.update((p, n) for p, n in got.items() if len(p) <= REMEMBER_CHARS)
        return {p: n for p, n in got.items() if len(p) > REMEMBER_CHARS}


def count_tokens(docs: DataFrame, tokenizer: str, *, keep: list[str] = ("doc_id",), text: str = "text", limit: int = 1024) -> DataFrame:
    """keep columns, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    A null text counts as empty (0 bytes, 0 tokens, not over the limit); repeated
    rows each give a row; an empty table gives none; columns not in keep are left
    out, so their names cannot clash. tokenizer is the path of a byte-level BPE
    file that every executor can read.
    """

    def make():
        counter = Counter(tokenizer)

        def run(texts: list[str]) -> dict:
            n = counter.batch(texts)
            return {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return run

    return per_text(docs, list(keep), text, make, "n_bytes long, n_tokens long, over_limit boolean")
