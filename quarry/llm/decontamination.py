"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The benchmark is the query set: it is taken in blocks of a bounded number of words,
and every task holds a block while it reads the documents once. A word n-gram that a
document and an item share is a seed, however frequent; it joins the stretch of the
document around it to the item. A stretch in which even a match of every word that the
item holds would not score enough is discarded, and what is left is aligned to the
item word by word, so that copies with words changed, added or left out are scored
too. Documents are never shuffled; only scores are.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import bucket, materialize, release, split

#: Words in an n-gram; bits of a table of a block's n-grams, looked at before they are.
GRAM, TABLE_BITS = 3, 1 << 22
MASK = np.uint64(TABLE_BITS - 1)
#: Words of benchmark items in a block, about: a longer item is a block by itself.
BLOCK_WORDS = 1_000_000
#: Places of an n-gram's words, in items and documents: in a row, or one word skipped.
#: In a copy without a common n-gram, any three successive matches have two edits
#: between them, so m matches have m - 2 edits and score m + 2 at most: every copy of an
#: item of n words that scores n + 3 or more (of 2 n) has one, whatever its edits.
PATTERNS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Alignment scores, and the share of an item's full score that counts as a copy.
MATCH, MISMATCH, GAP, THRESHOLD = 2, -1, -1, 0.5
#: Words of which hashes are remembered by a task; words of windows looked at at a time.
REMEMBER, WINDOW_WORDS = 500_000, 1_000_000

TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> list[str]:
    """Words by which texts are compared: letters and digits, in lower case."""
    return TOKEN.findall(text.lower())


class Known(dict):
    """Hashes of words, made when they are first asked for."""

    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


class Hasher:
    """64-bit hashes of words and of word n-grams."""

    def __init__(self) -> None:
        self.known = Known()

    def words(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBER:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))

    @staticmethod
    def grams(words: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
        """Hash of the words at places after each word that has them."""
        n = len(words) - places[-1]
        if n <= 0:
            return np.empty(0, np.uint64)
        h = np.full(n, len(places), dtype=np.uint64)
        for k in places:
            h = (h ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h


def patterns(size: int) -> tuple[tuple[int, ...], ...]:
    """Places of the words of n-grams of size words."""
    return PATTERNS if size == GRAM else (tuple(range(size)),)


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """(best local score, end in doc) of aligning word hashes doc and item.

    Rows of the table are made one per item word; gaps along a row are a running
    maximum of the scores plus what the gaps up to there cost."""
    slope = np.arange(len(doc) + 1) * -GAP
    row, best, end = np.zeros(len(doc) + 1, dtype=np.int64), 0, 0
    for w in item:
        step = row[:-1] + np.where(doc == w, MATCH, MISMATCH)
        now = np.maximum(row + GAP, 0)
        now[1:] = np.maximum(now[1:], step)
        row = np.maximum.accumulate(now + slope) - slope
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


def span(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(best score, start, end) of the best alignment in doc, end exclusive."""
    best, end = align(doc, item)
    if not best:
        return 0, 0, 0
    back = align(doc[:end][::-1], item[::-1])[1]
    return best, end - back, end


class Block:
    """Items of a block as word hashes, and their n-grams in order of hash.

    An item of fewer than GRAM words has its whole as its one n-gram."""

    def __init__(self, texts: list[str]):
        hasher = Hasher()
        self.words = [hasher.words(tokens(t)) for t in texts]
        self.count = np.fromiter(map(len, self.words), dtype=np.int64, count=len(texts))
        self.sizes = sorted({min(GRAM, len(w)) for w in self.words if len(w)})
        own = [np.unique(np.concatenate([Hasher.grams(w, p) for p in patterns(min(GRAM, len(w)))])) if len(w) else np.empty(0, np.uint64) for w in self.words]
        grams, item = np.concatenate([*own, np.empty(0, np.uint64)]), np.repeat(np.arange(len(own)), [len(g) for g in own])
        order = np.argsort(grams, kind="stable")
        self.grams, self.item = grams[order], item[order]
        self.bits, self.holds = np.zeros(TABLE_BITS, dtype=bool), np.zeros(TABLE_BITS, dtype=bool)
        self.bits[self.grams & MASK] = True
        if len(texts):
            self.holds[self.cell(np.concatenate(self.words), np.repeat(np.arange(len(texts)), self.count))] = True

    @staticmethod
    def cell(words: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Where holds says whether items have words; it may say so of others too."""
        h = (words ^ (item.astype(np.uint64) << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(40)) & MASK

    def promising(self, words: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which windows words[low:high] may hold an alignment to item that scores least,
        by the bound of stretches(), for all windows at once."""
        out = []
        for some in np.array_split(np.arange(len(low)), 1 + int((high - low).sum()) // WINDOW_WORDS):
            n = high[some] - low[some] + 1  # a place more, at which the sum falls below all before
            window = np.repeat(np.arange(len(some)), n)
            at = np.arange(len(window)) - np.repeat(np.cumsum(n) - n - low[some], n)
            end = at == high[some][window]
            held = self.holds[self.cell(words[np.where(end, 0, at)], item[some][window])]
            total = np.cumsum(np.where(end, -MATCH * n.max(initial=0), np.where(held, MATCH, max(MISMATCH, GAP))))
            rise = total - np.minimum(np.minimum.accumulate(total), 0)
            out.append(some[np.unique(window[(rise >= least[some][window]) & ~end])])
        return np.concatenate(out)

    def seeds(self, words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of every n-gram of words that an item holds too, none of which
        reaches over into another text; text: the text of each word."""
        place, item = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for places in [p for size in self.sizes for p in patterns(size)]:
            g = Hasher.grams(words, places)
            at = np.flatnonzero(self.bits[g & MASK])
            at = at[text[at] == text[at + places[-1]]]
            low, high = np.searchsorted(self.grams, g[at], side="left"), np.searchsorted(self.grams, g[at], side="right")
            n = high - low
            place.append(np.repeat(at, n))
            item.append(self.item[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())])
        return np.concatenate(place), np.concatenate(item)


def stretches(have: np.ndarray, want: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """(start, end) of parts of have outside which no alignment to want scores least.

    A word of have that want holds adds a match at most, any other one takes off an
    edit. No alignment scores more than the sum over the words it covers, and the best
    one starts with no sum of zero or less: it is inside one rise of the running sum
    above its least value so far."""
    total = np.cumsum(np.where(np.isin(have, want), MATCH, max(MISMATCH, GAP)))
    rise = total - np.minimum(np.minimum.accumulate(total), 0)
    if rise.max(initial=0) < least:
        return
    low = np.flatnonzero(rise <= 0)
    edges = np.concatenate([[-1], low, [len(have)]])
    for k in np.unique(np.searchsorted(low, np.flatnonzero(rise >= least))):
        yield int(edges[k]) + 1, int(edges[k + 1])


def copies(block: Block, words: np.ndarray, text: np.ndarray, begin: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, score, start, words covered) of the best alignment of each text to
    each item that scores threshold of the item's full score or more.

    words: hashes of the words of texts, one after the other; begin: where each text
    begins, and the end. An alignment that scores enough covers a seed and at most as
    many words to either side as all scores could pay for."""
    place, item = block.seeds(words, text)
    if not len(place):
        return
    order = np.lexsort((place, item, text[place]))
    place, item = place[order], item[order]
    size = block.count[item]
    reach = np.ceil(size * MATCH * (1 - threshold) / -max(MISMATCH, GAP)).astype(np.int64) + size + GRAM
    owner = text[place]
    low, high = np.maximum(place - reach, begin[owner]), np.minimum(place + reach, begin[owner + 1])
    apart = np.flatnonzero((owner[1:] != owner[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])) + 1
    first, last = np.concatenate([[0], apart]), np.concatenate([apart, [len(place)]]) - 1
    owner, item, low, high = owner[first], item[first], low[first], high[last]
    best: dict[tuple[int, int], tuple] = {}
    for k in block.promising(words, item, low, high, threshold * MATCH * block.count[item]).tolist():
        at, key, want = int(low[k]), (int(owner[k]), int(item[k])), block.words[item[k]]
        have, least = words[at : int(high[k])], threshold * MATCH * len(want)
        for x, y in stretches(have, want, least):
            score, start, end = span(have[x:y], want)
            if score >= least:
                found = (score / (MATCH * len(want)), at + x + start - int(begin[key[0]]), end - start)
                if key not in best or (found[0], -found[1]) > (best[key][0], -best[key][1]):
                    best[key] = found
    for key, found in best.items():
        yield *key, *found


def blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterator[pa.Table]:
    """The items of benchmark (item, text), distinct, in blocks of about most words."""
    rows = benchmark.select(F.col(item).alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).filter("text <> ''").distinct()
    rows = materialize(rows.withColumn("words", F.size(F.split("text", r"[^\p{L}\p{N}]+"))), "benchmark")
    n = max(1, -(-(rows.agg(F.sum("words")).first()[0] or 0) // most))
    for k in range(n):
        found = rows.filter(bucket(n, F.col("item"), F.col("text")) == k).select("item", "text").toArrow()
        if found.num_rows:
            yield found
    release(rows)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, doc: str = "doc_id", item: str = "item_id", text: str = "text", threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, score, start, n_words) of documents that hold a copy of a
    benchmark item: the best alignment's share of the item's full score, threshold
    or more, and the words (letters and digits) of the document that it covers.

    docs are read once for every block_words words of the benchmark. Null and empty
    texts on either side match nothing, nor do rows whose id is null; rows that repeat
    a doc_id or item_id count as one, the best; of equal scores the first in the text
    counts; empty tables give none; other columns are left out.
    """
    kind, item_kind = docs.schema[doc].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    source = docs.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).cast("string"))

    def against(items: pa.Table) -> DataFrame:
        spread = docs.sparkSession.sparkContext.broadcast((items.column("item").combine_chunks(), items.column("text").to_pylist()))

        def run(batches):
            ids, texts = spread.value
            block, hasher = Block(texts), Hasher()
            for whole in batches:
                for b in split(whole):
                    own = [tokens(t) if t else [] for t in b.column(1).to_pylist()]
                    n = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
                    words = np.concatenate([hasher.words(w) for w in own])
                    found = list(copies(block, words, np.repeat(np.arange(len(own)), n), np.concatenate([[0], np.cumsum(n)]), threshold))
                    cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(cols[0]), ids.take(cols[1]), *cols[2:]], ["doc_id", "item_id", "score", "start", "n_words"])

        return materialize(source.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, score double, start long, n_words long"), "aligned")

    found = [against(x) for x in blocks(benchmark.filter(F.col(item).isNotNull()), item, text, block_words)]
    scored = functools.reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {item_kind}, score double, start long, n_words long")
    best = F.max(F.struct("score", (-F.col("start")).alias("back"), "n_words")).alias("b")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", (-F.col("b.back")).alias("start"), "b.n_words")
