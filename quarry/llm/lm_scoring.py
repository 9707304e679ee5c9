"""Language-model scores from a hashed maximum-entropy model.

The model predicts each token of a text, and its end, from n-gram and skip
features of the words before it. The softmax is factored: first a class of words,
then a word of the class. Frequent words are dealt to classes by rank; all others
share one class, in which a word has its add-one share of the corpus counts. So
the probabilities of a context sum to one over words seen, plus one for unseen.

Features are hashed into two weight tables of fixed size, one with a column per
class, one with a column per word of a class. Training goes in rounds, each over
its own part of the training texts, so that every text is learned from once. In a
round tasks add up, for every weight, how often its feature and outcome were
observed and how often the model expected them; Spark sums both over all tasks, and
the driver takes one gradient step for the whole round: observed less expected, over
their mean (the curvature, nearly). Tasks take no steps of their own, so the model
does not depend on how texts are dealt to them. Scores are made in batches by
gathering the few rows that the features of a token name.
"""

from __future__ import annotations

import itertools
import math
import secrets
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import materialize, split

#: Classes (the first is that of all other words), words in a class, rows of the
#: class table and of the word table (powers of two), positions looked at at a time,
#: and summed up at a time.
CLASSES, MEMBERS, CLASS_ROWS, WORD_ROWS, STEP, SUMMED = 32, 32, 1 << 14, 1 << 15, 8_192, 1 << 16
#: Words before a token that features look at; rounds; the step of a round, and the
#: count by which the steps of rare features are damped. A weight moves by at most
#: 2 * RATE in a round, so no exponential of the model's overflows.
BEFORE, ROUNDS, RATE, DAMP = 3, 3, 0.5, 2.0
#: Training tokens for which a task of a round sums up tables.
TASK_TOKENS = 5_000_000
#: Words of which every task holds the counts, at most, and their longest, in bytes;
#: the others are joined.
HELD_WORDS, HELD_BYTES = 100_000, 256
#: Endings by which other words are features; distinct words a task counts at a time.
ENDINGS, AT_A_TIME = 4096, 400_000
END = b""
#: Features of the class table (all) and of the word table (the first ones).
FEATURES, WORD_FEATURES = 4, (0, 1, 3)


@dataclass
class Vocabulary:
    """words: counts of the most frequent tokens; rank: place of the model's own
    words among them; tokens, distinct: of the training texts; rest: tokens and
    distinct tokens outside the model's own words."""

    words: dict[bytes, int]
    rank: dict[bytes, int]
    tokens: int
    distinct: int
    rest: tuple[int, int]

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Biases that give every class and word its share of the corpus."""
        own = np.zeros((CLASSES, MEMBERS))
        for w, k in self.rank.items():
            own[1 + k // MEMBERS, k % MEMBERS] = self.words[w]
        mass = own.sum(axis=1)
        mass[0] = self.rest[0] + self.rest[1] + 1
        with np.errstate(divide="ignore"):
            word = np.log(own) - np.log(np.maximum(mass, 1))[:, None]
            return np.log(mass / mass.sum()).astype(np.float32), np.maximum(word, -1e4).astype(np.float32)


class Numbering:
    """Place of a word among the held ones, the model's own words first; a word that
    is not held has the place of its ending after them. Tables by place: feature,
    the number by which contexts are hashed, and logs, log10 of count + 1."""

    def __init__(self, vocabulary: Vocabulary):
        rest = [w for w in vocabulary.words if w not in vocabulary.rank]
        self.place = vocabulary.rank | {w: k for k, w in enumerate(rest, len(vocabulary.rank))}
        self.own, self.held = len(vocabulary.rank), len(self.place)
        self.pad = self.held + ENDINGS
        ends = np.arange(ENDINGS + 1) + CLASSES * MEMBERS
        self.feature = np.concatenate([np.arange(self.own), [CLASSES * MEMBERS + ending(w) for w in rest], ends]).astype(np.int64)
        counts = [vocabulary.words[w] for w in (*vocabulary.rank, *rest)]
        self.logs = np.concatenate([np.log10(np.array(counts, dtype=np.float64) + 1), np.zeros(ENDINGS + 1)])

    def places(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))
        far = np.flatnonzero(out < 0)
        out[far] = [self.held + ending(words[i]) for i in far.tolist()]
        return out


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


class Model:
    """Weight tables; biases are the vocabulary's shares."""

    def __init__(self, class_bias, word_bias, class_table=None, word_table=None):
        self.class_bias, self.word_bias = class_bias, word_bias
        self.class_table = np.zeros((CLASS_ROWS, CLASSES), np.float32) if class_table is None else class_table
        self.word_table = np.zeros((WORD_ROWS, MEMBERS), np.float32) if word_table is None else word_table

    @staticmethod
    def features(numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the features of positions at (FEATURES, positions): the word
        before, the two that skip one and two words, and the pair before."""
        w = [numbers[at - k] for k in range(1, BEFORE + 1)]
        return np.stack([mixed(w[0], 1), mixed(w[1], 2), mixed(w[2], 3), mixed(w[0] * 65_536 + w[1], 4)])

    @staticmethod
    def class_rows(hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(20)) & np.uint64(CLASS_ROWS - 1)).astype(np.int64)

    @staticmethod
    def word_rows(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        h = mixed(hashes ^ (classes.astype(np.uint64) << np.uint64(40)), 7)
        return ((h >> np.uint64(20)) & np.uint64(WORD_ROWS - 1)).astype(np.int64)

    @staticmethod
    def exponentials(table: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exponentials of the logits, their sum) of each position."""
        e = np.take(table, rows[0], axis=0)
        for r in rows[1:]:
            e += np.take(table, r, axis=0)
        e += bias
        np.exp(e, out=e)
        return e, e @ np.ones(e.shape[1], np.float32)

    def decisions(self, numbers: np.ndarray, at: np.ndarray):
        """(rows, outcome, exponentials, sum, positions) of the choice of a class at
        every position, then of a word of the class where it is the model's own."""
        h, own = self.features(numbers, at), numbers[at]
        k = np.where(own < CLASSES * MEMBERS, own // MEMBERS + 1, 0)
        rows = self.class_rows(h)
        yield rows, k, *self.exponentials(self.class_table, rows, self.class_bias), slice(None)
        known = np.flatnonzero(k)
        if len(known):
            rows = self.word_rows(h[WORD_FEATURES, :][:, known], k[known])
            yield rows, own[known] % MEMBERS, *self.exponentials(self.word_table, rows, np.take(self.word_bias, k[known], axis=0)), known

    def log_probabilities(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log of the probability of the class of each position and, for
        words of the model's own, of the word in it."""
        out = np.zeros(len(at))
        for _, outcome, e, total, where in self.decisions(numbers, at):
            out[where] += np.log(e[np.arange(len(outcome)), outcome] / total)
        return out

    def moved(self, sums: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        """This model after a gradient step on (observed, expected) of both tables."""
        step = [RATE * (o - e) / ((o + e) / 2 + DAMP) for o, e in sums]
        return Model(self.class_bias, self.word_bias, (self.class_table + step[0]).astype(np.float32), (self.word_table + step[1]).astype(np.float32))


class Sums:
    """How often features met outcomes, and how often a model expected them to."""

    def __init__(self) -> None:
        shapes = ((CLASS_ROWS, CLASSES, FEATURES), (WORD_ROWS, MEMBERS, len(WORD_FEATURES)))
        self.observed = [np.zeros(n * c, np.int64) for n, c, _ in shapes]
        # a line per outcome, as each is summed up by itself, SUMMED positions at a time
        self.expected = [np.zeros((c, n)) for n, c, _ in shapes]
        self.share = [np.empty((c, SUMMED)) for _, c, _ in shapes]
        self.row = [np.empty((f, SUMMED), np.int64) for _, _, f in shapes]
        self.held = [0, 0]

    def add(self, model: Model, numbers: np.ndarray, at: np.ndarray) -> None:
        """Add up to STEP positions at."""
        for k, (rows, outcome, e, total, _) in enumerate(model.decisions(numbers, at)):
            if self.held[k] + len(e) > SUMMED:
                self.sum_up(k)
            here = slice(self.held[k], self.held[k] + len(e))
            self.row[k][:, here] = rows
            np.divide(e.T, total, out=self.share[k][:, here])
            self.held[k] = here.stop
            for r in rows:
                np.add.at(self.observed[k], r * e.shape[1] + outcome, 1)

    def sum_up(self, k: int) -> None:
        n, self.held[k] = self.held[k], 0
        for total, p in zip(self.expected[k], self.share[k], strict=True):
            for r in self.row[k]:
                total += np.bincount(r[:n], p[:n], len(total))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, observed, expected) of every row met, those of the word table after
        those of the class table."""
        self.sum_up(0), self.sum_up(1)
        expected = np.concatenate([x.T for x in self.expected])
        row = np.flatnonzero(expected.any(axis=1))
        observed = np.concatenate([x.reshape(-1, len(y)) for x, y in zip(self.observed, self.expected, strict=True)])
        return row, observed[row], expected[row]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def token_counts(train: DataFrame) -> DataFrame:
    """(token, n): tokens of every text of train, ends as the empty token."""

    def run(batches):
        held: Counter = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "n"])
            held.clear()

        for batch in batches:
            for t in batch.column(0):
                held.update(words_of(t.as_py()))
                held[END] += 1
                if len(held) > AT_A_TIME:
                    yield from out()
        if held:
            yield from out()

    return train.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The bounded part of counts that every task holds. The least count is taken
    such that at most HELD_WORDS tokens have it; none is cut from a tie. Tokens of
    over HELD_BYTES bytes are left out."""
    of = counts.groupBy("n").agg(F.count("*").alias("k"))
    total = of.agg(F.sum(F.col("n") * F.col("k")).alias("tokens"), F.sum("k").alias("distinct")).first()
    level, held, most = None, 0, of.orderBy(F.desc("n")).limit(HELD_WORDS).collect()
    for r in most:
        if held + r["k"] > HELD_WORDS:
            break
        level, held = r["n"], held + r["k"]
    words = {} if level is None else {bytes(r["token"]): r["n"] for r in counts.filter((F.col("n") >= level) & (F.octet_length("token") <= HELD_BYTES)).collect()}
    top = sorted(words, key=lambda w: (-words[w], w))[: (CLASSES - 1) * MEMBERS]
    tokens, distinct = total["tokens"] or 0, total["distinct"] or 0
    return Vocabulary(words, {w: k for k, w in enumerate(top)}, tokens, distinct, (tokens - sum(words[w] for w in top), distinct - len(top)))


def numbered(numbering: Numbering, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, positions to predict, text of each position) of many texts in one
    array, BEFORE pads ahead of each and an end after it."""
    parts, size = [], []
    pad = np.full(BEFORE, numbering.pad, dtype=np.int64)
    end = numbering.places([END])
    for words in texts:
        parts += [pad, numbering.places(words), end]
        size.append(len(words) + 1)
    owner = np.repeat(np.arange(len(texts)), size)
    return np.concatenate(parts), np.arange(len(owner)) + BEFORE * (owner + 1), owner


def train(docs: DataFrame, vocab: Vocabulary, model: Model) -> Model:
    """model after a gradient step on all docs (one text column)."""
    spread = docs.sparkSession.sparkContext.broadcast((vocab, model))
    columns = [f"{x}{k}" for x in "oe" for k in range(max(CLASSES, MEMBERS))]

    def run(batches):
        vocab, model = spread.value
        numbering, sums = Numbering(vocab), Sums()
        for batch in batches:
            for b in split(batch):
                places, at, _ = numbered(numbering, [words_of(t) for t in b.column(0).to_pylist()])
                numbers = numbering.feature[places]
                for k in range(0, len(at), STEP):
                    sums.add(model, numbers, at[k : k + STEP])
        row, observed, expected = sums.rows()
        cells = np.concatenate([observed, expected], axis=1, dtype=np.float32, casting="unsafe")
        for k in range(0, len(row), STEP):
            own = np.ascontiguousarray(cells[k : k + STEP].T)
            yield pa.RecordBatch.from_arrays([pa.array(row[k : k + STEP], pa.int32()), *map(pa.array, own)], ["row", *columns])

    parts = docs.mapInArrow(run, "row int, " + ", ".join(f"{c} float" for c in columns))
    found = parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()  # at most a row for each of the tables'
    cells = np.zeros((CLASS_ROWS + WORD_ROWS, len(columns)))
    cells[found.column("row").to_numpy()] = np.stack([found.column(c).to_numpy() for c in columns], axis=1)
    observed, expected = np.split(cells, 2, axis=1)
    return model.moved([(observed[:CLASS_ROWS, :CLASSES], expected[:CLASS_ROWS, :CLASSES]), (observed[CLASS_ROWS:, :MEMBERS], expected[CLASS_ROWS:, :MEMBERS])])


def score(docs: DataFrame, *, doc: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of
    every row of docs; see op5 for base_score. score is the model's log10
    probability of the whole text and its end.

    held_out: crc32 of doc_id as text leaves held after division by folds; such
    rows are not learned from. A null doc_id is not held out. A null text counts
    as empty: one token, its end. Repeated rows each give a row and are learned
    from as often; an empty table gives none; other columns are left out. If no
    row is left to learn from, every token has probability one over one.
    """
    kind = docs.schema[doc].dataType.simpleString()
    is_held = F.coalesce(F.crc32(F.col(doc).cast("string")) % folds == held, F.lit(False))
    learn = docs.filter(~is_held)
    turn = F.pmod(F.xxhash64(doc, text), F.lit(ROUNDS))
    counts = materialize(token_counts(learn.select(F.col(text).cast("string"))), "token-counts")
    vocab = vocabulary(counts)
    model = Model(*vocab.starts())
    # as each task sends tables of the model's size, their number follows the tokens
    tasks = -(-vocab.tokens // (ROUNDS * TASK_TOKENS))
    for k in range(ROUNDS if vocab.tokens else 0):
        model = train(learn.filter(turn == k).select(F.col(text).cast("string")).coalesce(tasks), vocab, model)
    spread = docs.sparkSession.sparkContext.broadcast((vocab, model))
    base_of, rest_of = math.log10(vocab.tokens + vocab.distinct + 1), math.log10(vocab.rest[0] + vocab.rest[1] + 1)

    def run(batches):
        vocab, model = spread.value
        numbering = Numbering(vocab)
        for batch in batches:
            for b in split(batch):
                texts = [words_of(t) for t in b.column(2).to_pylist()]
                places, at, owner = numbered(numbering, texts)
                numbers, own = numbering.feature[places], places[at]
                total = np.zeros(len(texts))
                for k in range(0, len(at), STEP):
                    total += np.bincount(owner[k : k + STEP], model.log_probabilities(numbers, at[k : k + STEP]), minlength=len(texts))
                per_text = lambda x: np.bincount(owner, x, minlength=len(texts))  # noqa: B023, E731
                logs, outside, far = numbering.logs[own], own >= numbering.own, own >= numbering.held
                rest, n = per_text(outside), np.array([len(w) + 1 for w in texts])
                token, times = [], []
                place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                for words, some in zip(texts, np.split(place[far], np.cumsum(per_text(far))[:-1].astype(int)), strict=True):
                    count = Counter(words[i] if i < len(words) else END for i in some.tolist())
                    token.append(list(count))
                    times.append(list(count.values()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([secrets.randbits(63) for _ in texts]), pa.array(n), pa.array(per_text(~far).astype(np.int64)),
                     pa.array(per_text(logs) - n * base_of), pa.array(total / math.log(10) + per_text(logs * outside) - rest * rest_of),
                     pa.array(token, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                    ["doc_id", "held_out", "row", "n_tokens", "n_known", "base_score", "score", "token", "times"],
                )

    near = docs.select(F.col(doc).alias("doc_id"), is_held.alias("held_out"), F.col(text).cast("string")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double, token array<binary>, times array<long>"
    )
    near = materialize(near, "scores")
    # words that tasks do not hold: those never seen add nothing to the sums
    far = near.select("row", F.explode(F.arrays_zip("token", "times")).alias("x")).select("row", "x.token", "x.times").join(counts, "token")
    far = far.groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    added = F.coalesce("logs", F.lit(0.0))
    return near.join(far, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + added).alias("base_score"), (F.col("score") + added).alias("score"),
    )
