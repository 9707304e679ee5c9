"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Rules are predicates on a text. Their cost and their rejection rate are measured on
a sample, and a CASE expression tries them in the order of rejections per unit of
cost: Spark evaluates a branch only where all before it let the row pass. So a text
that a cheap rule rejects is not split into words, and word windows are made only for
texts that nothing cheaper rejects. The order changes the work, never the verdict, as
a row is rejected if any rule rejects it.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import SPACE, WORD, let, materialize, release

SYMBOLS = "#*$%&|<>"
#: Rows of the sample, about; characters of a sampled text by which costs are
#: estimated, and only they; seconds that an estimate takes at least.
SAMPLE_ROWS, SAMPLE_CHARS, LEAST_SECONDS = 200, 20_000, 0.1
#: Words in a window of which two equal ones count as repetition.
WINDOW = 8


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def n_dup_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier one."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(without(x, SPACE)) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that occur twice or more, each word counted once.

    Windows are compared by a 64-bit hash of their words' 64-bit hashes. Most texts
    have no equal ones, which a hash set of them shows. For the others, sorting
    brings equal ones together, and the places of those with an equal neighbour
    are joined, each adding at most window words beyond the place before it.
    """

    def repeated(keys: Column) -> Column:
        placed = F.sort_array(F.transform(keys, lambda x, i: F.struct(x.alias("a"), i.alias("i"))))
        same = lambda s, x, k: F.coalesce(F.get(s, k)["a"] == x["a"], F.lit(False))
        starts = let(placed, lambda s: F.transform(s, lambda x, k: F.when(same(s, x, k - 1) | same(s, x, k + 1), x["i"])))
        return F.sort_array(F.filter(starts, lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
        step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(window), x - acc["last"])).alias("n"), x.alias("last"))
        return F.aggregate(p, zero, step, lambda acc: acc["n"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window))))
    count = let(windows, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(repeated(k))))
    return F.when(F.size(words) > window, count).otherwise(F.lit(0)).cast("long")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def share_of(chars: str, text: Column) -> Column:
    return F.length(text) - F.length(without(text, chars))


class Seen:
    """What rules look at: expressions on a text (not null) and its words, each
    evaluated only where a rule that is tried uses it."""

    def __init__(self, text: Column, words: Column | None = None):
        self.text = text
        self.words = words_of(text) if words is None else words

    @property
    def n_words(self) -> Column:
        return F.size(self.words).cast("long")

    @property
    def word_chars(self) -> Column:
        return F.length(without(self.text, SPACE)).cast("long")

    @property
    def n_symbols(self) -> Column:
        return share_of(SYMBOLS, self.text).cast("long")

    @property
    def n_dup_lines(self) -> Column:
        return n_dup_lines(self.text)

    @property
    def n_repeat_words(self) -> Column:
        return n_repeat_words(self.words)


class Made:
    """The same, as columns of features() that are there already."""

    def __init__(self, made: Column):
        self.text = made["text"]
        for name in FEATURES:
            setattr(self, name, made[name])


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """rejects: a predicate on Seen or Made; null does not reject. by_words: whether
    it needs the words of a text."""

    name: str
    rejects: Callable[[Seen | Made], Column]
    by_words: bool = False


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The rules whose failing is reported as base_failed.
BASE = (
    Rule("few words", lambda x: x.n_words < 20, True),
    Rule("repeated words", lambda x: 100 * x.n_repeat_words > 30 * x.n_words, True),
)
#: Thresholds far from prose: clean text has few symbols, mostly small letters,
#: words of ordinary length, and rarely the same line twice.
RULES = (
    Rule("symbols", lambda x: 10 * x.n_symbols > 3 * x.n_words, True),
    Rule("duplicate lines", lambda x: let(x.n_dup_lines, lambda n: (n >= 3) & (2 * n > F.size(F.split(x.text, "\n", -1))))),
    Rule("word length", lambda x: let(x.word_chars, lambda n: (n > 25 * x.n_words) | (n < 2 * x.n_words)), True),
    Rule("capitals", lambda x: 2 * share_of(UPPER, x.text) > x.word_chars),
    Rule("exclamations", lambda x: 10 * share_of("!", x.text) > 3 * x.n_words, True),
)


def sampled(docs: DataFrame, text: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text (null: empty) of about so many rows, each as likely as any other, one
    partition; SAMPLE_CHARS characters of each."""
    found = docs.select(F.left(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(SAMPLE_CHARS)).alias("text"))
    n = docs.count()
    if n > rows:
        found = found.sample(min(1.0, (rows + 3 * rows**0.5) / n), seed=42).limit(2 * rows)
    return materialize(found.coalesce(1), "rules-sample")


def order_rules(sample: DataFrame, rules: tuple[Rule, ...] = BASE + RULES) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, rejected share) by rejected share per second, on a sample
    of texts. Rows are repeated until a rule takes LEAST_SECONDS more than a pass that
    only reads them. An empty sample leaves the order as given."""
    total = sample.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    seen = Seen(F.col("text"))

    def timed(predicate: Column, times: int) -> tuple[float, int]:
        rows = sample.select("text", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("again"))
        began = time.perf_counter()
        n = rows.select(F.count_if(predicate).alias("n")).first()["n"]
        return time.perf_counter() - began, n // times

    @functools.cache
    def reading(times: int) -> float:
        return min(timed(F.length("text") < 0, times)[0] for _ in range(2))

    def cost(rule: Rule) -> tuple[float, int]:
        predicate = rule.rejects(seen)
        for times in (1, 8, 64, 512):
            looks = [timed(predicate, times) for _ in range(2)]
            took = min(x for x, _ in looks) - reading(times)
            if took >= LEAST_SECONDS:
                break
        return max(took, 1e-4) / (times * total), looks[0][1]

    timed(any_of(rules, seen), 1)  # so that the first rule does not pay for compiling what all need
    found = [(r, *cost(r)) for r in rules]
    return sorted(((r, c, n / total) for r, c, n in found), key=lambda x: -x[2] / x[1])


def cascade(order: list[Rule], seen: Seen | Made) -> Column:
    """Name of the rule that rejects a row, tried in this order; null if none. Texts
    are split into words where the first rule that needs them is reached, once."""
    if not order:
        return F.lit(None).cast("string")

    def tried(some: list[Rule], seen: Seen | Made, rest: Column | None = None) -> Column:
        out = F
        for r in some:
            out = out.when(F.coalesce(r.rejects(seen), F.lit(False)), F.lit(r.name))
        return rest if out is F else out.otherwise(rest)

    first = next((k for k, r in enumerate(order) if r.by_words), len(order))
    if isinstance(seen, Made) or first == len(order):
        return tried(order, seen)
    return tried(order[:first], seen, let(seen.words, lambda w: tried(order[first:], Seen(seen.text, w))))


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns and __made, a struct of the text (null: empty) and FEATURES."""
    base = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    seen = Seen(F.col("__text"))
    of_words = lambda w: F.struct(*(getattr(Seen(F.col("__text"), w), x).alias(x) for x in ("n_words", "n_repeat_words")))
    made = let(seen.words, of_words)
    rest = [getattr(seen, x).alias(x) for x in ("word_chars", "n_symbols", "n_dup_lines")]
    # made by a generator of one row: a later filter on features is not pushed below
    # it, where every use of a feature would compute it again
    made = F.explode(F.array(F.struct(F.col("__text").alias("text"), made.alias("w"), *rest))).alias("__f")
    found = base.select(*keep, made)
    return found.select(*keep, F.struct("__f.text", "__f.w.n_words", "__f.word_chars", "__f.n_symbols", "__f.n_dup_lines", "__f.w.n_repeat_words").alias("__made"))


def any_of(rules: tuple[Rule, ...], seen: Seen | Made) -> Column:
    return cascade(list(rules), seen).isNotNull()


def judge(docs: DataFrame, *, keep: list[str] = ("doc_id",), text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """keep columns, FEATURES, base_failed and kept of every row. Features are made for
    every row, as they are returned; the cascade is over the rules beside the base
    ones. Where only the verdict is wanted, passing() does less.

    The rules' order comes from a sample of about sample_rows rows, of which
    SAMPLE_CHARS characters are looked at; neither can change a verdict. A null text
    counts as empty and fails the base rules; repeated rows each give a row; an empty
    table gives none; columns not in keep are left out. A keep column with the name of
    a column that is returned raises ValueError.
    """
    keep = list(keep)
    if clash := {*FEATURES, "base_failed", "kept"}.intersection(keep):
        raise ValueError(f"names taken by the result: {sorted(clash)}")
    sample = sampled(docs, text, sample_rows)
    order = [r for r, _, _ in order_rules(sample, rules)]
    release(sample)
    made = Made(F.col("__made"))
    found = features(docs, keep, text).select(*keep, "__made", any_of(BASE, made).alias("__failed"))
    kept = F.when(F.col("__failed"), F.lit(False)).otherwise(cascade(order, made).isNull())
    return found.select(*keep, *(F.col("__made")[x].alias(x) for x in FEATURES), F.col("__failed").alias("base_failed"), kept.alias("kept"))


def passing(docs: DataFrame, *, text: str = "text", rules: tuple[Rule, ...] = BASE + RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that no rule rejects.

    The verdict is judge()'s; the whole cascade is lazy. Null and empty texts have
    few words and are rejected; repeated rows stay or go together; an empty table
    gives none; as no column is added, no name can clash.
    """
    sample = sampled(docs, text, sample_rows)
    order = [r for r, _, _ in order_rules(sample, rules)]
    release(sample)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.filter(cascade(order, Seen(whole)).isNull())
