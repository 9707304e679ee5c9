"""The nearest vectors of each question, by every pair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors and questions that meet in one task at once; what it holds follows from them
#: alone. Scores are compared in tiles of so many.
ROWS, QUESTIONS, TILE = 16_384, 4_096, 2_000_000
#: Decimals of a score.
DIGITS = 6
#: Tasks at most that groups are dealt to.
TASKS = 2_000


def nearest(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(question, target, score, gold): of each question the k targets with the largest
    dot product, rounded to DIGITS, ties by target.

    vectors (target, vector, label), questions (question, vector, label); target and
    question are whole numbers, a question is no target of its own. gold: whether the
    labels are equal. Scores of null vectors are null and come last. Every pair is
    compared: blocks of vectors meet blocks of questions, each in a group of its own."""
    sides = []
    for side, key, most in ((vectors, "target", ROWS), (questions, "question", QUESTIONS)):
        rows = side.select(F.col(key).cast("long").alias("id"), "vector", "label").filter("id IS NOT NULL")
        sides.append((rows, max(1, -(-rows.count() // most))))
    (v, n_v), (q, n_q) = sides
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    v = v.select(block(n_v).alias("row"), every(n_q).alias("column"), "*")
    # under names of their own: of columns that both sides share, Spark can leave out one side's
    q = q.select(every(n_v).alias("q_row"), block(n_q).alias("q_column"), *(F.col(c).alias(f"q_{c}") for c in q.columns))
    # by number, else small blocks would share few tasks
    dealt = lambda side, *cell: side.repartition(min(TASKS, n_v * n_q), *cell).groupBy(*cell)
    met = dealt(v, "row", "column").cogroup(dealt(q, "q_row", "q_column"))
    best = met.applyInArrow(lambda a, b: best_pairs(a, b.rename_columns([c.removeprefix("q_") for c in b.column_names]), k), "question long, target long, score double, gold boolean")
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc_nulls_last("score"), "target"))
    return best.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def matrices(*columns: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each column its vectors as rows, and which are null (zeros here)."""
    sizes = {n for c in columns for n in pc.unique(pc.list_value_length(c.drop_null())).to_pylist()}
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(sizes)}")
    width, out = max(sizes, default=0), []
    for c in columns:
        values, null = pc.list_flatten(c), pc.is_null(c).to_numpy()
        if values.null_count:
            raise ValueError("a vector holds a null")
        rows = np.zeros((len(c), width))
        rows[~null] = pc.cast(values, pa.float64()).to_numpy().reshape(-1, width)
        out.append((rows, null))
    return out


def first_copies(ids: np.ndarray, rows: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows of which some question can need its k best: of equal vectors,
    whose scores are equal, those of the first k ids and of one that may be the question.
    ids in order."""
    same = np.unique(np.ascontiguousarray(np.c_[rows, null]).view(f"V{8 * rows.shape[1] + 8}").ravel(), return_inverse=True)[1]
    by_copy = np.argsort(same, kind="stable")
    same, ids = same[by_copy], ids[by_copy]
    opens = np.r_[True, same[1:] != same[:-1]]
    count = np.cumsum(opens | np.r_[True, ids[1:] != ids[:-1]])  # of ids, one after another
    return np.sort(by_copy[count - count[np.flatnonzero(opens)][np.cumsum(opens) - 1] <= k])


def rounded(x: np.ndarray) -> np.ndarray:
    """x to DIGITS decimals, halves away from zero, as SQL's round() of a double has it."""
    y = x * 10.0**DIGITS
    whole = np.trunc(y)
    out = (whole + np.where(np.abs(y - whole) >= 0.5, np.copysign(1.0, y), 0.0)) / 10.0**DIGITS
    return np.where(np.isfinite(out), out, x)


@np.errstate(all="ignore")
def best_pairs(a: pa.Table, b: pa.Table, k: int) -> pa.Table:
    """The k best targets of a for each question of b. A product of matrices finds those
    that can be among them; their scores are then added up in order, as SQL does."""
    found = [[np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0)], [np.zeros(0, bool)]]
    if len(a) and len(b):
        a = a.sort_by("id")
        targets, asked = a["id"].to_numpy(), b["id"].to_numpy()
        (v, v_null), (q, q_null) = matrices(a["vector"], b["vector"])
        kept = first_copies(targets, v, v_null, k)
        a, targets, v, v_null = a.take(kept), targets[kept], v[kept], v_null[kept]
        by_place, width = (np.ascontiguousarray(v.T), np.ascontiguousarray(q.T)), v.shape[1]
        # what rounding to digits and the order of adding can change, twice over
        size = lambda x: np.sqrt((x * x).sum(axis=1))
        slack = 2 * 10.0**-DIGITS + 8 * (width + 4) * 2.0**-53 * size(q) * size(v).max()
        step = max(1, TILE // len(targets))
        for at in range(0, len(asked), step):
            part = slice(at, at + step)
            s = q[part] @ v.T
            s[:, v_null], s[q_null[part]] = -np.inf, -np.inf
            first, last = (np.searchsorted(targets, asked[part], side) for side in ("left", "right"))
            for i in np.flatnonzero(last > first):
                s[i, first[i] : last[i]] = -np.inf
            least = np.partition(s, len(targets) - k, axis=1)[:, len(targets) - k] if len(targets) > k else np.full(len(s), -np.inf)
            i, j = np.nonzero(~(s < (least - slack[part])[:, None]))  # not below: keeps what is no number
            i, j = (x[targets[j] != asked[at + i]] for x in (i, j))
            score = np.zeros(len(i))
            for of_v, of_q in zip(*by_place):
                score += of_q[at + i] * of_v[j]
            null = v_null[j] | q_null[at + i]
            score = np.where(null, 0.0, rounded(score))
            odd = np.isnan(score)  # the largest, as SQL orders
            order = np.lexsort((j, np.where(odd, 0, -score), ~odd, null, i))
            order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < k]
            for x, y in zip(found, (at + i[order], j[order], score[order], null[order])):
                x.append(y)
        i, j, score, null = map(np.concatenate, found)
        gold = pc.fill_null(pc.equal(b["label"].take(i), a["label"].take(j)), False)
        question, target = asked[i], targets[j]
    else:
        question, target, score, null = (x[0] for x in found)
        gold = pa.array([], "bool")
    return pa.table({"question": question, "target": target, "score": pa.array(score, mask=null), "gold": gold})
