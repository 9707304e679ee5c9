"""Quality classifier: regularised quadratic discriminant analysis.

Transformed statistics of whole texts are modelled by one Gaussian per class.
Class covariances are shrunk towards the pooled one and towards a multiple of
the identity; a score is the logistic of the difference of two log densities,
each a Mahalanobis distance through a Cholesky factor made once.

Means and covariances come from moments that every task adds up over its own
labelled rows; the driver gets one row of moments per class, of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import materialize, per_text

FEATURES = (
    "log_words", "word_length", "word_length_spread", "upper", "digits", "symbols", "marks", "bangs", "pipes",
    "distinct_words", "top_word", "repeat_next", "dup_lines", "line_words", "sentence_words", "non_ascii",
)
UPPER = bytes(range(65, 91))
DIGIT = b"0123456789"
#: Shares of the pooled covariance and of its diagonal in a class covariance, chosen by
#: five folds within the rows that are not held out.
POOLED, RIDGE = 0.8, 0.001
#: Log-density differences are divided by this before the logistic: features of
#: one text depend on each other, so plain differences are overconfident.
TEMPERATURE = 2.0


def logit(share: float, n: float) -> float:
    """Log odds of a share among n, with half a case added to either side."""
    k = share * n
    return float(np.log((k + 0.5) / (n - k + 0.5)))


def statistics(text: str) -> list[float]:
    """FEATURES of a whole text. An empty text gives those of no words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    size = np.fromiter(map(len, words), dtype=np.float64, count=n) if n else np.zeros(1)
    chars = max(1.0, float(size.sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    near = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    count = lambda letters: len(raw) - len(raw.translate(None, letters))
    share = lambda k: logit(min(1.0, k / chars), chars)
    ends = count(b".!?")
    rest = raw.translate(None, bytes(range(128)))
    return [
        float(np.log1p(n)), float(np.log1p(size.mean())), float(np.log1p(size.std())),
        share(count(UPPER)), share(count(DIGIT)), share(count(b"#*$%&<>@^~_={}[]\\/")), share(count(b".,;:?\"'()-")), share(count(b"!")), share(count(b"|")),
        logit(len(counts) / max(1, n), max(1, n)), logit(max(counts.values(), default=0) / max(1, n), max(1, n)), logit(near / max(1, n), max(1, n)),
        logit(1 - len(set(lines)) / max(1, len(lines)), max(1, len(lines))), float(np.log1p(n / max(1, len(lines)))), float(np.log1p(n / max(1, ends))),
        share(len(rest)),
    ]


def document_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep columns and x, the array of FEATURES of every whole text."""

    def make():
        return lambda texts: {"x": [statistics(t) for t in texts]}

    return per_text(docs, keep, text, make, "x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, then 1): mean, lower Cholesky factor, and the log density's
    constant with the class's prior."""

    mean: np.ndarray
    factor: np.ndarray
    constant: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row of x."""
        log = []
        for k in (0, 1):
            z = np.linalg.solve(self.factor[k], (x - self.mean[k]).T)
            log.append(self.constant[k] - 0.5 * (z * z).sum(axis=0))
        return 1.0 / (1.0 + np.exp(np.clip((log[0] - log[1]) / TEMPERATURE, -500, 500)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """{class: (rows, sums, sums of products)} of labelled (y int, x array)."""
    d = len(FEATURES)
    width = d + d * d

    def run(batches):
        import pyarrow as pa

        total = np.zeros((2, width + 1))
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["y", "m"])

    parts = labelled.select(F.col("y").cast("int"), "x").mapInArrow(run, "y int, m array<double>")
    # summed place by place: a fixed number of rows, however many tasks there are
    sums = parts.select("y", F.posexplode("m")).groupBy("y", "pos").agg(F.sum("col").alias("v")).collect()
    out = np.zeros((2, width + 1))
    for r in sums:
        out[r["y"], r["pos"]] = r["v"]
    return {k: (out[k, 0], out[k, 1 : d + 1], out[k, d + 1 :].reshape(d, d)) for k in (0, 1)}


def fit(labelled: DataFrame, pooled: float = POOLED, ridge: float = RIDGE) -> Discriminant:
    """Discriminant of labelled (y int: 0 or 1, x array). A class without rows
    has the other's mean and covariance; without any rows both are standard."""
    found, d = moments(labelled), len(FEATURES)
    n = np.array([found[0][0], found[1][0]])
    total = [found[0][i] + found[1][i] for i in range(3)]

    def covariance(rows: float, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not rows:
            return np.zeros(d), np.eye(d)
        mean = sums / rows
        return mean, squares / rows - np.outer(mean, mean)

    every_mean, every = covariance(*total)
    if total[0]:
        own = [covariance(*found[k]) if n[k] else (every_mean, every) for k in (0, 1)]
        within = sum(n[k] / total[0] * own[k][1] for k in (0, 1))
    else:
        own, within = [(every_mean, every)] * 2, every
    mean, factor, constant = [], [], []
    for k in (0, 1):
        s = (1 - pooled) * own[k][1] + pooled * within
        scale = np.diag(np.maximum(np.diag(within), 1e-3))
        s = (1 - ridge) * s + ridge * scale
        root = np.linalg.cholesky(s)
        mean.append(own[k][0])
        factor.append(root)
        constant.append(-np.log(np.diag(root)).sum() + np.log((n[k] + 1) / (total[0] + 2)))
    return Discriminant(np.array(mean), np.array(factor), np.array(constant))


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs.

    held_out: crc32 of doc_id as text leaves held after division by folds; labels
    of such rows are not learned from. A null doc_id is not held out and has no
    label. A null text is scored as empty; labels other than 0 and 1 are left
    out; a doc_id with several labels, or several rows, counts each of them;
    repeated rows each give a row; without any label every score is 0.5.
    """
    stats = materialize(document_statistics(docs, ["doc_id"]), "quality-statistics")
    is_held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))
    known = labels.select("doc_id", F.col(label).alias("y")).filter(F.col("y").isin(0, 1) & ~is_held)
    model = fit(known.join(stats, "doc_id").select("y", "x"))
    spread = stats.sparkSession.sparkContext.broadcast(model)
    d = len(FEATURES)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            score = spread.value.score(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", is_held.alias("held_out"), "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
