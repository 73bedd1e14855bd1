"""Quality by regularised quadratic discriminant analysis.

A document becomes some twenty statistics of its text, transformed to be roughly normal. For
each class the mean and covariance come from sums of first and second powers, which Spark
adds up over all labelled rows; nothing is sampled. A class covariance is shrunk towards the
pooled one and that towards its diagonal. A score is the difference of the two Gaussian
log-densities, whose Mahalanobis distances use Cholesky factors computed once per model, put
through the logistic function.

Edge cases: null and empty texts have defined statistics and so a score; a null ``doc_id`` is
scored and never learned from; repeated ids teach as often as they stand in the documents; with
only one class learned all scores are that class's; without labels they are 0.5; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches, slices, text_of

#: Shrinkage of a class covariance towards the pooled one, and of that towards its diagonal.
TO_POOLED, TO_DIAGONAL, FLOOR = 0.2, 0.1, 1e-4
_UP, _DIGIT, _MARK = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>"
_STOP, _LOUD, _LETTER = b".,;:", b"!?", bytes([*range(65, 91), *range(97, 123), *range(128, 256)])
NAMES = ("size", "word_length", "upper", "digit", "mark", "bar", "stop", "loud", "letter", "distinct", "top_word", "lines", "dup_lines", "line_size", "dup_pairs", "long_words", "other")
D = len(NAMES)


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, transformed."""
    raw = text.encode()
    n = max(1, len(raw))
    count = lambda table: len(raw) - len(raw.translate(None, table))
    words = text.split()
    w = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    share = lambda k, of: float(np.sqrt(k / of))
    counts = Counter(words)
    upper, digit, mark, stop, loud, letter = (count(t) for t in (_UP, _DIGIT, _MARK, _STOP, _LOUD, _LETTER))
    pairs = max(1, len(words) - 1)
    return [
        float(np.log1p(len(words))),
        float(np.log1p(sum(map(len, words)) / w)),
        share(upper, n),
        share(digit, n),
        share(mark, n),
        share(raw.count(b"|"), n),
        share(stop, n),
        share(loud, n),
        share(letter, n),
        share(len(counts), w),
        share(max(counts.values(), default=0), w),
        float(np.log1p(len(lines))),
        share(len(lines) - len(set(lines)), max(1, len(lines))),
        float(np.log1p(len(raw) / max(1, len(lines)))),
        share(pairs - len(set(zip(words, words[1:], strict=False))) if len(words) > 1 else 0, pairs),
        share(sum(len(x) > 14 for x in words), w),
        share(max(0, n - upper - digit - mark - stop - loud - letter), n),
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, s0 .. ): a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t.as_py()) for t in batch[1]]).reshape(batch.num_rows, D)
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array(x[:, k]) for k in range(D))], ["doc_id", *(f"s{k}" for k in range(D))])

    modest_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"s{k} double" for k in range(D)))


@dataclass
class Discriminant:
    """Two Gaussians: log prior less half the log determinant, mean, inverse Cholesky factor."""

    offsets: tuple[float, float]
    means: np.ndarray | None = None
    factors: np.ndarray | None = None

    def log_density(self, x: np.ndarray, k: int) -> np.ndarray:
        z = (x - self.means[k]) @ self.factors[k].T
        return self.offsets[k] - 0.5 * (z * z).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if self.means is None:
            return np.full(len(x), self.offsets[1])
        return 1 / (1 + np.exp(-np.clip(self.log_density(x, 1) - self.log_density(x, 0), -50, 50)))


def solve(n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
    """From counts (2), sums (2, D) and sums of products (2, D, D) of the classes 0 and 1."""
    if n.min() < 2:
        only = 0.5 if n.sum() == 0 or n[0] == n[1] else float(n[1] > n[0])
        return Discriminant((1 - only, only))
    means = sums / n[:, None]
    own = [products[k] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
    factors, offsets = [], []
    for k in (0, 1):
        c = (1 - TO_POOLED) * own[k] + TO_POOLED * pooled + FLOOR * np.eye(len(pooled))
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.solve(lower, np.eye(len(c))))
        offsets.append(float(np.log(n[k] / n.sum()) - np.log(np.diag(lower)).sum()))
    return Discriminant(tuple(offsets), means, np.array(factors))


def train(statistics_: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """statistics_: of with_statistics(); labels: (doc_id, label). Only 2 x D x D numbers are collected."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y"))
    both = statistics_.join(known, "doc_id")
    cells = [(i, j) for i in range(D) for j in range(i + 1)]
    rows = both.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f"s{i}") for i in range(D)]).alias("sums"), F.array(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in cells]).alias("products")
    )
    n, sums, products = np.zeros(2), np.zeros((2, D)), np.zeros((2, D, D))
    for r in rows.collect():
        n[r.y], sums[r.y] = r.n, r.sums
        for (i, j), v in zip(cells, r.products, strict=True):
            products[r.y, i, j] = products[r.y, j, i] = v
    return solve(n, sums, products)


def score(statistics_: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch[f"s{k}"].to_numpy() for k in range(D)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(x))], ["doc_id", "score"])

    return statistics_.mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are for testing: CRC-32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
