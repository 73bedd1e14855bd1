"""Toxicity by a classifier chain.

Categories are predicted one after the other: each is a linear (logistic) model over counts of
telling terms and over the probabilities of the categories before it. In training those
probabilities come from models that did not see the row (out of fold), so a later model meets
the same kind of number as when scoring. ``labels.toxic`` is the last link; the earlier ones
are its parts: toxic rows that hold words of a category's seed list, and toxic rows that hold
none of any list (``coded``: other languages and spellings, whose terms are learned).

Terms are words and their beginnings of 4 to 7 characters, in 2^20 hashed slots; those most
associated with the label are kept. Fitting uses at most ``SAMPLE`` labelled rows (the least
hashes of their ids), the only bound; scoring reads every whole text.

Edge cases: null and empty texts have no terms and get the score of the intercept; a null
``doc_id`` is scored and never learned from; repeated ids teach once; without a toxic (or a
clean) label all scores are 0 (or 1); an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .shared import materialised, modest_batches, slices, text_of, texts_of

#: Most labelled rows that the chain is fitted on.
SAMPLE = 8000
TERMS, SLOTS, FOLDS, RIDGE = 256, 1 << 20, 5, 1.0
#: Seed words of the categories; fixed values.
SEEDS = {
    "insult": ("idiot", "moron", "clown", "loser", "stupid", "fool", "scum"),
    "contempt": ("worthless", "trash", "pathetic", "disgusting", "garbage", "useless"),
}
CHAIN = (*SEEDS, "coded", "toxic")
_WORD = re.compile(r"\w+")


def term_slots(word: str) -> tuple[int, ...]:
    """Slots of a word and of its beginnings."""
    found = {word + "$", *(word[:k] for k in range(4, 8) if len(word) >= k)}
    return tuple({zlib.crc32(t.encode()) % SLOTS for t in found})


def term_counts(text: str) -> Counter:
    counts: Counter = Counter()
    for word, k in Counter(_WORD.findall(text.lower())).items():
        for slot in term_slots(word):
            counts[slot] += k
    return counts


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 100) -> np.ndarray:
    """Weights, intercept last, by Newton steps that are halved until the loss falls; the intercept is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(share / (1 - share))
    if y.min() == y.max():  # nothing to tell apart
        return w
    shrink = np.full(len(w), ridge)
    shrink[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (shrink * w * w).sum())

    for _ in range(steps):
        p, now = sigmoid(x @ w), loss(w)
        slope = x.T @ (y - p) - shrink * w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), slope)
        part = 1.0
        while part > 1e-9 and loss(w + part * move) > now - 1e-4 * part * float(slope @ move):
            part /= 2
        w += part * move
        if np.abs(part * move).max() < 1e-4:
            break
    return w


@dataclass
class Chain:
    """A fitted chain; small enough to travel with each task."""

    terms: dict[int, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5
    constant: float | None = None

    def places(self, word: str) -> tuple[int, ...]:
        """Where a word and its beginnings stand among the terms."""
        return tuple(self.terms[s] for s in term_slots(word) if s in self.terms)

    def features(self, text: str, memory: dict[str, tuple[int, ...]]) -> np.ndarray:
        """Counts of the terms; memory holds the places of words met before."""
        x = np.zeros(len(self.terms))
        for word, k in Counter(_WORD.findall(text.lower())).items():
            if (at := memory.get(word)) is None:
                if len(memory) > 400_000:
                    memory.clear()
                at = memory[word] = self.places(word)
            for i in at:
                x[i] += k
        return np.log1p(x)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of all categories, in chain order."""
        if self.constant is not None:
            return np.full((len(x), len(CHAIN)), self.constant)
        for w in self.weights:
            x = np.hstack([x, sigmoid(x @ w[:-1] + w[-1])[:, None]])
        return x[:, -len(CHAIN) :]


def fit_chain(docs: np.ndarray, y: np.ndarray, counts: np.ndarray, seeds: list[list[str]], terms: dict[int, int]) -> Chain:
    """A row in docs (ids), y (toxic), counts (of the terms) and seeds (categories whose seed
    words it holds); terms: the place of each term's slot."""
    if not len(docs) or y.min() == y.max():
        return Chain(constant=float(y[0]) if len(docs) else 0.0)
    y, x, chain = y.astype(float), np.log1p(counts), Chain(terms=terms)
    targets = {c: np.array([t and c in own for t, own in zip(y, seeds, strict=True)], dtype=float) for c in SEEDS}
    targets |= {"coded": np.array([t and not own for t, own in zip(y, seeds, strict=True)], dtype=float), "toxic": y}
    fold = np.array([zlib.crc32(f"fold {d}".encode()) % FOLDS for d in docs.tolist()])
    seen = x
    for name in CHAIN:
        out = np.zeros(len(docs))
        for k in range(FOLDS):
            test = fold == k
            if test.any():
                w = logistic(seen[~test], targets[name][~test])
                out[test] = sigmoid(seen[test] @ w[:-1] + w[-1])
        chain.weights.append(logistic(seen, targets[name]))
        seen = np.hstack([seen, out[:, None]])
    cuts = np.arange(0.3, 0.71, 0.05)
    f1 = [2 * ((out >= c) & (y == 1)).sum() / max(1, (out >= c).sum() + y.sum()) for c in cuts]
    chain.threshold = float(round(np.mean(cuts[np.array(f1) >= max(f1) - 1e-12]), 3))  # the middle of the best
    return chain


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain from documents and labels (doc_id, toxic). Only the sample's ids are broadcast."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).join(F.broadcast(picked), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for doc, text, toxic in zip(batch["doc_id"].to_pylist(), batch["text"], batch["toxic"].to_pylist(), strict=True):
                text = text.as_py()
                counts = term_counts(text)
                words = set(_WORD.findall(text.lower()))
                out.append((doc, toxic, list(counts), list(counts.values()), [c for c, seeds in SEEDS.items() if words & set(seeds)]))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "toxic", "slots", "counts", "seeds"])

    found = texts.mapInArrow(run, "doc_id long, toxic int, slots array<int>, counts array<int>, seeds array<string>")
    found = materialised(found.dropDuplicates(["doc_id"]), "toxicity-sample")
    terms = {r.slot: i for i, r in enumerate(telling(found).collect())}

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.zeros((batch.num_rows, len(terms)), dtype=np.int32)
            for i, (slots, counts) in enumerate(zip(batch["slots"].to_pylist(), batch["counts"].to_pylist(), strict=True)):
                for s, k in zip(slots, counts, strict=True):
                    if (at := terms.get(s)) is not None:
                        x[i, at] = k
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(list(x), pa.list_(pa.int32())), batch["seeds"]], ["doc_id", "toxic", "counts", "seeds"])

    rows = found.mapInArrow(dense, "doc_id long, toxic int, counts array<int>, seeds array<string>").toArrow().combine_chunks().sort_by("doc_id")
    counts = np.array(rows["counts"].to_pylist(), dtype=float).reshape(rows.num_rows, len(terms))
    return fit_chain(rows["doc_id"].to_numpy(), rows["toxic"].to_numpy(), counts, rows["seeds"].to_pylist(), terms)


def telling(found: DataFrame) -> DataFrame:
    """The slots most associated with the label: (slot, gain), best first, at most TERMS."""
    sizes = found.agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
    held = found.select("toxic", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("toxic").alias("with"), F.sum(1 - F.col("toxic")).alias("without")).where("with >= 3")
    gain = F.col("with") * F.log(((F.col("with") + 0.5) / (F.col("n1") + 1)) / ((F.col("without") + 0.5) / (F.col("n0") + 1)))
    return held.crossJoin(F.broadcast(sizes)).select("slot", gain.alias("gain")).where("gain > 0").orderBy(F.col("gain").desc(), "slot").limit(TERMS)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """(row, a probability for each category, toxic_predicted): row is the input row."""
    names = [f"p_{c}" for c in CHAIN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, tuple[int, ...]] = {}
        for batch in slices(batches):
            x = np.array([chain.features(t.as_py() or "", memory) for t in texts_of(batch["row"], text_col)]).reshape(batch.num_rows, -1)
            p = chain.predict(x)
            yield pa.RecordBatch.from_arrays([batch["row"], *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array((p[:, -1] >= chain.threshold).astype(np.int32))], ["row", *names, "predicted"])

    rows = docs.select(F.struct("*").alias("row"))
    modest_batches(docs.sparkSession)
    return rows.mapInArrow(run, StructType([rows.schema["row"], *(StructField(n, DoubleType()) for n in names), StructField("predicted", IntegerType())]))
