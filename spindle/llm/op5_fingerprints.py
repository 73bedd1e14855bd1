"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line; a long line counts in blocks that end where a clause ends (after ``BLOCK``
characters, at the latest after ``MOST``), so a change in a line leaves its other blocks alone. Its digest (with how many
equal ones came before, so that repeats are told apart) goes into three cells of the sketch,
each a count, a sum of digests and a sum of check values. Sketches of two versions subtract cell
by cell; cells with a count of one are peeled off, which uncovers more, until all differing
digests are known. Where peeling gets stuck both versions are sketched again in a larger table.
The number of differing digests gives a likeness between 0 and 1 (shared over all). Fingerprints that
were kept can be compared later without the texts: ``compare`` reads and subtracts them.

To meet the next document in descending order of ids, documents are dealt into ranges of ids
and sorted there; the first document of a range is copied to the range above, and the first of
all to the last. Texts move once and stream through; no window spans the table.

Edge cases: null and empty texts are one empty paragraph; a null ``doc_id`` comes after all ids; rows
with equal ids stand in the order of their texts' hashes; a single row is its own next; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches, shuffle_width, text_of

#: Cells of the stored sketch (a multiple of three), and least and most characters in a block of a long line.
CELLS, BLOCK, MOST = 18, 80, 240
_BLOCKS = re.compile(f".{{{BLOCK},{MOST}}}?(?:[.!?,;:] |$)|.{{1,{MOST}}}")
#: Cells for each digest of the two versions on the first retry; growth on later ones.
ROOM, GROWTH = 1.6, 2
U = np.uint64
_SHIFTS, _LOW = np.array([[0], [21], [42]], dtype=U), U((1 << 21) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array; products wrap around."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def paragraphs(text: str) -> list[str]:
    out: list[str] = []
    for line in text.split("\n"):
        if len(line) <= BLOCK:
            out.append(line)
        else:
            out += _BLOCKS.findall(line)
    return out


def digests(text: str) -> np.ndarray:
    """A 64-bit digest of each paragraph; the k-th of equal ones is hashed with seed k."""
    from xxhash import xxh64_intdigest

    seen: dict[str, int] = {}
    out = []
    for p in paragraphs(text):
        k = seen.get(p, 0)
        seen[p] = k + 1
        out.append(xxh64_intdigest(p.encode(), k))
    return np.array(out, dtype=U)


class Sketch:
    """An invertible Bloom lookup table of 64-bit keys."""

    __slots__ = ("checks", "counts", "keys", "mask")

    def __init__(self, cells: int = CELLS, mask: int = 0xFFFFFFFFFFFFFFFF) -> None:
        self.mask = U(mask)  # the bits of check values that are kept
        self.counts, self.keys, self.checks = np.zeros(cells, dtype=np.int64), np.zeros(cells, dtype=U), np.zeros(cells, dtype=U)

    @classmethod
    def of(cls, keys: np.ndarray, cells: int = CELLS) -> Sketch:
        out = cls(cells)
        out.add(keys, np.ones(len(keys), dtype=np.int64))
        return out

    def places(self, mixed: np.ndarray) -> np.ndarray:
        """A cell in each third, by 21 bits of the mixed key."""
        third = len(self.counts) // 3
        return (((mixed >> _SHIFTS & _LOW) * U(third) >> U(21)).astype(np.int64) + np.arange(3)[:, None] * third).ravel()

    def add(self, keys: np.ndarray, times: np.ndarray) -> None:
        """Adds each key so many times; negative times take away."""
        mixed, signed = mix(keys), times.astype(U)
        at = self.places(mixed)
        np.add.at(self.counts, at, np.tile(times, 3))
        np.add.at(self.keys, at, np.tile(keys * signed, 3))
        np.add.at(self.checks, at, np.tile(mixed * signed, 3))
        self.checks &= self.mask

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(len(self.counts), int(self.mask & other.mask))
        out.counts, out.keys, out.checks = self.counts - other.counts, self.keys - other.keys, (self.checks - other.checks) & out.mask
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """(keys only in the left, keys only in the right) of a difference, or None if stuck."""
        left, right = [], []
        while self.counts.any() or self.keys.any() or self.checks.any():
            one = np.flatnonzero(np.abs(self.counts) == 1)
            sign = self.counts[one]
            times = sign.astype(U)
            keys = self.keys[one] * times
            pure = (mix(keys) * times & self.mask) == self.checks[one]
            keys, first = np.unique(keys[pure], return_index=True)
            if not len(keys):
                return None
            sign = sign[pure][first]
            left.append(keys[sign > 0])
            right.append(keys[sign < 0])
            self.add(keys, -sign)
        none = np.zeros(0, dtype=U)
        return np.concatenate([none, *left]), np.concatenate([none, *right])

    @classmethod
    def parse(cls, text: str) -> Sketch:
        """A stored sketch; of its check values the lower 32 bits are kept."""
        raw = base64.b64decode(text)
        out = cls(len(raw) // 16, 0xFFFFFFFF)
        n = len(out.counts)
        out.counts = np.frombuffer(raw, "<i4", n).astype(np.int64)
        out.keys, out.checks = np.frombuffer(raw, "<u8", n, 4 * n).astype(U), np.frombuffer(raw, "<u4", n, 12 * n).astype(U)
        return out

    def text(self) -> str:
        raw = self.counts.astype("<i4").tobytes() + self.keys.astype("<u8").tobytes() + self.checks.astype("<u4").tobytes()
        return base64.b64encode(raw).decode()


def difference(a: np.ndarray, b: np.ndarray, own: tuple[Sketch, Sketch] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Digests only in a and only in b, by subtracting sketches and peeling, larger until it succeeds."""
    if own and abs(len(a) - len(b)) <= CELLS and (found := own[0].minus(own[1]).peel()):
        return found
    third = int(ROOM * (len(a) + len(b)) / 3) + 4
    while (found := Sketch.of(a, 3 * third).minus(Sketch.of(b, 3 * third)).peel()) is None:
        third *= GROWTH
    return found


def likeness(a: np.ndarray, b: np.ndarray, own: tuple[Sketch, Sketch] | None = None) -> float:
    """Shared digests over all digests of the two."""
    only_a, only_b = difference(a, b, own)
    apart = len(only_a) + len(only_b)
    return (len(a) + len(b) - apart) / (len(a) + len(b) + apart)


def compare(a: str, b: str) -> tuple[np.ndarray, np.ndarray] | None:
    """The digests only in the text of fingerprint a and only in that of b, or None where they differ in
    too many for the stored cells (from about a dozen on), so that the texts have to be sketched again."""
    return Sketch.parse(a).minus(Sketch.parse(b)).peel()


def edited(text: str, following: str) -> str:
    """The text whose last half (rounded down) gives way to the next one's beginning."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def ranged(docs: DataFrame, ranges: int) -> DataFrame:
    """(doc_id, text, range, tail): sorted runs of neighbours; a run's last row is a tail, the next run's first."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    cuts = rows.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    bounds = np.array(sorted(set(cuts)), dtype=np.float64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), -1, np.searchsorted(bounds, ids.fillna(0).astype("float64"), side="left"))).astype("int32")

    rows = rows.withColumn("range", range_of("doc_id"))
    firsts = docs.select("doc_id", F.xxhash64("text").alias("tie")).withColumn("range", range_of("doc_id"))
    # of a range: the greatest id, and of its rows the least tie
    tops = firsts.groupBy("range").agg(F.max(F.struct("doc_id", (-F.col("tie").cast("decimal(20,0)")).alias("tie"))).alias("f")).collect()
    order = sorted(tops, key=lambda r: -r["range"])
    spark = docs.sparkSession
    above = {r["range"]: order[k - 1]["range"] for k, r in enumerate(order)}
    edges = spark.createDataFrame([(r["f"]["doc_id"], int(-r["f"]["tie"]), above[r["range"]]) for r in order], "e_doc long, e_tie long, above int")
    rows = rows.join(F.broadcast(edges), F.col("doc_id").eqNullSafe(F.col("e_doc")) & (F.col("tie") == F.col("e_tie")), "left")  # a row for each range
    places = F.filter(F.array(F.struct("range", F.lit(0).alias("tail")), F.struct(F.col("above").alias("range"), F.lit(1).alias("tail"))), lambda x: x["range"].isNotNull())
    spread = rows.select("doc_id", "text", "tie", F.explode(places).alias("p")).select("doc_id", "text", "tie", "p.range", "p.tail")
    by_range = spread.repartitionById(len(bounds) + 2, F.col("range") + 1)  # a task for each range, one for rows without an id
    return by_range.sortWithinPartitions("range", "tail", F.col("doc_id").desc_nulls_last(), "tie").select("doc_id", "text", "range", "tail")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, and how like it the edited and the next are."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    ranges = ranges or shuffle_width(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = [x.split()[0] for x in OUT.split(", ")]
        before = None  # (doc_id, text, range, digests, sketch) of the row that waits for its next
        for batch in batches:
            out = []
            docs_, places, tails = (batch.column(c).to_pylist() for c in (0, 2, 3))
            for doc, text, place, tail in zip(docs_, batch.column(1), places, tails, strict=True):
                text = text.as_py()
                own = digests(text)
                sketch = Sketch.of(own)
                if before and before[2] == place:
                    out.append(compared(before, text, own, sketch))
                before = None if tail else (doc, text, place, own, sketch)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    modest_batches(docs.sparkSession)
    return ranged(docs, ranges).mapInArrow(run, OUT)


def compared(before: tuple, text: str, following: np.ndarray, sketch: Sketch) -> tuple:
    doc, whole, _, own, own_sketch = before
    new = edited(whole, text)
    new_digests = digests(new)
    new_sketch = Sketch.of(new_digests)
    return (
        doc, len(whole), hashlib.sha256(new.encode()).hexdigest(), own_sketch.text(), new_sketch.text(),
        likeness(own, new_digests, (own_sketch, new_sketch)), likeness(own, following, (own_sketch, sketch)),
    )
