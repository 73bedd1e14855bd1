"""Best-fit packing by a configuration linear program.

Pieces of documents go into sequences of at most ``capacity`` tokens. Only the histogram of
piece lengths (at most ``capacity`` numbers, whatever the corpus) reaches the driver. There

1. the configuration LP (a variable per way of filling a sequence, a row per length) is
   solved by multiplicative weights: each round prices the lengths by how little they are
   covered so far, and a knapsack dynamic program finds the best fillings at these prices,
   and with them a lower bound of what any packing needs;
2. the fractional solution is rounded; the rest, which is bounded by the number of fillings
   and not by the corpus, goes best-fit into sequences.

It is the same whatever the histogram's size; how near a plan is to the bound is
``solved(...).sequences`` against ``solved(...).bound``.

The outcome is a table of rank ranges by length. Executors number the pieces of a length
(salted, so that a length which holds a third of all pieces is no hot key) and look up
sequence and offset. Every piece is placed; nothing is dropped or shortened.

Edge cases: a null or empty text is one piece that holds only the end token; a null
``doc_id`` is kept as null; repeated rows are packed once each; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import ceil
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialised, modest_batches, shuffle_width, slices, text_of

CAPACITY, END_ID = 1024, 2
#: Knapsack programs a phase, but for the last. Phases of the linear program and how fast a weight falls with coverage, as tried in turn
#: until a plan needs at most this share more sequences than the bound.
TURNS, SCHEDULES, ENOUGH = 2, ((3, 1.0), (4, 0.5), (6, 0.3)), 0.001
END_OF_TEXT = "<|endoftext|>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    """Text to ids of a byte-level BPE vocabulary, as the tokenizers library gives them.

    The vocabulary file names the merges; the same merges as ranks give the same ids
    about four times as fast, so the rank encoder runs first. A text on which its
    pattern matcher gives up goes to the tokenizers library itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    to_byte = {c: b for b, c in byte_alphabet().items()}
    specials = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in slow.get_vocab(False).items() if token not in specials}
    fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials)
    allowed = set(specials)

    def encode(text: str) -> np.ndarray:
        try:
            return np.asarray(fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()), dtype="<u4")
        except BaseException as e:  # the matcher's own failure type is no Exception
            if isinstance(e, KeyboardInterrupt | SystemExit):
                raise
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")

    return encode


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; of a long document the first may be short."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(at, capacity) for at in range(head, n, capacity)]


def tokenised_pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: id, piece, start, length and CRC-32 of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                out += ((doc, i, at, n, zlib.crc32(ids[at : at + n].tobytes())) for i, (at, n) in enumerate(cut(len(ids), capacity)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    modest_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, PIECES)


# --- the linear program -------------------------------------------------------------


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """By room: the most worth that lengths with repetition give, and a length that comes last there."""
    worth, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        worth[room] = worth[room - 1]
        if k := int(upto[room]):
            total = worth[room - lengths[:k]] + prices[:k]
            best = int(total.argmax())
            if total[best] > worth[room]:
                worth[room], last[room] = total[best], lengths[best]
    return worth, last


def best_filling(last: np.ndarray, room: int) -> Counter:
    """The lengths that a knapsack program puts into a room."""
    filling: Counter = Counter()
    while room > 0:
        n = int(last[room])
        filling[n] += n > 0
        room -= n or 1
    return +filling


def fractional(demand: np.ndarray, capacity: int, phases: int, decay: float) -> tuple[list[tuple[Counter, float]], float]:
    """Multiplicative weights for the configuration LP: (filling, how often), and a lower bound.

    A length's weight starts at its share of a sequence, its price where every sequence can be
    filled, and falls exponentially with the share of its demand that is covered. Each phase
    brings the lengths to the next of ``phases`` equal levels of coverage: a knapsack program
    prices all fillings, and every length below the level, long ones first, takes the best
    filling that holds it until it, or another length of that filling, is done. A length whose
    company ran out ``TURNS`` times waits for the next phase; the last one covers all. Every program
    also bounds the LP from below: demand times prices over the worth of the best filling is
    feasible in the dual.
    """
    lengths = np.flatnonzero(demand)
    covered, found, bound = np.zeros(capacity + 1), [], 0.0
    for phase in range(1, phases + 1):
        level, turns = phase / phases, 0
        while todo := [int(n) for n in lengths[::-1] if covered[n] < level - 1e-9]:
            turns += 1
            if turns > TURNS and phase < phases:
                break
            open_ = lengths[covered[lengths] < 1]
            prices = open_ / capacity * np.exp(-decay * covered[open_])
            worth, last = knapsack(open_, prices, capacity)
            bound = max(bound, float(prices @ demand[open_] / worth[capacity]))
            for n in todo:
                filling = best_filling(last, capacity - n) + Counter([n])
                most = {m: demand[m] * ((level if m == n else 1.0) - covered[m]) / k for m, k in filling.items()}
                often = min(most.values())
                if often <= 1e-9 * demand[n]:
                    continue
                found.append((filling, often))
                for m, k in filling.items():
                    covered[m] += often * k / demand[m]
                    if covered[m] > 1 - 1e-9:
                        covered[m] = 1.0
    return found, bound


def rounded(demand: np.ndarray, fillings: list[tuple[Counter, float]], capacity: int) -> list[tuple[Counter, int]]:
    """Whole fillings that hold the demand exactly, those of long pieces first.

    Fractions that leave next to no room round up from a quarter on, where their pieces are still
    there, others down and one less; what is left goes best-fit.
    """
    left, chosen = demand.copy(), []
    ordered = sorted(fillings, key=lambda x: -sum(n * n * k for n, k in x[0].items()))
    room = [capacity - sum(n * k for n, k in filling.items()) for filling, _ in ordered]
    for up, least, most in ((0.75, 0, capacity // 128), (1e-9 - 1, capacity // 128 + 1, capacity)):
        for (filling, often), free in zip(ordered, room, strict=True):
            if least <= free <= most and (whole := min(int(often + up), *(int(left[n] // k) for n, k in filling.items()))) > 0:
                chosen.append((filling, whole))
                for n, k in filling.items():
                    left[n] -= whole * k
    return chosen + best_fit(left, capacity)


def best_fit(demand: np.ndarray, capacity: int) -> list[tuple[Counter, int]]:
    """Longest first, each into the fullest sequence that still has room."""
    rooms: list[int] = []
    open_: dict[int, list[Counter]] = defaultdict(list)
    done: list[tuple[Counter, int]] = []
    for n in map(int, np.repeat(np.arange(capacity + 1), demand)[::-1]):
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            filling = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
        else:
            room, filling = capacity, Counter()
            done.append((filling, 1))
        filling[n] += 1
        if room > n:
            if not open_[room - n]:
                insort(rooms, room - n)
            open_[room - n].append(filling)
    return done


class Plan(NamedTuple):
    """Fillings and how many sequences each fills, and how few sequences any packing needs."""

    fillings: list[tuple[dict[int, int], int]]
    bound: int

    @property
    def sequences(self) -> int:
        return sum(k for _, k in self.fillings)


def solved(histogram: dict[int, int], capacity: int = CAPACITY, schedules: tuple[tuple[int, float], ...] = SCHEDULES, enough: float = ENOUGH) -> Plan:
    """A plan for a histogram of lengths; its fillings hold the histogram exactly.

    schedules: (phases, decay) tried in turn until a plan is within ``enough`` of the bound; the
    best plan counts.
    """
    demand = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in histogram.items():
        demand[n] += k
    full, demand[capacity] = int(demand[capacity]), 0  # a full piece has one filling
    best, bound = None, 0
    for phases, decay in schedules if demand.any() else ():
        fillings, below = fractional(demand, capacity, phases, decay)
        bound = max(bound, ceil(below - 1e-6))
        chosen: Counter = Counter()
        for filling, k in rounded(demand, fillings, capacity):
            chosen[tuple(sorted(filling.items()))] += k
        if best is None or chosen.total() < best.total():
            best = chosen
        if best.total() <= bound * (1 + enough):
            break
    best = best or Counter()
    if full:
        best[((capacity, 1),)] += full
    return Plan([(dict(filling), k) for filling, k in sorted(best.items())], bound + full)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Fillings and how many sequences each fills; together they hold the histogram exactly."""
    return solved(histogram, capacity).fillings


def ranges(fillings: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces a sequence, first sequence, offset of the first piece)."""
    taken: Counter = Counter()
    rows: dict[int, list] = defaultdict(list)
    sequence = 0
    for filling, often in fillings:
        at = 0
        for n in sorted(filling, reverse=True):
            rows[n].append((taken[n], filling[n], sequence, at))
            taken[n] += filling[n] * often
            at += n * filling[n]
        sequence += often
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def numbered(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``: pieces of a length numbered from 0 without a gap.

    A length's pieces are dealt to as many salts as there are shuffle partitions; the salt's
    count gives its first number. The order within a salt is by content, so a task that runs
    again gives the same numbers.
    """
    width = shuffle_width(pieces.sparkSession)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(width)).cast("int"))
    sums = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(sums), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    return salted.withColumn("nr", F.row_number().over(within)).join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("nr") - 1).drop("salt", "nr", "first")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (columns of PIECES)."""
    pieces = materialised(pieces, "pieces", compact=True)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = ranges(plan(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                own = length == n
                rows = table[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                copy, nth = np.divmod(rank[own] - row[:, 0], row[:, 1])
                sequence[own], offset[own] = row[:, 2] + copy, row[:, 3] + nth * n
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenises, cuts and packs all documents."""
    return pack(tokenised_pieces(docs, vocabulary, capacity, end_id), capacity)
