"""SimHash near-duplicates found with BK-trees.

A document's fingerprint has a bit set where over half of its shingle hashes have it set.
Copies share a fingerprint, so the search runs over distinct fingerprints only. To be within
``RADIUS`` bits two fingerprints must agree on some choice of bit blocks (pigeonhole), so
each choice deals the fingerprints into shards; a shard's BK-tree is built and searched where
the shard lies. A node's children hang on edges keyed by their distance to it, and a search
follows only edges within the radius of its own distance. Oversized shards are dealt again by
further bits, so no tree grows without bound and no pair is lost. A shard reports a link per fingerprint to the least one of its group, not all
pairs. Links join up by alternating star contractions, each cut off by a table in the shared
folder.

Edge cases: null and empty texts have fingerprint zero and link like any other; a null
``doc_id`` gets a row, and counts for no component id unless all ids of the component are
null (then it is null); repeated rows share a component; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import UPPER, discard, materialised, modest_batches, scratch_path, slices, text_of

SHINGLE, RADIUS, SEED, BITS = 4, 4, 42, 64
#: Most fingerprints in a tree, and how often larger shards are dealt again.
TREE, LEVELS = 4096, 6
#: Near duplicates by likeness: words a shingle, least Jaccard similarity, bits that BK-trees
#: follow, shards a text, least hashes that name a shard, most shingles compared in one task.
WIDTH, SIMILARITY, WIDE, BANDS, MINIMA, PART = 5, 0.8, 24, 10, 3, 1 << 21
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def shingle_hashes(text: str, width: int = SHINGLE, chunk: int = 1 << 15) -> Iterator[np.ndarray]:
    """The XXH64 of each shingle, unsigned, in pieces, so that long documents need bounded memory."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[-1:] if len(words) < width else ends[width - 1 :]
    for at in range(0, n, chunk):
        spans = zip(starts[at : at + chunk].tolist() if n > 1 else [0], last[at : at + chunk].tolist(), strict=False)
        yield np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)


def majority(pieces: Iterable[np.ndarray]) -> int:
    """The bits that over half of the hashes have set."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in pieces:
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str, width: int = SHINGLE, chunk: int = 1 << 15) -> int:
    """The 64-bit SimHash of a text, unsigned."""
    return majority(shingle_hashes(text, width, chunk))


def fingerprints(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed number; hashed: and t, a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([fingerprint(t.as_py(), width) for t in batch[1]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(values), *batch.columns[2:]], ["doc_id", "fp", *more])

    more = ["t"] if hashed else []
    modest_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), *[F.xxhash64(text_of(text_col)).alias(c) for c in more])
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "fp", *more]))


class BKTree:
    """Children of a node are keyed by their integer Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        values, edges = self.values, self.edges
        values.append(value)
        edges.append({})
        at, new = 0, len(values) - 1
        while new:
            d = (values[at] ^ value).bit_count()
            if d not in edges[at]:
                edges[at][d] = new
                return
            at = edges[at][d]

    def walk(self, value: int, radius: int) -> Iterator[int]:
        """Places of all values at most ``radius`` bits away, as they are met."""
        values, edges = self.values, self.edges
        stack = [0] if values else []
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            stack += [child for edge, child in edges[at].items() if d - radius <= edge <= d + radius]

    def within(self, value: int, radius: int) -> list[int]:
        return list(self.walk(value, radius))


class Groups:
    """Union by least member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def shard_links(tree_side: list[int], query_side: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(member, least member) of each group that links form inside one shard.

    Values are the signed forms. With a query side, only links across the sides are sought.
    """
    full, groups, tree = (1 << BITS) - 1, Groups(), BKTree()
    for value in tree_side:
        if not query_side:
            for at in tree.within(value & full, radius):
                groups.join(value, tree_side[at])
        tree.add(value & full)
    for value in query_side:
        for at in tree.within(value & full, radius):
            groups.join(value, tree_side[at])
    return [(x, root) for x in list(groups.parent) if (root := groups.find(x)) != x]


def block_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Signed bit masks; fingerprints within the radius agree on at least one of them.

    64 bits in ``radius + agree`` blocks: some ``agree`` blocks are untouched. More agreeing
    blocks make smaller shards and more of them; the expected shard holds at most 64 of
    n fingerprints, for any n up to what 32 agreeing bits give.
    """
    agree = next((a for a in (1, 2, 3) if n <= 64 * 2 ** (BITS * a // (radius + a))), 4)
    blocks = radius + agree
    bounds = [BITS * k // blocks for k in range(blocks + 1)]
    single = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]
    masks = [sum(x) for x in combinations(single, agree)]
    assert len(masks) == comb(blocks, agree)
    return [signed(m) for m in masks]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def finer_masks(mask: int, radius: int) -> list[int]:
    """Masks with further bits; what agrees on mask and is within the radius agrees on one of them."""
    free = [k for k in range(BITS) if not mask >> k & 1]
    blocks = radius + 1
    bounds = [len(free) * k // blocks for k in range(blocks + 1)]
    return [signed(mask & (1 << BITS) - 1 | sum(1 << k for k in free[a:b])) for a, b in zip(bounds, bounds[1:], strict=False)]


def links(distinct: DataFrame, n: int, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(a, b), b < a: links that connect what lies within the radius; at most one a shard and member.

    distinct: a column fp of n different values. A shard of more than ``tree`` fingerprints is dealt
    again by further bits, block by block of those left, until it is small. Only fingerprints that
    agree on nearly all bits can stay together through ``LEVELS`` turns; those are searched part
    against part.
    """
    spark, shard = distinct.sparkSession, ["mask", "bits"]
    deal = lambda rows, masks: rows.select("fp", F.explode(masks).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
    keys = deal(distinct, F.array(*[F.lit(m).cast("long") for m in block_masks(n, radius)]))
    settled: list[DataFrame] = []
    for level in range(LEVELS + 1):
        large = materialised(keys.groupBy(*shard).count().where(F.col("count") > tree), "large-shards")
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]  # at most one a choice of blocks
        if not masks or level == LEVELS:
            break
        settled.append(keys.join(large, shard, "left_anti"))
        finer = spark.createDataFrame([(m, finer_masks(m, radius)) for m in masks], "mask long, finer array<long>")
        keys = materialised(deal(keys.join(large, shard, "left_semi").join(F.broadcast(finer), "mask").select("fp", "finer"), F.col("finer")).distinct(), "finer-shards")
    sized = keys.join(large.withColumnRenamed("count", "size"), shard, "left") if masks else keys.withColumn("size", F.lit(1))
    sized = sized.withColumn("parts", F.coalesce(F.ceil(2 * F.col("size") / tree), F.lit(1)).cast("int"))
    own = sized.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = own.select(*shard, "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        *shard, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp"
    )
    for small in settled:
        dealt = dealt.unionByName(small.select(*shard, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        now, sides = None, ([], [])
        for batch in batches:
            for *shard, side, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    found += shard_links(*sides, radius) if len(sides[0]) + len(sides[1]) > 1 else []
                    now, sides = shard, ([], [])
                sides[side].append(fp)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
            found = []
        found += shard_links(*sides, radius) if len(sides[0]) + len(sides[1]) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    shard = ["mask", "bits", "i", "j"]
    return dealt.repartition(*shard).sortWithinPartitions(*shard, "side", "fp").mapInArrow(search, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node reachable; edges: (a, b).

    Alternates large and small star steps until nothing changes; each round ends in a table.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))

    spark = edges.sparkSession
    place, print_ = scratch_path(spark, "edges"), None
    edges = materialised(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges", path=place)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(mins, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        old, place = place, scratch_path(spark, "edges")
        edges = materialised(small.where("a > b").distinct(), "edges", path=place)
        discard(spark, old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == print_:
            break
        print_ = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(doc_id, fp, root, component_id) of every row; root names the component; hashed: and t, a hash of the text."""
    own = materialised(fingerprints(docs, width, id_col, text_col, hashed), "fingerprints", compact=True)
    distinct = materialised(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    tree = components(links(distinct.select("fp"), distinct.count(), radius))
    rooted = distinct.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "root", "component_id", *(["t"] if hashed else []))


# --- by likeness of the shingles ---------------------------------------------------------


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    small, big = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return float(not len(big))
    at = np.minimum(np.searchsorted(big, small), len(big) - 1)
    both = int((big[at] == small).sum())
    return both / (len(a) + len(b) - both)


@lru_cache(maxsize=1)
def _mixers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(BANDS * MINIMA), draw(BANDS * MINIMA), draw(MINIMA)


def shard_keys(hashes: np.ndarray, chunk: int = 1 << 12) -> np.ndarray:
    """The ``BANDS`` shards of a set of shingles, each named by ``MINIMA`` least hashes."""
    flip, factor, weight = _mixers()
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), chunk):
        np.minimum(least, ((hashes[at : at + chunk, None] ^ flip) * factor).min(axis=0), out=least)
    return (least.reshape(BANDS, MINIMA) * weight).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, fp, s, n, shards): hashes of text and shingle set, fingerprint, size, shards."""
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in slices(batches):
            fp, own, sizes, shards = [], [], [], []
            for text in batch[2]:
                pieces = list(shingle_hashes(text.as_py(), width))
                hashes = np.unique(np.concatenate(pieces)) if pieces else np.empty(0, dtype=np.uint64)
                fp.append(majority(pieces))
                own.append(xxh64_intdigest(hashes.tobytes(), SEED))
                sizes.append(len(hashes))
                shards.append(shard_keys(hashes))
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            nested = pa.array([x.tolist() for x in shards], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], signed(fp), signed(own), pa.array(sizes, pa.int64()), nested], ["doc_id", "t", "fp", "s", "n", "shards"])

    modest_batches(docs.sparkSession)
    schema = StructType([*(StructField(c, LongType()) for c in ("doc_id", "t", "fp", "s", "n")), StructField("shards", ArrayType(LongType()))])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("t"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def set_links(rows: list[tuple[int, int, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """(a, b): links that join all rows (s, fp, set) whose sets are alike, directly or by others.

    Each group so far has a BK-tree of its fingerprints. A row follows the edges within ``WIDE`` bits
    until a set is alike, so it costs little beside its own copies; groups that it joins become one.
    """
    groups: list[tuple[BKTree, list[int]]] = []
    found = []
    for i, (s, fp, own) in enumerate(rows):
        joined, value = [], fp & (1 << BITS) - 1
        for g, (tree, members) in enumerate(groups):
            for at in tree.walk(value, WIDE):
                other, _, hashes = rows[members[at]]
                if min(len(own), len(hashes)) >= similarity * max(len(own), len(hashes)) and likeness(own, hashes) >= similarity:
                    found.append((s, other))
                    joined.append(g)
                    break
        joined.sort(key=lambda g: -len(groups[g][1]))
        tree, members = groups[joined[0]] if joined else (BKTree(), [])
        for g in joined[1:]:
            for value_, member in zip(groups[g][0].values, groups[g][1], strict=True):
                tree.add(value_)
                members.append(member)
        tree.add(value)
        members.append(i)
        groups = [x for g, x in enumerate(groups) if g not in joined] + [(tree, members)]
    return found


def alike(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """(doc_id, fp, root, t) of every row: rows of one root are joined by links of Jaccard similarity.

    No radius in bits stands for a similarity of 0.8: such pairs lie up to 18 bits apart, where
    chance pairs begin, and pigeonhole shards for that would hold everything. So the shards here are
    named by least hashes of the shingles (a pair of 0.8 shares one of them with a probability over
    0.999), and texts of a shard are of one block. Inside a block, BK-trees follow edges within
    ``WIDE`` bits, and what they meet is compared exactly, set against set. Blocks of more than
    ``part`` shingles or ``TREE`` texts are compared part against part.
    """
    own = materialised(sketches(docs, width, id_col, text_col), "sketches", compact=True)
    first = F.min(F.struct(F.isnull("doc_id").alias("k2"), F.coalesce("doc_id", F.lit(0)).alias("k1"), "t", "fp", "n")).alias("f")
    texts = materialised(own.groupBy("s").agg(first, F.first("shards").alias("shards")).select("s", "f.*", "shards"), "texts")  # of each set one text
    keys = texts.select("s", F.posexplode("shards").alias("choice", "bits"))
    least = keys.groupBy("choice", "bits").agg(F.min("s").alias("b"), F.count(F.lit(1)).alias("held")).where("held > 1").select("choice", "bits", "b")
    tree = components(keys.join(least, ["choice", "bits"]).select(F.col("s").alias("a"), "b").where("a <> b"))
    blocked = materialised(texts.drop("shards").join(tree.withColumnRenamed("node", "s"), "s", "left").withColumn("block", F.coalesce("root", "s")).drop("root"), "blocks")
    blocks = blocked.groupBy("block").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("size")).where("members > 1")
    parts = F.ceil(2 * F.greatest(F.col("size") / part, F.col("members") / TREE)).cast("int")
    chosen = blocked.join(blocks.select("block", F.when((F.col("size") > part) | (F.col("members") > TREE), parts).otherwise(1).alias("parts")), "block")
    chosen = chosen.withColumn("own", F.pmod(F.xxhash64("s"), F.col("parts")).cast("int")).select("k1", "k2", "t", "s", "fp", "block", "parts", "own")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = []
            for text in batch.column("text"):
                pieces = list(shingle_hashes(text.as_py(), width))
                found.append(np.unique(np.concatenate(pieces)).tobytes() if pieces else b"")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "parts", "own", "s", "fp")), pa.array(found, pa.binary())], ["block", "parts", "own", "s", "fp", "hashes"])

    key = ["k1", "k2", "t"]
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k1"), F.isnull(F.col(id_col).cast("long")).alias("k2"), F.xxhash64(text_of(text_col)).alias("t"), text_of(text_col).alias("text"))
    sized = rows.join(chosen, key).select("text", "block", "parts", "own", "s", "fp").mapInArrow(sets, "block long, parts int, own int, s long, fp long, hashes binary")
    dealt = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "s", "fp", "hashes"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def links_of() -> pa.RecordBatch:
            found = set_links(rows, similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for *shard, s, fp, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    yield links_of()
                    now, rows = shard, []
                if not rows or rows[-1][0] != s:  # a row may come twice
                    rows.append((s, fp, np.frombuffer(hashes, dtype=np.uint64)))
        yield links_of()

    shard = ["block", "i", "j"]
    groups = components(dealt.repartition(*shard).sortWithinPartitions(*shard, "s").mapInArrow(compare, "a long, b long"))
    return own.join(groups.withColumnRenamed("node", "s"), "s", "left").select("doc_id", "fp", F.coalesce("root", "s").alias("root"), "t")


def one_of_each(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the least id stays.

    With a similarity, components are those of ``alike`` and the radius plays no part. Rows without an id come last; of equal ids the least fingerprint stays, then the least hash
    of the text. Whatever the ids, a component keeps exactly one row.
    """
    found = near_duplicates(docs, radius, width, id_col, text_col, hashed=True) if similarity is None else alike(docs, similarity, width, id_col, text_col)
    least = F.min(F.struct(F.isnull("doc_id").alias("k2"), F.coalesce("doc_id", F.lit(0)).alias("k1"), "fp", "t")).alias("least")
    stays = found.groupBy("root").agg(least).select("least.k1", "least.k2", "least.t")
    key = ["k1", "k2", "t"]
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k1"), F.isnull(F.col(id_col).cast("long")).alias("k2"), F.xxhash64(text_of(text_col)).alias("t"))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("t"))
    return rows.join(stays, key, "left_semi").withColumn("nr", first).where("nr = 1").select("row.*")
