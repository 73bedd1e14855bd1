"""Line de-duplication over levelled sorted runs of line hashes.

A store keeps, per line key, in how many documents it was seen. It is a set of runs in levels.
A run is a table bucketed and sorted by the two hashes of the key, so runs meet batches by
merging, without moving or sorting again what is stored. A batch of documents is
counted, anti-joined by merge against the keys that the runs already know to be over the limit
(nothing more need be known of those), and written as a run of level 0; when a level holds
``fanout`` runs they are merged into one run of the next. So a key is rewritten once a level, not
once a batch, and old batches are never read again. When all batches are in, lines of keys over
the limit go from all documents.

A key is the line stripped of ASCII white space at both ends, A-Z lowered, and is held as two
64-bit hashes. Texts are read twice: once for the hashes of their keys, which lie in the shared
folder by batch, and once to meet the keys to drop. Keys are distinct within a document before
they are counted, and counts are summed before the shuffle. What a text loses depends on the text
alone, so texts, not ids, are joined: rows without an id or of one id are no hot key.

Edge cases: a null or empty text is one empty line, which stays; a null ``doc_id`` is kept;
each row counts as a document, repeated ones too; an empty table gives an empty result;
lines without a key always stay.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import BLANKS, UPPER, materialised, modest_batches, scratch_path, setting, shuffle_width, slices, text_of, texts_of

MIN_DOCS, BATCHES, FANOUT = 10, 4, 3
HASHES, TEXT = ["h1", "h2"], ["t1", "t2"]
#: A bucket of one file is read as sorted where this is set.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, different ones only."""
    lines = F.split(F.translate(text, UPPER, UPPER.lower()), "\n")
    return F.array_distinct(F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS))))


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.concat(key, F.lit("\n"))).alias("h2")]


def python_hashes(line: bytes) -> tuple[int, int]:
    """The same two hashes of a line's key, signed."""
    from xxhash import xxh64_intdigest

    key = line.strip(BLANKS.encode()).translate(_LOWER)
    return tuple(h - (1 << 64) if (h := xxh64_intdigest(x, 42)) >> 63 else h for x in (key, key + b"\n")) if key else (0, 0)


_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def exploded(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each document and different key: the columns to keep, and the hashes."""
    return docs.select(*keep, F.explode(line_keys(F.col("text"))).alias("key")).where("key <> ''").select(*keep, *hashed(F.col("key")))


class LineRuns:
    """The store: runs by level. Tables lie in the shared folder unless a place is given."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, place: str | None = None) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.place, self.buckets = place or scratch_path(spark, "line-runs"), shuffle_width(spark)
        self.levels: dict[int, list[str]] = defaultdict(list)
        self.written = 0

    def _read(self, runs: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.table(r) for r in runs])

    def _summed(self, runs: list[str]) -> DataFrame:
        """The counts of several runs. Their buckets are dealt anew: a union of bucketed scans that
        claims their partitioning may lose it again when scans are re-planned, and would not sum."""
        dealt = self._read(runs).repartition(self.buckets, F.col("h1"))
        return dealt.groupBy(*HASHES).agg(F.sum("n").alias("n"))

    def _write(self, counts: DataFrame, level: int) -> None:
        """A run: each task holds one bucket whole, so a bucket is one sorted file."""
        name = f"lines_{self.place.rsplit('-', 1)[-1]}_{level}_{self.written}"
        self.written += 1
        dealt = counts.repartition(self.buckets, *HASHES).sortWithinPartitions(*HASHES)
        with setting(self.spark, ORDERED, "true"):
            dealt.write.format("parquet").bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", f"{self.place}/{name}").saveAsTable(name)
        self.levels[level].append(name)

    def add(self, docs: DataFrame) -> None:
        """Count a batch; docs has a column text."""
        self.add_keys(exploded(docs))

    def add_keys(self, keys: DataFrame) -> None:
        """Count a batch of hashed keys, each once a document."""
        self._write(self.fresh(keys), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._merge(level)
            level += 1

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The counts of a batch's keys that no run knows to be over the limit."""
        new = keys.groupBy(*HASHES).agg(F.count(F.lit(1)).alias("n"))
        for run in self.paths():
            new = new.join(self._read([run]).where(F.col("n") >= self.min_docs).select(*HASHES).hint("merge"), HASHES, "left_anti")
        return new

    def paths(self) -> list[str]:
        return [p for level in sorted(self.levels) for p in self.levels[level]]

    def _merge(self, level: int) -> None:
        merged = self._summed(self.levels[level])
        old, self.levels[level] = self.levels[level], []
        self._write(merged, level + 1)
        for run in old:
            self.spark.sql(f"DROP TABLE {run}")

    def frequent(self) -> DataFrame:
        """Hashes of the keys that at least min_docs documents hold."""
        return self._summed(self.paths()).where(F.col("n") >= self.min_docs).select(*HASHES)


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.hash(text).alias("t2")]


def drop_lines(docs: DataFrame, keys: DataFrame, frequent: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_dropped): the input row as a struct, its text without frequent lines.

    keys: (t1, t2, h1, h2), the keys of each text; frequent: (h1, h2).
    """
    hits = keys.join(frequent, HASHES, "left_semi").groupBy(*TEXT).agg(F.collect_set(F.struct(*HASHES)).alias("drop"))
    inner = docs.select(F.struct("*").alias("row"), *text_key(text_of(text_col))).join(hits, TEXT, "left").select("row", "drop")
    modest_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, lines, dropped = [], [], []
            row = batch.column("row")
            for text, drop in zip(texts_of(row, text_col), batch.column("drop"), strict=True):
                text, gone = text.as_py(), {(d["h1"], d["h2"]) for d in drop.as_py() or ()}
                parts = (text or "").split("\n")
                kept = [p for p in parts if python_hashes(p.encode()) not in gone] if gone else parts
                texts.append("\n".join(kept) if gone else text)
                lines.append(len(parts))
                dropped.append(len(parts) - len(kept))
            kind = [row.type.field(i) for i in range(row.type.num_fields)]
            new = [pa.array(texts, f.type) if f.name == text_col else pc.struct_field(row, [i]) for i, f in enumerate(kind)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(new, fields=kind), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["row", "n_lines", "n_dropped"])

    out = StructType([StructField("row", inner.schema["row"].dataType), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return inner.mapInArrow(cut, out)


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents through the store, batch after batch, then without their frequent lines."""
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    batch = F.pmod(F.xxhash64(id_col, text_col), F.lit(batches)).cast("int").alias("batch")
    dealt = docs.select(text_of(text_col).alias("text"), batch).select("text", "batch", *text_key(F.col("text")))
    keys = materialised(exploded(dealt, "batch", *TEXT), "line-keys", by=["batch"])
    for k in range(batches):
        runs.add_keys(keys.where(F.col("batch") == k))
    # as a table: a join with it can be split where a line is hot, or Spark broadcasts it by its size
    return drop_lines(docs, keys, materialised(runs.frequent(), "frequent-lines"), text_col)


def sha256(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()


def merged_paths(runs: LineRuns) -> int:
    """How many runs the store holds now."""
    return reduce(lambda n, level: n + len(runs.levels[level]), runs.levels, 0)
