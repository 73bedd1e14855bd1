"""Readers and writers of the pipeline's files."""

from __future__ import annotations

import os
import tarfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .. import schemas
from ..functions import text as T

#: Widths of token types; fixed values.
DTYPES = {"uint8": 1, "int8": 1, "uint16": 2, "int16": 2, "uint32": 4, "int32": 4}


def file_system(place: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a path as Spark writes it (local, hdfs, s3, gs), and the path within."""
    if place.startswith("file:"):
        return fs.LocalFileSystem(), "/" + place.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(place) if ":" in place.split("/")[0] else (fs.LocalFileSystem(), place)


def read_range(place: str, start: int, size: int) -> bytes:
    """Some bytes of a file, without the rest of it."""
    system, inner = file_system(place)
    with system.open_input_file(inner) as f:
        return f.read_at(size, start)


def scan(spark: SparkSession, path: str, kind: str = "parquet", where: str | None = None, schema: str | None = None) -> DataFrame:
    """A dataset; where selects its partitions (configuration, language, split)."""
    reader = spark.read.option("ignoreMissingFiles", "true")
    df = (reader.schema(schema) if schema else reader).format(kind).load(path)
    return df.where(where) if where else df


def scan_all(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """S3: several sources, each a dict of scan()'s arguments and a name, as one table."""
    out = None
    for s in sources:
        one = scan(spark, **{k: v for k, v in s.items() if k != "name"}).withColumn("origin", F.lit(s["name"]))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of packed text files: (file, file_size, domain, text).

    The marker is the reader's line separator, so files are split among tasks wherever they are
    large and a marker across a split is still found.
    """
    raw = spark.read.option("lineSep", T.EOT).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"), "value")
    clean = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit("")))
    return raw.select("file", "file_size", T.domain_of_path(F.col("file")).alias("domain"), T.py_strip(clean).alias("text")).where("text <> ''")


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, size) of files, their content unread. Spark's scan passes over files without bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(T.basename(F.col("path")).alias("name"), F.col("length").alias("size"))


def manifest(spark: SparkSession, path: str, merged: bool = False) -> DataFrame:
    """A manifest's shards with their place."""
    raw = spark.read.option("multiLine", "true").schema(schemas.MERGED_MANIFEST if merged else schemas.MANIFEST).json(path)
    return raw.select("tokenization_id", F.posexplode("shards").alias("pos", "s")).select("tokenization_id", F.col("pos").cast("long").alias("pos"), "s.*")


def manifest_faults(spark: SparkSession, path: str) -> DataFrame:
    """M8: (pos, fault) of a manifest read as it is: missing and null fields are told apart."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    shards = raw.select(F.posexplode(F.variant_get("v", "$.shards", "array<variant>")).alias("pos", "s"))
    faults = []
    for name, kind in (("shard", "STRING"), ("source", "STRING"), ("tokens", "BIGINT"), ("documents", "BIGINT")):
        v = F.try_variant_get("s", f"$.{name}", "variant")
        typed = F.schema_of_variant(v)
        faults.append(F.when(v.isNull(), f"{name}: missing").when(F.is_variant_null(v), f"{name}: null").when(typed != kind, f"{name}: wrong type"))
        if kind == "BIGINT":
            faults.append(F.when(F.try_variant_get("s", f"$.{name}", "bigint") < 0, f"{name}: negative"))
    return shards.select("pos", F.explode(F.filter(F.array(*faults), lambda f: f.isNotNull())).alias("fault"))


def token_shards(spark: SparkSession, path: str, dtype: str = "uint16", max_tokens: int | None = None) -> DataFrame:
    """(shard, ids, aligned) of binary shards; with max_tokens the first ids only, null where there are fewer.

    The listing comes without content; a task opens each of its files and reads only the bytes it
    needs. Spark's scan passes over files without bytes, so an empty shard has no row.
    """
    width = DTYPES[dtype]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, place, size in zip(*(batch[c].to_pylist() for c in ("name", "path", "length")), strict=True):
                n = size // width if max_tokens is None else max_tokens
                own = None if n > size // width else np.frombuffer(read_range(place, 0, n * width), dtype=f"<{np.dtype(dtype).str[1:]}").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([own], pa.list_(pa.int64())), pa.array([size % width == 0])], ["shard", "ids", "aligned"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    return files.select(T.basename(F.col("path")).alias("name"), "path", "length").mapInArrow(run, "shard string, ids array<long>, aligned boolean")


class _ShardWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.dtype = options["path"], np.dtype(options.get("dtype", "uint16")).newbyteorder("<")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        top = np.iinfo(self.dtype).max
        for row in rows:
            ids = np.asarray(row.ids, dtype=np.int64)
            if len(ids) and (ids.max() > top or ids.min() < 0):
                raise ValueError(f"{row.shard}: ids don't fit {self.dtype}")
            part = f"{folder}/.{row.shard}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as f:
                f.write(ids.astype(self.dtype).tobytes())
            system.move(part, f"{folder}/{row.shard}")  # whole or not at all
        return WriterCommitMessage()


class TokenShardSink(DataSource):
    """K2: writes rows (shard, ids) as flat little-endian files on a file system that all tasks share, local or remote."""

    @classmethod
    def name(cls) -> str:
        return "token_shard_files"

    def schema(self) -> str:
        return "shard string, ids array<long>"

    def writer(self, schema, overwrite: bool) -> _ShardWriter:  # noqa: ANN001
        return _ShardWriter(self.options)


class _TarReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.parts, self.suffix = options["path"].split(","), options.get("suffix", ".bin")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a stream across parts can't be split

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        class Joined:
            def __init__(self, paths: list[str]) -> None:
                self.left, self.now = list(paths), None

            def read(self, n: int) -> bytes:
                out = b""
                while len(out) < n:
                    if self.now is None:
                        if not self.left:
                            break
                        system, inner = file_system(self.left.pop(0))
                        self.now = system.open_input_stream(inner)
                    piece = self.now.read(n - len(out))
                    if not piece:
                        self.now.close()
                        self.now = None
                    out += piece
                return out

        with tarfile.open(fileobj=Joined(self.parts), mode="r|") as tar:
            for member in tar:
                if member.isfile() and member.name.endswith(self.suffix):
                    yield os.path.basename(member.name), member.size, tar.extractfile(member).read()


class TarShardSource(DataSource):
    """Members of a tar archive cut into parts; path: the parts in order, comma-joined."""

    @classmethod
    def name(cls) -> str:
        return "tar_parts"

    def schema(self) -> str:
        return "name string, size long, content binary"

    def reader(self, schema) -> _TarReader:  # noqa: ANN001
        return _TarReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the two Python data sources known to a session."""
    spark.dataSource.register(TokenShardSink)
    spark.dataSource.register(TarShardSource)


def edge_hashes(spark: SparkSession, path: str, edge: int = 1 << 20) -> DataFrame:
    """(name, size, hash) over a file's first and last MiB and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for name, place, size in zip(*(batch[c].to_pylist() for c in ("name", "path", "length")), strict=True):
                h = hashlib.sha256(read_range(place, 0, min(edge, size)))
                if size > 2 * edge:
                    h.update(read_range(place, size - edge, edge))
                h.update(size.to_bytes(8, "little"))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([h.hexdigest()])], ["name", "size", "hash"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(T.basename(F.col("path")).alias("name"), "path", "length").mapInArrow(run, "name string, size long, hash string")


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first path that exists, in any file system Spark knows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    return None


def write_text_files(files: DataFrame, path: str, keys: list[str]) -> None:
    """Packed content, a folder a key; folders that exist are left alone."""
    files.select(*keys, F.col("content").alias("value")).write.mode("ignore").partitionBy(*keys).text(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """K4: a row a line; the commit protocol makes it whole or absent."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """K5"""
    rows.write.mode("overwrite").option("header", "true").csv(path)


def to_copy(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Files whose name, size or checksum the other side lacks."""
    return local.join(remote, ["name", "size", "hash"], "left_anti")


def markdown_table(rows: DataFrame, most: int = 50) -> str:
    """K6: the first rows of a small report as a Markdown table."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    head = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    return "\n".join(head + ["| " + " | ".join(map(cell, r)) + " |" for r in rows.limit(most).collect()])


def markdown_report(title: str, sections: dict[str, DataFrame], most: int = 50) -> str:
    """K6: a report of several small tables under their headings."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(rows, most)}" for name, rows in sections.items())]) + "\n"
