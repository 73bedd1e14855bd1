"""Incremental runs: only what is new is read."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import catalog

Transform = Callable[[DataFrame], DataFrame]


def ingest(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, transform: Transform, kind: str = "parquet", files_per_batch: int = 1000) -> None:
    """Files that came since the last run go through a transform and are appended.

    The checkpoint knows which files were read, so a run that broke off goes on where it was and
    no document is skipped or taken twice, whatever the filters keep.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)
    transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def retokenize(spark: SparkSession, path: str, schema: str, manifest_path: str, checkpoint: str, entries: Transform, keys: list[str]) -> None:
    """In each batch new and changed sources are turned into entries and upserted.

    A manifest version is a folder; a reader takes the last whole one (N3: none is rewritten). A
    batch that is tried again starts from the version below its own and writes its own anew.
    """

    def batch(df: DataFrame, number: int) -> None:
        old = latest(spark, manifest_path, below=number)
        fresh = df if old is None else catalog.classified(df, old, keys).where("action <> 'skip'").drop("action")
        new = entries(fresh)
        whole = new if old is None else catalog.upserted(old, new.select(*old.columns), keys)
        _store(whole, f"{manifest_path}/version={number:08d}")

    stream = spark.readStream.schema(schema).parquet(path)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _store(version: DataFrame, path: str) -> None:
    version.write.mode("overwrite").parquet(path)


def latest(spark: SparkSession, manifest_path: str, below: int | None = None) -> DataFrame | None:
    """The last whole version of a manifest table; below: of those with a lower number."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest_path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return None
    versions = sorted(str(s.getPath()) for s in fs.listStatus(fs_path) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    versions = [v for v in versions if below is None or int(v.rpartition("=")[2]) < below]
    return spark.read.parquet(versions[-1]) if versions else None


def assembled(arrivals: DataFrame, needed: str = "parts") -> DataFrame:
    """A merged shard is emitted once all its parts have come, in whatever order.

    arrivals: (merged_shard, place, tokens, parts), parts being how many make it whole. The state
    holds the places that have come; one that comes again counts once.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        places, sizes = (list(x) for x in state.get) if state.exists else ([], [])
        whole = 0
        for pdf in pdfs:
            for place, tokens, parts in zip(pdf["place"], pdf["tokens"], pdf[needed], strict=True):
                whole = int(parts)
                if int(place) not in places:
                    places.append(int(place))
                    sizes.append(int(tokens))
        if whole and len(places) == whole and -1 not in places:
            places.append(-1)  # emitted
            state.update((places, sizes))
            yield pd.DataFrame({"merged_shard": [key[0]], "parts": [whole], "tokens": [sum(sizes)]})
        else:
            state.update((places, sizes))

    return arrivals.groupBy("merged_shard").applyInPandasWithState(step, "merged_shard string, parts long, tokens long", "places array<long>, sizes array<long>", "append", GroupStateTimeout.NoTimeout)


def run_state(spark: SparkSession, path: str) -> dict:
    """Step, bag of seen shards and evaluation history of the last whole checkpoint table.

    Of the last checkpoint only step and bag are read, of the others step and loss.
    """
    table = latest(spark, path)
    last = None if table is None else table.agg(F.max("step").alias("step"), F.max_by("seen_shards", "step").alias("seen")).first()
    if last is None or last.step is None:
        return {"step": 0, "seen": {}, "history": []}
    history = table.where("loss IS NOT NULL").select("step", "loss").orderBy("step", "loss").collect()  # an evaluation a row
    return {"step": last.step, "seen": dict(Counter(last.seen or [])), "history": [tuple(r) for r in history]}
