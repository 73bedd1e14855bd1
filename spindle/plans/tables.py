"""Inputs of the queries: the test tables, and catalogue tables derived from ``documents``.

Each document stands for a shard of its source's domain; its characters are the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest: (pos, shard, domain, source, source_hash, source_size, tokens, documents)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"), T.shard_name(F.col("doc_id")).alias("shard"), F.concat(F.lit("data_"), F.col("source")).alias("domain"),
        F.concat(F.lit("corpus/data_"), F.col("source"), F.format_string("/part_%06d.txt", F.col("doc_id"))).alias("source"), T.sha16(F.col("text")).alias("source_hash"),
        F.octet_length("text").cast("long").alias("source_size"), F.col("n_chars").alias("tokens"), F.lit(1).cast("long").alias("documents"),
    )


SHARDS = """(SELECT doc_id AS pos, printf('shard_%05d.bin', doc_id) AS shard, 'data_' || source AS domain,
 'corpus/data_' || source || printf('/part_%06d.txt', doc_id) AS source, substr(sha256(text), 1, 16) AS source_hash,
 strlen(text) AS source_size, n_chars AS tokens, 1::BIGINT AS documents FROM documents)"""


def listing(manifest: DataFrame) -> DataFrame:
    """What lies on disk: some shards are gone, some cut short, and there are strays."""
    there = manifest.where(F.pmod("pos", F.lit(17)) != 0)
    size = F.col("tokens") * 2 - F.when(F.pmod("pos", F.lit(13)) == 0, F.when(F.pmod("pos", F.lit(2)) == 0, 1).otherwise(2)).otherwise(0)
    strays = manifest.where(F.pmod("pos", F.lit(97)) == 0).select(F.concat(F.lit("stray_"), F.col("shard")).alias("name"), (F.col("tokens") * 2).alias("size"))
    return there.select(F.col("shard").alias("name"), size.alias("size")).unionByName(strays)


LISTING = f"""(SELECT shard AS name, tokens * 2 - CASE WHEN pos % 13 = 0 THEN CASE WHEN pos % 2 = 0 THEN 1 ELSE 2 END ELSE 0 END AS size FROM {SHARDS} WHERE pos % 17 <> 0
 UNION ALL SELECT 'stray_' || shard, tokens * 2 FROM {SHARDS} WHERE pos % 97 = 0)"""

#: (domain, weight, most passes); one domain has no shards.
MIX = [(f"data_src{k}", (k + 1) / 64.0, 1 + k % 3) for k in range(8)] + [("data_absent", 0.25, 1)]


def mix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *m) for i, m in enumerate(MIX)], "ord int, domain string, weight double, max_epochs int")


MIX_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{d}', {w!r}::DOUBLE, {e})" for i, (d, w, e) in enumerate(MIX)) + ") AS m(ord, domain, weight, max_epochs))"


def order_sql(seed: int, *keys: str) -> str:
    return "sha256(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"{k}::VARCHAR" for k in keys) + "))"
