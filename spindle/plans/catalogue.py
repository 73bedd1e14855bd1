"""The shard catalogue: presence, gates, merges, provenance, repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog
from ..session import work_dir
from .registry import Book
from .tables import LISTING, MIX_SQL, SHARDS, listing, mix, shards

book = Book()
TARGET = 60_000  # bytes of a merged shard


@book.query(f"SELECT m.shard, domain, CASE WHEN l.name IS NULL THEN 'missing' WHEN l.size <> tokens * 2 THEN 'wrong_size' ELSE 'kept' END AS status FROM {SHARDS} m LEFT JOIN {LISTING} l ON m.shard = l.name")
def shard_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14"""
    s = shards(spark, sf_dir)
    return catalog.presence(s, listing(s)).select("shard", "domain", "status")


STATUS = f"(SELECT m.*, CASE WHEN l.name IS NULL THEN 'missing' WHEN l.size <> tokens * 2 THEN 'wrong_size' ELSE 'kept' END AS status FROM {SHARDS} m LEFT JOIN {LISTING} l ON m.shard = l.name)"


@book.query(f"SELECT domain, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'wrong_size') AS wrong_size FROM {STATUS} GROUP BY domain")
def skipped_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7"""
    s = shards(spark, sf_dir)
    return catalog.skipped_by_reason(catalog.presence(s, listing(s)))


@book.query(f"SELECT domain, count(*) FILTER (WHERE status = 'kept') AS ok, count(*) FILTER (WHERE status = 'wrong_size') AS mismatch, count(*) FILTER (WHERE status = 'missing') AS missing FROM {STATUS} GROUP BY domain")
def size_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8"""
    s = shards(spark, sf_dir)
    return catalog.size_summary(catalog.presence(s, listing(s)))


@book.query(f"SELECT source_hash, count(*) AS n, string_agg(shard, ',' ORDER BY shard) AS members FROM {SHARDS} GROUP BY source_hash HAVING count(*) > 1")
def duplicate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9"""
    return catalog.duplicated(shards(spark, sf_dir), "source_hash", "shard")


@book.query(f"SELECT shard, tokens, source_size, round(tokens * 2 / (source_size * 1.0::DOUBLE), 4) AS ratio FROM {SHARDS} WHERE tokens * 2 > 1.98::DOUBLE * source_size")
def oversize_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F23"""
    return catalog.oversize(shards(spark, sf_dir), factor=0.99).select("shard", "tokens", "source_size", "ratio")


ISSUES = f"""(SELECT 'duplicate_source' AS "check", source AS item, count(*)::VARCHAR AS detail FROM {SHARDS} GROUP BY source HAVING count(*) > 1
 UNION ALL SELECT 'missing_file', shard, tokens::VARCHAR FROM {STATUS} WHERE status = 'missing'
 UNION ALL SELECT 'orphan_file', name, size::VARCHAR FROM {LISTING} WHERE name NOT IN (SELECT shard FROM {SHARDS})
 UNION ALL SELECT 'misaligned', name, size::VARCHAR FROM {LISTING} WHERE size % 2 <> 0
 UNION ALL SELECT 'wrong_size', shard, size::VARCHAR FROM {SHARDS} m JOIN {LISTING} l ON m.shard = l.name WHERE size <> tokens * 2
 UNION ALL SELECT 'oversize', shard, tokens::VARCHAR FROM {SHARDS} WHERE tokens > source_size)"""


@book.query(f'SELECT "check", item, detail FROM {ISSUES}')
def manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M7, M9"""
    s = shards(spark, sf_dir)
    return catalog.issues(s, listing(s))


@book.query(f'SELECT "check", item, detail, nr FROM (SELECT *, row_number() OVER (PARTITION BY "check" ORDER BY item) AS nr FROM {ISSUES}) WHERE nr <= 5', longs=("nr",))
def issue_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of a class are the feature."""
    s = shards(spark, sf_dir)
    return catalog.examples(catalog.issues(s, listing(s)))


OLD = f"(SELECT pos, shard, domain, source, source_hash, CASE WHEN pos % 11 = 0 THEN source_size + 1 ELSE source_size END AS source_size, tokens FROM {SHARDS} WHERE pos % 5 <> 0)"


def _old(s: DataFrame) -> DataFrame:
    """An earlier manifest: some sources weren't there yet, some had another size."""
    size = F.when(F.pmod("pos", F.lit(11)) == 0, F.col("source_size") + 1).otherwise(F.col("source_size"))
    return s.where(F.pmod("pos", F.lit(5)) != 0).withColumn("source_size", size)


@book.query(f"SELECT n.domain, n.source, CASE WHEN o.source IS NULL THEN 'new' WHEN o.source_size <> n.source_size THEN 'recheck' ELSE 'skip' END AS action FROM {SHARDS} n LEFT JOIN {OLD} o USING (domain, source)")
def incremental_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, M2, N2"""
    s = shards(spark, sf_dir)
    return catalog.classified(s, _old(s), ["domain", "source"]).select("domain", "source", "action")


@book.query(f"""
WITH n AS (SELECT * FROM {SHARDS} WHERE pos % 5 = 0 OR pos % 11 = 0), o AS {OLD}
SELECT coalesce(n.domain, o.domain) AS domain, coalesce(n.source, o.source) AS source,
 coalesce(o.pos, (SELECT max(pos) FROM o) + row_number() OVER (PARTITION BY o.pos IS NULL ORDER BY n.pos)) AS pos, coalesce(n.source_size, o.source_size) AS source_size, coalesce(n.tokens, o.tokens) AS tokens
FROM o FULL JOIN n ON o.domain = n.domain AND o.source = n.source""")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, K9"""
    s = shards(spark, sf_dir).select("domain", "source", "pos", "source_size", "tokens")
    return catalog.upserted(_old(s), s.where((F.pmod("pos", F.lit(5)) == 0) | (F.pmod("pos", F.lit(11)) == 0)), ["domain", "source"])


@book.query(f"SELECT sum(tokens)::BIGINT AS num_tokens, count(*) AS num_shards, 64000 AS vocab_size, 'uint16' AS shard_dtype FROM {SHARDS}")
def meta_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, K8"""
    return catalog.meta(shards(spark, sf_dir), 64000, 0, 1, "tokenizer.json", "uint16", "0").select("num_tokens", "num_shards", "vocab_size", "shard_dtype")


def cut_sql(rows: str, target: int = TARGET) -> str:
    """The cut with reset as a recursive statement; rows: (domain, ord, pos, shard, source, tokens, documents, emerged)."""
    return f"""
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ord) AS rn FROM {rows}),
c(domain, rn, bucket, total, full_) AS (
 SELECT domain, rn, 0::BIGINT, tokens * 2, tokens * 2 >= {target} FROM r WHERE rn = 1
 UNION ALL SELECT r.domain, r.rn, CASE WHEN c.full_ THEN c.bucket + 1 ELSE c.bucket END, CASE WHEN c.full_ THEN r.tokens * 2 ELSE c.total + r.tokens * 2 END,
  CASE WHEN c.full_ THEN r.tokens * 2 ELSE c.total + r.tokens * 2 END >= {target} FROM c JOIN r ON r.domain = c.domain AND r.rn = c.rn + 1),
b AS (SELECT r.*, c.bucket FROM r JOIN c USING (domain, rn)),
k AS (SELECT domain, bucket, row_number() OVER (ORDER BY min(emerged), bucket) - 1 AS nr FROM b GROUP BY domain, bucket)"""


ALL_ROWS = f"(SELECT *, pos AS ord, min(pos) OVER (PARTITION BY domain) AS emerged FROM {SHARDS})"
PLAN = f"""(WITH RECURSIVE {cut_sql(ALL_ROWS)}
SELECT nr AS merged_index, printf('shard_%05d.bin', nr) AS merged_shard, domain, bucket, row_number() OVER (PARTITION BY nr ORDER BY ord) - 1 AS place, pos, shard, source, tokens, documents FROM b JOIN k USING (domain, bucket))"""


@book.query(f"SELECT merged_index, merged_shard, domain, bucket, place, shard, tokens FROM {PLAN}", longs=("place",))
def merge_plan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, W4, W15"""
    return catalog.merge_plan(shards(spark, sf_dir), TARGET).select("merged_index", "merged_shard", "domain", "bucket", "place", "shard", "tokens")


EARLY = f"(SELECT * FROM {SHARDS} WHERE pos % 3 = 0)"
EARLY_ROWS = f"(SELECT *, pos AS ord, min(pos) OVER (PARTITION BY domain) AS emerged FROM {EARLY})"
LATE_ROWS = f"(SELECT *, pos AS ord, min(pos) OVER (PARTITION BY domain) AS emerged FROM {SHARDS} WHERE pos % 3 <> 0)"


@book.query(f"""
WITH RECURSIVE {cut_sql(LATE_ROWS)}, last AS (SELECT max(merged_index) AS m FROM (WITH RECURSIVE {cut_sql(EARLY_ROWS)} SELECT nr AS merged_index FROM k))
SELECT nr + m + 1 AS merged_index, printf('shard_%05d.bin', nr + m + 1) AS merged_shard, domain, bucket, shard, tokens FROM b JOIN k USING (domain, bucket), last""")
def merge_plan_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the shards is merged already; the rest goes into new ones."""
    s, place = shards(spark, sf_dir), work_dir(spark, "merged")
    catalog.merged_entries(catalog.merge_plan(s.where(F.pmod("pos", F.lit(3)) == 0), TARGET)).write.parquet(place)  # the manifest of the merge before
    return catalog.incremental_plan(spark.read.parquet(place), s, TARGET).select("merged_index", "merged_shard", "domain", "bucket", "shard", "tokens")


MERGED = f"""(SELECT merged_shard AS shard, merged_index, domain, sum(tokens)::BIGINT AS tokens, sum(documents)::BIGINT AS documents, round(sum(tokens)::BIGINT * 2 / (1024 * 1024), 2) AS shard_mb, list(shard ORDER BY place) AS shards, list(source ORDER BY place) AS sources FROM {PLAN} GROUP BY ALL)"""


@book.query(f"""SELECT shard, 'corpus/' || domain || printf('/_merged_%05d', merged_index) AS source, domain, tokens, documents, shard_mb, len(shards) AS parts, array_to_string(shards, ',') AS part_names FROM {MERGED.replace('GROUP BY ALL', 'GROUP BY merged_shard, merged_index, domain')}""", longs=("parts",))
def merged_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M6, F21"""
    m = catalog.merged_entries(catalog.merge_plan(shards(spark, sf_dir), TARGET))
    return m.select("shard", "source", "domain", "tokens", "documents", "shard_mb", F.size("merged_from").alias("parts"), F.array_join(F.transform("merged_from", lambda x: x["shard"]), ",").alias("part_names"))


@book.query(f"""
WITH refs AS (SELECT shard, domain, tokens, pos, 'shard_' || printf('%05d', pos // 10) || '.bin' AS merged_shard,
  CASE WHEN pos % 41 = 1 THEN 'ghost_' || shard ELSE shard END AS ref, CASE WHEN pos % 43 = 2 THEN tokens + 1 ELSE tokens END AS ref_tokens FROM {SHARDS}),
 dom AS (SELECT *, CASE WHEN (pos // 10) % 19 = 3 THEN 'data_moved' ELSE first(domain) OVER (PARTITION BY merged_shard ORDER BY pos) END AS merged_domain FROM refs),
 twice AS (SELECT * FROM dom UNION ALL SELECT * REPLACE ('extra.bin' AS merged_shard, domain AS merged_domain) FROM dom WHERE pos % 53 = 5)
SELECT 'double_claim' AS problem, merged_shard, ref AS shard FROM (SELECT *, count(*) OVER (PARTITION BY ref) AS n FROM twice) WHERE n > 1
UNION ALL SELECT CASE WHEN s.shard IS NULL THEN 'removed' WHEN s.tokens <> ref_tokens THEN 'retokenized' ELSE 'moved' END, merged_shard, ref
 FROM twice LEFT JOIN {SHARDS} s ON s.shard = ref WHERE s.shard IS NULL OR s.tokens <> ref_tokens OR s.domain <> merged_domain""")
def merge_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that were removed, retokenised, moved or claimed twice."""
    s = shards(spark, sf_dir)
    tens = F.floor(F.col("pos") / 10)
    refs = s.select(
        "pos", "domain", T.shard_name(tens).alias("merged_shard"), tens.alias("tens"), F.when(F.pmod("pos", F.lit(41)) == 1, F.concat(F.lit("ghost_"), F.col("shard"))).otherwise(F.col("shard")).alias("ref"),
        F.when(F.pmod("pos", F.lit(43)) == 2, F.col("tokens") + 1).otherwise(F.col("tokens")).alias("ref_tokens"), "source",
    )
    first = F.first("domain").over(Window.partitionBy("merged_shard").orderBy("pos"))
    named = refs.withColumn("merged_domain", F.when(F.pmod("tens", F.lit(19)) == 3, "data_moved").otherwise(first))
    extra = named.where(F.pmod("pos", F.lit(53)) == 5).withColumn("merged_shard", F.lit("extra.bin")).withColumn("merged_domain", F.col("domain"))
    # entries that share a name but not a domain stay apart
    merged = named.unionByName(extra).groupBy(F.col("merged_shard").alias("shard"), F.col("merged_domain").alias("domain")).agg(F.collect_list(F.struct(F.col("ref").alias("shard"), "source", F.col("ref_tokens").alias("tokens"))).alias("merged_from"))
    return catalog.divergences(merged, s)


@book.query(f"SELECT substr(sha256('{TARGET}' || string_agg('|' || source || '|' || source_size || '|' || source_hash || '|' || tokens, '' ORDER BY pos)), 1, 16) AS merge_fingerprint FROM {SHARDS}")
def merge_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26"""
    return catalog.fingerprint(shards(spark, sf_dir), TARGET)


@book.query(f"""
SELECT domain, count(*) AS shards, sum(t)::BIGINT AS tokens, sum(k)::BIGINT AS sources, min(t * 2)::BIGINT AS min_bytes, list_sort(list(t * 2))[len(list(t)) // 2 + 1]::BIGINT AS p50_bytes, max(t * 2)::BIGINT AS max_bytes
FROM (SELECT domain, merged_index, sum(tokens) AS t, count(*) AS k FROM {PLAN} GROUP BY 1, 2) GROUP BY domain""")
def plan_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10"""
    return catalog.plan_sizes(catalog.merge_plan(shards(spark, sf_dir), TARGET))


@book.query(f"SELECT merged_shard, place, shard, (coalesce(sum(tokens) OVER (PARTITION BY merged_shard ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2)::BIGINT AS byte_offset FROM {PLAN}", longs=("place",))
def shard_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5"""
    return catalog.offsets(catalog.merge_plan(shards(spark, sf_dir), TARGET)).select("merged_shard", "place", "shard", "byte_offset")


@book.query(f"SELECT merged_shard AS shard, domain, count(*) AS hits FROM {PLAN} WHERE contains(source, 'part_00001') GROUP BY 1, 2", longs=("hits",))
def forward_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, M15"""
    return catalog.holding(catalog.merged_entries(catalog.merge_plan(shards(spark, sf_dir), TARGET)), "part_00001")


@book.query(f"SELECT domain, count(DISTINCT merged_index) AS shards, sum(tokens)::BIGINT AS tokens, count(*) AS parts FROM {PLAN} GROUP BY domain")
def domain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2"""
    return catalog.rollup(catalog.merged_entries(catalog.merge_plan(shards(spark, sf_dir), TARGET)))


def _provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = catalog.merged_entries(catalog.merge_plan(shards(spark, sf_dir), TARGET))
    index = T.shard_index(F.col("shard"))
    selected, pinned = m.where(F.pmod(index, F.lit(3)) != 0), m.where(F.pmod(index, F.lit(7)) == 0)
    domains = selected.groupBy("domain").agg(F.count(F.lit(1)).alias("passes"), F.sum("tokens").alias("tokens"))
    return catalog.provenance(m, selected, pinned, mix(spark), domains)


PROVENANCE = f"""(WITH p AS {PLAN}, m AS (SELECT merged_shard, merged_index, domain, sum(tokens)::BIGINT AS merged_tokens FROM p GROUP BY 1, 2, 3),
 sel AS (SELECT domain, count(*) AS passes, sum(merged_tokens)::BIGINT AS tokens FROM m WHERE merged_index % 3 <> 0 GROUP BY domain)
SELECT p.source AS source_txt, string_split(p.source, '/')[-1] AS source_file, p.domain AS source_domain, p.tokens AS source_tokens, p.shard AS source_shard, p.merged_shard, p.domain AS merged_domain, m.merged_tokens,
 round(m.merged_tokens * 2 / (1024 * 1024), 2) AS merged_mb, CASE WHEN p.merged_index % 3 <> 0 THEN 'yes' ELSE 'no' END AS selected_for_training, CASE WHEN p.merged_index % 7 = 0 THEN 'yes' ELSE 'no' END AS eval_heldout,
 x.weight AS training_weight, sel.passes AS selected_domain_passes, sel.tokens AS selected_domain_tokens
FROM p JOIN m USING (merged_shard) LEFT JOIN {MIX_SQL} x ON x.domain = p.domain LEFT JOIN sel ON sel.domain = p.domain)"""


@book.query(f"SELECT * FROM {PROVENANCE}")
def provenance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, M14"""
    return _provenance(spark, sf_dir)


SUMMARY = """count(*) AS txt_files, sum(source_tokens)::BIGINT AS source_tokens, count(DISTINCT merged_shard) AS merged_shards,
 count(DISTINCT merged_shard) FILTER (WHERE selected_for_training = 'yes') AS selected_merged_shards, count(DISTINCT merged_shard) FILTER (WHERE eval_heldout = 'yes') AS eval_merged_shards"""


@book.query(f"SELECT source_domain AS domain, {SUMMARY} FROM {PROVENANCE} GROUP BY source_domain")
def domain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3"""
    return catalog.domain_summary(_provenance(spark, sf_dir))


@book.query(f"SELECT {SUMMARY} FROM {PROVENANCE}")
def provenance_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4"""
    return catalog.totals(_provenance(spark, sf_dir))


@book.query(f"SELECT merged_shard, source_shard, source_txt FROM {PROVENANCE} WHERE merged_shard IN (SELECT merged_shard FROM {PROVENANCE} WHERE contains(lower(source_txt), 'part_00010'))")
def sibling_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F15, J11"""
    return catalog.siblings(_provenance(spark, sf_dir), "PART_00010").select("merged_shard", "source_shard", "source_txt")


@book.query(f"SELECT source, tokens FROM {SHARDS} ORDER BY tokens DESC, pos LIMIT 30")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature."""
    return shards(spark, sf_dir).orderBy(F.col("tokens").desc(), "pos").limit(30).select("source", "tokens")


@book.query(f"""
WITH p AS {PLAN}, gone AS (SELECT * FROM p WHERE merged_index % 4 = 1),
 o AS (SELECT *, (coalesce(sum(tokens) OVER (PARTITION BY merged_shard ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2)::BIGINT AS byte_offset, tokens * 2 AS bytes FROM gone),
 t AS (SELECT o.*, CASE WHEN l.name IS NULL THEN 'absent' WHEN l.size <> bytes THEN 'wrong_size' ELSE 'found' END AS state FROM o LEFT JOIN {LISTING} l ON l.name = o.shard)
SELECT merged_shard, place, shard, byte_offset, bytes, state, count(*) FILTER (WHERE state = 'found') OVER w = count(*) OVER w AS complete FROM t WINDOW w AS (PARTITION BY merged_shard)""", longs=("place",))
def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth merged shard is lost; the archive lacks some parts."""
    s = shards(spark, sf_dir)
    m = catalog.merged_entries(catalog.merge_plan(s, TARGET))
    there = m.where(F.pmod(T.shard_index(F.col("shard")), F.lit(4)) != 1).select(F.col("shard").alias("name"), (F.col("tokens") * 2).alias("size"))
    return catalog.repair_plan(m, there, listing(s)).select("merged_shard", "place", "shard", "byte_offset", "bytes", "state", "complete")


@book.query(f"SELECT name, size FROM (SELECT shard AS name, tokens * 2 AS size FROM {SHARDS}) EXCEPT SELECT name, size FROM {LISTING}")
def copy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to be copied, by name and size."""
    s = shards(spark, sf_dir)
    return s.select(F.col("shard").alias("name"), (F.col("tokens") * 2).alias("size")).join(listing(s), ["name", "size"], "left_anti").distinct()


@book.query(f"SELECT domain, shard, (SELECT max(pos) FROM {SHARDS} WHERE pos % 3 = 0) + row_number() OVER (ORDER BY pos) AS new_index FROM {SHARDS} WHERE pos % 3 <> 0")
def next_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New shards are numbered after the last existing one."""
    s = shards(spark, sf_dir)
    old, new = s.where(F.pmod("pos", F.lit(3)) == 0), catalog.absent(s, s.where(F.pmod("pos", F.lit(3)) == 0), "shard")
    from ..operators.corpus import numbered

    last = old.agg(F.max(T.shard_index(F.col("shard"))).alias("last"))
    rows = numbered(new.withColumn("all", F.lit(0)), ["all"], "pos").crossJoin(F.broadcast(last))
    return rows.select("domain", "shard", (F.col("last") + F.col("nr") + 1).alias("new_index"))


@book.query(f"SELECT pos FROM {SHARDS} WHERE source_hash NOT IN (SELECT source_hash FROM {SHARDS} WHERE pos % 2 = 0)")
def subset_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps one set from holding another."""
    s = shards(spark, sf_dir)
    return catalog.absent(s, s.where(F.pmod("pos", F.lit(2)) == 0), "source_hash").select("pos")
