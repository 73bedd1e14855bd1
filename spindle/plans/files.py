"""Round trips through files, and figures of single values: readers, sinks, incremental runs, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, corpus, gates, metrics
from ..session import work_dir
from ..sources import files
from ..streaming import incremental
from .corpus import stripped
from .registry import Book
from .tables import LISTING, MIX_SQL, SHARDS, listing, mix, shards, table

book = Book()


@book.query(f"SELECT substr(sha256({stripped('text')}), 1, 16) AS text_hash, count(*) AS n FROM documents WHERE {stripped('text')} <> '' GROUP BY 1")
def packed_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into text files, written twice, and read back."""
    place = work_dir(spark, "packed")
    packed = corpus.packed_files(table(spark, sf_dir, "documents"), ["source"], "doc_id", 50).select("source", "file_no", "content")
    for _ in range(2):  # what exists is left alone
        files.write_text_files(packed, place, ["source", "file_no"])
    return files.text_documents(spark, place).groupBy(T.sha16(F.col("text")).alias("text_hash")).agg(F.count(F.lit(1)).alias("n"))


def _token_files(spark: SparkSession, sf_dir: str) -> str:
    """A shard of 32-bit ids a document: its code points."""
    place = work_dir(spark, "shards")
    files.register(spark)
    ids = F.transform(F.split("text", ""), lambda c: F.ascii(c).cast("long"))
    rows = table(spark, sf_dir, "documents").where("text <> ''").select(T.shard_name(F.col("doc_id")).alias("shard"), ids.alias("ids"))
    rows.write.format("token_shard_files").option("dtype", "uint32").option("path", place).mode("append").save()
    return place


NAMED = "(SELECT printf('shard_%05d.bin', doc_id) AS shard, text, length(text) AS n FROM documents WHERE text <> '')"


@book.query(f"SELECT shard, n, unicode(substr(text, 1, 1)) AS first_id, unicode(right(text, 1)) AS last_id, true AS aligned FROM {NAMED}", longs=("n", "first_id", "last_id"))
def token_shard_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, S9, D4"""
    got = files.token_shards(spark, _token_files(spark, sf_dir), "uint32")
    return got.select("shard", F.size("ids").alias("n"), F.col("ids")[0].alias("first_id"), F.element_at("ids", -1).alias("last_id"), "aligned")


@book.query(f"SELECT shard, CASE WHEN n >= 300 THEN unicode(substr(text, 300, 1)) END AS id_300 FROM {NAMED}", longs=("id_300",))
def token_shard_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ids only; the prefix is the feature."""
    got = files.token_shards(spark, _token_files(spark, sf_dir), "uint32", max_tokens=300)
    return got.select("shard", F.get("ids", F.lit(299)).alias("id_300"))


@book.query(f"SELECT shard AS name, n * 4 AS size FROM {NAMED}")
def shard_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, S14"""
    return files.listing(spark, _token_files(spark, sf_dir), "shard_*.bin")


@book.query("SELECT doc_id, lang, source, n_chars FROM documents")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls stay nulls."""
    place = work_dir(spark, "lines")
    files.write_json_lines(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), place)
    return files.scan(spark, place, "json", schema="doc_id long, lang string, source string, n_chars long")


@book.query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def csv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with a header, found among candidates and read back."""
    place = work_dir(spark, "report")
    files.write_csv(table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")), place)
    found = files.first_existing(spark, [place + "-absent", place])
    return spark.read.option("header", "true").schema("lang string, n long, chars long").csv(found)


def _manifest(spark: SparkSession, sf_dir: str) -> str:
    place = work_dir(spark, "manifest")
    p = F.col("pos")
    entry = F.struct(F.when(F.pmod(p, F.lit(31)) != 3, F.col("shard")).alias("shard"), "source", F.when(F.pmod(p, F.lit(29)) == 2, -F.col("tokens")).otherwise(F.col("tokens")).alias("tokens"), "documents")
    rows = shards(spark, sf_dir).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda x: x["e"]).alias("shards"))
    rows.select(F.lit("id").alias("tokenization_id"), "shards").coalesce(1).write.option("ignoreNullFields", "false").json(place)
    return place


@book.query(f"SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, CASE WHEN pos % 31 <> 3 THEN shard END AS shard, CASE WHEN pos % 29 = 2 THEN -tokens ELSE tokens END AS tokens FROM {SHARDS}")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11, D5, K3"""
    return files.manifest(spark, _manifest(spark, sf_dir)).select("pos", "shard", "tokens")


@book.query(f"""
WITH m AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS place, * FROM {SHARDS})
SELECT place AS pos, 'shard: null' AS fault FROM m WHERE pos % 31 = 3 UNION ALL SELECT place, 'tokens: negative' FROM m WHERE pos % 29 = 2 AND tokens > 0""", longs=("pos",))
def manifest_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: null and negative fields of a manifest as it is."""
    return files.manifest_faults(spark, _manifest(spark, sf_dir))


META = f"(SELECT count(*) AS n, sum(tokens)::BIGINT AS t FROM {SHARDS})"


@book.query(f"SELECT 'num_shards' AS fault, (n + 1)::VARCHAR AS stated, n::VARCHAR AS found FROM {META} UNION ALL SELECT 'manifest identity', 'b', 'a' UNION ALL SELECT 'meta without shard_dtype', NULL, 'a value'")
def meta_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8, K8: a summary that counts a shard too many and lacks a field, beside another identity."""
    s = shards(spark, sf_dir)
    m = catalog.meta(s, 64000, 0, 1, "tokenizer.json", "uint16", "a").withColumn("num_shards", F.col("num_shards") + 1).drop("shard_dtype")
    return gates.meta_faults(s, m, "b", "a")


@book.query(f"""
SELECT doc_id, length(text) AS chars FROM documents WHERE length({stripped('text')}) >= 200""", longs=("chars",))
def resumed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, the second over what came since."""
    place, docs = work_dir(spark, "ingest"), table(spark, sf_dir, "documents").select("doc_id", "text")
    keep = lambda df: corpus.keep(df, [("short", corpus.too_short(F.col("text")))])
    for k in (0, 1):
        docs.where(F.pmod("doc_id", F.lit(2)) == k).write.mode("append").parquet(f"{place}/in")
        incremental.ingest(spark, f"{place}/in", "doc_id long, text string", f"{place}/out", f"{place}/check", keep)
    return spark.read.parquet(f"{place}/out").select("doc_id", F.length("text").alias("chars"))


@book.query(f"SELECT source, CASE WHEN pos % 5 = 0 THEN source_size + 1 ELSE source_size END AS source_size, CASE WHEN pos % 5 = 0 THEN 2 ELSE 1 END AS run FROM {SHARDS} WHERE pos % 7 <> 0 OR pos % 5 = 0", longs=("run",))
def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a second run that are new or of another size are turned into entries again."""
    place = work_dir(spark, "entries")
    s = shards(spark, sf_dir).select("pos", "domain", "source", "source_size", "source_hash")
    schema, fives = "pos long, domain string, source string, source_size long, source_hash string", F.pmod("pos", F.lit(5)) == 0
    runs = [s.where(F.pmod("pos", F.lit(7)) != 0), s.where(fives).withColumn("source_size", F.col("source_size") + 1)]
    for nr, rows in enumerate(runs, 1):
        rows.write.mode("append").parquet(f"{place}/in")
        incremental.retokenize(spark, f"{place}/in", schema, f"{place}/manifest", f"{place}/check", lambda df, nr=nr: df.withColumn("run", F.lit(nr)), ["domain", "source"])
    return incremental.latest(spark, f"{place}/manifest").select("source", "source_size", "run")


@book.query(f"SELECT shard FROM {SHARDS} WHERE pos % 3 <> 0")
def remaining_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4"""
    s = shards(spark, sf_dir)
    return catalog.absent(s, s.where(F.pmod("pos", F.lit(3)) == 0).select("shard"), "shard").select("shard")


@book.query(f"SELECT name FROM {LISTING} WHERE name NOT IN (SELECT shard FROM {SHARDS})")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5"""
    s = shards(spark, sf_dir)
    return listing(s).join(s.select(F.col("shard").alias("name")), "name", "left_anti").select("name")


@book.query(f"SELECT shard FROM {SHARDS} WHERE shard NOT IN (SELECT name FROM {LISTING}) ORDER BY shard LIMIT 20")
def first_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature."""
    s = shards(spark, sf_dir)
    return catalog.absent(s, listing(s).select(F.col("name").alias("shard")), "shard").select("shard").orderBy("shard").limit(20)


@book.query(f"SELECT DISTINCT shard FROM {SHARDS} s JOIN {MIX_SQL} m USING (domain) WHERE pos % 4 < 2")
def selected_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of all sources of a training manifest."""
    rows = shards(spark, sf_dir).join(mix(spark).select("domain"), "domain").where(F.pmod("pos", F.lit(4)) < 2)
    per = rows.groupBy("domain").agg(F.struct(F.count(F.lit(1)).alias("passes"), F.sum("tokens").alias("tokens"), F.collect_set("shard").alias("unique")).alias("s"))
    training = per.agg(F.map_from_entries(F.collect_list(F.struct("domain", "s"))).alias("sources")).select(F.struct("sources").alias("data_selection"))
    return gates.selected_names(training)


@book.query("SELECT source, round(sum(strlen(text)) / 1073741824, 12) AS gigabytes, round(sum(strlen(text)) / 1048576 / greatest(count(*) * 0.25::DOUBLE, 0.01), 9) AS megabytes_a_second FROM documents GROUP BY source")
def copy_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of a second a file."""
    rows = table(spark, sf_dir, "documents").select("source", F.octet_length("text").cast("long").alias("size"))
    r = gates.throughput(rows, ["source"], "size", F.count(F.lit(1)) * 0.25)
    return r.select("source", F.round("gigabytes", 12).alias("gigabytes"), F.round("megabytes_a_second", 9).alias("megabytes_a_second"))


@book.query(f"SELECT 'wanted' AS wish, 'shard_00003.bin' AS picked UNION ALL SELECT 'absent', max(shard) FROM {SHARDS}")
def preferred_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O11"""
    names = shards(spark, sf_dir).select(F.col("shard").alias("name"))
    wishes = {"wanted": "shard_00003.bin", "absent": "nobody.bin"}
    one = [gates.preferred(names, wanted, ".bin").select(F.lit(wish).alias("wish"), "picked") for wish, wanted in wishes.items()]
    return one[0].unionByName(one[1])


@book.query("SELECT 'max_id' AS fault, max(doc_id) * 100 AS value, 65535 AS most FROM documents HAVING max(doc_id) * 100 > 65535", longs=("most",))
def id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """few ids, the greatest of them too large for the token type in larger tables."""
    return gates.id_range_faults(table(spark, sf_dir, "documents").select((F.col("doc_id") * 100).alias("id")), "uint16").where("fault = 'max_id'")


@book.query(f"SELECT shard, substr(sha256('tokenizer ' || (pos % 2)), 1, 16) AS tokenization_id FROM {SHARDS} WHERE pos % 2 = 1")
def still_valid_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that the present tokenizer file made."""
    place = work_dir(spark, "tokenizer")
    spark.range(1).select(F.lit("tokenizer 1").alias("value")).coalesce(1).write.option("lineSep", "|").text(place)
    made = shards(spark, sf_dir).select("shard", T.sha16(F.concat(F.lit("tokenizer "), F.pmod("pos", F.lit(2)).cast("string"))).alias("tokenization_id"))
    identity = spark.read.option("lineSep", "|").text(place).select(T.sha16(F.col("value")).alias("tokenization_id"))
    return gates.still_valid(made, identity).select("shard", "tokenization_id")


@book.query(f"SELECT 'rebuild' AS action, count(*) AS inputs FROM {SHARDS} UNION ALL SELECT 'nothing', 0 UNION ALL SELECT 'dry extend', count(*) FROM {SHARDS} WHERE pos % 3 <> 0")
def merge_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: a first merge, the same inputs again, and further inputs in a dry run."""
    s, target = shards(spark, sf_dir), 60_000
    disk, third = s.select(F.col("shard").alias("name")), s.where(F.pmod("pos", F.lit(3)) == 0)
    merged = catalog.merged_entries(catalog.merge_plan(third, target))
    done = gates.merge_run(third, "t", target, disk)[2]
    runs = [gates.merge_run(s, "t", target, disk), gates.merge_run(third, "t", target, disk, merged, done), gates.merge_run(s, "t", target, disk, merged, done, dry_run=True)]
    rows = [(action, 0 if plan is None else plan.count()) for action, plan, _ in runs]  # three actions
    return spark.createDataFrame(rows, "action string, inputs long")


@book.query("""
SELECT o_orderkey AS k, round_even(o_orderkey * 0.25::DOUBLE, 1) AS half_even, trunc(o_totalprice * 0.05::DOUBLE)::BIGINT AS cut, o_orderkey // 7 AS seventh,
 round(exp(o_orderkey % 10 / 10.0::DOUBLE) + ln(o_orderkey + 1) + sqrt(o_orderkey) + pow(o_orderkey % 10, 1.5::DOUBLE) + cos(o_orderkey % 10), 8) AS figures,
 printf('%.1f MB', o_orderkey * 125000 / 1e6::DOUBLE) AS size_text, len(list_distinct([o_orderkey % 3, o_orderkey % 2, 1])) AS distinct_n FROM orders""", longs=("distinct_n",))
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T10, T11, T12, T13, T25, T30"""
    k, p = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    tenth = F.pmod(k, F.lit(10)).cast("double")
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), F.bround(k * F.lit(0.25), 1).alias("half_even"), T.truncated(p * 0.05).alias("cut"), F.floor(k / 7).alias("seventh"),
        F.round(F.exp(tenth / 10) + F.log(k + 1) + F.sqrt(k) + F.pow(tenth, F.lit(1.5)) + F.cos(tenth), 8).alias("figures"),
        F.replace(T.megabytes(k * 125000), F.lit(","), F.lit("")).alias("size_text"), F.size(F.array_distinct(F.array(F.pmod(k, F.lit(3)), F.pmod(k, F.lit(2)), F.lit(1)))).alias("distinct_n"),
    )


@book.query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words FROM documents", longs=("words",))
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T24"""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).alias("words"))


@book.query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T29"""
    return table(spark, sf_dir, "events").select("event_id", T.iso(F.col("ts")).alias("iso"))


@book.query("SELECT 'layer_' || vec_id AS name FROM embeddings WHERE vec_id % 4 <> 1")
def matching_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored names with a prefix, some of another shape."""
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("layer_"), F.col("vec_id").cast("string")).alias("name"), F.col("vec_id").alias("v"))
    stored = e.select(F.concat(F.when(F.pmod("v", F.lit(2)) == 0, "_orig_mod.").otherwise(""), F.col("name")).alias("name"), F.lit("2x2").alias("shape"))
    wanted = e.select("name", F.when(F.pmod("v", F.lit(4)) == 1, "3x3").otherwise("2x2").alias("shape"))
    return metrics.matching_weights(stored, wanted).select("name")
