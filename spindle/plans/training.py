"""Selection, hold-out, remainders, windows, tokens and instruction rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budget, catalog, corpus, metrics, sft, tokens
from .corpus import PAIRS, stripped
from .registry import Book
from .tables import MIX_SQL, SHARDS, mix, order_sql, shards, table

book = Book()
TOTAL = 400_000  # tokens of the mix


def vocabulary() -> str:
    """The rank file that encoding uses: SPINDLE_RANKS, else one of the public files."""
    if path := os.environ.get("SPINDLE_RANKS"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of the mix's domains with the domain's budget; a mix is a few rows."""
    return shards(spark, sf_dir).join(F.broadcast(mix(spark)), "domain").withColumn("budget", T.truncated(F.col("weight") * F.lit(float(TOTAL))))


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mixed(spark, sf_dir).withColumn("o", T.seeded_order(42, "shard"))
    return budget.within_budget(rows, ["domain"], "o", "tokens", F.col("budget"))


RUN = "coalesce(sum(tokens) OVER (PARTITION BY {p} ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
SELECTED = f"""(SELECT * FROM (SELECT s.*, trunc(weight * {TOTAL}.0::DOUBLE)::BIGINT AS budget, {RUN.format(p='domain', o=order_sql(42, 'shard'))} AS before
 FROM {SHARDS} s JOIN {MIX_SQL} m USING (domain)) WHERE before < budget)"""


@book.query(f"""
SELECT domain, count(*) AS passes, sum(s.tokens)::BIGINT AS tokens, count(DISTINCT shard) AS unique_shards, any_value(a.n) AS available_shards, any_value(a.t) AS available_tokens,
 round(100 * sum(s.tokens)::BIGINT / any_value(a.t), 2) AS percent, round(count(*) / count(DISTINCT shard), 2) AS epochs
FROM {SELECTED} s JOIN (SELECT domain, count(*) AS n, sum(tokens)::BIGINT AS t FROM {SHARDS} GROUP BY domain) a USING (domain) GROUP BY domain""")
def mix_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, J15, A5, A6, M10"""
    return metrics.selection_summary(_selected(spark, sf_dir), shards(spark, sf_dir))


@book.query(f"""
WITH p AS (SELECT s.*, trunc(weight * {TOTAL * 20}.0::DOUBLE)::BIGINT AS budget, unnest(generate_series(1, max_epochs)) AS pass FROM {SHARDS} s JOIN {MIX_SQL} m USING (domain))
SELECT domain, shard, pass FROM (SELECT *, {RUN.format(p='domain', o="pass || " + order_sql(42, 'shard'))} AS before FROM p) WHERE before < budget""", longs=("pass",))
def mix_selection_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2"""
    rows = budget.repeated_passes(_mixed(spark, sf_dir).withColumn("budget", T.truncated(F.col("weight") * F.lit(float(TOTAL * 20)))))
    rows = rows.withColumn("o", F.concat(F.col("pass").cast("string"), T.seeded_order(42, "shard")))
    return budget.within_budget(rows, ["domain"], "o", "tokens", F.col("budget")).select("domain", "shard", "pass")


@book.query(f"SELECT domain, weight FROM {MIX_SQL} WHERE domain NOT IN (SELECT domain FROM {SHARDS})")
def mix_missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the mix without shards."""
    return catalog.absent(mix(spark), shards(spark, sf_dir), "domain").select("domain", "weight")


@book.query(f"SELECT domain, weight, max_epochs FROM (SELECT DISTINCT domain FROM {SHARDS}) LEFT JOIN {MIX_SQL} USING (domain)")
def training_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T28"""
    return shards(spark, sf_dir).select("domain").distinct().join(mix(spark).drop("ord"), "domain", "left")


HELD = """(SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {o}, shard) AS r, count(*) OVER (PARTITION BY domain) AS n FROM {s})"""


@book.query(f"SELECT domain, shard, r <= CASE WHEN n > 1 THEN greatest(1, trunc(0.05::DOUBLE * n)::BIGINT) ELSE 0 END AS held FROM {HELD.format(o=order_sql(1234, 'shard'), s=SHARDS)}")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8"""
    return budget.held_out(shards(spark, sf_dir), ["domain"], "shard", 0.05, 1234).select("domain", "shard", "held")


PIN = f"(SELECT * FROM {HELD.format(o=order_sql(1337, 'shard'), s=SHARDS)} WHERE r <= CASE WHEN n > 1 THEN least(5, greatest(1, trunc(0.2::DOUBLE * n)::BIGINT)) ELSE 0 END)"


def _pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.held_out(shards(spark, sf_dir), ["domain"], "shard", 0.2, 1337, cap=5).where("held")


@book.query(f"SELECT domain, shard FROM {PIN}")
def eval_pin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W9"""
    return _pin(spark, sf_dir).select("domain", "shard")


@book.query(f"SELECT domain, count(*) AS shards, sum(tokens)::BIGINT AS tokens FROM {SHARDS} WHERE shard NOT IN (SELECT shard FROM {PIN}) GROUP BY domain")
def train_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7"""
    pool = catalog.absent(shards(spark, sf_dir), _pin(spark, sf_dir), "shard")
    return pool.groupBy("domain").agg(F.count(F.lit(1)).alias("shards"), F.sum("tokens").alias("tokens"))


@book.query(f"SELECT p.shard, s.tokens, s.source, s.pos % 17 <> 0 AS present FROM {PIN} p JOIN {SHARDS} s USING (shard)")
def pin_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest entries of a pin, and whether their files are there."""
    s = shards(spark, sf_dir)
    from .tables import listing

    there = listing(s).select(F.col("name").alias("shard"), F.lit(True).alias("present"))
    return _pin(spark, sf_dir).select("shard").join(s, "shard").join(there, "shard", "left").select("shard", "tokens", "source", F.coalesce("present", F.lit(False)).alias("present"))


PASSES = f"(SELECT s.*, p.pass, p.pass * 1000000 + pos AS place FROM {SHARDS} s, (SELECT unnest([0, 1, 2]) AS pass) p WHERE s.pos % 3 >= p.pass)"


@book.query(f"""
WITH seen AS (SELECT shard, sum(k) AS n FROM (SELECT shard, pos % 4 AS k FROM {SHARDS}) GROUP BY shard), p AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY place) AS nth FROM {PASSES})
SELECT shard, place FROM p LEFT JOIN seen USING (shard) WHERE nth > coalesce(n, 0)""")
def seen_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, U3"""
    s = shards(spark, sf_dir)
    plan = s.withColumn("pass", F.explode(F.sequence(F.lit(0), F.pmod("pos", F.lit(3)).cast("int")))).withColumn("place", F.col("pass") * 1_000_000 + F.col("pos"))
    seen = s.where(F.pmod("pos", F.lit(4)) > 0).select("shard", F.explode(F.sequence(F.lit(1), F.pmod("pos", F.lit(4)).cast("int"))).alias("k"))
    return budget.minus_seen(plan, seen, position="place").select("shard", "place")


NEED = budget.need(300, 100, 1024)


@book.query(f"SELECT shard, tokens FROM (SELECT *, {RUN.format(p='1', o=order_sql(9, 'shard'))} AS before FROM {SHARDS}) WHERE before < {NEED}")
def trim_to_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, T15, M11"""
    return budget.trimmed(shards(spark, sf_dir).withColumn("o", T.seeded_order(9, "shard")), "o", "tokens", NEED).select("shard", "tokens")


@book.query(f"SELECT shard, domain FROM {SELECTED} UNION SELECT shard, domain FROM {PIN}")
def pull_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards to fetch: selected ones and pinned ones, each once."""
    selected, pinned = _selected(spark, sf_dir).select("shard", "domain"), _pin(spark, sf_dir).select("shard", "domain")
    return selected.distinct().unionByName(catalog.absent(pinned, selected, "shard").select("shard", "domain").distinct())


@book.query(f"SELECT domain, count(*) AS passes, count(DISTINCT shard) AS unique_shards FROM (SELECT domain, shard FROM {SELECTED} UNION ALL SELECT domain, shard FROM {PIN}) GROUP BY domain")
def seen_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29, U5"""
    bag = _selected(spark, sf_dir).select("domain", "shard").unionByName(_pin(spark, sf_dir).select("domain", "shard"))
    return bag.groupBy("domain").agg(F.count(F.lit(1)).alias("passes"), F.count_distinct("shard").alias("unique_shards"))


@book.query("SELECT doc_id, greatest(0, floor((n_chars - 256 - 1) / 200.0::DOUBLE))::BIGINT AS windows FROM documents")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7"""
    return table(spark, sf_dir, "documents").select("doc_id", tokens.window_count(F.col("n_chars"), 256, 200).alias("windows"))


def _code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token streams: each character's code point is an id."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.transform(F.split("text", ""), lambda c: F.ascii(c)).alias("ids"))


@book.query("""
WITH w AS (SELECT doc_id, text, unnest(generate_series(0, greatest(0, (n_chars - 257) // 200) - 1)) AS win FROM documents WHERE n_chars >= 457)
SELECT doc_id, win, unicode(substr(text, win * 200 + 1, 1)) AS x_first, unicode(substr(text, win * 200 + 256, 1)) AS x_last, unicode(substr(text, win * 200 + 2, 1)) AS y_first, unicode(substr(text, win * 200 + 257, 1)) AS y_last, 256 AS n FROM w""")
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7, D13"""
    w = tokens.training_windows(_code_points(spark, sf_dir), 256, 200)
    return w.select("doc_id", "win", F.col("x")[0].alias("x_first"), F.col("x")[255].alias("x_last"), F.col("y")[0].alias("y_first"), F.col("y")[255].alias("y_last"), F.size("y").alias("n"))


@book.query("""
WITH w AS (SELECT doc_id, unnest(generate_series(0, greatest(0, (n_chars - 257) // 50) - 1)) AS win FROM documents WHERE n_chars >= 307)
SELECT doc_id, win // 4 // 16 AS step, count(*) AS windows, count(DISTINCT win // 4) AS micro_batches FROM w GROUP BY 1, 2""")
def accumulation_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W18"""
    n = tokens.window_count(F.col("n_chars"), 256, 50)
    wins = table(spark, sf_dir, "documents").where(n > 0).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("win"))
    return tokens.accumulation_groups(wins, 4, 16, shard="doc_id").groupBy("doc_id", "step").agg(F.count(F.lit(1)).alias("windows"), F.count_distinct("micro").alias("micro_batches"))


@book.query(f"SELECT unnest(regexp_extract_all(text, '{tokens.PRE_TOKEN_PLAIN}')) AS piece, count(*) AS count FROM documents GROUP BY 1")
def pretokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2, in the form without look-ahead"""
    return tokens.pre_token_counts(table(spark, sf_dir, "documents"), "(?U)" + tokens.PRE_TOKEN_PLAIN)


@book.query(None)
def pretokenize_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2; SQL engines without look-ahead can't say it."""
    return tokens.pre_token_counts(table(spark, sf_dir, "documents"))


@book.query("SELECT c AS id, count(*) AS count FROM (SELECT unicode(unnest(string_split(text, ''))) AS c FROM documents) WHERE c >= 97 GROUP BY c ORDER BY count DESC, id LIMIT 20")
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, O3 over code points: the twenty are the feature."""
    return tokens.top_tokens(_code_points(spark, sf_dir), 20, specials=97)


@book.query("SELECT sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, sum(n_chars)::BIGINT AS tokens, round(sum(length(text)) / sum(n_chars), 3) AS chars_per_token, round(sum(strlen(text)) / sum(n_chars), 3) AS bytes_per_token FROM documents")
def compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 over code points"""
    return tokens.compression(table(spark, sf_dir, "documents").select("text", F.split("text", "").alias("ids")))


@book.query(None)
def bpe_encode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, as counts and a digest."""
    found = tokens.encode(table(spark, sf_dir, "documents"), vocabulary())
    return found.select("doc_id", F.size("ids").alias("n_ids"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"))


@book.query("SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4, X5"""
    ids = tokens.encode(table(spark, sf_dir, "documents"), vocabulary())
    return tokens.decode(ids, vocabulary()).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@book.query(None)
def tokenizer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6"""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.tokenizer_gate(docs.join(tokens.encode(docs, vocabulary()), "doc_id"))


@book.query(None)
def spot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample is the feature."""
    docs = table(spark, sf_dir, "documents").select(T.shard_name(F.col("doc_id")).alias("shard"), "text")
    return tokens.spot_check(tokens.encode(docs, vocabulary(), key="shard"), docs, vocabulary(), 100, 42).select("shard", "status")


@book.query("SELECT i AS id, CASE WHEN i < 9 THEN (['<|endoftext|>', '<|pad|>', '<|im_start|>', '<|im_end|>', '<|fim_prefix|>', '<|fim_middle|>', '<|fim_suffix|>', '<|tool_call|>', '<|tool_result|>'])[i + 1] ELSE '<|reserved_' || (i - 9) || '|>' END AS token FROM range(256) t(i)")
def special_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1"""
    return tokens.special_tokens(spark)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = corpus.turns_to_pairs(table(spark, sf_dir, "conversations"))
    return pairs.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), F.col("prompt").alias("instruction"), F.when(F.pmod("turn", F.lit(2)) == 0, "").otherwise("given").alias("input"), F.col("response").alias("output"))


SFT_RAW = f"(SELECT conv_id * 1000 + turn AS pos, {stripped('prompt')} AS instruction, CASE WHEN turn % 2 = 0 THEN '' ELSE 'given' END AS input, {stripped('response')} AS output FROM {PAIRS})"
SFT = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instruction, input, output ORDER BY pos) AS r FROM {SFT_RAW} WHERE instruction <> '' AND output <> '' AND length(instruction) + length(input) + length(output) >= 10) WHERE r = 1)"


@book.query(f"""SELECT pos, sha256('<|im_start|>user' || chr(10) || instruction || CASE WHEN input <> '' THEN chr(10) || chr(10) || input ELSE '' END || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant') AS prompt_sha256, sha256(chr(10) || output || '<|im_end|><|endoftext|>') AS response_sha256 FROM {SFT}""")
def sft_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, F10, U1, X9"""
    return sft.rendered(sft.prepared(_rows(spark, sf_dir))).select("pos", F.sha2("prompt", 256).alias("prompt_sha256"), F.sha2("response", 256).alias("response_sha256"))


@book.query(f"""SELECT reason, count(*) AS count FROM (SELECT CASE WHEN r < 3 THEN 'short_response' WHEN p >= 256 THEN 'prompt_too_long' WHEN p + r > 257 AND pos % 5 <> 0 THEN 'truncation_lost_eos' ELSE 'kept' END AS reason
FROM (SELECT pos, length(instruction) // 4 AS p, length(output) // 40 AS r FROM {SFT})) GROUP BY reason""")
def sft_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11 over lengths in place of ids"""
    rows = sft.prepared(_rows(spark, sf_dir)).select("pos", F.floor(F.length("instruction") / 4).alias("p"), F.floor(F.length("output") / 40).alias("r"))
    reason = sft.verdict(F.col("p"), F.col("r"), F.pmod("pos", F.lit(5)) == 0, 256)
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).count()


@book.query(f"SELECT pos, CASE WHEN row_number() OVER (ORDER BY {order_sql(42, 'pos')}) <= (SELECT greatest(1, trunc(count(*) * 0.05::DOUBLE)::BIGINT) FROM {SFT}) THEN 'val' ELSE 'train' END AS part FROM {SFT}")
def sft_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12"""
    return sft.split(sft.prepared(_rows(spark, sf_dir)), 0.05, 42, "pos").select("pos", "part")


@book.query(None)
def sft_tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and response encoded apart, joined, cut and judged."""
    rows = sft.rendered(sft.prepared(_rows(spark, sf_dir))).select("pos", "prompt", "response")
    end = F.size("ids") - 1  # each encoding ends with the end id; the texts carry their own
    p = tokens.encode(rows.withColumnRenamed("prompt", "text"), vocabulary(), key="pos").select("pos", F.slice("ids", F.lit(1), end).alias("prompt_ids"))
    r = tokens.encode(rows.withColumnRenamed("response", "text"), vocabulary(), key="pos").select("pos", F.slice("ids", F.lit(1), end).alias("response_ids"))
    cut = sft.cut_rows(p.join(r, "pos"), 512, 0).where("reason IS NULL")
    return cut.select("pos", "prefix_len", F.size("input_ids").alias("n_ids"), tokens.ends_well(F.col("input_ids"), 0, tokens.SPECIALS.index("<|im_end|>")).alias("ends_well"))


@book.query("SELECT doc_id, greatest(length(text) - 16, 0) AS kept, least(length(text), 16) AS masked FROM documents WHERE text <> ''", longs=("kept", "masked"))
def masked_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over whole texts."""
    masked = _code_points(spark, sf_dir).select("doc_id", tokens.masked_targets(F.col("ids"), F.lit(16)).alias("y"))
    return masked.select("doc_id", F.size(F.filter("y", lambda v: v != -100)).alias("kept"), F.size(F.filter("y", lambda v: v == -100)).alias("masked"))


@book.query("SELECT doc_id, len(list_distinct(string_split(right(text, 256), ''))) AS n_seen FROM documents WHERE text <> ''", longs=("n_seen",))
def look_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W14"""
    return _code_points(spark, sf_dir).select("doc_id", F.size(tokens.look_back(F.col("ids"))).alias("n_seen"))
