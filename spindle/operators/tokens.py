"""Pre-tokens, encoding, windows and the tokenizer gate.

Vocabularies come as data: (token bytes, rank) tables or rank files. None is learned here.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Pre-tokens: each digit alone, contractions, letters, symbols, white space; fixed value.
PRE_TOKEN = r"(?U)\p{N}|'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?[^\s\p{L}\p{N}]+|\s+(?![^\s\p{N}])|\s+"
#: The same without look-ahead, for engines that lack it.
PRE_TOKEN_PLAIN = r"\p{N}| ?\p{L}+| ?[^\s\p{L}\p{N}]+|\s+"
#: Named special tokens in id order; reserved ones follow up to RESERVED; fixed values.
SPECIALS = ("<|endoftext|>", "<|pad|>", "<|im_start|>", "<|im_end|>", "<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>", "<|tool_call|>", "<|tool_result|>")
RESERVED = 256
#: Bounds of the gate: characters and bytes a token, share of the most frequent one; fixed values.
GATE = {"chars_low": 3.0, "chars_high": 6.0, "bytes_low": 2.5, "top_high": 0.10}


def special_tokens(spark: SparkSession) -> DataFrame:
    """(id, token): the named ones, then reserved ones."""
    named = F.element_at(F.array(*[F.lit(s) for s in SPECIALS]), (F.least(F.col("id"), F.lit(len(SPECIALS) - 1)) + 1).cast("int"))
    return spark.range(RESERVED).select("id", F.when(F.col("id") < len(SPECIALS), named).otherwise(F.format_string("<|reserved_%d|>", F.col("id") - len(SPECIALS))).alias("token"))


def pre_tokens(text: Column, pattern: str = PRE_TOKEN) -> Column:
    """The pieces of a text, in order and without loss."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pre_token_counts(docs: DataFrame, pattern: str = PRE_TOKEN, text: str = "text") -> DataFrame:
    """How often each piece occurs; counts are summed before the shuffle."""
    return docs.select(F.explode(pre_tokens(F.col(text), pattern)).alias("piece")).groupBy("piece").count()


@lru_cache(maxsize=4)
def rank_file(path: str) -> dict[bytes, int]:
    """A rank file's tokens and ids."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair of least rank merges first, leftmost on ties."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


@lru_cache(maxsize=4)
def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """Text to ranks; by a library of compiled merges where it is installed, else by merge()."""
    ranks, pattern = rank_file(vocabulary), PRE_TOKEN.removeprefix("(?U)")
    try:
        import tiktoken
    except ImportError:
        import regex

        pieces, own = regex.compile(pattern), lru_cache(maxsize=300_000)(lambda p: merge(p.encode(), ranks))
        return lambda text: [r for p in pieces.findall(text) for r in own(p)]
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces, so that the ids of few texts are in a worker's memory at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, vocabulary: str, shift: int = RESERVED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): special tokens in the text are atomic, the end id follows each document.

    vocabulary: a rank file that every executor can open. Ranks become ids after the specials.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile("(" + "|".join(map(re.escape, SPECIALS)) + ")")
        special = {s: [i] for i, s in enumerate(SPECIALS)}
        plain = encoder(vocabulary)
        for batch in slices(batches):
            out = []
            for t in batch["text"]:
                ids: list[int] = []
                for part in cut.split(t.as_py() or ""):
                    ids += special[part] if part in special else [r + shift for r in plain(part)]
                out.append(np.array([*ids, 0], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(out, pa.list_(pa.int32()))], [key, "ids"])

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(run, f"{key} {slim.schema['key'].dataType.simpleString()}, ids array<int>")


def vocabulary_table(spark: SparkSession, vocabulary: str, shift: int = RESERVED) -> DataFrame:
    """(id, token bytes) of a rank file."""
    rows = [(r + shift, bytearray(t)) for t, r in rank_file(vocabulary).items()]
    return spark.createDataFrame(rows, "id int, token binary").unionByName(special_tokens(spark).select(F.col("id").cast("int"), F.encode("token", "UTF-8").alias("token")))


def decode(ids: DataFrame, vocabulary: str, shift: int = RESERVED, key: str = "doc_id") -> DataFrame:
    """(key, text) of token ids, special tokens left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {r + shift: t for t, r in rank_file(vocabulary).items()}
        for batch in slices(batches):
            texts = [b"".join(tokens.get(i, b"") for i in x.as_py() or ()).decode(errors="replace") for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(texts, pa.string())], [key, "text"])

    slim = ids.select(F.col(key).alias("key"), "ids")
    return slim.mapInArrow(run, f"{key} {slim.schema['key'].dataType.simpleString()}, text string")


def top_tokens(ids: DataFrame, n: int = 20, specials: int = RESERVED) -> DataFrame:
    """The n most frequent tokens without special ones, ties by id."""
    return ids.select(F.explode("ids").alias("id")).where(F.col("id") >= specials).groupBy("id").count().orderBy(F.col("count").desc(), "id").limit(n)


def compression(docs: DataFrame, text: str = "text") -> DataFrame:
    """Characters and bytes a token; docs has text and ids."""
    sums = docs.agg(F.sum(F.length(text)).alias("chars"), F.sum(F.octet_length(text)).alias("bytes"), F.sum(F.size("ids")).alias("tokens"))
    n = F.greatest(F.lit(1), F.col("tokens"))
    return sums.select("chars", "bytes", "tokens", F.round(F.col("chars") / n, 3).alias("chars_per_token"), F.round(F.col("bytes") / n, 3).alias("bytes_per_token"))


def gate_failures(chars: Column, bytes_: Column, top: Column) -> Column:
    """Which bounds a tokenizer's figures break; an empty list passes."""
    rules = (("chars_per_token_low", chars < GATE["chars_low"]), ("chars_per_token_high", chars > GATE["chars_high"]), ("bytes_per_token_low", bytes_ < GATE["bytes_low"]), ("top_token_share", top > GATE["top_high"]))
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())


def tokenizer_gate(docs: DataFrame, text: str = "text") -> DataFrame:
    """Figures and failures over encoded documents; raise_on_failure() aborts on them."""
    figures = compression(docs, text)
    counts = docs.select(F.explode("ids").alias("id")).where(F.col("id") >= RESERVED).groupBy("id").count()
    share = counts.agg((F.max("count") / F.greatest(F.lit(1), F.sum("count"))).alias("top_share"))
    both = figures.crossJoin(F.broadcast(share))  # a row each
    return both.withColumn("failures", gate_failures(F.col("chars_per_token"), F.col("bytes_per_token"), F.coalesce("top_share", F.lit(0.0))))


def raise_on_failure(gate: DataFrame) -> None:
    found = gate.first().failures
    if found:
        raise ValueError("tokenizer gate: " + ", ".join(found))


def window_count(n: Column, block: int, stride: int) -> Column:
    """How many training windows n tokens give; exactly block + 1 give none."""
    return F.greatest(F.lit(0), F.floor((n - block - 1) / stride)).cast("long")


def training_windows(shards: DataFrame, block: int, stride: int, ids: str = "ids") -> DataFrame:
    """(.., win, x, y): y is x moved on by one token."""
    n = window_count(F.size(ids), block, stride)
    wins = shards.withColumn("win", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))))
    at = (F.col("win") * stride + 1).cast("int")
    return wins.select(*[c for c in shards.columns if c != ids], "win", F.slice(ids, at, block).alias("x"), F.slice(ids, at + 1, block).alias("y"))


def random_windows(shards: DataFrame, block: int, k: int, seed: int, key: str = "shard", ids: str = "ids") -> DataFrame:
    """K windows a shard at seeded places."""
    room = F.size(ids) - block - 1
    rows = shards.where(room > 0).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    at = F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("i")), room.cast("long")).cast("int")
    return rows.select(key, "i", at.alias("start"), F.slice(ids, at + 1, block).alias("x"))


def look_back(ids: Column, n: int = 256) -> Column:
    """The different ids among the last n."""
    return F.array_distinct(F.slice(ids, F.greatest(F.size(ids) - n + 1, F.lit(1)), F.lit(n)))


def masked_targets(ids: Column, prefix: Column) -> Column:
    """Ids with those of the prompt as -100, which no loss counts."""
    return F.transform(ids, lambda x, i: F.when(i < prefix, F.lit(-100)).otherwise(x))


def response_perplexity(rows: DataFrame, key: str) -> DataFrame:
    """Exp of the mean loss over the response; rows: (key, pos, loss, prefix_len), pos of the shifted target from 0."""
    return rows.where(F.col("pos") >= F.col("prefix_len") - 1).groupBy(key).agg(F.exp(F.avg("loss")).alias("perplexity"))


def accumulation_groups(windows: DataFrame, batch: int = 4, accumulate: int = 64, shard: str = "shard", order: str = "win") -> DataFrame:
    """Micro-batch and step of each window; a shard's remainder is a step of its own."""
    nr = F.row_number().over(Window.partitionBy(shard).orderBy(order)) - 1
    return windows.withColumn("micro", F.floor(nr / batch)).withColumn("step", F.floor(F.col("micro") / accumulate))


def ends_well(ids: Column, eot: int, end_mark: int) -> Column:
    """The end id is last, the end mark before it."""
    return (F.try_element_at(ids, F.lit(-1)) == eot) & (F.try_element_at(ids, F.lit(-2)) == end_mark)


def spot_check(shards: DataFrame, docs: DataFrame, vocabulary: str, n: int, seed: int, width: int = 10) -> DataFrame:
    """Sampled shards whose first ids differ from a new encoding of their text's start.

    shards: (shard, ids); docs: (shard, text). status: ok, mismatch, short or unreadable.
    """
    from .budget import sample

    picked = sample(shards.select("shard", F.slice("ids", 1, width).alias("stored")), n, seed, "shard")
    first = F.substring(T.py_strip(F.split(F.substring("text", 1, 2000), r"<\|endoftext\|>")[0]), 1, 500)
    again = encode(docs.join(picked.select("shard"), "shard", "left_semi").select("shard", first.alias("text")), vocabulary, key="shard")
    both = picked.join(again.select("shard", F.slice("ids", 1, width).alias("new")), "shard", "left")
    status = F.when(F.col("new").isNull(), "unreadable").when(F.size("stored") < width, "short").when(F.col("stored") == F.col("new"), "ok").otherwise("mismatch")
    return both.withColumn("status", status)
