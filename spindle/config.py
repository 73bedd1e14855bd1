"""The keys of a tokenizer run, read from JSON; values travel into plans as literals."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Thresholds:
    chars_per_token_min: float = 3.0
    chars_per_token_max: float = 6.0
    bytes_per_token_min: float = 2.5
    max_single_token_freq: float = 0.10


@dataclass(frozen=True)
class Evaluation:
    held_out_fraction: float = 0.05
    max_eval_bytes: int = 52_428_800
    seed: int = 43
    thresholds: Thresholds = field(default_factory=Thresholds)


@dataclass(frozen=True)
class Merge:
    enabled: bool = True
    target_bytes: int = 104_857_600


@dataclass(frozen=True)
class Config:
    vocab_size: int = 64_000
    min_frequency: int = 2
    bpe_dropout: float | None = None
    train_subset_bytes: int = 4_294_967_296
    encode_batch_size: int = 500
    read_chunk_characters: int = 8_388_608
    shard_dtype: str = "uint16"
    num_special_tokens: int = 256
    eot_token: str = "<|endoftext|>"
    pad_token: str = "<|pad|>"
    eval: Evaluation = field(default_factory=Evaluation)
    merge: Merge = field(default_factory=Merge)


def _build(kind: type, given: dict):
    nested = {"eval": Evaluation, "merge": Merge, "thresholds": Thresholds}
    known = {f.name for f in fields(kind)}
    return kind(**{k: _build(nested[k], v) if k in nested else v for k, v in given.items() if k in known})


def read_config(spark: SparkSession, path: str) -> Config:
    """A configuration from any file system Spark reads; keys it doesn't know are passed over."""
    return _build(Config, json.loads(spark.read.text(path, wholetext=True).first().value))
