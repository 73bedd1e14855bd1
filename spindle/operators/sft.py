"""Instruction-tuning rows: render, encode, cut, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .corpus import adapted, first_of_each


def prepared(rows: DataFrame, least: int = 10, position: str = "pos") -> DataFrame:
    """Stripped rows, long enough in all, the first of equal ones."""
    rows = adapted(rows).where(F.length("instruction") + F.length("input") + F.length("output") >= least)
    return first_of_each(rows, ["instruction", "input", "output"], [position])


def rendered(rows: DataFrame) -> DataFrame:
    """X9"""
    return rows.withColumns({"prompt": T.sft_prompt(F.col("instruction"), F.col("input")), "response": T.sft_response(F.col("output"))})


def joined(prompt_ids: Column, response_ids: Column) -> Column:
    """The two encodings in a row; they are never encoded as one text."""
    return F.concat(prompt_ids, response_ids)


def verdict(prompt_len: Column, response_len: Column, last_kept_is_end: Column, block: int) -> Column:
    """X11: why a row is dropped, null if it stays. Rules apply in this order."""
    return (
        F.when(response_len < 3, "short_response").when(prompt_len >= block, "prompt_too_long").when((prompt_len + response_len > block + 1) & ~F.coalesce(last_kept_is_end, F.lit(False)), "truncation_lost_eos")
    )


def cut_rows(rows: DataFrame, block: int, eot: int) -> DataFrame:
    """X11: (.., input_ids, prefix_len, reason); rows: prompt_ids, response_ids."""
    full = joined(F.col("prompt_ids"), F.col("response_ids"))
    kept = F.slice(full, 1, block + 1)
    p, r = F.size("prompt_ids"), F.size("response_ids")
    return rows.withColumns({"input_ids": kept, "prefix_len": p, "response_len": r, "reason": verdict(p, r, F.try_element_at(kept, F.lit(-1)) == eot, block)})


def split(rows: DataFrame, fraction: float, seed: int, key: str) -> DataFrame:
    """Adds ``part``: the first rows in seeded order are val, at least one.

    The bound is found by ranking order keys only, in pieces of their first digits.
    """
    from .budget import running_before

    ordered = rows.withColumn("__o", T.seeded_order(seed, key)).withColumn("__all", F.lit(0))
    n = ordered.groupBy("__all").agg(F.greatest(F.lit(1), (F.count(F.lit(1)) * F.lit(fraction)).cast("long")).alias("__val"))
    ranked = running_before(ordered, ["__all"], ["__o"], F.lit(1), F.substring("__o", 1, 3), "__r")
    return ranked.join(F.broadcast(n), "__all").withColumn("part", F.when(F.col("__r") < F.col("__val"), "val").otherwise("train")).drop("__o", "__all", "__r", "__val")
