"""Filters, projections and packing of raw documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

Rules = list[tuple[str, Column]]


def drop_reason(rules: Rules) -> Column:
    """F8: the name of the first rule that a row breaks, null for a row that breaks none."""
    found = None
    for name, broken in rules:
        broken = F.coalesce(broken, F.lit(False))
        found = F.when(broken, name) if found is None else found.when(broken, name)
    return found if found is not None else F.lit(None).cast("string")


def keep(df: DataFrame, rules: Rules) -> DataFrame:
    """Rows that break no rule; the filter reaches the scan where its columns allow."""
    for _, broken in rules:
        df = df.where(~F.coalesce(broken, F.lit(False)))
    return df


def drop_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """F8: how many rows each rule drops, and how many stay."""
    return df.groupBy(F.coalesce(drop_reason(rules), F.lit("kept")).alias("reason")).count()


def too_short(text: Column, least: int = 200) -> Column:
    """under so many characters once stripped."""
    return F.length(T.py_strip(F.coalesce(text, F.lit("")))) < least


def outside(text: Column, least: int = 200, most: int = 50_000) -> Column:
    """length outside a range, bounds allowed."""
    return ~F.length(F.coalesce(text, F.lit(""))).between(least, most)


def low_score(score: Column, least: float = 0.5) -> Column:
    """a score under the bound; no score is no reason."""
    return score.isNotNull() & (score < least)


def titled(df: DataFrame, title: str = "title", text: str = "text", least: int = 500) -> DataFrame:
    """stubs go by the bare text's length; then the title goes on top."""
    body, head = T.py_strip(F.coalesce(F.col(text), F.lit(""))), F.coalesce(F.col(title), F.lit(""))
    return df.where(F.length(body) >= least).withColumn(text, F.when(head != "", F.concat(head, F.lit("\n\n"), body)).otherwise(body))


def chat_documents(df: DataFrame, least: int = 100, score: str | None = None) -> DataFrame:
    """Pairs with both sides long enough, rendered; columns prompt and response."""
    prompt, response = (T.py_strip(F.coalesce(F.col(c), F.lit(""))) for c in ("prompt", "response"))
    rules = ([("low_score", low_score(F.col(score)))] if score else []) + [("short", (F.length(prompt) < least) | (F.length(response) < least))]
    return keep(df, rules).withColumn("text", T.chat(prompt, response))


def adapted(df: DataFrame) -> DataFrame:
    """instruction, input and output stripped; rows without instruction or output go."""
    cols = {c: T.py_strip(F.coalesce(F.col(c), F.lit(""))) for c in ("instruction", "input", "output")}
    return df.withColumns(cols).where((F.col("instruction") != "") & (F.col("output") != ""))


def first_of_each(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """Of rows with equal keys the first in the order.

    The least order is found by a partial aggregate before the shuffle, so a key with many rows
    sends one a task; the rows themselves are met again by a join.
    """
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("o")).select("o.*")
    return df.join(first, [o for o in order if isinstance(o, str)], "left_semi")


def numbered(df: DataFrame, keys: list[str], position: str, block: int = 4096, name: str = "nr") -> DataFrame:
    """Rows of a group numbered from 0 by an integer position.

    Positions are cut into as many equal blocks as the group has times ``block`` rows, however
    sparse they are; a block's count gives the next one's first number. A group of any size so
    spreads over many tasks, and its blocks are few.
    """
    p = F.col(position)
    spans = df.groupBy(*keys).agg(F.min(p).alias("__least"), (F.max(p) - F.min(p) + 1).alias("__span"), F.ceil(F.count(F.lit(1)) / block).alias("__blocks"))
    cut = df.join(spans, keys).withColumn("__block", F.floor((p - F.col("__least")) / F.col("__span") * F.col("__blocks"))).drop("__least", "__span", "__blocks")
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    first = cut.groupBy(*keys, "__block").count().select(*keys, "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(position))
    return cut.withColumn("__nr", within).join(first, [*keys, "__block"]).withColumn(name, F.col("__first") + F.col("__nr") - 1).drop("__block", "__nr", "__first")


def packed_files(df: DataFrame, keys: list[str], position: str, per_file: int, text: str = "text") -> DataFrame:
    """Every so many documents of a group joined into a file's content, in order."""
    files = numbered(df, keys, position).withColumn("file_no", F.floor(F.col("nr") / per_file))
    return files.groupBy(*keys, "file_no").agg(
        F.count(F.lit(1)).alias("documents"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]), T.SEPARATOR).alias("content"),
    )


def documents_of(df: DataFrame, content: str = "content") -> DataFrame:
    """The documents of packed files: stripped, not empty, with their place."""
    parts = df.select(*[c for c in df.columns if c != content], F.posexplode(T.split_literal(F.col(content), T.EOT)).alias("part", "t"))
    return parts.withColumn("text", T.py_strip(F.col("t"))).where("text <> ''").drop("t")


def titles_from_html(pages: DataFrame) -> DataFrame:
    """A title and a text for pages: what the upstream columns of encyclopaedia rows hold."""
    body = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?s)<[^>]*>", " "), r"[ \t\n\r]+", " ")
    return pages.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.trim(body).alias("text"))


def turns_to_pairs(conversations: DataFrame) -> DataFrame:
    """A user's turn and the assistant's next one, as prompt and response."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    following = conversations.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("response"))
    return following.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prompt"), "response")


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def adapter(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Registers a transform from a dataset's own columns to (instruction, input, output)."""

    def put(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        ADAPTERS[name] = f
        return f

    return put


@adapter("instructions")
def _instructions(df: DataFrame) -> DataFrame:
    return adapted(df)


@adapter("pairs")
def _pairs(df: DataFrame) -> DataFrame:
    return adapted(df.withColumns({"instruction": F.col("prompt"), "input": F.lit(""), "output": F.col("response")}))
