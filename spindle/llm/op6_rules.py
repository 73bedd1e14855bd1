"""Quality rules over words and lines, and line frequency across documents.

Two parts, both Spark SQL only. The first counts within a text: words, their characters,
symbols, repeated lines, and words in three-word windows that occur again. The second counts
across documents: normalised lines are hashed, and for each host (``source``) the distinct
documents that hold a line are counted. A line that ``LINE_DOCS`` or more of them hold, however
many documents the host has, is removed from all of them. A document left with under ``LEFT`` of
its characters is depleted and rejected. Documents are distinct by their text: an exact copy is
no further document, since otherwise ten copies of any document would reject it whole, the last
copy too, where the de-duplication operators keep one.

Texts are read once: counts and line hashes go to a table in the shared folder, and all that
follows reads that. Lines shuffle as hashes; a frequent line is summed before the shuffle and its
join is split by adaptive execution; texts never move.

Edge cases: a null text has no words; empty ones fail the word count; a null ``source`` is a
host of its own, equal to the empty one; a null ``doc_id`` is kept; repeated rows get a row each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, let, materialised, text_of

WORD, SYMBOLS, BLANK_CLASS = r"[^\x20\x09-\x0D]+", "#*$%&|<>", r"[\x20\x09-\x0D]+"
MIN_WORDS, MAX_REPEATED = 50, 50
#: A line is frequent in a host from so many of its documents on.
LINE_DOCS = 10
#: Least share of characters that a document must keep: published filters for web text reject
#: documents of which over 30 % is repeated lines.
LEFT = 0.7


def repeated_words(words: Column) -> Column:
    """How many words stand in a three-word window that the text holds twice or more.

    Windows are compared by 64-bit hashes, sorted with their places.
    """

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

        def again(z: Column) -> Column:
            same = lambda e, i: F.coalesce(F.get(z, i)["h"] == e["h"], F.lit(False))
            twice = F.filter(z, lambda e, i: same(e, i - 1) | same(e, i + 1))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

        return F.when(F.size(w) < 4, 0).otherwise(let(F.sort_array(windows), again))

    return let(words, of)


def base_counts(text: Column) -> dict[str, Column]:
    """The counts of a text that need no other document."""
    words = F.filter(F.split(text, BLANK_CLASS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    both = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r")))
    return {
        "both": both,
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def normalised_lines(text: Column) -> Column:
    """Lines lowered and stripped, with digits made equal."""
    return F.transform(F.split(F.translate(F.lower(text), "123456789", "000000000"), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def line_hashes(text: Column) -> Column:
    """A struct for each line that isn't blank: two hashes of it, and its size with the line's end."""
    own = F.filter(normalised_lines(text), lambda x: x != "")
    return F.transform(own, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.hash(x).alias("h2"), (F.length(x) + 1).alias("size")))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The counts of every row, lines and characters removed, base_failed, and kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit(""))).alias("host"), text_of(text_col).alias("text"))
    counted = rows.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("t1"),
        F.hash("text").alias("t2"),
        F.length("text").alias("n_chars"),
        *[c.alias(n) for n, c in base_counts(F.col("text")).items()],
        line_hashes(F.col("text")).alias("lines"),
    )
    counted = materialised(counted, "line-hashes", compact=True)

    document, line = ["host", "t1", "t2"], ["host", "h1", "h2"]
    distinct = counted.select(*document, "lines").where(F.size("lines") > 0).dropDuplicates(document)
    held = distinct.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))).alias("line"))
    frequent = held.groupBy("host", "line.h1", "line.h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LINE_DOCS).select(*line)
    lines = distinct.select(*document, F.explode("lines").alias("line")).select(*document, "line.*")
    removed = lines.join(frequent, line).groupBy(*document).agg(F.sum("size").cast("long").alias("removed"), F.count(F.lit(1)).alias("hits"))

    out = counted.join(removed, document, "left").select(
        "doc_id",
        F.col("both.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("both.r").alias("n_repeat_words"),
        F.coalesce("hits", F.lit(0)).alias("lines_removed"),
        F.coalesce("removed", F.lit(0)).alias("chars_removed"),
        "n_chars",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    depleted = F.col("n_chars") - F.col("chars_removed") < LEFT * F.col("n_chars")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("n_chars")
