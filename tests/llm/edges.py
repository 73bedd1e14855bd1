"""Documents that every operator of the subpackage must bear."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "Lorem ipsum dolor sit amet. " * 20000


def documents(spark, rows=None, extra=False):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    same = "The same line here.\nAnd another one.\n"
    rows = rows or [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, LONG, "en", "a", len(LONG)),
        (4, same, "en", "a", len(same)),
        (4, same, "en", "a", len(same)),
        (5, same, "en", "b", len(same)),
        (None, "no id but a text with words", "en", "b", 27),
        (None, None, None, None, None),
        (6, " \t\n\x0b\x0c\r ", "en", "c", 7),
        (7, "ÉÀ ÑÖ 　 Straße 𝒳𝒴 ?", "de", "c", 18),
        (8, "one", "en", "c", 3),
        (9, "a b c", "en", "c", 5),
        (-1, "<|endoftext|> a b c d e", "en", "c", 23),
    ]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names that operators might use themselves
        for name in ("row", "k1", "k2", "fp", "key", "h1", "batch", "rank", "salt", "length", "count", "piece", "words", "n_words", "t", "nr"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
