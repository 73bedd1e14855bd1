"""From raw documents to packed sequences, in five stages.

Toxic documents go; lines that many documents share go; of near duplicates one stays; personal
numbers become pseudonyms; what is left is packed. Each stage works on all that its predecessor
kept and is written as Parquet before the next one reads it.

Edge cases: a null or empty text is not toxic, keeps its one empty line, is alike only to other
texts without words (one of them stays), stays null or empty, and packs as its end token; a null
``doc_id`` is kept and comes last where one of several stays; repeated rows are near duplicates;
an empty table gives an empty result; further columns pass all stages but the last, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import op1_packing, op2_pseudonyms, op3_lines, op8_toxicity, op10_simhash
from spindle.llm.shared import materialised, read_table


def _with_text(found: DataFrame, docs: DataFrame, text: str, changed: str) -> DataFrame:
    """The columns of docs, with text and n_chars renewed in rows where a count says so."""
    new = F.col(changed) > 0
    row = F.col("row")
    renewed = {"text": F.when(new, F.col(text)).otherwise(row["text"]), "n_chars": F.when(new, F.length(text).cast("long")).otherwise(row["n_chars"])}
    return found.select(*[renewed[c].alias(c) if c in renewed else row[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = op8_toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return op8_toxicity.score(docs, chain).where("predicted = 0").select("row.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(op3_lines.deduplicated(docs), docs, "row.text", "n_dropped")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose five-word shingles are alike to 0.8 or more, directly or by others, one stays."""
    return op10_simhash.one_of_each(docs, width=op10_simhash.WIDTH, similarity=op10_simhash.SIMILARITY)


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(op2_pseudonyms.replace_personal(docs), docs, "text", "n_replaced")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("near_dedup", drop_near_duplicates),
    ("pseudonyms", replace_personal),
    ("packing", pack),
]

#: The toxicity model, the pseudonyms and the packing have no SQL form; the tests hold run()
#: against a plain version in memory.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
