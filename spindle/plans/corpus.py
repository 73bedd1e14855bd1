"""Filters, rendering, packing and text functions over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budget, corpus
from .registry import Book
from .tables import SHARDS, order_sql, shards, table

book = Book()
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)"
STRIP = f"trim({{}}, {WS})"
SEP = "chr(10) || '<|endoftext|>' || chr(10)"


def stripped(c: str) -> str:
    return STRIP.format(c)


@book.query(f"SELECT doc_id, source FROM documents WHERE length({stripped('text')}) >= 200")
def doc_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1"""
    return corpus.keep(table(spark, sf_dir, "documents"), [("short", corpus.too_short(F.col("text")))]).select("doc_id", "source")


@book.query("SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 200 AND 50000")
def doc_length_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2"""
    return corpus.keep(table(spark, sf_dir, "documents"), [("range", corpus.outside(F.col("text")))]).select("doc_id", "n_chars")


@book.query(r"""
WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages)
SELECT page_id, title, CASE WHEN title <> '' THEN title || chr(10) || chr(10) || text ELSE text END AS text FROM p WHERE length(text) >= 500""")
def doc_stub_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F4"""
    return corpus.titled(corpus.titles_from_html(table(spark, sf_dir, "pages")))


@book.query("SELECT doc_id, CAST(quality AS DOUBLE) AS score FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality >= 0.5")
def score_filter_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5"""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return corpus.keep(rows, [("low_score", corpus.low_score(F.col("score")))])


@book.query(f"""
SELECT CASE WHEN quality < 0.5 THEN 'low_score' WHEN length({stripped('text')}) < 200 THEN 'short' WHEN NOT length(text) BETWEEN 200 AND 50000 THEN 'range' ELSE 'kept' END AS reason,
 count(*) AS count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: the score rule comes before the length rules."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("score")), "doc_id", "left")
    rules = [("low_score", corpus.low_score(F.col("score"))), ("short", corpus.too_short(F.col("text"))), ("range", corpus.outside(F.col("text")))]
    return corpus.drop_counts(rows, rules)


PAIRS = """(SELECT conv_id, turn, text AS prompt, response FROM (
 SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 WHERE role = 'user' AND next_role = 'assistant')"""


@book.query(f"SELECT conv_id, turn, length(prompt) AS prompt_chars, length(response) AS response_chars FROM {PAIRS}", longs=("prompt_chars", "response_chars"))
def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = corpus.turns_to_pairs(table(spark, sf_dir, "conversations"))
    return pairs.select("conv_id", "turn", F.length("prompt").alias("prompt_chars"), F.length("response").alias("response_chars"))


@book.query(f"""
SELECT conv_id, turn, sha256('<|im_start|>user' || chr(10) || p || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || r || '<|im_end|>') AS text_sha256
FROM (SELECT conv_id, turn, {stripped('prompt')} AS p, {stripped('response')} AS r FROM {PAIRS}) WHERE length(p) >= 100 AND length(r) >= 100""")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, F7"""
    return corpus.chat_documents(corpus.turns_to_pairs(table(spark, sf_dir, "conversations"))).select("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"))


@book.query("SELECT min(doc_id) AS doc_id, sha256(text) AS text_sha256 FROM documents GROUP BY text")
def exact_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1"""
    return corpus.first_of_each(table(spark, sf_dir, "documents"), ["text"], ["doc_id"]).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nr FROM documents)"


@book.query(f"SELECT source, nr // 20 AS file_no, count(*) AS documents, sha256(string_agg(text, {SEP} ORDER BY doc_id)) AS content_sha256 FROM {NUMBERED} GROUP BY 1, 2")
def pack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, W6"""
    files = corpus.packed_files(table(spark, sf_dir, "documents"), ["source"], "doc_id", 20)
    return files.select("source", "file_no", "documents", F.sha2("content", 256).alias("content_sha256"))


@book.query(f"SELECT source, nr // 20 AS file_no, sha256({stripped('text')}) AS text_sha256 FROM {NUMBERED} WHERE {stripped('text')} <> ''")
def eot_split_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed files give their documents back."""
    files = corpus.packed_files(table(spark, sf_dir, "documents"), ["source"], "doc_id", 20)
    return corpus.documents_of(files.select("source", "file_no", "content")).select("source", "file_no", F.sha2("text", 256).alias("text_sha256"))


@book.query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def max_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature."""
    return table(spark, sf_dir, "documents").orderBy("doc_id").limit(100).select("doc_id", "n_chars")


@book.query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed run still has to take, found by id and not by a count."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@book.query("SELECT lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang IN ('en', 'de') GROUP BY lang")
def language_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of some partitions."""
    return table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de")).groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


@book.query("""
SELECT 'documents' AS origin, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM documents UNION ALL SELECT 'benchmark', count(*), sum(length(text))::BIGINT FROM benchmark
UNION ALL SELECT 'conversations', count(*), sum(length(text))::BIGINT FROM conversations""")
def multi_source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3"""
    from ..sources.files import scan_all

    all_ = scan_all(spark, [{"name": n, "path": f"{sf_dir}/{n}.parquet"} for n in ("documents", "benchmark", "conversations")])
    return all_.groupBy("origin").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"))


@book.query(f"""
SELECT doc_id, length(text) AS chars, strlen(text) AS bytes, length({stripped('text')}) AS stripped, substr(sha256(text), 1, 16) AS sha16,
 (length(text) - length(replace(text, 'the', ''))) // 3 AS n_the, len(string_split(text, 'the')) AS parts, printf('%04d', doc_id % 10000) AS padded FROM documents""", longs=("chars", "bytes", "stripped", "parts"))
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 to T7"""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(t).alias("chars"), F.octet_length(t).alias("bytes"), F.length(T.py_strip(t)).alias("stripped"), T.sha16(t).alias("sha16"),
        T.occurrences(t, "the").alias("n_the"), F.size(T.split_literal(t, "the")).alias("parts"), F.format_string("%04d", F.pmod("doc_id", F.lit(10000))).alias("padded"),
    )


@book.query(f"""
SELECT pos, parse[-1] AS base, parse[-2] AS parent, domain, pos AS idx, 'corpus/' || domain || printf('/_merged_%05d', pos) AS merged, lang_tag, (tokens + 63) // 64 * 64 AS padded
FROM (SELECT *, string_split(source, '/') AS parse, replace('c++', '+', 'p') AS lang_tag FROM {SHARDS})""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9, F17 to F22, F24"""
    s = F.col("source")
    return shards(spark, sf_dir).select(
        "pos", T.basename(s).alias("base"), T.parent_dir(s).alias("parent"), T.domain_of_path(s).alias("domain"), T.shard_index(F.col("shard")).alias("idx"), T.merged_source(s, F.col("pos")).alias("merged"),
        T.language_tag(F.lit("c++")).alias("lang_tag"), T.padded_vocab(F.col("tokens")).alias("padded"),
    )


@book.query(f"SELECT doc_id, row_number() OVER (ORDER BY {order_sql(42, 'doc_id')}) - 1 AS place FROM documents")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each document in a seeded permutation."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.seeded_order(42, "doc_id").alias("o"), F.lit(0).alias("g"))
    return budget.running_before(rows, ["g"], ["o"], F.lit(1), F.substring("o", 1, 3), "place").select("doc_id", F.col("place").cast("long").alias("place"))


@book.query(f"SELECT doc_id FROM documents ORDER BY {order_sql(7, 'doc_id')} LIMIT 50")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the feature."""
    return budget.sample(table(spark, sf_dir, "documents"), 50, 7, "doc_id").select("doc_id")


LINES = f"""(SELECT doc_id, source, {order_sql(42, 'doc_id')} AS o, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"""


@book.query(f"""
WITH l AS (SELECT *, strlen(line) + 1 AS size FROM {LINES}), b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT source, count(*) AS lines, sum(size)::BIGINT AS bytes, count(DISTINCT doc_id) AS documents FROM b WHERE before < 1000000 // (SELECT count(DISTINCT source) FROM documents) GROUP BY source""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equal budget of bytes for each source, taken line by line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", T.seeded_order(42, "doc_id").alias("o"))
    share = docs.select("source").distinct().agg(F.floor(F.lit(1_000_000) / F.count(F.lit(1))).alias("share"))
    lines = docs.select("doc_id", "source", "o", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).crossJoin(F.broadcast(share)).withColumn("bytes", (F.octet_length("line") + 1).cast("long"))
    taken = budget.byte_budget_lines(lines, ["source"], "o", "line_no", F.col("bytes"), F.col("share"))
    return taken.groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("bytes"), F.count_distinct("doc_id").alias("documents"))


PROBLEMS = """(SELECT o_orderkey AS k, (o_orderkey % 4)::INT AS o, o_custkey - 400 AS a, o_orderkey % 37 + 1 AS b FROM orders)"""


@book.query(f"""
SELECT k, 'Compute ' || a || ' ' || ['+', '-', '×', '/'][o + 1] || ' ' || b AS problem,
 CASE o WHEN 0 THEN (a + b)::VARCHAR WHEN 1 THEN (a - b)::VARCHAR WHEN 2 THEN (a * b)::VARCHAR ELSE
  CASE WHEN a - floor(a / b)::BIGINT * b = 0 THEN floor(a / b)::BIGINT::VARCHAR ELSE floor(a / b)::BIGINT || ' remainder ' || (a - floor(a / b)::BIGINT * b) END END AS value,
 a || '/' || b AS answer, k % 3 <> 0 AS passes FROM {PROBLEMS}""")
def worked_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems and answers written as documents and read back."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.pmod("o_orderkey", F.lit(4)).alias("o"), (F.col("o_custkey") - 400).alias("a"), (F.pmod("o_orderkey", F.lit(37)) + 1).alias("b"))
    sign = F.element_at(F.array(*map(F.lit, "+-×/")), (F.col("o") + 1).cast("int"))
    doubled = F.when(F.pmod("k", F.lit(3)) == 0, "Step 1: Step 2: x").otherwise("Step 1: x")
    text = F.concat(F.lit("Problem: Compute "), F.col("a").cast("string"), F.lit(" "), sign, F.lit(" "), F.col("b").cast("string"), F.lit("\n"), doubled, F.lit("\nAnswer: \\boxed{\\frac{"), F.col("a").cast("string"), F.lit("}{"), F.col("b").cast("string"), F.lit("}}\n"))
    docs = o.select("k", text.alias("text"))
    problem = T.problem_line(F.col("text"))
    return docs.select("k", problem.alias("problem"), T.evaluated(T.bare_problem(problem)).alias("value"), T.declared_answer(F.col("text")).alias("answer"), T.text_gate(F.col("text")).alias("passes"))


@book.query("""
SELECT conv_id, turn, CASE WHEN c BETWEEN 1 AND 5 THEN c END AS clarity, CASE WHEN f BETWEEN 1 AND 5 THEN f END AS fluency
FROM (SELECT conv_id, turn, (length(text) % 8)::INT AS c, (turn % 7)::INT AS f FROM conversations)""")
def judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's fenced JSON; scores outside 1 to 5 don't count."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.format_string('```json\n{"clarity": %d, "fluency": %d}\n```', F.pmod(F.length("text"), F.lit(8)), F.pmod("turn", F.lit(7))).alias("answer"))
    return rows.withColumn("s", T.judge_scores(F.col("answer"), "clarity", "fluency")).select("conv_id", "turn", "s.clarity", "s.fluency")


@book.query(f"SELECT conv_id, turn FROM {PAIRS} WHERE {stripped('prompt')} <> '' AND {stripped('response')} <> ''")
def adapter_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, F9"""
    return corpus.ADAPTERS["pairs"](corpus.turns_to_pairs(table(spark, sf_dir, "conversations"))).select("conv_id", "turn")


@book.query("SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'source': source})::VARCHAR AS line FROM documents")
def json_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T23, K7"""
    return table(spark, sf_dir, "documents").select("doc_id", T.json_line("doc_id", "lang", "source").alias("line"))


@book.query("""
WITH l AS (SELECT conv_id, coalesce(list(length(text) ORDER BY turn) FILTER (WHERE role = 'user'), []) AS u, coalesce(list(length(text) ORDER BY turn) FILTER (WHERE role = 'assistant'), []) AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, unnest(u[1:least(len(u), len(a))]) AS prompt_chars, unnest(a[1:least(len(u), len(a))]) AS output_chars FROM l""", longs=("prompt_chars", "output_chars"))
def paired_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's prompts and outputs by position."""
    sizes = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", F.length("text").alias("n"))))), lambda x: x["n"])
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(sizes("user").alias("u"), sizes("assistant").alias("o"))
    return lists.select("conv_id", F.explode(T.paired(F.col("u"), F.col("o"))).alias("p")).select("conv_id", F.col("p.a").alias("prompt_chars"), F.col("p.b").alias("output_chars"))
