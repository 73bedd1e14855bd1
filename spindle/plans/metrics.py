"""Statistics of lengths, tensors, losses, texts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics
from .registry import Book
from .tables import table

book = Book()


def rank_sql(values: str, q: float) -> str:
    return f"list_sort({values})[least(len({values}) - 1, trunc({q}::DOUBLE * len({values}))::BIGINT) + 1]"


@book.query(f"SELECT lang, {rank_sql('list(n_chars)', 0.5)} AS p50, {rank_sql('list(n_chars)', 0.95)} AS p95, {rank_sql('list(n_chars)', 0.99)} AS p99, max(n_chars) AS max, round(avg(n_chars), 1) AS mean FROM documents GROUP BY lang")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11"""
    return metrics.length_stats(table(spark, sf_dir, "documents"), ["lang"], "n_chars")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tensor a label: a vector is a position, its places are channels."""
    e = table(spark, sf_dir, "embeddings")
    name = F.when(F.col("label").isNotNull(), F.format_string("block_%02d.output", F.pmod("label", F.lit(4))))
    return metrics.tensor_long(e, name, "embedding", F.col("vec_id"))


LONG = "(SELECT printf('block_%02d.output', label % 4) AS name, vec_id AS t, generate_subscripts(embedding, 1) - 1 AS h, unnest(embedding)::DOUBLE AS x FROM embeddings)"
STATS = f"""(SELECT name, count(*) AS numel, sqrt(avg(x * x)) AS rms, max(abs(x)) AS max_abs, avg(abs(x)) AS mean_abs,
 {rank_sql('list(abs(x))', 0.99)} AS p99_abs, {rank_sql('list(abs(x))', 0.999)} AS p999_abs FROM {LONG} GROUP BY name)"""
ROUNDED = f"""(SELECT name, numel, round(rms, 6) AS rms, round(max_abs, 6) AS max_abs, round(mean_abs, 6) AS mean_abs, round(p99_abs, 6) AS p99_abs, round(p999_abs, 6) AS p999_abs,
 round(max_abs / rms, 4) AS max_over_rms, round(p99_abs / rms, 4) AS p99_over_rms, round(p999_abs / rms, 4) AS p999_over_rms FROM {STATS})"""


@book.query(f"SELECT * FROM {ROUNDED}")
def tensor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17"""
    return metrics.tensor_stats(_long(spark, sf_dir))


@book.query(f"SELECT name, max_over_rms, CASE WHEN max_over_rms > 20 THEN 'severe' WHEN max_over_rms > 10 THEN 'mild' ELSE 'ok' END AS severity FROM {ROUNDED} ORDER BY max_over_rms DESC, name LIMIT 3")
def outlier_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k are the feature."""
    return metrics.outliers(metrics.tensor_stats(_long(spark, sf_dir)), 3).select("name", "max_over_rms", T.severity(F.col("max_over_rms")).alias("severity"))


@book.query(f"""
WITH p AS (SELECT name, t % 2 AS pass, x FROM {LONG}), s AS (SELECT name, pass, sqrt(avg(x * x)) AS rms, max(abs(x)) AS m FROM p GROUP BY 1, 2)
SELECT name, round(avg(round(rms, 6)), 5) AS rms, max(round(m, 6)) AS max_abs FROM s GROUP BY name""")
def combined_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over different positions."""
    long = _long(spark, sf_dir)
    both = None
    for k in (0, 1):
        one = metrics.tensor_stats(long.where(F.pmod("t", F.lit(2)) == k))
        both = one if both is None else both.unionByName(one)
    return metrics.combined_passes(both).select("name", F.round("rms", 5).alias("rms"), "max_abs")


@book.query(f"SELECT l.name, l.max_over_rms, coalesce(r.max_over_rms, 'nan'::DOUBLE) AS other FROM {ROUNDED} l LEFT JOIN (SELECT * FROM {ROUNDED} WHERE name <> 'block_00.output') r USING (name)")
def compare_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13"""
    s = metrics.tensor_stats(_long(spark, sf_dir))
    return metrics.compared(s, s.where("name <> 'block_00.output'"), "max_over_rms")


@book.query(f"SELECT regexp_extract(name, 'block_(\\d+)', 1)::INT AS block, max(max_over_rms) AS max_over_rms FROM {ROUNDED} GROUP BY 1")
def block_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21"""
    return metrics.block_trend(metrics.tensor_stats(_long(spark, sf_dir)))


POSITIONS = f"(SELECT t, max(abs(x)) / ((SELECT sqrt(avg(x * x)) FROM {LONG}) + 1e-8::DOUBLE) AS ratio_global, max(abs(x)) / (sqrt(avg(x * x)) + 1e-8::DOUBLE) AS ratio_local FROM {LONG} GROUP BY t)"


@book.query(f"SELECT t, round(ratio_global, 5) AS ratio_global, round(ratio_local, 5) AS ratio_local FROM {POSITIONS}")
def tensor_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19"""
    return metrics.by_position(_long(spark, sf_dir)).select("t", F.round("ratio_global", 5).alias("ratio_global"), F.round("ratio_local", 5).alias("ratio_local"))


@book.query(f"SELECT h, round(avg(x * x), 6) AS energy, round(avg(x * x) / (SELECT sum(e) FROM (SELECT avg(x * x) AS e FROM {LONG} GROUP BY h)), 6) AS share FROM {LONG} GROUP BY h", longs=("h",))
def channel_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19"""
    return metrics.channel_energy(_long(spark, sf_dir)).select("h", F.round("energy", 6).alias("energy"), F.round("share", 6).alias("share"))


@book.query(f"SELECT t, h, round(abs(x), 6) AS value FROM {LONG} ORDER BY abs(x) DESC, t, h LIMIT 1", longs=("h",))
def greatest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19"""
    return metrics.greatest_place(_long(spark, sf_dir)).select("t", "h", F.round("value", 6).alias("value"))


BANDS = "avg(ratio) FILTER (WHERE t < 8) AS early, avg(ratio) FILTER (WHERE t >= 8 AND t < 128) AS mid, avg(ratio) FILTER (WHERE t >= 128) AS late"


@book.query(f"SELECT round(early, 5) AS early, round(mid, 5) AS mid, round(late, 5) AS late FROM (SELECT {BANDS.replace('ratio', 'ratio_global')} FROM {POSITIONS})")
def tensor_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20"""
    b = metrics.bands(metrics.by_position(_long(spark, sf_dir)))
    return b.select(*[F.round(c, 5).alias(c) for c in ("early", "mid", "late")])


BLOCKS = f"""(SELECT * FROM
 (SELECT name, arg_max(t, (abs(x), -t, -h)) AS max_position, arg_max(h, (abs(x), -t, -h)) AS max_channel, max(abs(x)) AS max_value FROM {LONG} GROUP BY name)
 JOIN (SELECT name, {BANDS} FROM (SELECT name, t, max(abs(x)) / (any_value(g) + 1e-8::DOUBLE) AS ratio FROM {LONG} JOIN (SELECT name, sqrt(avg(x * x)) AS g FROM {LONG} GROUP BY name) USING (name) GROUP BY name, t) GROUP BY name) USING (name)
 JOIN (SELECT name, arg_max(h, (e, -h)) AS channel, max(e) / sum(e) AS channel_share FROM (SELECT name, h, avg(x * x) AS e FROM {LONG} GROUP BY name, h) GROUP BY name) USING (name))"""


@book.query(f"SELECT name, max_position, max_channel, round(max_value, 6) AS max_value, round(early, 5) AS early, round(mid, 5) AS mid, round(late, 5) AS late, channel, round(channel_share, 6) AS channel_share FROM {BLOCKS}", longs=("max_channel", "channel"))
def block_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a block."""
    b = metrics.block_places(_long(spark, sf_dir))
    return b.select("name", "max_position", "max_channel", F.round("max_value", 6).alias("max_value"), *[F.round(c, 5).alias(c) for c in ("early", "mid", "late")], "channel", F.round("channel_share", 6).alias("channel_share"))


@book.query(f"""
WITH b AS {BLOCKS}, s AS (SELECT count(*) AS blocks, avg((max_position < 8)::INT) AS early_fraction, avg(early) AS early, avg(late) AS late FROM b),
 c AS (SELECT channel AS top_channel, count(*) AS top_blocks FROM b GROUP BY channel ORDER BY count(*) DESC, min(name) LIMIT 1)
SELECT blocks, early_fraction, round(early, 5) AS early, round(late, 5) AS late, top_channel, top_blocks, early_fraction >= 0.5 AND early > 1.3::DOUBLE * late AS early_leads, top_blocks >= 0.5 * blocks AS fixed_channel FROM s, c""", longs=("top_channel",))
def outlier_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict over all blocks."""
    v = metrics.outlier_verdict(metrics.block_places(_long(spark, sf_dir)))
    return v.withColumns({c: F.round(c, 5) for c in ("early", "late")})


@book.query(f"SELECT name, round(avg(abs(x)), 6) AS mean_abs, round(stddev_pop(abs(x)), 6) AS std_abs, round(stddev_samp(x), 6) AS std FROM {LONG} GROUP BY name")
def weight_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25"""
    return metrics.spread(_long(spark, sf_dir), "name").select("name", *[F.round(c, 6).alias(c) for c in ("mean_abs", "std_abs", "std")])


@book.query("""
WITH b AS (SELECT least(floor((value - 0.0::DOUBLE) / ((100.0::DOUBLE - 0) / 50)), 49)::INT AS bin FROM events WHERE value BETWEEN 0 AND 100)
SELECT bin, count(*) AS n, round(count(*) / ((SELECT count(*) FROM b) * 2.0::DOUBLE), 8) AS density FROM b GROUP BY bin""")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31"""
    return metrics.histogram(table(spark, sf_dir, "events"), F.col("value"), 0.0, 100.0, 50).select("bin", "n", F.round("density", 8).alias("density"))


@book.query("SELECT count(*) FILTER (WHERE event_id % 10 < 2) AS non_finite FROM events")
def non_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T27"""
    k = F.pmod("event_id", F.lit(10))
    rows = table(spark, sf_dir, "events").select(F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("-inf"))).otherwise(F.col("value")).alias("v"))
    return metrics.non_finite(rows, "v")


@book.query("WITH p AS (SELECT event_type, avg(value) AS loss FROM events GROUP BY event_type) SELECT event_type, round(loss, 6) AS loss, round((SELECT avg(loss) FROM p), 6) AS overall FROM p")
def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14"""
    return metrics.mean_of_means(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", F.round("loss", 6).alias("loss"), F.round("overall", 6).alias("overall"))


@book.query("SELECT event_type, round(exp(avg(value / 100)), 6) AS perplexity, min(value / 100) AS min_loss, max(value / 100) AS max_loss FROM events GROUP BY event_type")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15"""
    rows = table(spark, sf_dir, "events").withColumn("loss", F.col("value") / 100)
    return metrics.perplexity(rows, ["event_type"], "loss").withColumn("perplexity", F.round("perplexity", 6))


@book.query("SELECT event_type, round(exp(avg(value / 100)), 6) AS perplexity FROM events WHERE event_id % 16 >= 5 - 1 GROUP BY event_type")
def response_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of the prompt don't count."""
    from ..operators.tokens import response_perplexity as operator

    rows = table(spark, sf_dir, "events").select("event_type", F.pmod("event_id", F.lit(16)).alias("pos"), (F.col("value") / 100).alias("loss"), F.lit(5).alias("prefix_len"))
    return operator(rows, "event_type").withColumn("perplexity", F.round("perplexity", 6))


@book.query("SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS median FROM events GROUP BY event_type")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16"""
    return metrics.medians(table(spark, sf_dir, "events"), "event_type", "value")


@book.query("""WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events)
SELECT event_type, i // 64 AS "window", round(avg(value), 10) AS mean, count(*) AS present FROM n GROUP BY 1, 2""")
def grad_window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28"""
    from ..operators.corpus import numbered

    rows = numbered(table(spark, sf_dir, "events"), ["event_type"], "event_id")
    return metrics.window_means(rows, ["event_type"], "nr", "value").select("event_type", "window", F.round("mean", 10).alias("mean"), "present")


@book.query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 32")
def capped_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap is the feature."""
    return metrics.capped_batches(table(spark, sf_dir, "events"), "event_type", ["event_id"]).select("event_type", "event_id")


WORDS = r"(SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents)"


@book.query(f"""
SELECT doc_id, round(CASE WHEN len(w) < 3 THEN 0 ELSE (len(w) - 2 - len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) / (len(w) - 2) END, 6) AS repetition FROM {WORDS}""")
def ngram_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22"""
    return metrics.with_repetition(table(spark, sf_dir, "documents"), 3).select("doc_id", F.round("repetition", 6).alias("repetition"))


@book.query(f"SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w)) / len(w) END, 6) AS diversity FROM {WORDS}")
def token_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23"""
    return table(spark, sf_dir, "documents").select("doc_id", F.round(metrics.diversity(T.words(F.col("text"))), 6).alias("diversity"))


@book.query(f"SELECT count(DISTINCT w) AS used, count(*) AS total, round(count(DISTINCT w) / count(*), 6) AS diversity FROM (SELECT unnest(w) AS w FROM {WORDS})")
def vocabulary_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").count()
    return words.agg(F.count(F.lit(1)).alias("used"), F.sum("count").alias("total")).withColumn("diversity", F.round(F.col("used") / F.col("total"), 6))


@book.query("""
SELECT step, round(CASE WHEN step < 200 THEN 3e-4::DOUBLE * step / 200 ELSE 3e-5::DOUBLE + 0.5 * (1 + cos(pi() * least(1.0::DOUBLE, (step - 200) / 1800.0::DOUBLE))) * (3e-4::DOUBLE - 3e-5::DOUBLE) END, 12) AS lr
FROM (SELECT event_id AS step FROM events)""")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T14"""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"))
    return rows.select("step", F.round(T.learning_rate(F.col("step"), F.lit(2000), 3e-4, 3e-5, 200), 12).alias("lr"))


@book.query("SELECT role, round(avg(v) FILTER (WHERE v > 0), 6) AS mean, min(v) FILTER (WHERE v > 0) AS min, max(v) FILTER (WHERE v > 0) AS max FROM (SELECT role, (length(text) % 6)::INT AS v FROM conversations) GROUP BY role")
def judged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24"""
    rows = table(spark, sf_dir, "conversations").select("role", F.pmod(F.length("text"), F.lit(6)).alias("v"))
    return metrics.judged(rows, ["role"], "v").withColumn("mean", F.round("mean", 6))


@book.query("""
WITH m AS (SELECT h, avg(x) AS m FROM (SELECT generate_subscripts(embedding, 1) AS h, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY h),
 c AS (SELECT vec_id, label, list(x - m ORDER BY h) AS v FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) AS h, unnest(embedding)::DOUBLE AS x FROM embeddings) JOIN m USING (h) GROUP BY 1, 2),
 p AS (SELECT a.label = b.label AS same, list_cosine_similarity(a.v, b.v) AS c FROM c a JOIN c b ON a.vec_id <> b.vec_id)
SELECT round(w, 5) AS within, round(o, 5) AS across, round(w - o, 5) AS gap, CASE WHEN w - o > 0.15 THEN 'good' WHEN w - o > 0.05 THEN 'emerging' WHEN w - o > 0 THEN 'weak' ELSE 'none' END AS label
FROM (SELECT avg(c) FILTER (WHERE same) AS w, avg(c) FILTER (WHERE NOT same) AS o FROM p)""")
def embedding_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs' cosines by sums of unit vectors."""
    g = metrics.group_gap(metrics.centred(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding"), "label", "embedding")
    return g.select(*[F.round(c, 5).alias(c) for c in ("within", "across", "gap")], "label")


@book.query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS cosine FROM embeddings")
def cosine_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T16"""
    e = table(spark, sf_dir, "embeddings")
    first = e.agg(F.min_by("embedding", "vec_id").alias("q"))
    return e.crossJoin(F.broadcast(first)).select("vec_id", F.round(metrics.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@book.query("""
SELECT vec_id, list_position(v, list_max(v)) - 1 AS best, round(list_max(v), 6) AS value, round(exp(list_max(v)) / list_sum(list_transform(v, lambda x: exp(x))), 6) AS probability FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""")
def greedy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O12, T17"""
    v = F.transform("embedding", lambda x: x.cast("double"))
    top = metrics.top_k(F.col("v"), 1)[0]
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", top["id"].alias("best"), F.round(top["value"], 6).alias("value"), F.round(F.array_max(metrics.softmax(F.col("v"))), 6).alias("probability"))
