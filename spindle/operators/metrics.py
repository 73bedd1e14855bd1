"""Statistics of lengths, tensors, losses and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .budget import at_rank, joined


def length_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """p50, p95, p99, max and mean to one place."""
    ranks = at_rank(df, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    rest = df.groupBy(*keys).agg(F.max(value).alias("max"), F.round(F.avg(value), 1).alias("mean"))
    return joined(ranks, rest, keys)


def tensor_long(df: DataFrame, name: Column, values: str, row: Column) -> DataFrame:
    """(name, t, h, x) of arrays: t the row's position, h the channel."""
    return df.select(name.alias("name"), row.alias("t"), F.posexplode(values).alias("h", "x")).withColumn("x", F.col("x").cast("double"))


def tensor_stats(long: DataFrame) -> DataFrame:
    """Root mean square, greatest and mean magnitude, magnitudes at 0.99 and 0.999, and their ratios."""
    a = F.abs("x")
    base = long.groupBy("name").agg(F.count("x").alias("numel"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.max(a).alias("max_abs"), F.avg(a).alias("mean_abs"))
    ranks = at_rank(long.withColumn("a", a), ["name"], "a", {"p99_abs": 0.99, "p999_abs": 0.999})
    both = joined(base, ranks, ["name"])
    ratio = lambda c: F.when(F.col("rms") > 1e-12, F.round(F.col(c) / F.col("rms"), 4)).otherwise(F.lit(float("inf")))
    return both.select(
        "name", "numel", *[F.round(c, 6).alias(c) for c in ("rms", "max_abs", "mean_abs", "p99_abs", "p999_abs")],
        ratio("max_abs").alias("max_over_rms"), ratio("p99_abs").alias("p99_over_rms"), ratio("p999_abs").alias("p999_over_rms"),
    )


def outliers(stats: DataFrame, k: int = 25) -> DataFrame:
    """O2: the k tensors that stand out most; empty ones don't count."""
    return stats.where("numel > 0").orderBy(F.col("max_over_rms").desc(), "name").limit(k)


def combined_passes(stats: DataFrame) -> DataFrame:
    """Means of the passes, the greatest of the maxima, ratios anew."""
    m = stats.groupBy("name").agg(*[F.avg(c).alias(c) for c in ("rms", "mean_abs", "p99_abs", "p999_abs")], F.max("max_abs").alias("max_abs"))
    ratio = lambda c: F.when(F.col("rms") > 1e-12, F.col(c) / F.col("rms")).otherwise(F.lit(float("inf")))
    return m.withColumns({"max_over_rms": ratio("max_abs"), "p99_over_rms": ratio("p99_abs"), "p999_over_rms": ratio("p999_abs")})


def compared(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """A figure of two tables by name; NaN where the right has none."""
    r = right.select("name", F.col(value).alias("other"))
    return left.select("name", value).join(r, "name", "left").withColumn("other", F.coalesce("other", F.lit(float("nan"))))


def by_position(long: DataFrame) -> DataFrame:
    """For each position its greatest magnitude over the whole tensor's and over its own root mean square."""
    per = long.groupBy("t").agg(F.max(F.abs("x")).alias("m"), F.sum(F.col("x") * F.col("x")).alias("s"), F.count("x").alias("n"))
    whole = long.agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("g"))
    return per.crossJoin(F.broadcast(whole)).select("t", (F.col("m") / (F.col("g") + 1e-8)).alias("ratio_global"), (F.col("m") / (F.sqrt(F.col("s") / F.col("n")) + 1e-8)).alias("ratio_local"))


def channel_energy(long: DataFrame) -> DataFrame:
    """Each channel's mean square and its share of all channels'."""
    per = long.groupBy("h").agg(F.avg(F.col("x") * F.col("x")).alias("energy"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("energy").alias("__all")))).select("h", "energy", (F.col("energy") / F.col("__all")).alias("share"))


def greatest_place(long: DataFrame) -> DataFrame:
    """Where the greatest magnitude lies, the first in order on ties."""
    return long.agg(F.max(F.struct(F.abs("x").alias("v"), (-F.col("t")).alias("t"), (-F.col("h")).alias("h"))).alias("m")).select((-F.col("m.t")).alias("t"), (-F.col("m.h")).alias("h"), F.col("m.v").alias("value"))


def bands(positions: DataFrame, early: int = 8, mid: int = 128, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean ratios of early, middle and late positions."""
    t, r = F.col("t"), F.col("ratio_global")
    means = {"early": F.avg(F.when(t < early, r)), "mid": F.avg(F.when((t >= early) & (t < mid), r)), "late": F.avg(F.when(t >= mid, r))}
    return positions.groupBy(*keys).agg(*[v.alias(k) for k, v in means.items()])


def block_places(long: DataFrame, early: int = 8, mid: int = 128) -> DataFrame:
    """For each tensor its bands, where its greatest magnitude lies and the channel of most energy."""
    x = F.col("x")
    whole = long.groupBy("name").agg(F.sqrt(F.avg(x * x)).alias("__g"), F.max(F.struct(F.abs("x").alias("v"), (-F.col("t")).alias("t"), (-F.col("h")).alias("h"))).alias("__m"))
    at = long.groupBy("name", "t").agg(F.max(F.abs("x")).alias("m")).join(whole.select("name", "__g"), "name")
    by = bands(at.withColumn("ratio_global", F.col("m") / (F.col("__g") + 1e-8)), early, mid, ("name",))
    channels = long.groupBy("name", "h").agg(F.avg(x * x).alias("e")).groupBy("name").agg(F.max(F.struct("e", (-F.col("h")).alias("h"))).alias("c"), F.sum("e").alias("s"))
    places = whole.select("name", (-F.col("__m.t")).alias("max_position"), (-F.col("__m.h")).alias("max_channel"), F.col("__m.v").alias("max_value"))
    return places.join(by, "name").join(channels.select("name", (-F.col("c.h")).alias("channel"), (F.col("c.e") / F.col("s")).alias("channel_share")), "name")


def outlier_verdict(blocks: DataFrame, early: int = 8) -> DataFrame:
    """Whether early positions carry the outliers, and whether one channel does.

    blocks: a row a block, as block_places gives them. Of equally frequent channels the one that
    the first block by name has counts.
    """
    n, first = F.count(F.lit(1)), F.max(F.struct("k", F.col("__first").alias("f"), "channel"))
    sums = blocks.agg(n.alias("blocks"), F.avg((F.col("max_position") < early).cast("double")).alias("early_fraction"), F.avg("early").alias("early"), F.avg("late").alias("late"))
    order = blocks.withColumn("__nr", -F.row_number().over(Window.orderBy("name")))  # one row a block of a model
    top = order.groupBy("channel").agg(n.alias("k"), F.max("__nr").alias("__first")).agg(first.alias("top")).select(F.col("top.channel").alias("top_channel"), F.col("top.k").alias("top_blocks"))
    leads = (F.col("early_fraction") >= 0.5) & F.coalesce(F.col("early") > 1.3 * F.col("late"), F.lit(False))
    return sums.crossJoin(F.broadcast(top)).withColumns({"early_leads": leads, "fixed_channel": F.col("top_blocks") >= 0.5 * F.col("blocks")})


def block_trend(stats: DataFrame, value: str = "max_over_rms") -> DataFrame:
    """The greatest figure of each block, by the block's number in the name."""
    block = F.regexp_extract("name", r"block_(\d+)", 1)
    return stats.where(block != "").groupBy(block.cast("int").alias("block")).agg(F.max(value).alias(value))


def spread(long: DataFrame, group: str) -> DataFrame:
    """Mean and population deviation of magnitudes, sample deviation of values."""
    return long.groupBy(group).agg(F.avg(F.abs("x")).alias("mean_abs"), F.stddev_pop(F.abs("x")).alias("std_abs"), F.stddev_samp("x").alias("std"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int = 200) -> DataFrame:
    """(bin, n, density) of equal bins; the upper bound belongs to the last one."""
    v = value.cast("double")
    b = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    counts = df.where(v.between(low, high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__n"))
    return counts.crossJoin(F.broadcast(total)).select("bin", "n", (F.col("n") / (F.col("__n") * ((high - low) / bins))).alias("density"))


def non_finite(df: DataFrame, value: str) -> DataFrame:
    """T27"""
    x = F.col(value).cast("double")
    return df.agg(F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("non_finite"))


def mean_of_means(df: DataFrame, source: str, value: str) -> DataFrame:
    """Each source's mean, and the plain mean of those."""
    per = df.groupBy(source).agg(F.avg(value).alias("loss"))
    return per.crossJoin(F.broadcast(per.agg(F.avg("loss").alias("overall"))))


def capped_batches(df: DataFrame, source: str, order: list[str], most: int = 32) -> DataFrame:
    """At most so many batches of a source, in order, going on into its next shard."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("__r") <= most).drop("__r")


def perplexity(df: DataFrame, keys: list[str], loss: str) -> DataFrame:
    """A15"""
    return df.groupBy(*keys).agg(F.exp(F.avg(loss)).alias("perplexity"), F.min(loss).alias("min_loss"), F.max(loss).alias("max_loss"))


def medians(df: DataFrame, category: str, value: str) -> DataFrame:
    """The upper median of each category."""
    return at_rank(df, [category], value, {"median": 0.5})


def window_means(df: DataFrame, keys: list[str], index: str, value: str, n: int = 64) -> DataFrame:
    """The mean of each window of n; a short one is scaled to what is present."""
    return df.groupBy(*keys, F.floor(F.col(index) / n).alias("window")).agg(((F.sum(F.col(value) / n)) * (F.lit(n) / F.count(value))).alias("mean"), F.count(value).alias("present"))


def repetition(text: Column, n: int) -> Column:
    """The share of n-grams of words that are repeats; 0 for fewer than n words.

    n-grams are compared by 64-bit hashes of their words.
    """
    grams = F.transform(F.sequence(F.lit(0), F.size("__w") - n), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(n)]))
    return F.when(F.size("__w") < n, F.lit(0.0)).otherwise((F.size("__w") - n + 1 - F.size(F.array_distinct(grams))) / (F.size("__w") - n + 1))


def with_repetition(df: DataFrame, n: int, text: str = "text", name: str = "repetition") -> DataFrame:
    return df.withColumn("__w", T.words(F.col(text))).withColumn(name, repetition(F.col(text), n)).drop("__w")


def diversity(items: Column) -> Column:
    """Different items over all items."""
    return F.when(F.size(items) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(items)) / F.size(items))


def judged(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Figures of a criterion; a zero is an error and doesn't count."""
    v = F.when(F.col(score) > 0, F.col(score))
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """T16"""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centred(df: DataFrame, key: list[str], values: str) -> DataFrame:
    """Vectors without the table's mean vector."""
    long = df.select(*key, F.posexplode(values).alias("h", "x"))
    mean = long.groupBy("h").agg(F.avg("x").alias("m"))
    mids = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "m"))), lambda s: s["m"]).alias("__m"))  # one row of as many numbers as channels
    return df.crossJoin(F.broadcast(mids)).withColumn(values, F.zip_with(values, "__m", lambda x, m: x.cast("double") - m)).drop("__m")


def group_gap(df: DataFrame, label: str, values: str) -> DataFrame:
    """Mean cosine within labels less that across labels, over all pairs of vectors.

    Sums of unit vectors give all pairs' cosines without forming pairs: the squared length of a
    group's sum is the sum over its ordered pairs, a vector with itself included.
    """
    unit = df.withColumn("__l", F.sqrt(dot(F.col(values), F.col(values)))).where("__l > 0").select(label, F.transform(values, lambda x: x.cast("double")).alias("v"), "__l")
    unit = unit.select(label, F.posexplode("v").alias("h", "x"), "__l").withColumn("u", F.col("x") / F.col("__l"))
    cells = unit.groupBy(label, "h").agg(F.sum("u").alias("s"), F.count(F.lit(1)).alias("n"))
    within = cells.groupBy(label).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    inner = within.agg(F.sum(F.col("q") - F.col("n")).alias("same"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same_n"), F.sum("n").alias("n"))
    whole = cells.groupBy("h").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("all"))
    both = inner.crossJoin(F.broadcast(whole))
    same = F.try_divide("same", "same_n")
    other = F.try_divide(F.col("all") - F.col("n") - F.col("same"), F.col("n") * (F.col("n") - 1) - F.col("same_n"))
    return both.select(same.alias("within"), other.alias("across"), (same - other).alias("gap")).withColumn("label", T.gap_label(F.col("gap")))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """T17"""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def penalised(logits: Column, seen: Column, penalty: float) -> Column:
    """Logits of seen ids made less likely."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i.cast("int")), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


def top_k(logits: Column, k: int) -> Column:
    """The k greatest as (value, id), greatest first, ties by id."""
    pairs = F.transform(logits, lambda x, i: F.struct((-x).alias("v"), i.alias("id")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["v"]).alias("value"), p["id"].alias("id")))


def nucleus(probabilities: Column, p: float) -> Column:
    """The ids of the smallest set of greatest probabilities that reaches p."""
    pairs = F.array_sort(F.transform(probabilities, lambda x, i: F.struct((-x).alias("v"), i.alias("id"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("ids"))
    step = lambda a, x: F.when(a["sum"] < p, F.struct((a["sum"] - x["v"]).alias("sum"), F.concat(a["ids"], F.array(x["id"].cast("int"))).alias("ids"))).otherwise(a)
    return F.aggregate(pairs, start, step)["ids"]


def matching_weights(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored tensors whose cleaned name and shape the model has; (name, shape)."""
    clean = stored.withColumn("name", F.replace("name", F.lit("_orig_mod."), F.lit("")))
    return clean.join(wanted, ["name", "shape"], "left_semi")


def selection_summary(selected: DataFrame, available: DataFrame, source: str = "domain") -> DataFrame:
    """Passes, tokens and different shards of each source, its share of what there is, and epochs."""
    have = available.groupBy(source).agg(F.count(F.lit(1)).alias("available_shards"), F.sum("tokens").alias("available_tokens"))
    took = selected.groupBy(source).agg(F.count(F.lit(1)).alias("passes"), F.sum("tokens").alias("tokens"), F.count_distinct("shard").alias("unique_shards"))
    both = took.join(have, source)
    return both.withColumn("percent", F.round(100 * F.try_divide("tokens", "available_tokens"), 2)).withColumn("epochs", F.round(F.try_divide("passes", "unique_shards"), 2))
