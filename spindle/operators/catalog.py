"""The shard catalogue: manifests, gates, merges, provenance, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .budget import at_rank, cut_with_reset
from .corpus import numbered

WIDTH = 2  # bytes of a token id in the default shard type


def duplicated(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keys held more than once, with how many rows and their members in order."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list(F.col(member).cast("string"))), ",").alias("members")).where("n > 1")


def presence(manifest: DataFrame, listing: DataFrame, width: int = WIDTH) -> DataFrame:
    """manifest rows by what lies on disk: kept, missing or wrong_size."""
    on_disk = listing.select(F.col("name").alias("shard"), F.col("size").alias("__size"))
    status = F.when(F.col("__size").isNull(), "missing").when(F.col("__size") != F.col("tokens") * width, "wrong_size").otherwise("kept")
    return manifest.join(on_disk, "shard", "left").withColumn("status", status).drop("__size")


def skipped_by_reason(found: DataFrame, source: str = "domain") -> DataFrame:
    """For each source how many shards are missing and how many have the wrong size."""
    return found.groupBy(source).agg(F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "wrong_size").alias("wrong_size"))


def size_summary(found: DataFrame, source: str = "domain") -> DataFrame:
    """A8"""
    return found.groupBy(source).agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("kept", "ok"), ("wrong_size", "mismatch"), ("missing", "missing"))])


def absent(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of the left without a partner."""
    return left.join(right.select(key), key, "left_anti")


def oversize(manifest: DataFrame, width: int = WIDTH, factor: float = 1.0) -> DataFrame:
    """shards larger than their source allows, worst first."""
    size = F.col("tokens") * width
    return manifest.where(size > factor * width * F.col("source_size")).withColumn("ratio", F.round(size / F.col("source_size"), 4)).orderBy(F.col("ratio").desc(), "shard")


def classified(sources: DataFrame, manifest: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Each source as new, recheck (its size changed; with strict also its hash) or skip."""
    old = manifest.select(*keys, F.col("source_size").alias("__size"), F.col("source_hash").alias("__hash"), F.lit(True).alias("__old"))
    changed = F.col("__size") != F.col("source_size")
    if strict:
        changed = changed | (F.col("__hash") != F.col("source_hash"))
    return sources.join(old, keys, "left").withColumn("action", F.when(F.col("__old").isNull(), "new").when(changed, "recheck").otherwise("skip")).drop("__size", "__hash", "__old")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """New rows over old ones by key; old places stay, fresh keys go to the end."""
    values = [c for c in old.columns if c not in keys and c != position]
    n = new.select(*keys, F.col(position).alias("__np"), F.struct(*values).alias("__n"))
    kept = old.join(n.drop("__np"), keys, "left").select(*keys, F.col(position).cast("long").alias(position), F.coalesce("__n", F.struct(*values)).alias("v"))
    last = old.agg(F.coalesce(F.max(position), F.lit(-1)).alias("__last"))  # one row
    fresh = numbered(n.join(old.select(*keys), keys, "left_anti").withColumn("__all", F.lit(0)), ["__all"], "__np").crossJoin(F.broadcast(last))
    fresh = fresh.select(*keys, (F.col("__last") + 1 + F.col("nr")).cast("long").alias(position), F.col("__n").alias("v"))
    return kept.unionByName(fresh).select(*keys, position, "v.*")


def merge_plan(shards: DataFrame, target: int, width: int = WIDTH, first_index: int = 0, emerged: DataFrame | None = None) -> DataFrame:
    """M3: (merged_index, merged_shard, domain, bucket, place, shard columns): which shards make up which merged one.

    Domains follow each other as they first appear (W15), or as emerged (domain, __emerged) says;
    shards within a domain go by their place.
    """
    sized = shards.withColumn("bytes", F.col("tokens") * width)
    cut = cut_with_reset(sized, "domain", "pos", "bytes", target)
    emerged = shards.groupBy("domain").agg(F.min("pos").alias("__emerged")) if emerged is None else emerged
    buckets = cut.groupBy("domain", "bucket").agg(F.min("pos").alias("__p")).join(emerged, "domain")
    # one row a merged shard: catalogue rows
    nr = F.row_number().over(Window.orderBy("__emerged", "bucket"))
    named = buckets.select("domain", "bucket", (nr - 1 + first_index).cast("long").alias("merged_index"))
    out = cut.join(named, ["domain", "bucket"])
    place = F.row_number().over(Window.partitionBy("merged_index").orderBy("pos")) - 1
    return out.withColumns({"merged_shard": T.shard_name(F.col("merged_index")), "place": place.cast("int")})


def merged_entries(plan: DataFrame, width: int = WIDTH) -> DataFrame:
    """The manifest entries of a plan, with their parts in order."""
    parts = F.array_sort(F.collect_list(F.struct("place", "shard", "source", "tokens")))
    grouped = plan.groupBy("merged_index", "merged_shard", "domain").agg(F.sum("tokens").alias("tokens"), F.sum("documents").alias("documents"), parts.alias("p"))
    return grouped.select(
        F.col("merged_shard").alias("shard"), T.merged_source(F.col("p")[0]["source"], F.col("merged_index")).alias("source"), "domain", "tokens", "documents",
        F.round(F.col("tokens") * width / (1024 * 1024), 2).alias("shard_mb"), F.transform("p", lambda x: F.struct(x["shard"].alias("shard"), x["source"].alias("source"), x["tokens"].alias("tokens"))).alias("merged_from"),
    )


def merged_ids(plan: DataFrame, ids: DataFrame) -> DataFrame:
    """M5: the token ids of each merged shard, parts concatenated in order; (merged_shard, ids)."""
    joined = plan.select("merged_shard", "place", "shard").join(ids, "shard")
    parts = F.array_sort(F.collect_list(F.struct("place", "ids")))
    return joined.groupBy("merged_shard").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def divergences(merged: DataFrame, shards: DataFrame) -> DataFrame:
    """What keeps existing merged shards from being extended: (problem, merged_shard, shard).

    merged: (shard, domain, merged_from); shards: the current inputs (shard, domain, tokens).
    """
    twice = duplicated(shards, "shard", "domain").select(F.lit("duplicate_input").alias("problem"), F.lit(None).cast("string").alias("merged_shard"), "shard")
    bare = merged.where(F.coalesce(F.size("merged_from"), F.lit(0)) <= 0).select(F.lit("no_refs").alias("problem"), F.col("shard").alias("merged_shard"), F.lit(None).cast("string").alias("shard"))
    refs = merged.select(F.col("shard").alias("merged_shard"), F.col("domain").alias("merged_domain"), F.explode("merged_from").alias("r")).select("merged_shard", "merged_domain", F.col("r.shard").alias("shard"), F.col("r.tokens").alias("ref_tokens"))
    claims = F.count(F.lit(1)).over(Window.partitionBy("shard"))
    double = refs.withColumn("n", claims).where("n > 1").select(F.lit("double_claim").alias("problem"), "merged_shard", "shard")
    now = shards.dropDuplicates(["shard"]).select("shard", F.col("domain").alias("now_domain"), F.col("tokens").alias("now_tokens"))
    met = refs.join(now, "shard", "left")
    problem = (
        F.when(F.col("now_tokens").isNull() & F.col("now_domain").isNull(), "removed").when(~F.col("now_tokens").eqNullSafe(F.col("ref_tokens")), "retokenized").when(~F.col("now_domain").eqNullSafe(F.col("merged_domain")), "moved")
    )
    wrong = met.withColumn("problem", problem).where("problem IS NOT NULL").select("problem", "merged_shard", "shard")
    return twice.unionByName(bare).unionByName(double).unionByName(wrong)


def incremental_plan(merged: DataFrame, shards: DataFrame, target: int, width: int = WIDTH) -> DataFrame:
    """M4: the plan for shards that no merged one holds yet; numbers go on after the last.

    Raises ValueError when the catalogue diverges. Shards of a domain come by their index.
    """
    problems = divergences(merged, shards).limit(5).collect()
    if problems:
        raise ValueError("cannot extend: " + "; ".join(f"{p.problem} {p.merged_shard or ''} {p.shard or ''}" for p in problems))
    consumed = merged.select(F.explode("merged_from").alias("r")).select(F.col("r.shard").alias("shard"))
    left = absent(shards, consumed, "shard")
    last = merged.agg(F.max(T.shard_index(F.col("shard"))).alias("m")).first().m
    emerged = left.groupBy("domain").agg(F.min("pos").alias("__emerged"))  # as the manifest names them
    placed = left.withColumn("pos", T.shard_index(F.col("shard")))  # within a domain by index
    return merge_plan(placed, target, width, 0 if last is None else int(last) + 1, emerged)


def fingerprint(shards: DataFrame, target: int) -> DataFrame:
    """Sixteen hex digits over the target and the inputs in order; equal inputs need no merge.

    The digest is one over all entries, so they meet in one row: some 150 bytes an entry, so that
    the 2 GB of a row are reached at about 14 million entries, beyond which it raises.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    piece = F.concat(F.lit("|"), text("source"), F.lit("|"), text("source_size"), F.lit("|"), text("source_hash"), F.lit("|"), text("tokens"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("t")))), lambda x: x["t"])
    return shards.agg(T.sha16(F.concat(F.lit(str(target)), F.array_join(parts, ""))).alias("merge_fingerprint"))


def plan_sizes(plan: DataFrame, width: int = WIDTH) -> DataFrame:
    """A10: for each domain the merged shards' least, upper median and greatest size."""
    sizes = plan.groupBy("domain", "merged_index").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("k"), (F.sum("tokens") * width).alias("bytes"))
    sums = sizes.groupBy("domain").agg(
        F.count(F.lit(1)).alias("shards"), F.sum("t").alias("tokens"), F.sum("k").alias("sources"), F.min("bytes").alias("min_bytes"), F.max("bytes").alias("max_bytes")
    )
    return sums.join(at_rank(sizes, ["domain"], "bytes", {"p50_bytes": 0.5}), "domain")


def offsets(plan: DataFrame, width: int = WIDTH) -> DataFrame:
    """Where each part begins within its merged shard, in bytes."""
    before = Window.partitionBy("merged_shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return plan.withColumn("byte_offset", (F.coalesce(F.sum("tokens").over(before), F.lit(0)) * width).cast("long"))


def holding(merged: DataFrame, query: str) -> DataFrame:
    """Merged shards with a part whose source holds the query."""
    hits = F.filter("merged_from", lambda r: r["source"].contains(query))
    return merged.where(F.size(hits) > 0).select("shard", "domain", F.size(hits).alias("hits"))


def rollup(merged: DataFrame) -> DataFrame:
    """A2: for each domain shards, tokens and parts."""
    return merged.groupBy(F.coalesce("domain", F.lit("other")).alias("domain")).agg(
        F.count(F.lit(1)).alias("shards"), F.sum("tokens").alias("tokens"), F.sum(F.greatest(F.coalesce(F.size("merged_from"), F.lit(0)), F.lit(0))).cast("long").alias("parts")
    )


def provenance(merged: DataFrame, selected: DataFrame, pinned: DataFrame, mix: DataFrame, domains: DataFrame) -> DataFrame:
    """The fourteen columns of the provenance report.

    merged: manifest entries; selected: (shard) once each; pinned: (shard); mix: (domain, weight);
    domains: (domain, passes, tokens) of the selection. A shard without parts stands for itself.
    """
    own = F.array(F.struct("shard", "source", "tokens"))
    merged = merged.withColumn("domain", F.coalesce(F.nullif("domain", F.lit("")), T.domain_of_path(F.col("source"))))
    parts = merged.withColumn("r", F.explode(F.when(F.coalesce(F.size("merged_from"), F.lit(0)) > 0, F.col("merged_from")).otherwise(own)))
    rows = parts.select(
        F.col("r.source").alias("source_txt"), T.basename(F.col("r.source")).alias("source_file"), T.domain_of_path(F.col("r.source"), F.col("domain")).alias("source_domain"), F.col("r.tokens").alias("source_tokens"), F.col("r.shard").alias("source_shard"),
        F.col("shard").alias("merged_shard"), F.col("domain").alias("merged_domain"), F.col("tokens").alias("merged_tokens"), F.col("shard_mb").alias("merged_mb"),
    )
    yes = lambda df, name: df.select(F.col("shard").alias("merged_shard"), F.lit("yes").alias(name)).distinct()
    rows = rows.join(yes(selected, "selected_for_training"), "merged_shard", "left").join(yes(pinned, "eval_heldout"), "merged_shard", "left")
    rows = rows.fillna("no", ["selected_for_training", "eval_heldout"])
    rows = rows.join(mix.select(F.col("domain").alias("merged_domain"), F.col("weight").alias("training_weight")), "merged_domain", "left")
    return rows.join(domains.select(F.col("domain").alias("merged_domain"), F.col("passes").alias("selected_domain_passes"), F.col("tokens").alias("selected_domain_tokens")), "merged_domain", "left")


def domain_summary(rows: DataFrame) -> DataFrame:
    """For each source domain its rows, tokens and three counts of different merged shards."""
    when = lambda c: F.when(F.col(c) == "yes", F.col("merged_shard"))
    out = rows.groupBy(F.col("source_domain").alias("domain")).agg(
        F.count(F.lit(1)).alias("txt_files"), F.sum("source_tokens").alias("source_tokens"), F.count_distinct("merged_shard").alias("merged_shards"),
        F.count_distinct(when("selected_for_training")).alias("selected_merged_shards"), F.count_distinct(when("eval_heldout")).alias("eval_merged_shards"),
    )
    return out.orderBy(F.col("source_tokens").desc(), "domain")


def totals(rows: DataFrame) -> DataFrame:
    """A4"""
    when = lambda c: F.when(F.col(c) == "yes", F.col("merged_shard"))
    return rows.agg(
        F.count(F.lit(1)).alias("txt_files"), F.sum("source_tokens").alias("source_tokens"), F.count_distinct("merged_shard").alias("merged_shards"),
        F.count_distinct(when("selected_for_training")).alias("selected_merged_shards"), F.count_distinct(when("eval_heldout")).alias("eval_merged_shards"),
    )


def siblings(rows: DataFrame, query: str) -> DataFrame:
    """All rows whose merged shard holds a row that matches the query."""
    matched = rows.where(T.contains_any(query, "source_txt", "source_file", "source_domain", "merged_shard")).select("merged_shard").distinct()
    return rows.join(matched, "merged_shard", "left_semi")


def repair_plan(merged: DataFrame, listing: DataFrame, archived: DataFrame, width: int = WIDTH, limit: int | None = None) -> DataFrame:
    """For merged shards that are missing, which archived shard goes where.

    merged: manifest entries; listing, archived: (name, size). Adds whether the archive has the
    part in its right size and whether all parts of the merged shard are there.
    """
    gone = absent(merged, listing.select(F.col("name").alias("shard")), "shard")
    if limit is not None:
        gone = gone.orderBy("shard").limit(limit)
    parts = gone.select(F.col("shard").alias("merged_shard"), F.posexplode("merged_from").alias("place", "r")).select("merged_shard", "place", F.col("r.shard").alias("shard"), F.col("r.tokens").alias("tokens"))
    placed = offsets(parts, width).withColumn("bytes", F.col("tokens") * width)
    met = placed.join(archived.select(F.col("name").alias("shard"), F.col("size").alias("__size")), "shard", "left")
    state = F.when(F.col("__size").isNull(), "absent").when(F.col("__size") != F.col("bytes"), "wrong_size").otherwise("found")
    whole = F.count_if(F.col("state") == "found").over(Window.partitionBy("merged_shard")) == F.count(F.lit(1)).over(Window.partitionBy("merged_shard"))
    return met.withColumn("state", state).withColumn("complete", whole).drop("__size")


def issues(shards: DataFrame, listing: DataFrame, width: int = WIDTH) -> DataFrame:
    """M1, M7, M9: everything wrong with a manifest, one row each: (check, item, detail)."""
    row = lambda check, item, detail: [F.lit(check).alias("check"), F.col(item).alias("item"), detail.cast("string").alias("detail")]
    on_disk = listing.select(F.col("name").alias("shard"), "size")
    found = [
        duplicated(shards, "shard", "source").select(*row("duplicate_shard", "shard", F.col("n"))),
        duplicated(shards, "source", "shard").select(*row("duplicate_source", "source", F.col("n"))),
        shards.where(T.parent_dir(F.col("source")) == "").select(*row("no_domain", "shard", F.col("source"))),
        absent(shards, on_disk, "shard").select(*row("missing_file", "shard", F.col("tokens"))),
        on_disk.join(shards.select("shard"), "shard", "left_anti").select(*row("orphan_file", "shard", F.col("size"))),
        on_disk.where(F.pmod("size", F.lit(width)) != 0).select(*row("misaligned", "shard", F.col("size"))),
        shards.join(on_disk, "shard").where(F.col("size") != F.col("tokens") * width).select(*row("wrong_size", "shard", F.col("size"))),
        shards.where(F.col("tokens") * width > width * F.col("source_size")).select(*row("oversize", "shard", F.col("tokens"))),
        shards.where(F.col("tokens") < 0).select(*row("negative_tokens", "shard", F.col("tokens"))),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


#: The order in which a manifest's faults stop a run (M1); fixed values.
GATES = ("duplicate_shard", "duplicate_source", "orphan_file", "oversize")


def gate(found: DataFrame) -> None:
    """M1: raises on the first class of fault that occurs."""
    counts = {r.check: r["count"] for r in found.where(F.col("check").isin(*GATES)).groupBy("check").count().collect()}
    for name in GATES:
        if counts.get(name):
            raise ValueError(f"{counts[name]} x {name}")


def examples(found: DataFrame, most: int = 5) -> DataFrame:
    """The first few items of each class."""
    nr = F.row_number().over(Window.partitionBy("check").orderBy("item"))
    return found.withColumn("nr", nr).where(F.col("nr") <= most)


def same_identity(*ids: str | None) -> None:
    """all artefacts must carry the same tokenizer identity."""
    if len(set(ids)) != 1 or None in ids:
        raise ValueError(f"tokenizer identities differ: {ids}")


def meta(shards: DataFrame, vocab_size: int, eot_id: int, pad_id: int, tokenizer: str, dtype: str, tokenization_id: str) -> DataFrame:
    """The one-row summary of a manifest."""
    sums = shards.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("num_tokens"), F.count(F.lit(1)).alias("num_shards"))
    return sums.select("*", *[F.lit(v).alias(k) for k, v in (("vocab_size", vocab_size), ("eot_id", eot_id), ("pad_id", pad_id), ("tokenizer", tokenizer), ("shard_dtype", dtype), ("tokenization_id", tokenization_id))])
