"""Gates around a run: identities, id ranges, cross-checks, the merge driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog

#: Greatest id of each token type; fixed values.
TOP_IDS = {"uint8": 2**8 - 1, "uint16": 2**16 - 1, "uint32": 2**32 - 1, "int32": 2**31 - 1}


def selected_names(training: DataFrame) -> DataFrame:
    """The different shards that any source of a training manifest selected; (shard)."""
    sources = training.select(F.explode(F.map_values("data_selection.sources")).alias("s"))
    return sources.select(F.explode("s.unique").alias("shard")).distinct()


def throughput(files: DataFrame, keys: list[str], size: str, seconds: Column) -> DataFrame:
    """For each group the gigabytes and the megabytes a second, both of 1024 to the step."""
    total = F.sum(size)
    return files.groupBy(*keys).agg((total / 1024**3).alias("gigabytes"), (total / 1024**2 / F.greatest(seconds, F.lit(0.01))).alias("megabytes_a_second"))


def preferred(names: DataFrame, wanted: str, suffix: str = ".pth", name: str = "name") -> DataFrame:
    """The wanted name where it is there, else the last one in order; null without any."""
    n = F.col(name)
    return names.where(n.endswith(suffix)).agg(F.coalesce(F.max(F.when(n == wanted, n)), F.max(n)).alias("picked"))


def id_range_faults(vocabulary: DataFrame, dtype: str, column: str = "id") -> DataFrame:
    """(fault, value, most) where a vocabulary's size or its greatest id don't fit the token type."""
    top = TOP_IDS[dtype]
    sums = vocabulary.agg(F.count(F.lit(1)).alias("size"), F.max(column).cast("long").alias("last"))
    fault = lambda name, value, most: F.when(F.col(value) > most, F.struct(F.lit(name).alias("fault"), F.col(value).alias("value"), F.lit(most).cast("long").alias("most")))
    found = F.filter(F.array(fault("vocab_size", "size", top + 1), fault("max_id", "last", top)), lambda x: x.isNotNull())
    return sums.select(F.explode(found).alias("f")).select("f.*")


def tokenizer_identity(spark: SparkSession, path: str) -> DataFrame:
    """The first 16 hex digits of a tokenizer file's SHA-256; one row."""
    return spark.read.format("binaryFile").load(path).select(F.substring(F.sha2("content", 256), 1, 16).alias("tokenization_id"))


def still_valid(manifest: DataFrame, identity: DataFrame) -> DataFrame:
    """The entries of a manifest that the present tokenizer made; of another's none stays."""
    return manifest.join(F.broadcast(identity), "tokenization_id", "left_semi")  # one row


def meta_faults(shards: DataFrame, meta: DataFrame, manifest_id: str | None, stored_id: str | None) -> DataFrame:
    """M8: (fault, stated, found) between a manifest, its one-row summary and the stored identity."""
    sums = shards.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).crossJoin(F.broadcast(meta))
    missing = [c for c in ("num_tokens", "num_shards", "vocab_size", "shard_dtype") if c not in meta.columns]

    def fault(name: str, stated: Column, found: Column) -> Column:
        stated, found = stated.cast("string"), found.cast("string")
        return F.when(~stated.eqNullSafe(found), F.struct(F.lit(name).alias("fault"), stated.alias("stated"), found.alias("found")))

    checks = [fault(f"meta without {c}", F.lit(None), F.lit("a value")) for c in missing]
    checks += [fault(c, F.col(c), F.col(v)) for c, v in (("num_shards", "n"), ("num_tokens", "t")) if c not in missing]
    checks.append(fault("manifest identity", F.lit(manifest_id), F.lit(stored_id)))
    if "tokenization_id" in meta.columns:
        checks.append(fault("meta identity", F.col("tokenization_id"), F.lit(stored_id)))
    return sums.select(F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("f")).select("f.*")


def merge_run(shards: DataFrame, identity: str, target: int, listing: DataFrame, merged: DataFrame | None = None, state: dict | None = None, rebuild: bool = False, dry_run: bool = False) -> tuple[str, DataFrame | None, dict]:
    """M6: what a merge does now: (action, plan, new state).

    merged and state (tokenization_id, merge_target_bytes, merge_fingerprint) are those of the merge
    before. Actions: ``nothing`` where the inputs are those of the merge before, ``extend`` with a plan
    for what no merged shard holds, ``rebuild`` with a plan for all, each as ``dry ...`` in a dry run.
    Raises ValueError where another tokenizer or target made the merged shards, where the catalogue
    diverges, or where a shard that the plan reads is not in the listing; rebuild=True starts anew.
    """
    old = None if rebuild or merged is None else (state or {})
    now = {"tokenization_id": identity, "merge_target_bytes": target, "merge_fingerprint": catalog.fingerprint(shards, target).first().merge_fingerprint}
    if old is not None:
        for key in ("tokenization_id", "merge_target_bytes"):
            if old.get(key) is not None and now[key] is not None and old[key] != now[key]:
                raise ValueError(f"{key} mismatch: merged shards were made with {old[key]!r}, not {now[key]!r}")
        if old.get("merge_fingerprint") == now["merge_fingerprint"]:
            return "nothing", None, now
    plan = catalog.merge_plan(shards, target) if old is None else catalog.incremental_plan(merged, shards, target)
    gone = plan.select("shard").distinct().join(listing.select(F.col("name").alias("shard")), "shard", "left_anti").orderBy("shard").limit(5).collect()
    if gone:
        raise ValueError("not on disk: " + ", ".join(r.shard for r in gone))
    action = "rebuild" if old is None else "extend"
    return (f"dry {action}", plan, state or {}) if dry_run else (action, plan, now)
