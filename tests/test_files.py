import io
import json
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.functions import text as T
from spindle.operators import catalog, corpus
from spindle.sources import files
from spindle.streaming import incremental


def test_text_files_round_trip(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("domain", F.concat(F.lit("data_"), F.col("source")))
    packed = corpus.packed_files(docs, ["domain"], "doc_id", 7).select("domain", "file_no", "content")
    files.write_text_files(packed, str(tmp_path / "out"), ["domain", "file_no"])
    read = files.text_documents(spark, str(tmp_path / "out"))
    assert sorted(r.text for r in read.collect()) == sorted(r.text.strip() for r in docs.collect())
    before = files.listing(spark, str(tmp_path / "out"), "*.txt").count()
    files.write_text_files(packed, str(tmp_path / "out"), ["domain", "file_no"])  # outputs that exist are left
    assert files.listing(spark, str(tmp_path / "out"), "*.txt").count() == before


def test_text_with_broken_bytes(spark, tmp_path):
    (tmp_path / "data_x").mkdir()
    (tmp_path / "data_x" / "a.txt").write_bytes(b"one \xff\xfe two" + T.SEPARATOR.encode() + "drei ü".encode())
    got = files.text_documents(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in got) == ["drei ü", "one  two"] and {r.domain for r in got} == {"data_x"}


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int32"])
def test_token_shards(spark, tmp_path, dtype):
    files.register(spark)
    rows = [("shard_00000.bin", [1, 2, 200]), ("shard_00001.bin", [7]), ("shard_00002.bin", list(range(100)))]
    spark.createDataFrame(rows, "shard string, ids array<long>").write.format("token_shard_files").mode("append").option("path", str(tmp_path)).option("dtype", dtype).save()
    assert np.fromfile(tmp_path / "shard_00000.bin", dtype=dtype).tolist() == [1, 2, 200]
    got = {r.shard: r.ids for r in files.token_shards(spark, str(tmp_path), dtype).collect()}
    assert got == dict(rows)
    first = {r.shard: r.ids for r in files.token_shards(spark, str(tmp_path), dtype, max_tokens=2).collect()}
    assert first == {"shard_00000.bin": [1, 2], "shard_00001.bin": None, "shard_00002.bin": [0, 1]}


def test_ids_that_do_not_fit(spark, tmp_path):
    files.register(spark)
    df = spark.createDataFrame([("s.bin", [70_000])], "shard string, ids array<long>")
    with pytest.raises(Exception, match="fit"):
        df.write.format("token_shard_files").mode("append").option("path", str(tmp_path)).save()


def test_tar_in_parts(spark, tmp_path):
    files.register(spark)
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for k in range(5):
            data = bytes([k]) * (1000 * k + 10)
            info = tarfile.TarInfo(f"deep/shard_{k:05d}.bin")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        tar.addfile(tarfile.TarInfo("readme.txt"), io.BytesIO(b""))
    whole, parts = raw.getvalue(), []
    for i in range(6):
        parts.append(tmp_path / f"part{i}")
        parts[-1].write_bytes(whole[i * len(whole) // 6 : (i + 1) * len(whole) // 6])
    got = spark.read.format("tar_parts").option("path", ",".join(map(str, parts))).load().collect()
    assert [(r.name, r.size, bytes(r.content[:1])) for r in got] == [(f"shard_{k:05d}.bin", 1000 * k + 10, bytes([k])) for k in range(5)]


def test_manifests(spark, tmp_path):
    entry = {"shard": "shard_00000.bin", "source": "c/data_x/a.txt", "source_hash": "h", "source_size": 9, "tokens": 4, "documents": 1, "shard_mb": 0.0}
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"tokenization_id": "t", "shards": [entry, entry | {"shard": None}, {k: v for k, v in entry.items() if k != "tokens"} | {"documents": -1}, entry | {"tokens": "4"}]}))
    assert [r.tokens for r in files.manifest(spark, str(path)).where("pos = 0").collect()] == [4]
    assert sorted(map(tuple, files.manifest_faults(spark, str(path)).collect())) == [(1, "shard: null"), (2, "documents: negative"), (2, "tokens: missing"), (3, "tokens: wrong type")]


def test_edge_hash(spark, tmp_path):
    for name, size in (("a", 10), ("b", 3000), ("c", 3001)):
        (tmp_path / name).write_bytes(bytes(range(256)) * (size // 256) + b"x" * (size % 256))
    (tmp_path / "b2").write_bytes((tmp_path / "b").read_bytes()[:1200] + b"changed" + (tmp_path / "b").read_bytes()[1207:])
    got = {r.name: r.hash for r in files.edge_hashes(spark, str(tmp_path), edge=1000).collect()}
    assert got["b"] == got["b2"] and len({got["a"], got["b"], got["c"]}) == 3  # the middle doesn't count


def test_paths_and_reports(spark, tmp_path):
    (tmp_path / "there").mkdir()
    assert files.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "there")]).endswith("there")
    assert files.first_existing(spark, [str(tmp_path / "no")]) is None
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string")
    assert files.markdown_table(df) == "| n | s |\n|---|---|\n| 1 | a\\|b |\n| 2 |  |"
    files.write_json_lines(df, str(tmp_path / "j"))
    assert sorted(map(tuple, spark.read.schema("n int, s string").json(str(tmp_path / "j")).collect())) == [(1, "a|b"), (2, None)]
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).columns == ["n", "s"]


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    put = lambda a, b: spark.range(a, b).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text")).write.mode("append").parquet(src)
    keep = lambda df: corpus.keep(df, [("short", corpus.too_short(F.col("text"), 5))])
    for a, b in ((0, 10), (10, 20)):
        put(a, b)
        incremental.ingest(spark, src, "id long, text string", out, check, keep)
        incremental.ingest(spark, src, "id long, text string", out, check, keep)  # nothing new
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(5, 20))


def test_retokenize_only_what_changed(spark, tmp_path):
    src, manifest, check = (str(tmp_path / n) for n in ("in", "manifest", "check"))
    schema = "pos long, domain string, source string, source_size long, source_hash string"
    calls = []

    def entries(df):
        calls.append(sorted(r.source for r in df.select("source").collect()))
        return df.withColumn("tokens", F.col("source_size") * 2)

    spark.createDataFrame([(0, "d", "a", 5, "h"), (1, "d", "b", 6, "h")], schema).write.parquet(src)
    incremental.retokenize(spark, src, schema, manifest, check, entries, ["domain", "source"])
    spark.createDataFrame([(0, "d", "a", 5, "h"), (1, "d", "b", 7, "h"), (2, "d", "c", 1, "h")], schema).write.mode("append").parquet(src)
    incremental.retokenize(spark, src, schema, manifest, check, entries, ["domain", "source"])
    assert calls == [["a", "b"], ["b", "c"]]
    rows = incremental.latest(spark, manifest).orderBy("pos").collect()
    assert [(r.pos, r.source, r.tokens) for r in rows] == [(0, "a", 10), (1, "b", 14), (2, "c", 2)]


def test_a_batch_that_dies_after_its_write_is_tried_again(spark, tmp_path, monkeypatch):
    src, manifest, check = (str(tmp_path / n) for n in ("in", "manifest", "check"))
    schema = "pos long, domain string, source string, source_size long, source_hash string"
    entries = lambda df: df.withColumn("tokens", F.col("source_size") * 2)
    read, dies = incremental.latest, []

    def once_more(df, path):
        df.write.mode("overwrite").parquet(path)
        if dies:
            dies.pop()
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(incremental, "_store", once_more)
    spark.createDataFrame([(0, "d", "a", 5, "h"), (1, "d", "b", 6, "h")], schema).write.parquet(src)
    incremental.retokenize(spark, src, schema, manifest, check, entries, ["domain", "source"])
    for size, extra in ((7, 2), (8, 3)):
        rows = [(1, "d", "b", size, "h"), (extra, "d", f"x{extra}", 1, "h")]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        dies.append(1)
        with pytest.raises(Exception, match="lost after the write"):
            incremental.retokenize(spark, src, schema, manifest, check, entries, ["domain", "source"])
        incremental.retokenize(spark, src, schema, manifest, check, entries, ["domain", "source"])
        found = {r.source: r.tokens for r in read(spark, manifest).collect()}
        assert found["a"] == 10 and found["b"] == 2 * size and found[f"x{extra}"] == 2


def test_shards_are_emitted_once_whole(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "merged_shard string, place long, tokens long, parts long"
    out = []

    def run():
        stream = incremental.assembled(spark.readStream.schema(schema).parquet(src))
        q = stream.writeStream.foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    spark.createDataFrame([("m", 1, 10, 2), ("n", 0, 5, 1), ("k", 0, 1, 2)], schema).write.parquet(src)
    run()
    assert sorted(out) == [("n", 1, 5)]
    spark.createDataFrame([("m", 0, 7, 2), ("k", 0, 1, 2), ("n", 0, 5, 1)], schema).write.mode("append").parquet(src)
    run()
    assert sorted(out) == [("m", 2, 17), ("n", 1, 5)]


def test_state_of_the_last_checkpoint(spark, tmp_path):
    path = str(tmp_path / "state")
    assert incremental.run_state(spark, path) == {"step": 0, "seen": {}, "history": []}
    spark.createDataFrame([(5, ["a"], 1.5), (9, ["a", "a", "b"], 1.2)], "step long, seen_shards array<string>, loss double").write.parquet(f"{path}/version=00000000")
    assert incremental.run_state(spark, path) == {"step": 9, "seen": {"a": 2, "b": 1}, "history": [(5, 1.5), (9, 1.2)]}


def test_copy_plan(spark):
    cols = "name string, size long, hash string"
    a, b = spark.createDataFrame([("x", 1, "h"), ("y", 2, "h")], cols), spark.createDataFrame([("x", 1, "h"), ("y", 2, "other")], cols)
    assert [r.name for r in files.to_copy(a, b).collect()] == ["y"]
    assert catalog.absent(a, b.where("name = 'x'"), "name").count() == 1


def test_configuration(spark, tmp_path):
    from spindle.config import Config, read_config

    path = tmp_path / "c.json"
    path.write_text(json.dumps({"_comment": "x", "vocab_size": 100, "eval": {"seed": 1, "thresholds": {"bytes_per_token_min": 2.0}}, "merge": {"enabled": False}}))
    c = read_config(spark, str(path))
    assert (c.vocab_size, c.eval.seed, c.eval.thresholds.bytes_per_token_min, c.eval.thresholds.chars_per_token_max, c.merge.enabled) == (100, 1, 2.0, 6.0, False)
    assert Config().merge.target_bytes == 100 * 1024 * 1024
