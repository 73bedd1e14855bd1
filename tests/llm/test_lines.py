from collections import Counter

import pytest

from spindle.llm import op3_lines as op
from spindle.llm.queries import line_dedup
from spindle.llm.shared import BLANKS

from .edges import documents, empty


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def by_hand(rows, least):
    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or counts[key(x)] < least]
        yield doc, len(lines), len(lines) - len(kept), op.sha256("\n".join(kept))


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, line_dedup(spark, small).collect())) == Counter(by_hand(rows, 10))


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("batches", [1, 7])
def test_edges(spark, extra, batches):
    docs = documents(spark, extra=extra)
    got = op.deduplicated(docs, min_docs=3, batches=batches, fanout=2).collect()
    assert Counter((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], op.sha256(r["row"]["text"])) for r in got) == Counter(by_hand([(r.doc_id, r.text) for r in docs.collect()], 3))


def test_empty(spark):
    assert op.deduplicated(empty(spark)).collect() == []


def test_runs_are_levelled_and_keys_over_the_limit_stay_out_of_new_runs(spark):
    runs = op.LineRuns(spark, min_docs=2, fanout=3)
    batch = spark.createDataFrame([("hot\nown",), ("hot",)], "text string")
    for k in range(9):
        runs.add(batch if k == 0 else spark.createDataFrame([(f"hot\nline {k}",), ("Pair ",)], "text string"))
    assert [len(runs.levels[k]) for k in (0, 1, 2)] == [0, 0, 1] and op.merged_paths(runs) == 1
    held = {r.h1: r.n for r in runs._read(runs.paths()).collect()}
    assert held[op.python_hashes(b"hot")[0]] == 2
    assert held[op.python_hashes(b" PAIR")[0]] >= 2
    frequent = {r.h1 for r in runs.frequent().collect()}
    assert frequent == {op.python_hashes(b"hot")[0], op.python_hashes(b"pair")[0]}


def test_both_hash_functions_agree(spark):
    lines = ["A b", " \tÉcole ", "x\x0b", "ſ", "1"]
    df = spark.createDataFrame([("\n".join(lines),)], "text string")
    assert {tuple(r) for r in op.exploded(df).collect()} == {op.python_hashes(x.encode()) for x in lines}


def test_runs_meet_a_batch_without_moving_or_sorting_them(spark):
    runs = op.LineRuns(spark, min_docs=2, fanout=3)
    for k in range(2):
        runs.add(spark.createDataFrame([(f"hot\nline {k}\n{x}",) for x in range(40)], "text string"))
    with op.setting(spark, op.ORDERED, "true"), op.setting(spark, "spark.sql.adaptive.enabled", "false"):
        fresh = runs.fresh(op.exploded(spark.createDataFrame([("hot\nnew",)], "text string")))
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Bucketed: true") == 2 and plan.count("SortMergeJoin") == 2
        # only the batch itself moves, once to be counted, and is sorted
        assert plan.count("Exchange") == 1 and plan.count("Sort [") <= 2
        assert {r.h1 for r in fresh.collect()} == {op.python_hashes(b"new")[0]}
    assert {r.h1 for r in runs.fresh(op.exploded(spark.createDataFrame([("hot\nnew",)], "text string"))).collect()} == {op.python_hashes(b"new")[0]}


def test_rows_without_an_id(spark):
    rows = [(None, f"shared\nown {k % 50}", "en", "a", 1) for k in range(300)]
    got = op.deduplicated(documents(spark, rows), min_docs=10).collect()
    assert Counter((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], op.sha256(r["row"]["text"])) for r in got) == Counter(by_hand([r[:2] for r in rows], 10))


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from spindle.llm import shared

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
