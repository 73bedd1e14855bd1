"""Edge cases of the operators, after FIXTURES.md §3 and §4."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spindle.functions import text as T
from spindle.operators import budget, catalog, corpus, gates, metrics, sft, tokens


def values(df, *names):
    return [tuple(r) if len(names) != 1 else r[0] for r in df.select(*names).collect()]


def column(spark, data, f):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, x string")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


# --- text ---------------------------------------------------------------------------


def test_strip_is_unicode_aware(spark):
    texts = ["\t a\n", "　a　", "\x85a", "\xa0a\xa0", "\x1ca\x1f", "​a", "", " \n ", "a b"]
    assert column(spark, texts, T.py_strip) == [t.strip() for t in texts]


def test_marker_functions(spark):
    texts = ["<|endoftext|>a<|endoftext|><|endoftext|>b", "none", ""]
    assert column(spark, texts, lambda x: T.occurrences(x, T.EOT)) == [3, 0, 0]
    assert column(spark, texts, T.replace_eot) == [t.replace(T.EOT, "\n") for t in texts]


def test_path_forms(spark):
    paths = ["a\\data_x\\f.txt", "a/b/f.txt", "f.txt", "data_y/f", "x/data_z", "", None]
    assert column(spark, paths, lambda p: T.domain_of_path(p)) == ["data_x", "other", "other", "data_y", "data_z", "other", "other"]
    assert column(spark, ["a/b", ""], lambda p: T.domain_of_path(p, F.lit("fall"))) == ["fall", "fall"]
    assert column(spark, paths[1:5], T.parent_dir) == ["b", "", "data_y", "x"]
    assert column(spark, ["shard_00012.bin", "shard_x.bin", "other", "shard_123456.bin"], T.shard_index) == [12, -1, -1, 123456]
    assert column(spark, ["c++", "go"], T.language_tag) == ["cpp", "go"]


def test_worked_texts(spark):
    text = ["Problem: >>> solve(x + 1 = 2)\nAnswer: \\boxed{\\frac{-3}{4}} \n", "Problem: Compute \\(7 / -2\\).\nAnswer: 5", "no lines", "Problem: Solve 2 - 5 for x.\nAnswer:  a "]
    assert column(spark, text, T.declared_answer) == ["-3/4", "5", None, "a"]
    assert column(spark, text, lambda x: T.bare_problem(T.problem_line(x))) == ["x + 1 = 2", "7 / -2", None, "2 - 5"]
    problems = ["7 / -2", "-7 / 2", "8/4", "3 × -4", "5 − 9", "1 / 0", "x + 1", "2 + 2"]
    assert column(spark, problems, T.evaluated) == ["-4 remainder -1", "-4 remainder 1", "2", "-12", "-4", None, None, "4"]
    gates = ["fine", "bad ('+' here", "Step 1: Step 2: x", "Step 3: 4. y", "Step 1: x"]
    assert column(spark, gates, T.text_gate) == [True, False, False, False, True]


def test_arithmetic_of_any_length(spark):
    rng = random.Random(35)
    cases = {"8 \\div 3": "2 remainder 2", "-8 \\div 3": "-3 remainder 1", "6 \\times -7": "-42", "0 / -5": "0", "5 ÷ 0": None, f"{10**37} * 100": None}
    for _ in range(200):
        a, b = (rng.choice([-1, 1]) * rng.randrange(10 ** rng.randrange(1, 19)) for _ in range(2))
        cases[f"{a} + {b}"], cases[f"{a} - {b}"], cases[f"{a}*{b}"] = str(a + b), str(a - b), str(a * b)
        a = a * 10**18 + rng.randrange(10**18)
        if b:
            q, r = divmod(a, b)
            cases[f"{a}/{b}"] = f"{q} remainder {r}" if r else str(q)
    assert column(spark, list(cases), T.evaluated) == list(cases.values())
    assert column(spark, [f"shard_{7:025d}.bin", f"shard_{10**25}.bin"], T.shard_index) == [7, -1]


def test_judge_json(spark):
    answers = ['```json\n{"a": 3, "b": 9}\n```', '{"a": 5}', "nonsense", '```\n{"a": 0, "b": 1}```']
    assert [tuple(r) for r in column(spark, answers, lambda x: T.judge_scores(x, "a", "b"))] == [(3, None), (5, None), (None, None), (None, 1)]


def test_schedule(spark):
    df = spark.createDataFrame([(0,), (50,), (100,), (550,), (1000,), (5000,)], "s int")
    got = values(df.select(T.learning_rate(F.col("s"), F.lit(1000), 1.0, 0.1, 100).alias("v")), "v")
    assert got == pytest.approx([0, 0.5, 1, 0.55, 0.1, 0.1])


# --- corpus -------------------------------------------------------------------------


def test_length_bounds(spark):
    df = spark.createDataFrame([(n, "x" * n) for n in (0, 199, 200, 499, 500, 50_000, 50_001)] + [(-1, " " * 100 + "x" * 150), (-2, None)], "n int, text string")
    assert set(values(corpus.keep(df, [("s", corpus.too_short(F.col("text")))]), "n")) == {200, 499, 500, 50_000, 50_001}
    assert set(values(corpus.keep(df, [("r", corpus.outside(F.col("text")))]), "n")) == {-1, 200, 499, 500, 50_000}
    titled = corpus.titled(df.withColumn("title", F.when(F.col("n") == 500, "T").otherwise("")))
    assert {n: len(t) for n, t in values(titled, "n", "text")} == {500: 503, 50_000: 50_000, 50_001: 50_001}


def test_rules_in_order_and_null_scores(spark):
    df = spark.createDataFrame([(None, "x" * 300), (0.49, "x" * 300), (0.5, "x" * 300), (0.51, ""), (0.1, "")], "score double, text string")
    rules = [("low_score", corpus.low_score(F.col("score"))), ("short", corpus.too_short(F.col("text")))]
    assert dict(values(corpus.drop_counts(df, rules), "reason", "count")) == {"kept": 2, "low_score": 2, "short": 1}
    assert sorted(values(corpus.keep(df, rules), "score"), key=str) == [0.5, None]


def test_documents_between_markers(spark):
    text = f"{T.EOT}a{T.EOT}{T.EOT} \n {T.EOT}b in{T.EOT}side{T.EOT}"
    df = spark.createDataFrame([("f", text)], "file string, content string")
    assert values(corpus.documents_of(df), "part", "text") == [(1, "a"), (4, "b in"), (5, "side")]


def test_numbering_a_large_group(spark):
    df = spark.range(10_000).select((F.col("id") * 7 - 30_000).alias("p"), F.lit("g").alias("g"))
    got = corpus.numbered(df, ["g"], "p", block=512)
    assert values(got.where("nr * 7 - 30000 <> p"), "p") == [] and got.count() == 10_000


def test_numbering_sparse_positions(spark):
    df = spark.range(3000).select((F.col("id") * F.col("id") * 1_000_003).alias("p"), F.pmod("id", F.lit(3)).alias("g"))
    got = corpus.numbered(df, ["g"], "p", block=100).select("g", "p", "nr").collect()
    for g in range(3):
        assert [r.nr for r in sorted((r for r in got if r.g == g), key=lambda r: r.p)] == list(range(1000))


def test_first_of_equal_rows(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (5, "b")], "pos int, k string")
    assert sorted(values(corpus.first_of_each(df, ["k"], ["pos"]), "pos")) == [1, 2]


# --- greedy cuts --------------------------------------------------------------------


def test_seen_passes_go_from_random_plans(spark):
    """Many plans at once, each with a bag of seen passes, against counting by hand."""
    rng = random.Random(31)
    rows, bags, expected = [], [], Counter()
    for case in range(60):
        names = [f"c{case}-{rng.randrange(6)}" for _ in range(rng.randrange(15))]
        seen = [f"c{case}-{rng.randrange(7)}" for _ in range(rng.randrange(12))]
        rows += [(1000 * case + 7 * at, name) for at, name in enumerate(names)]
        bags += [(name,) for name in seen]
        still = Counter(seen)
        for at, name in enumerate(names):
            if still[name]:
                still[name] -= 1
            else:
                expected[1000 * case + 7 * at, name] += 1
    got = budget.minus_seen(spark.createDataFrame(rows, "pos int, shard string"), spark.createDataFrame(bags, "shard string"))
    assert Counter(values(got, "pos", "shard")) == expected


def test_trims_of_random_tables(spark):
    rng = random.Random(32)
    for _ in range(6):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 60))]
        wanted = rng.choice([0, 1, sum(sizes) // 2, sum(sizes), sum(sizes) + 5])
        df = spark.createDataFrame(list(enumerate(sizes)), "id int, tokens int").withColumn("o", T.seeded_order(3, "id"))
        total, taken = 0, []
        for r in df.orderBy("o").collect():
            if total < wanted:
                taken.append(r.id)
                total += r.tokens
        assert sorted(values(budget.trimmed(df, "o", "tokens", wanted), "id")) == sorted(taken)


def test_need():
    assert budget.need(10, 10, 5) == 0 and budget.need(10, 12, 5) == 0 and budget.need(20, 0, 10) == 210


def cut_by_hand(sizes, target):
    out, bucket, total = [], 0, 0
    for s in sizes:
        out.append(bucket)
        total += s
        if total >= target:
            bucket, total = bucket + 1, 0
    return out


@pytest.mark.parametrize("sizes", [[500], [100, 100, 100], [99, 1, 50], [30, 30, 30, 30, 30, 30, 200, 1], [1]])
@pytest.mark.parametrize("f", [budget.cut_with_reset, budget.cut_with_reset_folded])
def test_cut_with_reset(spark, sizes, f):
    df = spark.createDataFrame([(d, i, s) for d in ("x", "y") for i, s in enumerate(sizes)], "domain string, pos long, bytes long")
    got = f(df, "domain", "pos", "bytes", 100)
    for d in ("x", "y"):
        assert values(got.where(F.col("domain") == d).orderBy("pos"), "bucket") == cut_by_hand(sizes, 100)


def test_cut_of_no_rows(spark):
    assert budget.cut_with_reset(spark.createDataFrame([], "domain string, pos long, bytes long"), "domain", "pos", "bytes", 5).count() == 0


def test_budgets(spark):
    rows = [(d, f"{i:03x}", 10, b) for d, b in (("none", 0), ("some", 25), ("all", 1000)) for i in range(5)]
    df = spark.createDataFrame(rows, "domain string, o string, tokens int, budget int")
    got = budget.within_budget(df, ["domain"], "o", "tokens", F.col("budget"))
    assert dict(values(got.groupBy("domain").count(), "domain", "count")) == {"some": 3, "all": 5}


@pytest.mark.parametrize(("n", "k"), [(0, 0), (1, 0), (2, 1), (49, 2), (50, 2), (300, 15)])
def test_held_out_counts(spark, n, k):
    df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("name"))
    assert budget.held_out(df, ["g"], "name", 0.05, 3).where("held").count() == k
    assert budget.held_out(df, ["g"], "name", 0.05, 3, cap=5).where("held").count() == min(k, 5)


# --- catalogue ----------------------------------------------------------------------

REF = "struct<shard:string,source:string,tokens:long>"


def merged(spark, rows):
    return spark.createDataFrame(rows, f"shard string, source string, domain string, tokens long, documents long, shard_mb double, merged_from array<{REF}>")


def inputs(spark, rows):
    return spark.createDataFrame([(i, s, f"c/{d}/{s}.txt", d, t, 1) for i, (s, d, t) in enumerate(rows)], "pos long, shard string, source string, domain string, tokens long, documents long")


@pytest.mark.parametrize(
    ("refs", "now", "problem"),
    [
        ([("m0", "x", [("a", 5)])], [("a", "x", 5), ("a", "x", 5)], "duplicate_input"),
        ([("m0", "x", [])], [("a", "x", 5)], "no_refs"),
        ([("m0", "x", [("a", 5)]), ("m1", "x", [("a", 5)])], [("a", "x", 5)], "double_claim"),
        ([("m0", "x", [("a", 5)])], [("b", "x", 5)], "removed"),
        ([("m0", "x", [("a", 5)])], [("a", "x", 6)], "retokenized"),
        ([("m0", "x", [("a", 5)])], [("a", "y", 5)], "moved"),
    ],
)
def test_divergence(spark, refs, now, problem):
    m = merged(spark, [(n, "s", d, 5, 1, 0.0, [(s, "f", t) for s, t in r]) for n, d, r in refs])
    s = inputs(spark, now)
    assert set(values(catalog.divergences(m, s), "problem")) == {problem}
    with pytest.raises(ValueError, match=problem):
        catalog.incremental_plan(m, s, 10)


def test_incremental_plan_goes_on_after_the_last_number(spark):
    s = inputs(spark, [(f"shard_{i:05d}.bin", "xy"[i % 2], 3) for i in (4, 1, 2, 3, 0)])
    first = catalog.merged_entries(catalog.merge_plan(s.where("shard = 'shard_00004.bin'"), 6, width=1))
    got = catalog.incremental_plan(first, s, 6, width=1).orderBy("merged_index", "place")
    # the manifest names y's remaining shards first (1), then x's (2)
    assert values(got, "merged_index", "domain", "shard") == [(1, "y", "shard_00001.bin"), (1, "y", "shard_00003.bin"), (2, "x", "shard_00000.bin"), (2, "x", "shard_00002.bin")]


def test_merged_ids_in_order(spark):
    s = inputs(spark, [("a", "x", 2), ("b", "x", 2), ("c", "x", 1)])
    p = catalog.merge_plan(s, 4, width=1)
    ids = spark.createDataFrame([("a", [1, 2]), ("b", [3, 4]), ("c", [5])], "shard string, ids array<int>")
    assert values(catalog.merged_ids(p, ids).orderBy("merged_shard"), "ids") == [[1, 2, 3, 4], [5]]


def test_manifest_faults_and_gate(spark):
    s = spark.createDataFrame(
        [(0, "a", "d/x.txt", "h", 10, 5, 1), (1, "a", "d/y.txt", "h", 10, 5, 1), (2, "b", "d/y.txt", "h", 10, -1, 1), (3, "c", "bare.txt", "h", 1, 7, 1), (4, "e", "d/e.txt", "h", 90, 9, 1)],
        "pos long, shard string, source string, source_hash string, source_size long, tokens long, documents long",
    )
    disk = spark.createDataFrame([("a", 10), ("b", 3), ("c", 14), ("stray", 2)], "name string, size long")
    found = catalog.issues(s, disk)
    kinds = dict(values(found.groupBy("check").count(), "check", "count"))
    assert kinds == {"duplicate_shard": 1, "duplicate_source": 1, "no_domain": 1, "missing_file": 1, "orphan_file": 1, "misaligned": 1, "wrong_size": 1, "oversize": 1, "negative_tokens": 1}
    with pytest.raises(ValueError, match="duplicate_shard"):
        catalog.gate(found)
    catalog.gate(found.where("check = 'misaligned'"))


def test_merge_runs(spark):
    s = inputs(spark, [(f"shard_{i:05d}.bin", "xy"[i % 2], 3 + i) for i in range(9)]).withColumns({"source_size": F.lit(5), "source_hash": F.lit("h")})
    disk = s.select(F.col("shard").alias("name"))
    first = s.where("pos < 6")
    action, plan, state = gates.merge_run(first, "id", 20, disk)
    done = catalog.merged_entries(plan)
    assert action == "rebuild" and plan.count() == 6 and state["merge_target_bytes"] == 20
    assert gates.merge_run(first, "id", 20, disk, done, state) == ("nothing", None, state)
    action, plan, new = gates.merge_run(s, "id", 20, disk.where("name >= 'shard_00006'"), done, state)  # what is merged needn't be there
    assert action == "extend" and sorted(values(plan, "pos")) == [6, 7, 8] and new["merge_fingerprint"] != state["merge_fingerprint"]
    assert gates.merge_run(s, "id", 20, disk, done, state, dry_run=True)[::2] == ("dry extend", state)
    for more, problem in (({"identity": "other"}, "tokenization_id mismatch"), ({"target": 30}, "merge_target_bytes mismatch"), ({"listing": disk.where("name < 'shard_00007'")}, "not on disk: shard_00007.bin, shard_00008.bin")):
        with pytest.raises(ValueError, match=problem):
            gates.merge_run(**{"shards": s, "identity": "id", "target": 20, "listing": disk, "merged": done, "state": state} | more)
    assert gates.merge_run(s, "other", 30, disk, done, state, rebuild=True)[0] == "rebuild"


def test_id_ranges(spark):
    for n, last, faults in ((256, 255, []), (3, 256, ["max_id"]), (257, 256, ["vocab_size", "max_id"])):
        ids = spark.range(n - 1).select("id").unionAll(spark.createDataFrame([(last,)], "id long"))
        assert values(gates.id_range_faults(ids, "uint8"), "fault") == faults


def test_meta_that_agrees_has_no_fault(spark):
    s = spark.createDataFrame([("a", 3), ("b", 4)], "shard string, tokens long")
    m = catalog.meta(s, 10, 0, 1, "t", "uint16", "id")
    assert gates.meta_faults(s, m, "id", "id").count() == 0
    assert sorted(values(gates.meta_faults(s.limit(1), m, None, "other"), "fault")) == ["manifest identity", "meta identity", "num_shards", "num_tokens"]


def test_identity():
    catalog.same_identity("a", "a")
    for ids in (("a", "b"), ("a", None)):
        with pytest.raises(ValueError, match="identities"):
            catalog.same_identity(*ids)


def test_strict_recheck(spark):
    cols = "d string, f string, source_size long, source_hash string"
    old = spark.createDataFrame([("x", "a", 5, "h"), ("x", "b", 5, "h")], cols)
    new = spark.createDataFrame([("x", "a", 5, "other"), ("x", "b", 6, "h"), ("x", "c", 1, "h")], cols)
    assert sorted(values(catalog.classified(new, old, ["d", "f"]), "f", "action")) == [("a", "skip"), ("b", "recheck"), ("c", "new")]
    assert dict(values(catalog.classified(new, old, ["d", "f"], strict=True), "f", "action"))["a"] == "recheck"


def test_shards_without_parts_stand_for_themselves(spark):
    m = merged(spark, [("m", "c/data_x/s.txt", "data_x", 5, 1, 0.0, [])])
    none = m.limit(0)
    mix = spark.createDataFrame([], "domain string, weight double")
    domains = spark.createDataFrame([], "domain string, passes long, tokens long")
    r = catalog.provenance(m, none, none, mix, domains).first()
    assert (r.source_shard, r.source_domain, r.selected_for_training, r.training_weight) == ("m", "data_x", "no", None)


# --- tokens and windows --------------------------------------------------------------


@pytest.mark.parametrize(("n", "k"), [(0, 0), (10, 0), (11, 0), (20, 0), (21, 1), (22, 1), (31, 2)])
def test_windows(spark, n, k):
    df = spark.createDataFrame([("s", list(range(n)))], "shard string, ids array<int>")
    got = values(tokens.training_windows(df, 10, 10).orderBy("win"), "x", "y")
    assert len(got) == k == max(0, (n - 11) // 10)
    for w, (x, y) in enumerate(got):
        assert x == list(range(w * 10, w * 10 + 10)) and y == list(range(w * 10 + 1, w * 10 + 11))


def test_random_windows_are_seeded_and_inside(spark):
    df = spark.createDataFrame([("s", list(range(100))), ("short", [1, 2])], "shard string, ids array<int>")
    a, b = (values(tokens.random_windows(df, 10, 5, 3), "shard", "start", "x") for _ in range(2))
    assert a == b and len(a) == 5 and all(x == list(range(s, s + 10)) for _, s, x in a)


def test_toy_merges(spark, tmp_path):
    import base64

    toy = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc"]
    path = tmp_path / "toy.ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(toy)))
    ranks = tokens.rank_file(str(path))
    assert tokens.merge(b"abcb", ranks) == [258, ord("b")] and tokens.merge(b"bcab", ranks) == [257, 256]
    df = spark.createDataFrame([(1, "abc<|im_end|>7"), (2, None), (3, "")], "doc_id long, text string")
    ids = {r.doc_id: r.ids for r in tokens.encode(df, str(path)).collect()}
    assert ids == {1: [258 + 256, 3, ord("7") + 256, 0], 2: [0], 3: [0]}
    assert values(tokens.decode(tokens.encode(df, str(path)), str(path)).orderBy("doc_id"), "text") == ["abc7", "", ""]
    table = tokens.vocabulary_table(spark, str(path))
    assert table.count() == 259 + 256 and bytes(table.where("id = 512").first().token) == b"ab"


def test_encoding_matches_the_rank_library(spark, small):
    import tiktoken

    from spindle.plans.training import vocabulary

    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    library = tiktoken.Encoding("own", pat_str=tokens.PRE_TOKEN.removeprefix("(?U)"), mergeable_ranks=tokens.rank_file(vocabulary()), special_tokens={})
    got = {r.doc_id: r.ids for r in tokens.encode(docs, vocabulary()).collect()}
    import regex

    pieces, ranks = regex.compile(tokens.PRE_TOKEN.removeprefix("(?U)")), tokens.rank_file(vocabulary())
    for r in docs.collect():
        assert got[r.doc_id] == [i + 256 for i in library.encode_ordinary(r.text)] + [0]
        assert got[r.doc_id][:-1] == [i + 256 for p in pieces.findall(r.text) for i in tokens.merge(p.encode(), ranks)]


def test_pre_tokens_lose_nothing(spark):
    texts = ["don't  stop 12½³ ٣", "a\r\n b　c\x1c", "  lead", "trail  ", "x!?? y", ""]
    assert column(spark, texts, lambda x: F.array_join(tokens.pre_tokens(x), "")) == texts
    assert column(spark, ["ab 12"], tokens.pre_tokens) == [["ab", " ", "1", "2"]]


def test_tokenizer_gate(spark):
    good = spark.createDataFrame([("word " * 4, list(range(300, 305)))], "text string, ids array<int>")
    assert tokens.tokenizer_gate(good).first().failures == ["top_token_share"]
    bad = spark.createDataFrame([("ab", [300, 300])], "text string, ids array<int>")
    gate = tokens.tokenizer_gate(bad)
    assert set(gate.first().failures) == {"chars_per_token_low", "bytes_per_token_low", "top_token_share"}
    with pytest.raises(ValueError, match="chars_per_token_low"):
        tokens.raise_on_failure(gate)


def test_response_losses(spark):
    df = spark.createDataFrame([("a", p, float(p), 3) for p in range(5)], "k string, pos int, loss double, prefix_len int")
    assert tokens.response_perplexity(df, "k").first().perplexity == pytest.approx(math.exp(3.0))


# --- instruction rows ---------------------------------------------------------------


def test_adapter_and_length(spark):
    rows = [(0, " a ", "", "b"), (1, "", "x", "long enough"), (2, "instr", None, "output"), (3, "instr", None, " output "), (4, "1234", "", "56789"), (5, "1234", "", "567890")]
    df = spark.createDataFrame(rows, "pos long, instruction string, input string, output string")
    assert sorted(values(sft.prepared(df), "pos")) == [2, 5]


@pytest.mark.parametrize(("p", "r", "end", "reason"), [(5, 2, True, "short_response"), (5, 3, True, None), (9, 3, False, "truncation_lost_eos"), (10, 3, True, "prompt_too_long"), (7, 4, True, None), (8, 4, False, "truncation_lost_eos")])
def test_cut_rules(spark, p, r, end, reason):
    ids = list(range(1, r)) + [0]
    df = spark.createDataFrame([([7] * p, ids)], "prompt_ids array<int>, response_ids array<int>")
    got = sft.cut_rows(df, 10, 0).first()
    assert got.reason == reason and got.prefix_len == p and len(got.input_ids) == min(p + r, 11)


def test_split_takes_at_least_one(spark):
    for n in (1, 19, 40):
        df = spark.range(n).withColumnRenamed("id", "pos")
        assert sft.split(df, 0.05, 1, "pos").where("part = 'val'").count() == max(1, int(n * 0.05))


# --- metrics ------------------------------------------------------------------------


def test_index_percentiles(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 9, 3)] + [("b", 7)], "g string, v int")
    got = {r.g: (r.p50, r.p95, r.p99, r.max, r["mean"]) for r in metrics.length_stats(df, ["g"], "v").collect()}
    assert got == {"a": (5, 9, 9, 9, 4.5), "b": (7, 7, 7, 7, 7.0)}


def test_window_means_of_random_lengths(spark):
    rng = random.Random(33)
    rows = [(g, i, rng.uniform(-5, 5)) for g in range(12) for i in range(rng.randrange(1, 200))]
    got = {(r.g, r.window): (r["mean"], r.present) for r in metrics.window_means(spark.createDataFrame(rows, "g int, i int, x double"), ["g"], "i", "x", 50).collect()}
    own = defaultdict(list)
    for g, i, x in rows:
        own[g, i // 50].append(x)
    assert got == {k: (pytest.approx(sum(v) / len(v)), len(v)) for k, v in own.items()}


def test_ranks_of_random_groups(spark):
    rng = random.Random(34)
    rows = [(g, v) for g in range(6) for v in [rng.choice([rng.expovariate(0.01), rng.randrange(4), float("inf"), -1e300]) for _ in range(rng.randrange(1, 900))]]
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p999": 0.999, "p100": 1.0}
    got = {r.g: r for r in budget.at_rank(spark.createDataFrame([(g, float(v)) for g, v in rows], "g int, v double"), ["g"], "v", wanted).collect()}
    for g in range(6):
        own = sorted(v for k, v in rows if k == g)
        assert [got[g][name] for name in wanted] == [own[min(len(own) - 1, int(q * len(own)))] for q in wanted.values()]


@pytest.fixture
def many_parts(spark):
    """Shuffles of many parts, which branches of a plan read in different groups, as on large tables."""
    adaptive = "spark.sql.adaptive."
    put = {"spark.sql.shuffle.partitions": "100", f"{adaptive}coalescePartitions.parallelismFirst": "false", f"{adaptive}coalescePartitions.minPartitionSize": "1k", f"{adaptive}advisoryPartitionSizeInBytes": "200k"}
    before = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def drawn(spark, groups, n, draw):
    """(g, v) of a group each: n random values, and the same as lists in order."""
    rng = random.Random(35)
    own = {g: [draw(rng) for _ in range(n)] for g in groups}
    df = spark.createDataFrame([(g, v) for g in groups for v in own[g]], f"g string, v {'double' if isinstance(own[groups[0]][0], float) else 'long'}")
    return df.repartition(16), {g: sorted(v) for g, v in own.items()}


def test_length_stats_of_many_parts(spark, many_parts):
    df, own = drawn(spark, ["a", "b", "c"], 40_000, lambda rng: int(rng.lognormvariate(9, 1.5)))
    at = lambda v, q: v[min(len(v) - 1, int(q * len(v)))]
    got = {r.g: (r.p50, r.p95, r.p99, r.max) for r in metrics.length_stats(df, ["g"], "v").collect()}
    assert got == {g: (at(v, 0.5), at(v, 0.95), at(v, 0.99), v[-1]) for g, v in own.items()}


def test_medians_of_many_parts(spark, many_parts):
    df, own = drawn(spark, ["a", "b", "c"], 40_000, lambda rng: rng.expovariate(0.02))
    got = {r.g: r.median for r in metrics.medians(df, "g", "v").collect()}
    assert got == {g: v[len(v) // 2] for g, v in own.items()}


def test_tensor_stats_of_many_parts(spark, many_parts):
    df, own = drawn(spark, ["a", "b", "c"], 40_000, lambda rng: rng.gauss(0, 0.125))
    long = df.select(F.col("g").alias("name"), F.lit(0).alias("t"), F.lit(0).alias("h"), F.col("v").alias("x"))
    got = {r.name: (r.numel, r.p99_abs, r.p999_abs) for r in metrics.tensor_stats(long).collect()}
    own = {g: sorted(map(abs, v)) for g, v in own.items()}
    assert got == {g: (len(v), pytest.approx(v[int(0.99 * len(v))], abs=1e-6), pytest.approx(v[int(0.999 * len(v))], abs=1e-6)) for g, v in own.items()}


@pytest.fixture(params=["-1", "10m"])
def sorted_and_broadcast(spark, request):
    """Joins by sorting, and by broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ranks_with_nulls(spark, sorted_and_broadcast):
    """As the SQL has them: nulls count and come last, and a group's key may be null."""
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 5), ("b", None), (None, 2), (None, 4), (None, 8), ("c", None), ("c", None), ("c", 3)], "g string, v long")
    assert {r.g: r.median for r in metrics.medians(df, "g", "v").collect()} == {"a": 5, "b": None, None: 4, "c": None}
    assert {r.g: (r.p50, r.p99, r.max, r["mean"]) for r in metrics.length_stats(df, ["g"], "v").collect()} == {"a": (5, None, 5, 3.0), "b": (None,) * 4, None: (4, 8, 8, 4.7), "c": (None, None, 3, 3.0)}
    two = df.select(F.lit(1).alias("k"), "g", "v")
    assert {(r.k, r.g): r.p for r in budget.at_rank(two, ["k", "g"], "v", {"p": 0.0}).collect()} == {(1, "a"): 1, (1, "b"): None, (1, None): 2, (1, "c"): 3}


def test_tensor_without_name(spark):
    df = spark.createDataFrame([(None, 0, h, float(h)) for h in range(1, 5)] + [("one", 0, 0, -2.0)], "name string, t int, h int, x double")
    assert {r.name: (r.numel, r.p99_abs) for r in metrics.tensor_stats(df).collect()} == {None: (4, 4.0), "one": (1, 2.0)}


def test_outlier_verdict(spark):
    """Three blocks: two with their greatest value early and in one channel, one late."""
    rows = [(f"block_{b:02d}", t, h, 1.0) for b in range(3) for t in range(140) for h in range(4)]
    spikes = {("block_00", 2, 1): 90.0, ("block_01", 5, 1): -80.0, ("block_02", 135, 3): 70.0}
    long = spark.createDataFrame([(n, t, h, spikes.get((n, t, h), x)) for n, t, h, x in rows], "name string, t int, h int, x double")
    places = {r.name: r for r in metrics.block_places(long).collect()}
    assert [(places[n].max_position, places[n].max_channel, places[n].max_value, places[n].channel) for n in sorted(places)] == [(2, 1, 90, 1), (5, 1, 80, 1), (135, 3, 70, 3)]
    v = metrics.outlier_verdict(metrics.block_places(long)).first()
    assert (v.blocks, v.early_fraction, v.top_channel, v.top_blocks, v.early_leads, v.fixed_channel) == (3, pytest.approx(2 / 3), 1, 2, True, True)
    late = metrics.outlier_verdict(metrics.block_places(long.where("name = 'block_02'"))).first()
    assert (late.early_fraction, late.early_leads, late.fixed_channel) == (0, False, True)


def test_constant_tensors(spark):
    df = spark.createDataFrame([("zero", 0, h, 0.0) for h in range(4)] + [("one", 0, 0, -2.0)], "name string, t int, h int, x double")
    got = {r.name: r for r in metrics.tensor_stats(df).collect()}
    assert got["zero"].max_over_rms == math.inf and got["zero"].rms == 0
    assert (got["one"].rms, got["one"].p999_abs, got["one"].max_over_rms) == (2.0, 2.0, 1.0)
    assert values(metrics.outliers(metrics.tensor_stats(df), 1), "name") == ["zero"]


def test_non_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "x double")
    assert metrics.non_finite(df, "x").first()[0] == 3


def test_repetition(spark):
    df = spark.createDataFrame([(0, "a b a b a b"), (1, "a b"), (2, ""), (3, "a b c d")], "i int, text string")
    assert values(metrics.with_repetition(df, 3).orderBy("i"), "repetition") == pytest.approx([0.5, 0, 0, 0])


def test_logits(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -1.0],)], "v array<double>")
    r = df.select(metrics.top_k(F.col("v"), 2).alias("k"), metrics.softmax(F.col("v")).alias("p"), metrics.penalised(F.col("v"), F.array(F.lit(1), F.lit(3)), 2.0).alias("q")).withColumn("n", metrics.nucleus(F.col("p"), 0.5)).first()
    assert [(x.value, x.id) for x in r.k] == [(3.0, 1), (3.0, 2)] and sum(r.p) == pytest.approx(1) and r.q == [1.0, 1.5, 3.0, -2.0] and r.n == [1, 2]


def test_gap_of_separate_groups(spark):
    df = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "a", [2.0, 0.0]), (2, "b", [0.0, 1.0]), (3, "b", [0.0, 5.0])], "i int, l string, v array<double>")
    r = metrics.group_gap(df, "l", "v").first()
    assert (r.within, r.across, r.label) == (pytest.approx(1), pytest.approx(0), "good")


def test_cleaned_weight_names(spark):
    stored = spark.createDataFrame([("_orig_mod.a", "2x2"), ("b", "3"), ("c", "1")], "name string, shape string")
    wanted = spark.createDataFrame([("a", "2x2"), ("b", "4")], "name string, shape string")
    assert values(metrics.matching_weights(stored, wanted), "name") == ["a"]


def test_iso_and_json(spark):
    df = spark.sql("SELECT timestamp'2024-02-03 04:05:06' AS t, 'ü\"x' AS s, CAST(NULL AS INT) AS n")
    r = df.select(T.iso(F.col("t")).alias("t"), T.json_line("s", "n").alias("j")).first()
    assert r.t == "2024-02-03T04:05:06" and r.j == '{"s":"ü\\"x","n":null}'
