import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spindle.llm import op6_rules as op
from spindle.llm.queries import rules
from spindle.llm.shared import BLANKS

from .edges import documents, empty


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_whole_table(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = rules(spark, small).collect()
    assert Counter((r.doc_id, *(r[c] for c in BASE)) for r in got) == Counter((d, *by_hand(t)) for d, t in rows)


def verdicts_by_hand(rows):
    """(doc_id, lines_removed, chars_removed, kept) of (doc_id, text, source), by counting."""
    rows = [(d, t or "", s or "") for d, t, s in rows]
    plain = lambda t: [re.sub("[1-9]", "0", x.lower()).strip(BLANKS) for x in t.split("\n")]
    holders = defaultdict(set)
    for _, t, s in rows:
        for line in filter(None, plain(t)):
            holders[s, line].add(t)
    for d, t, s in rows:
        gone = [x for x in plain(t) if len(holders.get((s, x), ())) >= 10]
        size = sum(len(x) + 1 for x in gone)
        yield d, len(gone), size, not by_hand(t)[-1] and not len(t) - size < 0.7 * len(t)


VERDICT = ("doc_id", "lines_removed", "chars_removed", "kept")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_verdicts_of_a_whole_table(spark, small, sf):
    place = small.replace("sf0.001", sf)
    rows = spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "text", "source").collect()
    assert Counter(tuple(r[c] for c in VERDICT) for r in rules(spark, place).collect()) == Counter(verdicts_by_hand(rows))


def test_the_verdict_rejects_what_the_base_rules_pass(spark, small):
    got = rules(spark, small.replace("sf0.001", "sf0.1")).where("not base_failed").collect()
    assert 0 < sum(not r.kept for r in got) < 0.01 * len(got)


def test_the_limit_does_not_grow_with_the_host(spark):
    notice = " ".join(f"shared{i}" for i in range(60))
    rows = [(k, notice + f"\nown {k}", "en", "h", 1) for k in range(10)]
    more = [(k, " ".join(f"w{k}x{i}" for i in range(60)), "en", "h", 1) for k in range(100, 15000)]
    for table in (rows, rows + more):
        got = op.quality(documents(spark, table)).where("doc_id < 10").collect()
        assert len(got) == 10 and not any(r.kept or r.base_failed for r in got)


def test_clean_documents_stay(spark, small):
    place = small.replace("sf0.001", "sf0.01")
    good = {r.doc_id for r in spark.read.parquet(f"{place}/labels.parquet").where("quality = 1").collect()}
    got = [r for r in rules(spark, place).collect() if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in got) > 0.99 * len(got)


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    docs = documents(spark, extra=extra)
    got = op.quality(docs).collect()
    assert Counter((r.doc_id, *(r[c] for c in BASE)) for r in got) == Counter((r.doc_id, *by_hand(r.text)) for r in docs.collect())
    assert Counter(tuple(r[c] for c in VERDICT) for r in got) == Counter(verdicts_by_hand([(r.doc_id, r.text, r.source) for r in docs.collect()]))
    assert op.quality(empty(spark)).collect() == []


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    filler = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    notice = "Page 1 of this site is brought to you by " + filler(0, 60)
    rows = [(k, f"{notice.replace('1', str(k % 10))}\n{filler(k, 20)}", "en", "h", 1) for k in range(1, 13)]
    rows += [(k, f"{notice}\n{filler(k, 200)}", "en", "h", 1) for k in range(20, 23)]
    rows += [(40, f"{notice}\n{filler(40, 20)}", "en", "elsewhere", 1)]
    got = {r.doc_id: r for r in op.quality(documents(spark, rows)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(not got[k].kept and got[k].lines_removed == 1 for k in range(1, 13))
    assert all(got[k].kept and got[k].lines_removed == 1 for k in range(20, 23))
    assert got[40].kept and got[40].lines_removed == 0


def test_exact_copies_count_as_one_text(spark):
    text = "the same line here\n" + " ".join(f"v{i}" for i in range(60))
    got = op.quality(documents(spark, [(k, text, "en", "h", 1) for k in range(50)])).collect()
    assert len(got) == 50 and all(r.kept and r.lines_removed == 0 for r in got)


def test_nothing_but_sql_operators(spark, small):
    plan = rules(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_repeats_by_words(spark):
    df = spark.createDataFrame([("a b c a b c",), ("a a a a",), ("a b",), ("a b c d a b x a b c",)], "text string")
    got = [r.n for r in df.select(op.repeated_words(F.split("text", " ")).alias("n")).collect()]
    assert got == [6, 4, 0, 6]
