import hashlib

import numpy as np
import pytest

from spindle.llm import op5_fingerprints as op
from spindle.llm.queries import fingerprints

from .edges import documents, empty


def by_hand(rows):
    """rows with distinct ids: (doc_id, n_chars, edited, exact likenesses)."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: -r[0])
    for (d, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        new = t[: len(t) - half] + u[:half]
        a, b, c = (set(op.digests(x).tolist()) for x in (t, new, u))
        yield d, (len(t), hashlib.sha256(new.encode()).hexdigest(), len(a & b) / len(a | b), len(a & c) / len(a | c))


def held(got, rows):
    expected = dict(by_hand(rows))
    assert len(got) == len(expected)
    for r in got:
        n, digest, edited, following = expected[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        assert r.near_edited == pytest.approx(edited) and r.near_next == pytest.approx(following)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, small, sf):
    place = small.replace("sf0.001", sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "text").collect()]
    got = fingerprints(spark, place).collect()
    held(got, rows)
    texts = dict(rows)
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) > 0.99 * len(by_text)
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got]) + 0.2


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_any_number_of_ranges(spark, ranges):
    rows = [(k * k, f"text {k}\nshared\n" + "word " * (k % 40)) for k in range(120)]
    held(op.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), ranges=ranges).collect(), rows)


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    docs = documents(spark, extra=extra)
    got = op.fingerprints(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == sorted((r.doc_id is None, r.doc_id or 0, len(r.text or "")) for r in docs.collect())
    assert op.fingerprints(empty(spark)).collect() == []


def test_a_single_row_is_its_own_next(spark):
    r = op.fingerprints(spark.createDataFrame([(5, "abc")], "doc_id long, text string")).collect()[0]
    assert r.near_next == 1 and r.edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    nothing = op.fingerprints(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()[0]
    assert nothing.near_next == nothing.near_edited == 1 and nothing.n_chars == 0


@pytest.mark.parametrize("size", [0, 1, 5, 60, 2000])
def test_peeling_recovers_the_difference(size):
    rng = np.random.default_rng(size)
    common, a, b = (rng.integers(1, 2**63, n).astype(np.uint64) for n in (500, size, size // 2))
    left, right = op.difference(np.concatenate([common, a]), np.concatenate([b, common]))
    assert set(left.tolist()) == set(a.tolist()) and set(right.tolist()) == set(b.tolist())


def test_small_tables_get_stuck_and_say_so():
    keys = np.arange(1, 200, dtype=np.uint64)
    assert op.Sketch.of(keys, 18).peel() is None
    left, right = op.Sketch.of(keys[:3], 18).minus(op.Sketch.of(keys[2:4], 18)).peel()
    assert (sorted(left.tolist()), sorted(right.tolist())) == ([1, 2], [4])


def test_repeated_paragraphs_are_told_apart():
    assert len(set(op.digests("same\nsame\nsame").tolist())) == 3
    assert op.likeness(op.digests("a\nb\nb"), op.digests("a\nb")) == pytest.approx(2 / 3)


def test_a_change_in_a_long_line_leaves_its_other_blocks():
    rng = np.random.default_rng(12)
    line = "".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) + (", " if rng.random() < 0.2 else " ") for _ in range(600))
    at = len(line) // 2
    for changed in (line[:at] + "X" + line[at:], "X" + line, line[:at] + line[at + 1 :]):
        assert 0.8 < op.likeness(op.digests(line), op.digests(changed)) < 1
    for odd in (line, "x" * 5000, "a" * op.MOST + ". ", "a" * (op.BLOCK + 1), "\r" * 300, line[: op.BLOCK]):
        assert "".join(op.paragraphs(odd)) == odd and max(map(len, op.paragraphs(odd))) <= op.MOST + 2


def test_kept_fingerprints_are_compared_without_the_texts(spark):
    first = "\n".join(f"paragraph {k}" for k in range(400))
    second = first.replace("paragraph 7\n", "paragraph seven\n").replace("paragraph 300\n", "")
    rows = op.fingerprints(spark.createDataFrame([(1, first), (2, second), (3, first)], "doc_id long, text string")).collect()
    kept = {r.doc_id: r.fingerprint for r in rows}
    left, right = op.compare(kept[1], kept[2])
    assert set(left.tolist()) == set(op.digests(first).tolist()) - set(op.digests(second).tolist()) and len(left) == 2
    assert set(right.tolist()) == set(op.digests(second).tolist()) - set(op.digests(first).tolist()) and len(right) == 1
    assert [len(x) for x in op.compare(kept[1], kept[3])] == [0, 0]
    assert op.compare(kept[1], op.Sketch.of(op.digests("\n".join(f"other {k}" for k in range(400)))).text()) is None


def figures_by_hand(text):
    """The edited half of a version by plain sets of numbered paragraphs, without any digest."""
    seen, out = {}, set()
    for line in text.split("\n"):
        seen[line] = seen.get(line, 0) + 1
        out.add((line, seen[line]))
    return out


def test_likeness_of_short_lines_against_plain_sets(spark):
    rng = np.random.default_rng(13)
    rows = [(k, "\n".join(f"line {x}" for x in rng.integers(0, 12, rng.integers(1, 30)))) for k in range(80)]
    got = {r.doc_id: r for r in op.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        following = dict(rows)[k - 1 if k else 79]
        half = len(text) // 2
        a, b, c = map(figures_by_hand, (text, text[: len(text) - half] + following[:half], following))
        assert got[k].near_edited == pytest.approx(len(a & b) / len(a | b)) and got[k].near_next == pytest.approx(len(a & c) / len(a | c))
