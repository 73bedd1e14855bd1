from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from spindle.llm import op10_simhash as op
from spindle.llm.queries import simhash

from .edges import documents, empty


def print_by_hand(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components_by_hand(rows):
    """rows: (doc_id, print); by comparing all distinct prints."""
    prints = sorted({p for _, p in rows})
    values = np.array(prints, dtype=np.uint64)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, p in enumerate(prints):
        near = np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4
        for q in values[i + 1 :][near]:
            a, b = find(p), find(int(q))
            root[max(a, b)] = min(a, b)
    least = {}
    for d, p in rows:
        if d is not None:
            least[find(p)] = min(least.get(find(p), d), d)
    return Counter((d, f"{p:016x}", least.get(find(p))) for d, p in rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, small, sf):
    place = small.replace("sf0.001", sf)
    docs = spark.read.parquet(f"{place}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(map(tuple, simhash(spark, place).collect())) == components_by_hand([(d, print_by_hand(t)) for d, t in docs])


@pytest.mark.parametrize("extra", [False, True])
def test_edges(spark, extra):
    docs = documents(spark, extra=extra)
    got = op.near_duplicates(docs).collect()
    rows = [(r.doc_id, print_by_hand(r.text)) for r in docs.collect()]
    assert Counter((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got) == components_by_hand(rows)
    kept = op.one_of_each(docs).collect()
    assert all(len(r) == len(docs.columns) for r in kept)
    assert Counter(r.doc_id for r in kept if r.doc_id is not None) == Counter({c for _, _, c in components_by_hand(rows) if c is not None})


def test_components_without_any_id_keep_one_row(spark):
    docs = documents(spark, [(None, "w x y z", "en", "a", 7), (None, "w x y z", "en", "a", 7), (None, "other words in here now", "en", "a", 7), (3, "third text of all", None, None, 1)])
    assert sorted(r.text for r in op.one_of_each(docs).collect()) == ["other words in here now", "third text of all", "w x y z"]


def test_empty(spark):
    assert op.near_duplicates(empty(spark)).collect() == []
    assert op.one_of_each(empty(spark)).collect() == []


def test_tree_finds_what_comparison_finds():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40)
    values = sorted({int(b) ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 6))) for b in base for _ in range(8)})
    tree = op.BKTree()
    for v in values:
        tree.add(v)
    for q in values[::7]:
        assert sorted(tree.within(q, 4)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 4]


@pytest.mark.parametrize("n", [1, 10**6, 10**8, 10**12])
def test_masks_lose_no_pair(n):
    rng = np.random.default_rng(n % 97)
    masks = [m & (1 << 64) - 1 for m in op.block_masks(n)]
    for _ in range(300):
        flips = sum({1 << int(k) for k in rng.integers(0, 64, 4)})
        assert any(flips & m == 0 for m in masks)


def test_large_shards_are_cut_without_loss(spark):
    rng = np.random.default_rng(8)
    values = sorted({int(sum({1 << int(k) for k in rng.integers(0, 64, rng.integers(1, 4))})) for _ in range(400)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    tree = op.components(op.links(df, len(signed), tree=16)).collect()
    got = {r.node: r.root for r in tree}
    expected = components_by_hand(list(zip(signed, values, strict=True)))
    root = {v: got.get(v, v) for v in signed}
    groups = Counter(root.values())
    assert sorted(groups.values()) == sorted(Counter(c for _, _, c in expected).values())


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    assert {(r.node, r.root) for r in op.components(edges).collect()} == {(i, 0) for i in range(1, 301)}


def test_each_component_keeps_one_row_when_texts_share_an_id(spark):
    a, b, c = ("first words of all here", "another text with its own words", "a third one that nobody else has")
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (4, a)]
    docs = documents(spark, [(d, t, "en", "a", len(t)) for d, t in rows])
    assert Counter((r.doc_id, r.text) for r in op.one_of_each(docs).collect()) == Counter([(1, a), (1, b), (3, c)])


def test_oversized_shards_are_dealt_again(spark, monkeypatch):
    """Prints that agree on most bits, in one shard of every choice of blocks."""
    rng = np.random.default_rng(11)
    values = sorted({int(rng.integers(0, 1 << 20)) << 44 | 5 for _ in range(1500)} | {int(rng.integers(0, 1 << 20)) | 7 << 40 for _ in range(1500)})
    signed = [op.signed(v) for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    expected = components_by_hand(list(zip(signed, values, strict=True)))
    for levels in (6, 1):
        monkeypatch.setattr(op, "LEVELS", levels)
        got = {r.node: r.root for r in op.components(op.links(df, len(signed), tree=64)).collect()}
        assert sorted(Counter(got.get(v, v) for v in signed).values()) == sorted(Counter(c for _, _, c in expected.elements()).values())


def words_of(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def alike_by_hand(rows, similarity=0.8):
    """rows: (key, text); the groups of keys that links of Jaccard similarity form, by comparing all sets."""
    sets = {}
    for k, t in rows:
        sets.setdefault(words_of(t), []).append(k)
    distinct = sorted(sets, key=len)
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for j in range(i):
            b = distinct[j]
            if len(b) >= similarity * len(a) and find(i) != find(j):
                both = len(a & b)
                if both >= similarity * (len(a) + len(b) - both) and both:
                    root[find(i)] = find(j)
    groups = {}
    for i, a in enumerate(distinct):
        groups.setdefault(find(i), []).extend(sets[a])
    return sorted(sorted(g, key=str) for g in groups.values())


def groups_of(found):
    groups = {}
    for r in found:
        groups.setdefault(r.root, []).append(r.doc_id)
    return sorted(sorted(g, key=str) for g in groups.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_alike_on_a_whole_table(spark, small, sf):
    docs = spark.read.parquet(f"{small.replace('sf0.001', sf)}/documents.parquet")
    assert groups_of(op.alike(docs).collect()) == alike_by_hand([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("tree", [4096, 40])
def test_large_blocks_are_compared_part_by_part(spark, monkeypatch, tree):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(op, "TREE", tree)
    rows = []
    for base in range(3):
        words = [f"b{base}w{i}" for i in range(120)]
        for k in range(90):
            own = list(words)
            for at in rng.integers(0, 120, rng.integers(0, 5)):
                own[at] = f"x{rng.integers(0, 50)}"
            rows.append((base * 1000 + k, " ".join(own), "en", "a", 1))
    docs = documents(spark, rows)
    by_hand = alike_by_hand([(r[0], r[1]) for r in rows])
    assert groups_of(op.alike(docs).collect()) == by_hand and 3 <= len(by_hand) < 200
    assert sorted(r.doc_id for r in op.one_of_each(docs, width=5, similarity=0.8).collect()) == sorted(min(g) for g in by_hand)


@pytest.mark.parametrize("extra", [False, True])
def test_alike_edges(spark, extra):
    docs = documents(spark, extra=extra)
    kept = op.one_of_each(docs, width=5, similarity=0.8).collect()
    assert all(len(r) == len(docs.columns) for r in kept)
    groups = alike_by_hand([((r.doc_id is None, r.doc_id or 0), r.text) for r in docs.collect()])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(min(g) for g in groups)
    assert op.alike(empty(spark)).collect() == []


def test_pairs_at_the_threshold_share_a_shard():
    rng = np.random.default_rng(9)
    missed = 0
    for _ in range(2000):
        both = rng.integers(0, 1 << 63, 160, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, 20, dtype=np.uint64)])) for _ in range(2))
        assert abs(op.likeness(a, b) - 0.8) < 1e-9
        missed += not (op.shard_keys(a) == op.shard_keys(b)).any()
    assert missed <= 10
